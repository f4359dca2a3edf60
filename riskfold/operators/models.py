"""Class-balanced forests: parameter draws, search, prediction, the meta-model, OOF tables."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool
from queue import SimpleQueue
from random import Random

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.functions.scalars import col
from riskfold.functions.scaling import fits_one_task, written
from riskfold.operators.blocks import is_block, slot_names
from riskfold.operators.cohort import ID, LABEL
from riskfold.operators.curves import ap_sum, cumulative_curve
from riskfold.operators.features import (
    balanced_weights,
    class_sizes,
    class_weights,
    feature_names,
    fit_preparation,
    guard_blocks,
    prepare_inputs,
    split_feature_types,
)
from riskfold.operators.folds import INNER_CV_SEED, SEARCH_SEED, fold_sizes, stratified_folds

DEEPEST = 30  # the deepest tree Spark grows; stands for "unlimited"
SHALLOW = 8  # up to this depth a row is walked down its trees anew for each level of a fit
HELD_NODES = 1 << 18  # a search scores forests together that have at most so many nodes
HELD_FORESTS = 16

# The two search spaces. A range is drawn uniformly from its members, a
# pair of floats uniformly between them, a tuple of texts or a list by choice.
MULTI_SPACE = {
    "trees": range(50, 250),
    "depth": range(3, 11),
    "min_split": range(2, 16),
    "min_leaf": range(3, 21),
    "features": ("sqrt", "0.5", "0.7"),
    "subsample": (0.60, 0.95),
}
SINGLE_SPACE = {
    "trees": range(50, 300),
    "depth": [None, *range(2, 15)],
    "min_split": range(2, 20),
    "min_leaf": range(1, 15),
    "features": ("sqrt", "log2", "0.3", "0.5"),
}


@dataclass(frozen=True)
class ForestParams:
    """Hyper-parameters of one forest."""

    trees: int = 100
    depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    features: str = "sqrt"
    subsample: float = 1.0

    @property
    def min_rows(self) -> int:
        """Rows each child needs. Two leaves need ``2 * min_leaf`` rows anyway, so a
        smaller ``min_split`` says nothing; a larger one is approximated by halves."""
        return max(self.min_leaf, math.ceil(self.min_split / 2))

    @property
    def most_nodes(self) -> int:
        depth = DEEPEST if self.depth is None else self.depth
        return self.trees * 2 ** (depth + 1)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


class FitSlots:
    """Lets at most ``n`` pieces of fitting work run at a time, however searches are nested.

    Each slot is a scheduler pool of its own: where ``spark.scheduler.mode`` is FAIR the
    running fits get equal shares of the cluster instead of queueing behind the largest.
    """

    POOL = "spark.scheduler.pool"

    def __init__(self, n: int):
        self._free = SimpleQueue()
        for i in range(max(1, n)):
            self._free.put(i)

    @contextmanager
    def taken(self, spark: SparkSession) -> Iterator[None]:
        """Waits for a free slot and holds it. Never wait for another slot inside."""
        slot = self._free.get()
        before = spark.sparkContext.getLocalProperty(self.POOL)
        spark.sparkContext.setLocalProperty(self.POOL, f"fit-{slot}")
        try:
            yield
        finally:
            spark.sparkContext.setLocalProperty(self.POOL, before)
            self._free.put(slot)


@dataclass(frozen=True)
class SearchConfig:
    """Sizes of the nested cross-validation, seed, and how many fits run at once.

    ``parallelism`` bounds the fits of all searches that use one configuration object.
    ``hashed`` names text columns that get a fixed number of hashed slots instead of one
    indicator a level.
    """

    outer_folds: int = 10
    inner_folds: int = 5
    draws: int = 30
    seed: int = 42
    space: Mapping = field(default_factory=lambda: MULTI_SPACE)
    parallelism: int = 4
    hashed: Mapping[str, int] = field(default_factory=dict)
    slots: FitSlots = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "slots", FitSlots(self.parallelism))


def sample_param_grid(space: Mapping, n: int, seed: int) -> list[ForestParams]:
    """``n`` independent seeded draws from a search space."""
    rng = Random(seed)

    def draw(choices):
        if isinstance(choices, tuple) and all(isinstance(c, float) for c in choices):
            return rng.uniform(*choices)
        return rng.choice(list(choices))

    return [ForestParams(**{k: draw(v) for k, v in space.items()}) for _ in range(n)]


def forest(params: ForestParams, seed: int) -> RandomForestClassifier:
    if params.depth is not None and params.depth > DEEPEST:
        raise ValueError(f"depth {params.depth}: at most {DEEPEST}, or None for the deepest")
    depth = DEEPEST if params.depth is None else params.depth
    return RandomForestClassifier(
        featuresCol="features",
        labelCol=LABEL,
        weightCol="weight",
        numTrees=params.trees,
        maxDepth=depth,
        cacheNodeIds=depth > SHALLOW,
        minInstancesPerNode=params.min_rows,
        featureSubsetStrategy=params.features,
        subsamplingRate=params.subsample,
        bootstrap=True,
        seed=seed,
    )


def positive_probability(name: str = "probability") -> Column:
    return vector_to_array(name)[1]


def step_precisions(scored: Sequence[DataFrame], few: bool = False) -> list[float]:
    """Step-sum average precision of the class-1 probability of each frame, without binning.

    All frames share the passes of one curve, as in ``model_precisions``.
    """
    scores = union_all(
        df.select(F.lit(i).alias("model"), positive_probability().alias("p"), F.col(LABEL))
        for i, df in enumerate(scored)
    )
    return model_precisions(scores, len(scored), few)


def held_scores(
    rows: DataFrame, fold: str, fitted: Sequence[tuple[RandomForestClassificationModel, int]]
) -> DataFrame:
    """``model`` (its number)``, p, label``: the score of each forest on the fold beside it.

    The forests of one fold share a scan of its rows, so their output columns are renamed.
    """

    def of(k: int) -> DataFrame:
        out, cells = rows.filter(F.col(fold) == k), []
        for i, (model, held) in enumerate(fitted):
            if held == k:
                name = f"_prob{i}"
                model.setRawPredictionCol("").setPredictionCol("").setProbabilityCol(name)
                out = model.transform(out)
                cells.append(F.struct(F.lit(i).alias("model"), positive_probability(name).alias("p")))
        return out.select(F.col(LABEL), F.inline(F.array(*cells)))

    return union_all(of(k) for k in sorted({k for _, k in fitted}))


def model_precisions(scores: DataFrame, n: int, few: bool = False) -> list[float]:
    """Step-sum average precision of the models 0 to ``n - 1`` in ``model, p, label``.

    ``few`` says that one task can sort the scores of a model, so they need no buckets and are
    read once and shuffled once.
    """
    if few:
        scores = scores.repartition("model")
    else:
        scores.persist()  # the trees score the rows once for both passes of the curve
    try:
        curve = cumulative_curve(scores, edges=[] if few else None)
        rows = curve.groupBy("model").agg(ap_sum().alias("auprc")).collect()
    finally:
        if not few:
            scores.unpersist()
    found = {r.model: r.auprc for r in rows}
    return [float(found[i]) if found.get(i) is not None else 0.0 for i in range(n)]


def with_classes(rows: DataFrame, classes: int) -> DataFrame:
    """Notes the number of classes at the label, so that a fit does not scan the rows for it."""
    noted = {"ml_attr": {"type": "nominal", "num_vals": classes}}
    return rows.withColumn(LABEL, F.col(LABEL).cast("double").alias(LABEL, metadata=noted))


@dataclass
class FittedForest:
    """Preparation and forest with their input columns by name.

    ``blocks`` holds the slot names of the packed inputs (see ``operators.blocks``).
    """

    preparation: PipelineModel
    model: RandomForestClassificationModel
    numeric: list[str]
    categorical: list[str]
    params: ForestParams
    search: list[tuple[ForestParams, float]] = field(default_factory=list)
    blocks: dict[str, list[str]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        """Name of every feature vector slot."""
        return feature_names(self.preparation, self.numeric, self.blocks)

    def vectors(self, df: DataFrame, keep: Sequence[str] = (ID,)) -> DataFrame:
        """``keep`` and the feature vector. Inputs are matched by name only."""
        # Kept columns travel in a struct: one may share its name with an input.
        packed = df.withColumn("_keep", F.struct(*[col(k) for k in keep]))
        inputs = prepare_inputs(packed, self.numeric, self.categorical, ["_keep"], self.blocks)
        inputs = guard_blocks(inputs, self.preparation, self.blocks)
        return self.preparation.transform(inputs).select("_keep.*", "features")

    def predict(self, df: DataFrame, keep: Sequence[str] = (ID,), name: str = "p") -> DataFrame:
        """``keep`` and the probability of class 1."""
        out = self.model.transform(self.vectors(df, keep))
        return out.select(*[col(k) for k in keep], positive_probability().alias(name))


@dataclass
class TrainingRows:
    """Fitted preparation and ``id, label, _tie, features, weight`` of a training frame.

    ``sizes`` are the rows of each class.
    """

    preparation: PipelineModel
    rows: DataFrame
    numeric: list[str]
    categorical: list[str]
    blocks: dict[str, list[str]]
    sizes: dict[int, int]

    def fitted(self, model, params: ForestParams, search=()) -> FittedForest:
        return FittedForest(
            self.preparation, model, self.numeric, self.categorical, params, list(search), self.blocks
        )


def training_vectors(
    df: DataFrame,
    columns: Sequence[str],
    allow_missing: bool = False,
    hashed: Mapping[str, int] | None = None,
) -> TrainingRows:
    numeric, categorical = split_feature_types(df, columns)
    blocks = {c: slot_names(df, c) for c in numeric if is_block(df, c)}
    inputs = prepare_inputs(df, numeric, categorical, [ID, LABEL], blocks)
    preparation = fit_preparation(inputs, numeric, categorical, allow_missing, hashed=hashed)
    inputs = guard_blocks(inputs, preparation, blocks)
    tie = F.xxhash64(*[col(c) for c in [*numeric, *categorical]])
    vectors = preparation.transform(inputs.withColumn("_tie", tie)).select(
        ID, LABEL, "_tie", "features"
    )
    sizes = class_sizes(vectors)
    rows = balanced_weights(vectors, sizes=sizes)
    return TrainingRows(preparation, rows, numeric, categorical, blocks, sizes)


def balanced_partitions(rows: DataFrame) -> DataFrame:
    """Partitions decided by id and row content, in a fixed order inside.

    So a fit does not depend on how its input was laid out. Copies of one id scatter by
    content; where even equal rows fill a partition, the rebalance splits it by size.
    """
    return rows.hint("rebalance", ID, "_tie").sortWithinPartitions(ID, "_tie")


def fit_forest(
    df: DataFrame,
    columns: Sequence[str],
    params: ForestParams,
    seed: int,
    allow_missing: bool = False,
    hashed: Mapping[str, int] | None = None,
) -> FittedForest:
    """One forest with given parameters. Equal inputs and seed give an equal forest."""
    train = training_vectors(df, columns, allow_missing, hashed)
    rows = balanced_partitions(train.rows).persist()
    try:
        model = forest(params, seed).fit(rows)
    finally:
        rows.unpersist()
    return train.fitted(model, params)


def fit_tuned(
    df: DataFrame,
    columns: Sequence[str],
    cfg: SearchConfig,
    seed_offset: int = 0,
    allow_missing: bool = False,
) -> FittedForest:
    """Random search by average precision over stratified inner folds, best refitted on all.

    Indicator columns are learned once on the training rows: a level that an inner
    training part lacks is a constant column there, which no tree can split on. The
    vectors are written once, in as many files as their size asks for, so the tasks of a fit
    and the plans over it stay few; every (draw, fold) pair is a filter of them and waits for
    a slot of the configuration, as the preparation and the refit do. Small forests are
    scored together, large ones one by one. Of equally good draws the first wins.
    """
    spark, seed = df.sparkSession, cfg.seed + seed_offset
    draws = sample_param_grid(cfg.space, cfg.draws, seed + SEARCH_SEED)
    with cfg.slots.taken(spark):
        train = training_vectors(df, columns, allow_missing, cfg.hashed)
        few = fits_one_task(sum(train.sizes.values()))
        rows = stratified_folds(
            train.rows, cfg.inner_folds, seed + INNER_CV_SEED, name="inner", tie=["_tie"], few=few
        )
        rows = written(balanced_partitions(rows), "search")
        filled = fold_sizes(train.sizes, cfg.inner_folds)
    folds = range(1, cfg.inner_folds + 1)
    n = len({k for k, _ in filled})
    if n < cfg.inner_folds:
        raise ValueError(f"{n} of {cfg.inner_folds} inner folds have rows")

    def seen(fold: int | None) -> DataFrame:
        kept = rows if fold is None else rows.filter(F.col("inner") != fold)
        return with_classes(kept, 1 + max(label for k, label in filled if k != fold))

    # One frame for all draws: Spark plans a frame's rows once, however many fits read it.
    training = {k: seen(k) for k in [*folds, None]}

    def fit(draw: ForestParams, fold: int | None = None) -> RandomForestClassificationModel:
        """The forest without one inner fold, or on all rows."""
        with cfg.slots.taken(spark):
            return forest(draw, seed).fit(training[fold])

    def score(pairs: Sequence[tuple[ForestParams, int]]) -> list[float]:
        fits = [(lambda d=d, k=k: fit(d, k)) for d, k in pairs]
        fitted = in_parallel(spark, fits, cfg.parallelism)
        with cfg.slots.taken(spark):
            held = held_scores(rows, "inner", [(m, k) for m, (_, k) in zip(fitted, pairs)])
            return model_precisions(held, len(fitted), few)

    batches = forest_batches([(d, k) for d in draws for k in folds])
    tasks = [(lambda b=b: score(b)) for b in batches]
    found = sum(in_parallel(spark, tasks, cfg.parallelism), [])
    means = np.reshape(found, (len(draws), cfg.inner_folds)).mean(axis=1)
    best = draws[int(np.argmax(means))]
    model = fit(best)
    return train.fitted(model, best, [(d, float(m)) for d, m in zip(draws, means)])


def forest_batches(
    pairs: Iterable[tuple[ForestParams, int]],
) -> list[list[tuple[ForestParams, int]]]:
    """The pairs of draw and fold in order, in groups whose forests the driver may hold at once."""
    batches, nodes = [], 0
    for pair in pairs:
        nodes += pair[0].most_nodes
        if not batches or nodes > HELD_NODES or len(batches[-1]) == HELD_FORESTS:
            batches.append([])
            nodes = pair[0].most_nodes
        batches[-1].append(pair)
    return batches


# ---------------------------------------------------------------- meta-model


@dataclass(frozen=True)
class MetaModel:
    """Logistic model of the base probabilities, inputs matched by name."""

    coefficients: dict[str, float]
    intercept: float

    def margin(self, prefix: str = "p_") -> Column:
        total = F.lit(self.intercept)
        for name, c in self.coefficients.items():
            total = total + c * col(prefix + name)
        return total

    def probability(self, prefix: str = "p_") -> Column:
        return 1 / (1 + F.exp(-self.margin(prefix)))


def fit_meta(df: DataFrame, names: Sequence[str], prefix: str = "p_") -> MetaModel:
    """Class-balanced L2 logistic regression whose intercept is penalized as well.

    Spark never fits a constant column and never penalizes the intercept, so ``[x, 1]``
    is turned by a fixed orthogonal matrix, which mixes the constant into every column
    and leaves the norm of the coefficients as it was, and the solution is turned back.
    """
    m = len(names) + 1
    v = np.ones(m)
    v[-1] += math.sqrt(m)  # reflection vector without zero mixing entries
    turn = np.eye(m) - 2 * np.outer(v, v) / (v @ v)
    x = [col(prefix + n).cast("double") for n in names] + [F.lit(1.0)]
    turned = [
        reduce(lambda a, b: a + b, [float(turn[i, j]) * x[i] for i in range(m)]) for j in range(m)
    ]
    rows = df.select(LABEL, array_to_vector(F.array(*turned)).alias("features"))
    sizes = class_sizes(rows)
    # The balanced weights of all rows, from the counts they are made of.
    total = math.fsum(sizes[k] * w for k, w in class_weights(rows, sizes=sizes).items())
    rows = balanced_weights(rows, sizes=sizes).persist()
    try:
        model = LogisticRegression(
            featuresCol="features",
            labelCol=LABEL,
            weightCol="weight",
            regParam=1.0 / total,
            elasticNetParam=0.0,
            fitIntercept=False,
            standardization=False,
            maxIter=5000,
            tol=1e-10,
        ).fit(rows)
    finally:
        rows.unpersist()
    beta = turn @ model.coefficients.toArray()
    return MetaModel({n: float(b) for n, b in zip(names, beta)}, float(beta[-1]))


# ---------------------------------------------------------------- predictions of many fits


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def in_parallel(spark: SparkSession, tasks: Sequence[Callable], threads: int) -> list:
    """Run independent fits from a few driver threads; Spark schedules their jobs."""
    if threads <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    pool = ThreadPool(min(threads, len(tasks)))
    try:
        run = inheritable_thread_target(spark)(lambda t: t())
        return pool.map(run, tasks, chunksize=1)
    finally:
        pool.close()


def assemble_oof(
    long: DataFrame, names: Sequence[str], keys: Sequence[str] = (ID, "fold_id", LABEL)
) -> DataFrame:
    """Wide out-of-fold table: one ``proba_<model>`` column per model."""
    wide = long.groupBy(*keys).pivot("model", list(names)).agg(F.first("p"))
    return wide.select(*keys, *[col(n).alias(f"proba_{n}") for n in names])
