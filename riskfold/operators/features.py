"""Feature preparation: type split, indicators, assembly, alignment by name, class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    FeatureHasher,
    OneHotEncoder,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.functions.scalars import col
from riskfold.operators import blocks as packed
from riskfold.operators.cohort import LABEL

NULL_LEVEL = "__null__"  # null is a level of its own


def split_feature_types(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns by schema; other types take no part.

    A packed block of numbers counts as one numeric column.
    """
    numeric, categorical = [], []
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
            categorical.append(c)
        elif isinstance(kind, (T.NumericType, T.BooleanType, VectorUDT)):
            numeric.append(c)
    return numeric, categorical


def prepare_inputs(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    keep: Sequence[str] = (),
    blocks: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Model inputs by name: numbers as doubles, text with a level for null.

    A column the frame lacks becomes NaN or the null level; extra columns are dropped.
    ``blocks`` gives the slots of packed numbers, which are matched by name as well.
    """
    have, blocks = set(df.columns), blocks or {}
    numbers = [
        packed.aligned(df, c, blocks[c])
        if c in blocks
        else (col(c).cast("double") if c in have else F.lit(float("nan"))).alias(c)
        for c in numeric
    ]
    texts = [
        (F.coalesce(col(c), F.lit(NULL_LEVEL)) if c in have else F.lit(NULL_LEVEL)).alias(c)
        for c in categorical
    ]
    return df.select(*[col(c) for c in keep], *numbers, *texts)


def guard_levels(df: DataFrame, categorical: Sequence[str], limit: int | None) -> None:
    """Refuse text columns with more than about ``limit`` levels (None: no limit)."""
    if not categorical or limit is None:
        return
    row = df.agg(*[F.approx_count_distinct(col(c)).alias(c) for c in categorical]).first()
    wide = {c: row[c] for c in categorical if row[c] > limit}
    if wide:
        raise ValueError(f"too many levels for indicator columns: {wide}")


def fit_preparation(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    allow_missing: bool = False,
    max_levels: int | None = None,
    hashed: Mapping[str, int] | None = None,
) -> PipelineModel:
    """Learn indicator columns on training rows; numbers pass through.

    A level unseen in training falls into the dropped last slot, so all its indicators
    are zero. Missing numbers are an error unless ``allow_missing``. The levels stay with
    the model on the driver: ``max_levels`` refuses id-like text columns. A column in
    ``hashed`` gets that many slots instead and its levels share them by hash: nothing is
    learned, listed or refused, however many levels there are, and a level unseen in
    training has a slot like any other.
    """
    hashed = {c: n for c, n in (hashed or {}).items() if c in categorical}
    categorical = [c for c in categorical if c not in hashed]
    guard_levels(df, categorical, max_levels)
    stages, inputs = [], list(numeric)
    if categorical:
        index = [f"{c}__index" for c in categorical]
        onehot = [f"{c}__onehot" for c in categorical]
        stages += [
            StringIndexer(
                inputCols=list(categorical),
                outputCols=index,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=index, outputCols=onehot, dropLast=True),
        ]
        inputs += onehot
    for c, slots in hashed.items():
        stages.append(FeatureHasher(inputCols=[c], outputCol=f"{c}__hashed", numFeatures=slots))
        inputs.append(f"{c}__hashed")
    stages.append(
        VectorAssembler(
            inputCols=inputs,
            outputCol="features",
            handleInvalid="keep" if allow_missing else "error",
        )
    )
    return Pipeline(stages=stages).fit(df)


def guard_blocks(
    inputs: DataFrame, preparation: PipelineModel, blocks: Mapping[str, Sequence[str]]
) -> DataFrame:
    """``inputs`` with an error in every row whose blocks miss a number the assembler refuses.

    The assembler itself looks at plain columns only.
    """
    if not blocks or preparation.stages[-1].getHandleInvalid() != "error":
        return inputs
    for c, slots in blocks.items():
        bad = F.exists(vector_to_array(col(c)), F.isnan)
        checked = F.when(bad, F.raise_error(F.lit(f"{c}: missing numbers"))).otherwise(col(c))
        inputs = inputs.withColumn(c, packed.named(checked, slots, c))
    return inputs


def feature_names(
    preparation: PipelineModel,
    numeric: Sequence[str],
    blocks: Mapping[str, Sequence[str]] | None = None,
) -> list[str]:
    """Names of the vector slots: columns, then indicators ``<column>_<level>``, then hashed
    slots ``<column>#<slot>``. A packed block stands for its slots."""
    names = [n for c in numeric for n in (blocks or {}).get(c, [c])]
    for stage in preparation.stages:
        if isinstance(stage, FeatureHasher):
            names += [f"{stage.getInputCols()[0]}#{i}" for i in range(stage.getNumFeatures())]
        if isinstance(stage, StringIndexerModel):
            for c, levels in zip(stage.getInputCols(), stage.labelsArray):
                names += [f"{c}_{level}" for level in levels]
    return names


def class_sizes(df: DataFrame, label: str = LABEL) -> dict[int, int]:
    """Rows of each class; a label that is not 0 or 1 is an error."""
    of = F.when(F.col(label).isin(0, 1), F.col(label))
    some = F.max(label).alias("example")
    rows = df.groupBy(of.alias("of")).agg(F.count(F.lit(1)).alias("n"), some).collect()
    bad = [(r.example, r.n) for r in rows if r.of is None]
    if bad:
        raise ValueError(f"{label}: {bad[0][1]} labels are not 0 or 1, for example {bad[0][0]}")
    return {r.of: r.n for r in rows}


def class_weights(
    df: DataFrame, label: str = LABEL, sizes: Mapping[int, int] | None = None
) -> dict[int, float]:
    """``rows / (classes * rows of the class)`` per class."""
    sizes = class_sizes(df, label) if sizes is None else sizes
    return {k: sum(sizes.values()) / (len(sizes) * n) for k, n in sizes.items()}


def balanced_weights(
    df: DataFrame, label: str = LABEL, name: str = "weight", sizes: Mapping[int, int] | None = None
) -> DataFrame:
    """Add the balanced class weight; the counts are a handful of literals, not a join."""
    c = F.lit(None).cast("double")
    for value, weight in class_weights(df, label, sizes).items():
        c = F.when(F.col(label) == value, F.lit(weight)).otherwise(c)
    return df.withColumn(name, c)
