"""Calibration inside the training part: refit on k-1 parts, map on the k-th, average."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.functions.scalars import col
from riskfold.functions.scaling import written
from riskfold.operators.calibration import Calibrator, fit_isotonic, fit_smoothed_sigmoid
from riskfold.operators.cohort import ID, LABEL
from riskfold.operators.features import balanced_weights
from riskfold.operators.folds import stratified_folds
from riskfold.operators.models import (
    FittedForest,
    MetaModel,
    SearchConfig,
    balanced_partitions,
    fit_meta,
    forest,
    in_parallel,
    positive_probability,
)

MARGIN_CLIP = 1e-15  # only keeps the log-odds finite


def _fit_map(scores: DataFrame, method: str, margin: bool) -> Calibrator:
    if method == "isotonic":
        return fit_isotonic(scores)
    return fit_smoothed_sigmoid(scores, logit=margin, clip=MARGIN_CLIP if margin else 0.0)


def _average(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts) / len(parts)


@dataclass
class CalibratedForest:
    """Refits of one forest, each with the map fitted on the part it did not see."""

    base: FittedForest
    parts: list[tuple[RandomForestClassificationModel, Calibrator]]

    def predict(self, df: DataFrame, keep: Sequence[str] = (ID,), name: str = "p") -> DataFrame:
        """``keep`` and the mean calibrated probability; sigmoid refits are one narrow plan."""
        out = self.base.vectors(df, keep)
        for i, (model, cal) in enumerate(self.parts):
            model = model.copy().setProbabilityCol(f"_prob{i}")
            out = model.setRawPredictionCol("").setPredictionCol("").transform(out)
            out = out.withColumn(f"_prob{i}", positive_probability(f"_prob{i}"))
            out = cal.calibrate(out, f"_prob{i}", f"_cal{i}")
        mapped = [F.col(f"_cal{i}") for i in range(len(self.parts))]
        return out.select(*[col(k) for k in keep], _average(mapped).alias(name))


def calibrated_forest(
    fitted: FittedForest,
    train: DataFrame,
    method: str,
    k: int,
    seed: int,
    cfg: SearchConfig,
) -> CalibratedForest:
    """Same hyper-parameters on k-1 stratified parts, the map on the remaining part.

    Each part waits for a slot of ``cfg``, like the fits of a search.
    """
    spark = train.sparkSession
    inputs = [*fitted.numeric, *fitted.categorical]
    tied = train.withColumn("_tie", F.xxhash64(*[col(c) for c in inputs]))
    vectors = fitted.vectors(tied, [ID, LABEL, "_tie"])
    rows = stratified_folds(vectors, k, seed, name="part", tie=["_tie"])
    rows = written(balanced_partitions(rows), "calibration")

    def task(i: int):
        with cfg.slots.taken(spark):
            seen = balanced_weights(rows.filter(F.col("part") != i))
            model = forest(fitted.params, seed).fit(seen)
            scored = model.transform(rows.filter(F.col("part") == i))
            scored = scored.select(positive_probability().alias("p"), LABEL)
            return model, _fit_map(scored, method, margin=False)

    jobs = [(lambda i=i: task(i)) for i in range(1, k + 1)]
    return CalibratedForest(fitted, in_parallel(spark, jobs, cfg.parallelism))


@dataclass
class CalibratedMeta:
    """Refits of the meta-model, each with the map fitted on the part it did not see."""

    parts: list[tuple[MetaModel, Calibrator]]

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        """``df`` with the mean calibrated probability."""
        out = df
        for i, (meta, cal) in enumerate(self.parts):
            out = cal.calibrate(out.withColumn(f"_raw{i}", meta.probability()), f"_raw{i}", f"_cal{i}")
        added = [f"_{k}{i}" for k in ("raw", "cal") for i in range(len(self.parts))]
        mapped = _average([F.col(f"_cal{i}") for i in range(len(self.parts))])
        return out.withColumn(name, mapped).drop(*added)


def calibrated_meta(
    rows: DataFrame, names: Sequence[str], method: str, k: int, seed: int
) -> CalibratedMeta:
    """The same for the meta-model, whose sigmoid map reads the log-odds rather than p."""
    parts = written(stratified_folds(rows, k, seed, name="part"), "calibration-meta")

    def task(i: int):
        meta = fit_meta(parts.filter(F.col("part") != i), names)
        scored = parts.filter(F.col("part") == i).select(meta.probability().alias("p"), LABEL)
        return meta, _fit_map(scored, method, margin=True)

    jobs = [(lambda i=i: task(i)) for i in range(1, k + 1)]
    return CalibratedMeta(in_parallel(rows.sparkSession, jobs, k))
