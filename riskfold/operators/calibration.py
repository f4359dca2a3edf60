"""Probability calibration: sigmoid and isotonic maps, fitted and applied as Spark jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.functions.scalars import clip_probability
from riskfold.functions.scaling import written
from riskfold.operators.curves import is_counted
from riskfold.operators.isotonic import apply_knots, isotonic_knots
from riskfold.operators.summaries import finite_filter

CLIP = 1e-6
METHODS = ("sigmoid", "isotonic")
KNOTS = "x double, y double"


@dataclass(frozen=True)
class Sigmoid:
    """``1 / (1 + exp(-(a * t(p) + b)))``. The input transform travels with the map."""

    a: float
    b: float
    logit: bool = False
    clip: float = CLIP

    def apply(self, p: Column) -> Column:
        return 1 / (1 + F.exp(-(self.a * sigmoid_input(p, self.logit, self.clip) + self.b)))

    def calibrate(self, df: DataFrame, score: str = "p", name: str = "p_cal") -> DataFrame:
        return df.withColumn(name, self.apply(F.col(score)))

    def to_dict(self) -> dict:
        return {"method": "sigmoid", **asdict(self)}

    def save(self, path: str) -> dict:
        return self.to_dict()


@dataclass(frozen=True)
class Isotonic:
    """Monotone piecewise-linear map, flat outside its knots: a written table of ``x, y``."""

    knots: DataFrame

    def calibrate(self, df: DataFrame, score: str = "p", name: str = "p_cal") -> DataFrame:
        return apply_knots(df, self.knots, (), score, name)

    def to_dict(self) -> dict:
        return {"method": "isotonic"}

    def save(self, path: str) -> dict:
        self.knots.coalesce(1).write.mode("overwrite").parquet(f"{path}/knots")
        return self.to_dict()


Calibrator = Sigmoid | Isotonic


def load(spark: SparkSession, details: dict, path: str) -> Calibrator:
    """The map that ``save`` wrote under ``path`` and described by ``details``."""
    details = dict(details)
    if details.pop("method") == "sigmoid":
        return Sigmoid(**details)
    return Isotonic(spark.read.schema(KNOTS).parquet(f"{path}/knots"))


def sigmoid_input(p: Column, logit: bool, clip: float) -> Column:
    if not logit:
        return p
    q = clip_probability(p, clip)
    return F.log(q / (1 - q))


def distinct_scores(scores: DataFrame, x: Column) -> DataFrame:
    """``x, pos, n``: equal scores pooled, so that fitting sees distinct values only.

    ``scores`` are rows with ``y_true``, or counts of them.
    """
    pos, n = (F.col("pos"), F.col("n")) if is_counted(scores) else (F.col("y_true"), F.lit(1))
    rows = scores.select(x.alias("x"), pos.alias("pos"), n.alias("n"))
    return rows.groupBy("x").agg(
        F.sum(F.col("pos").cast("double")).alias("pos"), F.sum(F.col("n").cast("double")).alias("n")
    )


def _logistic(rows: DataFrame, reg: float) -> tuple[float, float]:
    """Slope and intercept of weighted ``(x, label, weight)`` rows."""
    model = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        regParam=reg,
        elasticNetParam=0.0,
        standardization=False,
        tol=1e-10,
        maxIter=2000,
    ).fit(rows.select(array_to_vector(F.array("x")).alias("features"), "label", "weight"))
    return float(model.coefficients[0]), float(model.intercept)


def _two_rows(pooled: DataFrame, weight_pos: Column, weight_neg: Column) -> DataFrame:
    """One label-1 and one label-0 row per distinct score, with their weights."""
    cells = F.array(
        F.struct(F.lit(1.0).alias("label"), weight_pos.alias("weight")),
        F.struct(F.lit(0.0).alias("label"), weight_neg.alias("weight")),
    )
    return pooled.select("x", F.inline(cells)).filter(F.col("weight") > 0)


def _pooled(scores: DataFrame, logit: bool, clip: float) -> DataFrame:
    """Distinct scores, written: a kept frame would have a task for every shuffle partition."""
    return written(distinct_scores(scores, sigmoid_input(F.col("p"), logit, clip)), "pooled-scores")


def fit_sigmoid(scores: DataFrame, logit: bool = False, clip: float = CLIP) -> Sigmoid:
    """L2-regularized logistic map of ``(p, y_true)``: half the squared slope plus log-loss."""
    pooled = _pooled(scores, logit, clip)
    n = pooled.agg(F.sum("n")).first()[0]
    rows = _two_rows(pooled, F.col("pos"), F.col("n") - F.col("pos"))
    a, b = _logistic(rows, 1.0 / n)
    return Sigmoid(a, b, logit, clip)


def fit_smoothed_sigmoid(scores: DataFrame, logit: bool = False, clip: float = CLIP) -> Sigmoid:
    """Unregularized logistic map onto Platt's smoothed targets."""
    pooled = _pooled(scores, logit, clip)
    n, pos = pooled.agg(F.sum("n"), F.sum("pos")).first()
    high, low = (pos + 1) / (pos + 2), 1 / (n - pos + 2)
    p, q = F.col("pos"), F.col("n") - F.col("pos")
    rows = _two_rows(pooled, p * high + q * low, p * (1 - high) + q * (1 - low))
    a, b = _logistic(rows, 0.0)
    return Sigmoid(a, b, logit, clip)


def fit_isotonic(scores: DataFrame) -> Isotonic:
    """Monotone least-squares map of ``(p, y_true)``."""
    return Isotonic(written(isotonic_knots(scores).select("x", "y"), "isotonic-knots"))


def has_two_classes(scores: DataFrame) -> bool:
    """Whether the finite rows hold both labels."""
    low, high = finite_filter(scores).agg(F.min("y_true"), F.max("y_true")).first()
    return low is not None and low != high


def two_classes(scores: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    y = F.col("y_true")
    return finite_filter(scores).groupBy(*by).agg((F.min(y) != F.max(y)).alias("both_classes"))


def fit_calibrator(
    scores: DataFrame, method: str, logit: bool = False, clip: float = CLIP
) -> Calibrator | None:
    """Deployable map from finite, clipped out-of-fold scores; ``None`` without both classes."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    rows = finite_filter(scores).withColumn("p", clip_probability(F.col("p"), clip))
    if not has_two_classes(rows):
        return None
    return fit_isotonic(rows) if method == "isotonic" else fit_sigmoid(rows, logit, clip)


def calibrator_meta(
    scores: DataFrame, method: str, clip: float = CLIP, by: Sequence[str] = ()
) -> DataFrame:
    """Size and prevalence of the calibration rows with the settings used."""
    y = F.col("y_true").cast("bigint")
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_oof"), F.sum(y).alias("n_pos"), F.avg(y).alias("prevalence")
    ).select("*", F.lit(method).alias("method"), F.lit(float(clip)).alias("clip"))
