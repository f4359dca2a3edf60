"""Cohort, fold, calibration and ranking summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.functions.scalars import clamp, is_finite
from riskfold.functions.scaling import attach_small
from riskfold.operators.curves import count_table, cumulative_curve, score_counts
from riskfold.operators.thresholds import SUMMARY_METRICS

DEFAULT_BINS = 10


def finite_filter(scores: DataFrame, p: str = "p", label: str = "y_true") -> DataFrame:
    """Rows whose probability and label are both finite."""
    return scores.filter(is_finite(F.col(p)) & is_finite(F.col(label)))


def cohort_summary(
    df: DataFrame, label: str = "y_true", by: Sequence[str] = ()
) -> DataFrame:
    """Rows, positives, negatives, prevalence."""
    y = F.col(label).cast("bigint")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("n_pos"),
        F.sum(1 - y).alias("n_neg"),
        F.avg(y).alias("prevalence"),
    )


def brier_score(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean squared error of the clamped probability with cohort sizes, best first."""
    p, y = clamp(F.col("p"), 0.0, 1.0), F.col("y_true")
    return (
        scores.groupBy(*by)
        .agg(
            F.avg((p - y) * (p - y)).alias("brier"),
            F.count(F.lit(1)).alias("n"),
            F.sum(y.cast("bigint")).alias("n_pos"),
            F.avg(y).alias("prevalence"),
        )
        .orderBy("brier", *by)
    )


def rank_models(metrics: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    """Position of each model by one metric; the input has one row per model."""
    key = F.asc(metric) if ascending else F.desc(metric)
    return metrics.withColumn("position", F.rank().over(Window.orderBy(key))).orderBy(
        "position", "model"
    )


def reliability_curve(
    scores: DataFrame, bins: int = DEFAULT_BINS, by: Sequence[str] = ("model",)
) -> DataFrame:
    """Mean score and positive rate in quantile bins.

    Edges are linearly interpolated order statistics, found from the cumulative counts
    rather than by collecting scores, so they are exact at any size. A score belongs to
    the bin numbered by the inner edges strictly below it; empty bins do not appear.
    Edges and bins read one table of counts.
    """
    by = list(by)
    present = scores.filter(~F.isnan("p"))  # before the clamp, which would take NaN for 1
    clamped = count_table(present.withColumn("p", clamp(F.col("p"), 0.0, 1.0)), by)
    edges = quantile_edges(clamped, bins, by)
    counts = attach_small(score_counts(clamped, by), edges, by, salt_by=["p"])
    binned = counts.withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("p"))))
    return binned.groupBy(*by, "bin").agg(
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_p"),
        (F.sum("pos") / F.sum("n")).alias("positive_rate"),
        F.sum("n").alias("n"),
    )


def quantile_edges(scores: DataFrame, bins: int, by: Sequence[str]) -> DataFrame:
    """``edges``: the inner quantiles ``1/bins .. (bins-1)/bins`` of each group."""
    total = F.col("tot_pos") + F.col("tot_neg")
    # A row of the curve occupies the ascending ranks first .. first + n - 1.
    first = total - F.col("tp") - F.col("fp")

    # The position k * (total - 1) / bins in whole numbers: exact rank and remainder.
    def rest(k):
        return F.pmod(k * (total - 1), F.lit(bins))

    def low(k):
        return (k * (total - 1) - rest(k)) / bins

    def holds(rank):
        return (rank >= first) & (rank < first + F.col("n"))

    def wanted(k):
        return F.struct(
            k.alias("k"),
            holds(low(k)).alias("is_low"),
            holds(low(k) + F.signum(rest(k))).alias("is_high"),
            (rest(k) / F.lit(bins)).alias("part"),
        )

    # The k whose ranks end at or after the row's first and begin at or before its last: most
    # rows have none, so the functions over all k run for a few rows only.
    def whole(x):
        return (x - F.pmod(x, span)) / span

    span = F.greatest(total - 1, F.lit(1))
    least = F.greatest(whole((first - 1) * bins) + 1, F.lit(1))
    most = F.least(whole((first + F.col("n")) * bins - 1), F.lit(bins - 1))

    ks = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), wanted)
    found = (
        cumulative_curve(scores, by)
        .filter(least <= most)
        .withColumn("q", F.explode(F.filter(ks, lambda q: q["is_low"] | q["is_high"])))
        .groupBy(*by, "q.k", "q.part")
        .agg(
            F.max(F.when(F.col("q.is_low"), F.col("p"))).alias("lo"),
            F.max(F.when(F.col("q.is_high"), F.col("p"))).alias("hi"),
        )
    )
    edge = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    return found.groupBy(*by).agg(F.collect_list(edge).alias("edges"))


def fold_summary(
    fold_metrics: DataFrame,
    metrics: Sequence[str] = ("auc", "auprc"),
    by: Sequence[str] = ("model",),
    ddof: int = 1,
) -> DataFrame:
    """Mean and standard deviation over folds; ``ddof=0`` is the population form."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), sd(m).alias(f"{m}_sd")]
    return fold_metrics.groupBy(*by).agg(*aggs).orderBy(*by)


def fold_threshold_summary(fold_metrics: DataFrame, ddof: int = 1) -> DataFrame:
    return fold_summary(fold_metrics, SUMMARY_METRICS, ("model", "threshold_name"), ddof)


def modal_best_params(best: DataFrame) -> DataFrame:
    """The parameter set chosen in most folds; among equals the one seen first.

    Input: ``(fold_id, params)``. No rows in, no rows out: the caller keeps its defaults.
    """
    return (
        best.groupBy("params")
        .agg(F.count(F.lit(1)).alias("n_folds"), F.min("fold_id").alias("first_fold"))
        .orderBy(F.desc("n_folds"), "first_fold", "params")
        .limit(1)
    )
