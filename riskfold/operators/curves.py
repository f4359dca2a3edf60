"""Cumulative score curves and the ranking metrics derived from them.

Input everywhere is the long stream ``(model, p, y_true)``, optionally with more
grouping columns such as ``fold_id``. Rows are first collapsed to one per distinct
score, which bounds every later step by the number of distinct scores and defuses
scores shared by many rows. The running sums are then taken inside score buckets, and
each bucket starts from the total of the buckets above it, so a curve with one model
still spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfold.functions.scalars import ratio
from riskfold.functions.scaling import score_edges, with_bucket, written

INF = float("inf")


def is_counted(scores: DataFrame) -> bool:
    """Whether a stream has been collapsed to counts ``pos`` and ``n`` already."""
    return {"pos", "n"} <= set(scores.columns) and "y_true" not in scores.columns


def score_counts(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Positives and rows at each distinct score; a null or NaN score is on no curve.

    Counts by finer groups are rolled up, so one table of them serves every metric.
    """
    if is_counted(scores):
        pos, n = F.sum("pos"), F.sum("n")
    else:
        pos, n = F.sum(F.col("y_true").cast("bigint")), F.count(F.lit(1))
    kept = scores.filter(F.col("p").isNotNull() & ~F.isnan("p"))
    return kept.groupBy(*by, "p").agg(pos.alias("pos"), n.alias("n"))


def count_table(scores: DataFrame, by: Sequence[str] = ("model", "fold_id")) -> DataFrame:
    """The stream as a written table of counts, for callers that read it several times.

    Two passes over a stream cost less than writing its counts where scores hardly repeat.
    """
    if is_counted(scores):
        return scores
    return written(score_counts(scores, [c for c in by if c in scores.columns]), "score-counts")


def cumulative_curve(
    scores: DataFrame,
    by: Sequence[str] = ("model",),
    buckets: int | None = None,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """One row per distinct score with counts at or above it.

    Columns: ``by``, ``p``, ``pos``, ``n`` (at this score), ``tp``, ``fp`` (at or above),
    ``tot_pos``, ``tot_neg`` and ``next_pos``, ``next_n`` (at the next lower score).
    ``edges`` skips the sketch pass when the caller already knows balanced ones; no edges
    mean one bucket.
    """
    by = list(by)
    if edges is None:
        edges = score_edges(scores, buckets=buckets)
    counts = score_counts(scores, by)
    if edges:
        return _bucketed_curve(with_bucket(counts, edges), by)
    order = Window.partitionBy(*by).orderBy(F.desc("p"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    return counts.select(
        *by,
        "p",
        "pos",
        "n",
        F.sum("pos").over(running).alias("tp"),
        F.sum(F.col("n") - F.col("pos")).over(running).alias("fp"),
        F.sum("pos").over(whole).alias("tot_pos"),
        F.sum(F.col("n") - F.col("pos")).over(whole).alias("tot_neg"),
        F.lead("pos").over(order).alias("next_pos"),
        F.lead("n").over(order).alias("next_n"),
    )


def _bucketed_curve(counts: DataFrame, by: list[str]) -> DataFrame:
    """The curve from running sums inside buckets and the totals of the buckets above."""
    totals = counts.groupBy(*by, "bucket").agg(
        F.sum("pos").alias("b_pos"),
        F.sum("n").alias("b_n"),
        F.max_by(F.struct("pos", "n"), "p").alias("head"),
    )
    # At most one row per bucket and group: a small frame whatever the input size.
    nearby = Window.partitionBy(*by).orderBy(F.desc("bucket"))
    above = nearby.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *by,
        "bucket",
        F.coalesce(F.sum("b_pos").over(above), F.lit(0)).alias("above_pos"),
        F.coalesce(F.sum("b_n").over(above), F.lit(0)).alias("above_n"),
        F.sum("b_pos").over(whole).alias("tot_pos"),
        F.sum("b_n").over(whole).alias("tot_n"),
        F.lead("head").over(nearby).alias("below"),
    )
    inside = Window.partitionBy(*by, "bucket").orderBy(F.desc("p"))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = counts.select(
        *by,
        "bucket",
        "p",
        "pos",
        "n",
        F.sum("pos").over(running).alias("in_pos"),
        F.sum("n").over(running).alias("in_n"),
        F.lead(F.struct("pos", "n")).over(inside).alias("next_in"),
    )
    after = F.coalesce(F.col("next_in"), F.col("below"))
    tp = F.col("in_pos") + F.col("above_pos")
    return local.join(offsets, [*by, "bucket"]).select(
        *by,
        "p",
        "pos",
        "n",
        tp.alias("tp"),
        (F.col("in_n") + F.col("above_n") - tp).alias("fp"),
        "tot_pos",
        (F.col("tot_n") - F.col("tot_pos")).alias("tot_neg"),
        after["pos"].alias("next_pos"),
        after["n"].alias("next_n"),
    )


def recall_at() -> Column:
    return ratio(F.col("tp"), F.col("tot_pos"))


def fpr_at() -> Column:
    return ratio(F.col("fp"), F.col("tot_neg"))


def precision_at() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def f1_at() -> Column:
    p, r = precision_at(), recall_at()
    return 2 * p * r / F.greatest(p + r, F.lit(1e-12))


def youden_at() -> Column:
    return recall_at() - fpr_at()


def auc_sum() -> Column:
    """Aggregate giving the ROC area; ties count half, null when a class is missing."""
    neg = (F.col("n") - F.col("pos")).cast("double")
    area = F.sum(neg * (2 * F.col("tp") - F.col("pos")))
    pairs = 2 * F.max("tot_pos").cast("double") * F.max("tot_neg")
    return F.when(pairs != 0, area / pairs)


def ap_sum() -> Column:
    """Aggregate giving average precision as a step sum, without interpolation."""
    return F.sum(ratio(F.col("pos"), F.col("tot_pos")) * precision_at())


def roc_points(
    scores: DataFrame,
    by: Sequence[str] = ("model",),
    drop_collinear: bool = False,
    curve: DataFrame | None = None,
) -> DataFrame:
    """``threshold, fpr, tpr`` with the leading ``(+inf, 0, 0)`` point of each curve.

    ``drop_collinear`` removes inner points whose step repeats the next one.
    """
    curve = cumulative_curve(scores, by) if curve is None else curve
    points = curve
    if drop_collinear:
        first, last = F.col("tp") + F.col("fp") == F.col("n"), F.col("next_n").isNull()
        turns = (F.col("pos") != F.col("next_pos")) | (F.col("n") != F.col("next_n"))
        points = curve.filter(first | last | turns)
    point = F.struct(F.col("p").alias("threshold"), fpr_at().alias("fpr"), recall_at().alias("tpr"))
    origin = F.struct(
        F.lit(INF).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return _with_extra_point(points, by, point, origin)


def _with_extra_point(
    curve: DataFrame, by: Sequence[str], point: Column, extra: Column
) -> DataFrame:
    """Every point, and one more per curve next to its highest score: no second pass."""
    highest = F.col("tp") + F.col("fp") == F.col("n")
    cells = F.when(highest, F.array(extra, point)).otherwise(F.array(point))
    return curve.select(*by, F.inline(cells))


def pr_points(
    scores: DataFrame, by: Sequence[str] = ("model",), curve: DataFrame | None = None
) -> DataFrame:
    """``threshold, precision, recall`` with the trailing ``(null, 1, 0)`` point."""
    curve = cumulative_curve(scores, by) if curve is None else curve
    point = F.struct(
        F.col("p").alias("threshold"),
        precision_at().alias("precision"),
        recall_at().alias("recall"),
    )
    end = F.struct(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return _with_extra_point(curve, by, point, end)


def roc_auc(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return cumulative_curve(scores, by).groupBy(*by).agg(auc_sum().alias("auc"))


def average_precision(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return cumulative_curve(scores, by).groupBy(*by).agg(ap_sum().alias("auprc"))


def oof_ranking(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """AUC and average precision per model, sorted by name."""
    return (
        cumulative_curve(scores, by)
        .groupBy(*by)
        .agg(auc_sum().alias("oof_auc"), ap_sum().alias("oof_auprc"))
        .orderBy(*by)
    )


def fold_ranking(scores: DataFrame) -> DataFrame:
    """AUC, average precision and sizes per model and fold; fold -1 is skipped."""
    by = ["model", "fold_id"]
    return (
        cumulative_curve(scores.filter(F.col("fold_id") != -1), by)
        .groupBy(*by)
        .agg(
            auc_sum().alias("auc"),
            ap_sum().alias("auprc"),
            F.sum("n").alias("n"),
            F.sum("pos").alias("n_pos"),
        )
        .orderBy(*by)
    )


def long_streams(wide: DataFrame, ids: Sequence[str], streams: dict[str, str]) -> DataFrame:
    """Long ``(ids, model, p)`` from one probability column per model.

    Exploding structs, unlike ``unpivot``, lets both uses of a curve share one shuffle.
    """
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.col(f"`{c}`").cast("double").alias("p"))
            for m, c in streams.items()
        ]
    )
    return wide.select(*ids, F.inline(cells))
