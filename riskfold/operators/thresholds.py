"""Decision thresholds: sweeps, selection rules, confusion counts, metrics.

Every selected threshold is a point of the score curve, and the curve row already knows
how many positives and negatives lie at or above it. Selection and the metrics at the
selected thresholds are therefore one aggregate over the curve, without a second pass
over the scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.functions.scalars import at_least, ratio, safe_ratio
from riskfold.functions.scaling import attach_small
from riskfold.operators.curves import (
    INF,
    ap_sum,
    auc_sum,
    cumulative_curve,
    f1_at,
    precision_at,
    recall_at,
    score_counts,
    youden_at,
)

# Defaults and names that reports and threshold files rely on.
FIXED_THRESHOLD = 0.50
TARGET_RECALLS = (0.90, 0.85, 0.80)
FALLBACK_RECALLS = (0.90,)
NAME_FIXED = "fixed"
NAME_F1 = "f1_opt"
NAME_YOUDEN = "youden_j_opt"
NAME_RECALL = "recall_%.2f"

SUMMARY_METRICS = (
    "precision",
    "recall",
    "f1",
    "specificity",
    "youden_j",
    "npv",
    "pred_pos_rate",
)


def recall_targets(targets: Sequence[float] | None) -> list[float]:
    """Distinct targets, highest first; none given means 0.90."""
    return sorted({float(t) for t in (targets or FALLBACK_RECALLS)}, reverse=True)


# ---------------------------------------------------------------- sweeps


def sweep_f1(curve: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """F1 at every distinct score."""
    return curve.select(
        *by,
        F.col("p").alias("threshold"),
        precision_at().alias("precision"),
        recall_at().alias("recall"),
        f1_at().alias("f1"),
    )


def sweep_youden(roc: DataFrame) -> DataFrame:
    """J at every ROC threshold, the infinite one included."""
    return roc.withColumn("youden_j", F.col("tpr") - F.col("fpr"))


def sweep_recall(
    curve: DataFrame, targets: Sequence[float], by: Sequence[str] = ("model",)
) -> DataFrame:
    """The F1 sweep once per target recall, flagged where the target is met."""
    wanted = F.array(*[F.lit(t) for t in recall_targets(targets)])
    return (
        sweep_f1(curve, by)
        .withColumn("target_recall", F.explode(wanted))
        .withColumn("meets_recall", F.col("recall") >= F.col("target_recall"))
    )


# ---------------------------------------------------------------- selection


def _point() -> Column:
    return F.struct(F.col("p").alias("threshold"), "tp", "fp")


def _best_f1() -> Column:
    """Highest F1; among equals the lowest threshold."""
    return F.max_by(_point(), F.struct(f1_at(), -F.col("p")))


def _best_youden() -> Column:
    """Highest J; among equals the highest threshold, which is +inf unless some J > 0."""
    best = F.max(F.struct(youden_at().alias("j"), F.col("p").alias("threshold"), "tp", "fp"))
    nothing = F.struct(
        F.lit(INF).alias("threshold"),
        F.lit(0).cast("bigint").alias("tp"),
        F.lit(0).cast("bigint").alias("fp"),
    )
    chosen = F.struct(best["threshold"].alias("threshold"), best["tp"].alias("tp"), best["fp"].alias("fp"))
    return F.when(best["j"] > 0, chosen).otherwise(nothing)


def _best_recall(target: float) -> Column:
    """Highest threshold reaching the target; else most recall, precision, lowest threshold."""
    meets = F.coalesce(recall_at() >= target, F.lit(False))
    order = F.struct(
        meets,
        F.when(meets, F.col("p")).otherwise(recall_at()),
        F.when(meets, F.lit(0.0)).otherwise(precision_at()),
        F.when(meets, F.lit(0.0)).otherwise(-F.col("p")),
    )
    return F.max_by(_point(), order)


def _at_fixed(threshold: float) -> Column:
    """Counts at or above a given threshold, read off the curve."""
    above = at_least(F.col("p"), F.lit(float(threshold)))
    return F.struct(
        F.lit(float(threshold)).alias("threshold"),
        F.coalesce(F.max(F.when(above, F.col("tp"))), F.lit(0).cast("bigint")).alias("tp"),
        F.coalesce(F.max(F.when(above, F.col("fp"))), F.lit(0).cast("bigint")).alias("fp"),
    )


def pick_f1(curve: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return _picked(curve, by, _best_f1())


def pick_youden(curve: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return _picked(curve, by, _best_youden())


def pick_recall(
    curve: DataFrame, target: float, by: Sequence[str] = ("model",)
) -> DataFrame:
    return _picked(curve, by, _best_recall(target))


def _picked(curve: DataFrame, by: Sequence[str], best: Column) -> DataFrame:
    return curve.groupBy(*by).agg(best.alias("best")).select(*by, "best.threshold")


def threshold_bundle(
    curve: DataFrame,
    by: Sequence[str] = ("model",),
    fixed: float = FIXED_THRESHOLD,
    targets: Sequence[float] | None = TARGET_RECALLS,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Every named threshold of every model with its confusion counts and the OOF ranking.

    ``names`` restricts the set, so that one rule costs one aggregate.
    """
    rules = {NAME_FIXED: _at_fixed(fixed), NAME_F1: _best_f1(), NAME_YOUDEN: _best_youden()}
    rules |= {NAME_RECALL % t: _best_recall(t) for t in recall_targets(targets)}
    if names is not None:
        rules = {n: rules[n] for n in names}
    cols = {name: f"_t{i}" for i, name in enumerate(rules)}
    per_model = curve.groupBy(*by).agg(
        F.max("tot_pos").alias("tot_pos"),
        F.max("tot_neg").alias("tot_neg"),
        auc_sum().alias("oof_auc"),
        ap_sum().alias("oof_auprc"),
        *[rules[n].alias(c) for n, c in cols.items()],
    )
    named = F.array(
        *[F.struct(F.lit(n).alias("threshold_name"), F.col(c).alias("at")) for n, c in cols.items()]
    )
    return per_model.select(
        *by, "tot_pos", "tot_neg", "oof_auc", "oof_auprc", F.explode(named).alias("t")
    ).select(
        *by,
        "t.threshold_name",
        "t.at.threshold",
        "oof_auc",
        "oof_auprc",
        F.col("t.at.tp").alias("tp"),
        F.col("t.at.fp").alias("fp"),
        (F.col("tot_neg") - F.col("t.at.fp")).alias("tn"),
        (F.col("tot_pos") - F.col("t.at.tp")).alias("fn"),
    )


def threshold_set(curve: DataFrame, by: Sequence[str] = ("model",), **kw) -> DataFrame:
    """``by, threshold_name, threshold``."""
    return threshold_bundle(curve, by, **kw).select(*by, "threshold_name", "threshold")


# ---------------------------------------------------------------- metrics


def with_metrics(counts: DataFrame) -> DataFrame:
    """Add every thresholded metric to ``tp, fp, tn, fn``; zero denominators give zero."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    specificity, fpr = safe_ratio(tn, tn + fp), safe_ratio(fp, fp + tn)
    # Mean recall over the classes that are present.
    balanced = (
        F.when(tp + fn == 0, specificity)
        .when(tn + fp == 0, recall)
        .otherwise((recall + specificity) / 2)
    )
    return counts.select(
        "*",
        precision.alias("precision"),
        recall.alias("recall"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        balanced.alias("balanced_accuracy"),
        specificity.alias("specificity"),
        fpr.alias("fpr"),
        recall.alias("tpr"),
        (recall - fpr).alias("youden_j"),
        safe_ratio(tn, tn + fn).alias("npv"),
        ratio(tp + fp, tp + fp + tn + fn).alias("pred_pos_rate"),
    )


def join_thresholds(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Each row of a stream with each threshold of its own model, and no other model's."""
    return attach_small(scores, thresholds, ["model"], salt_by=["p"])


def metrics_at_threshold(
    scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("model",)
) -> DataFrame:
    """Metrics of given thresholds ``(model, threshold_name, threshold)``.

    Equal scores are collapsed before the join, so that it multiplies distinct scores
    rather than rows.
    """
    yes = at_least(F.col("p"), F.col("threshold"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")

    def total(condition, amount):
        return F.sum(F.when(condition, amount).otherwise(F.lit(0)))

    counts = (
        join_thresholds(score_counts(scores, by), thresholds)
        .groupBy(*by, "threshold_name", "threshold")
        .agg(
            total(yes, pos).alias("tp"),
            total(yes, neg).alias("fp"),
            total(~yes, neg).alias("tn"),
            total(~yes, pos).alias("fn"),
        )
    )
    return with_metrics(counts)


def oof_threshold_metrics(scores: DataFrame, **kw) -> DataFrame:
    """Metrics and ranking of every model at every one of its thresholds, sorted."""
    return with_metrics(threshold_bundle(cumulative_curve(scores), **kw)).orderBy(
        "model", "threshold_name"
    )


def fold_threshold_metrics(
    scores: DataFrame, thresholds: DataFrame | None = None, **kw
) -> DataFrame:
    """Metrics per fold at thresholds chosen over all folds; fold -1 is skipped."""
    if thresholds is None:
        thresholds = threshold_set(cumulative_curve(scores), **kw)
    in_folds = scores.filter(F.col("fold_id") != -1)
    return metrics_at_threshold(in_folds, thresholds, ["model", "fold_id"]).orderBy(
        "model", "threshold_name", "fold_id"
    )


def thresholded_predictions(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Long form: 0/1 per row and threshold of its model."""
    return join_thresholds(scores, thresholds).withColumn(
        "y_pred", at_least(F.col("p"), F.col("threshold")).cast("int")
    )


def thresholded_columns(wide: DataFrame, streams: dict[str, str], thresholds: DataFrame) -> DataFrame:
    """Wide form: one ``y_pred__<model>__<threshold name>`` column per threshold.

    ``streams`` maps model to probability column. The threshold names come to the driver
    because they become column names.
    """
    rows = thresholds.filter(F.col("model").isin(*streams)).orderBy("model", "threshold_name").collect()
    flags = {
        f"y_pred__{r.model}__{r.threshold_name}": at_least(
            F.col(f"`{streams[r.model]}`"), F.lit(r.threshold)
        ).cast("int")
        for r in rows
    }
    return wide.select("*", *[c.alias(n) for n, c in flags.items()])


def performance_matrix(scores: DataFrame, rule: str = NAME_YOUDEN, **kw) -> DataFrame:
    """One row per model: ranking and metrics at its Youden threshold, sorted by model."""
    bundle = threshold_bundle(cumulative_curve(scores), names=[rule], **kw)
    return (
        with_metrics(bundle)
        .select(
            "model",
            "threshold",
            F.col("oof_auc").alias("auc"),
            F.col("oof_auprc").alias("auprc"),
            "precision",
            "recall",
            "f1",
            "balanced_accuracy",
            "pred_pos_rate",
            "tp",
            "fp",
            "fn",
            "tn",
        )
        .orderBy("model")
    )
