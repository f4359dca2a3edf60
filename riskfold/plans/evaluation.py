"""Data behind the evaluation figures: curves, reliability, Brier scores, top features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.functions.scalars import clean_feature_name, meta_feature_name
from riskfold.operators import attribution, curves, summaries
from riskfold.operators.cohort import whole_label
from riskfold.sources.tables import optional_source, require_columns

# The streams a unified out-of-fold table must hold, and the optional ones.
REQUIRED = (
    "multi_late",
    "multi_early",
    "single_serology",
    "single_lab",
    "single_clinical",
    "single_genetics",
)
CALIBRATED = ("multi_late_cal", "multi_early_cal")
SINGLE_OOF_COLUMNS = ("y_true", "y_oof_prob")


@dataclass
class EvaluationTables:
    """Tables of one evaluation; calibrated ones are ``None`` without calibrated streams."""

    roc: DataFrame
    pr: DataFrame
    ranking: DataFrame
    reliability: DataFrame
    brier: DataFrame
    reliability_cal: DataFrame | None
    brier_cal: DataFrame | None


def load_single_oof(spark: SparkSession, paths: dict[str, str | None]) -> DataFrame | None:
    """Long stream of separately evaluated sources; ``None`` unless every file is there."""
    found = {n: optional_source(spark, p) for n, p in paths.items()}
    if not found or any(df is None for df in found.values()):
        return None
    parts = [
        require_columns(df, SINGLE_OOF_COLUMNS, n).select(
            F.lit(n).alias("model"),
            whole_label(F.col("y_true")).alias("y_true"),
            F.col("y_oof_prob").cast("double").alias("p"),
        )
        for n, df in found.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unified_stream(oof: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Long stream of a wide out-of-fold table that must hold every required model."""
    require_columns(oof, ["y_true", *[f"proba_{m}" for m in required]], "out-of-fold table")
    have = [m for m in (*required, *CALIBRATED) if f"proba_{m}" in oof.columns]
    return curves.long_streams(
        oof.withColumn("y_true", whole_label(F.col("y_true"))),
        ["y_true"],
        {m: f"proba_{m}" for m in have},
    )


def evaluation_tables(
    stream: DataFrame, bins: int = summaries.DEFAULT_BINS, main: tuple[str, ...] = REQUIRED
) -> EvaluationTables:
    """Curves of the main models; reliability and Brier of the fused ones, raw and calibrated.

    Curves and reliability come from one written table of counts, so the stream is read once
    for all of them.
    """
    plain = [m.removesuffix("_cal") for m in CALIBRATED]
    fused = stream.filter(F.col("model").isin(*plain))
    cal = stream.filter(F.col("model").isin(*CALIBRATED))
    has_cal = not cal.isEmpty()
    counts = curves.count_table(stream.filter(F.col("model").isin(*main, *plain, *CALIBRATED)), ["model"])
    ranked = counts.filter(F.col("model").isin(*main))
    fused_counts = counts.filter(F.col("model").isin(*plain))
    cal_counts = counts.filter(F.col("model").isin(*CALIBRATED))
    curve = curves.cumulative_curve(ranked)
    ranking = curve.groupBy("model").agg(
        curves.auc_sum().alias("auc"), curves.ap_sum().alias("auprc")
    )
    return EvaluationTables(
        curves.roc_points(ranked, drop_collinear=True, curve=curve),
        curves.pr_points(ranked, curve=curve),
        ranking.orderBy(F.desc("auc"), "model"),
        summaries.reliability_curve(fused_counts, bins),
        summaries.brier_score(fused),
        summaries.reliability_curve(cal_counts, bins) if has_cal else None,
        summaries.brier_score(cal) if has_cal else None,
    )


def curve_table(stream: DataFrame) -> DataFrame:
    """ROC and PR points of every model in one long table."""
    curve = curves.cumulative_curve(stream)
    roc = curves.roc_points(stream, curve=curve).select(
        "model", F.lit("roc").alias("curve"), "threshold", F.col("fpr").alias("x"), F.col("tpr").alias("y")
    )
    pr = curves.pr_points(stream, curve=curve).select(
        "model", F.lit("pr").alias("curve"), "threshold", F.col("recall").alias("x"), F.col("precision").alias("y")
    )
    return roc.unionByName(pr)


def early_importance(table: DataFrame, k: int = attribution.TOP_K) -> DataFrame:
    """Top features of the early model under their report names."""
    named = table.withColumn("feature", clean_feature_name(F.col("feature")))
    return attribution.top_features(named, k)


def late_importance(table: DataFrame) -> DataFrame:
    """Every meta-model input under its source's name."""
    named = table.withColumn("feature", meta_feature_name(F.col("feature")))
    return attribution.top_features(named, None)
