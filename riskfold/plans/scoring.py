"""Run reports and batch scoring of new subjects with saved models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.functions.scalars import (
    at_least,
    clip_probability,
    coerce_numeric,
    col,
    format_subject_id,
)
from riskfold.operators import curves, thresholds
from riskfold.operators.cohort import ID, LABEL, join_intersection, select_unlabelled
from riskfold.plans.multi_source import FinalModels
from riskfold.sources.tables import canonical_thresholds

# Which score column each threshold row applies to.
MODEL_SCORES = {
    "multi_early": "risk_multi_early_raw",
    "multi_early_cal": "risk_multi_early",
    "multi_late": "risk_multi_late_raw",
    "multi_late_cal": "risk_multi_late",
}
UNNAMED = "thr"


def run_report(
    scores: DataFrame,
    fixed: float = thresholds.FIXED_THRESHOLD,
    targets: Sequence[float] | None = thresholds.TARGET_RECALLS,
) -> DataFrame:
    """Nested summary of a run: ranking, sizes and a map of thresholds per model."""
    bundle = thresholds.threshold_bundle(
        curves.cumulative_curve(scores), fixed=fixed, targets=targets
    )
    # A handful of threshold rows per model.
    return bundle.groupBy("model").agg(
        F.max("oof_auc").alias("oof_auc"),
        F.max("oof_auprc").alias("oof_auprc"),
        F.max(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"),
        F.max(F.col("tp") + F.col("fn")).alias("n_pos"),
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    "threshold_name",
                    # JSON has no infinity: a threshold nothing reaches is null.
                    F.when(F.col("threshold") != curves.INF, F.col("threshold")),
                )
            )
        ).alias("thresholds"),
    )


def flag_rules(threshold_rows: DataFrame) -> list[tuple[str, str, float]]:
    """``(flag column, score column, threshold)`` of the usable rows, in a fixed order.

    Only exact model names count, so a padded name is lost. Rows without a number are
    skipped. Of rows with one flag name the last wins.
    """
    rows = canonical_thresholds(threshold_rows)
    if rows is None:
        return []
    usable = (
        rows.filter(F.col("model").isin(*MODEL_SCORES))
        .withColumn("threshold", coerce_numeric(F.col("threshold")))
        .filter(F.col("threshold").isNotNull() & ~F.isnan("threshold"))
        .orderBy("model", "threshold_name", "threshold")
    )
    rules = {}
    # One row per flag column: their number is the width of the output table.
    for r in usable.collect():
        name = r.threshold_name.strip() if r.threshold_name is not None else UNNAMED
        flag = f"binary_{r.model}_{name}_thr_{r.threshold:.2f}"
        rules[flag] = (flag, MODEL_SCORES[r.model], r.threshold)
    return list(rules.values())


def binary_flags(out: DataFrame, threshold_rows: DataFrame) -> DataFrame:
    """Add one Yes/No column per usable threshold; a missing score is No."""
    flags = [
        F.when(at_least(coerce_numeric(F.col(score)), F.lit(t)), "Yes").otherwise("No").alias(flag)
        for flag, score, t in flag_rules(threshold_rows)
        if score in out.columns
    ]
    return out.select("*", *flags)


def with_display_id(out: DataFrame, id_col: str, name: str = "display_id") -> DataFrame:
    return out.withColumn(name, format_subject_id(F.col(id_col)))


def scoring_cohort(
    pheno: DataFrame,
    features: Mapping[str, DataFrame],
    unlabelled_only: bool = False,
    dedup: bool = False,
) -> DataFrame:
    """Subjects present in every source, labelled or not; copies multiply unless ``dedup``."""
    if unlabelled_only:
        pheno = select_unlabelled(pheno)
    return join_intersection({"pheno": pheno, **features}, None, dedup=dedup)


def score_early(models: FinalModels, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Early-fusion risk; inputs are matched by name."""
    return models.early.predict(df, keep, "risk_multi_early_raw")


def score_late(models: FinalModels, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Late-fusion risk: base probabilities into the meta-model, base columns dropped."""
    names = list(models.bases)
    out = df
    for n in names:
        carried = [*df.columns, *[f"p_{m}" for m in names if f"p_{m}" in out.columns]]
        out = models.bases[n].predict(out, carried, f"p_{n}")
    return out.select(*[col(k) for k in keep], models.meta.probability().alias("risk_multi_late_raw"))


def score_calibrated(models: FinalModels, out: DataFrame, clip: float = 0.0) -> DataFrame:
    """Add calibrated risks, equal to the raw ones where no calibrators were saved.

    ``calibration_source`` tells which: thresholds named ``*_cal`` were chosen on the
    fold-calibrated streams, not on these.
    """
    have = all(k in models.calibrators for k in ("early", "late"))
    for k in ("early", "late"):
        raw, name = F.col(f"risk_multi_{k}_raw"), f"risk_multi_{k}"
        if have:
            out = models.calibrators[k].calibrate(out.withColumn(name, clip_probability(raw, clip)), name, name)
        else:
            out = out.withColumn(name, raw)
    return out.withColumn("calibration_source", F.lit("oof_map" if have else "none"))


def score_table(
    models: FinalModels,
    df: DataFrame,
    threshold_rows: DataFrame | None = None,
    clip: float = 0.0,
    calibrate: bool = True,
) -> DataFrame:
    """Id, label where there is one, raw and calibrated risks, flags, display id.

    One narrow plan over the cohort: no shuffle after the cohort joins.
    """
    keep = [ID] + ([LABEL] if LABEL in df.columns else [])
    early = score_early(models, df, [*df.columns])
    out = score_late(models, early, [*keep, "risk_multi_early_raw"])
    chosen = models if calibrate else replace(models, calibrators={})
    out = score_calibrated(chosen, out, clip)
    if threshold_rows is not None:
        out = binary_flags(out, threshold_rows)
    return with_display_id(out, ID)
