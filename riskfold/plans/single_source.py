"""Nested evaluation of one source on its own labelled cohort."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.functions.scaling import fits_one_task, written
from riskfold.operators.calibration import Calibrator, fit_calibrator
from riskfold.operators.cohort import (
    ID,
    LABEL,
    dedup_keep_first,
    guard_complete,
    guard_labels,
    join_label,
)
from riskfold.operators.folds import CALIBRATION_SEED, stratified_folds
from riskfold.operators.models import (
    SINGLE_SPACE,
    FittedForest,
    ForestParams,
    SearchConfig,
    fit_forest,
    fit_tuned,
    in_parallel,
    union_all,
)
from riskfold.operators.summaries import modal_best_params
from riskfold.plans.calibrated import CalibratedForest, calibrated_forest

OUT = [ID, "fold_id", LABEL]
RAW, CALIBRATED = "uncalibrated", "calibrated"


@dataclass
class SingleRun:
    """Out-of-fold stream (models ``uncalibrated`` and ``calibrated``) and chosen parameters."""

    cohort: DataFrame
    columns: list[str]
    oof: DataFrame
    best: DataFrame


def build_cohort(features: DataFrame, labels: DataFrame, cfg: SearchConfig) -> DataFrame:
    """One row per labelled subject with its outer fold."""
    rows = join_label(dedup_keep_first(features, [ID]), dedup_keep_first(labels, [ID]))
    rows = written(rows, "cohort-rows")  # read for the folds and again with them
    few = fits_one_task(rows.count())
    folds = stratified_folds(rows.select(ID, LABEL), cfg.outer_folds, cfg.seed, few=few)
    return guard_labels(written(rows.join(folds.select(ID, "fold_id"), ID), "cohort"), "cohort")


def evaluate(
    features: DataFrame,
    labels: DataFrame,
    cfg: SearchConfig | None = None,
    method: str | None = "sigmoid",
    calibration_folds: int = 5,
) -> SingleRun:
    """Nested evaluation; the search space is that of single sources unless ``cfg`` names another."""
    cfg = cfg or SearchConfig(space=SINGLE_SPACE)
    columns = [c for c in features.columns if c != ID]
    rows = build_cohort(features, labels, cfg)
    spark = rows.sparkSession

    def task(fold: int):
        train, test = rows.filter(F.col("fold_id") != fold), rows.filter(F.col("fold_id") == fold)
        model = fit_tuned(train, columns, cfg, fold)
        out = [model.predict(test, OUT).withColumn("model", F.lit(RAW))]
        if method:
            seed = cfg.seed + CALIBRATION_SEED["single"] + fold
            cal = calibrated_forest(model, train, method, calibration_folds, seed, cfg)
            out.append(cal.predict(test, OUT).withColumn("model", F.lit(CALIBRATED)))
        return written(union_all(out), f"oof-{fold}"), (fold, model.params.to_json())

    jobs = [(lambda f=f: task(f)) for f in range(1, cfg.outer_folds + 1)]
    done = in_parallel(spark, jobs, cfg.parallelism)
    oof = guard_complete(union_all([d for d, _ in done]), ["p"], "out-of-fold stream")
    best = spark.createDataFrame([b for _, b in done], "fold_id int, params string")
    return SingleRun(rows, columns, oof, best)


def fit_deployable(
    run: SingleRun, cfg: SearchConfig, method: str | None = "sigmoid", calibration_folds: int = 5
) -> tuple[FittedForest, CalibratedForest | None]:
    """Refit on the whole cohort with the parameters most folds chose, and its calibration."""
    chosen = modal_best_params(run.best).collect()
    params = ForestParams(**json.loads(chosen[0].params)) if chosen else ForestParams()
    model = fit_forest(run.cohort, run.columns, params, cfg.seed)
    if not method:
        return model, None
    seed = cfg.seed + CALIBRATION_SEED["deploy"]
    return model, calibrated_forest(model, run.cohort, method, calibration_folds, seed, cfg)


def oof_calibrators(run: SingleRun, method: str = "sigmoid") -> dict[str, Calibrator]:
    """Maps fitted on each out-of-fold stream; the sigmoid reads log-odds, fitted and applied."""
    out = {}
    for stream in (RAW, CALIBRATED):
        rows = run.oof.filter(F.col("model") == stream)
        cal = fit_calibrator(rows, method, logit=True)
        if cal is not None:
            out[stream] = cal
    return out
