"""Tables behind the figures, and the run report."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.operators import models, summaries
from riskfold.plans import evaluation, reporting, scoring
from riskfold.sources import tables

MODELS = evaluation.REQUIRED


@pytest.fixture(scope="module")
def wide(spark):
    rows = [
        (str(i), i % 2, *[((i * (7 + j)) % 20) / 20 + 0.02 * (i % 2) for j in range(len(MODELS))]) for i in range(60)
    ]
    names = ", ".join(f"proba_{m} double" for m in MODELS)
    return spark.createDataFrame(rows, f"subject_id string, y_true int, {names}")


def test_required_streams(spark, wide):
    assert evaluation.unified_stream(wide).select("model").distinct().count() == 6
    with pytest.raises(ValueError, match="proba_single_lab"):
        evaluation.unified_stream(wide.drop("proba_single_lab"))


def test_calibrated_tables_only_with_calibrated_streams(wide):
    out = evaluation.evaluation_tables(evaluation.unified_stream(wide), bins=4)
    assert out.brier_cal is None and out.reliability_cal is None
    assert {r.model for r in out.brier.collect()} == {"multi_late", "multi_early"}
    assert out.ranking.count() == 6
    auc = [r.auc for r in out.ranking.collect()]
    assert auc == sorted(auc, reverse=True)
    both = wide.selectExpr("*", "proba_multi_late as proba_multi_late_cal", "proba_multi_early as proba_multi_early_cal")
    cal = evaluation.evaluation_tables(evaluation.unified_stream(both), bins=4)
    assert {r.model for r in cal.brier_cal.collect()} == {"multi_late_cal", "multi_early_cal"}
    assert cal.reliability_cal.count() == out.reliability.count()


def test_tables_read_the_stream_once(spark):
    """However many tables are made of it: a score is computed for a filter and for the counts."""
    count = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        count.add(1)
        return v

    names = [*evaluation.REQUIRED, *evaluation.CALIBRATED]
    rows = [(m, i % 2, (i * 7 % 20) / 20) for m in names for i in range(30)]
    stream = spark.createDataFrame(rows, "model string, y_true int, p double").select("model", "y_true", seen("p").alias("p"))
    out = evaluation.evaluation_tables(stream, bins=4)
    for df in (out.roc, out.pr, out.ranking, out.reliability, out.reliability_cal):
        assert df.count()
    assert count.value <= 2 * len(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11, 57])
def test_quantile_edges_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    streams = {"tied": rng.integers(0, 4, n) / 4, "mixed": rng.uniform(size=n), "flat": np.full(n, 0.5)}
    rows = [(m, i % 2, float(p)) for m, ps in streams.items() for i, p in enumerate(ps)]
    scores = spark.createDataFrame(rows, "model string, y_true int, p double")
    for r in summaries.quantile_edges(scores, 10, ["model"]).collect():
        assert sorted(r.edges) == pytest.approx(list(np.quantile(streams[r.model], np.arange(1, 10) / 10)))


def test_single_files_are_used_only_together(spark, wide, tmp_path):
    paths = {}
    for n in ("lab", "serology"):
        df = wide.selectExpr("y_true", f"proba_single_{n} as y_oof_prob")
        paths[n] = tables.write_table(df, str(tmp_path / f"{n}.csv"))
    assert evaluation.load_single_oof(spark, paths).count() == 120
    assert evaluation.load_single_oof(spark, {**paths, "genetics": str(tmp_path / "no.csv")}) is None
    assert evaluation.load_single_oof(spark, {**paths, "genetics": None}) is None
    bad = tables.write_table(wide.select("y_true"), str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError, match="y_oof_prob"):
        evaluation.load_single_oof(spark, {"x": bad})


def test_importance_tables(spark):
    early = spark.createDataFrame([("num__ANCA EU", "0.5"), ("cat__x", "bad"), ("b", "0.7")], "feature string, mean_abs string")
    assert [(r.feature, r.mean_abs) for r in evaluation.early_importance(early, 2).collect()] == [("b", 0.7), ("ANCA", 0.5)]
    late = spark.createDataFrame([("p_lab", 0.1), ("p_serology", 0.4)], "feature string, mean_abs double")
    assert [r.feature for r in evaluation.late_importance(late).collect()] == ["Serology", "Lab"]


def test_report_is_nested_json(spark, wide, tmp_path):
    report = scoring.run_report(evaluation.unified_stream(wide), targets=[0.9])
    path = tables.write_report(report, str(tmp_path / "report"))
    rows = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert len(rows) == 6
    assert set(rows[0]["thresholds"]) == {"fixed", "f1_opt", "youden_j_opt", "recall_0.90"}
    assert rows[0]["n"] == 60 and rows[0]["n_pos"] == 30


def test_run_report_of_streams_with_odd_rows(spark, tmp_path):
    """A stream without positives, rows outside every fold, scores nothing reaches."""
    rows = [("a", i % 3 + 1, i % 2, (i % 10) / 10 + 0.05 * (i % 2)) for i in range(60)]
    rows += [("a", -1, 1, 0.99), ("flat", 1, 0, 0.2), ("flat", 2, 0, 0.2), ("turned", 1, 1, 0.1), ("turned", 1, 0, 0.9)]
    oof = spark.createDataFrame(rows, "model string, fold_id int, y_true int, p double")
    best = spark.createDataFrame([("a", 2, "{}"), ("a", 1, "[]")], reporting.BEST_SCHEMA)
    cfg = models.SearchConfig(3, 2, 4, 9)
    report = reporting.run_report(oof, cfg, ["lab"], best, None, saved_models={"multi_early": "forest"})
    path = tables.write_report(report, str(tmp_path / "run"))
    (line,) = [json.loads(r.value) for r in spark.read.text(path).collect()]
    info, a = line["run_info"], line["models"]["a"]
    assert (info["outer_folds"], info["draws"], info["n_subjects"], info["sources"]) == (3, 4, 61, ["lab"])
    assert info["calibration"] == {"enabled": False, "method": None, "folds": None}
    assert line["saved_models"] == {"multi_early": "forest"}
    assert a["n"] == 61 and [f["n"] for f in a["folds"]] == [20, 20, 20]
    assert [p["fold_id"] for p in a["params"]] == [1, 2] and line["models"]["flat"]["params"] == []
    aucs = [f["auc"] for f in a["folds"]]
    assert a["fold_ranking"]["auc"]["mean"] == pytest.approx(sum(aucs) / 3)
    assert a["fold_metrics"]["fixed"]["recall"]["sd"] >= a["fold_metrics"]["fixed"]["recall"]["sd_pop"]
    assert line["models"]["turned"]["thresholds"]["youden_j_opt"]["threshold"] is None
    assert line["models"]["flat"]["n_pos"] == 0
    empty = reporting.run_report(oof.limit(0), cfg, [], targets=None).collect()
    assert len(empty) == 1 and empty[0].models == {} and empty[0].run_info.n_subjects == 0
