"""Curves against brute force, on ties, one class and any bucketing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.operators import curves, summaries, thresholds

STREAMS = {
    "ties": ([0.1, 0.4, 0.4, 0.4, 0.8, 0.8, 0.9, 0.1], [0, 0, 1, 1, 0, 1, 1, 0]),
    "equal": ([0.5] * 6, [0, 1, 0, 1, 1, 0]),
    "reversed": ([0.9, 0.8, 0.2, 0.1], [0, 0, 1, 1]),
    "ones": ([0.2, 0.6], [1, 1]),
    "zeros": ([0.2, 0.6, 0.7], [0, 0, 0]),
}


def stream(spark, which=STREAMS):
    rows = [(m, float(p), y) for m in which for p, y in zip(*STREAMS[m])]
    return spark.createDataFrame(rows, "model string, p double, y_true int")


def brute(m):
    p, y = map(np.array, STREAMS[m])
    pairs = [(a, b) for a in p[y == 1] for b in p[y == 0]]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a, b in pairs]) if pairs else None
    ap, before = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = y[hit].sum() / y.sum() if y.sum() else np.nan
        ap += (recall - before) * y[hit].mean()
        before = recall
    return auc, (ap if y.sum() else None)


@pytest.mark.parametrize("edges", [[], [0.3], [0.1, 0.4, 0.5, 0.8, 0.85], [2.0], [-1.0, 0.0, 0.45]])
def test_ranking_equals_brute_force_with_any_edges(spark, edges):
    curve = curves.cumulative_curve(stream(spark), edges=edges)
    got = {
        r.model: r
        for r in curve.groupBy("model").agg(curves.auc_sum().alias("auc"), curves.ap_sum().alias("ap")).collect()
    }
    for m in STREAMS:
        auc, ap = brute(m)
        assert got[m].auc == pytest.approx(auc)
        assert got[m].ap == pytest.approx(ap)


def test_buckets_do_not_change_the_curve(spark):
    rng = np.random.default_rng(0)
    rows = [("m", int(f), float(np.round(p, 3)), int(y)) for f, p, y in
            zip(rng.integers(1, 4, 3000), rng.beta(0.3, 3, 3000), rng.integers(0, 2, 3000))]
    df = spark.createDataFrame(rows, "model string, fold_id int, p double, y_true int")
    by = ["model", "fold_id"]
    plain = curves.cumulative_curve(df, by, edges=[])
    many = curves.cumulative_curve(df, by, edges=[i / 50 for i in range(1, 50)])
    assert plain.exceptAll(many).count() == 0 and many.exceptAll(plain).count() == 0


def test_auc_is_invariant_under_monotone_maps(spark):
    s = stream(spark)
    moved = s.withColumn("p", F.exp(3 * F.col("p")) / 100)
    assert sorted(curves.roc_auc(s).collect()) == sorted(curves.roc_auc(moved).collect())


def test_roc_points_ends_and_collinear_points(spark):
    rows = [("m", p, y) for p, y in [(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 0)]]
    s = spark.createDataFrame(rows, "model string, p double, y_true int")
    full = curves.roc_points(s).orderBy(F.desc("threshold")).collect()
    assert [r.threshold for r in full] == [float("inf"), 0.9, 0.8, 0.7, 0.6, 0.5]
    assert (full[0].fpr, full[0].tpr) == (0, 0) and (full[-1].fpr, full[-1].tpr) == (1, 1)
    for edges in ([], [0.65, 0.75, 0.85]):
        curve = curves.cumulative_curve(s, edges=edges)
        kept = curves.roc_points(s, drop_collinear=True, curve=curve)
        assert sorted(r.threshold for r in kept.collect()) == [0.5, 0.7, 0.9, float("inf")]


def test_pr_points_end(spark):
    last = curves.pr_points(stream(spark, ["ties"])).filter("threshold is null").collect()
    assert [(r.precision, r.recall) for r in last] == [(1.0, 0.0)]


def test_fold_minus_one_is_skipped(spark):
    s = stream(spark, ["ties"]).withColumn("fold_id", F.when(F.col("p") < 0.3, -1).otherwise(1))
    assert [r.fold_id for r in curves.fold_ranking(s).collect()] == [1]


# ---------------------------------------------------------------- thresholds


def test_selection_rules(spark):
    curve = curves.cumulative_curve(stream(spark))
    f1 = {r.model: r.threshold for r in thresholds.pick_f1(curve).collect()}
    j = {r.model: r.threshold for r in thresholds.pick_youden(curve).collect()}
    assert f1["ties"] == 0.4 and f1["ones"] == 0.2
    # J ties between 0.9 and 0.4 in no case here: 0.4 wins alone.
    assert j["ties"] == 0.4
    assert j["reversed"] == float("inf") and j["equal"] == float("inf")


def test_ties_take_lowest_f1_and_highest_youden(spark):
    rows = [("m", p, y) for p, y in [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)]]
    s = spark.createDataFrame(rows, "model string, p double, y_true int")
    curve = curves.cumulative_curve(s)
    assert thresholds.pick_youden(curve).first().threshold == 0.9
    # 2/3, 1/2, 4/5, 2/3
    assert thresholds.pick_f1(curve).first().threshold == 0.7
    flat = spark.createDataFrame([("m", 0.9, 1), ("m", 0.8, 0), ("m", 0.8, 0), ("m", 0.7, 1), ("m", 0.7, 1), ("m", 0.7, 0)],
                                 "model string, p double, y_true int")
    got = thresholds.sweep_f1(curves.cumulative_curve(flat)).orderBy("threshold").collect()
    best = max(r.f1 for r in got)
    assert thresholds.pick_f1(curves.cumulative_curve(flat)).first().threshold == min(
        r.threshold for r in got if r.f1 == best
    )


def test_recall_rule_and_fallback(spark):
    curve = curves.cumulative_curve(stream(spark, ["ties"]))
    assert thresholds.pick_recall(curve, 0.5).first().threshold == 0.8
    assert thresholds.pick_recall(curve, 1.0).first().threshold == 0.4
    # unreachable: full recall at 0.4 and 0.1, more precise at 0.4
    assert thresholds.pick_recall(curve, 1.5).first().threshold == 0.4


def test_threshold_names_and_targets(spark):
    curve = curves.cumulative_curve(stream(spark, ["ties"]))
    names = {r.threshold_name for r in thresholds.threshold_set(curve, targets=[0.8, 0.9, 0.8]).collect()}
    assert names == {"fixed", "f1_opt", "youden_j_opt", "recall_0.90", "recall_0.80"}
    assert thresholds.recall_targets([]) == [0.9]


def test_curve_counts_equal_counted_rows(spark):
    s = stream(spark)
    bundle = thresholds.with_metrics(thresholds.threshold_bundle(curves.cumulative_curve(s)))
    thr = bundle.select("model", "threshold_name", "threshold")
    counted = thresholds.metrics_at_threshold(s, thr)
    cols = counted.columns
    assert bundle.select(*cols).exceptAll(counted).count() == 0
    sizes = {m: len(p) for m, (p, _) in STREAMS.items()}
    for r in counted.collect():
        assert r.tp + r.fp + r.tn + r.fn == sizes[r.model]


def test_one_class_metrics(spark):
    s = stream(spark, ["ones", "zeros"])
    thr = spark.createDataFrame([("ones", "t", 0.5), ("zeros", "t", 0.5)], "model string, threshold_name string, threshold double")
    got = {r.model: r for r in thresholds.metrics_at_threshold(s, thr).collect()}
    assert got["ones"].balanced_accuracy == 0.5 and got["ones"].fpr == 0 and got["ones"].npv == 0
    assert got["zeros"].balanced_accuracy == pytest.approx(1 / 3) and got["zeros"].recall == 0


def test_missing_scores_are_predicted_negative(spark):
    s = spark.createDataFrame([("m", None, 1), ("m", float("nan"), 1), ("m", 0.9, 1)], "model string, p double, y_true int")
    thr = spark.createDataFrame([("m", "t", 0.5)], "model string, threshold_name string, threshold double")
    assert sorted(r.y_pred for r in thresholds.thresholded_predictions(s, thr).collect()) == [0, 0, 1]


def test_wide_predictions(spark):
    wide = spark.createDataFrame([(0.2, 0.9), (0.7, None)], "pa double, pb double")
    thr = spark.createDataFrame([("a", "t", 0.5), ("b", "t", 0.5), ("c", "t", 0.5)], "model string, threshold_name string, threshold double")
    out = thresholds.thresholded_columns(wide, {"a": "pa", "b": "pb"}, thr).collect()
    assert [(r.y_pred__a__t, r.y_pred__b__t) for r in out] == [(0, 1), (1, 0)]


def test_thresholds_join_only_their_own_model(spark):
    s = stream(spark, ["ties", "equal"])
    thr = spark.createDataFrame([("ties", "a", 0.5), ("ties", "b", 0.6), ("other", "c", 0.1)], "model string, threshold_name string, threshold double")
    assert thresholds.join_thresholds(s, thr).count() == 16


# ---------------------------------------------------------------- reliability


@pytest.mark.parametrize("bins", [3, 10])
def test_reliability_equals_numpy_percentiles(spark, bins):
    rng = np.random.default_rng(1)
    p = np.round(rng.beta(0.5, 2, 997), 2)
    y = rng.integers(0, 2, 997)
    df = spark.createDataFrame([("m", float(a), int(b)) for a, b in zip(p, y)], "model string, p double, y_true int")
    k = np.arange(1, bins)
    at, order = k * (len(p) - 1), np.sort(p)
    low = order[at // bins]
    edges = low + (order[np.minimum(at // bins + (at % bins > 0), len(p) - 1)] - low) * (at % bins / bins)
    where = np.searchsorted(edges, p)
    got = {r.bin: r for r in summaries.reliability_curve(df, bins).collect()}
    assert set(got) == set(where)
    for b, r in got.items():
        assert r.n == (where == b).sum()
        assert r.mean_p == pytest.approx(p[where == b].mean())
        assert r.positive_rate == pytest.approx(y[where == b].mean())


def test_summary_sd_forms(spark):
    df = spark.createDataFrame([("m", 0.5, 0.1), ("m", 0.7, 0.2)], "model string, auc double, auprc double")
    assert summaries.fold_summary(df, ddof=1).first().auc_sd == pytest.approx(np.std([0.5, 0.7], ddof=1))
    assert summaries.fold_summary(df, ddof=0).first().auc_sd == pytest.approx(0.1)


def test_counts_serve_every_metric(spark, sf):
    """Metrics of a table of counts equal those of its rows."""
    from riskfold.operators import summaries
    from workloads.lines import scores

    rows = scores(spark, sf)
    counted = curves.count_table(rows)
    assert curves.count_table(counted) is counted and "y_true" not in counted.columns
    for metric in (
        thresholds.performance_matrix,
        thresholds.oof_threshold_metrics,
        thresholds.fold_threshold_metrics,
        curves.fold_ranking,
        summaries.reliability_curve,
    ):
        a, b = metric(rows), metric(counted)
        key = [c for c, t in a.dtypes if t != "double"]
        values = [c for c in a.columns if c not in key]
        found = {tuple(r[c] for c in key): [r[c] for c in values] for r in a.collect()}
        other = {tuple(r[c] for c in key): [r[c] for c in values] for r in b.collect()}
        assert found.keys() == other.keys()
        assert all(found[k] == pytest.approx(other[k], nan_ok=True) for k in found)
