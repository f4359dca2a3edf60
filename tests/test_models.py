"""Fitted models: sanity on a learnable label, exactness of the linear parts, attribution."""

from itertools import count
from threading import Barrier

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskfold.functions.scaling import shared_dir
from riskfold.operators import attribution, calibration, cohort, curves, folds, models
from riskfold.plans import calibrated, multi_source, scoring, single_source
from riskfold.sources import artifacts
from tests import plain_trees
from workloads.lines import table

SPACE = {
    "trees": range(4, 8), "depth": range(2, 5), "min_split": range(2, 6), "min_leaf": range(2, 5),
    "features": ("sqrt", "0.7"), "subsample": (0.6, 0.95),
}
CFG = models.SearchConfig(2, 2, 1, 7, SPACE, 4)


@pytest.fixture(scope="module")
def accounts(spark):
    """Customers: profile and orders sources; the label is a large total of orders."""
    sf = "/root/testdata/sf0.01"
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.max("o_totalprice").alias("top_price"),
        F.sum("o_totalprice").alias("total"),
    )
    cut = orders.select(F.percentile_approx("total", 0.8)).first()[0]
    cust = table(spark, sf, "customer").withColumn("subject_id", F.col("c_custkey").cast("string"))
    profile = cust.select("subject_id", "c_mktsegment", "c_acctbal")
    o = orders.withColumn("subject_id", F.col("o_custkey").cast("string"))
    labels = o.select("subject_id", (F.col("total") >= cut).cast("int").alias("y_true"))
    return {"profile": profile, "orders": o.select("subject_id", "n_orders", "top_price")}, labels


@pytest.fixture(scope="module")
def cohorts(accounts):
    return multi_source.build_cohorts(*accounts, CFG)


@pytest.fixture(scope="module")
def run(cohorts):
    return multi_source.evaluate(cohorts, CFG, "sigmoid", 2)


@pytest.fixture(scope="module")
def final(cohorts, run):
    f = multi_source.fit_final(cohorts, CFG)
    return multi_source.add_oof_calibrators(f, run.oof)


def test_param_draws():
    draws = models.sample_param_grid(models.MULTI_SPACE, 200, 1)
    assert draws == models.sample_param_grid(models.MULTI_SPACE, 200, 1)
    assert {d.features for d in draws} == {"sqrt", "0.5", "0.7"}
    assert all(50 <= d.trees <= 249 and 3 <= d.depth <= 10 and 3 <= d.min_leaf <= 20 for d in draws)
    assert all(0.6 <= d.subsample <= 0.95 and 2 <= d.min_split <= 15 for d in draws)
    single = models.sample_param_grid(models.SINGLE_SPACE, 200, 1)
    assert None in {d.depth for d in single} and all(d.subsample == 1.0 for d in single)
    assert models.ForestParams(min_split=9, min_leaf=2).min_rows == 5
    assert models.ForestParams(min_split=4, min_leaf=3).min_rows == 3


def test_every_subject_is_held_out_once_per_model(cohorts, run):
    n = cohorts.wide.count()
    per = {r.model: r for r in run.oof.groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("subject_id").alias("d")).collect()}
    assert set(per) == {
        "single_profile", "single_orders", "base_profile", "base_orders",
        "multi_early", "multi_early_cal", "multi_late", "multi_late_cal",
    }
    assert all(r.n == n and r.d == n for r in per.values())
    assert run.oof.filter("p < 0 or p > 1").count() == 0
    wide = run.wide(["multi_early", "multi_late"])
    assert wide.columns == ["subject_id", "fold_id", "y_true", "proba_multi_early", "proba_multi_late"]
    assert wide.count() == n


def test_models_learn(run):
    auc = {r.model: r.auc for r in curves.roc_auc(run.oof).collect()}
    assert auc["single_orders"] > 0.8 and auc["multi_early"] > 0.8 and auc["multi_late"] > 0.8
    assert auc["single_profile"] < 0.7


def test_meta_rows_cover_the_outer_training_part(cohorts, run):
    for fold, rows in run.meta_rows.items():
        train = cohorts.train(fold)
        assert rows.count() == train.count()
        assert rows.join(cohorts.test(fold), "subject_id", "left_semi").count() == 0


def test_no_fit_sees_a_held_out_subject(cohorts, monkeypatch):
    """Every base model of the inner loop trains without its test and validation ids."""
    seen = []
    real = multi_source.fit_tuned

    def spy(df, columns, cfg, seed):
        seen.append({r[0] for r in df.select("subject_id").collect()})
        return real(df, columns, cfg, seed)

    monkeypatch.setattr(multi_source, "fit_tuned", spy)
    rows = multi_source.inner_oof(cohorts, 1, CFG)
    test_ids = {r[0] for r in cohorts.test(1).select("subject_id").collect()}
    parts = [
        {r[0] for r in rows.filter(F.col("inner_fold") == j).select("subject_id").collect()} for j in (1, 2)
    ]
    assert len(seen) == 4
    for ids in seen:
        assert not ids & test_ids
        assert sum(not ids & p for p in parts) == 1


def test_held_out_folds_are_not_read(cohorts):
    for df in (cohorts.base_train("orders", 1, 2), cohorts.base_held("orders", 2), cohorts.train(1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "fold_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    folds = cohorts.expanded["orders"].select("fold_id", "inner_fold_1").distinct().collect()
    assert all((r.inner_fold_1 is None) == (r.fold_id in (None, 1)) for r in folds)


def test_meta_logistic_is_stationary(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(400, 3))
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(3 - 4 * x[:, 0]))).astype(int)
    df = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y)], "y_true int, p_a double, p_b double, p_c double")
    meta = models.fit_meta(df, ["a", "b", "c"])
    w = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    beta = np.array([*meta.coefficients.values(), meta.intercept])
    full = np.c_[x, np.ones(400)]
    q = 1 / (1 + np.exp(-full @ beta))
    # half the squared norm, intercept included, plus weighted log-loss
    assert np.abs(beta + full.T @ (w * (q - y))).max() < 1e-3
    got = np.array([r[0] for r in df.select(meta.probability()).collect()])
    assert np.allclose(got, q)


def test_sigmoid_maps_are_stationary(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.beta(2, 5, 500), 2)
    y = (rng.uniform(size=500) < p**2 * 3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y_true int")
    c = calibration.fit_sigmoid(df)
    q = 1 / (1 + np.exp(-(c.a * p + c.b)))
    assert abs(c.a + ((q - y) * p).sum()) < 1e-3 and abs((q - y).sum()) < 1e-3
    logit = calibration.fit_sigmoid(df, logit=True)
    z = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    q = 1 / (1 + np.exp(-(logit.a * z + logit.b)))
    assert abs(logit.a + ((q - y) * z).sum()) < 5e-3
    got = np.array([r[0] for r in df.select(logit.apply(F.col("p"))).collect()])
    assert np.allclose(got, q)  # fitted and applied on the same input
    s = calibration.fit_smoothed_sigmoid(df)
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    q = 1 / (1 + np.exp(-(s.a * p + s.b)))
    assert abs(((q - t) * p).sum()) < 1e-3 and abs((q - t).sum()) < 1e-3


def test_isotonic_is_monotone_clamped_and_interpolated(spark, tmp_path):
    rows = [(0.1, 0), (0.2, 1), (0.3, 0), (0.3, 0), (0.6, 1), (0.8, 1)]
    df = spark.createDataFrame(rows, "p double, y_true int")
    cal = calibration.fit_isotonic(df)
    new = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.9, None)], "p double")
    third = 1 / 3
    want = {0.0: 0, 0.1: 0, 0.15: third / 2, 0.2: third, 0.3: third, 0.45: 2 * third, 0.6: 1, 0.9: 1}
    again = calibration.load(spark, cal.save(str(tmp_path)), str(tmp_path))
    one = calibration.Isotonic(spark.createDataFrame([(0.4, 0.25)], "x double, y double"))
    for c in (cal, again):
        got = {r.p: r.p_cal for r in c.calibrate(new).collect()}
        assert got.pop(None) is None and got == pytest.approx(want, abs=1e-9)
    assert {r.p_cal for r in one.calibrate(new).collect()} == {0.25, None}


def test_no_calibrator_for_one_class(spark):
    df = spark.createDataFrame([(0.1, 1), (0.7, 1)], "p double, y_true int")
    assert calibration.fit_calibrator(df, "sigmoid") is None
    with pytest.raises(ValueError):
        calibration.fit_calibrator(df, "other")


def test_tree_contributions_add_up(spark, cohorts, final):
    fitted = final.early
    leaves = plain_trees.forest_leaves(fitted.model, spark)
    rows = fitted.vectors(cohorts.wide, ["subject_id"]).join(
        fitted.predict(cohorts.wide, ["subject_id"]), "subject_id"
    ).select(vector_to_array("features").alias("x"), "p").limit(200).collect()
    x, p = np.array([r.x for r in rows]), np.array([r.p for r in rows])
    parts, base = plain_trees.forest_contributions(leaves, x)
    assert np.allclose(base + sum(parts.values()), p, atol=1e-9)


def test_tree_contributions_equal_enumeration(spark, cohorts, final):
    """Shapley values by their definition, over every coalition of the used features."""
    from itertools import combinations
    from math import factorial

    leaves = plain_trees.forest_leaves(final.early.model, spark)[:12]
    x = np.array([r.x for r in final.early.vectors(cohorts.wide).select(
        vector_to_array("features").alias("x")).limit(5).collect()])
    used = sorted({s.slot for _, splits in leaves for s in splits})

    def worth(coalition):
        total = np.zeros(len(x))
        for value, splits in leaves:
            factor = np.ones(len(x))
            for s in splits:
                factor *= s.holds(x[:, s.slot]) if s.slot in coalition else s.share
            total += value * factor
        return total

    got, _ = plain_trees.forest_contributions(leaves, x)
    m = len(used)
    for i in used:
        rest, want = [j for j in used if j != i], np.zeros(len(x))
        for k in range(m):
            for c in combinations(rest, k):
                w = factorial(k) * factorial(m - k - 1) / factorial(m)
                want += w * (worth({*c, i}) - worth(set(c)))
        assert np.allclose(got[i], want)


def test_tree_attribution_table(cohorts, final):
    out = attribution.tree_attribution(final.early, cohorts.wide, 100, 1).collect()
    assert len(out) == len(final.early.names)
    assert out[0].feature in ("n_orders", "top_price")
    assert all(r.mean_abs >= abs(r.mean_signed) - 1e-12 for r in out)


def test_attribution_of_a_run(cohorts, run):
    """One job equals forest by forest; contributions lead from the base to the mean probability."""
    folds = multi_source.fold_attribution(run, cohorts, CFG)
    rows = folds.collect()
    assert {(r.model, r.fold_id) for r in rows} == {
        (m, k) for m in ("single_profile", "single_orders", "multi_early", multi_source.META) for k in (1, 2)
    }
    fitted, train = run.forests["multi_early", 2], cohorts.train(2)
    alone = {r.feature: (r.mean_abs, r.mean_signed) for r in attribution.tree_attribution(fitted, train).collect()}
    found = {r.feature: (r.mean_abs, r.mean_signed) for r in rows if (r.model, r.fold_id) == ("multi_early", 2)}
    assert found.keys() == alone.keys() and all(found[f] == pytest.approx(alone[f]) for f in alone)
    base = attribution.tree_contributions(fitted, train).first().base
    mean = fitted.predict(train).agg(F.avg("p")).first()[0]
    assert base + sum(v for _, v in found.values()) == pytest.approx(mean)
    averaged = {(r.model, r.feature): r.mean_abs for r in multi_source.mean_attribution(folds, CFG).collect()}
    both = [r.mean_abs for r in rows if (r.model, r.feature) == ("single_orders", "top_price")]
    assert averaged["single_orders", "top_price"] == pytest.approx(sum(both) / 2)
    few = multi_source.fold_attribution(run, cohorts, CFG, max_rows=20)
    assert few.count() == folds.count()


def test_linear_attribution_splits_the_margin(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=600)
    df = spark.createDataFrame([(float(v), float(v + e)) for v, e in zip(a, rng.normal(size=600))], "a double, b double")
    beta = np.array([1.0, -0.5])
    cov = np.cov(np.array(df.collect()).T)
    t = attribution.conditional_transform(beta, cov)
    assert np.allclose(t.sum(axis=0), beta)  # contributions add up to beta (x - mean)
    assert np.allclose(attribution.conditional_transform(beta, np.diag([1.0, 2.0])), np.diag(beta))
    x = np.array(df.collect())
    want = np.abs((x - x.mean(axis=0)) @ t.T).mean(axis=0)
    got = {r.feature: r.mean_abs for r in attribution.linear_attribution(df, {"a": 1.0, "b": -0.5}).collect()}
    assert [got["a"], got["b"]] == pytest.approx(list(want))


def test_single_source_run(spark, accounts):
    sources, labels = accounts
    run = single_source.evaluate(sources["orders"], labels, CFG, "isotonic", 2)
    auc = {r.model: r.auc for r in curves.roc_auc(run.oof).collect()}
    assert auc["uncalibrated"] > 0.8 and auc["calibrated"] > 0.8
    model, cal = single_source.fit_deployable(run, CFG, "sigmoid", 2)
    assert isinstance(cal, calibrated.CalibratedForest) and len(cal.parts) == 2
    assert cal.predict(run.cohort).filter("p is null or p < 0 or p > 1").count() == 0
    maps = single_source.oof_calibrators(run)
    assert set(maps) == {"uncalibrated", "calibrated"} and maps["uncalibrated"].logit


def test_saved_models_score_alike(spark, cohorts, final):
    path = artifacts.save_models(final, f"{shared_dir(spark)}/models-test")
    loaded = artifacts.load_models(spark, path, ["profile", "orders"])
    n, pos = cohorts.wide.agg(F.count("*"), F.sum("y_true")).first()
    for k in ("early", "late"):  # what each map was fitted on is saved with it
        meta = loaded.calibrator_meta[k]
        assert meta == final.calibrator_meta[k] and (meta["n_oof"], meta["n_pos"], meta["method"]) == (n, pos, "sigmoid")
    new = cohorts.wide.drop("fold_id", "y_true")
    thr = spark.createDataFrame(
        [("multi_early", "f1_opt", "0.375", 1), ("multi_late", None, "0.2", 1), (" multi_late", "x", "0.2", 1),
         ("multi_late_cal", "f", "bad", 1), ("multi_early_cal", "fixed", None, 1), ("single_lab", "f", "0.1", 1)],
        "model_name string, rule string, thr string, other int",
    )
    a = scoring.score_table(final, new, thr)
    b = scoring.score_table(loaded, new, thr)
    assert a.columns == b.columns
    flags = [c for c in a.columns if c.startswith("binary_")]
    assert flags == ["binary_multi_early_f1_opt_thr_0.38", "binary_multi_late_thr_thr_0.20"]
    cols = ["subject_id", *[c for c in a.columns if c.startswith("risk_")]]
    pa = {r[0]: r[1:] for r in a.select(*cols).collect()}
    pb = {r[0]: r[1:] for r in b.select(*cols).collect()}
    assert pa.keys() == pb.keys() and all(pa[k] == pytest.approx(pb[k]) for k in pa)
    raw = scoring.score_table(final, new, calibrate=False)
    assert raw.filter("risk_multi_early <> risk_multi_early_raw").count() == 0
    with pytest.raises(FileNotFoundError, match="base_third"):
        artifacts.load_models(spark, path, ["profile", "third"])
    with pytest.raises(FileNotFoundError):
        artifacts.load_models(spark, path + "-absent", ["profile"])


def test_fit_is_reproducible_and_ignores_column_order(accounts, spark):
    sources, labels = accounts
    df = cohort.join_label(sources["orders"], labels)
    p = models.ForestParams(5, 3)
    one = models.fit_forest(df, ["n_orders", "top_price"], p, 1).predict(df)
    two = models.fit_forest(df.repartition(5), ["n_orders", "top_price"], p, 1)
    again = two.predict(df.select("top_price", F.lit(1).alias("extra"), "subject_id", "n_orders"))
    assert one.exceptAll(again).count() == 0


def test_score_cohort_keeps_unlabelled_only(spark):
    pheno = spark.createDataFrame([("1", None), ("2", 1), ("3", 2)], "subject_id string, y_true int")
    f = spark.createDataFrame([("1", 5), ("2", 6), ("3", 7), ("3", 8)], "subject_id string, x int")
    assert scoring.scoring_cohort(pheno, {"f": f}).count() == 4
    got = scoring.scoring_cohort(pheno, {"f": f}, unlabelled_only=True, dedup=True)
    assert sorted(r.subject_id for r in got.collect()) == ["1", "3"]
    assert folds.source_seed("lab") == 11


def test_small_forests_of_a_search_are_scored_together(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.uniform(size=60)
    rows = [(str(i), float(v), int(v > 0.4)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "subject_id string, x double, y_true int")
    passes, real = [], models.cumulative_curve
    monkeypatch.setattr(models, "cumulative_curve", lambda *a, **k: passes.append(1) or real(*a, **k))
    space = {"trees": [3], "depth": [2, 3], "min_split": [2], "min_leaf": [1], "features": ("0.7",)}
    fitted = models.fit_tuned(df, ["x"], models.SearchConfig(2, 2, 3, 7, space, 2))
    assert len(fitted.search) == 3 and len(passes) == 1
    large = models.ForestParams(250, 10)
    assert [len(b) for b in models.forest_batches([(large, 1), (large, 2)])] == [1, 1]


def test_precisions_scored_together_equal_those_alone(spark):
    parts = []
    for seed in (1, 2):
        rng = np.random.default_rng(seed)
        rows = [([1 - float(p), float(p)], int(y)) for p, y in zip(rng.integers(0, 20, 50) / 20, rng.integers(0, 2, 50))]
        df = spark.createDataFrame(rows, "a array<double>, y_true int")
        parts.append(df.select(array_to_vector("a").alias("probability"), "y_true"))
    none = parts[0].filter("y_true = 0")
    expected = []
    for df in parts:
        alone = df.select(F.lit("m").alias("model"), models.positive_probability().alias("p"), "y_true")
        expected.append(curves.average_precision(alone).first().auprc)
    for few in (True, False):
        found = models.step_precisions([*parts, none], few)
        assert found == pytest.approx([*expected, 0.0])


def test_forests_of_a_fold_share_a_scan_of_it(spark):
    rows = spark.range(80).select(
        F.col("id").cast("string").alias("subject_id"),
        array_to_vector(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double"))).alias("features"),
        (F.col("id") % 3 == 0).cast("double").alias("y_true"),
        F.lit(1.0).alias("weight"),
        (F.col("id") % 2 + 1).cast("int").alias("inner"),
    )
    some = [models.forest(models.ForestParams(3, d), 7).fit(rows) for d in (1, 2)]
    fitted = [(m, k) for m in some for k in (1, 2)]
    alone = [m.transform(rows.filter(F.col("inner") == k)) for m, k in fitted]
    scores = models.held_scores(rows, "inner", [(m.copy(), k) for m, k in fitted])
    expected = {i: sorted((r[0], r[1]) for r in d.select(models.positive_probability(), "y_true").collect()) for i, d in enumerate(alone)}
    found = {i: [] for i in expected}
    for r in scores.collect():
        found[r.model].append((r.p, r.y_true))
    assert {i: sorted(x) for i, x in found.items()} == expected
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 2  # one a fold, not one a forest
    shuffled = curves.cumulative_curve(scores.repartition("model"), edges=[]).groupBy("model").count()
    assert shuffled._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert models.model_precisions(scores, 5, True) == pytest.approx([*models.step_precisions(alone), 0.0])


def test_sources_are_read_once_for_all_cohorts(spark):
    """A source is computed once, however many cohorts and folds are built from it."""
    count = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        count.add(1)
        return v

    df = spark.createDataFrame([(str(i), float(i)) for i in range(40)], "subject_id string, x double")
    labels = spark.createDataFrame([(str(i), i % 2) for i in range(40)], "subject_id string, y_true int")
    features = {"a": df.select("subject_id", seen("x").alias("x"))}
    multi_source.build_cohorts(features, labels, models.SearchConfig(2, 2, 1, 7))
    assert count.value == 40


def test_tasks_of_a_fit_follow_its_rows(spark, monkeypatch):
    """However many shuffle partitions are set, a small fit has few tasks."""
    rng = np.random.default_rng(5)
    rows = [(str(i), float(v), int(v > 0.4)) for i, v in enumerate(rng.uniform(size=60))]
    df = spark.createDataFrame(rows, "subject_id string, x double, y_true int")
    widths, classes, logistic = [], models.with_classes, calibration._logistic

    def noted(real):
        return lambda rows, other: widths.append(rows.rdd.getNumPartitions()) or real(rows, other)

    monkeypatch.setattr(models, "with_classes", noted(classes))
    monkeypatch.setattr(calibration, "_logistic", noted(logistic))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        space = {"trees": [3], "depth": [2], "min_split": [2], "min_leaf": [1], "features": ("0.7",)}
        models.fit_tuned(df, ["x"], models.SearchConfig(2, 2, 1, 7, space, 1))
        calibration.fit_sigmoid(df.withColumnRenamed("x", "p"))
        calibration.fit_smoothed_sigmoid(df.withColumnRenamed("x", "p"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(widths) == 5 and max(widths) == 1


def test_a_search_has_few_jobs(spark):
    """A search counts its classes once; its folds need one shuffle and their sizes no job."""
    rng = np.random.default_rng(5)
    rows = [(str(i), float(v), int(v > 0.4)) for i, v in enumerate(rng.uniform(size=60))]
    df = spark.createDataFrame(rows, "subject_id string, x double, y_true int")
    space = {"trees": [3], "depth": [2], "min_split": [2], "min_leaf": [1], "features": ("0.7",)}
    jobs, context = [], spark.sparkContext
    real = models.in_parallel

    def noted(*args):  # the first call starts the fits
        jobs.append(len(context.statusTracker().getJobIdsForGroup("search-jobs")))
        return real(*args)

    context.setJobGroup("search-jobs", "jobs before the first fit")
    models.in_parallel = noted
    try:
        models.fit_tuned(df, ["x"], models.SearchConfig(2, 2, 1, 7, space, 1))
    finally:
        models.in_parallel = real
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 1 <= jobs[0] <= 5


def test_a_fold_is_finished_with_its_last_fit(spark, cohorts, monkeypatch):
    """Late fusion of a fold does not wait for the fits of later folds."""
    order = []
    cfg = models.SearchConfig(2, 2, 1, 7, SPACE, 1)
    table = cohorts.wide.select("subject_id", "fold_id", "y_true", F.lit(0.5).alias("p"))

    def jobs(kind):
        return lambda c, k, cfg: {n: (lambda: order.append((kind, k)) or table) for n in ("a", "b")}

    monkeypatch.setattr(multi_source, "_inner_jobs", jobs("inner"))
    monkeypatch.setattr(multi_source, "_base_jobs", jobs("base"))
    monkeypatch.setattr(multi_source, "_meta_rows", lambda c, k, scored: table)
    monkeypatch.setattr(multi_source, "_base_rows", lambda c, k, scored: table)

    def late(c, fold, *rest):
        order.append(("late", fold))
        return [multi_source._labelled(table.filter(F.col("fold_id") == fold), "multi_late")], table, None

    monkeypatch.setattr(multi_source, "late_fold", late)
    run = multi_source.evaluate(cohorts, cfg, None, 2, ("late",))
    assert run.oof.count() == table.count()
    assert order.index(("late", 1)) < order.index(("inner", 2))


def test_deep_forests_hold_the_node_of_each_row(spark):
    """The trees are those of a fit that walks every row down from the root for each level."""
    rng = np.random.default_rng(5)
    rows = [(float(v), float(w), int(v + w > 0.9), 1.0) for v, w in rng.uniform(size=(300, 2))]
    df = spark.createDataFrame(rows, "v double, w double, y_true int, weight double")
    df = models.with_classes(df.withColumn("features", array_to_vector(F.array("v", "w"))), 2)
    deep = models.forest(models.ForestParams(5, None), 3)
    shallow = models.forest(models.ForestParams(5, models.SHALLOW), 3)
    assert deep.getCacheNodeIds() and not shallow.getCacheNodeIds()
    walked = models.forest(models.ForestParams(5, None), 3)
    walked.set(walked.cacheNodeIds, False)
    trees = [[t.toDebugString.split("\n", 1)[1] for t in f.fit(df).trees] for f in (deep, walked)]
    assert trees[0] == trees[1]


def test_draws_of_a_search_share_the_frame_of_a_fold(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(str(i), float(v), int(v > 0.4)) for i, v in enumerate(rng.uniform(size=60))]
    df = spark.createDataFrame(rows, "subject_id string, x double, y_true int")
    made, real = [], models.with_classes
    monkeypatch.setattr(models, "with_classes", lambda *a: made.append(a[1]) or real(*a))
    space = {"trees": [3], "depth": [2], "min_split": [2], "min_leaf": [1], "features": ("0.7",)}
    found = models.fit_tuned(df, ["x"], models.SearchConfig(2, 2, 4, 7, space, 2))
    assert made == [2, 2, 2] and len(found.search) == 4


def test_models_are_saved_loaded_and_calibrated_at_the_same_time(spark, final, run, monkeypatch, tmp_path):
    """Two of each kind wait for each other, so one after the other would time out."""

    def met(real):
        pair = Barrier(2)

        def wait(*args, **kwargs):
            if next(calls) < 2:
                pair.wait(60)
            return real(*args, **kwargs)

        calls = count()
        return wait

    for module, name in (
        (artifacts, "save_forest"), (artifacts, "load_forest"), (calibration, "fit_calibrator"),
    ):
        monkeypatch.setattr(module, name, met(getattr(module, name)))
    path = artifacts.save_models(final, str(tmp_path / "models"))
    loaded = artifacts.load_models(spark, path, ["profile", "orders"])
    assert list(loaded.bases) == ["profile", "orders"] and set(loaded.singles) == set(final.singles)
    assert set(multi_source.fit_oof_calibrators(run.oof)) == {"early", "late"}
