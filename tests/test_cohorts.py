import pytest
from pyspark.sql import functions as F

from riskfold.functions.scaling import attach_small
from riskfold.operators import cohort, features, folds, summaries
from riskfold.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_dedup_keeps_first_by_order(spark):
    df = frame(spark, [("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, o int, v string")
    got = sorted(tuple(r) for r in cohort.dedup_keep_first(df, ["k"], ["o"]).collect())
    assert got == [("a", 1, "y"), ("b", 5, None)]
    # without an order the remaining columns decide, so the result never depends on partitions
    assert sorted(cohort.dedup_keep_first(df.repartition(3), ["k"]).collect()) == sorted(
        cohort.dedup_keep_first(df.coalesce(1), ["k"]).collect()
    )


def test_feature_columns(spark):
    df = frame(spark, [("1", 1, 2, 3)], "subject_id string, `1:2:A` int, other int, `ANCA EU` int")
    assert cohort.feature_columns(df, ":") == ["1:2:A"]
    assert cohort.feature_columns(df, None) == ["1:2:A", "other", "ANCA EU"]
    assert cohort.feature_columns(df, ["ANCA EU", "CBir1 EU"], strict=False) == ["ANCA EU"]
    with pytest.raises(ValueError, match="CBir1"):
        cohort.feature_columns(df, ["ANCA EU", "CBir1 EU"])
    with pytest.raises(ValueError, match="no usable"):
        cohort.feature_columns(df, ["nothing"], strict=False)


def test_intersection_and_expanded(spark):
    a = frame(spark, [("1", 10), ("1", 5), ("2", 20), ("3", 30)], "subject_id string, a int")
    b = frame(spark, [("1", "x"), ("2", "y"), ("4", "z")], "subject_id string, b string")
    y = frame(spark, [("1", 1), ("2", 0), ("3", 0)], "subject_id string, y_true int")
    assert cohort.join_label(a, y).count() == 4
    wide = cohort.join_intersection({"a": a, "b": b}, y)
    assert sorted(tuple(r) for r in wide.collect()) == [("1", 5, "x", 1), ("2", 20, "y", 0)]
    assert cohort.join_intersection({"a": a, "b": b}, None, dedup=False).count() == 3


def test_holdouts_split_without_overlap(spark):
    rows = frame(spark, [(str(i), i) for i in range(20)], "subject_id string, v int")
    h1, h2 = rows.filter("v < 5"), rows.filter("v between 4 and 8")
    train, held = cohort.without_ids(rows, h1, h2), cohort.only_ids(rows, h1, h2)
    assert train.count() == 11 and held.count() == 9
    assert train.join(held, "subject_id").count() == 0


def test_last_duplicate_probability_wins(spark):
    rows = frame(spark, [("1",), ("2",)], "subject_id string")
    probs = frame(spark, [("01", 1, 0.9), ("1", 2, 0.1)], "subject_id string, o int, p double")
    got = {r.subject_id: r.p_x for r in cohort.join_probability(rows, probs, "p_x", ["o"]).collect()}
    assert got == {"1": 0.1, "2": None}


def test_guards(spark):
    df = frame(spark, [("1", 0.5, 1), ("2", None, 0), ("3", float("nan"), 1)], "subject_id string, p double, y_true int")
    with pytest.raises(ValueError, match="2 of 3 rows"):
        cohort.guard_complete(df, ["p"], "oof")
    with pytest.raises(ValueError, match="no rows"):
        cohort.guard_complete(df.limit(0), ["p"], "oof")
    assert cohort.guard_labels(df, "x") is df
    with pytest.raises(ValueError, match="not 0 or 1"):
        cohort.guard_labels(df.withColumn("y_true", F.lit(2)), "x")


@pytest.mark.parametrize("limit", [0, 100])
def test_small_side_join_is_the_same_broadcast_or_salted(spark, limit):
    big = frame(spark, [("hot", i) for i in range(500)] + [("cold", 1), ("none", 2)], "k string, v int")
    small = frame(spark, [("hot", 1), ("hot", 2), ("cold", 3)], "k string, t int")
    got = attach_small(big, small, ["k"], salt_by=["v"], limit=limit)
    want = big.join(small, "k")
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


# ---------------------------------------------------------------- folds


def labelled(spark, n=397, positives=41):
    return frame(spark, [(f"s{i}", int(i < positives)) for i in range(n)], "subject_id string, y_true int")


def test_folds_are_stratified_and_reproducible(spark):
    df = labelled(spark)
    one = folds.stratified_folds(df, 5, 42)
    counts = one.groupBy("fold_id", "y_true").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in counts if r.y_true == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = folds.stratified_folds(df.repartition(7), 5, 42)
    assert one.exceptAll(again).count() == 0
    other = folds.stratified_folds(df, 5, 43)
    assert one.exceptAll(other).count() > 0


def test_nested_folds_leave_the_outer_test_out(spark):
    outer = folds.stratified_folds(labelled(spark), 3, 1)
    nested = folds.nested_folds(outer, 3, 2, 1)
    assert nested.filter("fold_id = outer_fold").count() == 0
    assert nested.count() == 2 * outer.count()
    sizes = [r["count"] for r in nested.groupBy("outer_fold", "inner_fold", "y_true").count().collect()]
    assert len(sizes) == 12
    assert {r.inner_fold for r in nested.select("inner_fold").distinct().collect()} == {1, 2}


def test_sample_rows(spark):
    df = labelled(spark)
    assert folds.sample_rows(df, 30, 1).count() == 30
    assert folds.sample_rows(df, 30, 1).exceptAll(folds.sample_rows(df.repartition(5), 30, 1)).count() == 0
    assert folds.sample_rows(df, None, 1) is df
    assert folds.sample_rows(df, 10_000, 1).count() == 397


def test_seeds():
    assert folds.derive_seed("single", 2, "lab") == 2011
    assert folds.derive_seed("late_inner", 1, "clinical", 3) == 3074
    assert folds.derive_seed("early", 4) == 8000


def test_modal_params_tie_takes_the_first_seen(spark):
    best = frame(spark, [(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, "c")], "fold_id int, params string")
    assert summaries.modal_best_params(best).first().params == "b"
    assert summaries.modal_best_params(best.limit(0)).count() == 0


# ---------------------------------------------------------------- features


def test_one_hot_unseen_and_null_levels(spark):
    train = frame(spark, [("1", "a"), ("2", "b"), ("3", None)], "subject_id string, c string")
    prep = features.fit_preparation(features.prepare_inputs(train, [], ["c"]), [], ["c"])
    assert features.feature_names(prep, []) == ["c___null__", "c_a", "c_b"]
    new = frame(spark, [("1", "a"), ("2", "z"), ("3", None)], "subject_id string, c string")
    out = prep.transform(features.prepare_inputs(new, [], ["c"], ["subject_id"])).orderBy("subject_id")
    assert [list(r.features.toArray()) for r in out.collect()] == [[0, 1, 0], [0, 0, 0], [1, 0, 0]]


def test_missing_numbers_are_an_error_unless_allowed(spark):
    df = frame(spark, [(1.0,), (2.0,)], "x double")
    wanted = features.prepare_inputs(df, ["x", "gone"], [])
    strict = features.fit_preparation(features.prepare_inputs(df, ["x"], []), ["x"], [])
    assert strict.transform(df).count() == 2
    with pytest.raises(Exception, match="(?i)nan|null|invalid"):
        features.fit_preparation(wanted, ["x", "gone"], []).transform(wanted).collect()
    loose = features.fit_preparation(wanted, ["x", "gone"], [], allow_missing=True)
    assert loose.transform(wanted).count() == 2


def test_weights_and_level_guard(spark):
    df = frame(spark, [(1,), (0,), (0,), (0,)], "y_true int")
    assert features.class_weights(df) == {1: 2.0, 0: pytest.approx(2 / 3)}
    with pytest.raises(ValueError, match="too many levels"):
        features.guard_levels(frame(spark, [(str(i),) for i in range(50)], "c string"), ["c"], 10)


# ---------------------------------------------------------------- sources


def test_table_round_trip_and_optional(spark, tmp_path):
    df = frame(spark, [(1, "a b", 0.5), (2, None, None)], "`the id` int, t string, x double")
    path = tables.write_table(df, str(tmp_path / "t.csv"))
    back = tables.scan_table(spark, path)
    assert sorted(back.collect()) == sorted(df.collect())
    assert tables.optional_source(spark, str(tmp_path / "none.csv")) is None
    assert tables.optional_source(spark, None) is None
    assert tables.optional_source(spark, path).count() == 2


def test_column_checks_and_aliases(spark):
    df = frame(spark, [("m", "r", "0.5")], "` clf ` string, rule string, value string")
    with pytest.raises(ValueError, match="missing|lacks"):
        tables.require_columns(df, ["rule", "nope"])
    got = tables.canonical_thresholds(df)
    assert got.columns == ["model", "threshold_name", "threshold"]
    assert tables.canonical_thresholds(df.drop("value")) is None
    assert tables.resolve_alias(df, ["x", "rule"]) == "rule"


def test_fractional_labels_are_refused(spark):
    pheno = spark.createDataFrame(
        [("1", "p", "g", 0.5), ("2", "p", "g", 1.0), ("3", "p", "g", None)],
        "subject_id string, pop string, grp string, y double",
    )
    kept = cohort.filter_training(pheno, "pop", ["p"], "grp", ["g"], "y")
    assert sorted(r[cohort.LABEL] for r in kept.collect()) == [-1, 1]
    with pytest.raises(ValueError):
        cohort.guard_labels(kept, "labels")


def test_few_rows_get_the_folds_of_many(spark):
    """One window deals the same folds as buckets, copies and nulls included, and their sizes are known."""
    rows = [(str(i % 50), int(i % 7 == 0), i) for i in range(180)] + [("x", None, 1), (None, 1, 2)]
    df = spark.createDataFrame(rows, "subject_id string, y_true int, v int")
    many = folds.stratified_folds(df, 4, 42, tie=["v"])
    few = folds.stratified_folds(df, 4, 42, tie=["v"], few=True)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    known = df.dropna(subset=["y_true"])
    sizes = {r[0]: r[1] for r in known.groupBy("y_true").count().collect()}
    dealt = folds.stratified_folds(known, 4, 42, tie=["v"])
    counted = {(r[0], r[1]): r[2] for r in dealt.groupBy("fold_id", "y_true").count().collect()}
    assert folds.fold_sizes(sizes, 4) == counted
    for sizes in ({0: 2, 1: 1}, {1: 5}, {0: 3, 1: 7}):
        by_rank = [(i % 4 + 1, k) for i, k in enumerate(k for k, n in sorted(sizes.items()) for _ in range(n))]
        assert folds.fold_sizes(sizes, 4) == {pair: by_rank.count(pair) for pair in by_rank}
    outer = folds.stratified_folds(df.filter("subject_id is not null"), 3, 1)
    one, two = (folds.nested_folds(outer, 3, 2, 1, few=f) for f in (False, True))
    per = ["subject_id", "v", "outer_fold"]
    assert sorted(map(str, two.select(per).collect())) == sorted(map(str, one.select(per).collect()))


def test_folds_of_many_tied_rows_broadcast_nothing(spark):
    df = spark.range(500).selectExpr("cast(id as string) as subject_id", "cast(id % 2 as int) as y_true")
    dealt = folds.stratified_folds(df.withColumn("_tie", F.xxhash64("y_true")), 3, 1, tie=["_tie"])
    assert dealt.count() == 500
    assert "Broadcast" not in dealt._jdf.queryExecution().executedPlan().toString()
