"""Packed blocks, hashed levels, and the bound on running fits."""

import threading
import time

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from riskfold.functions.scaling import shared_dir, written
from riskfold.operators import blocks, cohort, features, models
from riskfold.plans import multi_source
from riskfold.sources import artifacts

ODD = ["1:55.5 A", "x`y", "2:7"]


def frame(spark):
    rows = [("a", 1.0, None, 0), ("b", 0.0, 0.5, 0), ("b", 0.0, 0.5, 0), (None, 2.0, 1.0, 3)]
    return spark.createDataFrame(rows, ["subject_id", *ODD])


def values(df, name="g"):
    rows = df.orderBy("subject_id").collect()
    return [(r.subject_id, tuple(None if np.isnan(v) else float(v) for v in r[name].toArray())) for r in rows]


def test_pack_keeps_names_order_and_missing_values(spark):
    out = blocks.pack(frame(spark), ODD, "g", ["subject_id"])
    assert blocks.slot_names(out, "g") == ODD
    assert values(out) == [(None, (2.0, 1.0, 3.0)), ("a", (1.0, None, 0.0)), ("b", (0, 0.5, 0)), ("b", (0, 0.5, 0))]
    back = written(out, "block")
    assert blocks.slot_names(back, "g") == ODD
    joined = cohort.join_intersection({"g": back, "h": frame(spark).select("subject_id", F.lit(1).alias("z"))})
    assert blocks.slot_names(joined, "g") == ODD and joined.count() == 2
    assert isinstance(
        blocks.pack(spark.createDataFrame([("a", *[0] * 50)], ["subject_id", *map(str, range(50))]),
                    [str(i) for i in range(50)], "g", ["subject_id"]).first().g, SparseVector)
    assert values(blocks.pack(frame(spark).limit(0), ODD, "g", ["subject_id"])) == []


def test_pack_array_refuses_other_lengths(spark):
    df = spark.createDataFrame([("a", [1.0, None]), ("b", [0.0, 2.0])], "subject_id string, v array<double>")
    assert values(blocks.pack_array(df, "v", ["p", "q"], "g", ["subject_id"])) == [("a", (1.0, None)), ("b", (0.0, 2.0))]
    with pytest.raises(Exception, match="2 values for 3 slots"):
        blocks.pack_array(df, "v", ["p", "q", "r"], "g", ["subject_id"]).collect()
    with pytest.raises(ValueError, match="repeat"):
        blocks.pack_array(df, "v", ["p", "p"], "g", ["subject_id"])


def test_slices_and_alignment_go_by_name(spark):
    df = blocks.pack(frame(spark), ODD, "g", ["subject_id"]).filter("subject_id = 'a'")
    turned = blocks.slice_block(df, "g", [ODD[2], ODD[0]], "t")
    assert blocks.slot_names(turned, "t") == [ODD[2], ODD[0]] and values(turned, "t") == [("a", (0.0, 1.0))]
    with pytest.raises(ValueError, match="lacks slots"):
        blocks.slice_block(df, "g", ["gone"], "t")
    asked = df.select("subject_id", blocks.aligned(df, "g", [ODD[2], "gone", ODD[0]]))
    assert values(asked) == [("a", (0.0, None, 1.0))] and blocks.slot_names(asked, "g")[1] == "gone"
    absent = df.select("subject_id", blocks.aligned(df, "other", ["p", "q"]))
    assert values(absent, "other") == [("a", (None, None))]
    plain = spark.createDataFrame([("a", Vectors.dense([1.0]))], ["subject_id", "g"])
    with pytest.raises(ValueError, match="pack it first"):
        blocks.slot_names(plain, "g")


def wide_source(spark, width):
    """A source of ``width`` mostly zero columns; the first tells the label."""
    ids = spark.range(120)
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.when(i == 0, F.col("id") % 2).otherwise(
            (F.pmod(F.xxhash64("id", i), F.lit(40)) == 0).cast("int")
        ).cast("double"),
    )
    return ids.select(F.col("id").cast("string").alias("subject_id"), cells.alias("v"))


def packed_cohorts(spark, width, cfg):
    names = [f"{i}:{i}" for i in range(width)]
    genes = blocks.pack_array(wide_source(spark, width), "v", names, "genetics", ["subject_id"])
    other = spark.range(120).select(F.col("id").cast("string").alias("subject_id"), (F.col("id") % 7).alias("x"))
    labels = spark.range(120).select(F.col("id").cast("string").alias("subject_id"), (F.col("id") % 2).cast("int").alias("y_true"))
    return multi_source.build_cohorts({"genetics": genes, "other": other}, labels, cfg)


def test_a_wide_source_goes_through_early_fusion_in_a_plan_of_constant_size(spark):
    cfg = models.SearchConfig(2, 2, 1, 7, {"trees": [5], "depth": [3], "min_split": [2], "min_leaf": [1], "features": ("0.7",)}, 4)

    def size(c, fitted):
        return len(fitted.predict(c.test(1))._jdf.queryExecution().optimizedPlan().toString())

    sizes = []
    for width in (50, 5000):
        c = packed_cohorts(spark, width, cfg)
        kept = {}
        raw = multi_source.early_fold(c, 1, cfg, None, 2, kept)[0]
        fitted = kept["multi_early", 1]
        assert fitted.names == [*[f"{i}:{i}" for i in range(width)], "x"]
        assert raw.filter("abs(p - y_true) >= 0.5").count() == 0
        sizes.append(size(c, fitted))
    assert sizes[1] < 1.5 * sizes[0]


def test_blocks_refuse_missing_numbers_unless_allowed_and_are_saved(spark):
    p = models.ForestParams(3, 3)
    names = ["a", "b"]
    rows = [(str(i), [float(i % 2), float(i)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "subject_id string, v array<double>, y_true int")
    good = blocks.pack_array(df, "v", names, "g", ["subject_id", "y_true"])
    hole = spark.createDataFrame([("0", [None, 1.0], 0)], df.schema)
    bad = blocks.pack_array(hole, "v", names, "g", ["subject_id", "y_true"])
    fitted = models.fit_forest(good, ["g"], p, 1)
    with pytest.raises(Exception, match="missing numbers"):
        fitted.predict(bad).collect()
    with pytest.raises(Exception, match="missing numbers"):
        models.fit_forest(good.unionByName(bad), ["g"], p, 1)
    loose = models.fit_forest(good, ["g"], p, 1, allow_missing=True)
    assert loose.predict(bad).count() == 1
    assert loose.predict(good.drop("g")).count() == 40
    path = f"{shared_dir(spark)}/packed-forest"
    read = artifacts.load_forest(path, artifacts.save_forest(fitted, path))
    turned = blocks.slice_block(good, "g", ["b", "a"], "t").select("subject_id", F.col("t").alias("g"))
    assert fitted.predict(good).exceptAll(read.predict(turned)).count() == 0


def test_a_million_levels_without_a_list_of_them(spark):
    df = spark.range(1_000_000).select(
        F.col("id").cast("string").alias("subject_id"),
        F.concat(F.lit("level "), F.col("id")).alias("c"),
        (F.col("id") % 2).alias("x"),
        (F.col("id") % 2).cast("int").alias("y_true"),
    )
    inputs = features.prepare_inputs(df, ["x"], ["c"], ["subject_id", "y_true"])
    prep = features.fit_preparation(inputs, ["x"], ["c"], max_levels=10, hashed={"c": 16})
    assert features.feature_names(prep, ["x"]) == ["x", *[f"c#{i}" for i in range(16)]]
    fitted = models.fit_forest(df, ["x", "c"], models.ForestParams(2, 2, features="0.7"), 1, hashed={"c": 16})
    new = spark.createDataFrame([("n", "unseen", 1), ("m", None, 0)], "subject_id string, c string, x long")
    assert fitted.predict(new).filter("p between 0 and 1").count() == 2
    assert fitted.names == features.feature_names(prep, ["x"])


def test_nested_searches_share_the_slots_of_their_configuration(spark, monkeypatch):
    cfg = models.SearchConfig(2, 2, 2, 7, {"trees": [2], "depth": [2], "min_split": [2], "min_leaf": [1], "features": ("0.7",)}, 3)
    running, most, pools, lock = [0], [0], set(), threading.Lock()
    total = [0]
    real = models.RandomForestClassifier.fit

    def fit(self, *args):
        with lock:
            running[0] += 1
            total[0] += 1
            most[0] = max(most[0], running[0])
            pools.add(spark.sparkContext.getLocalProperty(models.FitSlots.POOL))
        try:
            time.sleep(0.05)
            return real(self, *args)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(models.RandomForestClassifier, "fit", fit)
    c = packed_cohorts(spark, 3, cfg)
    multi_source.inner_oof(c, 1, cfg)
    # Two sources and two inner folds; each search fits 2 draws in 2 folds and the best again.
    assert total[0] == 2 * 2 * (2 * 2 + 1)
    assert 1 < most[0] <= 3
    assert pools <= {f"fit-{i}" for i in range(3)}
    assert spark.sparkContext.getLocalProperty(models.FitSlots.POOL) is None


def test_a_failed_fit_gives_its_slot_back(spark):
    slots = models.FitSlots(1)
    for _ in range(2):
        with pytest.raises(KeyError), slots.taken(spark):
            raise KeyError
    cfg = models.SearchConfig(2, 5, 1, 7)
    few = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 1)], "subject_id string, x double, y_true int")
    with pytest.raises(ValueError, match="inner folds have rows"):
        models.fit_tuned(few, ["x"], cfg)
