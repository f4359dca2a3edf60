"""Parallel pooling of violators and the range join, against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.operators import isotonic


def plain_fit(p, y):
    """Distinct scores and their fitted values: largest start mean over smallest end mean."""
    xs, at = np.unique(p, return_inverse=True)
    pos, n = np.bincount(at, y), np.bincount(at)
    cp, cn = np.append(0, np.cumsum(pos)), np.append(0, np.cumsum(n))
    means = np.array([[(cp[j + 1] - cp[i]) / (cn[j + 1] - cn[i]) if j >= i else np.inf for j in range(len(xs))] for i in range(len(xs))])
    return xs, np.array([max(means[i, k:].min() for i in range(k + 1)) for k in range(len(xs))])


STREAMS = {
    "rising": lambda p, r: r < p,
    "falling": lambda p, r: r < 1 - p,
    "noise": lambda p, r: r < 0.5,
    "steps": lambda p, r: (np.floor(p * 7) % 2 == 0) & (r < 0.9),
    "zeros": lambda p, r: r < 0,
}


@pytest.fixture(scope="module")
def streams(spark):
    rng = np.random.default_rng(11)
    out = {}
    for name, rule in STREAMS.items():
        p = np.round(rng.uniform(size=240), 3)
        p[:60] = 0.25  # a score that a quarter of all rows share
        out[name] = p, rule(p, rng.uniform(size=240)).astype(int)
    rows = [(m, float(a), int(b)) for m, (p, y) in out.items() for a, b in zip(p, y)]
    rows += [("rising", None, 1), ("rising", float("nan"), 0), ("rising", 0.5, None)]
    return out, spark.createDataFrame(rows, "model string, p double, y_true int")


@pytest.mark.parametrize("per_task", [1, 7, 1 << 18])
def test_ranges_pool_to_the_same_fit(streams, per_task):
    """Small ranges: several rounds over the seams."""
    data, df = streams
    blocks = isotonic.isotonic_blocks(df, ["model"], per_task=per_task).collect()
    for name, (p, y) in data.items():
        xs, want = plain_fit(p, y)
        own = sorted((r.lo, r.hi, r.pos / r.n) for r in blocks if r.model == name)
        assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(own, own[1:], strict=False))
        found = [next(v for lo, hi, v in own if lo <= x <= hi) for x in xs]
        assert found == pytest.approx(want)
    assert len([r for r in blocks if r.model == "zeros"]) == 1


def test_maps_interpolate_by_group(spark, streams, monkeypatch):
    monkeypatch.setattr(isotonic, "KNOTS_PER_BUCKET", 2)  # many buckets, some without knots
    data, df = streams
    knots = isotonic.isotonic_knots(df, ["model"])
    asked = np.round(np.linspace(-0.2, 1.2, 701), 4)
    rows = [(m, float(x)) for m in [*data, "unknown"] for x in asked]
    rows += [("noise", None), ("noise", float("nan")), (None, 0.5)]
    new = spark.createDataFrame(rows, "model string, p double")
    new = new.select("*", *[F.lit("x").alias(c) for c in ("bucket", "knots", "x", "_p")])
    out = isotonic.apply_knots(new, knots, ["model"])
    assert out.columns == [*new.columns, "p_cal"]
    found = {(r.model, r.p): r.p_cal for r in out.collect()}
    for name, (p, y) in data.items():
        xs, ys = plain_fit(p, y)
        want = np.interp(asked, xs, ys)
        assert [found[name, float(x)] for x in asked] == pytest.approx(want)
    assert all(v is None for (m, p), v in found.items() if m in (None, "unknown") or p is None or p != p)


def test_plan_does_not_grow_with_the_knots(spark):
    def size(n):
        knots = spark.range(n).select((F.col("id") / n).alias("x"), (F.col("id") / n).alias("y"))
        out = isotonic.apply_knots(spark.range(5).select(F.rand(1).alias("p")), knots)
        return len(out._jdf.queryExecution().optimizedPlan().toString())

    assert size(40_000) < 1.2 * size(400)


def test_no_rows_no_map(spark):
    none = spark.createDataFrame([], "p double, y_true int")
    assert isotonic.isotonic_knots(none).count() == 0
    out = isotonic.apply_knots(spark.createDataFrame([(0.5,)], "p double"), isotonic.isotonic_knots(none))
    assert out.first().p_cal is None
