"""Mixing sources to target weights by Pfair scheduling.

The rows of each source form blocks of ``block_rows`` rows. A source with share ``a`` of
``q`` slots gives its j-th block the window from slot ``floor((j-1) q/a)`` to
``ceil(j q/a)``; in each slot the released block with the earliest deadline goes next. So
after any number of slots a source is less than one block from its exact share.

Shares are whole numbers, so the schedule repeats after ``q`` slots: one period is folded in
SQL and laid over all blocks by arithmetic, whatever their number. When a source runs out
within a period, the windows of that period follow the exact flow in which the others go on
in the ratio of their shares, and later periods are without it. There are at most
two kinds of period for each source, so the plan is as small as the list of sources.

All rows come out, each once, with ``position`` (0, 1, ...). Within a source, rows are
ordered by hash of the key columns. A null source is a source of its own. Repeated rows get
a position each. An empty table gives an empty result. Sources without a weight are refused,
weights without rows are left out, and added columns replace those of the same names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfold.functions.scaling import written
from riskfold.llm.tables import let

BLOCK_ROWS = 16
SLOTS = 1000
SPREAD = 4


def whole_shares(weights: Mapping, slots: int = SLOTS) -> dict:
    """Weights as whole numbers of at least one that sum to ``slots`` (or to their number).

    Largest remainders; ties by name.
    """
    total = sum(weights.values())
    if total <= 0 or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    slots = max(slots, len(weights))
    exact = {k: w * slots / total for k, w in weights.items()}
    shares = {k: max(1, int(x)) for k, x in exact.items()}
    order = sorted(exact, key=lambda k: (shares[k] - exact[k], str(k)))
    i = 0
    while (left := slots - sum(shares.values())) != 0:
        k = order[i % len(order)] if left > 0 else max(shares, key=lambda k: (shares[k] - exact[k], shares[k]))
        shares[k] += 1 if left > 0 else -1
        i += 1
    return shares


def phases(blocks: Mapping, shares: Mapping) -> list[dict]:
    """Runs of equal periods: ``shares`` of the sources, blocks of each in a period (``per``),
    number of periods, and the slot and the blocks of each source before it."""
    left, first, slot, out = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    while active := {k: shares[k] for k, n in left.items() if n}:
        per = {k: min(a, left[k]) for k, a in active.items()}
        times = min(left[k] // a for k, a in active.items()) or 1
        out.append({"shares": active, "per": per, "times": times, "slot": slot, "first": dict(first)})
        for k, n in per.items():
            left[k] -= n * times
            first[k] += n * times
        slot += times * sum(per.values())
    return out


def period(spark: SparkSession, runs: list[tuple[list[int], list[int]]]) -> DataFrame:
    """Slots of one period of each run: ``run, source, nth, slot``, by earliest deadline first.

    A run has the shares of its sources and how many blocks each has for the period. When
    shares ``v`` have been served, a source has had ``share * v`` blocks or all it has; the
    sum over all sources is the slot that this takes. It gives the windows of the blocks.
    """
    rows = spark.createDataFrame(
        [(i, [(a, n) for a, n in zip(*run, strict=True)]) for i, run in enumerate(runs)],
        "run int, s array<struct<a:int,n:int>>",
    )

    def slots(d: Column, a: Column) -> Column:
        """``a`` times the slot at which a source of share ``a`` has had ``d`` blocks."""
        zero = F.lit(0).cast("long")
        return F.aggregate(
            "s", zero, lambda t, x: t + F.least(x["a"].cast("long") * d, x["n"].cast("long") * a)
        )

    windows = F.transform(
        "s",
        lambda s: F.transform(
            F.sequence(F.lit(0), s["n"] - 1),
            lambda d: F.struct(
                F.floor(slots(d, s["a"]) / s["a"]).alias("release"),
                F.ceil(slots(d + 1, s["a"]) / s["a"]).alias("deadline"),
            ),
        ),
    )

    def pick(windows: Column, done: Column, t: Column) -> Column:
        """Released block with the least deadline; equal deadlines by place in the list."""
        ahead = F.transform(windows, lambda w, i: F.struct(F.get(w, F.get(done, i)).alias("w"), i.alias("source")))
        released = F.filter(ahead, lambda x: x["w"]["release"] <= t)
        by = F.transform(released, lambda x: F.struct(x["w"]["deadline"].alias("deadline"), x["source"].alias("source")))
        return F.array_min(by)["source"]

    def scheduled(windows: Column) -> Column:
        start = F.struct(
            F.transform("s", lambda _: F.lit(0)).alias("done"),
            F.array().cast("array<int>").alias("order"),
        )

        def step(state: Column, t: Column) -> Column:
            return let(
                pick(windows, state["done"], t),
                lambda s: F.struct(
                    F.transform(state["done"], lambda d, i: d + F.when(i == s, 1).otherwise(0)).alias("done"),
                    F.concat(state["order"], F.array(s)).alias("order"),
                ),
            )

        total = F.aggregate("s", F.lit(0), lambda t, x: t + x["n"])
        return F.aggregate(F.sequence(F.lit(0), total - 1), start, step, lambda x: x["order"])

    each = rows.select("run", F.posexplode(let(windows, scheduled)).alias("slot", "source"))
    nth = F.row_number().over(Window.partitionBy("run", "source").orderBy("slot")) - 1
    return each.withColumn("nth", nth)


def _name(source: str) -> Column:
    """The source as a text that is never null."""
    c = F.col(source)
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("+"), c.cast("string")))


def ranked(rows: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """Adds ``_s``, the name of the source, and ``_nth``, the row's place in it by hash of ``keys``.

    A source is cut into ranges of the hash that windows count one by one, so that a source
    with most of the rows still fills all tasks. Offsets and rows share one partitioning.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * SPREAD
    high = F.shiftrightunsigned(F.col("_h"), 32)
    hashed = rows.withColumn("_s", _name(source)).withColumn("_h", F.xxhash64(*keys))
    hashed = hashed.withColumn("_part", F.shiftrightunsigned(high * width, 32).cast("int"))
    sizes = hashed.groupBy("_s", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_s", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_s", "_part").orderBy("_h", *keys)
    counted = hashed.withColumn("_i", F.row_number().over(inside) - 1)
    placed = counted.join(offsets, ["_s", "_part"])
    return placed.withColumn("_nth", F.col("_o") + F.col("_i")).drop("_h", "_part", "_o", "_i")


def source_sizes(rows: DataFrame, source: str) -> dict:
    """Rows by source; as many numbers as there are sources to weigh."""
    return {r[0]: r[1] for r in rows.groupBy(source).count().collect()}


def tempered(sizes: Mapping, power: float = 0.7) -> dict:
    """Target weights that lift small sources: sizes to a power."""
    return {k: n**power for k, n in sizes.items()}


def mix(
    rows: DataFrame,
    weights: Mapping | None = None,
    source: str = "source",
    keys: list[str] | None = None,
    block_rows: int = BLOCK_ROWS,
    slots: int = SLOTS,
) -> DataFrame:
    """All columns of ``rows``, and ``position``, ``slot`` and ``block`` of each in the mixture.

    ``weights`` by source; by default :func:`tempered` sizes. ``keys`` order the rows of a
    source, by default ``doc_id``, else all columns.
    """
    spark = rows.sparkSession
    rows = rows.drop("position", "slot", "block")
    keys = keys or (["doc_id"] if "doc_id" in rows.columns else rows.columns)
    columns = {f"in_{c}": c for c in rows.columns}  # no added column begins like this
    rows = rows.withColumnsRenamed({c: i for i, c in columns.items()})
    source, keys = f"in_{source}", [f"in_{c}" for c in keys]
    result = [F.col(i).alias(c) for i, c in columns.items()] + ["position", "slot", "block"]
    sizes = source_sizes(rows, source)
    if not sizes:
        return rows.selectExpr("*", "0L position", "0L slot", "0L block").select(*result)
    weights = weights or tempered(sizes)
    if missing := [k for k in sizes if k not in weights]:
        raise ValueError(f"no weight for sources {sorted(map(str, missing))[:10]}")
    order = sorted(sizes, key=lambda k: (k is None, str(k)))
    names = {k: "-" if k is None else f"+{k}" for k in order}
    blocks = {k: -(-sizes[k] // block_rows) for k in order}
    plan = phases(blocks, whole_shares({k: weights[k] for k in order}, slots))
    members = spark.createDataFrame(
        [
            (i, j, names[k], p["first"][k], p["first"][k] + n * p["times"], n, sum(p["per"].values()), p["slot"])
            for i, p in enumerate(plan)
            for j, (k, n) in enumerate(p["per"].items())
        ],
        "run int, member int, _s string, _from long, _to long, _a long, _q long, _slot long",
    )
    runs = [(list(p["shares"].values()), list(p["per"].values())) for p in plan]
    cells = written(period(spark, runs), "mixing-period")
    cells = cells.withColumnsRenamed({"source": "member", "slot": "_in_period"})

    def scheduled(blocked: DataFrame) -> DataFrame:
        """Adds the slot of each ``_s, block``. Both tables are as small as the list of sources."""
        own = (F.col("block") >= F.col("_from")) & (F.col("block") < F.col("_to"))
        met = blocked.join(F.broadcast(members), "_s").filter(own)
        met = met.withColumn("nth", ((F.col("block") - F.col("_from")) % F.col("_a")).cast("int"))
        met = met.join(F.broadcast(cells), ["run", "member", "nth"])
        whole = F.floor((F.col("block") - F.col("_from")) / F.col("_a"))
        slot = F.col("_slot") + whole * F.col("_q") + F.col("_in_period")
        return met.withColumn("slot", slot).select(*blocked.columns, "slot")

    ends = [(names[k], blocks[k] - 1, blocks[k] * block_rows - sizes[k]) for k in order]
    ends = scheduled(spark.createDataFrame(ends, "_s string, block long, _short long"))
    short = [(r["slot"], r["_short"]) for r in ends.filter("_short > 0").collect()]
    blocked = ranked(rows, source, keys).withColumn("block", F.floor(F.col("_nth") / block_rows))
    found = scheduled(blocked)
    gaps = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(n).alias("n")) for s, n in short])
    missing = F.lit(0).cast("long")
    if short:
        missing = F.aggregate(
            gaps, F.lit(0).cast("long"), lambda t, g: t + F.when(g["slot"] < F.col("slot"), g["n"]).otherwise(0)
        )
    position = F.col("slot") * block_rows + F.col("_nth") % block_rows - missing
    return found.withColumn("position", position).select(*result)
