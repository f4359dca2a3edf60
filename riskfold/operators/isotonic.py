"""Monotone maps of scores: parallel pool-adjacent-violators, and a range join that applies them.

Fitting pools equal scores map-side, deals the distinct ones out by range and pools violators
inside each range. What is left are blocks whose means grow within a range; where the last block of
one range lies above the first of the next, a further round deals the blocks out by other
ranges. Pooling in any order ends in the same blocks, so the number and the bounds of ranges
matter to speed only. No task sees more than a range, and the driver sees counts.

A fitted map is a table of knots. It is applied by a join on the bucket of the score: a row of
the lookup table holds the few knots of its bucket and the nearest one on either side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.functions.scaling import with_bucket, written

BLOCKS_PER_TASK = 1 << 18
KNOTS_PER_BUCKET = 8
MAX_BUCKETS = 4096
BLOCK = "lo double, hi double, pos bigint, n bigint"


def pool_violators(blocks: Iterator[tuple]) -> Iterator[list]:
    """Merge ``(key, lo, hi, pos, n)`` with growing ``lo`` until means of a key strictly grow.

    A block's mean is ``pos / n``; neighbours with equal means are merged too, and means are
    compared by whole numbers.
    """
    stack: list[list] = []
    for key, lo, hi, pos, n in blocks:
        if stack and stack[-1][0] != key:
            yield from stack
            stack = []
        top = [key, lo, hi, pos, n]
        while stack and stack[-1][3] * top[4] >= top[3] * stack[-1][4]:
            left = stack.pop()
            top = [key, left[1], top[2], left[3] + top[3], left[4] + top[4]]
        stack.append(top)
    yield from stack


def _pooled(schema: pa.Schema, width: int):
    """Pool violators inside a task; ``width`` columns name the map a row belongs to."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def rows():
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                keys = zip(*columns[:width]) if width else ((),) * batch.num_rows
                yield from zip(keys, *columns[width:])

        out: list[tuple] = []

        def packed():
            columns = list(zip(*out)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

        for key, lo, hi, pos, n in pool_violators(rows()):
            out.append((*key, lo, hi, pos, n, task))
            if len(out) == 1 << 16:
                yield packed()
                out = []
        yield packed()

    return pool


def isotonic_blocks(
    scores: DataFrame, by: Sequence[str] = (), score: str = "p", per_task: int = BLOCKS_PER_TASK
) -> DataFrame:
    """``by..., lo, hi, pos, n`` of the blocks of equal fitted value, for each group of ``by``.

    The value ``pos / n`` grows strictly from block to block. Rows without a score or label don't
    count; a group without rows has no block.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    by, spark = list(by), scores.sparkSession
    rows = scores.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col("y_true").isNotNull())
    x, y = F.col(score).cast("double"), F.col("y_true").cast("bigint")
    blocks = rows.groupBy(*by, x.alias("lo")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.select(*by, "lo", F.col("lo").alias("hi"), "pos", "n")
    schema = T.StructType([*blocks.schema.fields, T.StructField("task", T.IntegerType())])
    pool = _pooled(to_arrow_schema(schema), len(by))
    tasks, odd = int(spark.conf.get("spark.sql.shuffle.partitions")), 0
    while True:
        dealt = blocks.repartition(1) if tasks == 1 else blocks.repartitionByRange(tasks + odd, *by, "lo")
        found = dealt.sortWithinPartitions(*by, "lo").mapInArrow(pool, schema)
        found = written(found, "isotonic-blocks")
        blocks = found.drop("task")
        if tasks == 1:
            return blocks
        # One row per task and group: the means at the ends of its range.
        mean = F.col("pos") / F.col("n")
        ends = found.groupBy(*by, "task").agg(
            F.min("lo").alias("lo"),
            F.min_by(mean, "lo").alias("first"),
            F.max_by(mean, "lo").alias("last"),
            F.count(F.lit(1)).alias("blocks"),
        )
        before = F.lag("last").over(Window.partitionBy(*by).orderBy("lo"))
        off = ends.withColumn("before", before).agg(
            F.count_if(F.col("before") >= F.col("first")).alias("off"), F.sum("blocks").alias("blocks")
        )
        seams, left = off.first()
        if not seams:
            return blocks
        tasks, odd = max(1, min(tasks, -(-left // per_task))), 1 - odd


def isotonic_knots(
    scores: DataFrame, by: Sequence[str] = (), score: str = "p", per_task: int = BLOCKS_PER_TASK
) -> DataFrame:
    """Knots ``by..., x, y`` of each group's map: both ends of every block."""
    blocks = isotonic_blocks(scores, by, score, per_task)
    y = F.col("pos") / F.col("n")
    # A block of one score has one knot.
    ends = F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))
    return blocks.select(*by, F.explode(ends).alias("x"), y.alias("y"))


def _bucketed(df: DataFrame, edges: Sequence[float], score: str) -> DataFrame:
    if not edges:
        return df.withColumn("bucket", F.lit(0))
    return with_bucket(df, edges, score).withColumn("bucket", F.col("bucket").cast("int"))


def _at_most(knots: Column, p: Column) -> Column:
    return F.size(F.filter(knots, lambda k: k.x <= p))


def knot_lookup(knots: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, list[float]]:
    """One row per group and score bucket with its knots in order, and the edges of buckets.

    Edges follow the knots, so a bucket holds few of them. Buckets without knots are there too:
    each row begins with the last knot before its bucket and ends with the first one behind.
    """
    by, spark = list(by), knots.sparkSession
    n = knots.count()
    buckets = min(MAX_BUCKETS, max(1, n // KNOTS_PER_BUCKET))
    edges: list[float] = []
    if buckets > 1:
        sketch = F.percentile_approx("x", [i / buckets for i in range(1, buckets)], 20 * buckets)
        edges = sorted(set(knots.agg(sketch).first()[0] or []))
    held = _bucketed(knots, edges, "x").groupBy(*by, "bucket").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("own"))
    groups = knots.select(*by).distinct() if by else spark.range(1).select()
    grid = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(len(edges)))))
    rows = grid.join(held, [*by, "bucket"], "left")
    # At most MAX_BUCKETS rows a group.
    order = Window.partitionBy(*by).orderBy("bucket")
    before = F.last(F.element_at("own", -1), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first(F.element_at("own", 1), True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.select(*by, "bucket", "own", before.alias("before"), behind.alias("behind"))
    none = F.array().cast(held.schema["own"].dataType)
    parts = [F.when(F.col(c).isNotNull(), F.array(c)).otherwise(none) for c in ("before", "behind")]
    around = F.concat(parts[0], F.coalesce("own", none), parts[1])
    return rows.select(*by, "bucket", around.alias("knots")), edges


def apply_knots(
    df: DataFrame, knots: DataFrame, by: Sequence[str] = (), score: str = "p", name: str = "p_cal"
) -> DataFrame:
    """``df`` with the value of its group's map at ``score``: linear between knots, flat outside.

    Null without a score, a number or a map. The plan does not grow with the knots.
    """
    lookup, edges = knot_lookup(knots, by)
    lookup = written(lookup, "isotonic-lookup")  # so that its size is known to the join
    columns = df.columns
    own = {c: f"in_{c}" for c in columns}  # no added column begins like this
    marked = df.withColumnsRenamed(own).withColumn("_p", F.col(own[score]).cast("double"))
    marked = _bucketed(marked, edges, "_p").withColumnsRenamed({"bucket": "_bucket"})
    by = [own[c] for c in by]
    lookup = lookup.withColumnsRenamed({**own, "bucket": "_bucket", "knots": "_knots"})
    at = marked.join(lookup, [*by, "_bucket"], "left")
    p, ks, low, high = F.col("_p"), F.col("_knots"), F.col("_low"), F.col("_high")
    at = at.withColumn("_place", _at_most(ks, p))  # searched once, used twice
    at = at.withColumns(
        {
            "_low": F.try_element_at(ks, F.greatest("_place", F.lit(1))),
            "_high": F.try_element_at(ks, F.greatest(F.least(F.col("_place") + 1, F.size(ks)), F.lit(1))),
        }
    )
    share = (p - low.x) / (high.x - low.x)
    value = F.when(low.x >= p, low.y).when(high.x <= p, high.y).otherwise(low.y + (high.y - low.y) * share)
    usable = p.isNotNull() & ~F.isnan(p) & (F.size(ks) > 0)
    at = at.withColumn("_value", F.when(usable, value))
    kept = [F.col(i).alias(c) for c, i in own.items() if c != name]
    return at.select(*kept, F.col("_value").alias(name))
