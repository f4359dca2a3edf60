"""Helpers that keep a plan distributed: score buckets, checked broadcasts, lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
MIN_BUCKETS, MAX_BUCKETS = 64, 4096
EDGE_SAMPLE = 0.01
SMALL_SAMPLE = 1000  # about 100,000 rows: one task sorts them at once
SALTS = 32


def fits_one_task(rows: int) -> bool:
    """Whether so few rows can be sorted at once."""
    return rows * EDGE_SAMPLE < SMALL_SAMPLE


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where that is unset, a folder in the warehouse, which Spark shares as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def written(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts lineage, so that whatever loses an executor re-reads files instead of
    refitting models, and fixes the row order of each partition. With ``by``, each value of
    that column has files of its own, split by size, and a filter on it skips the others'.
    ``options`` are those of the files.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if by:
        df.hint("rebalance", by).write.options(**options).partitionBy(by).parquet(path)
    else:
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> list | None:
    """Rows of ``df`` when it has at most ``limit`` of them, else ``None``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def attach_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    limit: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Inner equi-join of ``big`` with a side that is expected to be small.

    The small side is counted first and broadcast only within ``limit`` rows. Above
    it, each of its rows is copied to ``salts`` sub-keys, and the rows of ``big``
    spread over them by the hash of ``salt_by``, so one hot key still fills many tasks.
    """
    rows = collect_small(small, limit)
    if rows is not None:
        local = big.sparkSession.createDataFrame(rows, small.schema)
        return big.join(F.broadcast(local), list(on))
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), F.lit(salts)).cast("int")
    return big.withColumn("_salt", spread).join(salted, [*on, "_salt"]).drop("_salt")


def score_edges(scores: DataFrame, score: str = "p", buckets: int | None = None) -> list[float]:
    """Interior bucket edges so that no bucket holds much more than its share of rows.

    A sketch of a row sample; at most ``buckets - 1`` numbers come back. Results never
    depend on where the edges fall, only the balance of tasks does. An input with a small
    sample needs no buckets and gets none. A score shared by many rows collapses to one
    row before buckets are used. By default there are as many buckets as shuffle
    partitions.
    """
    if buckets is None:
        width = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(max(width, MIN_BUCKETS), MAX_BUCKETS)
    if buckets < 2:
        return []
    quantiles = [i / buckets for i in range(1, buckets)]
    sketch = F.percentile_approx(F.col(score).cast("double"), quantiles, buckets * 20)
    row = scores.sample(EDGE_SAMPLE, seed=1).agg(F.count(F.lit(1)).alias("n"), sketch.alias("e"))
    n, edges = row.collect()[0]
    if n < SMALL_SAMPLE:
        return []
    inf = float("inf")
    return sorted({e for e in (edges or []) if -inf < e < inf})


def with_bucket(
    df: DataFrame, edges: Sequence[float], score: str = "p", name: str = "bucket"
) -> DataFrame:
    """Number the score interval of each row; higher scores get higher numbers."""
    splits = [-float("inf"), *edges, float("inf")]
    return Bucketizer(
        splits=splits, inputCol=score, outputCol=name, handleInvalid="keep"
    ).transform(df)


