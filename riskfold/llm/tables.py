"""Given tables, and joins on keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas.

    A fold over no elements ends with ``body`` of its start. (Taking the only element of a
    transformed array works as well, but derives the type of the whole tree for every row.)
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def join_counted(
    rows: DataFrame, keyed: DataFrame, key: str, count: str, hot_keys: int = HOT_KEYS
) -> DataFrame:
    """Inner join of ``rows`` with one row per key in ``keyed``, which says how many rows have it.

    At most ``hot_keys`` keys can each hold more than a ``hot_keys``-th of all rows.
    These are broadcast, so a hot key never meets in one task; the others are shuffled.
    Both inputs are read twice and should be written tables.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * hot_keys > total
    hot = F.broadcast(keyed.filter(is_hot).drop(count))
    common = rows.join(hot, key)
    rare = rows.join(hot.select(key), key, "left_anti")
    return common.unionByName(rare.join(keyed.filter(~is_hot).drop(count), key))
