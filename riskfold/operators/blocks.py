"""Packed blocks: thousands of numeric columns of a source as one vector column.

A block keeps the names of its slots in the metadata of its column, which Parquet stores
as well. Joins, folds and fits then move one column, and no plan grows with the slots.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.functions.scalars import col


def is_block(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, VectorUDT)


def pack(df: DataFrame, columns: Sequence[str], name: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` and one vector of ``columns``, in their order, sparse where that is smaller.

    Missing values become NaN, which a fit refuses unless it allows them.
    """
    # Positions as names: a real one may hold the dots and quotes that a name must not.
    short = [f"_{i}" for i in range(len(columns))]
    kept = [col(k) for k in keep]
    flat = df.select(F.struct(*kept).alias("_keep"), *[col(c).cast("double").alias(s) for c, s in zip(columns, short)])
    packed = VectorAssembler(inputCols=short, outputCol="_block", handleInvalid="keep").transform(flat)
    return packed.select("_keep.*", named(F.col("_block"), columns, name))


def pack_array(df: DataFrame, array: str, slots: Sequence[str], name: str, keep: Sequence[str]) -> DataFrame:
    """The same from one array column. Every array must hold a value for each slot; a null is NaN."""
    values = F.transform(col(array), lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    whole = F.when(F.size(col(array)) == len(slots), values).otherwise(
        F.raise_error(F.format_string(f"{array}: %d values for {len(slots)} slots", F.size(col(array))))
    )
    return df.select(*[col(k) for k in keep], named(array_to_vector(whole), slots, name))


def named(block: Column, slots: Sequence[str], name: str) -> Column:
    """The vector under ``name`` with its slot names."""
    if len(set(slots)) < len(slots):
        raise ValueError(f"{name}: slot names repeat")
    listed = [{"idx": i, "name": s} for i, s in enumerate(slots)]
    return block.alias(name, metadata={"ml_attr": {"attrs": {"numeric": listed}, "num_attrs": len(slots)}})


def slot_names(df: DataFrame, name: str) -> list[str]:
    """Names of the slots, in order."""
    groups = df.schema[name].metadata.get("ml_attr", {}).get("attrs", {})
    named = {a["idx"]: a.get("name") for group in groups.values() for a in group}
    if not named or None in named.values():
        raise ValueError(f"{name} is a vector without slot names: pack it first")
    return [named[i] for i in range(len(named))]


def slice_block(df: DataFrame, name: str, slots: Sequence[str], to: str) -> DataFrame:
    """``df`` with one more block of the named slots, in the given order."""
    have = {s: i for i, s in enumerate(slot_names(df, name))}
    missing = [s for s in slots if s not in have]
    if missing:
        raise ValueError(f"{name} lacks slots {missing[:10]}")
    out = VectorSlicer(inputCol=name, outputCol=to, indices=[have[s] for s in slots]).transform(df)
    return out.withColumn(to, named(F.col(to), slots, to))


def unpack(df: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    """``keep, slot, value``: one row per slot."""
    names = F.from_json(F.lit(json.dumps(slot_names(df, name))), "array<string>")
    cells = F.arrays_zip(names.alias("slot"), vector_to_array(col(name)).alias("value"))
    return df.select(*[col(k) for k in keep], F.inline(cells).alias("slot", "value"))


def aligned(df: DataFrame, name: str, slots: Sequence[str]) -> Column:
    """The block with exactly these slots. Slots it lacks are NaN, and so is all of an absent block."""
    have = slot_names(df, name) if is_block(df, name) else []
    if have == list(slots):
        return col(name)
    at = {s: i for i, s in enumerate(have)}
    if have:
        values = vector_to_array(col(name))
        where = F.from_json(F.lit(json.dumps([at.get(s, -1) for s in slots])), "array<int>")
        out = F.transform(where, lambda i: F.when(i < 0, F.lit(float("nan"))).otherwise(F.get(values, i)))
    else:
        out = F.array_repeat(F.lit(float("nan")), len(slots))
    return named(array_to_vector(out), slots, name)
