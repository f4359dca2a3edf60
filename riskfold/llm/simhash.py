"""SimHash near-duplicates: majority bits of shingle hashes, linked through BK-trees.

Two fingerprints that differ in at most ``radius`` bits agree on one of ``radius + 1``
parts of their bits. Each distinct fingerprint goes to the shard of each of its parts, and
a shard's fingerprints meet in one BK-tree. A shard above ``shard_size`` is split again by
the bits on which its members may still differ, until it is small or no bit is left, so
that no tree is large, no pair is lost and no shard is compared with all others. Trees meet
their queries in the shuffle: a broadcast would have no bound. A shard hands on a spanning
tree of its links, so groups of copies never turn into pairs.

A null text counts as empty. Texts without words have fingerprint zero and are linked like
any other. Equal rows stay, each with its own result. A group without any id has a null
component. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_digest

from riskfold.functions.scaling import written
from riskfold.llm.tables import join_counted

BITS = 64
SEED = 42
SHARD_SIZE = 1024
STEP = 1 << 16  # shingles whose bits are unpacked at a time


def fingerprint_text(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint: a bit is set where over half of the shingles' hashes have it."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [words]
    else:
        shingles = zip(*(words[i:] for i in range(shingle)), strict=False)
    digests = b"".join(map(xxh64_digest, map(b" ".join, shingles), repeat(SEED)))
    raw = np.frombuffer(digests, np.uint8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 8 * STEP):
        bits = np.unpackbits(raw[at : at + 8 * STEP]).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw) // 8).tobytes(), "big")


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Fingerprint as a long with the same 64 bits."""

    @F.arrow_udf(T.LongType())
    def of(texts: pa.Array) -> pa.Array:
        found = (fingerprint_text(t.as_py(), shingle) for t in texts)
        return pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64))

    # Else a filter on the result would be pushed below it and hash again.
    return of.asNondeterministic()(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


class BKTree:
    """Integers by Hamming distance: a child hangs on its parent by their distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Positions at most ``radius`` bits away; only edges that can lead there are followed."""
        pending = [0] if self.values else []
        while pending:
            at = pending.pop()
            far = (self.values[at] ^ value).bit_count()
            if far <= radius:
                yield at
            below = self.children[at]
            pending += [below[d] for d in range(far - radius, far + radius + 1) if d in below]

    def add(self, value: int) -> None:
        at = 0 if self.values else None
        while at is not None:
            far = (self.values[at] ^ value).bit_count()
            parent, at = at, self.children[at].get(far)
            if at is None:
                self.children[parent][far] = len(self.values)
        self.values.append(value)
        self.children.append({})


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, root) of all values linked to a smaller one, roots by union-find over BK-tree hits."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
        tree.add(value)
    return [(v, values[r]) for i, v in enumerate(values) if (r := root(i)) != i]


def _parts(free: int, n: int) -> list[int]:
    """The set bits of ``free`` as ``n`` masks of nearly equal size."""
    places = [i for i in range(BITS) if free >> i & 1]
    cuts = [len(places) * k // n for k in range(n + 1)]
    return [sum(1 << i for i in places[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _link_shards(radius: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard; the last shard of a batch may go on in the next."""
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            mask, key = rows["mask"].to_numpy(), rows["key"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            held = rows.iloc[starts[-1] :] if len(rows) else None
            yield found(rows["fp"].to_numpy(), starts)
        if held is not None:
            yield found(held["fp"].to_numpy(), np.array([0, len(held)]))

    def found(fps: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for k in np.flatnonzero(np.diff(starts) > 1):
            out += spanning_links(fps[starts[k] : starts[k + 1]].view(np.uint64).tolist(), radius)
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return links


def links(fps: DataFrame, radius: int = 2, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Links ``(u, v)`` among distinct fingerprints ``fp`` that span each group of near ones."""
    spark, n = fps.sparkSession, radius + 1
    masks = _parts((1 << BITS) - 1, n)
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    done = []
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = written(rows.groupBy("mask", "key").count(), "shards")
        wide = [_signed(m) for m in masks if BITS - m.bit_count() >= n]  # others: few values
        hot = sizes.filter(F.col("mask").isin(wide) & (F.col("count") > shard_size)).drop("count")
        if hot.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(hot, ["mask", "key"], "left_anti"))
        finer = {
            m: [m | p for p in _parts(~m & ((1 << BITS) - 1), n)] for m in masks if _signed(m) in wide
        }
        masks = sorted({x for xs in finer.values() for x in xs})
        table = F.create_map(
            *[
                x
                for m, xs in finer.items()
                for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in xs]))
            ]
        )
        rows = written(
            rows.join(hot, ["mask", "key"], "left_semi").select(
                "fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask")
            ),
            "hot-shards",
        )
    shards = done[0]
    for more in done[1:]:
        shards = shards.unionByName(more)
    met = shards.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    found = met.select("mask", "key", "fp").mapInPandas(_link_shards(radius), "u long, v long")
    return written(found.distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges (u, v)``; ``root`` is the component's smallest node.

    Alternates large-star and small-star steps; each round is written, so a lost executor
    costs one round. Neighbour minima combine before the shuffle.
    """

    def star(both: DataFrame, keep: Column) -> DataFrame:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))

    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, F.col("v") > F.col("u")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        both = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(both.filter("u != v"), "stars")
        before, state = state, edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def groups(fps: DataFrame, best: Column, radius: int, shard_size: int) -> DataFrame:
    """Per distinct ``fp`` of the written table ``fps``: its rows ``n`` and its group's least ``best``."""
    each = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best"))
    each = written(each, "fingerprints")
    of = written(components(links(each.select("fp"), radius, shard_size)), "components")
    linked = each.join(of.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("best").alias("least"))
    least = of.join(least, "root").select(F.col("node").alias("fp"), "least")
    known = each.join(least, "fp", "left")
    return written(
        known.select("fp", "n", F.coalesce("least", "best").alias("best")), "fingerprint-groups"
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 2,
    shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """``doc_id, fingerprint`` (hex) and ``component_id``, the smallest id reachable over links."""
    fps = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp"))
    fps = written(fps, "document-fingerprints")
    found = groups(fps, F.col("doc_id"), radius, shard_size)
    return join_counted(fps, found, "fp", "n").select(
        "doc_id", as_hex(F.col("fp")).alias("fingerprint"), F.col("best").alias("component_id")
    )


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 2,
    shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """One row of each group of near-duplicates, all columns: the row with the smallest id.

    A row without id stands for its group only if no member has one; of repeated rows one stays.
    """
    columns = {f"in_{c}": c for c in docs.columns}  # no added column begins like this
    docs = docs.withColumnsRenamed({c: i for i, c in columns.items()})
    id_col, text_col = f"in_{id_col}", f"in_{text_col}"
    marked = docs.withColumn("_fp", fingerprint(F.col(text_col), shingle))
    fps = written(marked.select(F.col(id_col).alias("_id"), F.col("_fp").alias("fp")), "document-fingerprints")
    best = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("fp").alias("fp"))
    keep = groups(fps, best, radius, shard_size).select("best.id", "best.fp").distinct()
    keep = keep.select(F.col("id").alias("_keep_id"), F.col("fp").alias("_fp"))
    same = marked[id_col].eqNullSafe(keep["_keep_id"]) & (marked["_fp"] == keep["_fp"])
    kept = marked.join(keep.hint("shuffle_hash"), same, "left_semi")
    kept = kept.dropDuplicates([id_col, "_fp"])
    return kept.select(*[F.col(i).alias(c) for i, c in columns.items()])
