"""Embedding near-duplicates: an inverted multi-index, walked cell by cell, then exact cosines.

A codebook for each half of the unit vectors makes a grid of cells: the pair of nearest
codewords. Every vector is filed in its own cell and visits further cells in the order of
their distance, which the multi-sequence walk over the two sorted codeword lists yields one
by one. It stops ``slack`` above the nearest cell. The slack is the distance within which a
sampled vector reaches the stated share (``recall``) of neighbours at exactly the linking
cosine, in random directions; closer neighbours are found more often. Of two cells only the
lower one's vectors visit the higher, so a pair is met once. What meets is verified by its
cosine in double precision.

Codebooks are fitted on at most ``SAMPLE_PER_CODEWORD`` distinct vectors a codeword, picked by
hash, and their number grows with the square root of the rows a label has, up to
``max_codewords``, so that a cell holds about ``cell_rows``. Vectors of one cell and label
meet in chunks of at most about ``CHUNK``: a crowded cell becomes many tasks. Equal vectors of
a label are one vector with a count, and a chunk hands on counts and a spanning forest of
its links, never the pairs.

A row links with nothing where its label or vector is null, or its vector is empty, zero or has
null or non-finite components; vectors of different length don't link. Equal rows, and rows with
equal ids, stay, each with its own result, and count as each other's links. A group without
any id has a null component; a row is kept where its id is the component's. Extra columns are
not read. An empty table gives an empty result. Vectors are held whole, texts aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.functions.scaling import written
from riskfold.llm.simhash import components
from riskfold.llm.tables import join_counted

COSINE = 0.93
RECALL = 0.999
CELL_ROWS = 256
MAX_CODEWORDS = 1024
SAMPLE_PER_CODEWORD = 64
LEAST_SAMPLE = 4096
STEPS = 12
CHUNK = 2048
SLICE = 512


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def squared_distances(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    far = (rows**2).sum(1)[:, None] + (words**2).sum(1) - 2 * rows @ words.T
    return np.maximum(far, 0)


def codebook(rows: np.ndarray, size: int, rng: np.random.Generator, steps: int = STEPS) -> np.ndarray:
    """Means of ``size`` clusters of ``rows`` (Lloyd's steps from a random start)."""
    words = rows[rng.permutation(len(rows))[:size]].copy()
    for _ in range(steps):
        own = squared_distances(rows, words).argmin(1)
        sums, n = np.zeros_like(words), np.bincount(own, minlength=len(words))
        np.add.at(sums, own, rows)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


@dataclass(frozen=True)
class MultiIndex:
    """Codewords of the first and second half of vectors of length ``dim``."""

    dim: int
    first: np.ndarray
    second: np.ndarray
    slack: float

    def fitted(self, units: np.ndarray) -> np.ndarray:
        """Rows as long as the codebooks: zeros added, or the end left out of the walk."""
        short = self.dim - units.shape[1]
        return np.pad(units, ((0, 0), (0, short))) if short > 0 else units[:, : self.dim]

    def halves(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units, cut = self.fitted(units), self.first.shape[1]
        return squared_distances(units[:, :cut], self.first), squared_distances(units[:, cut:], self.second)

    def cells(self, units: np.ndarray) -> np.ndarray:
        a, b = self.halves(units)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def visits(self, units: np.ndarray) -> Iterator[list[int]]:
        """Cells of each row, nearest first, as far as the slack goes."""
        a, b = self.halves(units)
        by_a, by_b = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        a, b = np.take_along_axis(a, by_a, 1), np.take_along_axis(b, by_b, 1)
        for row in range(len(units)):
            walk = multi_sequence(a[row].tolist(), b[row].tolist(), self.slack)
            yield [int(by_a[row, i]) * len(self.second) + int(by_b[row, j]) for i, j in walk]


def multi_sequence(a: list[float], b: list[float], slack: float) -> Iterator[tuple[int, int]]:
    """Pairs of places of two sorted lists by growing sum, while it is within ``slack`` of the least.

    A pair enters the queue once both pairs just before it have left.
    """
    queue, done = [(a[0] + b[0], 0, 0)], set()
    most = a[0] + b[0] + slack
    while queue:
        far, i, j = heapq.heappop(queue)
        if far > most:
            return
        yield i, j
        done.add((i, j))
        if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in done):
            heapq.heappush(queue, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in done):
            heapq.heappush(queue, (a[i] + b[j + 1], i, j + 1))


def neighbours_at(units: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each row one at exactly this cosine, in a random direction."""
    side = rng.standard_normal(units.shape)
    side -= (side * units).sum(1, keepdims=True) * units
    long = np.linalg.norm(side, axis=1, keepdims=True)
    side = np.divide(side, long, out=np.zeros_like(side), where=long > 0)
    return cosine * units + np.sqrt(max(0.0, 1 - cosine**2)) * side


def fit(units: np.ndarray, size: int, cosine: float = COSINE, recall: float = RECALL) -> MultiIndex:
    """Codebooks of at most ``size`` words, and the slack that reaches ``recall``.

    ``recall`` 1 walks every cell.
    """
    rng, cut = np.random.default_rng(7), max(1, units.shape[1] // 2)
    first = codebook(units[:, :cut], size, rng)
    second = codebook(units[:, cut:], size, rng)
    index = MultiIndex(units.shape[1], first, second, np.inf)
    if recall >= 1:
        return index
    asked = units[rng.permutation(len(units))[:LEAST_SAMPLE]]
    asked = np.repeat(asked, max(1, LEAST_SAMPLE // len(asked)), axis=0)
    a, b = index.halves(asked)
    there = index.cells(neighbours_at(asked, cosine, rng))
    row = np.arange(len(asked))
    over = a[row, there // len(second)] + b[row, there % len(second)] - a.min(1) - b.min(1)
    return MultiIndex(units.shape[1], first, second, float(np.quantile(over, recall)))


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit rows of the lists of each length."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, unit_rows(flat.astype(np.float64).reshape(len(at), dim))


def _filed(index: MultiIndex):
    """Each vector at its own cell (``own``) and at the higher cells that it visits."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows, cells, own = [], [], []
                for at, units in matrices(part.column("embedding")):
                    for row, home, seen in zip(at, index.cells(units).tolist(), index.visits(units)):
                        more = [c for c in seen if c > home]
                        rows += [row] * (1 + len(more))
                        cells += [home, *more]
                        own += [True] + [False] * len(more)
                taken = part.take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cells, pa.int32()), pa.array(own, pa.bool_())],
                    [*part.schema.names, "cell", "own"],
                )

    return file


def spanning_forest(match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of edges that connect what ``match`` connects, without cycles."""
    new_row, new_col = match.any(1), match.any(0)
    us, vs = [], []
    for root in np.flatnonzero(new_row):
        if not new_row[root]:
            continue
        front = np.array([root])
        new_row[root] = False
        while len(front):
            hit = match[front] & new_col
            cols = np.flatnonzero(hit.any(0))
            us.append(front[hit[:, cols].argmax(0)])
            vs.append(cols)
            new_col[cols] = False
            hit = match[:, cols] & new_row[:, None]
            front = np.flatnonzero(hit.any(1))
            us.append(front)
            vs.append(cols[hit[front].argmax(1)] if len(front) else front)
            new_row[front] = False
    none = np.zeros(0, int)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _linked(cosine: float):
    """Rows ``u, null, links`` with counts and ``u, v, 0`` with spanning links, chunk by chunk.

    Rows come sorted by chunk, in each those filed there first.
    """

    def met(a, b, same: bool):
        (ids, n, x), (others, m, y) = a, b
        match = x @ y.T >= cosine
        if same:
            np.fill_diagonal(match, False)
        if not match.any():
            return
        u, v = spanning_forest(match)
        yield ids[u], others[v], np.zeros(len(u), np.int64)
        some = match.any(1)
        yield ids[some], None, (match[some] * m).sum(1)
        if not same:
            some = match.any(0)
            yield others[some], None, (match[:, some] * n[:, None]).sum(0)

    def rows_of(part: pa.RecordBatch):
        ((_, units),) = matrices(part.column("embedding"))
        return part.column("gid").to_numpy(), part.column("n").to_numpy(), units

    def met_in_slices(asked, filed, same: bool):
        for at in range(0, len(asked[0]), SLICE):
            piece = tuple(x[at : at + SLICE] for x in asked)
            if same:  # the slice with itself, then with what follows
                yield from met(piece, piece, True)
                rest = tuple(x[at + SLICE :] for x in filed)
                if len(rest[0]):
                    yield from met(piece, rest, False)
            else:
                yield from met(piece, filed, False)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, filed = None, [], None

        def closed():
            """The chunk's own rows are complete."""
            nonlocal filed, parts
            if filed is None and parts:
                filed = tuple(np.concatenate(x) for x in zip(*parts))
                parts = []
                yield from met_in_slices(filed, filed, True)

        def found(batch):
            nonlocal key, parts, filed
            chunk, own = batch.column("chunk_key").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (own[1:] != own[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(chunk)]):
                if chunk[a] != key:
                    yield from closed()
                    key, parts, filed = chunk[a], [], None
                rows = rows_of(batch.slice(a, b - a))
                if own[a]:
                    parts.append(rows)
                else:
                    yield from closed()
                    if filed is not None:
                        yield from met_in_slices(rows, filed, False)

        def out(found):
            for u, v, links in found:
                v = pa.nulls(len(u), pa.int64()) if v is None else pa.array(v, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u, pa.int64()), v, pa.array(links, pa.int64())], ["u", "v", "links"]
                )

        for batch in batches:
            if batch.num_rows:
                yield from out(found(batch))
        yield from out(closed())

    return link


def comparable(label: Column, vector: Column) -> Column:
    """Whether a row can link at all."""
    x = F.filter(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(
        label.isNotNull() & (F.size(x) == 0) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def index_of(
    vectors: DataFrame, cosine: float, recall: float, cell_rows: int, max_codewords: int
) -> MultiIndex | None:
    """Fitted on a bounded sample of the written table ``vectors``; None where it is empty."""
    sizes = vectors.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total, typical = sizes.agg(F.sum("n"), F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()
    if not total:
        return None
    size = int(min(max_codewords, max(1, np.ceil(np.sqrt(typical / cell_rows)))))
    most = max(LEAST_SAMPLE, SAMPLE_PER_CODEWORD * size)
    hashed = vectors.select("embedding", F.xxhash64("label", "embedding").alias("h"))
    share = min(1.0, 1.2 * most / total)
    picked = hashed.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = sorted(picked.limit(most).collect(), key=lambda r: r.h)
    if not rows:  # a few rows, none of them picked
        rows = hashed.limit(most).collect()
    dim = max(len(r.embedding) for r in rows)
    sample = np.zeros((len(rows), dim))
    for at, r in enumerate(rows):
        sample[at, : len(r.embedding)] = r.embedding
    return fit(unit_rows(sample), size, cosine, recall)


def links(
    vectors: DataFrame,
    cosine: float = COSINE,
    recall: float = RECALL,
    cell_rows: int = CELL_ROWS,
    max_codewords: int = MAX_CODEWORDS,
    chunk: int = CHUNK,
) -> DataFrame:
    """``u, v, links`` of the written table ``vectors (gid, label, embedding, n)`` of distinct ones.

    With ``v`` null, ``links`` adds to the rows linked with ``u``; else ``u`` and ``v`` are linked,
    and such links span each group.
    """
    schema = "u long, v long, links long"
    index = index_of(vectors, cosine, recall, cell_rows, max_codewords)
    if index is None:
        return vectors.sparkSession.createDataFrame([], schema)
    vectors = vectors.select("gid", "n", "label", "embedding")
    more = [T.StructField("cell", T.IntegerType()), T.StructField("own", T.BooleanType())]
    filed = T.StructType([*vectors.schema.fields, *more])
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # two codebooks, bounded above

    def file(batches):
        return _filed(shared.value)(batches)

    visits = vectors.mapInArrow(file, filed)
    place = ["label", "dim", "cell"]
    visits = written(visits.withColumn("dim", F.size("embedding")), "cell-visits")
    sizes = visits.filter("own").groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    at = visits.join(sizes, place)
    home = F.when(F.col("own"), F.pmod(F.xxhash64("gid"), F.col("chunks")))
    at = at.withColumn("home", home).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("home", F.col("chunks") - 1)))
    )
    at = at.withColumn("own", F.coalesce(F.col("home") == F.col("chunk"), F.lit(False)))
    dealt = at.repartition(*place, "chunk").sortWithinPartitions(*place, "chunk", F.desc("own"))
    rows = dealt.select("gid", "n", "embedding", "own", F.xxhash64(*place, "chunk").alias("chunk_key"))
    return written(rows.mapInArrow(_linked(cosine), schema), "vector-links")


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    recall: float = RECALL,
    cell_rows: int = CELL_ROWS,
    max_codewords: int = MAX_CODEWORDS,
    chunk: int = CHUNK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row; links as found by ``links``."""
    kind = df.schema[vec_col].dataType.elementType
    vector = F.col(vec_col) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(vec_col).cast("array<double>")
    rows = df.select(
        F.col(id_col).alias("vec_id"),
        F.when(
            comparable(F.col(label_col), vector),
            F.struct(F.col(label_col).alias("label"), vector.alias("embedding")),
        ).alias("key"),
    )
    each = rows.filter("key is not null").groupBy("key")
    each = each.agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    each = each.select(F.monotonically_increasing_id().alias("gid"), "key.*", "n", "least")
    each = written(each, "vectors")
    found = links(each, cosine, recall, cell_rows, max_codewords, chunk)
    of = written(components(found.filter("v is not null").select("u", "v")), "components")
    counts = found.groupBy(F.col("u").alias("gid")).agg(F.sum("links").alias("links"))
    linked = each.select("gid", "least").join(of.withColumnRenamed("node", "gid"), "gid")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    least = of.join(least, "root").select(F.col("node").alias("gid"), "component_id")
    known = each.join(counts, "gid", "left").join(least, "gid", "left")
    known = known.select(
        F.struct("label", "embedding").alias("key"),
        "n",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    known = written(known, "vector-groups")
    single = rows.filter("key is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    grouped = join_counted(rows.filter("key is not null"), known, "key", "n")
    out = grouped.select("vec_id", "n_links", "component_id").unionByName(single)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
