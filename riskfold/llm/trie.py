"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged upwards.

A turn is a record of 24 bytes: the md5 of its role and text and the text's length. A
conversation's path is its records in a row, so a node of the trie is a prefix of paths, and
byte order is depth-first order. Equal paths are one sequence with a count.

Sorted sequences are cut into shards. A shard writes its trie as balanced parentheses, a
preorder walk with one bit a step, over which blocks keep the least and largest excess of opened
over closed ones. ``findclose`` ends each subtree; ranks number its nodes and count its leaf
pairs "()"; differences of cumulative arrays give its members and savings. Nodes on the path
of a shard's first or last sequence may go on in other shards: these two spines, with what
hangs on each of their nodes summed up, are the sequences of the next level, until one shard
holds all. Any other node is final where it is.

Texts of any length count whole, but only their digests travel. A conversation's path is held
as one row, 24 bytes a turn. Null roles and texts are empty; rows without ``conv_id`` belong to no
conversation. Null turns come first; equal turn numbers go by their digest, and repeated rows
are repeated turns. Extra columns are not read. Without conversations there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.functions.scaling import written
from riskfold.llm.tables import join_counted

RECORD = 24  # bytes of a turn: digest, then length of the text
MOST = np.iinfo(np.int64).max
SHARD_SEQUENCES = 1 << 15
SHARD_TURNS = 1 << 19
LEAST_SEQUENCES = 4  # of a shard, however long they are
BLOCK = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()

#: What a spine node takes to the next level, from the rows and subtrees that hang on it.
ADDS = np.dtype(
    [("ends", "<i8"), ("least", "<i8"), ("children", "<i8"), ("leaves", "<i8"), ("saved", "<i8"), ("sha", "S64")]
)


# ---------------------------------------------------------------- parentheses


class Parentheses:
    """A tree as balanced parentheses, with range min-max blocks of excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.opened = np.cumsum(bits, dtype=np.int64)  # rank of "("
        self.pairs = np.cumsum(bits & ~np.append(bits[1:], True), dtype=np.int64)  # rank of "()"
        blocks = max(1, -(-len(bits) // BLOCK))
        padded = np.zeros(blocks * BLOCK, np.int64)
        padded[: len(bits)] = np.where(bits, 1, -1)
        self.excess = np.cumsum(padded).reshape(blocks, BLOCK)
        self.leaves = 1 << (blocks - 1).bit_length()
        self.least = np.full(2 * self.leaves, MOST)
        self.largest = np.full(2 * self.leaves, -MOST)
        self.least[self.leaves : self.leaves + blocks] = self.excess.min(1)
        self.largest[self.leaves : self.leaves + blocks] = self.excess.max(1)
        for k in range(self.leaves - 1, 0, -1):
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])
            self.largest[k] = max(self.largest[2 * k], self.largest[2 * k + 1])

    def _in_block(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Place in each block, behind ``after``, where the excess is ``target``; BLOCK if nowhere."""
        hit = (self.excess[block] == target[:, None]) & (np.arange(BLOCK) > after[:, None])
        return np.where(hit.any(1), hit.argmax(1), BLOCK)

    def _holds(self, node: np.ndarray, target: np.ndarray) -> np.ndarray:
        return (self.least[node] <= target) & (target <= self.largest[node])

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The ")" of each "(" at ``at``: the next place with an excess of one less."""
        out = np.empty(len(at), np.int64)
        for start in range(0, len(at), 1 << 14):
            some = at[start : start + (1 << 14)]
            out[start : start + len(some)] = self._findclose(some)
        return out

    def _findclose(self, at: np.ndarray) -> np.ndarray:
        block, target = at // BLOCK, self.excess[at // BLOCK, at % BLOCK] - 1
        found = self._in_block(block, at % BLOCK, target)
        away = np.flatnonzero(found == BLOCK)
        node, wanted = block[away] + self.leaves, target[away]
        # Up to the first subtree on the right that holds the excess, then down to its first block.
        up = np.ones(len(away), bool)
        while up.any():
            right = (node % 2 == 0) & self._holds(node | 1, wanted) & up
            node = np.where(right, node + 1, np.where(up, node // 2, node))
            up &= ~right
        while (down := node < self.leaves).any():
            left = self._holds(np.where(down, 2 * node, 1), wanted)
            node = np.where(down, 2 * node + ~left, node)
        block[away] = node - self.leaves
        found[away] = self._in_block(block[away], np.full(len(away), -1), wanted)
        return block * BLOCK + found


# ---------------------------------------------------------------- one shard


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns at the start of both paths."""
    most = min(len(a), len(b)) // RECORD
    if a[: most * RECORD] == b[: most * RECORD]:
        return most
    x, y = (np.frombuffer(p, np.uint8, most * RECORD) for p in (a, b))
    return int((x != y).argmax()) // RECORD


def lasts(path: bytes) -> np.ndarray:
    """Length of each turn's text."""
    return np.frombuffer(path, np.dtype([("digest", "V16"), ("size", ">i8")]))["size"].astype(np.int64)


def end_only(turns: int, n: int, least: int, sha: str) -> np.ndarray:
    """Adds of a sequence of conversations: all at its last node."""
    adds = np.zeros(turns + 1, ADDS)
    adds["least"] = MOST
    adds[-1] = (n, least, 0, 0, 0, sha)
    return adds


class Shard:
    """Trie of sorted, distinct paths with what each adds to its nodes, in preorder."""

    def __init__(self, paths: list[bytes], adds: list[np.ndarray]):
        turns = np.array([len(p) // RECORD for p in paths])
        shared = np.array([0, *map(shared_turns, paths, paths[1:])])
        self.paths, self.shared = paths, shared
        closed = np.append(0, turns[:-1]) - shared
        steps = np.empty(2 * len(paths) + 2, np.int64)
        steps[0], steps[-1] = 1, turns[-1] + 1
        steps[1:-1:2], steps[2:-1:2] = closed, turns - shared
        kinds = np.zeros(len(steps), bool)
        kinds[::2] = True
        kinds[-1] = False
        self.tree = Parentheses(np.repeat(kinds, steps))
        self.open = np.flatnonzero(self.tree.bits)
        self.close = self.tree.findclose(self.open)
        self.size = (self.close - self.open + 1) // 2
        n = len(self.open)
        self.depth = self.tree.excess.ravel()[self.open] - 1
        # The parent is the last node before with one turn less.
        order = np.lexsort((np.arange(n), self.depth))
        keys = self.depth[order] * n + order
        self.parent = order[np.searchsorted(keys, (self.depth - 1) * n + np.arange(n), "right") - 1]
        self.parent[0] = -1
        self.text = np.zeros(n, np.int64)
        self.adds = np.zeros(n, ADDS)
        self.adds["least"] = MOST
        first = 1 + np.append(0, np.cumsum(turns - shared)[:-1])  # new node of each path
        nodes = np.zeros(1, np.int64)
        for i, path in enumerate(paths):
            fresh = np.arange(first[i], first[i] + turns[i] - shared[i])
            nodes = np.concatenate([nodes[: shared[i] + 1], fresh])
            self.text[fresh] = lasts(path[shared[i] * RECORD :])
            self._add(nodes, adds[i])
            if i in (0, len(paths) - 1):
                self.first, self.last = (nodes, nodes) if i == 0 else (self.first, nodes)

    def _add(self, nodes: np.ndarray, adds: np.ndarray) -> None:
        """``adds`` of the last nodes of a path; those of nodes before are left out if they add nothing."""
        nodes, own = nodes[-len(adds) :], self.adds
        for field in ("ends", "children", "leaves", "saved"):
            own[field][nodes] += adds[field]
        own["least"][nodes] = np.minimum(own["least"][nodes], adds["least"])
        named = adds["sha"] != b""
        own["sha"][nodes[named]] = adds["sha"][named]

    def subtree(self, values: np.ndarray) -> np.ndarray:
        """Sum over each node's subtree: its nodes are consecutive in preorder."""
        total = np.append(0, np.cumsum(values))
        rank = self.tree.opened[self.open] - 1
        return total[rank + self.size] - total[rank]

    def least(self) -> np.ndarray:
        """Smallest member of each subtree, from the deepest turns upwards."""
        out, order = self.adds["least"].copy(), np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, self.depth.max() + 2))
        for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
            np.minimum.at(out, self.parent[order[a:b]], out[order[a:b]])
        return out

    def spine(self) -> np.ndarray:
        on = np.zeros(len(self.open), bool)
        on[self.first] = on[self.last] = True
        return on

    def digests(self, nodes: np.ndarray) -> dict[int, bytes]:
        """A name of each of ``nodes`` that is the same in all shards; they include their parents."""
        path_of = np.repeat(np.arange(len(self.paths)), np.diff(np.append(self._starts(), len(self.open))))
        out = {0: bytes(16)}
        for v in nodes.tolist():
            if v:
                d = int(self.depth[v])
                record = self.paths[path_of[v]][(d - 1) * RECORD : d * RECORD]
                out[v] = hashlib.blake2b(out[int(self.parent[v])] + record, digest_size=16).digest()
        return out

    def _starts(self) -> np.ndarray:
        """First new node of each path; the root counts to the first."""
        turns = np.array([len(p) // RECORD for p in self.paths])
        return np.append(0, 1 + np.cumsum(turns - self.shared)[:-1])

    def solve(self, last: bool) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Figures of all nodes, which of them are final, and the adds of the others."""
        adds, on = self.adds, self.spine() & (not last)
        members, least = self.subtree(adds["ends"]), self.least()
        below = np.bincount(self.parent[1:], minlength=len(self.open))
        children = below + adds["children"]
        # Leaf pairs of the shard, but for nodes with children elsewhere or still to come.
        alone = self.tree.bits & ~np.append(self.tree.bits[1:], True)
        pair = alone[self.open]
        pairs = self.tree.pairs[self.close] - self.tree.pairs[self.open] + pair
        leaves = pairs + self.subtree(adds["leaves"] - (pair & (on | (adds["children"] > 0))))
        own = np.where(on, 0, (members - 1) * self.text)
        saved = self.subtree(own + adds["saved"])
        figures = {"n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved}
        figures |= {"conv_id": least, "sha": adds["sha"]}
        hang = np.zeros(len(self.open), ADDS)
        hang["least"], hang["sha"] = least, adds["sha"]
        inner = np.flatnonzero(on)[1:]  # spine nodes but the root
        for field, total in (("ends", members), ("leaves", leaves), ("saved", saved)):
            hang[field] = total
            np.subtract.at(hang[field], self.parent[inner], total[inner])
        hang["children"] = children
        np.subtract.at(hang["children"], self.parent[inner], 1)
        return figures, ~on, hang

    def spines(self, hang: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """First and last path with the adds of their nodes; a node of both comes with the first."""
        yield self.paths[0], hang[self.first].tobytes()
        if len(self.paths) > 1:
            both = shared_turns(self.paths[0], self.paths[-1])
            rest = hang[self.last[both + 1 :]]
            yield self.paths[-1], rest.tobytes()


NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, node binary, parent binary, path binary, adds binary"
)
LONGS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def encoded(paths: list[bytes], adds: list[np.ndarray], level: int, last: bool) -> pa.RecordBatch:
    """A shard's final nodes, then its spines; other columns are null.

    ``node`` names a node that was on a spine, ``parent`` one that still is.
    """
    shard = Shard(paths, adds)
    figures, final, hang = shard.solve(last)
    at = np.flatnonzero(final)
    if level:
        names = shard.digests(np.arange(len(final)))
    else:
        names = shard.digests(np.flatnonzero(~final))
    up = shard.parent[at]
    known = (up >= 0) & final[up]
    spines = [] if last else list(shard.spines(hang))

    def long(values, null=None):
        mask = np.zeros(len(at), bool) if null is None else null
        return pa.concat_arrays([pa.array(values, pa.int64(), mask=mask), pa.nulls(len(spines), pa.int64())])

    def binary(values, more):
        return pa.array([*values, *more], pa.binary())

    none = [None] * len(spines)
    conv_id = figures["conv_id"]
    columns = [long(conv_id[at]), long(shard.depth[at]), long(conv_id[up], ~known)]
    columns += [long(figures[c][at]) for c in LONGS]
    columns += [pa.array([s.decode() or NO_ENDS for s in figures["sha"][at].tolist()] + none, pa.string())]
    columns += [binary([names.get(v) if level else None for v in at.tolist()], none)]
    columns += [binary([None if k or v < 0 else names[v] for v, k in zip(up.tolist(), known.tolist())], none)]
    columns += [binary([None] * len(at), [p for p, _ in spines]), binary([None] * len(at), [a for _, a in spines])]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NODES.split(", ")])


def _shards(level: int, last: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, adds, turns = [], [], 0
        for path, add in _sequences_of(batches, level):
            full = len(paths) >= SHARD_SEQUENCES or turns >= SHARD_TURNS and len(paths) >= LEAST_SEQUENCES
            if full and not last:
                yield encoded(paths, adds, level, last)
                paths, adds, turns = [], [], 0
            paths.append(path)
            adds.append(add)
            turns += len(path) // RECORD
        if paths:
            yield encoded(paths, adds, level, last)

    return encode


def _sequences_of(batches: Iterable[pa.RecordBatch], level: int) -> Iterator[tuple[bytes, np.ndarray]]:
    for batch in batches:
        if level:
            for path, add in zip(batch.column("path").to_pylist(), batch.column("adds").to_pylist()):
                yield path, np.frombuffer(add, ADDS)
        else:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "n", "least", "sha"))):
                yield row[0], end_only(0, *row[1:])


# ---------------------------------------------------------------- paths


def record(role: Column, text: Column) -> Column:
    """48 hex digits of a turn: digest of role and text, then length of the text in bytes."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    size = F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")
    return F.concat(digest, size)


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path``: the records of each conversation in order of turns."""
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"),
        F.col("turn").alias("turn"),
        record(F.col("role"), F.col("text")).alias("record"),
    )
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), turn.alias("row"))
    ordered = F.sort_array(F.collect_list("row"))
    each = rows.groupBy("conv_id").agg(ordered.alias("rows"))
    return each.select("conv_id", F.unhex(F.array_join(F.col("rows.record"), "")).alias("path"))


def rebuilt(own: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation with its first h turns taken from the first one of its family.

    h is the crc32 of the decimal id modulo ``heads``.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(family))
    rows = own.select("conv_id", "path", base.alias("base"), (h * RECORD).cast("int").alias("cut"))
    head = F.substring("path", 1, (heads - 1) * RECORD)
    heads_ = own.filter(F.pmod("conv_id", F.lit(family)) == 0).select(F.col("conv_id").alias("base"), head.alias("head"))
    joined = rows.join(heads_, "base", "left")
    start = F.coalesce(F.expr("substring(head, 1, cut)"), F.lit(b""))
    return joined.select("conv_id", F.concat(start, F.expr("substring(path, cut + 1)")).alias("path"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal paths within a batch, their ids joined; rows come sorted by path and id."""
    for batch in batches:
        out, last = [], None
        for path, conv_id in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
            if path != last:
                out.append((path, conv_id, []))
                last = path
            out[-1][2].append(str(conv_id))
        cols = list(zip(*((p, i, len(ids), ",".join(ids)) for p, i, ids in out))) or [()] * 4
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "least", "n", "ids"]
        )


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per path from its pieces in order; ids are hashed as they come, never held."""
    names, kinds = ("path", "n", "least", "sha"), (pa.binary(), pa.int64(), pa.int64(), pa.string())

    def packed(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], list(names)
        )

    open_, done = None, []
    for batch in batches:
        for path, least, n, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "least", "n", "ids"))):
            if open_ and open_[0] == path:
                open_[1] += n
                open_[3].update(b"," + ids.encode())
            else:
                if open_:
                    done.append((*open_[:3], open_[3].hexdigest()))
                open_ = [path, n, least, hashlib.sha256(ids.encode())]
        yield packed(done)
        done = []
    if open_:
        yield packed([(*open_[:3], open_[3].hexdigest())])


def sequences(convs: DataFrame) -> DataFrame:
    """Distinct paths of the written table ``conv_id, path``: ``path, n, least, sha`` of their ids."""
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = convs.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    pieces = dealt.mapInArrow(_pieces, "path binary, least long, n long, ids string")
    pieces = written(pieces, "path-pieces").repartitionByRange(parts, "path")
    pieces = pieces.sortWithinPartitions("path", "least")
    return pieces.mapInArrow(_sequences, "path binary, n long, least long, sha string")


def nodes(sequences: DataFrame) -> DataFrame:
    """All nodes of the trie over the written table of sequences.

    A level makes two rows a shard, so the number of levels is logarithmic.
    """
    spark = sequences.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, level, done = sequences, 0, None
    while True:
        n, size = rows.agg(F.count(F.lit(1)), F.sum(F.length("path"))).first()
        last = n <= LEAST_SEQUENCES or n <= SHARD_SEQUENCES and size <= SHARD_TURNS * RECORD
        if last:
            dealt = rows.repartition(1)
        else:
            dealt = rows.repartitionByRange(max(1, min(most, n // 16)), "path")
        dealt = dealt.sortWithinPartitions("path")
        found = written(dealt.mapInArrow(_shards(level, last), NODES), "trie-nodes")
        final = found.filter("path is null")
        done = final if done is None else done.unionByName(final)
        if last:
            break
        rows, level = found.filter("path is not null").select("path", "adds"), level + 1
    done = done.drop("path", "adds")
    # Nodes whose parent was still on a spine learn the parent's smallest member.
    waiting = done.filter("parent is not null")
    spine = done.filter("node is not null and n_children > 0")
    named = spine.select(F.col("node").alias("parent"), F.col("conv_id").alias("_conv"), "n_children")
    told = join_counted(waiting, named, "parent", "n_children").withColumn("parent_conv_id", F.col("_conv"))
    return done.filter("parent is null").unionByName(told.drop("_conv")).drop("node", "parent")


def prefix_trie(conversations: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations ``(conv_id, turn, role, text)``."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    convs = written(rebuilt(written(paths(rows), "paths"), family, heads), "rebuilt-paths")
    return nodes(written(sequences(convs), "sequences"))
