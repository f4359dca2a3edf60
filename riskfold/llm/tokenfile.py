"""Token ids in files: an adaptive context-mixing range coder over independent blocks.

Ids are cut into blocks of ``BLOCK``. A block starts with an empty model and carries a checksum of its
ids, so any block can be read alone. For each id the model tells whether it is the id that followed
the last two ids before (order 2), else the one that followed the last id (order 1), else which
length in bits it has; the other bits follow as they are. Three adaptive tables give that outcome's
frequencies: without context, by the length of the last id, and of the last two. Their mixture,
by weights that move to the tables that predict well, drives a 48-bit range coder with
carries. All numbers are whole, so reader and writer agree on any machine. The blocks of a
part are coded side by side in numpy, one id of each at a time.

A data set is a folder of Parquet rows, one a part: ``shard``, ``seq``, the counts of documents
and ids, and the coded part with its header. Parts go by shard, then ``seq``, in ascending id of the
documents (nulls first; equal ids by their tokens). Spark commits the files, so a lost executor
leaves no half of one. Documents of any length are whole in one part. An empty
table gives no parts. Extra columns are not written.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfold.llm.bpe import SPACE
from riskfold.llm.fingerprint import range_starts, with_range

BLOCK, LANES = 2048, 1024
STEP = 24  # added to the count of what came
SLOTS1, SLOTS2 = 10, 11  # bits of the tables of predicted ids
SCALE, WEIGHTS, TURN = 16, 256, 4
BITS48 = (1 << 48) - 1
MAGIC = b"RFTK1\n"
WORDS = re.compile(f"[^{SPACE}]+")
HELD_WORDS = 300_000
ROWS = 256


class _Model:
    """State of all blocks of a part; the same steps for writing and for reading."""

    def __init__(self, blocks: int, bits: int):
        self.size = bits + 2
        self.lane = np.arange(blocks)
        self.rows = [np.ones((blocks * self.size**k, self.size), np.int32) for k in range(3)]
        self.totals = [np.full(blocks * self.size**k, self.size, np.int64) for k in range(3)]
        self.weights = [np.full(blocks, WEIGHTS // 3, np.int64) for _ in range(3)]
        self.after1 = np.zeros(blocks << SLOTS1, np.int64)
        self.after2 = np.zeros(blocks << SLOTS2, np.int64)
        self.last = [np.zeros(blocks, np.int64) for _ in range(2)]
        self.lengths = [np.zeros(blocks, np.int64) for _ in range(2)]

    def narrow(self, blocks: int) -> None:
        """Go on with the first blocks only."""
        self.lane = self.lane[:blocks]
        for name in ("weights", "last", "lengths"):
            setattr(self, name, [x[:blocks] for x in getattr(self, name)])

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Frequencies of outcomes, their running sums, and the ids that orders 1 and 2 predict."""
        one = self.lane * self.size + self.lengths[0]
        self.at = [self.lane, one, one * self.size + self.lengths[1]]
        self.met = [r.take(i, axis=0) for r, i in zip(self.rows, self.at, strict=True)]
        self.sums = [t[i] for t, i in zip(self.totals, self.at, strict=True)]
        freq = 1
        for row, total, weight in zip(self.met, self.sums, self.weights, strict=True):
            freq = freq + row * ((weight << SCALE) // total)[:, None]
        a, b = self.last
        self.slot1 = (self.lane << SLOTS1) + ((a * 0x9E3779B1 >> 15) & ((1 << SLOTS1) - 1))
        mixed = a * 0x85EBCA6B + b * 0xC2B2AE35
        self.slot2 = (self.lane << SLOTS2) + ((mixed >> 17) & ((1 << SLOTS2) - 1))
        return freq, np.cumsum(freq, axis=1), self.after1[self.slot1], self.after2[self.slot2]

    def learn(self, outcome: np.ndarray, value: np.ndarray, length: np.ndarray) -> None:
        """``value`` is the id plus one, ``length`` its bits."""
        good = []
        for k in range(3):
            seen = self.met[k][self.lane, outcome].astype(np.int64)
            good.append((seen << SCALE) // self.sums[k] + 1)
            self.rows[k][self.at[k], outcome] += STEP
            self.totals[k][self.at[k]] += STEP
        whole = good[0] + good[1] + good[2]
        for k in range(3):
            self.weights[k] += (good[k] * WEIGHTS // whole - self.weights[k]) >> TURN
            np.maximum(self.weights[k], 1, out=self.weights[k])
        self.after1[self.slot1] = value
        self.after2[self.slot2] = value
        self.last = [value, self.last[0]]
        self.lengths = [length, self.lengths[0]]


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _columns(ids: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Ids as one row a block, the number of blocks, and the length of the last one."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.zeros((blocks, BLOCK), np.int64)
    padded.ravel()[: len(ids)] = ids
    return padded, blocks, len(ids) - (blocks - 1) * BLOCK


def code_blocks(ids: np.ndarray, bits: int) -> list[bytes]:
    """Coded blocks of ``ids``, each below ``2**bits - 1``."""
    values, blocks, last = _columns(ids)
    values += 1
    lengths = _bit_lengths(values)
    model = _Model(blocks, bits)
    low, span = np.zeros(blocks, np.int64), np.full(blocks, BITS48, np.int64)
    words = np.zeros((blocks, 4 * min(BLOCK, len(ids)) + 8), np.int32)
    count = np.zeros(blocks, np.int64)

    def settle(low: np.ndarray, span: np.ndarray) -> None:
        carry = np.flatnonzero(low > BITS48)
        if len(carry):
            words[carry, count[carry] - 1] += 1
            low[carry] &= BITS48
        while len(i := np.flatnonzero(span < 1 << 32)):
            words[i, count[i]] = low[i] >> 32
            count[i] += 1
            low[i] = (low[i] << 16) & BITS48
            span[i] <<= 16

    for t in range(values.shape[1] if blocks > 1 else last):
        if t == last:
            model.narrow(blocks - 1)
        n = len(model.lane)
        value, length, lo, sp = values[:n, t], lengths[:n, t], low[:n], span[:n]
        freq, upto, p1, p2 = model.predict()
        outcome = np.where(p2 == value, 0, np.where(p1 == value, 1, length + 1))
        own, top = freq[model.lane, outcome], upto[model.lane, outcome]
        sp //= upto[:, -1]
        lo += sp * (top - own)
        sp *= own
        settle(lo, sp)
        rest = np.where(outcome > 1, length - 1, 0)
        sp >>= rest
        lo += sp * np.where(outcome > 1, value - (1 << rest), 0)
        settle(lo, sp)
        model.learn(outcome, value, length)
    for shift in (32, 16, 0):
        words[np.arange(blocks), count] = (low >> shift) & 0xFFFF
        count += 1
    for j in range(int(count.max()) - 1, 0, -1):
        words[:, j - 1] += words[:, j] >> 16
        words[:, j] &= 0xFFFF
    return [words[i, : count[i]].astype("<u2").tobytes() for i in range(blocks)]


def read_blocks(coded: list[bytes], n_ids: int, bits: int) -> np.ndarray:
    """The ids of the coded blocks of a part."""
    blocks, last = len(coded), n_ids - (len(coded) - 1) * BLOCK
    words = np.zeros((blocks, max(map(len, coded)) // 2 + 2), np.int64)
    for i, c in enumerate(coded):
        words[i, : len(c) // 2] = np.frombuffer(c, "<u2")
    code = (words[:, 0] << 32) | (words[:, 1] << 16) | words[:, 2]
    span, count = np.full(blocks, BITS48, np.int64), np.full(blocks, 3, np.int64)
    model = _Model(blocks, bits)
    out = np.zeros((blocks, BLOCK), np.int64)

    def settle(code: np.ndarray, span: np.ndarray) -> None:
        while len(i := np.flatnonzero(span < 1 << 32)):
            code[i] = (code[i] << 16) | words[i, count[i]]
            count[i] += 1
            span[i] <<= 16

    for t in range(BLOCK if blocks > 1 else last):
        if t == last:
            model.narrow(blocks - 1)
        n = len(model.lane)
        cd, sp = code[:n], span[:n]
        freq, upto, p1, p2 = model.predict()
        sp //= upto[:, -1]
        at = np.minimum(cd // sp, upto[:, -1] - 1)
        outcome = (upto <= at[:, None]).sum(axis=1)
        own, top = freq[model.lane, outcome], upto[model.lane, outcome]
        cd -= sp * (top - own)
        sp *= own
        settle(cd, sp)
        rest = np.where(outcome > 1, outcome - 2, 0)
        sp >>= rest
        more = np.minimum(cd // sp, (1 << rest) - 1)
        cd -= sp * more
        settle(cd, sp)
        value = np.where(outcome == 0, p2, np.where(outcome == 1, p1, (1 << rest) + more))
        model.learn(outcome, value, _bit_lengths(value))
        out[:n, t] = value - 1
    return out.ravel()[:n_ids]


def pack_part(lengths: list[int], ids: np.ndarray) -> bytes:
    """One part: header, ids per document, and for each block its size, checksum and code."""
    bits = max(1, int(ids.max(initial=0) + 1).bit_length())
    head = MAGIC + struct.pack("<QQIB", len(lengths), len(ids), BLOCK, bits)
    head += np.array(lengths, "<u4").tobytes()
    body = []
    for at in range(0, len(ids), LANES * BLOCK):
        part = ids[at : at + LANES * BLOCK]
        for k, code in enumerate(code_blocks(part, bits)):
            plain = part[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()
            body.append(struct.pack("<II", len(code), zlib.crc32(plain)) + code)
    return head + b"".join(body)


def unpack_part(data: bytes) -> Iterator[np.ndarray]:
    """Ids of each document of a part; a block whose checksum differs is an error."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a part of token ids")
    docs, n_ids, block, bits = struct.unpack_from("<QQIB", data, len(MAGIC))
    if block != BLOCK:
        raise ValueError(f"blocks of {block} ids")
    at = len(MAGIC) + struct.calcsize("<QQIB")
    lengths = np.frombuffer(data, "<u4", docs, at)
    at += 4 * docs
    coded, sums = [], []
    for _ in range(-(-n_ids // BLOCK)):
        size, check = struct.unpack_from("<II", data, at)
        coded.append(data[at + 8 : at + 8 + size])
        sums.append(check)
        at += 8 + size
    ids = np.zeros(n_ids, "<u4")
    for k in range(0, len(coded), LANES):
        start = k * BLOCK
        n = min(n_ids - start, LANES * BLOCK)
        try:
            ids[start : start + n] = read_blocks(coded[k : k + LANES], n, bits)
        except IndexError as e:  # damage can lead the decoder past the end of a block
            raise ValueError(f"damage in blocks {k} to {k + LANES - 1}") from e
    for k, check in enumerate(sums):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].tobytes()) != check:
            raise ValueError(f"block {k} is damaged")
    ends = np.cumsum(lengths, dtype=np.int64)
    return (ids[e - n : e] for e, n in zip(ends, lengths, strict=True))


def tokenize(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and packed ids by a tokenizer's JSON, ``end`` after each text.

    Words are encoded by the library in batches, each once while a task remembers it; it splits
    texts at white space itself, so words apart give the ids of the text. Strings of special
    tokens in a text become their ids, as the library does.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(tokenizer)
        known: dict[str, bytes] = {}
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                words = [WORDS.findall(t or "") for t in part.column(1).to_pylist()]
                if len(known) > HELD_WORDS:
                    known = {}
                new = list({w: None for ws in words for w in ws if w not in known})
                for w, e in zip(new, library.encode_batch_fast(new, add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, "<u4").tobytes()
                ids = [b"".join([*map(known.__getitem__, ws), last]) for ws in words]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"]
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary")


def write(docs: DataFrame, ids: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes ``ids (doc_id, ids)`` as a data set; ``docs`` gives the ids from which shards are cut."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("double"), F.lit(float(-(1 << 63))))
    starts = range_starts(docs, key, shards)
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(float(-(1 << 63))))
    numbered = with_range(ids, key, starts, "shard")
    # Ranges count from the greatest ids down, shards the other way.
    numbered = numbered.withColumn("shard", F.lit(len(starts) - 1) - F.col("shard"))
    dealt = numbered.repartition(shards, "shard")
    dealt = dealt.sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
    full = LANES * BLOCK

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, names, held, size = None, 0, [], [], 0

        def row() -> pa.RecordBatch:
            lengths = [len(x) // 4 for x in held]
            flat = np.frombuffer(b"".join(held), "<u4").astype(np.int64)
            values = [[shard], [seq], [len(lengths)], [len(flat)], [names], [pack_part(lengths, flat)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=columns
            )

        for batch in batches:
            for name, own, its in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (its != shard or size >= full):
                    yield row()
                    seq, names, held, size = seq + 1, [], [], 0
                if its != shard:
                    shard, seq = its, 0
                names.append(name)
                held.append(own)
                size += len(own) // 4
        if held:
            yield row()

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    columns = ["shard", "seq", "n_docs", "n_ids", "doc_ids", "data"]
    files = dealt.select("doc_id", "ids", "shard").mapInArrow(
        parts, "shard int, seq int, n_docs long, n_ids long, doc_ids array<long>, data binary"
    )
    files.write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document of a data set, from its files.

    Starts are sums over earlier shards, as many as tasks that wrote, over earlier parts of
    the shard, and within the part.
    """
    files = spark.read.parquet(path)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, seq, names, data = (batch.column(i)[k].as_py() for i in range(4))
                start, rows = 0, []
                for name, own in zip(names, unpack_part(data), strict=True):
                    rows.append((shard, seq, name, start, len(own), own.tobytes()))
                    start += len(own)
                for at in range(0, len(rows), ROWS):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows[at : at + ROWS], strict=True), kinds, strict=True)],
                        names=["shard", "seq", "doc_id", "inside", "n_tokens", "ids"],
                    )

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    found = files.select("shard", "seq", "doc_ids", "data").mapInArrow(
        texts, "shard int, seq int, doc_id long, inside long, n_tokens long, ids binary"
    )
    before = (Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(*before)), F.lit(0)).alias("s0"))
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(*before)
    parts = files.select("shard", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("p0"))
    offsets = parts.join(shards, "shard").select("shard", "seq", (F.col("p0") + F.col("s0")).alias("at"))
    return found.join(offsets, ["shard", "seq"]).select(
        "doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids"
    )
