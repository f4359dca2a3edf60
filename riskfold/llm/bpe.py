"""Byte-level BPE: ranked merges folded by Spark's higher-order functions.

A task numbers the distinct words it meets and hands each new word on once, beside the
first text that has it. Spark folds the merges over the word's bytes with the rank map as a
literal; the last step looks the words of each text up by number. No row is shuffled and a
task holds no more than ``MAX_WORDS`` words at a time: beyond that it starts numbering anew.
Spark's maps are searched from front to back, so the literal is an array of small maps,
addressed by the hash of the key. Bytes are written as the characters of the same numbers.

Ids are little-endian unsigned 32-bit integers in one binary value; decoding concatenates
the bytes of the ids. A null text counts as empty and has no ids. Equal rows stay.
Runs above ``FOLD_BYTES`` bytes are merged by a heap, with the same result, as a fold is
quadratic in a word's length. Extra columns are kept; names of the result replace equal ones.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.llm.tables import let

BUCKETS = 1 << 15
FOLD_BYTES = 256
PLACES = 4096  # above FOLD_BYTES
NO_RANK = 1 << 31
MAX_WORDS = 300_000
LONG_TEXT = 1 << 22
ROWS = 256
# Unicode white space, as the word pattern has it: words keep at most one blank before them.
SPACE = "\t-\r \x85\xa0  -     　"
COARSE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_table(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: small maps from strings of byte characters, by hash."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        buckets[xxhash.xxh64_intdigest(key.encode(), 42) & (BUCKETS - 1)][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def merge_all(words: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of each word of an array; the literal stands once in the plan."""

    def rank_in(table: Column):
        def rank(key: Column) -> Column:
            slot = F.xxhash64(key).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
            return F.element_at(F.get(table, slot), key)

        return rank

    return let(
        rank_table(ranks), lambda t: F.transform(words, lambda w: merge_words(w, rank_in(t)))
    )


def merge_words(word: Column, rank) -> Column:
    """Ids of one word of byte characters: the pair of least rank is merged until none has a rank.

    The state of the fold is an array of pieces, each with the rank of its pair with the next.
    """

    def known(key: Column) -> Column:
        return F.coalesce(rank(key), F.lit(NO_RANK)).cast("long")

    def piece(text: Column, following: Column) -> Column:
        return F.struct(text.alias("t"), known(F.concat(text, following)).alias("r"))

    def least(state: Column) -> Column:
        """Rank and place of the pair to merge, as one number; ties go to the left."""
        return F.array_min(F.transform(state, lambda x, i: x["r"] * PLACES + i))

    def merge(state: Column, _: Column) -> Column:
        return let(
            least(state),
            lambda k: F.when(k >= NO_RANK * PLACES, state).otherwise(
                let((k % PLACES).cast("int"), lambda p: joined(state, p))
            ),
        )

    def joined(state: Column, p: Column) -> Column:
        def renewed(whole: Column) -> Column:
            def of(x: Column, i: Column) -> Column:
                return (
                    F.when(i == p, piece(whole, F.get(state, p + 2)["t"]))
                    .when(i == p - 1, piece(x["t"], whole))
                    .when(i != p + 1, x)
                )

            return F.filter(F.transform(state, of), lambda x: x.isNotNull())

        return let(F.concat(F.get(state, p)["t"], F.get(state, p + 1)["t"]), renewed)

    def start(parts: Column) -> Column:
        return F.transform(parts, lambda t, i: piece(t, F.get(parts, i + 1)))

    def folded(w: Column) -> Column:
        steps = F.sequence(F.lit(1), F.length(w) - 1)
        done = F.aggregate(steps, let(F.split(w, ""), start), merge)
        return F.transform(done, lambda x: rank(x["t"]))

    whole = rank(word)
    return (
        F.when(whole.isNotNull(), F.array(whole))
        .when(F.length(word) > FOLD_BYTES, F.lit(None))
        .otherwise(folded(word))
    )


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a very long word, by a heap of neighbouring pairs."""
    part = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    heap = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(part) and (r := ranks.get(part[i] + part[after[i]])) is not None:
            heapq.heappush(heap, (r, i, part[i], part[after[i]]))

    for i in range(len(part)):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if part[i] is not left or j >= len(part) or part[j] is not right:
            continue
        part[i], part[j] = left + right, None
        after[i] = after[j]
        if after[j] < len(part):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in part if p is not None]


class _Numbers(dict):
    """Numbers of words in the order they were met; new words are noted with their pieces."""

    def __init__(self, pattern: regex.Pattern):
        self.pattern = pattern
        self.pieces: dict[str, int] = {}  # those that are no word by themselves
        self.n_pieces = 0
        self.alone = array("i")  # of each word, the number of its only piece, or -1
        self.new_words: list[int] = []  # pieces of each
        self.new_codes: list[int] = []  # pieces of all, one after the other
        self.new_pieces: list[str] = []

    def __missing__(self, word: str) -> int:
        found = self.pattern.findall(word)
        numbers = [self._number(piece, piece == word) for piece in found]
        self.alone.append(numbers[0] if found == [word] else -1)
        self.new_codes += numbers
        self.new_words.append(len(found))
        self[word] = len(self)
        return len(self) - 1

    def _number(self, piece: str, is_word: bool) -> int:
        number = self.pieces.get(piece)
        if number is None and (word := self.get(piece)) is not None and self.alone[word] >= 0:
            number = self.alone[word]
        if number is None:
            number, self.n_pieces = self.n_pieces, self.n_pieces + 1
            if not is_word:  # a word's own number is kept with the word
                self.pieces[piece] = number
            self.new_pieces.append(piece.encode().decode("latin-1"))
        return number

    def clear_new(self) -> None:
        self.new_words, self.new_codes, self.new_pieces = [], [], []


def _words(text: str) -> Iterator[str]:
    if len(text) <= LONG_TEXT:
        return COARSE.findall(text)
    return (m.group() for m in COARSE.finditer(text))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that little is held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def _parts(lists: pa.ListArray, values: bytes, width: int) -> list[bytes]:
    """The slices of ``values`` that the lists stand for."""
    at = lists.offsets.to_numpy().astype(np.int64)
    at = ((at - at[0]) * width).tolist()
    return [values[a:b] for a, b in zip(at, at[1:], strict=False)]


def pack(ids: pa.ListArray | list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    flat = ids.flatten().to_numpy(zero_copy_only=False) if isinstance(ids, pa.ListArray) else ids
    return np.asarray(flat, "<u4").tobytes()


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text_col: str = "text",
    ids: str = "ids",
    keep: list[str] | None = None,
    decoded: str | None = None,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """All columns of ``docs``, or those in ``keep``, and the ids of the text, packed.

    Each match of ``pattern`` is merged apart. Texts that are not kept leave after the first step.
    ``decoded`` names one more column, the bytes to which the ids decode.
    """
    spark = docs.sparkSession
    added = [ids, *([decoded] if decoded else [])]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    docs = docs.select(*names, F.col(text_col).alias("_text"))
    held = spark.sparkContext.broadcast(ranks)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Numbers(regex.compile(pattern))
        for batch in sliced(batches):
            # A batch that would pass the bound starts anew as a whole.
            fresh = len(known) > max_words
            if fresh:
                known = _Numbers(known.pattern)
            codes, counts = [], []
            for text in batch.column(len(names)).to_pylist():
                before = len(known), known.n_pieces
                codes.append(np.fromiter(map(known.__getitem__, _words(text or "")), np.int32))
                counts.append((len(known) - before[0], known.n_pieces - before[1]))
            words = _lists(known.new_words, pa.array(known.new_codes, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names)],
                    _lists([len(c) for c in codes], pa.array(np.concatenate(codes))),
                    _lists([n for n, _ in counts], words),
                    _lists([n for _, n in counts], pa.array(known.new_pieces, pa.string())),
                    pa.array([fresh] + [False] * (len(codes) - 1)),
                ],
                names=[*names, "_codes", "_words", "_pieces", "_fresh"],
            )
            known.clear_new()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[bytes] = []
        words: list[bytes] = []
        texts = decoder(held.value) if decoded else None
        for batch in sliced(batches):
            starts = np.flatnonzero(batch.column(len(names) + 3).to_numpy(zero_copy_only=False))
            edges = sorted({0, *starts.tolist(), batch.num_rows})
            for a, b in zip(edges, edges[1:], strict=False):
                if a in starts:
                    pieces, words = [], []
                part = batch.slice(a, b - a)
                codes, new_words, long_pieces, _, merged = part.columns[len(names) :]
                merged = merged.flatten()
                own = _parts(merged, pack(merged), 4)
                long = (p.encode("latin-1") for p in long_pieces.flatten().to_pylist())
                long = (p for p in long if p not in held.value)
                for i in np.flatnonzero(merged.is_null().to_numpy(zero_copy_only=False)):
                    own[i] = pack(merge_long(next(long), held.value))
                pieces += own
                new_words = new_words.flatten()
                numbers = new_words.flatten().to_pylist()
                for found in _parts(new_words, numbers, 1):
                    words.append(b"".join([pieces[c] for c in found]))
                numbers = codes.flatten().to_pylist()
                out = [b"".join([words[c] for c in found]) for found in _parts(codes, numbers, 1)]
                kept = [*part.columns[: len(names)], pa.array(out, pa.binary())]
                if decoded:
                    kept.append(pa.array(map(texts, out), pa.binary()))
                yield pa.RecordBatch.from_arrays(kept, names=[*names, *added])

    extra = "_codes array<int>, _words array<array<int>>, _pieces array<string>, _fresh boolean"
    kept_fields = docs.schema.fields[: len(names)]
    schema = T.StructType([*kept_fields, *T._parse_datatype_string(extra).fields])
    numbered = docs.mapInArrow(number, schema)
    merged = numbered.withColumn("_merged", merge_all(F.col("_pieces"), ranks))
    # Only what the fold left over travels on.
    merged = merged.withColumn("_pieces", F.filter("_pieces", lambda p: F.length(p) > FOLD_BYTES))
    binary = [T.StructField(c, T.BinaryType()) for c in added]
    return merged.mapInArrow(assemble, T.StructType([*kept_fields, *binary]))


def decoder(ranks: dict[bytes, int]):
    """Function from packed ids to the bytes of all their tokens."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return lambda packed: b"".join([pieces[i] for i in np.frombuffer(packed, "<u4").tolist()])


def decode(packed: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of packed ids, as a binary column; null stays null."""
    held = decoder(ranks)

    @F.pandas_udf(T.BinaryType())
    def of(series):
        return series.map(held, na_action="ignore")

    return of(packed)
