"""Spelling variants: words one edit apart, by dynamic programming down sorted word lists.

Words are counted over whole texts: each task counts its documents' words and hands on sums.
Two words one edit apart are met in the shard of what they share: words of length l and l + 1
share a first or a last half around the edit. A shard is a class l with a shared start and a
shared end; its words differ in the ``middle``. A shard above ``shard_size`` is split again by
the halves of its middles, until it is small or its middles have one or two letters (so few
that the alphabet bounds it). A pair belongs to exactly one shard: to the one with the longer
start if the edit is behind it.

In a shard the middles are sorted. For each word the scan goes down the list with a band of
three cells of the edit matrix a letter, keeps the rows that adjacent words share (their
longest common prefix) and skips all words that share a prefix whose row is above one edit.

Null and empty texts have no words; a text of any length is read whole, and a word of any
length is a word. Equal rows count each. A null ``doc_id`` is written as an empty string in
what is hashed. Equal counts: the smaller word in code-point order wins. Extra columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.functions.scaling import written

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
DROP_MOD = 97
MIN_LENGTH, MIN_COUNT = 5, 3
SHARD_SIZE = 256
HELD_WORDS, HELD_LETTERS = 200_000, 1 << 26  # counted in a task before sums are handed on
TEXT_PIECE = 1 << 20


# ---------------------------------------------------------------- counting


def runs(text: str) -> Iterator[str]:
    """Letter runs, A-Z lower-cased, piece by piece so that a long text is never one list."""
    at = 0
    while at < len(text):
        end = min(len(text), at + TEXT_PIECE)
        cut = RUN.match(text, end)  # a run goes on behind the piece
        end = cut.end() if cut and RUN.match(text, end - 1) else end
        yield from RUN.findall(text[at:end].encode().lower().decode())
        at = end


def words_of(doc_id: object, text: str) -> Counter:
    """Words of one text; a run loses a letter where its hash with the id says so."""
    start = crc32(b"" if doc_id is None else str(doc_id).encode())
    start = crc32(b":", start)
    out = Counter()
    for run, n in Counter(runs(text)).items():
        h = crc32(run.encode(), start)
        if h % DROP_MOD == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def _counted(min_length: int):
    def flushed(held: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in held.items() if len(w) >= min_length]
        words, n = zip(*kept, strict=True) if kept else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters = Counter(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column("id"), batch.column("text"), strict=True):
                if text.is_valid:
                    whole = text.as_py()
                    held.update(words_of(doc_id.as_py(), whole))
                    letters += len(whole)
                if len(held) >= HELD_WORDS or letters >= HELD_LETTERS:
                    yield flushed(held)
                    held, letters = Counter(), 0
        yield flushed(held)

    return count


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """``word, n`` of the words with enough letters and occurrences in all texts together."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    each = rows.mapInArrow(_counted(min_length), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---------------------------------------------------------------- one shard


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def skips(shared: list[int]) -> list[dict[int, int]]:
    """For each place of a sorted list: where the words that share its first d letters end.

    ``shared[k]`` letters are common to words k - 1 and k. Only depths at which a range ends
    later than the next word are held.
    """
    ends: list[dict[int, int]] = [{} for _ in shared]
    last = len(shared)
    for k in range(last - 2, -1, -1):
        deep = shared[k + 1]
        for d in range(1, deep + 1):
            ends[k][d] = ends[k + 1].get(d, k + 2)
    return ends


def one_edit_pairs(words: list[str], length: int) -> Iterator[tuple[int, int, int]]:
    """Places ``(i, j)`` of distinct words one edit apart, and their common prefix.

    ``words`` are sorted and have ``length`` or ``length + 1`` letters. Each pair comes once: two
    words of ``length`` in sorted order, or a word of ``length`` with a longer one.

    A row of the band holds the distances between the first d letters of a list word and the
    first d - 1, d and d + 1 letters of the asked one.
    """
    shared = [0] + [common_prefix(a, b) for a, b in zip(words, words[1:], strict=False)]
    ends = skips(shared)
    far = 2
    for i, word in enumerate(words):
        if len(word) != length:
            continue
        rows = [(far, 0, 1)] + [(far, far, far)] * (length + 1)
        k, valid = 0, 0
        while k < len(words):
            other = words[k]
            d, jump = min(valid, shared[k]), 0
            while d < len(other):
                before, letter = rows[d], other[d]
                d += 1
                # cells (d, d - 1), (d, d) and (d, d + 1); beyond the asked word all is far
                left = min(before[0] + (d < 2 or letter != word[d - 2]), before[1] + 1) if d > 1 else 1
                if d <= length:
                    mid = min(before[1] + (letter != word[d - 1]), left + 1, before[2] + 1)
                else:
                    mid = far
                right = min(before[2] + (letter != word[d]), mid + 1) if d < length else far
                rows[d] = (left, mid, right)
                if left > 1 and mid > 1 and right > 1:
                    jump = ends[k].get(d, k + 1)
                    break
            valid = d
            if jump:
                # words in between share d letters; what they share with the next is less
                valid = min(d, min(shared[k + 1 : jump + 1], default=0)) if jump < len(words) else 0
                k = jump
                continue
            gap = rows[d][length - d + 1]
            if k != i and gap == 1 and (len(other) > length or k > i):
                yield i, k, common_prefix(word, other)
            k += 1


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each pair of a shard; rows come sorted by shard and middle."""
    held: list[tuple[str, str, int]] = []
    key = None

    def found() -> pa.RecordBatch:
        length, _, after = key
        out = []
        for i, j, same in one_edit_pairs([m for _, m, _ in held], length):
            if after and same == length:
                continue  # the edit lies behind the middle: a pair of the other half
            (a, _, n), (b, _, m) = held[i], held[j]
            out += [(a, b, m), (b, a, n)]
        word, near, n = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())],
            ["word", "near", "n"],
        )

    last = None
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "free", "after", "word", "middle", "n")))
        for shard, free, after, word, middle, n in rows:
            if shard != last:
                if len(held) > 1:
                    yield found()
                held, last, key = [], shard, (free, shard, after)
            held.append((word, middle, n))
    if len(held) > 1:
        yield found()


# ---------------------------------------------------------------- all shards


def _halved(rows: DataFrame) -> DataFrame:
    """Each word of a shard in its two halves: the start grows, or the end does."""
    cut = F.floor((F.col("size") - F.col("before") - F.col("after")) / 2)
    halves = F.array(
        F.struct((F.col("before") + cut).alias("before"), F.col("after").alias("after")),
        F.struct(F.col("before").alias("before"), (F.col("size") - F.col("before") - cut).alias("after")),
    )
    out = rows.select("word", "n", "size", F.explode(halves).alias("half"))
    return _sharded(out.select("word", "n", "size", "half.before", "half.after"))


def _sharded(rows: DataFrame) -> DataFrame:
    start = F.substring("word", F.lit(1), F.col("before").cast("int"))
    # substring(word, 0, 0) and a negative start of zero letters are both empty
    end = F.when(F.col("after") > 0, F.expr("right(word, cast(after as int))")).otherwise(F.lit(""))
    shard = F.concat_ws(" ", "size", "before", "after", start, end)
    return rows.withColumn("shard", shard)


def near_pairs(vocab: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """``word, near, n`` for all words one edit apart, both ways; ``n`` counts ``near``."""
    long = F.char_length("word").cast("long")
    classes = F.array(long, long - 1)
    rows = vocab.select("word", "n", F.explode(classes).alias("size")).filter("size >= 0")
    zero = F.lit(0).cast("long")
    rows = _halved(rows.withColumns({"before": zero, "after": zero}))
    done = None
    while True:
        rows = written(rows, "spelling-shards")
        splits = rows.filter("size - before - after > 1")
        hot = splits.groupBy("shard").count().filter(F.col("count") > shard_size).select("shard")
        hot = written(hot, "hot-spelling-shards")
        small = rows.join(hot, "shard", "left_anti")
        done = small if done is None else done.unionByName(small)
        if hot.isEmpty():
            break
        rows = _halved(rows.join(hot, "shard", "left_semi"))
    free = F.col("size") - F.col("before") - F.col("after")
    middle = F.expr("substring(word, cast(before as int) + 1, cast(char_length(word) - before - after as int))")
    met = done.select("shard", free.alias("free"), "after", "word", middle.alias("middle"), "n")
    met = met.repartition("shard").sortWithinPartitions("shard", "middle")
    return met.mapInArrow(_near, "word string, near string, n long")


def forms(vocab: DataFrame, near: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, n, n_near, form, form_n``: the form is the near word of largest count, if large enough."""
    # min of (-n, word): largest count first, then the smaller word
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    each = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    each = vocab.join(each, "word", "left")
    counts = -F.col("best.minus") >= ratio * F.col("n")
    return each.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(counts, F.col("best.near")).alias("form"),
        F.when(counts, -F.col("best.minus")).alias("form_n"),
    )


def roots(found: DataFrame) -> DataFrame:
    """Adds ``root``, the end of the chain of forms. Chains double their reach in each round.

    Counts at least double along a chain, so it has no cycle and few links.
    """
    links = written(found.filter("form is not null").select("word", F.col("form").alias("root")), "form-links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = links.join(onward, "root", "left")
        further = written(further.select("word", F.coalesce("next", "root").alias("root"), "next"), "form-links")
        links = further.drop("next")
        if further.filter("next is not null").isEmpty():
            break
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = 2,
    shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the vocabulary of whole texts."""
    vocab = written(vocabulary(docs, id_col, text_col, min_length, min_count), "vocabulary")
    near = near_pairs(vocab, shard_size)
    found = written(forms(vocab, near, ratio), "word-forms")
    return roots(found)
