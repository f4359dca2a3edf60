"""Language identification by hyperdimensional profiles.

Each letter has a fixed random vector of plus and minus ones. An n-gram is bound as the
product of its letters' vectors, each rotated by its place; a text is the sum of its
n-grams. A language's prototype is the sum over all its training texts, taken from counts of
every n-gram. Texts and prototypes are compared by cosine after the part that all
prototypes share has been taken off both.

Only letters count: they are lower-cased, and any run of other characters is one gap.
A null text, or one without letters, is ``und`` with score zero. Rows without a language are
not learned from but get a prediction. Equal texts get equal results. With nothing to learn
from, every text is ``und``. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1024
ORDER = 3
BLOCK_CHARS = 1 << 20
BLOCK_DOCS = 256
BLOCK_GRAMS = 1 << 11
SHARPNESS = 12.0
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@cache
def letter_vector(code: int, dim: int) -> np.ndarray:
    """Random signs that depend on the letter alone; code zero is the gap."""
    return np.random.default_rng((9, code)).integers(0, 2, dim, np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, dim: int) -> np.ndarray:
    """One vector per row of letters: rotated letter vectors, multiplied."""
    out = None
    for place in range(grams.shape[1]):
        codes, at = np.unique(grams[:, place], return_inverse=True)
        table = np.stack([letter_vector(int(c), dim) for c in codes])
        turned = np.roll(table, grams.shape[1] - 1 - place, axis=1)[at]
        out = turned if out is None else out * turned
    return out


def gram_counts(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of each distinct n-gram; for every n-gram met, its row there and its text."""
    coded = [np.frombuffer((t or "").lower().encode("utf-32-le"), np.uint32) for t in texts]
    gap = np.zeros(1, np.uint32)
    lengths = np.array([len(c) + 1 for c in coded])
    codes = np.concatenate([gap, *(x for c in coded for x in (c, gap))]).astype(np.int64)
    doc = np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths)])
    codes[~_letters()[codes]] = 0
    keep = np.r_[True, (codes[1:] > 0) | (codes[:-1] > 0)]
    codes, doc = codes[keep], doc[keep]
    present, ids = np.unique(codes, return_inverse=True)
    n = len(codes) - order + 1
    if n < 1:
        return np.zeros((0, order), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    base, packed = len(present), np.zeros(n, np.int64)
    for place in range(order):
        packed = packed * base + ids[place : place + n]
    # An n-gram belongs to the text of its letters: the gap before a text ends the last one.
    inside = np.ones(n, bool)
    for place in range(1, order - 1):
        inside &= codes[place : place + n] > 0
    inside &= doc[1 : n + 1] == doc[order - 2 : n + order - 2]
    packed, owner = packed[inside], doc[1 : n + 1][inside]
    if base**order <= 1 << 22:
        met = np.zeros(base**order, bool)
        met[packed] = True
        distinct = np.flatnonzero(met)
        row = np.cumsum(met)[packed] - 1
    else:
        distinct, row = np.unique(packed, return_inverse=True)
    grams = np.stack([present[distinct // base ** (order - 1 - p) % base] for p in range(order)], 1)
    return grams, row, owner


def bundles(texts: list[str | None], dim: int, order: int, owners: np.ndarray | None = None) -> np.ndarray:
    """Sum of n-gram vectors per text, or per value of ``owners``; whole numbers in floats."""
    grams, row, doc = gram_counts(texts, order)
    n = len(texts) if owners is None else int(owners.max()) + 1
    doc = doc if owners is None else owners[doc]
    out = np.zeros((n, dim), np.float32 if owners is None else np.float64)
    size = len(grams)
    counts = np.bincount(doc * size + row, minlength=n * size).reshape(n, size) if size else None
    for at in range(0, size, BLOCK_GRAMS):
        part = counts[:, at : at + BLOCK_GRAMS].astype(out.dtype)
        out += part @ gram_vectors(grams[at : at + BLOCK_GRAMS], dim).astype(out.dtype)
    return out


def blocks(columns: dict[str, list]) -> Iterator[slice]:
    """Slices of rows with a bounded number of rows and of characters (or one row)."""
    start = size = 0
    for i, text in enumerate(columns["text"]):
        if i > start and (i - start >= BLOCK_DOCS or size + len(text or "") > BLOCK_CHARS):
            yield slice(start, i)
            start, size = i, 0
        size += len(text or "")
    if columns["text"]:
        yield slice(start, len(columns["text"]))


def learn(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, order: int = ORDER
) -> dict[str, np.ndarray]:
    """Prototype sums by language from all rows with a language.

    Each task sums what it has; per language and task one vector is shuffled. What comes
    to the driver is one vector of ``dim`` numbers per distinct language.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                rows = batch.slice(at, BLOCK_DOCS).to_pydict()
                for part in blocks(rows):
                    langs = rows["lang"][part]
                    names = sorted(set(langs))
                    owners = np.array([names.index(x) for x in langs])
                    for name, vector in zip(names, bundles(rows["text"][part], dim, order, owners), strict=True):
                        total[name] = total.get(name, 0) + vector
        yield pa.RecordBatch.from_pydict(
            {"lang": list(total), "v": [v.astype(np.int64) for v in total.values()]}, schema=schema
        )

    schema = pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64()))])
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    parts = rows.filter("lang is not null and text is not null").mapInArrow(
        sums, "lang string, v array<bigint>"
    )
    whole = (
        parts.select("lang", F.posexplode("v"))
        .groupBy("lang", "pos")
        .agg(F.sum("col").alias("v"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("v"))
        .select("lang", "v.v")
    )
    found = {r["lang"]: np.array(r["v"], np.float64) for r in whole.collect()}
    return {k: found[k] for k in sorted(found) if found[k].any()}


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def compare(sums: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    """Cosines of texts with languages, both without what the languages have in common."""
    languages = _unit(prototypes)
    shared = languages.mean(axis=0) if len(languages) > 1 else np.zeros(languages.shape[1])
    along = _unit(shared[None])[0]
    texts = _unit(sums)
    texts = _unit(texts - np.outer(texts @ along, along))
    return texts @ _unit(languages - np.outer(languages @ along, along)).T


def identify(
    docs: DataFrame,
    model: dict[str, np.ndarray],
    text_col: str = "text",
    lang: str = "lang_pred",
    score: str = "score",
    sharpness: float = SHARPNESS,
    order: int = ORDER,
) -> DataFrame:
    """All columns of ``docs`` and the language with the largest cosine; the score is its
    share of the exponentials of the sharpened cosines."""
    names = list(model)
    stacked = np.stack(list(model.values())) if model else None
    held = docs.sparkSession.sparkContext.broadcast(stacked)

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        best, share = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for at in range(0, len(texts) if held.value is not None else 0, BLOCK_DOCS):
            some = texts.slice(at, BLOCK_DOCS).to_pylist()
            for part in blocks({"text": some}):
                sums = bundles(some[part], held.value.shape[1], order).astype(np.float64)
                near = np.exp(sharpness * compare(sums, held.value))
                near /= near.sum(axis=1, keepdims=True)
                for i in np.flatnonzero(np.abs(sums).any(axis=1)):
                    k, row = int(near[i].argmax()), at + part.start + i
                    best[row], share[row] = names[k], near[i, k]
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(share)], ["lang", "score"])

    # Else a filter on the result would be pushed below it and predict again.
    predict = predict.asNondeterministic()
    found = docs.withColumn("_found", predict(F.col(text_col)))
    keep = [c for c in docs.columns if c not in (lang, score)]
    return found.select(*keep, F.col("_found.lang").alias(lang), F.col("_found.score").alias(score))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
