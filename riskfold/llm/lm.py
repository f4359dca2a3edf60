"""Language-model scoring with a log-bilinear neural model.

Symbols of the model are the most frequent words, endings of the other words, and the end of
a text. The vector of the last symbol, times a matrix, predicts the next symbol by its product
with each symbol's vector plus a bias. Noise-contrastive estimation trains it on the
counts of all pairs of neighbouring symbols in the training texts; unigram noise enters by its
expectation instead of by samples. A word that is no symbol of its own has the probability of
its ending times its smoothed share among the words with that ending, so the
probabilities of the next word sum to one (unseen words of an ending share one event).

Every word of every training text is counted. A task holds a bounded number of words. What
comes to the driver is bounded by parameters: the ``frequent`` top words, the endings, and the counts
of pairs of symbols. Texts are scored with these; their other words are joined with the
table of counts, and sums come back per text.

Words are runs without ASCII white space, with A-Z lower-cased; each text has an end as its last
token. A null text counts as empty: one end. Rows without id are training rows. Equal rows
stay. With no training text all counts are zero. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.functions.scaling import written

END = b"\n"  # no word has white space
FREQUENT, WORDS, ENDINGS, ENDING = 1 << 17, 767, 255, 3
HELD_WORDS = 500_000
DIM, NOISE, STEPS, RATE, PRIOR = 48, 50, 200, 0.05, 50.0
ROWS = 256


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.column("text").slice(at, ROWS).to_pylist()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (bytes) and ``c`` of every token of ``docs (text)``, the end among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for texts in _texts(batches):
            for text in texts:
                held.update(tokens(text))
            if len(held) > HELD_WORDS:
                yield rows(held)
                held = Counter()
        yield rows(held)

    def rows(held: Counter) -> pa.RecordBatch:
        words = [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(words, names=["word", "c"])

    return docs.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Symbols:
    """Numbers of words: a frequent word's rank, or ``len(frequent) +`` the symbol of its ending."""

    frequent: list[bytes]
    counts: np.ndarray
    endings: list[bytes]
    words: int

    def __post_init__(self):
        self.number = {w: i for i, w in enumerate(self.frequent)}
        self.ending = {e: self.words + i for i, e in enumerate(self.endings)}
        self.other = self.words + len(self.endings)
        self.end = self.other + 1
        self.size = self.end + 1
        own = list(range(self.words))
        later = [self.end if w == END else self.of_ending(w) for w in self.frequent[self.words :]]
        self.symbol = np.array([*own, *later, *range(self.size)], np.int64)

    def of_ending(self, word: bytes) -> int:
        return self.ending.get(word[-ENDING:], self.other)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        rare, known, first = self.of_ending, self.number.get, len(self.frequent)
        found = (n if (n := known(w)) is not None else first + rare(w) for w in words)
        return np.fromiter(found, np.int64, len(words))


def find_symbols(
    vocab: DataFrame, frequent: int = FREQUENT, words: int = WORDS, endings: int = ENDINGS
) -> Symbols:
    """Top words and endings by count, ties by bytes; the end is numbered after the words."""
    end = vocab.filter(F.col("word") == F.lit(bytearray(END))).first()
    others = vocab.filter(F.col("word") != F.lit(bytearray(END)))
    top = others.orderBy(F.desc("c"), "word").limit(frequent).collect()
    found = [bytes(r["word"]) for r in top]
    counts = [r["c"] for r in top]
    words = min(words, len(found))
    spark = vocab.sparkSession
    own = spark.createDataFrame([(bytearray(w),) for w in found[:words]], "word binary")
    tail = others.join(F.broadcast(own), "word", "left_anti")
    last = F.expr(f"substring(word, -{ENDING}, {ENDING})")
    ends = tail.groupBy(last.alias("e")).agg(F.sum("c").alias("c"))
    ends = ends.orderBy(F.desc("c"), "e").limit(endings).collect()
    found.append(END)
    counts.append(end["c"] if end else 0)
    return Symbols(found, np.array(counts, np.float64), sorted(bytes(r["e"]) for r in ends), words)


def ending_sizes(vocab: DataFrame, symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Per symbol of an ending: tokens and distinct words that go by it."""
    spark = vocab.sparkSession
    own = [(bytearray(w),) for w in [*symbols.frequent[: symbols.words], END]]
    tail = vocab.join(F.broadcast(spark.createDataFrame(own, "word binary")), "word", "left_anti")
    known = [(bytearray(e), s) for e, s in symbols.ending.items()]
    known = spark.createDataFrame(known, "e binary, s int")
    tail = tail.withColumn("e", F.expr(f"substring(word, -{ENDING}, {ENDING})"))
    tail = tail.join(F.broadcast(known), "e", "left")
    sizes = tail.groupBy(F.coalesce("s", F.lit(symbols.other)).alias("s")).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")
    )
    n, v = np.zeros(symbols.size), np.zeros(symbols.size)
    for r in sizes.collect():
        n[r["s"]], v[r["s"]] = r["n"], r["v"]
    return n, v


def pair_counts(docs: DataFrame, symbols: Symbols) -> np.ndarray:
    """How often each symbol follows each other one in ``docs (text)``; a text begins after an end."""
    held = docs.sparkSession.sparkContext.broadcast(symbols)
    size = symbols.size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        total = np.zeros(size * size, np.int64)
        for texts in _texts(batches):
            seen = np.concatenate([[s.end], *(s.symbol[s.numbers(tokens(t))] for t in texts)])
            total += np.bincount(seen[:-1] * size + seen[1:], minlength=size * size)
        cells = np.flatnonzero(total)
        arrays = [pa.array(cells), pa.array(total[cells])]
        yield pa.RecordBatch.from_arrays(arrays, names=["cell", "n"])

    cells = docs.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = cells.toPandas()
    out = np.zeros(size * size)
    out[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return out.reshape(size, size)


def train(
    pairs: np.ndarray,
    dim: int = DIM,
    noise: int = NOISE,
    steps: int = STEPS,
    rate: float = RATE,
    prior: float = PRIOR,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context vectors, symbol vectors and biases by noise-contrastive estimation.

    A pair counts as data with odds ``exp(score) / (noise * q)``, where ``q`` is the noise's
    probability of the symbol. Each step follows the gradient over all pairs and all noise.
    Each context has ``prior`` more pairs that follow ``q``, which holds rare contexts to it.
    """
    size = len(pairs)
    dim = min(dim, size)
    q = (pairs.sum(axis=0) + 1.0) / (pairs.sum() + size)
    pairs = pairs + prior * q
    data = pairs / pairs.sum()
    before = data.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(10)
    vectors, outputs = rng.normal(0, 0.1, (size, dim)), rng.normal(0, 0.1, (size, dim))
    turn, bias = np.eye(dim), np.log(q)
    params = [vectors, turn, outputs, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        context = vectors @ turn
        odds = context @ outputs.T + bias - np.log(noise * q)
        real = 1.0 / (1.0 + np.exp(-np.clip(odds, -30, 30)))
        up = data * (1.0 - real) - noise * before * q * real
        down = up @ outputs
        grads = [down @ turn.T, vectors.T @ down, up.T @ context, up.sum(axis=0)]
        slow = rate * (1.0 - (step - 1) / steps)
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
    return vectors @ turn, outputs, bias


def log_probabilities(context: np.ndarray, outputs: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Normalised log10 probabilities of all symbols after each context, by one matrix product."""
    scores = context @ outputs.T + bias
    scores -= scores.max(axis=1, keepdims=True)
    return (scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))) / np.log(10)


@dataclass
class Model:
    symbols: Symbols
    context: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    ending_tokens: np.ndarray
    ending_words: np.ndarray
    tokens: int
    distinct: int


def learn(docs: DataFrame, vocab: DataFrame, **sizes: int) -> Model:
    """Model of the training rows ``docs (text)``; ``vocab`` is their written :func:`word_counts`."""
    n, v = vocab.agg(F.sum("c"), F.count(F.lit(1))).first()
    symbols = find_symbols(vocab, **sizes)
    trained = train(pair_counts(docs, symbols))
    return Model(symbols, *trained, *ending_sizes(vocab, symbols), n or 0, v)


def score(
    docs: DataFrame, model: Model, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of each row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        s, frequent = m.symbols, len(m.symbols.frequent)
        table = log_probabilities(m.context, m.outputs, m.bias).ravel()
        logs = np.r_[np.log10(s.counts + 0.5), np.zeros(s.size)]
        known = np.r_[s.counts > 0, np.zeros(s.size, bool)]
        by_ending = s.symbol != np.r_[np.arange(s.words), np.full(len(s.symbol) - s.words, s.end)]
        share = np.log10(m.ending_tokens + 0.5 * (m.ending_words + 1))[s.symbol]
        inside = np.where(by_ending, logs - share, 0.0)  # rare words add their count later
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = [[], [], [], [], []]
                for text in part.column(1).to_pylist():
                    words = tokens(text)
                    numbers = s.numbers(words)
                    now = s.symbol[numbers]
                    chain = table[np.r_[s.end, now[:-1]] * s.size + now].sum()
                    rare = Counter(words[i] for i in np.flatnonzero(numbers >= frequent))
                    values = len(words), int(known[numbers].sum()), logs[numbers].sum()
                    for column, value in zip(
                        out, (*values, chain + inside[numbers].sum(), list(rare.items())), strict=True
                    ):
                        column.append(value)
                arrays = [part.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    pair = pa.struct([("word", pa.binary()), ("n", pa.int64())])
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pair)]
    names = ["doc_id", "n_tokens", "known", "logs", "lm", "rare"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    part = rows.mapInArrow(
        sums,
        f"doc_id {kind}, n_tokens long, known long, logs double, lm double, "
        "rare array<struct<word:binary,n:long>>",
    )
    part = written(part.withColumn("row", F.monotonically_increasing_id()), "text-sums")
    each = part.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    c = F.coalesce("c", F.lit(0))
    met = each.join(vocab, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(c + 0.5)).alias("more"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
    )
    base = float(np.log10(model.tokens + 0.5 * (model.distinct + 1)))
    more = F.coalesce("more", F.lit(0.0))
    return (
        part.drop("rare")
        .join(met, "row", "left")
        .select(
            "doc_id",
            "n_tokens",
            (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            (F.col("logs") + more - F.col("n_tokens") * base).alias("base_score"),
            (F.col("lm") + more).alias("score"),
        )
    )


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 1, F.lit(False))
