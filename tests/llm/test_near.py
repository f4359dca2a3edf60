"""Spelling variants and embedding near-duplicates against brute force."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskfold.llm import multiindex, spelling

# -------------------------------------------------------------- 11 spelling


def is_near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, least=5, often=3):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= often}
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    form, near = {}, {}
    for w, n in words.items():
        found = [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if is_near(w, x)]
        near[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, near[w], words[form[w]] if form[w] else None))
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = entry.queries()["op11_spelling_variants"](spark, sf).select(*COLUMNS).collect()
    want = plain_variants([tuple(r) for r in docs.collect()])
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert any(r.form for r in found)


def test_sorted_scan_finds_each_pair_once():
    rng = random.Random(3)
    for _ in range(1500):
        size, letters = rng.randint(0, 6), "abc"[: rng.randint(1, 3)]
        some = ("".join(rng.choices(letters, k=size + rng.randint(0, 1))) for _ in range(25))
        words = sorted(set(some))
        found = sorted((i, j) for i, j, _ in spelling.one_edit_pairs(words, size))
        assert found == sorted(
            (i, j)
            for i, a in enumerate(words)
            for j, b in enumerate(words)
            if len(a) == size and is_near(a, b) and (len(b) > size or j > i)
        )


@pytest.mark.parametrize("shard_size", [2, 256])
def test_spelling_of_odd_rows(spark, shard_size):
    """Long and short words, chains, ties, umlauts, repeated and null rows, small shards."""
    rng = random.Random(5)
    words = ["Straße", "STRASSE", "strasse", "naïve", "naive", "x" * 3000, "x" * 2999 + "y", "été", "a"]
    words += ["".join(rng.choices("ab", k=rng.randint(4, 7))) for _ in range(200)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(40)]
    docs += [(1, docs[1][1]), (None, docs[2][1]), (50, None), (51, ""), (52, "12 \n,"), (-3, "x" * 3000)]
    docs += [(60, "qwertz " * 400_000), (61, "chains " * 40), (62, "chainsa " * 16), (63, "chainsab " * 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df = df.select("*", *[F.lit("z").alias(c) for c in ("word", "n", "shard", "middle", "id", "size")])
    found = spelling.variants(df, shard_size=shard_size).select(*COLUMNS).collect()
    want = plain_variants(docs)
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    chain = {r.word: r.root for r in found}
    assert chain["chainsab"] == "chains"
    assert spelling.variants(df.filter("false")).count() == 0


# -------------------------------------------------------------- 12 embeddings


def plain_links(rows, cosine):
    """Per row: number of links and smallest id reachable, by comparing all pairs."""

    def usable(x, label):
        return label is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)

    vectors = [np.array(x, float) / max(map(abs, x)) if usable(x, lab) else None for _, x, lab in rows]
    near = [[] for _ in rows]
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors):
            if i != j and a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2]:
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    near[i].append(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def clustered(n, dim, seed):
    """Groups of near vectors (many close to the threshold) among strangers, and exact copies."""
    rng = np.random.default_rng(seed)
    heads = rng.standard_normal((n // 10, dim))
    rows = [heads[i % len(heads)] + rng.uniform(0, 0.4) * rng.standard_normal(dim) for i in range(n)]
    rows[5] = rows[4]
    return [(i, [float(v) for v in x], i % 3) for i, x in enumerate(rows)]


def test_links_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    found = entry.queries()["op12_embedding_near_dedup"](spark, sf).collect()
    assert sorted(map(tuple, found), key=str) == plain_links(rows, 0.93)


def test_links_reach_the_recall(spark):
    """Small cells and chunks: many cells, walks that stop early, several chunks a cell."""
    rows = clustered(1500, 24, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = {r[0]: r for r in plain_links(rows, 0.93)}
    args = {"cell_rows": 8, "chunk": 16, "recall": 0.99}
    found = {r.vec_id: tuple(r) for r in multiindex.near_duplicates(df, **args).collect()}
    assert found.keys() == want.keys()
    assert all(found[k][1] <= want[k][1] for k in want)  # none below the threshold
    total = sum(r[1] for r in want.values())
    assert total > 3000 and sum(r[1] for r in found.values()) >= 0.99 * total
    whole = multiindex.near_duplicates(df, cell_rows=8, chunk=16, recall=1).collect()
    assert {r.vec_id: tuple(r) for r in whole} == want


def test_walk_goes_by_distance():
    rng = np.random.default_rng(2)
    units = multiindex.unit_rows(rng.standard_normal((500, 12)))
    index = multiindex.fit(units, 6, recall=0.95)
    a, b = index.halves(units)
    for row, cells in enumerate(index.visits(units)):
        far = (a[row][:, None] + b[row]).ravel()
        within = np.sort(far[far <= far.min() + index.slack])
        assert cells[0] == index.cells(units)[row] and len(set(cells)) == len(cells)
        assert far[cells] == pytest.approx(within)


def test_links_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0], 0),
        (2, [2.0, 0.0, 0.0], 0),  # same direction
        (2, [2.0, 0.0, 0.0], 0),  # repeated row
        (3, [1.0, 0.0, 0.0], 1),  # other label
        (4, [1.0, 0.0, 0.0], None),
        (5, None, 0),
        (6, [], 0),
        (7, [0.0, 0.0, 0.0], 0),
        (8, [nan, 0.0, 0.0], 0),
        (9, [inf, 1.0, 0.0], 0),
        (10, [None, 1.0, 0.0], 0),
        (11, [1.0, 0.0], 0),  # other length
        (12, [1e300, 1e299, 0.0], 0),  # its square overflows
        (None, [0.99, 0.01, 0.0], 0),
        (None, [0.0, 0.0, 5.0], 2),
        (13, [1.0], 0),
        (14, [-0.0, 3.0, 0.0], 0),
        (15, [0.0, 3.0, 0.0], 0),
        (-4, [0.0, 3.0, 0.1], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    odd = df.select("*", *[F.lit(1).alias(c) for c in ("gid", "n", "key", "cell", "least", "links", "own")])
    want = plain_links(rows, 0.93)
    want = [(i, n, c, i == c) for i, n, c, _ in want]
    found = sorted(map(tuple, multiindex.near_duplicates(odd).collect()), key=str)
    assert found == want
    assert multiindex.near_duplicates(odd.filter("false")).count() == 0
    strings = multiindex.near_duplicates(
        df.select(F.col("vec_id").alias("i"), F.col("embedding").alias("e"), F.col("label").cast("string").alias("l")),
        "i", "e", "l",
    )
    assert sorted(map(tuple, strings.collect()), key=str) == want
