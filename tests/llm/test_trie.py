"""Conversation prefix trie against a plain trie of tuples."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskfold.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    """All nodes, from prefixes held as tuples. ``rows``: conv_id, turn, role, text."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            size = len(text.encode())
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, size, role, text))
    own = {c: [(r[4], r[5]) for r in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in own.items():
        h = crc32(str(conv).encode()) % 9
        path = tuple(own.get(conv - conv % 5, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
        ends[path].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        own_saving = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves = sum(below[c][0] for c in children[node]) or 1
        below[node] = leaves, own_saving + sum(below[c][1] for c in children[node])
        ids = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        out.append(
            (min(members[node]), len(node), parent, len(members[node]), len(children[node]), *below[node])
            + (hashlib.sha256(ids.encode()).hexdigest(),)
        )
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_trie_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = collected(entry.queries()["op13_conversation_prefix_trie"](spark, sf))
    assert found == plain_trie([tuple(r) for r in rows.collect()])


def family(seed, convs=60):
    """Conversations over few texts: deep sharing, prefixes of each other, many equal ones."""
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.choice([0, 1, 2, 3, 9, 12])):
            rows.append((conv * 3 - 20, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bé"])))
    return rows


@pytest.mark.parametrize("sequences", [2, 5])
def test_spines_merge_over_levels(spark, sequences, monkeypatch):
    """Tiny shards: several levels, every node on some spine."""
    monkeypatch.setattr(trie, "SHARD_SEQUENCES", sequences)
    monkeypatch.setattr(trie, "LEAST_SEQUENCES", sequences)
    rng = random.Random(sequences)
    paths = {tuple(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(150)}
    rows = []
    for conv, path in enumerate(sorted(paths, key=lambda p: rng.random())):
        records = [hashlib.md5(t.encode()).digest() + (3).to_bytes(8, "big") for t in path]
        rows.append((b"".join(records), 2, conv * 2, f"{conv:064x}"))
    rows.sort()

    def solve(rows, level):
        """The levels as ``nodes`` runs them, on lists."""
        out, up = [], []
        last = len(rows) <= sequences
        step = len(rows) if last else max(3, sequences)
        for at in range(0, len(rows), step):
            paths, adds = zip(*rows[at : at + step])
            for r in trie.encoded(list(paths), list(adds), level, last).to_pylist():
                if r["path"] is None:
                    out.append(r)
                else:
                    up.append((r["path"], np.frombuffer(r["adds"], trie.ADDS)))
        return out if last else out + solve(up, level + 1)

    found = solve([(p, trie.end_only(0, *more)) for p, *more in rows], 0)
    whole = trie.encoded([r[0] for r in rows], [trie.end_only(0, *r[1:]) for r in rows], 0, True).to_pylist()
    names = {r["node"]: r["conv_id"] for r in found if r["node"]}
    assert len({r["node"] for r in found if r["node"]}) == sum(r["node"] is not None for r in found)
    for r in found:
        if r["parent"]:
            r["parent_conv_id"] = names[r["parent"]]
    want = sorted((tuple(r[c] for c in COLUMNS) for r in whole), key=str)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=str) == want


def test_trie_of_odd_rows(spark, monkeypatch):
    """Nulls, empty and long texts, equal turns, repeated rows, negative ids, small shards."""
    monkeypatch.setattr(trie, "SHARD_SEQUENCES", 16)
    rows = family(1) + [(c + 3000, t, r, x) for c, t, r, x in family(1)]
    rows += [(7, None, None, None), (7, 0, "user", ""), (7, 0, "user", ""), (7, 0, "", "user")]
    rows += [(None, 0, "user", "lost"), (500, 1, "user", "x" * 300_000), (501, 1, "user", "x" * 300_000)]
    rows += [(505, t, "user", "deep") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    odd = df.select("*", *[F.lit(1).alias(c) for c in ("path", "base", "cut", "head", "n", "least", "node", "depth")])
    # turns with equal numbers go by digest, as in the plain version
    assert collected(trie.prefix_trie(odd)) == plain_trie(rows)
    assert trie.prefix_trie(odd.filter("false")).count() == 0


def test_findclose_matches_a_stack():
    rng = random.Random(4)
    for n in (1, 2, 40, 3000):
        bits, opened = [True], 1
        for _ in range(n):
            up = opened == 1 or rng.random() < 0.5
            bits.append(up)
            opened += 1 if up else -1
        bits += [False] * opened
        stack, want = [], {}
        for at, bit in enumerate(bits):
            if bit:
                stack.append(at)
            else:
                want[stack.pop()] = at
        tree = trie.Parentheses(np.array(bits))
        at = np.flatnonzero(bits)
        assert tree.findclose(at).tolist() == [want[i] for i in at.tolist()]
