"""Pipeline operators against plain versions, exact round trips and held-out accuracy."""

import hashlib
import json
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter
from math import log, log10

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from riskfold.functions import scaling
from riskfold.llm import bpe, chat, fingerprint, html, langid, lm, mixing, search, simhash, tokenfile

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["_fp", "fp", "mask", "key", "count", "n", "best", "word", "row", "ids", "position", "_s", "_h", "range"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(1)
    words = ["the", "of", "Über", "ça", "l'été", "don't", "x1", "<|endoftext|>", "\x1c", "日本", "😀"]
    long = " ".join(rng.choice(words) for _ in range(6000))
    rows = [
        (1, "the cat sat on the mat and went home again", "en", "a", 1),
        (1, "the cat sat on the mat and went home again", "en", "a", 1),
        (2, "THE cat  sat on\tthe mat and went home again", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n　\t ", "de", "b", 4),
        (6, long, "fr", "a", 1),
        (7, long + " end", "fr", "a", 1),
        (8, "q" * 700 + " " + "ab" * 3000, "fr", None, 1),
        (None, "der Hund und die Katze sind nicht zu Hause", "de", "b", 1),
        (9, "12345 !!! ???", None, "c", 1),
        (10, "der Hund und die Katze sind nicht zu Haus", "de", "b", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


def sf_rows(spark, sf, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{table}.parquet").select(*columns).collect()]


# -------------------------------------------------------------- 1 fingerprints


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_of_the_table(spark, sf):
    docs = sorted(sf_rows(spark, sf, "documents", "doc_id", "text"), reverse=True)
    found = {r.doc_id: r for r in entry.queries()["op1_document_fingerprints"](spark, sf).collect()}
    assert len(found) == len(docs)
    for i, (name, text) in enumerate(docs):
        other, third = docs[(i + 1) % len(docs)][1], len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        r = found[name]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.n_chars == len(text)
        assert r.near_edited == pytest.approx(likeness(text, edited), abs=0.2)
        assert r.near_next == pytest.approx(likeness(text, other), abs=0.2)


def test_fingerprints_of_odd_rows(odd, none):
    found = fingerprint.neighbours(odd)
    rows = found.collect()
    assert len(rows) == odd.count() and fingerprint.neighbours(none).count() == 0
    assert all(r.fp == [] for r in rows if not r.text.strip(" \n\t"))
    same = [r.fp for r in rows if r.text.lower().startswith("the cat")]
    assert len(same) == 3 and same[0] == same[1] == same[2]
    last = next(r for r in rows if r.doc_id is None)  # ids without a number come last
    first = max((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id)
    third = len(last.text) // 3
    assert last.edited == last.text[: len(last.text) - third] + first.text[:third]


def test_merged_fingerprints_estimate_the_union(spark):
    texts = [" ".join(f"w{i}" for i in range(a, a + 3000)) for a in (0, 1500)]
    rows = spark.createDataFrame([("g", t) for t in texts], "g string, text string")
    parts = rows.select("g", fingerprint.fingerprint(F.col("text")).alias("fingerprint"))
    (one,) = fingerprint.merged(parts, ["g"]).collect()
    own = [r.fingerprint for r in parts.collect()]
    assert one.fingerprint == sorted(set(own[0]) | set(own[1]))[: fingerprint.K]
    a, b = parts.collect()
    pair = spark.createDataFrame([(a[1], b[1])], "a array<long>, b array<long>")
    n, inside = pair.select(
        fingerprint.distinct_shingles(F.col("a")), fingerprint.containment(F.col("a"), F.col("b"))
    ).first()
    assert n == pytest.approx(2996, rel=0.3) and inside == pytest.approx(0.5, abs=0.2)


# -------------------------------------------------------------- 2 HTML


@pytest.fixture(scope="module")
def crf():
    return html.train(html.labelled_pages(300), steps=80)


def test_unseen_layouts_are_labelled_well(crf):
    rng, right, n = random.Random(99), 0, 0
    for _ in range(150):
        blocks = html.leaf_blocks(html.labelled_page(rng))
        labels = crf.decode(html.features(blocks))
        right += sum(b.label == "main" == (b.label if x else "") or (b.label != "main" and not x) for b, x in zip(blocks, labels, strict=True))
        n += len(blocks)
    assert right / n > 0.97


def test_pages_of_the_table(spark, sf):
    found = {r.page_id: r for r in entry.queries()["op2_html_extraction"](spark, sf).collect()}
    import html as stdlib

    for page, markup in sf_rows(spark, sf, "pages", "page_id", "html"):
        article = re.search(r"<article>(.*?)</article>", markup, re.S)[1]
        blocks = (re.sub(r"<[^>]*>", " " if "<br>" in b else "", b) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n\n".join(x for b in blocks if (x := " ".join(stdlib.unescape(b).split())))
        assert found[page].text == want and found[page].n_chars == len(want)


def test_odd_pages(spark, crf):
    pages = [None, "", "<", "plain words only, no markup.", "<p>a<p>b</div></x><article><p>" + "Long words here. " * 20000, "<script>var x = '<p>no</p>'", "<a href='x>y"]
    rows = spark.createDataFrame([(i, p, "k") for i, p in enumerate(pages)], "page_id int, html string, text string")
    found = {r.page_id: r.text for r in html.extract(rows, crf).collect()}
    assert found[0] == found[1] == found[5] == "" and "Long words here." in found[4]
    assert html.extract(rows.filter("false"), crf).count() == 0


def test_pages_without_a_written_head_or_body():
    said = "<p>Hello there"
    for page in (
        f"<html><head><title>t</title>{said}",
        f"<html><head><title>t</title><meta charset=x><script>a<p>b</script>{said}</html>",
        f"<title>t</title>{said}",
        f"<html><head></head><body>{said}",
        "<html><head><title>t</title>Hello there",
    ):
        assert [b.text for b in html.leaf_blocks(page)] == ["Hello there"]


@pytest.mark.parametrize(
    "unit", ['<a x="', "<a ", "<a<", '<a "> ', "<!", "<p '>", "</", "<!--", "<script ", '">', "<b x='>\"", "<"]
)
def test_broken_pages_take_linear_time(unit):
    """Two MB of it; a pattern that looks for each end anew would take hours."""
    started = time.perf_counter()
    blocks = html.leaf_blocks("<div>" * 1000 + unit * (2_000_000 // len(unit)) + "<p>end</p>")
    assert time.perf_counter() - started < 60
    assert len(blocks) <= 2_000_000


def test_quotes_hide_the_end_of_a_tag():
    page = "<p title='a > b' x=\"'>\">one</p><p x=\"never closed>two</p>"
    assert [b.text for b in html.leaf_blocks(page)] == ["one", "two"]


def test_viterbi_finds_the_best_labelling(crf):
    rng = random.Random(5)
    blocks = html.features(html.leaf_blocks(html.labelled_page(rng)))[:9]

    def total(labels):
        score = sum(crf.weights.get(f, 0) for b, y in zip(blocks, labels, strict=True) if y for f in b)
        return score + sum(crf.turn[a][b] for a, b in zip(labels, labels[1:], strict=False))

    every = [[bool(k >> i & 1) for i in range(len(blocks))] for k in range(1 << len(blocks))]
    assert total(crf.decode(blocks)) == pytest.approx(max(map(total, every)))


# -------------------------------------------------------------- 3 mixing


def check_mixture(rows, shares, block):
    """Positions are 0..n-1, blocks of a source go up, and no source is a block off its flow."""
    rows = sorted(rows, key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(rows)))
    slots = {r.slot: str(r.source) for r in rows}
    order = [slots[s] for s in sorted(slots)]
    left = {k: -(-n // block) for k, n in Counter(str(r.source) for r in rows).items()}
    assert Counter(order) == left
    done = Counter()
    for t, k in enumerate(order, 1):
        done[k] += 1
        low, high = 0.0, max(left[j] / shares[j] for j in left)
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(shares[j] * mid, left[j]) for j in left) < t else (low, mid)
        assert all(abs(done[j] - min(shares[j] * high, left[j])) < 1 for j in left)


def test_mixture_stays_within_a_block_of_its_flow(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"),
    )
    weights = {"hot": 1, None: 5, "s0": 2, "s1": 2, "s2": 1, "s3": 3}
    mixed = mixing.mix(rows, weights, block_rows=8, slots=40).collect()
    assert len(mixed) == 3000
    shares = {str(k): v for k, v in mixing.whole_shares(weights, 40).items()}
    check_mixture(mixed, shares, 8)


def test_mixing_odd_rows(odd, none):
    mixed = mixing.mix(odd, block_rows=2)
    assert sorted(r.position for r in mixed.collect()) == list(range(odd.count()))
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"a": 1})


def test_mixing_query(spark, sf):
    found = entry.queries()["op3_pfair_mixing"](spark, sf).collect()
    sizes = Counter(r.source for r in found)
    assert sizes == Counter(x[0] for x in sf_rows(spark, sf, "documents", "source"))
    shares = mixing.whole_shares(mixing.tempered(dict(sorted(sizes.items()))), mixing.SLOTS)
    check_mixture(found, shares, mixing.BLOCK_ROWS)


# -------------------------------------------------------------- 4 token files


@pytest.mark.parametrize("n, top", [(1, 5), (100, 1), (2048, 49000), (5001, 49000), (9, (1 << 32) - 2)])
def test_coded_blocks_come_back(n, top):
    ids = np.random.default_rng(n).integers(0, top, n)
    lengths = [0, n // 3, n - n // 3]
    back = list(tokenfile.unpack_part(tokenfile.pack_part(lengths, ids)))
    assert [len(b) for b in back] == lengths and (np.concatenate(back) == ids).all()


def test_repeating_ids_shrink_and_damage_is_found():
    ids = np.tile(np.random.default_rng(0).integers(0, 49000, 100), 60)
    data = tokenfile.pack_part([len(ids)], ids)
    assert len(data) < len(ids) * 0.4
    damaged = bytearray(data)
    damaged[-20] ^= 1
    with pytest.raises(ValueError):
        list(tokenfile.unpack_part(bytes(damaged)))


def expected_tokens(rows):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array([*e.ids, 1], "<u4") for e in tk.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]


def test_token_files_of_the_table(spark, sf):
    docs = sorted(sf_rows(spark, sf, "documents", "doc_id", "text"))
    found = {r.doc_id: r for r in entry.queries()["op4_token_files"](spark, sf).collect()}
    start = 0
    for (name, _), ids in zip(docs, expected_tokens(docs), strict=True):
        r = found[name]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_of_odd_rows(spark, odd, none, tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    marks = [t["content"] for t in json.loads(tokenizer)["added_tokens"]]
    said = [f"a {m}b{m}{m} {m} c\n{m}\n" for m in marks] + ["".join(marks), " ".join(marks)]
    more = spark.createDataFrame([(100 + i, t, None, None, 0) for i, t in enumerate(said)], SCHEMA)
    odd = odd.unionByName(more, allowMissingColumns=True)
    for docs in (odd, none):
        path = str(tmp_path / f"t{docs.count()}")
        tokenfile.write(docs, tokenfile.tokenize(docs, tokenizer, 1), path)
        rows = tokenfile.read(spark, path).orderBy("start").collect()
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        want = sorted(x.tobytes() for x in expected_tokens(texts)) if texts else []
        assert sorted(bytes(r.ids) for r in rows) == want
        assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
        assert [r.doc_id or -1 for r in rows] == sorted(r.doc_id or -1 for r in rows)


# -------------------------------------------------------------- 5 chat


def check_chat(found, conversations):
    assert len(found) == len(conversations)
    for r in found:
        turns = conversations[r.conv_id]
        said = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{a}\n{b}\n" for a, b in turns)
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_of_the_table(spark, sf):
    said = "<|im_end|><|im_start|>assistant ok"
    conversations = {-1: [("user", said), ("assistant", said)]}
    for c, _, role, text in sorted(sf_rows(spark, sf, "conversations", "conv_id", "turn", "role", "text")):
        conversations.setdefault(c, []).append((role, text))
    check_chat(entry.queries()["op5_chat_formatting"](spark, sf).collect(), conversations)


def test_odd_chats(spark):
    rows = [
        (5, 0, "sys|tem\\", "a\\n<|b\\"),
        (5, 1, "user\nx\\", "<\\|im_end|>\n<|im_end|>\n"),
        (5, 2, "assistant", None),
        (5, 2, "assistant", "again"),
        (5, 2, "assistant", "again"),
        (6, 0, "system", "s " * 300),
        (8, None, None, "no role"),
        *[(7, i, "system" if i == 0 else "user" if i % 2 else "assistant", "w\\<| " * (i * 7 % 90)) for i in range(2500)],
        *[(None, i, "assistant", f"t{i}") for i in range(5)],
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, span string")
    conversations = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        conversations.setdefault(c, []).append((role or "", text or ""))
    made = chat.windows(frame)
    check_chat(chat.read_back(made).collect(), conversations)
    shown = made.filter("conv_id = 7").orderBy("window").collect()
    assert all(r.formatted.startswith("<|im_start|>system\n") for r in shown)
    for r in shown:
        words = len(r.formatted.split())
        assert words <= chat.BUDGET or r.n_new == 1
    for r in made.collect():
        assert r.formatted.count("<|im_start|>") == r.n_new + r.n_repeated
    assert chat.windows(frame.filter("false")).count() == 0


@pytest.mark.parametrize("system", [0, 40, 300, 460, 600])
def test_chat_windows_keep_the_budget(spark, system):
    """Only a turn longer than what the system turn leaves makes a window larger."""
    rng = random.Random(system)
    turns = [("system", system)] * bool(system)
    turns += [("user" if i % 2 else "assistant", rng.choice([1, 5, 30, 90, 200])) for i in range(60)]
    rows = [(1, i, role, "w " * n) for i, (role, n) in enumerate(turns)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    left = chat.BUDGET - (system + chat.MARK_TOKENS if system else 0)
    kept = made.select("*", chat.parsed(F.col("formatted")).alias("turns")).collect()
    assert sum(r.n_new for r in kept) == len(rows)
    for r in kept:
        costs = [len(t.text.split()) + chat.MARK_TOKENS for t in r.turns]
        assert r.turns[0].role == "system" or not system
        assert sum(costs) <= chat.BUDGET or r.n_new == 1 and costs[-1] > left and r.n_repeated <= bool(system)
    if system == 40:
        assert any(r.n_repeated > 1 for r in kept)


# -------------------------------------------------------------- 6 BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def check_bpe(rows, ranks):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows:
        want = np.array(own.encode_ordinary(r.text or ""), "<u4").tobytes()
        assert bytes(r.ids) == want and bytes(r.dec) == (r.text or "").encode()


def test_bpe_of_odd_rows(odd, none, ranks):
    for words in (bpe.MAX_WORDS, 3):
        found = bpe.encode(odd, ranks, public_tokenizers.PATTERN, decoded="dec", max_words=words)
        rows = found.withColumn("again", bpe.decode(F.col("ids"), ranks)).collect()
        assert len(rows) == odd.count() and all(r.again == r.dec for r in rows)
        check_bpe(rows, ranks)
    assert bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_the_table(spark, sf, ranks):
    docs = dict(sf_rows(spark, sf, "documents", "doc_id", "text"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in entry.queries()["op6_byte_level_bpe"](spark, sf).collect():
        ids = own.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


# -------------------------------------------------------------- 8 SimHash


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((of(i), of(j)))
                root[b] = a
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[of(i)] = min(name, least.get(of(i), name))
    return sorted((str(rows[i][0]), f"{fps[i]:016x}", str(least.get(of(i)))) for i in range(len(rows)))


def test_simhash_equals_all_pairs(spark, sf):
    rows = sf_rows(spark, sf, "documents", "doc_id", "text")
    found = entry.queries()["op8_simhash_near_dedup"](spark, sf).collect()
    assert sorted((str(a), b, str(c)) for a, b, c in found) == plain_components(rows)


@pytest.mark.parametrize("size", [2, 1024])
def test_simhash_of_odd_rows(odd, none, size):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = simhash.near_duplicates(odd, shard_size=size).collect()
    assert sorted((str(a), b, str(c)) for a, b, c in found) == plain_components(rows)
    kept = [r.doc_id for r in simhash.deduplicate(odd).collect()]
    assert len(kept) == len(set(kept)) == len({c for *_, c in plain_components(rows)})
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0


def test_dense_shards_are_split_without_loss(spark):
    """Thousands of fingerprints within few bits of each other, above the shard size."""
    rng = random.Random(3)
    values = {sum(1 << b for b in rng.sample(range(64), 2)) ^ (0xABCDEF << rng.choice((0, 30))) for _ in range(1500)}
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = simhash.components(simhash.links(fps, 2, shard_size=50)).collect()
    unsigned = sorted(values)
    want = simhash.spanning_links(unsigned, 2)
    assert {r.node & (1 << 64) - 1 for r in found} == {x for pair in want for x in pair}
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node & (1 << 64) - 1)
    plain = {}
    for v, root in want:
        plain.setdefault(root, {root}).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


# -------------------------------------------------------------- 9 language


def test_held_out_languages_are_found(spark, sf):
    truth = dict(sf_rows(spark, sf, "documents", "doc_id", "lang"))
    found = entry.queries()["op9_language_id"](spark, sf).collect()
    assert len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_of_odd_rows(odd, none):
    model = langid.learn(odd)
    rows = langid.identify(odd, model).collect()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
    assert {r.lang_pred for r in rows if r.doc_id == 10} == {"de"}
    assert langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.learn(none)).collect()} == {"und"}


def test_bundles_do_not_depend_on_the_batch():
    texts = ["abc def", None, "Ünï x", "", "日本語 text", "aa"]
    whole = langid.bundles(texts, 64, 3)
    for t, v in zip(texts, whole, strict=True):
        assert (langid.bundles([t], 64, 3)[0] == v).all()


# -------------------------------------------------------------- 10 language model


def test_base_scores_and_the_model_gains(spark, sf):
    docs = sf_rows(spark, sf, "documents", "doc_id", "text")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + ["\n"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, kinds = sum(c.values()), len(c)
    found = entry.queries()["op10_lm_scoring"](spark, sf).collect()
    assert len(found) == len(docs)
    for r in found:
        ws = words[r.doc_id]
        base = sum(log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(ws), total)
        assert r.n_known == sum(w in c for w in ws)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out)


def test_model_probabilities_sum_to_one():
    pairs = np.random.default_rng(0).integers(0, 50, (30, 30)).astype(float)
    table = lm.log_probabilities(*lm.train(pairs, dim=8, steps=60))
    assert np.allclose((10**table).sum(axis=1), 1)
    uniform = (pairs * log10(1 / 30)).sum()
    assert (pairs * table).sum() > uniform


def test_lm_of_odd_rows(odd, none):
    vocab = lm.word_counts(odd.select("text"))
    model = lm.learn(odd.select("text"), vocab, frequent=5, words=3, endings=2)
    rows = lm.score(odd, model, vocab).collect()
    assert len(rows) == odd.count()
    assert all(r.n_tokens == r.n_known and r.score < 0 for r in rows)
    assert lm.score(none, model, vocab).count() == 0
    nothing = lm.word_counts(none.select("text"))
    bare = lm.learn(none.select("text"), nothing)
    assert all(r.base_score == pytest.approx(0) for r in lm.score(odd, bare, nothing).collect())


# -------------------------------------------------------------- pipeline


def test_pipeline_equals_a_plain_version(spark, sf, ranks):
    docs = sf_rows(spark, sf, "documents", "doc_id", "text", "source")
    lettered = [d for d in docs if any(ch.isalpha() for ch in d[1] or "")]
    keep = {int(c) for *_, c in plain_components([d[:2] for d in lettered])}
    texts = {d[0]: d[1] for d in docs}
    found = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(keep)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in found:
        assert bytes(r.ids) == np.array(own.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = stage(spark, docs, "")
            if i < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
        rows = docs.collect()
        assert len({r.doc_id for r in rows}) == len(rows)


# -------------------------------------------------------------- 7 search


def plain_search(rows, queries, k=10):
    """BM25 of every row, from the words themselves."""
    white = re.compile("[ \t\n\v\f\r]+")

    def words(text):
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        return Counter(w for w in white.split(lowered) if w)

    counts = [(i, words(t)) for i, t in rows]
    df = Counter(w for _, c in counts for w in c)
    mean = sum(c.total() for _, c in counts) / max(len(rows), 1)
    out = {}
    for q, text in queries:
        scored = []
        for i, c in counts:
            norm = 1.2 * (0.25 + 0.75 * c.total() / mean)
            met = [(w, n) for w, n in words(text).items() if w in c]
            s = sum(n * log((len(rows) + 1) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w, n in met)
            if met:
                scored.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def check_hits(found, expected, k=10):
    by_query = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert set(by_query) == {q for q, hits in expected.items() if hits}
    for q, hits in by_query.items():
        assert [round(s, 6) for _, s in hits] == [round(s, 6) for _, s in expected[q]]
        last = round(hits[-1][1], 6)
        for of in (hits, expected[q]):
            of[:] = sorted((i for i, s in of if round(s, 6) > last), key=str)
        assert hits == expected[q]


def test_search_equals_scoring_all_rows(spark, sf, monkeypatch):
    docs = sf_rows(spark, sf, "documents", "doc_id", "text")
    asked = [d for d in docs if d[0] % 50 == 0]
    expected = plain_search(docs, asked)
    check_hits(entry.queries()["op7_exact_top_k"](spark, sf).collect(), expected)


def test_search_in_small_shards_and_blocks(spark, sf):
    docs = sf_rows(spark, sf, "documents", "doc_id", "text")
    asked = spark.createDataFrame([(1, docs[0][1][:60]), (2, docs[1][1]), (3, "nowhere-to-be-found")], "doc_id long, text string")
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).cache()
    found = search.search(index, asked, k=3, query_terms=20).collect()
    check_hits(found, plain_search(docs, [tuple(r) for r in asked.collect()], 3), 3)


def test_search_of_odd_rows(odd, none):
    rows = [(i, t) for i, t in odd.select("doc_id", "text").collect()]
    found = search.search(search.build(odd), odd.filter("doc_id = 1"), k=4).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r.rank)][:3] == [1, 1, 2]
    assert len(found) == 4 and len(rows) == 12
    assert search.search(search.build(none), odd).count() == 0
    assert search.search(search.build(odd), none).count() == 0
    repeated = odd.filter("doc_id = 1 or doc_id is null").withColumn("doc_id", F.lit(1))
    found = search.search(search.build(odd), repeated, k=2).collect()
    assert len({r.query_hash for r in found}) == 2 and len(found) == 4
    unnamed = search.search(search.build(odd), odd.filter("doc_id is null"), k=2).collect()
    assert [r.doc_id for r in sorted(unnamed, key=lambda r: r.rank)] == [None, 10]
    assert {r.query_id for r in unnamed} == {None}


@pytest.mark.parametrize("rows, words", [(900, 40), (3000, 400)])
def test_shards_equal_scoring_all_their_rows(monkeypatch, rows, words):
    monkeypatch.setattr(search, "FIRST", 16)
    rng = random.Random(rows)
    names = [f"w{i}" for i in range(words)]
    odds = [1 / (i + 1) for i in range(words)]
    texts = [" ".join(rng.choices(names, odds, k=rng.randrange(0, 60))) for _ in range(rows)]
    texts[5] = texts[77] = texts[rows - 1]
    hashes = search.Hashes()
    counts = [search.term_counts(t) for t in texts]
    raw = search._shard(list(range(rows)), [hashes.of(c) for c in counts])
    mean = sum(c.total() for c in counts) / rows
    shard = search.Shard(*raw[:4], np.array(raw[4]), raw[5], mean)
    assert shard.dense
    df = Counter(t for c in counts for t in c)
    for k in (1, 3, 10):
        for q in range(0, rows, rows // 20):
            asked = sorted((hashes[t], n * log((rows + 1) / (df[t] + 0.5))) for t, n in counts[q].items())
            terms, weights = np.array([t for t, _ in asked], np.int64), np.array([w for _, w in asked])
            expected = plain_search(list(enumerate(texts)), [(q, texts[q])], k)[q] if k == 3 and q < rows // 4 else None
            found, scores = shard.search(terms, weights, k)
            place = np.searchsorted(shard.terms, terms)
            shard.asked[place] = weights
            whole = shard._scores(np.arange(rows))
            shard.asked[place] = 0
            best = np.lexsort((shard.ids, -whole))[:k]
            best = best[whole[best] > 0]
            assert found.tolist() == best.tolist() and scores.tolist() == whole[best].tolist()
            if expected is not None:
                assert [round(s, 6) for s in scores] == [round(s, 6) for _, s in expected]


def test_a_shard_holds_few_bytes_a_posting():
    rows, terms = 4000, 40_000
    rng = np.random.default_rng(3)
    raw = search._shard(
        list(range(rows)),
        [(np.sort(rng.choice(terms, 150, False)), np.ones(150, np.int32)) for _ in range(rows)],
    )
    postings = rows * 150
    tracemalloc.start()
    shard = search.Shard(*raw[:4], np.array(raw[4]), raw[5], 150.0)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert shard.n == rows and held < 35 * postings and most < 45 * postings


def test_shards_of_a_file_are_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scaling, "shared_dir", lambda _: str(tmp_path))
    back = scaling.written(spark.range(0, 5, 1, 1), "index", **search.FILES)
    (file,) = tmp_path.glob("index-*/*.parquet")
    assert pq.ParquetFile(file).num_row_groups == 5 and back.count() == 5


def test_bpe_numbers_hold_a_word_once():
    """A word that is one piece is not held a second time as a piece, in whichever order they come."""
    known = bpe._Numbers(bpe.regex.compile(public_tokenizers.PATTERN))
    codes = [known[w] for w in (" one,", " one", " two", " two,", " one")]
    assert codes == [0, 1, 2, 3, 1]
    assert known.new_pieces == [" one", ",", " two"]
    assert known.new_codes == [0, 1, 0, 2, 2, 1] and known.new_words == [2, 1, 1, 2]
    assert set(known.pieces) == {" one", ","}
