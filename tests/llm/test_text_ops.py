"""Packing, token files, decontamination and quality rules against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, frame, odd_docs

from tidemark.llm import contamination, packing, quality, token_files
from tidemark.llm.subwords import tokenizer_path


def ids_of(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return {d: t.encode(x or "", add_special_tokens=False).ids + [end] for d, x, *_ in odd_docs()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pack(spark):
    want = ids_of("word_bpe_49k.json", 1)
    rows = packing.pack(frame(spark), tokenizer_path("word_bpe_49k.json"), window=256).collect()
    seen = {}
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.start == seen.get(r.doc_id, 0) and r.length > 0
        assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        seen[r.doc_id] = r.start + r.length
        fill[r.sequence_id] += r.length
    assert seen == {d: len(i) for d, i in want.items()}
    assert sorted(fill) == list(range(len(fill))) and all(fill[s] == 256 for s in sorted(fill)[:-1])
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length


@pytest.mark.parametrize("ranks", [[], [0], [255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], list(range(1000))])
def test_codes(ranks):
    c, d = token_files.encode_ranks(np.array(ranks, np.uint32))
    assert token_files.decode_ranks(c, d, len(ranks)).tolist() == ranks


def test_token_files(spark):
    want = ids_of("byte_bpe_50k.json", 2)
    rows = {r.doc_id: r for r in token_files.round_trip(frame(spark), tokenizer_path("byte_bpe_50k.json")).collect()}
    at = 0
    for d in sorted(want):
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(want[d]), crc(want[d]))
        at += len(want[d])
    assert len(rows) == len(want)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert packing.pack(none, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert token_files.round_trip(none, tokenizer_path("byte_bpe_50k.json")).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination.decontaminate(none, bench).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(none, quality.train(none, labels)).count() == 0
    assert all(not r.contaminated and r.n_items == 0 for r in contamination.decontaminate(frame(spark), bench).collect())


def plain_words(x):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def items():
    d = dict((r[0], r[1]) for r in odd_docs())
    return [(1, " ".join(d[204].split()[100:130])), (2, "single"), (10, None), (3, "; "), (4, " ".join(d[100].split()[:20])), (4, "A b"), (5, " ".join(d[7].split()[-13:]))]


@pytest.mark.parametrize("most_bytes", [1 << 20, 60])
def test_decontaminate(spark, most_bytes):
    windows = {}
    for item, text in items():
        w = plain_words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    rows = {r.doc_id: r for r in contamination.decontaminate(frame(spark), spark.createDataFrame(items(), "item_id long, text string"), most_bytes=most_bytes).collect()}
    hits = 0
    for d, text, *_ in odd_docs():
        w = plain_words(text)
        hit, found = set(), set()
        for key, own in windows.items():
            for i in range(len(w) - len(key) + 1):
                if tuple(w[i : i + len(key)]) == key:
                    hit |= set(range(i, i + len(key)))
                    found |= own
        r = rows[d]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found)), d
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
        hits += len(hit) > 0
    assert hits > 5


def plain_proximity(w, terms, rare, slop):
    """First and last word of each match: `rare` is the term that leads, each other is taken at its first fitting place."""
    out = set()
    for p, x in enumerate(w):
        if x != terms[rare]:
            continue
        places = [p]
        for j, t in enumerate(terms):
            if j != rare:
                near = [i for i in range(max(0, p - rare + j - slop), min(len(w), p - rare + j + slop + 1)) if w[i] == t]
                places += near[:1] or [None]
        if None not in places:
            out.add((min(places), max(places) + 1))
    return out


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_proximity(spark, slop):
    rng = random.Random(slop)
    texts = ["one two x", "three four", "one two X three", "one two three", "three one two", "", None, "two", "three"]
    texts += [" ".join(rng.choice(["one", "two", "three", "x", "y"]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    terms = ["one", "two", "three"]
    counts = Counter(w for t in texts for w in plain_words(t))
    rare = min(range(3), key=lambda j: counts[terms[j]])  # of the whole segment, as all texts lie in one
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    rows = contamination.matches(docs, spark.createDataFrame([(7, "one two three")], "item_id long, text string"), 3, slop).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_proximity(plain_words(texts[r.doc_id]), terms, rare, slop)
        spans = np.frombuffer(r.spans or b"", "<i8").reshape(-1, 2).tolist()
        assert {tuple(s) for s in spans} == want, texts[r.doc_id]
        assert r["items"] == (["7"] if want else [])
    assert not rows[0]["items"] and not rows[1]["items"]


def plain_counts(x):
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    lines = [s for s in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    docs = [*odd_docs(), (300, "a b c a b c\n a b c\n\na b c # | x\n", None, None, None), (301, "x x x x", None, None, None)]
    counts, x = quality.statistics(pa.array([d[1] for d in docs], pa.utf8()))
    for i, d in enumerate(docs):
        assert tuple(int(counts[c][i]) for c in quality.COUNTS) == plain_counts(d[1]), d[0]
    assert np.isfinite(x).all()
    labels = spark.createDataFrame([(d[0], i % 2, 0) for i, d in enumerate(docs)] * 2 + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    df = frame(spark, docs)
    out = quality.judge(df, quality.train(df, labels)).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_trees_learn_and_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(4000) < 0.05)).astype(float)
    t = quality.fit(x[:3000], y[:3000], [-1, 1, 0])
    assert ((t.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.9
    grid = np.linspace(0, 1, 50)
    for f, sign in ((0, -1), (1, 1)):
        probe = np.repeat(x[:20], 50, 0)
        probe[:, f] = np.tile(grid, 20)
        assert (sign * np.diff(t.score(probe).reshape(20, 50), axis=1) >= -1e-12).all()


def test_node_arrays_are_the_trees():
    rng = np.random.default_rng(1)
    x = rng.random((500, 3))
    t = quality.fit(x, (x[:, 0] + 0.3 * rng.random(500) < 0.6).astype(float), [-1, 0, 1], rounds=12)

    def walk(row):
        total = t.bias
        for root in t.roots:
            at = root
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.limit[at] else t.right[at]
            total += t.value[at]
        return total

    assert len(t.roots) == 12 and np.allclose(t.margin(x), [walk(r) for r in x])


def test_quality_verdict_is_the_walk(spark):
    """kept, by a plain walk of the trees over plain counts; rows that share a labelled id train once."""
    docs = [*odd_docs(), *((400 + i, " ".join(f"w{(i * j) % 17}" for j in range(60)), None, None, None) for i in range(80))]
    labels = spark.createDataFrame([(d[0], int(d[0] % 3 > 0), 0) for d in docs], "doc_id long, quality int, toxic int")
    df = frame(spark, docs)
    model = quality.train(df, labels)
    twice = quality.train(df.unionByName(df), labels)
    assert all(np.array_equal(getattr(model, k), getattr(twice, k)) for k in ("feature", "limit", "left", "right", "value"))
    _, x = quality.statistics(pa.array([d[1] for d in docs], pa.utf8()))
    rows = {r.doc_id: r for r in quality.judge(df, model).collect()}
    for d, features in zip(docs, x, strict=True):
        margin = model.bias
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if features[model.feature[at]] <= model.limit[at] else model.right[at]
            margin += model.value[at]
        r = rows[d[0]]
        assert abs(r.score - 1 / (1 + np.exp(-margin))) < 1e-12
        assert r.kept == (not r.base_failed and r.score >= model.threshold)
