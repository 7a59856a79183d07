"""Suffix and near-duplicate operators against plain versions on odd documents, and on many alike ones."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import frame, odd_docs, words

from tidemark.llm import near_dup, suffix_dedup


def plain_suffix(docs, size=50):
    seen, out = {}, {}
    raw = [(d if d is not None else 1 << 62, (t or "").encode(), d) for d, t, *_ in docs]
    for key, x, _ in raw:
        for i in range(len(x) - size + 1):
            seen[x[i : i + size]] = min(seen.get(x[i : i + size], 1 << 62), key)
    for key, x, d in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - size + 1):
            if seen[x[i : i + size]] < key:
                gone[i : i + size] = True
        left = bytes(np.frombuffer(x, np.uint8)[~gone])
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(x) else 0
        out[d] = (len(x), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def alike_docs(seed):
    """Many near copies of a few texts, a passage that all share, binary zeros, and long repeats of one byte."""
    rng = random.Random(seed)
    passage = words(rng, 14)
    out = []
    for i in range(120):
        base = words(random.Random(i % 5), 60).split()
        for _ in range(rng.randint(0, 12)):
            base[rng.randrange(60)] = rng.choice(["x", "yy", "zzz"])
        at = rng.randrange(60)
        out.append((i * 3, " ".join(base[:at] + ([passage] if i % 2 else []) + base[at:]), None, None, None))
    out += [(1, "a" * 400, None, None, None), (2, "a" * 60 + "b", None, None, None), (4, "b" + "\0a" * 60, None, None, None), (5, "\0a" * 40, None, None, None), (7, "\1a" * 40, None, None, None), (None, out[0][1], None, None, None)]
    return out


@pytest.mark.parametrize("docs", [odd_docs(), alike_docs(1)], ids=["odd", "alike"])
def test_suffix(spark, docs):
    want = plain_suffix(docs)
    rows = suffix_dedup.dedup(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
    assert sum(v[1] for v in want.values()) > 500


def test_suffix_equal_ids(spark):
    text = words(random.Random(3), 30)
    rows = suffix_dedup.dedup(frame(spark, [(5, text, None, None, None)] * 3 + [(9, text, None, None, None)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(5, 0)] * 3 + [(9, len(text.encode()))]


def test_suffix_order():
    rng = np.random.default_rng(1)
    for top in (1, 2, 256):
        sizes = rng.integers(0, 90, 40)
        data = rng.integers(0, top, sizes.sum()).astype(np.uint8)
        shard = suffix_dedup.Shard(data, sizes)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        whole = [(data[i : edge[k + 1]].tobytes(), k) for k in range(len(sizes)) for i in range(edge[k], edge[k + 1] + 1)]
        assert shard.order.tolist() == sorted(range(len(whole)), key=lambda i: (whole[i][0], i))


@pytest.mark.parametrize("top", [1, 2, 4, 256])
def test_interleave_is_the_order_of_strings(top):
    rng = np.random.default_rng(top)
    sizes = rng.integers(50, 90, 60)
    data = rng.integers(0, top, sizes.sum()).astype(np.uint8)
    data[sizes[:7].sum() : sizes[:9].sum()] = data[: sizes[7] + sizes[8]]
    edge = np.concatenate([[0], np.cumsum(sizes)])
    for shards in ([(0, 60)], [(0, 7), (7, 30), (30, 31), (31, 60)]):
        at, interval = suffix_dedup.interleave(data, sizes, shards, 50)
        text = [data[i : i + 50].tobytes() for i in at.tolist()]
        assert sorted(at.tolist()) == [i for k in range(60) for i in range(edge[k], edge[k + 1] - 49)]
        assert text == sorted(text) and [x == y for x, y in zip(text, text[1:], strict=False)] == (np.diff(interval) == 0).tolist()


def test_suffix_in_a_tree(spark, monkeypatch):
    """Units of a few documents, merged in a tree of several levels."""
    monkeypatch.setattr(suffix_dedup, "UNIT_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "LOT", 2)
    docs = alike_docs(5) + odd_docs()[:12]
    docs = [(i * 7 % 1009, *d[1:]) for i, d in enumerate(docs)]
    rows = suffix_dedup.dedup(frame(spark, docs).repartition(4)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == plain_suffix(docs)


def test_suffix_of_long_runs(spark):
    """Texts over the borders of slices: one byte, a short period, and a passage across a border."""
    n = 9 << 20
    passage = words(random.Random(1), 60)
    long = "a" * n + passage + "xyz" * 1000
    docs = [(1, long, None, None, None), (2, "a" * 300, None, None, None), (3, "b" + passage + "c", None, None, None), (0, "a" * 49, None, None, None), (4, "zxy" * 40, None, None, None), (5, "A" * n, None, None, None), (6, "A" * 60, None, None, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup(frame(spark, docs)).collect()}
    size = len(passage.encode())
    assert got == {0: (49, 0, 0), 1: (n + size + 3000, 0, 0), 2: (300, 300, 1), 3: (size + 2, size, 1), 4: (120, 120, 1), 5: (n, 0, 0), 6: (60, 60, 1)}


def plain_near(docs, percent=80):
    sets = {}
    for d, t, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} - {()}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {d: (len(sets[d]), top(d), top(d) == d) for d in ids}


@pytest.mark.parametrize("docs", [odd_docs(), alike_docs(2)[:-1]], ids=["odd", "alike"])
def test_near(spark, docs):
    rows = near_dup.near_duplicates(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == plain_near(docs)


def test_near_null_and_equal_ids(spark):
    text = words(random.Random(3), 30)
    docs = [(None, text, None, None, None), (4, text, None, None, None), (4, text, None, None, None), (6, text, None, None, None)]
    rows = near_dup.near_duplicates(frame(spark, docs)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (4, 4, True), (4, 4, True), (6, 4, False)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(900, 1000), (901, 1000)], "a long, b long")
    got = {r.v: r.component for r in near_dup.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1000] == 900 and got[901] == 900


def test_empty(spark):
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
