"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from numpy over whole columns of bytes. The trees are fitted on the driver on at most `sample`
labelled documents (those whose id hashes lowest), with histogram splits, second-order leaf values and monotonic
constraints, then flattened into node arrays; tasks score all documents at once by stepping down these arrays.

Defined results: a null or empty text has no words and fails the base rules; without labels of both kinds the
trees reject nothing; repeated rows are judged each, and of rows that share a labelled id the one whose statistics come
first trains; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, SMALL_BATCHES, batches, settings, stored, texts, tidy, utf8, word_array, word_hashes, word_spans

SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
DIGITS = np.isin(np.arange(256), [ord(c) for c in "0123456789"])
UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
PUNCT = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"])

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Model inputs; -1: more of it never raises the score, 1: never lowers it, 0: free.
FEATURES = {"log_words": 0, "word_len": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "distinct_words": 0, "top_word": -1, "line_words": 0, "digits": 0, "upper": 0, "punct": 0, "lines": 0}
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def _per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return np.diff(sums[offs]).astype(np.int64)


def repeated_words(codes: np.ndarray, doc: np.ndarray, distinct: int) -> np.ndarray:
    """Which words lie in a three-word window that their document holds twice or more."""
    hit = np.zeros(len(codes), bool)
    if len(codes) < 3:
        return hit
    if distinct >= 1 << 21:
        pair = np.unique(codes[:-1] * distinct + codes[1:], return_inverse=True)[1]
        key = pair[:-1] * distinct + codes[2:]
    else:
        key = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    at = np.flatnonzero(doc[:-2] == doc[2:])
    key, owner = key[at], doc[at]
    order = np.argsort(key, kind="stable")  # equal windows stay in order of their documents
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = at[twice]
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return hit


def statistics(col: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts of each text, and the matrix of model inputs."""
    data, offs = utf8(col)
    k = len(offs) - 1
    starts, ends = word_spans(data, offs, "space")
    doc = np.searchsorted(offs, starts, side="right") - 1
    n = np.bincount(doc, minlength=k)
    codes, distinct = word_hashes(word_array(data, starts, ends))
    code_points = (data & 0xC0) != 0x80
    chars = _per_row(code_points & WORD["space"][data], offs)
    repeat = np.bincount(doc[repeated_words(codes, doc, max(1, len(distinct)))], minlength=k)
    # lines: cut at \n and at row borders; only those with a word count
    cut = np.zeros(len(data) + 1, bool)
    cut[np.flatnonzero(data == 0x0A) + 1] = True
    cut[offs] = True
    ls = np.flatnonzero(cut)[:-1] if len(data) else np.zeros(0, np.int64)
    le = np.append(ls[1:], len(data)) if len(ls) else ls
    if len(ls):
        le = le - (data[le - 1] == 0x0A)
        worded = np.searchsorted(starts, ls) < np.searchsorted(starts, np.maximum(le, ls))
        ls, le = ls[worded], le[worded]
    line_doc = np.searchsorted(offs, ls, side="right") - 1
    line_codes, line_distinct = word_hashes(word_array(data, ls, le))
    lines = np.bincount(line_doc, minlength=k)
    dup = lines - np.bincount(np.unique(line_doc * max(1, len(line_distinct)) + line_codes) // max(1, len(line_distinct)), minlength=k)
    counts = dict(zip(COUNTS, (n, chars, _per_row(SYMBOLS[data], offs), dup, repeat), strict=True))
    pair, times = np.unique(doc * max(1, len(distinct)) + codes, return_counts=True)
    of = pair // max(1, len(distinct))
    top = np.zeros(k, np.int64)
    np.maximum.at(top, of, times)
    some, all_chars = np.maximum(n, 1), np.maximum(_per_row(code_points, offs), 1)
    x = np.column_stack([
        np.log1p(n), chars / some, counts["n_symbols"] / all_chars, dup / np.maximum(lines, 1), repeat / some, np.bincount(of, minlength=k) / some, top / some,
        n / np.maximum(lines, 1), _per_row(DIGITS[data], offs) / all_chars, _per_row(UPPER[data], offs) / all_chars, _per_row(PUNCT[data], offs) / some, np.log1p(lines),
    ])
    return counts, x


@dataclass
class Trees:
    """Flattened trees: node arrays of all trees, and the root of each. A leaf points to itself."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    threshold: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: int = 20) -> Trees:
    """Boosted trees for P(y = 1). signs: the monotonic constraint of each column."""
    p0 = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    t = Trees(*(np.zeros(0, d) for d in (np.int64, float, np.int64, np.int64, float)), np.zeros(0, np.int64), depth, float(np.log(p0 / (1 - p0))))
    if not len(y) or y.min() == y.max():
        return t
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    margin = np.full(len(y), t.bias)
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, left: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, None)
        for f in range(x.shape[1]) if left and len(rows) >= 2 * least else ():
            b, size = binned[rows, f], len(edges[f]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gr, hr, nr = g[rows].sum() - gs, h[rows].sum() - hs, len(rows) - ns
            if not len(gs):
                continue
            vl, vr = np.clip(-gs / (hs + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = -(gs * vl + 0.5 * (hs + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2)
            gain[(ns < least) | (nr < least) | (signs[f] * (vr - vl) < 0)] = -np.inf
            k = int(np.argmax(gain))
            base = -(g[rows].sum() * value + 0.5 * (h[rows].sum() + ridge) * value**2)
            if gain[k] - base > best[0]:
                best = (gain[k] - base, (f, k, vl[k], vr[k]))
        if best[1]:
            f, k, vl, vr = best[1]
            goes = binned[rows, f] <= k
            mid = (vl + vr) / 2
            ll, lh, rl, rh = low, high, low, high
            if signs[f] > 0:
                lh, rl = mid, mid
            elif signs[f] < 0:
                ll, rh = mid, mid
            a = grow(rows[goes], left - 1, ll, lh, g, h)
            c = grow(rows[~goes], left - 1, rl, rh, g, h)
            nodes[me][:4] = [f, edges[f][k], a, c]
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), depth, -4.0, 4.0, p - y, p * (1 - p)))
        a = np.array(nodes[roots[-1] :], float)
        t1 = Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int) - roots[-1], a[:, 3].astype(int) - roots[-1], a[:, 4], np.zeros(1, int), depth, 0.0)
        margin += t1.margin(x)
    a = np.array(nodes, float)
    return Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), depth, t.bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, spare: float = 0.002) -> Trees:
    """Trees from labelled documents. threshold: at most 0.5, and so low that `spare` of the good ones held out fall below it."""
    by_hash = F.xxhash64(F.col("doc_id").cast("long"))
    few = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).orderBy(by_hash, "doc_id").limit(sample)

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            _, x = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    rows = texts(docs).join(F.broadcast(few), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    rows = rows.mapInArrow(measure, "doc_id long, quality int, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("least")).select("doc_id", "least.*")  # `sample` rows
    with settings(docs.sparkSession, SMALL_BATCHES):
        rows = rows.toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    y = (rows["quality"].to_numpy() > 0).astype(float)
    signs = list(FEATURES.values())
    held = np.arange(len(y)) % 5 == 4
    first = fit(x[~held], y[~held], signs)
    good = first.score(x[held & (y > 0)]) if len(first.roots) else np.zeros(0)
    out = fit(x, y, signs)
    out.threshold = float(min(0.5, np.quantile(good, spare))) if len(good) else 0.0
    return out


@tidy
def judge(docs: DataFrame, model: Trees, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Every document with its counts, base_failed, the trees' score and kept."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            counts, x = statistics(b.column("text"))
            failed = (counts["n_words"] < least_words) | (100 * counts["n_repeat_words"] > most_repeated * counts["n_words"])
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(score), pa.array(~failed & (score >= model.threshold))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return stored(texts(docs).mapInArrow(run, SCHEMA), "quality", keep=True)


@tidy
def keep(docs: DataFrame, model: Trees, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """The documents that pass, with all their columns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            counts, x = statistics(b.column(b.schema.get_field_index("text")))
            failed = (counts["n_words"] < least_words) | (100 * counts["n_repeat_words"] > most_repeated * counts["n_words"])
            yield b.filter(pa.array(~failed & (model.score(x) >= model.threshold)))

    return stored(docs.mapInArrow(run, docs.schema), "quality-kept", keep=True)
