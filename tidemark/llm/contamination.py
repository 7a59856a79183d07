"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: each row is a segment with its sorted terms and, for each term, the delta-coded
list of its word positions. A search looks up a window's terms in a segment, starts from the rarest one there and
intersects the lists, each shifted by the term's offset (within `slop` words for proximity). Segments are
independent, so no term is gathered anywhere, however common. Test items are shipped in blocks of a bounded size.

Defined results: null or empty texts have no words and no hits; empty items match nothing; repeated documents and
items are judged each, equal item ids listed once; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, batches, ranges, stored, texts, tidy, utf8, word_array, word_hashes, word_spans

INDEX = "part int, segment long, doc_ids array<long>, word_offs array<long>, terms array<binary>, term_offs binary, deltas binary"
FOUND = "part int, segment long, row int, doc_id long, n_words long, spans binary, items array<string>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _words(col: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words, the distinct words, and the offsets of the rows in words."""
    data, offs = utf8(col)
    data = LOWER[data]
    starts, ends = word_spans(data, offs, "alnum")
    codes, distinct = word_hashes(word_array(data, starts, ends))
    return codes, distinct, np.searchsorted(starts, offs)


def build(docs: DataFrame) -> DataFrame:
    """The stored index of all words of all documents."""

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches(it)):
            codes, distinct, word_offs = _words(b.column("text"))
            order = np.argsort(codes, kind="stable")
            n = np.bincount(codes, minlength=len(distinct))
            offs = np.concatenate([[0], np.cumsum(n)])
            deltas = np.diff(order, prepend=0)
            deltas[offs[:-1][n > 0]] = order[offs[:-1][n > 0]]
            one = lambda v, t: pa.array([v], t)
            yield pa.RecordBatch.from_arrays([
                one(b.column("part")[0].as_py(), pa.int32()), one(k, pa.int64()), pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("doc_id")),
                pa.ListArray.from_arrays(pa.array([0, len(word_offs)], pa.int32()), pa.array(word_offs, pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct),
                one(offs.astype("<u4").tobytes(), pa.binary()), one(deltas.astype("<u4").tobytes(), pa.binary()),
            ], names=[c.split()[0] for c in INDEX.split(", ")])

    return stored(texts(docs).withColumn("part", F.spark_partition_id()).mapInArrow(index, INDEX), "postings")


class Windows:
    """All windows of some items, as places in their words put together; terms: the distinct words."""

    def __init__(self, ids: list[str], items: pa.Array, size: int):
        self.ids = ids
        self.codes, self.terms, offs = _words(items)
        n = np.diff(offs)
        many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        self.item = np.repeat(np.arange(len(n)), many)
        self.start = ranges(offs[:-1], many)
        self.size = np.minimum(n, size)[self.item]

    def present(self, local: np.ndarray) -> np.ndarray:
        """The windows all of whose terms a segment has; local: the segment's number of each term, or -1."""
        have = np.concatenate([[0], np.cumsum(local[self.codes] >= 0)]) if len(self.codes) else np.zeros(1, np.int64)
        return np.flatnonzero(have[self.start + self.size] - have[self.start] == self.size)


def search_segment(seg: dict, windows: Windows, slop: int = 0) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """First word and end (in words of the segment) of each match, and the items found in each document.

    A match: a place of the window's rarest term, with every other term in the same document and no more than `slop`
    words from where the window puts it. Each term is taken at its first such place.
    """
    offs, deltas = np.frombuffer(seg["term_offs"], "<u4").astype(np.int64), np.frombuffer(seg["deltas"], "<u4")
    word_offs = np.asarray(seg["word_offs"])
    items: list[set[str]] = [set() for _ in range(len(word_offs) - 1)]
    local = pc.fill_null(pc.index_in(windows.terms, value_set=seg["terms"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    lists: dict[int, np.ndarray] = {}

    def positions(t: int) -> np.ndarray:
        if t not in lists:
            lists[t] = np.cumsum(deltas[offs[t] : offs[t + 1]], dtype=np.int64)
        return lists[t]

    counts, starts, ends = np.diff(offs), [], []
    for i in windows.present(local).tolist():
        at = windows.start[i]
        terms = local[windows.codes[at : at + windows.size[i]]]
        order = np.argsort(counts[terms], kind="stable")
        low = high = positions(int(terms[order[0]]))
        begin, doc = low - order[0], np.searchsorted(word_offs, low, side="right") - 1
        for j in order[1:]:
            if not len(begin):
                break
            p = positions(int(terms[j]))
            k = np.searchsorted(p, np.maximum(begin + j - slop, word_offs[doc]))
            place = p[np.minimum(k, len(p) - 1)]
            fits = (k < len(p)) & (place <= np.minimum(begin + j + slop, word_offs[doc + 1] - 1))
            begin, doc, place = begin[fits], doc[fits], place[fits]
            low, high = np.minimum(low[fits], place), np.maximum(high[fits], place)
        if len(begin):
            starts.append(low)
            ends.append(high + 1)
            for d in np.unique(doc).tolist():
                items[d].add(windows.ids[windows.item[i]])
    none = np.zeros(0, np.int64)
    return np.concatenate(starts) if starts else none, np.concatenate(ends) if ends else none, items


def blocks(benchmark: DataFrame, most_bytes: int) -> Iterator[tuple[list[str], pa.Array]]:
    """The items in blocks whose texts take about `most_bytes`, one block on the driver at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most_bytes) or 1
    for k in range(n):
        part = (rows.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k) if n > 1 else rows).collect()
        yield [r["item_id"] for r in part], pa.array([r["text"] for r in part], pa.utf8())


def search(index: DataFrame, ids: list[str], items: pa.Array, window: int, slop: int = 0) -> DataFrame:
    """For each document: its words, the spans matched (int64 pairs, in words of the document) and the items found."""
    shared = index.sparkSession.sparkContext.broadcast((ids, items.to_pylist()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = shared.value
        windows = Windows(own, pa.array(held, pa.utf8()), window)
        for b in it:
            for i in range(b.num_rows):
                seg = {c: b.column(c)[i].values if c == "terms" else b.column(c)[i].as_py() for c in ("word_offs", "terms", "term_offs", "deltas")}
                starts, ends, found = search_segment(seg, windows, slop)
                offs = np.asarray(seg["word_offs"])
                docs = b.column("doc_ids")[i].values
                order = np.argsort(starts, kind="stable")
                starts, ends = starts[order], ends[order]
                cut = np.searchsorted(starts, offs)
                pairs = np.column_stack([starts, ends])
                k = len(docs)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b.column("part")[i].as_py()] * k, pa.int32()), pa.array([b.column("segment")[i].as_py()] * k, pa.int64()), pa.array(range(k), pa.int32()), docs, pa.array(np.diff(offs)),
                    pa.array([(pairs[x:y] - o).astype("<i8").tobytes() for x, y, o in zip(cut[:-1], cut[1:], offs, strict=False)], pa.binary()), pa.array([sorted(s) for s in found], pa.list_(pa.utf8())),
                ], names=[c.split()[0] for c in FOUND.split(", ")])

    return index.mapInArrow(run, FOUND)


def covered(spans: np.ndarray, n: int) -> int:
    """How many of n words lie in the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.clip(spans[:, 0], 0, n), 1)
    np.add.at(step, np.clip(spans[:, 1], 0, n), -1)
    return int((np.cumsum(step)[:n] > 0).sum())


@tidy
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, most_bytes: int = 8 << 20) -> DataFrame:
    """Every document with its words hit, the items found, and whether a 1/one_in share of its words is hit."""
    index = build(docs)
    found = [search(index, ids, items, window) for ids, items in blocks(benchmark, most_bytes)]
    rows = found[0]
    if len(found) > 1:
        for more in found[1:]:
            rows = rows.unionByName(more)
        key = ("part", "segment", "row")
        rows = rows.groupBy(*key).agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("all"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        rows = rows.select("doc_id", "n_words", F.concat(*[F.coalesce(F.get("all", F.lit(i)), F.expr("X''")) for i in range(len(found))]).alias("spans"), "items")

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = b.column("n_words").to_numpy()
            hit = np.array([covered(np.frombuffer(s, "<i8").reshape(-1, 2), int(k)) if s else 0 for s, k in zip(b.column("spans").to_pylist(), n, strict=True)], np.int64)
            items = [sorted(x) for x in b.column("items").to_pylist()]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array((hit > 0) & (one_in * hit >= n))], names=[c.split()[0] for c in RESULT.split(", ")])

    return stored(rows.select("doc_id", "n_words", "spans", "items").mapInArrow(finish, RESULT), "contaminated", keep=True)


@tidy
def matches(docs: DataFrame, queries: DataFrame, window: int, slop: int) -> DataFrame:
    """Phrase (slop 0) or proximity matches of a bounded query set: every document with its spans and items."""
    index = build(docs)
    found = [search(index, ids, items, window, slop) for ids, items in blocks(queries, 8 << 20)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return stored(out.select("doc_id", "n_words", "spans", "items"), "matches", keep=True)
