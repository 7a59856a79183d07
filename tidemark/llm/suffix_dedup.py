"""Suffix-array dedup: shard Burrows-Wheeler transforms merged by interleave refinement.

A byte goes if a string of `size` bytes that covers it also starts in a document with a smaller id. Work is dealt
out by content, so that equal strings meet without any order over the whole corpus: each string belongs to the
least hash among its grams (its minimizer), and neighbours with the same minimizer make one piece.

1. Minimizers (40-bit hashes) that lie in one document only are found by counts in hash buckets and dropped.
2. The pieces left go, once per unit of documents, to the bucket of their minimizer. All of them are merged there.
3. There the pieces of some units make a shard, which gets its suffix order: the rows of its transform. The shards are
   merged by refining their interleave: each round takes the symbols before the rows, as many as fit a machine word,
   and distributes the merged rows by them, so that rows are in order of so many characters more. Rows of a shard keep
   their own order and are not sorted again. Only rows take part from which a whole string can still be reached. Rows
   part in the round whose symbols differ, so neighbours that never part have a common prefix of `size`: these are the
   repeated intervals, and each gets its least id.
4. The least ids go back to the documents, which lose the bytes covered.

A bucket's size follows the input's bytes. Where there are more than LOT units, their pieces are merged in a tree:
equal pieces (those whose first and last strings lie in the same intervals) of a lot of units go up as one. So a
passage that every document holds is never gathered anywhere.

Defined results: null or empty texts have no bytes; strings never cross documents; rows with equal ids do not
remove each other's bytes; a null id counts as larger than all; an empty table gives no rows; extra columns are
ignored; a very long text is one unit, read some MB at a time, and long runs of one byte or a short period are cut into
pieces that are mostly equal.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SMALL_BATCHES, gathered, input_bytes, pressed, ranges, settings, settle, stored, texts, tidy, unpressed, utf8
from tidemark.llm.common import word_array, words64

GRAM = 24  # bytes whose hash picks the minimizer
POSITION = 20  # low bits of a hash that don't count
MOST = 200  # string starts of a piece
SLICE = 4 << 20  # bytes whose minimizers are looked at, or whose pieces are put together, at a time
UNIT_BYTES = 3 << 20  # of text in a unit
BUCKET_BYTES = 8 << 20  # of input for each bucket
TABLE_BYTES = 32 << 20  # of input for each bucket of the units' table, at most
SHARD = 32_000  # bytes of pieces in a shard, about
CHUNK = 1 << 18  # bytes of pieces whose shards are merged at a time, about
ORDER = 48  # characters by which the suffixes of a shard are in order at least; what lies behind a string is shorter
LOT = 4096  # units whose pieces are merged in one node of the tree
LAST = np.iinfo(np.int64).max

UNITS = "part long, unit long, ids binary, ends binary, data binary"
SEEN = "part long, unit long, bucket long, hashes binary, several binary"
SHARED = "part long, unit long, hashes binary"
PIECES = "kind int, part long, unit long, bucket long, first long, data binary, about binary, least binary"
LEVEL = "kind int, bucket long, lot long, unit long, first long, data binary, about binary, least binary, place binary"
LEAST = "unit long, bucket long, first long, least binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.utf8()}
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[f[0] for f in fields])


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(schema, rows)])


def _slice_runs(data: np.ndarray, size: int) -> np.ndarray:
    """The minimizer hash of the string at each start."""
    w = words64(data)
    h = np.zeros(len(data) - GRAM + 1, np.uint64)
    for k, m in zip(range(0, GRAM, 8), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5), strict=False):
        h ^= h >> np.uint64(29)
        h += w[k : k + len(h)] * np.uint64(m)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h >>= np.uint64(POSITION + 4)
    span, have = size - GRAM + 1, 1
    while 2 * have <= span:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (span - have)], h[span - have :]) if span > have else h


def runs(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at most MOST string starts with one minimizer: first start, how many, row, and minimizer hash."""
    out = []
    total = len(data) - size + 1
    for lo in range(0, max(0, total), SLICE):
        hi = min(total, lo + SLICE)
        h = _slice_runs(data[lo : hi + size - 1], size)
        a, b = np.searchsorted(offs, lo, side="right") - 1, np.searchsorted(offs, hi, side="left")
        begin, stop = np.maximum(offs[a:b], lo) - lo, np.minimum(offs[a + 1 : b + 1] - size + 1, hi) - lo
        some = stop > begin
        begin, stop = begin[some], stop[some]
        if not len(begin):
            continue
        step = np.zeros(hi - lo + 1, np.int8)
        step[begin] += 1
        step[stop] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
        new = inside.copy()
        new[1:] &= (h[1:] != h[:-1]) | ~inside[:-1]
        new[begin] = True
        first = np.flatnonzero(new)
        row = np.searchsorted(begin, first, side="right") - 1
        n = np.minimum(np.append(first[1:], hi - lo), stop[row]) - first
        parts = -(-n // MOST)  # runs of one byte, or of a short period, are long
        if (parts > 1).any():
            nth = ranges(np.zeros(len(n), np.int64), parts)
            first, n, row = np.repeat(first, parts) + nth * MOST, np.minimum(np.repeat(n, parts) - nth * MOST, MOST), np.repeat(row, parts)
        out.append((first + lo, n, (np.flatnonzero(some) + a)[row], h[first]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _five(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _eight(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def units(docs: DataFrame, name: str) -> DataFrame:
    """The documents in units of some MB, compressed, in a table bucketed by the task that read them, a file a task: what
    joins them later is not shuffled."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // TABLE_BYTES))

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(gathered(it, UNIT_BYTES)):
            data, offs = utf8(b.column("text"))
            doc, part = b.column("doc_id"), b.column("part")[0].as_py()
            ids = pressed(doc.is_valid().to_numpy(zero_copy_only=False).astype("u1"), doc.fill_null(LAST).to_numpy(zero_copy_only=False).astype("<i8"))
            yield _batch(UNITS, [(part, part << 32 | k, ids, offs[1:].astype("<i8").tobytes(), pressed(data))])
        settle()

    rows = texts(docs).withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(gather, UNITS)
    with settings(spark, SMALL_BATCHES):
        rows.write.format("parquet").bucketBy(parts, "part").saveAsTable(name)
    return spark.table(name)


def _unit(ids: bytes, ends: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    valid, own = unpressed(ids, "u1", "<i8")
    return valid.astype(bool), own, np.concatenate([[0], np.frombuffer(ends, "<i8")]), unpressed(data, "u1")[0]


def minimizers(rows: DataFrame, size: int, buckets: int) -> DataFrame:
    """Each unit's distinct minimizers by bucket, and which of them lie in several documents."""

    def see(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                part, unit = b.column("part")[r].as_py(), b.column("unit")[r].as_py()
                _, _, offs, data = _unit(*(b.column(c)[r].as_py() for c in ("ids", "ends", "data")))
                _, _, row, h = runs(data, offs, size)
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                several = row[head] != row[np.append(head[1:], len(h)) - 1] if len(h) else np.zeros(0, bool)
                h = h[head]
                to = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                h, several, to = h[order], several[order], to[order]
                cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, int)
                yield _batch(SEEN, [(part, unit, int(to[x]), _five(h[x:y]), np.packbits(several[x:y]).tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)])
        settle()

    return rows.mapInArrow(see, SEEN)


def shared(seen: DataFrame) -> DataFrame:
    """Stored: for each unit, its minimizers that lie in several documents."""

    def pick(t: pa.Table) -> pa.Table:
        own = [_eight(x.as_py()) for x in t.column("hashes")]
        flags = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8))[: len(h)].astype(bool) for x, h in zip(t.column("several"), own, strict=True)]
        every = np.sort(np.concatenate(own))
        both = np.union1d(every[1:][every[1:] == every[:-1]], np.concatenate([h[f] for h, f in zip(own, flags, strict=True)]))
        rows = []
        for p, k, h in zip(t.column("part").to_pylist(), t.column("unit").to_pylist(), own, strict=True):
            if len(both):
                h = h[both[np.minimum(np.searchsorted(both, h), len(both) - 1)] == h]
                if len(h):
                    rows.append((p, k, _five(h)))
        return _table(SHARED, rows)

    return stored(seen.groupBy("bucket").applyInArrow(pick, SHARED), "suffix-shared")


def _numbered(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal byte strings have equal numbers; and where each number occurs first. Some MB are put together at a time."""
    done = np.concatenate([[0], np.cumsum(last - first)])
    cuts = np.unique(np.searchsorted(done, np.arange(0, done[-1] + SLICE, SLICE), side="left").clip(0, len(first)))
    number, words = np.zeros(len(first), np.int64), []
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        d = word_array(data, first[x:y], last[x:y]).dictionary_encode()
        number[x:y] = d.indices.to_numpy(zero_copy_only=False).astype(np.int64) + sum(map(len, words))
        words.append(d.dictionary)
    if len(words) > 1:
        number = pa.concat_arrays(words).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[number]
    lead = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64)
    lead[number[::-1]] = np.arange(len(number))[::-1]
    return number, lead


def pieces(rows: DataFrame, common: DataFrame, size: int, buckets: int) -> DataFrame:
    """Stored. kind 0: distinct pieces of a unit for a bucket; kind 1: where the unit's pieces lie."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        hashes: dict[int, list[np.ndarray]] = {}
        for unit, x in zip(right.column("unit").to_pylist(), right.column("hashes"), strict=True):
            hashes.setdefault(unit, []).append(_eight(x.as_py()))
        for i, (part, unit) in enumerate(zip(left.column("part").to_pylist(), left.column("unit").to_pylist(), strict=True)):
            if unit not in hashes:
                continue
            known = np.sort(np.concatenate(hashes[unit]))
            _, ids, offs, data = _unit(*(left.column(c)[i].as_py() for c in ("ids", "ends", "data")))
            first, n, row, h = runs(data, offs, size)
            keep = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            first, n, row, h = first[keep], n[keep], row[keep], h[keep]
            number, lead = _numbered(data, first, first + n + size - 1)
            least = np.full(len(lead), LAST)
            np.minimum.at(least, number, ids[row])
            to = (h[lead] % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((h[lead], to))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            edge = np.flatnonzero(np.concatenate([[True], to[by][1:] != to[by][:-1], [True]])) if len(by) else np.zeros(1, int)
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                j = by[x:y]
                at = lead[j]
                raw = data[ranges(first[at], n[at] + size - 1)]
                about = pressed(n[at].astype("u1"), (h[at] >> np.uint64(8)).astype("<u4"))
                out.append((0, part, unit, int(to[j[0]]), x, pressed(raw), about, _packed(least[j], np.ones(y - x, np.int64))))
            out.append((1, part, unit, None, None, None, pressed(first.astype("<i8"), n.astype("u1"), rank[number].astype("<i4")), None))
        settle()
        return _table(PIECES, out)

    return stored(rows.groupBy("part").cogroup(common.groupBy("part")).applyInArrow(cut, PIECES), "suffix-pieces")


def _packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Least ids of pieces: one value, or one for each start."""
    a = pressed(counts.astype("u1"))
    return len(a).to_bytes(8, "little") + a + pressed(values.astype("<i8"))


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = 8 + int.from_bytes(raw[:8], "little")
    return unpressed(raw[k:], "<i8")[0], unpressed(raw[8:k], "u1")[0].astype(np.int64)


def _spread(values: np.ndarray, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A value for each of n starts."""
    first = np.cumsum(counts) - counts
    return values[np.repeat(first, n) + ranges(np.zeros(len(n), np.int64), n) * np.repeat(counts > 1, n)]


def _short(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The reverse: one value where all starts of a piece have the same."""
    if not len(n):
        return low, n
    first = np.cumsum(n) - n
    one = np.minimum.reduceat(low, first) == np.maximum.reduceat(low, first)
    counts = np.where(one, 1, n)
    return low[ranges(first, counts)], counts


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Rows in order of the suffixes of strings with terminators (at `ends`), or of their first `depth` characters; ties
    in order of the strings."""
    n = len(text)
    bits, i = max(1, (n - 1).bit_length()), np.arange(n, dtype=np.uint64)
    stop = ends[np.searchsorted(ends, np.arange(n))]
    mask, wide = np.uint64((1 << bits) - 1), np.uint64(bits)

    def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = key << wide | i  # ties go by place
        both.sort()
        order, key = (both & mask).astype(np.int64), both >> wide
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1])) if n else 0
        return rank, order

    symbol = text.astype(np.uint64) + np.uint64(1)
    symbol[ends] = 0
    wide_symbol = np.uint64(8 if n and int(symbol.max()) < 256 else 9)
    have = (64 - bits) // int(wide_symbol)
    key = symbol
    for k in range(1, have):  # past its end: the terminator, the least of all
        key = key << wide_symbol | symbol[np.minimum(np.arange(k, n + k), stop)]
    rank, order = ranked(key)
    longest = int((stop - np.arange(n)).max()) + 1 if n else 0
    longest = longest if depth is None else min(longest, depth)
    while have < longest and int(rank[order[-1]]) < n - 1:
        rank, order = ranked(rank << wide | rank[np.minimum(np.arange(n) + have, stop)])
        have *= 2
    return order


class Shard:
    """Suffix order of some strings, put together in `data`: `row` gives the row of the suffix from each place on, with
    one place more for each string's terminator."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, depth: int | None = None):
        n = int(sizes.sum()) + len(sizes)
        self.ends = np.cumsum(sizes + 1) - 1
        self.text = np.zeros(n, np.uint8)
        live = np.ones(n, bool)
        live[self.ends] = False
        self.text[live] = data
        self.order = suffix_order(self.text, self.ends, depth)
        self.row = np.empty(n, np.int64)
        self.row[self.order] = np.arange(n)


def interleave(data: np.ndarray, sizes: np.ndarray, shards: list[tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of all strings of `size` bytes in pieces put together, and the interval of each; shards: their
    first and last pieces.

    A string's row in a round is the suffix that begins `depth` bytes before the string's end.
    """
    edge = np.concatenate([[0], np.cumsum(sizes)])
    merged = []
    for a, z in shards:  # depth 0: the rows behind the strings, shard by shard in the shards' own order
        own = Shard(data[edge[a] : edge[z]], sizes[a:z], ORDER)
        n = sizes[a:z] - size + 1
        start = ranges(edge[a:z], n)
        behind = start - edge[a] + np.repeat(np.arange(z - a), n) + size
        wide = max(1, (len(start) - 1).bit_length())
        both = own.row[behind] << wide | np.arange(len(start))
        both.sort()
        merged.append(start[both & ((1 << wide) - 1)])
    at = np.concatenate(merged)
    bits = max(1, (len(at) - 1).bit_length())
    most = (64 - bits) // 8
    whole = words64(data).byteswap()  # eight bytes from each place on, the first the highest
    interval, depth, mask = np.zeros(len(at), np.int64), 0, np.uint64((1 << bits) - 1)
    nth = np.arange(len(at), dtype=np.uint64)
    while depth < size:
        k = size % most if depth == 0 and size % most else min(most, size - depth)
        depth += k
        symbols = whole[at + (size - depth)] >> np.uint64(64 - 8 * k)
        both = symbols << np.uint64(bits) | nth
        both.sort()  # a stable distribution by symbols
        order, symbols = (both & mask).astype(np.int64), both >> np.uint64(bits)
        at, interval = at[order], interval[order]
        part = np.append(False, (symbols[1:] != symbols[:-1]) | (interval[1:] != interval[:-1]))
        interval = np.cumsum(part)
    return at, interval


def least_ids(data: np.ndarray, sizes: np.ndarray, low: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string start of the pieces put together, the least of the ids (low, one a start) of all equal strings;
    and numbers of the pieces, equal for equal ones. owner: the unit of each piece, in order."""
    edge = np.concatenate([[0], np.cumsum(sizes)])
    cut, at = [0], 0
    for k in np.flatnonzero(owner[1:] != owner[:-1]).tolist():  # whole units make a shard, as many as fit
        if edge[k + 1] - edge[at] >= SHARD:
            at = k + 1
            cut.append(at)
    cut.append(len(sizes))
    start, interval = interleave(data, sizes, list(zip(cut[:-1], cut[1:], strict=True)), size)
    n = sizes - size + 1
    number = np.zeros(len(data), np.int64)
    number[ranges(edge[:-1], n)] = np.arange(len(low))
    number = number[start]
    head = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
    out, of = np.empty(len(low), np.int64), np.empty(len(low), np.int64)
    out[number] = np.repeat(np.minimum.reduceat(low[number], head), np.diff(np.append(head, len(number))))
    of[number] = interval
    first = np.cumsum(n) - n
    alike = np.column_stack([of[first], of[first + n - 1], n])  # the first and last strings cover a piece of n <= size
    alike[n > size, 2] = -1 - np.flatnonzero(n > size)  # longer ones stay apart
    return out, np.unique(alike, axis=0, return_inverse=True)[1].ravel()


class Group:
    """All pieces that rows of a bucket bring, and their least ids."""

    def __init__(self, t: pa.Table, size: int):
        about = [unpressed(x.as_py(), "u1", "<u4") for x in t.column("about")]
        self.count = [len(x[0]) for x in about]
        self.n = np.concatenate([x[0] for x in about]).astype(np.int64)
        tag = np.concatenate([x[1] for x in about])
        self.sizes = self.n + size - 1
        self.raw = np.concatenate([unpressed(x.as_py(), "u1")[0] for x in t.column("data")])
        least = [_unpacked(x.as_py()) for x in t.column("least")]
        low = _spread(*(np.concatenate([x[i] for x in least]) for i in range(2)), self.n)
        self.edge = np.concatenate([[0], np.cumsum(self.sizes)])
        self.first = np.cumsum(self.n) - self.n
        owner = np.repeat(np.arange(len(self.count)), self.count)
        self.low, self.alike = np.empty(len(low), np.int64), np.empty(len(owner), np.int64)
        del about, least
        self.tag = tag
        by = np.argsort(tag, kind="stable")  # pieces of a minimizer are merged together
        total, tags = np.cumsum(self.sizes[by]), tag[by]
        at = done = 0
        while at < len(by):
            to = int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, side="right"))
            to = int(np.searchsorted(tags, tags[min(max(to, at + 1), len(by)) - 1], side="right"))
            i = np.sort(by[at:to])  # in order of the rows, so of the units
            got, alike = least_ids(self.raw[ranges(self.edge[i], self.sizes[i])], self.sizes[i], low[ranges(self.first[i], self.n[i])], owner[i], size)
            self.low[ranges(self.first[i], self.n[i])] = got
            self.alike[i] = alike + done
            done += int(alike.max()) + 1
            at = to

    def rows(self, t: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
        """(unit, first, which pieces) of each row."""
        done = 0
        for k, (unit, first) in enumerate(zip(t.column("unit").to_pylist(), t.column("first").to_pylist(), strict=True)):
            yield unit, first, np.arange(done, done + self.count[k])
            done += self.count[k]

    def least(self, i: np.ndarray) -> bytes:
        return _packed(*_short(self.low[ranges(self.first[i], self.n[i])], self.n[i]))


def merge(rows: DataFrame, n_units: int, size: int) -> DataFrame:
    """Stored: for each row of pieces, the least id of each string start. rows: unit, bucket, first, data, about, least."""

    def whole(t: pa.Table) -> pa.Table:
        g, bucket = Group(t, size), t.column("bucket")[0].as_py()
        out = [(unit, bucket, first, g.least(i)) for unit, first, i in g.rows(t)]
        del g
        settle()
        return _table(LEAST, out)

    if n_units <= LOT:
        return stored(rows.groupBy("bucket").applyInArrow(whole, LEAST), "suffix-least")

    def level(t: pa.Table) -> pa.Table:
        """kind 0: one of equal pieces, for the next level; kind 1: which of them each row's pieces are."""
        g, bucket, lot = Group(t, size), t.column("bucket")[0].as_py(), t.column("lot")[0].as_py()
        lead, where = np.unique(g.alike, return_index=True, return_inverse=True)[1:]
        lead = np.asarray(lead)
        raw = g.raw[ranges(g.edge[lead], g.sizes[lead])]
        out = [(0, bucket, lot, lot, 0, pressed(raw), pressed(g.n[lead].astype("u1"), g.tag[lead]), g.least(lead), None)]
        return _table(LEVEL, out + [(1, bucket, lot, unit, first, None, None, None, pressed(where[i].astype("<i8"), g.n[i].astype("<i8"))) for unit, first, i in g.rows(t)])

    lots = -(-n_units // LOT)
    dealt = rows.withColumn("lot", F.pmod(F.xxhash64("unit"), F.lit(lots)))
    half = stored(dealt.groupBy("bucket", "lot").applyInArrow(level, LEVEL), "suffix-level")
    above = merge(half.filter("kind = 0").select("unit", "bucket", "first", "data", "about", "least"), lots, size)

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table(LEAST, [])
        values, counts = _unpacked(right.column("least")[0].as_py())
        first = np.cumsum(counts) - counts
        out = []
        for unit, bucket, at, place in zip(*(left.column(c).to_pylist() for c in ("unit", "bucket", "first", "place")), strict=True):
            which = unpressed(place, "<i8", "<i8")[0]
            out.append((unit, bucket, at, _packed(values[ranges(first[which], counts[which])], counts[which])))
        return _table(LEAST, out)

    own = half.filter("kind = 1").select("bucket", "lot", "unit", "first", "place")
    return stored(own.groupBy("bucket", "lot").cogroup(above.withColumnRenamed("unit", "lot").groupBy("bucket", "lot")).applyInArrow(down, LEAST), "suffix-least")


def _covered(hit: np.ndarray, size: int) -> np.ndarray:
    """Which bytes a string that starts at a hit covers."""
    out = np.zeros(len(hit), bool)
    for lo in range(0, len(hit), SLICE):
        hi = min(len(hit), lo + SLICE)
        sums = np.concatenate([[0], np.cumsum(hit[max(0, lo - size + 1) : hi], dtype=np.int32)])
        i = np.arange(lo, hi) - max(0, lo - size + 1)
        out[lo:hi] = sums[i + 1] > sums[np.maximum(i - size + 1, 0)]
    return out


def remove(rows: DataFrame, found: DataFrame, least: DataFrame, size: int) -> DataFrame:
    """Every document without the bytes covered: counts and the hash of what is left."""
    null = lambda t: F.lit(None).cast(t)
    part = F.shiftright("unit", 32)
    side = least.select(part.alias("part"), "unit", "first", null("binary").alias("about"), "least")
    side = side.unionByName(found.filter("kind = 1").select("part", "unit", null("long").alias("first"), "about", null("binary").alias("least")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, places, parts = [], {}, {}
        for unit, first, about, low in zip(*(right.column(c).to_pylist() for c in ("unit", "first", "about", "least")), strict=True):
            if first is None:
                places[unit] = about
            else:
                parts.setdefault(unit, []).append((first, low))
        for i, unit in enumerate(left.column("unit").to_pylist()):
            valid, ids, offs, data = _unit(*(left.column(c)[i].as_py() for c in ("ids", "ends", "data")))
            hit = np.zeros(len(data), bool)
            if unit in places and unit in parts:
                start, n, number = (x.astype(np.int64) for x in unpressed(places[unit], "<i8", "u1", "<i4"))
                got = [_unpacked(low) for _, low in sorted(parts.pop(unit))]
                values, counts = (np.concatenate([x[k] for x in got]) for k in range(2))
                first, own = np.cumsum(counts) - counts, ids[np.searchsorted(offs, start, side="right") - 1]
                for x in range(0, len(start), 1 << 16):  # some pieces at a time
                    s, k, j = start[x : x + (1 << 16)], n[x : x + (1 << 16)], number[x : x + (1 << 16)]
                    nth = ranges(np.zeros(len(k), np.int64), k)
                    low = values[np.repeat(first[j], k) + nth * np.repeat(counts[j] > 1, k)]
                    hit[(np.repeat(s, k) + nth)[low < np.repeat(own[x : x + (1 << 16)], k)]] = True
            gone = _covered(hit, size) if hit.any() else hit
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            heads = offs[:-1][offs[:-1] < offs[1:]]
            opens[heads] = gone[heads]
            for k in range(len(ids)):
                a, b = int(offs[k]), int(offs[k + 1])
                g = gone[a:b]
                kept = data[a:b][~g] if g.any() else data[a:b]
                out.append((int(ids[k]) if valid[k] else None, b - a, b - a - len(kept), int(opens[a:b].sum()), hashlib.sha256(kept.tobytes()).hexdigest()))
        settle()
        return _table(RESULT, out)

    return rows.groupBy("part").cogroup(side.groupBy("part")).applyInArrow(run, RESULT)


@tidy
def dedup(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; size: 32 to 250 bytes."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = -(-input_bytes(docs) // BUCKET_BYTES) or parts
    name = f"tidemark_units_{uuid.uuid4().hex}"
    try:
        rows = units(docs, name)
        found = pieces(rows, shared(minimizers(rows, size, buckets)), size, buckets)
        least = merge(found.filter("kind = 0").select("unit", "bucket", "first", "data", "about", "least"), rows.count(), size)
        return stored(remove(rows, found, least, size), "suffix-dedup", keep=True)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
