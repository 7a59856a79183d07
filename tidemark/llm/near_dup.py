"""MinHash near-dedup with an LSH forest.

Texts with equal shingle sets form a class at once (their sorted hashes' digest), so copies are never compared.
Each class has a signature of min-hashes; each tree sorts all classes by its own order of the signature, and knows the
length of the common prefix of neighbours. Classes that share DEPTH values are a region. The depth adapts by region: a
region of more than SMALL classes is cut at one value more, again and again, down to DEEPEST; a class alone at DEPTH
goes up one value. All pairs of a region small enough are candidates, and neighbours in the order always are. Where
even the deepest region is dense, classes still in different components are compared across them, block by block, by an
inverted index of the block's sets. Candidates are confirmed on full shingle sets, near each other in cells of bounded
size; links become components by alternating star contraction, in which vertices of very many links are joined apart.
Links, components and candidates stay distributed; no more vertices than there are partitions are broadcast.

Defined results: null, empty or blank texts have an empty set and are linked with nothing; one word is one shingle;
rows with equal ids are one document; a null id is its own, kept, with a null component; an empty table gives no
rows; extra columns are ignored; a very long text is one row of a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, SMALL_BATCHES, batches, hash64, mix, ranges, settings, stored, texts, tidy, utf8, word_array, word_hashes, word_spans

TREES, DEPTH = 24, 4
SIZE = TREES * DEPTH
DEEPEST = 8  # values of a prefix at most
SMALL = 6  # classes in a region whose pairs are all compared at once
NEAR = 2  # neighbours compared in any region
HUB = 1000  # links of a vertex that is joined apart, at least
HELD = 16_384  # rows of one region held at a time
CELL = 2000  # pairs confirmed in a cell
BLOCK = 256  # classes outside the largest component of a dense neighbourhood held at a time

_rng = np.random.default_rng(2024)
_XOR = _rng.integers(0, 1 << 32, SIZE, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, SIZE, dtype=np.uint32) | np.uint32(1)

SIGNED = "doc_id long, n long, digest binary, sig binary, text string"
FOREST = "tree int, k1 long, k2 long, k3 long, k4 long, n long, rep long"
PAIRS = "a long, b long, tree int, k1 long, k2 long"
_FOREST = [c.split()[0] for c in FOREST.split(", ")]


def shingle_sets(col: pa.Array, size: int = 2) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data, offs = utf8(col)
    data = LOWER[data]
    starts, ends = word_spans(data, offs, "space")
    codes, distinct = word_hashes(word_array(data, starts, ends))
    h = hash64(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    at = np.searchsorted(starts, offs)
    rolled = h.copy()
    for k in range(1, size):
        rolled[: len(h) - k] = mix(rolled[: len(h) - k]) + h[k:] if len(h) > k else rolled[:0]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:  # the whole sequence as one
            x = np.uint64(b - a)
            for v in h[a:b]:
                x = (mix(np.array([x], np.uint64)) + v)[0]
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), SIZE) uint32 min-hashes; no set may be empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), SIZE), np.uint32)
    for i in range(SIZE):
        v = (flat ^ _XOR[i]) * _MUL[i]
        v ^= v >> np.uint32(15)
        out[:, i] = np.minimum.reduceat(v * np.uint32(0x85EBCA6B), at)
    return out


def signed(docs: DataFrame, name: str) -> DataFrame:
    """(doc_id, n, digest, sig, text) of every row, in a table bucketed by doc_id: later joins don't shuffle the texts."""
    spark = docs.sparkSession

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches(it):
            sets = shingle_sets(b.column("text"))
            some = [i for i, s in enumerate(sets) if len(s)]
            sig = iter(signatures([sets[i] for i in some])) if some else iter(())
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()), b.column("text"),
            ], names=["doc_id", "n", "digest", "sig", "text"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs).mapInArrow(sign, SIGNED).repartition(parts, "doc_id")  # a file a bucket
    with settings(spark, SMALL_BATCHES):
        rows.write.format("parquet").option("compression", "zstd").bucketBy(parts, "doc_id").saveAsTable(name)
    return spark.table(name)


def forest(classes: DataFrame) -> DataFrame:
    """A row per class and tree: the first DEEPEST min-hashes of its order, two in a number, the first the higher."""

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = (np.arange(TREES)[:, None] * DEPTH + np.arange(DEEPEST)) % SIZE
        for b in it:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, SIZE)
            for lo in range(0, len(sig), 500):
                s = sig[lo : lo + 500]
                v = s[:, order].reshape(len(s) * TREES, DEEPEST).astype(np.uint64)
                k = (v[:, ::2] << np.uint64(32) | v[:, 1::2]).view(np.int64)
                of = pa.array(np.repeat(np.arange(lo, lo + len(s)), TREES))
                tree = pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(s)))
                yield pa.RecordBatch.from_arrays([tree, *(pa.array(np.ascontiguousarray(x)) for x in k.T), b.column("n").take(of), b.column("rep").take(of)], names=[c.split()[0] for c in FOREST.split(", ")])

    return classes.select("rep", "n", "sig").mapInArrow(keys, FOREST)


def common_prefix(rows: np.ndarray) -> np.ndarray:
    """How many values each row (tree, k1, k2, k3, k4, ...) shares with the next; -1 for rows of different trees."""
    a, b = rows[:-1], rows[1:]
    out = np.zeros(max(0, len(rows) - 1), np.int64)
    same = a[:, 0] == b[:, 0]
    for c in range(1, 1 + DEEPEST // 2):
        half = a[:, c] >> 32 == b[:, c] >> 32
        out += same * half
        same = same & (a[:, c] == b[:, c])
        out += same
    out[a[:, 0] != b[:, 0]] = -1
    return out


def region_sizes(shared: np.ndarray, depth: int) -> np.ndarray:
    """For each row, how many rows share `depth` values with it, one after another."""
    cut = np.concatenate([[True], shared < depth])
    first = np.flatnonzero(cut)
    return np.diff(np.append(first, len(cut)))[np.cumsum(cut) - 1]


def _pairs(rows: np.ndarray, percent: int) -> Iterator[tuple]:
    """Candidates among rows (tree, k1, k2, k3, k4, n, rep) in order; a dense region also gives (null, null, its key)."""
    if not len(rows):
        return
    shared = common_prefix(rows)
    # the depth at which each row's region is small: DEPTH or deeper; one less for a row alone at DEPTH
    depth = np.full(len(rows), DEPTH)
    for d in range(DEPTH, DEEPEST + 1):
        depth[(depth == d) & (region_sizes(shared, d) > SMALL)] = d + 1
    alone = region_sizes(shared, DEPTH) == 1
    least = shared.copy()
    for step in range(1, SMALL):
        if step > 1:  # shared by all rows between two that are `step` apart
            least = np.minimum(least[:-1], shared[step - 1 :])
        if not len(least):
            break
        take = least >= np.maximum(depth[:-step], DEPTH)
        if step <= NEAR:
            take |= least >= DEPTH
        if step == 1:
            take |= (least == DEPTH - 1) & (alone[:-1] | alone[1:])
        a, b = rows[:-step][take], rows[step:][take]
        fits = (100 * np.minimum(a[:, 5], b[:, 5]) >= percent * np.maximum(a[:, 5], b[:, 5])) & (a[:, 6] != b[:, 6])
        for x, y in zip(a[fits, 6].tolist(), b[fits, 6].tolist(), strict=True):
            yield (min(x, y), max(x, y), None, None, None)
    dense = np.flatnonzero(depth > DEEPEST)
    for t, k1, k2 in np.unique(rows[dense, :3], axis=0).tolist():
        yield (None, None, t, k1, k2)


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Stored pairs of neighbours in the sorted trees, and the keys of dense regions (a and b null)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names, kinds = [c.split()[0] for c in PAIRS.split(", ")], (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())

    def out(found: Iterator[tuple]) -> pa.RecordBatch:
        found = list(found)
        columns = zip(*found, strict=True) if found else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 7), np.int64)
        for b in it:
            if not b.num_rows:
                continue
            held = np.concatenate([held, np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _FOREST])])
            cut = np.flatnonzero(common_prefix(held) < DEPTH - 1)
            last = int(cut[-1]) + 1 if len(cut) else 0
            if not last and len(held) > HELD:  # a long region: its end is carried over
                yield out(_pairs(held, percent))
                held = held[-SMALL:]
            elif last:
                yield out(_pairs(held[:last], percent))
                held = held[last:]
        yield out(_pairs(held, percent))

    # rows that share DEPTH - 1 values share a partition; a dense region is streamed, never held
    first = F.shiftright("k2", 32)
    spread = rows.repartition(parts, "tree", "k1", first).sortWithinPartitions(*_FOREST[:5], "rep")
    return stored(spread.mapInArrow(near, PAIRS), "near-candidates")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Stored links (a, b) of the pairs (a < b) whose full sets are as similar as asked; pairs already joined inside a cell are skipped."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = stored(pairs.select("a", "b").distinct(), "near-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    cells = pairs.join(lowest, "a").select("a", "b", F.col("low").alias("cell"))
    many = cells.groupBy("cell").agg(F.ceil(F.count("*") / CELL).alias("subs"))
    cells = stored(cells.join(many, "cell").select("a", "b", "cell", F.pmod(F.xxhash64("a", "b"), F.col("subs")).alias("sub")), "near-cells")
    need = cells.select("cell", "sub", F.col("a").alias("doc_id")).unionByName(cells.select("cell", "sub", F.col("b").alias("doc_id"))).distinct()
    rows = docs.select("doc_id", "text").join(need.hint("shuffle_hash"), "doc_id").select("cell", "sub", F.lit(0).alias("kind"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = rows.unionByName(cells.select("cell", "sub", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("string").alias("text")))

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets, root = None, {}, {}

        def top(v):
            while root.get(v, v) != v:
                root[v] = root.get(root[v], root[v])
                v = root[v]
            return v

        for b in batches(it):
            own = shingle_sets(b.column("text"))
            found = []
            for c, s, kind, x, y, got in zip(*(b.column(k).to_pylist() for k in ("cell", "sub", "kind", "a", "b")), own, strict=True):
                if (c, s) != cell:
                    cell, sets, root = (c, s), {}, {}
                if kind == 0:
                    sets.setdefault(x, []).append(got)
                elif (p := top(x)) != (q := top(y)):
                    for m in sets.get(x, ()):
                        if any(alike(m, n, percent) for n in sets.get(y, ())):
                            found.append((x, y))
                            root[max(p, q)] = min(p, q)
                            break
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    spread = rows.repartition(parts, "cell", "sub").sortWithinPartitions("cell", "sub", "kind", "a", "b")
    return stored(spread.mapInArrow(check, "a long, b long"), "near-links")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _with_least(rows: DataFrame, hub: int | None) -> DataFrame:
    """(u, v, m) of rows (u, v): m is the least of u and all its v.

    hub: vertices of more rows than that, fewer than there are partitions, are broadcast with their m; the others are
    joined by u. None: there are no such vertices.
    """
    low = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
    if hub is None:
        return rows.join(low.select("u", "m"), "u")
    hubs = F.broadcast(low.filter(F.col("c") > hub).select("u", "m"))
    few = rows.join(hubs.select("u"), "u", "left_anti").join(low.filter(F.col("c") <= hub).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(few).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """(v, component) of every linked vertex: large-star and small-star steps until nothing changes."""
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "near-edges")

    def state() -> tuple:
        """How many edges there are, the most that a vertex is the least end of, and a checksum."""
        at = edges.groupBy("v").agg(F.count("*").alias("c"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        return tuple(at.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0)), F.sum("s")).first())

    now = state()
    while True:
        share = max(HUB, -(-2 * now[0] // parts))  # of an even split, so fewer vertices than partitions have more
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, share if now[1] > share else None).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        small = _with_least(large, None).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        edges = stored(small, "near-small")
        last, now = now, state()
        if now == last:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "v")


def across(rows: DataFrame, dense: DataFrame, links: DataFrame, comps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Stored links between the components that meet in dense regions.

    Regions that share classes are put together. In each such neighbourhood the classes outside its largest component
    are dealt into blocks, and every class of the neighbourhood passes every block once, with its full set.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["tree", "k1", "k2"]
    member = rows.join(dense.select(*key).distinct(), key).select(*key, "rep")
    member = member.join(comps, F.col("rep") == F.col("v"), "left").select(*key, "rep", F.coalesce("component", "rep").alias("c"))
    torn = member.groupBy(*key).agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("rep").alias("first")).filter("low != high")
    member = stored(member.join(torn, key).select("rep", "c", "first").distinct(), "near-torn")
    if member.isEmpty():
        return links.limit(0)
    wide = components(links.unionByName(member.select(F.col("rep").alias("a"), F.col("first").alias("b"))))
    member = member.select("rep", "c").distinct().join(wide, F.col("rep") == F.col("v"), "left").select(F.coalesce("component", "rep").alias("place"), "rep", "c")
    sizes = member.groupBy("place", "c").agg(F.count("*").alias("m")).groupBy("place").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("all"))
    sizes = sizes.select("place", F.col("top.c").alias("main"), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).alias("subs")).filter("subs > 0")
    member = stored(member.join(sizes, "place"), "near-open")
    own = member.filter("c != main").select("place", F.pmod(F.xxhash64("rep"), F.col("subs")).alias("sub"), F.lit(0).alias("role"), "rep", "c")
    other = member.select("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub"), F.lit(1).alias("role"), "rep", "c")
    every = docs.select("doc_id", "text").join(own.unionByName(other).hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).drop("doc_id")

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, index, root = None, [], None, {}

        def top(v):
            while root.get(v, v) != v:
                root[v] = root.get(root[v], root[v])
                v = root[v]
            return v

        for b in batches(it):
            sets, found = shingle_sets(b.column("text")), []
            for place, sub, role, rep, c, got in zip(*(b.column(k).to_pylist() for k in ("place", "sub", "role", "rep", "c")), sets, strict=True):
                if (place, sub) != at:
                    at, mine, index, root = (place, sub), [], None, {}
                if role == 0:
                    mine.append((rep, c, got))
                    continue
                if not mine:
                    continue
                index = index or Postings([m[2] for m in mine])
                shared = index.shared(got)
                for i in np.flatnonzero((shared > 0) & (100 * shared >= percent * (index.sizes + len(got) - shared))).tolist():
                    if (p := top(c)) != (q := top(mine[i][1])):
                        root[max(p, q)] = min(p, q)
                        found.append((min(rep, mine[i][0]), max(rep, mine[i][0])))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return stored(every.repartition(parts, "place", "sub").sortWithinPartitions("place", "sub", "role", "rep").mapInArrow(compare, "a long, b long"), "near-across")


class Postings:
    """Inverted index of some sets: how many members each shares with another set, all at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat, self.of = flat[order], of[order]
        head = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))[: len(flat)]
        self.keys, self.start, self.count = flat[head], head, np.diff(np.append(head, len(flat)))

    def shared(self, one: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(self.sizes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, one), len(self.keys) - 1)
        at = at[self.keys[at] == one]
        return np.bincount(self.of[ranges(self.start[at], self.count[at])], minlength=len(self.sizes))


@tidy
def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row, stored."""
    name = f"tidemark_signed_{uuid.uuid4().hex}"
    try:
        return stored(_near_duplicates(signed(docs, name), percent), "near-duplicates", keep=True)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def _near_duplicates(rows: DataFrame, percent: int) -> DataFrame:
    some = rows.filter("n > 0 and doc_id is not null")
    classes = stored(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "near-classes")
    trees = forest(classes)
    cand = candidates(trees, percent)
    links = confirm(cand.filter("a is not null"), rows, percent)
    same_id = some.join(classes.select("digest", "rep"), "digest").filter("doc_id != rep").groupBy("doc_id", "rep").count().select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    odd = stored(same_id.join(classes.select(F.col("rep").alias("a")).distinct(), "a", "left_semi"), "near-same-id")  # an id that has several texts
    links = links.unionByName(odd)
    comps = components(links)
    dense = cand.filter("a is null")
    if not dense.isEmpty():
        more = across(trees, dense, links, comps, rows, percent)
        if not more.isEmpty():
            comps = components(links.unionByName(more))
    named = rows.select("doc_id", "n", "digest").join(classes.select("digest", "rep"), "digest", "left")
    named = named.join(comps, F.col("rep") == F.col("v"), "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "rep", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))
