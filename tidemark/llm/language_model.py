"""Language-model scoring: causal self-attention over classes of subword ids, trained in numpy.

Texts are words; a word is the ids that it has by itself. A symbol is an id that says whether it ends its word, so
the symbols of a word and of no other word spell it. All training texts are counted: words, and symbols by the hash
bucket of the symbol before them. Symbols are clustered into classes by these contexts. A one-layer attention model
predicts the class of the next symbol from the classes before it, and carries every probability:

    P(word | past) = A(class of its first symbol) * (share * words(word | class) + (1 - share) * spelled)
    spelled = in_class(first symbol | class, bucket) * product over its other symbols of A(class) * in_class(symbol)

words() are counted shares among the training words that begin with that class, in_class() smoothed shares of a
symbol within its class after a bucket. A, words() and in_class() each sum to 1, so the model's probabilities of all
words and the end do so too (tests add them up). The share is the one of SHARES under which the training texts are
likeliest, each word left out of the counts it is judged by.

Weights are trained on every window of every training text, once: texts are dealt by their hash into slices of about
SLICE symbols, trained in order of the hash. A quarter of the slices trains from the start values, and their weights
are averaged; the other slices go on from there and are averaged again, in a tree and in order. So scores don't
depend on how rows lie in partitions.

Texts are scored in blocks of BLOCK symbols: a block's queries attend to itself (causally) and to the block before,
so windows overlap by half and each symbol is scored once, many blocks at a time.

The texts are read and encoded once, into units of some MB of word codes. Word counts are summed in hash buckets
whose number follows the input's bytes, and go back to the units that hold the words; nothing but the context counts
of the vocabulary (a fixed size) reaches the driver.

Defined results: null or empty texts hold the end alone; without training texts every count is 0; rows with equal
ids are scored each; a null id counts as training; an empty table gives no rows; extra columns are ignored; a very
long text is one unit, whose windows are made some thousand blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, gathered, hash64, input_bytes, pressed, ranges, settle, stored, texts, tidy, unpressed, utf8
from tidemark.llm.common import word_array, word_hashes, word_spans
from tidemark.llm.subwords import subwords

BLOCK, CLASSES, WIDTH, BUCKETS = 16, 32, 16, 64
UNIT_BYTES = 6 << 20  # of text in a unit
BUCKET_BYTES = 16 << 20  # of input for each bucket of word counts
SLICES = 256  # of the context counts
COLUMNS = BUCKETS + 1  # of the context counts; the last: as the first symbol of a word
SLICE = 2_000_000  # symbols that train together
BATCH = 64  # blocks in a step of training
RATES = (0.01, 0.002)  # of the first quarter of the slices, and of the others
FAN = 64  # rows of weights averaged at a time
SMOOTH = 30.0
SHARES = (0.05, 0.2, 0.4, 0.6, 0.8, 0.95)  # tried for words(); the rest is spelled
LN10 = np.log(10)

ANALYSED = "kind int, unit long, key long, at long, docs binary, codes binary, spelled binary, a binary, b binary"
COUNTS = "unit long, at long, counts binary, types long, tokens long"
WEIGHTS = "slice long, n long, w binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, scores array<double>, fits array<double>"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f[0] for f in fields])


class Attention:
    """One causal self-attention layer over classes, with a bias for each pair of places; class CLASSES is the start, and
    padding. Consecutive blocks are given together, so each class is a key for its own block and for the next."""

    SHAPES = {
        "E": (CLASSES + 1, WIDTH), "Q": (WIDTH, WIDTH), "K": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "U": (WIDTH, CLASSES),
        "B": (CLASSES + 1, CLASSES), "R": (BLOCK, 2 * BLOCK),
    }

    def __init__(self, bigrams: np.ndarray | None = None, flat: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for s in self.SHAPES.values()]
        rng = np.random.default_rng(5)
        self.flat = (rng.standard_normal(sum(sizes)) * 0.2).astype(np.float32) if flat is None else flat.astype(np.float32)
        self.w = self._parts(self.flat)
        if flat is None:
            self.w["U"][:] *= 0.1
            self.w["R"][:] = 0
        if bigrams is not None:
            share = bigrams + 0.5
            self.w["B"][:] = np.log(share / share.sum(1, keepdims=True))
        self.mean, self.square, self.steps = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        self.open = np.hstack([np.ones((BLOCK, BLOCK)), np.tril(np.ones((BLOCK, BLOCK)))]).astype(np.float32)

    def _parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of the parameters in a flat array."""
        out, at = {}, 0
        for k, s in self.SHAPES.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s)
            at += n
        return out

    @staticmethod
    def _pairs(rows: np.ndarray) -> np.ndarray:
        """(blocks + 1, BLOCK, d) as (blocks, 2 * BLOCK, d): each block behind the one before."""
        a, b, c = rows.strides
        return np.lib.stride_tricks.as_strided(rows, (len(rows) - 1, 2 * BLOCK, rows.shape[2]), (a, b, c))

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """Class probabilities after each of the last BLOCK classes of x (consecutive blocks, each 2 * BLOCK), flat, and
        what led there; first: there is no block before."""
        w = self.w
        rows = np.concatenate([x[:1, :BLOCK], x[:, BLOCK:]])
        q = (w["E"] @ w["Q"] * np.float32(WIDTH**-0.5)).take(rows[1:], axis=0)
        k, v = (self._pairs((w["E"] @ w[n]).take(rows, axis=0)) for n in "KV")
        # logits are clipped, not shifted: sums by products with ones are far cheaper than maxima along rows
        a = q @ k.transpose(0, 2, 1)
        a += w["R"]
        np.clip(a, -60, 60, out=a)
        np.exp(a, out=a)
        a *= self.open
        a[first, :, :BLOCK] = 0
        a /= a @ np.ones((2 * BLOCK, 1), np.float32)
        o = (a @ v).reshape(-1, WIDTH)
        z = o @ w["U"]
        z += w["B"].take(rows[1:].ravel(), axis=0)
        np.clip(z, -60, 60, out=z)
        np.exp(z, out=z)
        z /= z @ np.ones((CLASSES, 1), np.float32)
        return z, (rows, q, k, v, a, o)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The layer as tables: exponentials of masked scores by (place, class) of a query and a key, logits of a query's
        class, and what a key's class adds to them. There are few classes, so nothing has to be multiplied out again."""
        w, n = self.w, CLASSES + 1
        s = (w["E"] @ w["Q"]) @ (w["E"] @ w["K"]).T * np.float32(WIDTH**-0.5)
        s = np.exp(np.clip(s[None, :, None, :] + w["R"][:, None, :, None], -60, 60)) * self.open[:, None, :, None]
        return s.reshape(BLOCK * n, 2 * BLOCK * n), w["B"], w["E"] @ w["V"] @ w["U"]

    def log_classes(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, tables: tuple) -> np.ndarray:
        """Log-probability of each target, as forward() has it, from the tables."""
        pair, own, add = tables
        at = x + np.arange(2 * BLOCK, dtype=np.int32) * (CLASSES + 1)
        q = (at[:, BLOCK:] - BLOCK * (CLASSES + 1)) * pair.shape[1]
        a = pair.ravel().take(q[:, :, None] + at[:, None, :], mode="clip")
        a[first, :, :BLOCK] = 0
        a /= a @ np.ones((2 * BLOCK, 1), np.float32)
        z = a @ add.take(x, axis=0)
        z += own.take(x[:, BLOCK:], axis=0)
        np.clip(z, -60, 60, out=z)
        got = np.take_along_axis(z, np.maximum(y, 0)[..., None], 2)[..., 0]
        return got - np.log((np.exp(z, out=z) @ np.ones((CLASSES, 1), np.float32))[..., 0])

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss of consecutive blocks and its flat gradient; y: the next class, or -1 where there is none."""
        w, nb, live = self.w, len(x), y.ravel() >= 0
        z, (rows, q, k, v, a, o) = self.forward(x, first)
        at, want, n = np.arange(len(live)), np.maximum(y, 0).ravel(), max(1, int(live.sum()))
        loss = -float(np.log(np.maximum(z[at, want][live], 1e-30)).sum()) / n
        z[at, want] -= 1
        if n < len(live):
            z[~live] = 0
        z *= np.float32(1 / n)
        out = np.zeros_like(self.flat)
        g = self._parts(out)
        g["U"][:] = o.T @ z
        do = (z @ w["U"].T).reshape(nb, BLOCK, WIDTH)
        da, dv = do @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ do
        da -= np.einsum("ijk,ijk->ij", da, a)[..., None]
        da *= a
        g["R"][:] = da.sum(0)
        # rows are summed by class through products with 0 and 1, much faster than adding them one by one; the keys of a
        # block lie behind those of the block before
        hot = np.zeros((rows.size, CLASSES + 1), np.float32)
        hot[np.arange(rows.size), rows.ravel()] = 1
        own, before = hot[BLOCK:].T, hot[:-BLOCK].T
        g["B"][:] = own @ z
        keys, values = da.transpose(0, 2, 1) @ q, dv
        flat = lambda x: np.ascontiguousarray(x).reshape(-1, WIDTH)
        both = lambda x: before @ flat(x[:, :BLOCK]) + own @ flat(x[:, BLOCK:])
        scale = np.float32(WIDTH**-0.5)
        for name, d in (("Q", own @ (da @ k).reshape(-1, WIDTH) * scale), ("K", both(keys)), ("V", both(values))):
            g[name][:] = w["E"].T @ d
            g["E"][:] += d @ w[name].T
        return loss, out

    def step(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One step of Adam."""
        loss, g = self.gradient(x, first, y)
        self.steps += 1
        self.mean += np.float32(0.1) * (g - self.mean)
        self.square += np.float32(0.01) * (g * g - self.square)
        root = np.sqrt(self.square * np.float32(1 / (1 - 0.99**self.steps)))
        root += np.float32(1e-6)
        self.flat -= np.float32(rate / (1 - 0.9**self.steps)) * self.mean / root
        return loss


def blocks(classes: np.ndarray, offs: np.ndarray, most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All blocks of all rows, `most` at a time: inputs (blocks, 2 * BLOCK), no block before, targets (-1: none)."""
    n = np.diff(offs)
    k = -(-n // BLOCK)
    row = np.repeat(np.arange(len(n)), k)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    before = np.concatenate([[CLASSES], classes, np.zeros(BLOCK, classes.dtype)]).astype(np.int32)  # the class before each
    before[offs[:-1]] = CLASSES  # the start before a row's first
    after = np.concatenate([classes, np.zeros(BLOCK, classes.dtype)]).astype(np.int32)
    for lo in range(0, len(row), most):
        r, j = row[lo : lo + most], nth[lo : lo + most]
        place = (offs[r] + j * BLOCK)[:, None] + np.arange(BLOCK)
        live = place < offs[r + 1][:, None]
        x = np.full((len(r), 2 * BLOCK), CLASSES, np.int32)
        x[:, BLOCK:] = np.where(live, before[place], CLASSES)
        x[j > 0, :BLOCK] = before[place[j > 0] - BLOCK]
        yield x, j == 0, np.where(live, after[place], -1)


def cluster(context: np.ndarray, classes: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """The class of each symbol: weighted k-means on the square roots of its context shares; rare ones share a class."""
    total = context.sum(1)
    some = np.flatnonzero(total >= 5)
    out = np.zeros(len(context), np.int64)
    if len(some) <= classes:
        out[some] = np.arange(len(some)) % classes
        return out
    x = np.sqrt(context[some] / total[some, None])
    weight = np.sqrt(total[some])
    centre = x[np.argsort(-total[some], kind="stable")[:classes]]
    for _ in range(rounds):
        own = np.argmax(x @ centre.T - 0.5 * (centre**2).sum(1), axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x * weight[:, None])
        n = np.bincount(own, weight, classes)
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-9)[:, None], centre)
    out[some] = own
    out[total < 5] = np.argmin(np.bincount(own, minlength=classes))
    return out


def bucket(symbols: np.ndarray) -> np.ndarray:
    return ((symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.int64)


def before(symbols: np.ndarray, offs: np.ndarray, end: int) -> np.ndarray:
    """The bucket of the symbol before each one; the end's at the start of a row."""
    b = np.empty(len(symbols), np.int64)
    if len(symbols):
        b[1:] = bucket(symbols[:-1])
        b[offs[:-1]] = bucket(np.array([end]))[0]
    return b


@dataclass
class Unit:
    """Some documents as codes of words, and the spelling of each distinct word."""

    valid: np.ndarray
    ids: np.ndarray
    held: np.ndarray
    hashes: np.ndarray
    n_words: np.ndarray
    codes: np.ndarray
    size: np.ndarray  # symbols of each distinct word
    flat: np.ndarray  # the symbols, put together

    def pressed(self) -> tuple[bytes, bytes, bytes]:
        planes = np.ascontiguousarray(self.codes.astype("<u4")).view(np.uint8).reshape(-1, 4).T
        docs = pressed(self.valid.astype("u1"), self.held.astype("u1"), self.ids.astype("<i8"), self.hashes.astype("<i8"), self.n_words.astype("<i8"))
        at = pressed(self.size.astype("<u4"))
        return docs, pressed(planes), len(at).to_bytes(8, "little") + at + pressed(self.flat.astype("<u4"))

    @staticmethod
    def of(docs: bytes, codes: bytes, spelled: bytes) -> Unit:
        valid, held, ids, hashes, n = unpressed(docs, "u1", "u1", "<i8", "<i8", "<i8")
        raw = unpressed(codes, "u1")[0].reshape(4, -1)
        k = 8 + int.from_bytes(spelled[:8], "little")
        flat = unpressed(spelled[k:], "<u4")[0].astype(np.int64)
        return Unit(valid.astype(bool), ids, held.astype(bool), hashes, n, np.ascontiguousarray(raw.T).view("<u4").ravel(), unpressed(spelled[8:k], "<u4")[0].astype(np.int64), flat)

    def symbols(self, end: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols with the end after each document, the documents' offsets, and where each word starts; rows: which documents."""
        n, codes = self.n_words, self.codes
        if rows is not None:
            codes, n = codes[ranges((np.cumsum(n) - n)[rows], n[rows])], n[rows]
        size = self.size[codes]
        first = np.cumsum(self.size) - self.size
        words = np.concatenate([[0], np.cumsum(size)])
        doc = np.concatenate([[0], np.cumsum(n)])
        flat = self.flat[ranges(first[codes], size)]
        at = words[doc]
        return np.insert(flat, at[1:], end), at + np.arange(len(at)), words[:-1] + np.repeat(np.arange(len(n)), n)


def spelling(path: str, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of distinct words put together, and how many each has. A word without ids is one symbol of its own."""
    tok = subwords(path)
    m = len(tok.bytes)
    ids, offs = tok.column(pc.binary_join_element_wise(b" ", distinct, b"").cast(pa.utf8()))
    size = np.diff(offs)
    ids = np.insert(ids.astype(np.int64), offs[1:][size == 0], m)
    size = np.maximum(size, 1)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(size) - 1] = True
    return np.where(last, ids, ids + m + 2), size


def vocabulary(path: str) -> tuple[int, int]:
    """How many symbols there are, and the end's: ids, the wordless one and the end, each last in its word or not."""
    m = len(subwords(path).bytes)
    return 2 * (m + 2), m + 1


def task_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def analysed(docs: DataFrame, path: str, buckets: int, folds: int, held: int) -> DataFrame:
    """Stored, in one pass over the texts. kind 0: units; kind 1: a unit's distinct words of a bucket, as hashes and
    training counts; kind 2: slices of a task's context counts."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, end = vocabulary(path)
        context = np.zeros(size * COLUMNS, np.uint32)
        task, k = task_id(), 0
        for b in gathered(it, UNIT_BYTES):
            data, offs = utf8(b.column("text"))
            starts, ends = word_spans(data, offs, "space")
            data = LOWER[data]
            codes, distinct = word_hashes(word_array(data, starts, ends))
            hashes, n = hash64(distinct), np.bincount(codes, minlength=len(distinct))
            flat, sizes = spelling(path, distinct)
            doc = np.searchsorted(starts, offs)
            out = b.column("held").to_numpy(zero_copy_only=False).astype(bool)
            learned = np.bincount(codes[np.repeat(~out, np.diff(doc))], minlength=len(distinct))
            rank = np.argsort(-n, kind="stable")  # frequent words have small codes, which compress
            code = np.empty(len(rank), np.int64)
            code[rank] = np.arange(len(rank))
            ids = b.column("doc_id")
            unit = Unit(
                ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), out,
                b.column("h").to_numpy(zero_copy_only=False), np.diff(doc), code[codes], sizes[rank], flat[ranges((np.cumsum(sizes) - sizes)[rank], sizes[rank])],
            )
            name = task << 32 | k
            k += 1
            part = (hashes[rank] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(buckets + 1))
            parts, codes_, spelled = unit.pressed()
            rows = [(0, name, None, None, parts, codes_, spelled, pressed(order.astype("<u4")), None)]
            for p in np.unique(part).tolist():
                i = rank[order[cut[p] : cut[p + 1]]]
                rows.append((1, name, p, int(cut[p]), None, None, None, hashes[i].astype("<u8").tobytes(), learned[i].astype("<u4").tobytes()))
            yield _batch(ANALYSED, rows)
            if not out.all():
                symbols, edge, words = unit.symbols(end, np.flatnonzero(~out))
                np.add.at(context, symbols * COLUMNS + before(symbols, edge, end), np.uint32(1))
                opens = symbols[np.concatenate([words, edge[1:] - 1])]
                np.add.at(context, opens * COLUMNS + BUCKETS, np.uint32(1))
        if k:
            cut = np.linspace(0, size, SLICES + 1).astype(int) * COLUMNS
            yield _batch(ANALYSED, [(2, task, i, None, None, None, None, pressed(context[x:y].astype("<u4")), None) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True))])
        settle()

    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    rows = texts(docs).withColumn("held", fold == held).withColumn("h", F.xxhash64("doc_id", "text"))
    return stored(rows.mapInArrow(read, ANALYSED), "lm-analysed")


def word_counts(rows: DataFrame) -> DataFrame:
    """Stored training counts, sent back to the units that hold the words; types and tokens once a bucket (unit null)."""

    def total(t: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("a")]
        n = [np.frombuffer(x.as_buffer(), "<u4") for x in t.column("b")]
        h, back = np.unique(np.concatenate(hashes), return_inverse=True)
        c = np.bincount(back, np.concatenate(n), len(h)).astype("<i8")
        cut = np.concatenate([[0], np.cumsum([len(x) for x in n])])
        own = [c[back[x:y]].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
        out = [(u, a, o, 0, 0) for u, a, o in zip(t.column("unit").to_pylist(), t.column("at").to_pylist(), own, strict=True)]
        return pa.Table.from_batches([_batch(COUNTS, [*out, (None, None, None, int((c > 0).sum()), int(c.sum()))])])

    return stored(rows.filter("kind = 1").select("unit", "key", "at", "a", "b").groupBy("key").applyInArrow(total, COUNTS), "lm-counts")


def contexts(rows: DataFrame, size: int) -> np.ndarray:
    """Context counts of all symbols, summed in a tree of FAN tasks: `size` x COLUMNS numbers reach the driver."""

    def total(t: pa.Table) -> pa.Table:
        out = None
        for x in t.column("a"):
            v = unpressed(x.as_py(), "<u8" if wide else "<u4")[0].astype("<u8")
            out = v if out is None else out + v
        return pa.table({"key": t.column("key").slice(0, 1), "unit": t.column("lot").slice(0, 1), "a": pa.array([pressed(out)], pa.binary())})

    wide, now = False, rows.filter("kind = 2").select("key", "unit", "a")
    while True:
        most = now.agg(F.max("unit")).first()[0] or 0
        lots = now.withColumn("lot", F.floor(F.col("unit") / FAN)).groupBy("key", "lot").applyInArrow(total, "key long, unit long, a binary")
        if most < FAN:
            found = lots.collect()
            break
        now, wide = stored(lots, "lm-contexts"), True
    flat = [unpressed(r["a"], "<u8")[0] for r in sorted(found, key=lambda r: r["key"])]
    return (np.concatenate(flat) if flat else np.zeros(size * COLUMNS, np.int64)).reshape(size, COLUMNS).astype(np.float64)


class Model:
    """All that scoring needs, but for the word counts."""

    def __init__(self, path: str, counts: np.ndarray):
        context, opens = counts[:, :BUCKETS], counts[:, BUCKETS]
        self.path, self.end = path, vocabulary(path)[1]
        self.of = cluster(context)
        self.begins = np.bincount(self.of, opens, CLASSES)  # training words by the class of their first symbol
        total = context.sum(1)
        in_class = np.bincount(self.of, total + 0.5, CLASSES)
        self.plain = ((total + 0.5) / in_class[self.of]).astype(np.float32)  # a symbol within its class
        self.context = context.astype(np.float32)
        self.sums = np.zeros((CLASSES, BUCKETS))
        np.add.at(self.sums, self.of, context)
        self.n_symbols, self.learned = int(total.sum()), int(total[self.end])
        self.weights = Attention(self.bigrams()).flat

    def bigrams(self) -> np.ndarray:
        """Class after class, from the buckets of the classes' symbols."""
        total = self.context.sum(1)
        share = np.zeros((CLASSES + 1, BUCKETS))
        np.add.at(share, (self.of, bucket(np.arange(len(self.of)))), total)
        share[CLASSES, bucket(np.array([self.end]))] += 1
        return share / np.maximum(share.sum(0), 1) @ self.sums.T

    def within(self, symbols: np.ndarray, b: np.ndarray, less: int = 0) -> np.ndarray:
        """The share of symbols in their classes after buckets; less: taken off the counts."""
        own = np.maximum(self.context[symbols, b] - less, 0) + SMOOTH * self.plain[symbols]
        return own / (np.maximum(self.sums[self.of[symbols], b] - less, 0) + SMOOTH)

    def log_symbols(self, net: Attention, symbols: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log-probability of each symbol's class, the share of the symbol within it, and the buckets before."""
        held, out, at = net.tables(), np.empty(len(symbols)), 0
        for x, first, y in blocks(self.of[symbols], offs, 256):
            got = net.log_classes(x, first, y, held)[y >= 0]  # blocks, and targets in them, are in order
            out[at : at + len(got)] = got
            at += len(got)
        b = before(symbols, offs, self.end)
        return out, self.within(symbols, b), b


def averaged(rows: DataFrame) -> np.ndarray | None:
    """Weights of slices, averaged by symbols in a tree, in order of the slices; rows as in WEIGHTS, of doubles."""

    def mean(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("slice").to_numpy(), kind="stable")
        n = t.column("n").to_numpy()[order]
        w = np.array([np.frombuffer(t.column("w")[int(i)].as_buffer(), "<f8") for i in order])
        out = (w * n[:, None]).sum(0) / n.sum()
        return pa.Table.from_batches([_batch(WEIGHTS, [(t.column("lot")[0].as_py(), int(n.sum()), out.astype("<f8").tobytes())])])

    while True:
        rows = stored(rows, "lm-weights")
        most = rows.agg(F.max("slice")).first()[0]
        if most is None:
            return None
        rows = rows.withColumn("lot", F.floor(F.col("slice") / FAN)).groupBy("lot").applyInArrow(mean, WEIGHTS)
        if most < FAN:
            return np.frombuffer(rows.first()["w"], "<f8").astype(np.float32)


def train(units: DataFrame, model: Model, part: int = 4) -> None:
    """Sets the model's weights. Every window of every training text is trained on once, in its slice."""
    spark = units.sparkSession
    slices = max(1, -(-model.n_symbols // SLICE))

    def trained(odd: bool, rate: float) -> np.ndarray | None:
        shared = spark.sparkContext.broadcast((model.of.astype(np.uint8), model.end, model.weights))

        def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, end, _ = shared.value
            for b in it:
                for i in range(b.num_rows):
                    u = Unit.of(*(b.column(c)[i].as_py() for c in ("docs", "codes", "spelled")))
                    to = u.hashes % slices
                    take = np.flatnonzero(~u.held & ((to % part != 0) == odd))
                    symbols, offs, _ = u.symbols(end, take)
                    own = of[symbols]
                    yield pa.RecordBatch.from_arrays([pa.array(to[take]), pa.array(u.hashes[take]), pa.array([own[x:y].tobytes() for x, y in zip(offs[:-1], offs[1:], strict=True)], pa.binary())], names=["slice", "h", "classes"])

        def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start = shared.value[2]
            at, net, n, left = None, None, 0, None

            def steps(more, final=False):
                """Steps on whole batches of blocks; what is left waits for the next documents of the slice."""
                nonlocal left
                have = more if left is None else [np.concatenate(p) for p in zip(left, more, strict=True)]
                k = len(have[0]) if final else len(have[0]) // BATCH * BATCH
                for lo in range(0, k, BATCH):
                    net.step(*(h[lo : min(k, lo + BATCH)] for h in have), rate)
                left = [h[k:] for h in have]

            def ended():
                if left is not None and len(left[0]):
                    steps([h[:0] for h in left], True)
                return _batch(WEIGHTS, [(at, n, net.flat.astype("<f8").tobytes())])

            for b in gathered(it, 4 << 20, "classes"):
                s = b.column("slice").to_numpy()
                cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    if s[lo] != at:
                        if net:
                            yield ended()
                        at, net, n, left = int(s[lo]), Attention(flat=start), 0, None
                    rows = b.column("classes").slice(lo, hi - lo)
                    sizes = np.array([len(x.as_buffer()) for x in rows])
                    classes = np.frombuffer(b"".join(x.as_buffer() for x in rows), np.uint8)
                    for more in blocks(classes, np.concatenate([[0], np.cumsum(sizes)])):
                        steps(list(more))
                    n += len(classes)
            if net:
                yield ended()
            settle()

        rows = units.select("docs", "codes", "spelled").mapInArrow(deal, "slice long, h long, classes binary")
        out = averaged(rows.repartition("slice").sortWithinPartitions("slice", "h", "classes").mapInArrow(learn, WEIGHTS))
        shared.unpersist()
        return out

    for odd, rate in zip((False, True), RATES, strict=True):
        if odd and slices == 1:
            break
        got = trained(odd, rate)
        if got is not None:
            model.weights = got


@dataclass
class Prepared:
    """Units, counts sent back to them, the totals of base scores, and the model."""

    units: DataFrame
    counts: DataFrame
    learned: int
    types: int
    tokens: int
    model: Model


def prepare(docs: DataFrame, tokenizer: str, folds: int = 5, held: int = 1) -> Prepared:
    """Reads, counts and trains."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = analysed(docs, tokenizer, -(-input_bytes(docs) // BUCKET_BYTES) or parts, folds, held)
    counts = word_counts(rows)
    sums = counts.filter("unit is null").agg(F.sum("types"), F.sum("tokens")).first()
    model = Model(tokenizer, contexts(rows, vocabulary(tokenizer)[0]))
    learned = model.learned
    units = rows.filter("kind = 0").select("unit", "docs", "codes", "spelled", "a")
    train(units, model)
    return Prepared(units, counts.filter("unit is not null"), learned, (sums[0] or 0) + (learned > 0), (sums[1] or 0) + learned, model)


@tidy
def score(docs: DataFrame, tokenizer: str, folds: int = 5, held: int = 1) -> DataFrame:
    """Every document with its unigram base score and the model's score (log10), stored."""
    p = prepare(docs, tokenizer, folds, held)
    shared = docs.sparkSession.sparkContext.broadcast(p.model)
    learned, tokens = p.learned, p.tokens
    floor = tokens + 0.5 * (p.types + 1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        net = Attention(flat=m.weights)
        for b in it:
            for i in range(b.num_rows):
                u = Unit.of(*(b.column(c)[i].as_py() for c in ("docs", "codes", "spelled")))
                known = sorted((r["at"], r["counts"]) for r in b.column("known")[i].as_py() or ())
                each = np.zeros(len(u.size), np.int64)
                order = unpressed(b.column("a")[i].as_py(), "<u4")[0]
                each[order] = np.frombuffer(b"".join(k[1] for k in known), "<i8")
                doc = np.concatenate([[0], np.cumsum(u.n_words)])
                sums = np.concatenate([[0], np.cumsum(np.log10((each + 0.5) / floor)[u.codes])])
                base = np.diff(sums[doc]) + np.log10((learned + 0.5) / floor)
                seen = np.diff(np.concatenate([[0], np.cumsum((each > 0)[u.codes])])[doc]) + (learned > 0)
                edge = doc + np.arange(len(doc))
                own = np.array([np.diff(np.concatenate([[0], np.cumsum(x)])[edge]) for x in log_words(m, net, u, each, learned)]) / LN10
                k, half = len(u.ids), len(SHARES)
                lists = pa.array(np.arange(0, k * half + 1, half), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(u.ids, mask=~u.valid), pa.array(u.held), pa.array(u.n_words + 1), pa.array(seen.astype(np.int64)),
                    pa.array([tokens] * k, pa.int64()), pa.array(base),
                    *(pa.ListArray.from_arrays(lists, pa.array(np.ascontiguousarray(x.T).ravel())) for x in (own[:half], own[half:])),
                ], names=_names(SCORED))
        settle()

    known = p.counts.groupBy("unit").agg(F.collect_list(F.struct("at", "counts")).alias("known"))
    rows = stored(p.units.join(known, "unit", "left").select("docs", "codes", "spelled", "a", "known").mapInArrow(run, SCORED), "lm-scores", keep=True)
    shared.unpersist()
    fits = rows.filter("not held_out").agg(*[F.sum(F.get("fits", F.lit(i))).alias(str(i)) for i in range(len(SHARES))]).first()
    best = max(range(len(SHARES)), key=lambda i: -np.inf if fits[i] is None else fits[i])
    return rows.withColumn("score", F.get("scores", F.lit(best))).drop("scores", "fits")


def log_words(m: Model, net: Attention, u: Unit, each: np.ndarray, learned: int, shares: tuple = SHARES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Natural log-probabilities of all words of the documents, the end after each document, for each share; and those
    with every word left out of the counts it is judged by. each: counts of distinct words."""
    symbols, offs, words = u.symbols(m.end)
    by_class, within, b = m.log_symbols(net, symbols, offs)
    at = np.sort(np.concatenate([words, offs[1:] - 1]))  # first symbols of words, and ends
    is_end = symbols[at] == m.end
    count = np.empty(len(at))
    count[~is_end], count[is_end] = each[u.codes], learned
    begins = m.begins[m.of[symbols[at]]]
    for less in (0, 1):
        if less:
            within = m.within(symbols, b, 1)
        run = np.concatenate([[0], np.cumsum(by_class + np.log(within))])
        rest = run[np.append(at[1:], len(symbols))] - run[at + 1]  # of the symbols after the first
        counted = np.maximum(count - less, 0) / np.maximum(begins - less, 1)
        some, spelled = begins > less, within[at] * np.exp(rest)
        for share in shares:
            yield by_class[at] + np.log(np.where(some, share * counted + (1 - share) * spelled, spelled))
