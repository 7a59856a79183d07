"""What the operators share: the shared folder, byte-level word splitting, and small numpy helpers.

Text conventions: a null text is an empty text; ids and texts may repeat; extra columns are ignored.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at a time inside a task.
CHUNK_BYTES = 2 << 20


#: What Arrow batches hold while a table is stored: long rows go to Python in small batches, to bound its memory.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one, on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed, and put back in the end."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes in the end what is stored within, but for what is stored to be kept: that belongs to the scratch around."""
    own: list[str] = []
    outer = _scratch.get()
    token = _scratch.set(own)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in own:
            if path.startswith("keep:"):
                if outer is not None:
                    outer.append(path.removeprefix("keep:"))
                continue
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidy(operator):
    """An operator whose intermediate tables are deleted when it returns; its result is stored to be kept."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs):
        with scratch(docs.sparkSession):
            return operator(docs, *args, **kwargs)

    return run


def place(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; what is written there is deleted with the scratch around, if there is one."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    if (own := _scratch.get()) is not None:
        own.append(f"keep:{path}" if keep else path)
    return path


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df, written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = place(spark, name, keep)
    with settings(spark, SMALL_BATCHES):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of a table, which for files is theirs: no rows are read. 0 where it is not known."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key as long and text, null texts empty."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def batches(it: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of `column`; one long text stays whole."""
    for batch in it:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        offs = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))])
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    settle()


def gathered(it: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of `column`, put together or cut; one long text stays whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches(it, column, limit):
        own = pc.sum(pc.binary_length(b.column(b.schema.get_field_index(column)))).as_py() or 0
        if held and size + own > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pressed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length put together and compressed."""
    return zstandard.ZstdCompressor(3).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpressed(raw: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays, of these kinds."""
    raw = zstandard.ZstdDecompressor().decompress(raw)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.frombuffer(raw, k, n, at))
        at += n * w
    return out


def settle() -> None:
    """Hands freed memory back to the system at the end of a task: workers live on, for tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column put together (uint8), and the offsets of its rows (int64)."""
    col = pc.fill_null(col, "")
    sizes = pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if not offs[-1]:
        return np.zeros(0, np.uint8), offs
    col = col.cast(pa.large_utf8()) if not pa.types.is_large_string(col.type) else col
    base = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)[0]
    return np.frombuffer(col.buffers()[2], np.uint8, int(offs[-1]), int(base)), offs


def _table(in_word: str) -> np.ndarray:
    t = np.zeros(256, bool)
    if in_word == "space":  # [^\x20\x09-\x0D]
        t[:] = True
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:  # [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z are lower-cased
        t[0x30:0x3A] = t[0x61:0x7B] = True
        t[0x80:] = True
    return t


WORD = {k: _table(k) for k in ("space", "alnum")}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_spans(data: np.ndarray, offs: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in `data`; a word never crosses a row border."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = WORD[kind][data]
    border = np.zeros(n + 1, bool)
    border[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | border[1:n]
    end = np.zeros(n + 1, bool)
    end[1:] = inside
    end[1:n] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(start), np.flatnonzero(end)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow binary array."""
    sizes = ends - starts
    offs = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], sizes)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words, and the distinct words."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def words64(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number; zeros follow the end."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(pad, (len(data), 8), (1, 1))).view("<u8").ravel()


def hash64(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each binary value, the same in every process: eight bytes of all values at a time."""
    n = len(distinct)
    if not n:
        return np.zeros(0, np.uint64)
    offs = np.frombuffer(distinct.buffers()[1], np.int32, n + 1, 4 * distinct.offset).astype(np.int64)
    data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
    eight = words64(data)
    left = np.diff(offs)
    h = mix(left.astype(np.uint64) + np.uint64(0x51ED270B))
    live, at = np.flatnonzero(left > 0), offs[:-1][left > 0]
    left = left[live]
    while len(live):
        v = eight[at]
        short = left < 8
        v[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        h[live] = mix(h[live] ^ v) + np.uint64(0x9E3779B97F4A7C15)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (sizes[0] of them), then the same for the next, put together."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - np.concatenate([[0], ends[:-1]]), sizes) if len(sizes) else np.zeros(0, np.int64)
