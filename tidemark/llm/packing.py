"""Packing: concatenate and cut.

Pass one encodes every text and stores ids with their offset inside their partition; the partitions' totals (one
row each) are summed up on the driver into global offsets. Pass two cuts each document at the multiples of the
window and writes a record per piece. Nothing is shuffled, and only the last window can hold padding.

Defined results: a null or empty text is its end id alone; repeated rows are packed as often as they occur; an
empty table gives no rows; extra columns are ignored; a text longer than a window spans several.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches, stored, texts, tidy
from tidemark.llm.subwords import subwords

TOKENS = "doc_id long, part int, local_start long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Stored rows (doc_id, part, local_start, n, ids): ids as little-endian unsigned 32- or 16-bit binary."""

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, done = subwords(tokenizer), 0
        for b in batches(it):
            ids, offs = tok.column(b.column("text"))
            k = b.num_rows
            full = np.insert(ids, offs[1:], end_id).astype("<u2" if max(end_id, 65535) <= 65535 and (not len(ids) or ids.max() < 65536) else "<u4")
            offs = offs + np.arange(k + 1)
            raw, w = full.tobytes(), full.itemsize
            n = np.diff(offs)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("part"), pa.array(done + offs[:-1], pa.int64()), pa.array(n, pa.int64()),
                pa.array([raw[x * w : y * w] for x, y in zip(offs[:-1], offs[1:], strict=True)], pa.binary()),
            ], names=["doc_id", "part", "local_start", "n", "ids"])
            done += int(offs[-1])

    return stored(texts(docs).withColumn("part", F.spark_partition_id()).mapInArrow(encode, TOKENS), "packed-ids")


def bases(tokens: DataFrame) -> DataFrame:
    """(part, base): tokens before each partition. One row per partition goes through the driver."""
    spark = tokens.sparkSession
    rows = tokens.groupBy("part").agg(F.max(F.col("local_start") + F.col("n")).alias("n")).orderBy("part").collect()
    sums = np.concatenate([[0], np.cumsum([r["n"] for r in rows])]).astype(int).tolist()
    return spark.createDataFrame([(r["part"], b) for r, b in zip(rows, sums, strict=False)], "part int, base long")


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


@tidy
def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    """One row per piece: the document's ids from `start` on, `length` of them, lie in `sequence_id` from `offset` on."""
    tokens = encoded(docs, tokenizer, end_id)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            g, n = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("global_start", "n"))
            first = g // window
            k = (g + n - 1) // window - first + 1
            row = np.repeat(np.arange(len(g)), k)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            lo, hi = np.maximum(g[row], seq * window), np.minimum((g + n)[row], (seq + 1) * window)
            start = lo - g[row]
            crc, held, ids = np.zeros(len(row), np.int64), -1, b""
            raw = b.column("ids")
            for i, (r, s, e) in enumerate(zip(row.tolist(), start.tolist(), (hi - g[row]).tolist(), strict=True)):
                if r != held:
                    held, ids = r, unpacked(raw[r].as_py(), int(n[r])).tobytes()
                crc[i] = zlib.crc32(ids[4 * s : 4 * e])
            doc = b.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([doc, *map(pa.array, (start, hi - lo, crc, n[row], seq, lo - seq * window))], names=[c.split()[0] for c in PIECES.split(", ")])

    placed = tokens.join(F.broadcast(bases(tokens)), "part").select("doc_id", "n", "ids", (F.col("base") + F.col("local_start")).alias("global_start"))
    return stored(placed.mapInArrow(cut, PIECES), "packed", keep=True)
