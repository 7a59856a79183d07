"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are ranked by their count in the whole corpus (the table is bounded by the vocabulary). A file row holds a
block: the documents' ids and lengths, two control bits per token (bytes used less one, four tokens to a control
byte), and the data bytes (little-endian rank). Decoding looks the control bytes up in a 256-row table with numpy.
Files are Parquet rows written by Spark's own commit protocol, in ascending document order.

Defined results: a null or empty text is its end id alone; repeated ids are kept, in order of their texts' hashes
(equal ones: of the texts); a null document id comes first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SMALL_BATCHES, batches, place, settings, stored, texts, tidy
from tidemark.llm.subwords import subwords

BLOCK = "part int, block long, first long, n_docs int, doc_ids binary, lengths binary, control binary, data binary"
KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
DOCS = "doc_id long, part int, start long, n_tokens long, ids_crc32 long"

#: For a control byte: the bytes each of its four tokens takes.
WIDTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of uint32 ranks."""
    ranks = ranks.astype("<u4")
    width = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-len(ranks) % 4 + len(ranks), np.uint8)
    codes[: len(ranks)] = width - 1
    q = codes.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    keep = np.arange(4) < width[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The uint32 ranks again."""
    width = WIDTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < width[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def id_counts(raw: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the corpus: sums per task, then over tasks; `size` numbers reach the driver."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in it:
            for x in b.column("data"):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u4" if size > 65536 else "<u2"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = raw.select("data").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> np.ndarray:
    """Writes the files under `path`; returns the id of each rank, also kept in `path`/ranks."""
    spark = docs.sparkSession
    size = max(subwords(tokenizer).tok.get_vocab_size(with_added_tokens=True), end_id + 1)
    names, kind = [c.split()[0] for c in BLOCK.split(", ")], "<u4" if size > 65536 else "<u2"

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, done, k = subwords(tokenizer), 0, 0
        for b in batches(it):
            ids, offs = tok.column(b.column("text"))
            full = np.insert(ids, offs[1:], end_id)
            n = np.diff(offs) + 1
            doc = b.column("doc_id").cast(pa.int64())
            null = doc.is_null().to_numpy(zero_copy_only=False)
            doc = pc.fill_null(doc, 0).to_numpy(zero_copy_only=False)
            lengths = np.where(null, -n, n).astype("<i8")  # a length below zero: no document id
            row = (b.column("part")[0].as_py(), k, done, len(n), doc.astype("<i8").tobytes(), lengths.tobytes(), b"", full.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, KINDS, strict=True)], names=names)
            done += int(n.sum())
            k += 1

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(docs).repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    raw = stored(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(blocks, BLOCK), "token-ids")
    by_rank = np.argsort(-id_counts(raw, size), kind="stable")
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size)

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [encode_ranks(rank[np.frombuffer(x.as_buffer(), kind)]) for x in b.column("data")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary())], names=names)

    with settings(spark, SMALL_BATCHES):
        raw.mapInArrow(code, BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(size), "id": by_rank}), "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    return by_rank


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: doc_id, part, start (inside the part), n_tokens, ids_crc32 of the decoded ids."""
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                n = np.frombuffer(r["lengths"], "<i8")
                null, n = n < 0, np.abs(n)
                ids = by_rank[decode_ranks(r["control"], r["data"], int(n.sum()))].astype("<u4").tobytes()
                end = np.cumsum(n)
                crc = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip((end - n).tolist(), end.tolist(), strict=True)]
                doc = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=null)
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.full(len(n), r["part"], np.int32)), pa.array(r["first"] + end - n), pa.array(n), pa.array(crc, pa.int64())], names=[c.split()[0] for c in DOCS.split(", ")])

    return stored(spark.read.schema(BLOCK).parquet(f"{path}/blocks").mapInArrow(decode, DOCS), "token-documents", keep=True)


def tokens_of(spark: SparkSession, path: str) -> DataFrame:
    """The ids themselves: doc_id, ids array<int>."""
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                n = np.frombuffer(r["lengths"], "<i8")
                null, n = n < 0, np.abs(n)
                ids = by_rank[decode_ranks(r["control"], r["data"], int(n.sum()))].astype(np.int32)
                offs = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=null), pa.ListArray.from_arrays(offs, pa.array(ids))], names=["doc_id", "ids"])

    return stored(spark.read.schema(BLOCK).parquet(f"{path}/blocks").mapInArrow(decode, "doc_id long, ids array<int>"), "token-lists", keep=True)


@tidy
def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the documents' files into the shared folder and lists what they hold, with global starts."""
    spark = docs.sparkSession
    path = place(spark, "tokens")
    write(docs, path, tokenizer, end_id)
    found = read(spark, path)
    rows = found.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).orderBy("part").collect()
    sums = np.concatenate([[0], np.cumsum([r["n"] for r in rows])]).astype(int).tolist()
    base = spark.createDataFrame([(r["part"], b) for r, b in zip(rows, sums, strict=False)], "part int, base long")
    return found.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
