"""Tensor files of one layer and example, as rows of the long form.

The files are zip archives: a pickle of a dict of tensors that point to storages, and the storages' bytes. Reading
takes no library: the pickle may name tensors, storages and ordered dicts only, and nothing of it is executed.
Writing puts down bfloat16 tensors.
"""

from __future__ import annotations

import io
import pickle
import re
import struct
import zipfile
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import VECTORS

#: {task}/{example}/layer_{nn}.pt, and names such as Q_rope_head0, K_raw_kvhead1, V_kvhead0.
PATH = re.compile(r"([^/]+)/([^/]+)/layer_(\d+)\.pt$")
NAME = re.compile(r"([QK]_(?:rope|raw)|V)_(?:kv)?head(\d+)$")

# How storages are called, and what they hold.
STORAGES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "BFloat16Storage": "<u2"}


def parsed(path: str, name: str) -> tuple[str, str, int, str, int]:
    """(task, example_id, layer, tensor, head) of a tensor."""
    p, n = PATH.search(path), NAME.match(name)
    if not p or not n:
        raise ValueError(f"not a tensor of a layer: {path}: {name}")
    return p[1], p[2], int(p[3]), n[1], int(n[2])


class _Reader(pickle.Unpickler):
    def __init__(self, archive: zipfile.ZipFile, root: str):
        super().__init__(io.BytesIO(archive.read(f"{root}/data.pkl")))
        self.archive, self.root = archive, root

    def find_class(self, module: str, name: str):
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return self.tensor
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        if module == "torch" and name in STORAGES:
            return name
        raise ValueError(f"not part of a tensor file: {module}.{name}")

    def persistent_load(self, at: tuple) -> np.ndarray:
        _, kind, key, _, n = at
        raw = np.frombuffer(self.archive.read(f"{self.root}/data/{key}"), STORAGES[kind], n)
        return (raw.astype("<u4") << 16).view("<f4") if kind == "BFloat16Storage" else raw

    @staticmethod
    def tensor(storage: np.ndarray, first: int, shape: tuple, strides: tuple, *_) -> np.ndarray:
        strides = tuple(s * storage.itemsize for s in strides)
        return np.lib.stride_tricks.as_strided(storage[first:], shape, strides).astype(np.float32)


def load(raw: bytes) -> dict[str, np.ndarray]:
    """The tensors of a file, by name."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        root = next(n for n in archive.namelist() if n.endswith("/data.pkl")).rsplit("/", 1)[0]
        return _Reader(archive, root).load()


def dump(tensors: dict[str, np.ndarray]) -> bytes:
    """A file of two-dimensional tensors, rounded to bfloat16."""
    text = lambda s: b"X" + struct.pack("<I", len(s.encode())) + s.encode()
    number = lambda n: b"J" + struct.pack("<i", n)
    out, held = io.BytesIO(), b"\x80\x02}("
    with zipfile.ZipFile(out, "w") as archive:
        for i, (name, x) in enumerate(tensors.items()):
            bits = np.ascontiguousarray(x, "<f4").view("<u4")
            half = ((bits + 0x7FFF + (bits >> 16 & 1)) >> 16).astype("<u2")  # to the nearest, ties to even
            archive.writestr(f"archive/data/{i}", half.tobytes())
            n, d = x.shape
            storage = b"(" + text("storage") + b"ctorch\nBFloat16Storage\n" + text(str(i)) + text("cpu") + number(n * d) + b"tQ"
            shape = number(n) + number(d) + b"\x86" + number(d) + number(1) + b"\x86"
            held += text(name) + b"ctorch._utils\n_rebuild_tensor_v2\n(" + storage + number(0) + shape + b"\x89ccollections\nOrderedDict\n)RtR"
        archive.writestr("archive/data.pkl", held + b"u.")
        archive.writestr("archive/byteorder", "little")
        archive.writestr("archive/version", "3\n")
    return out.getvalue()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The long form of all tensor files below path; whole files are read by Spark, so any store will do."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                file = b.column("path")[i].as_py()
                for name, vec in load(b.column("content")[i].as_py()).items():
                    task, example, layer, tensor, head = parsed(file, name)
                    n, d = vec.shape
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d), pa.int32()), pa.array(np.ascontiguousarray(vec).ravel()))
                    same = [pa.array([x] * n, k) for x, k in ((task, pa.utf8()), (example, pa.utf8()), (layer, pa.int32()), (tensor, pa.utf8()), (head, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(n), pa.int32()), flat], names=[c.split()[0] for c in VECTORS.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "layer_*.pt").load(path)
    return files.select("path", "content").mapInArrow(rows, VECTORS)


def write(vectors: DataFrame, path: str) -> DataFrame:
    """Writes a file for each task, example and layer below path, a folder of a store that pyarrow reaches: whole, under
    another name first, so a task that runs again does no harm. Returns (file, n_tensors, n_positions)."""

    def save(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tensor", "ascending"), ("head", "ascending"), ("pos", "ascending")])
        task, example, layer = (t.column(c)[0].as_py() for c in ("task", "example_id", "layer"))
        kind, head = t.column("tensor").to_numpy(), t.column("head").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (head[1:] != head[:-1]), [True]]))
        tensors = {}
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            name = f"{kind[lo]}_{'head' if kind[lo].startswith('Q') else 'kvhead'}{head[lo]}"
            tensors[name] = np.array(t.column("vec").slice(lo, hi - lo).to_pylist(), "<f4")
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        file = f"{root}/{task}/{example}/layer_{layer:02d}.pt"
        fs.create_dir(file.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(f"{file}.part") as f:
            f.write(dump(tensors))
        fs.move(f"{file}.part", file)
        return pa.table({"file": [file], "n_tensors": pa.array([len(tensors)], pa.int32()), "n_positions": pa.array([max(map(len, tensors.values()))], pa.int32())})

    rows = vectors.groupBy("task", "example_id", "layer").applyInArrow(save, "file string, n_tensors int, n_positions int")
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)  # a row a file
