"""Flat token files: unsigned integers, 64-bit document offsets and document ids, one set of files a partition.

``part-N.bin`` holds the ids, little-endian, 16 bits wide where the vocabulary allows, else 32; ``part-N.idx`` the
n + 1 64-bit offsets of its documents, counted in ids; ``part-N.doc`` a 64-bit doc_id and a 64-bit null flag a
document. Partitions are ranges of doc_id, so a partition's base is the prefix sum of the sizes before it.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.kernels import blocks
from tidebook.llm.runtime import id_text, new_path, partitions, small_batches
from tidebook.llm.vocab import vocabulary

#: Documents whose rows are read back at once, and their ids (or one document's).
READ_DOCS, READ_IDS = 2000, 1 << 20


#: Schemes of Hadoop's object stores under the names that Arrow knows them by.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path of a whole URI."""
    scheme, rest = uri.split(":", 1)
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def whole_uri(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme, by the default file system of the session's Hadoop configuration where it has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


class Ranges:
    """Numbers of a file, read by ranges: memory-mapped where it is local, else only the bytes of the range."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: type):
        self.dtype, self.file = np.dtype(dtype), None
        if isinstance(fs, pafs.LocalFileSystem):
            self.map = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
            self.size = len(self.map)
        else:
            self.file = fs.open_input_file(path)
            self.size = self.file.size() // self.dtype.itemsize

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.file is None:
            return self.map[at]
        a, b, _ = at.indices(self.size)
        return np.frombuffer(self.file.read_at(max(0, b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _writer(path: str, folder: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = vocabulary(path)
        width = np.uint16 if max(memory.library.get_vocab_size(), end_id + 1) <= 65536 else np.uint32
        n = TaskContext.get().partitionId()
        fs, base = _store(folder)
        fs.create_dir(base, recursive=True)
        # an attempt writes under its own name and renames at the end: a lost or repeated task leaves whole files
        own = f"{base}/.{uuid.uuid4().hex}"
        end = np.array([end_id], np.uint32).tobytes()
        docs, total = 0, 0
        with fs.open_output_stream(own + ".bin") as ids, fs.open_output_stream(own + ".idx") as idx, fs.open_output_stream(own + ".doc") as doc:
            idx.write(np.zeros(1, np.uint64).tobytes())
            for batch in batches:
                for part, _, _ in blocks(batch, "text"):
                    raw = [x + end for x in memory.ids(part.column("text").fill_null("").to_pylist())]
                    ids.write(np.frombuffer(b"".join(raw), np.uint32).astype(width).tobytes())
                    offsets = total + np.cumsum([len(x) // 4 for x in raw], dtype=np.uint64)
                    idx.write(offsets.astype(np.uint64).tobytes())
                    names = part.column("doc_id")
                    doc.write(np.stack([names.fill_null(0).to_numpy(zero_copy_only=False), names.is_null().to_numpy(zero_copy_only=False).astype(np.int64)], axis=1).astype(np.int64).tobytes())
                    docs, total = docs + part.num_rows, int(offsets[-1])
        for end_of in (".bin", ".idx", ".doc"):
            fs.move(own + end_of, f"{base}/part-{n:06d}{end_of}")
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (n, docs, total, np.dtype(width).itemsize)], ["part", "docs", "ids", "width"])

    return run


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, int, int, int]]:
    """Encode whole texts, append ``end_id`` to each document, write them in ascending doc_id order (nulls first, equal
    ids by text) and return the manifest: part, documents, ids, width in bytes and base of each part. The manifest has
    a row a partition, nothing a document."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = whole_uri(spark, folder)
    texts = id_text(docs, id_col, text_col)
    dealt = texts.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = sorted(tuple(r) for r in dealt.mapInArrow(_writer(path, folder, end_id), "part long, docs long, ids long, width long").collect())
    bases = [0, *accumulate(r[2] for r in rows)]
    return [(*r, b) for r, b in zip(rows, bases, strict=False)]


def _reader(folder: str, keep: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(folder)

        for batch in batches:
            for part, width, first in zip(*(batch.column(c).to_pylist() for c in ("part", "width", "base")), strict=True):
                ids, idx, doc = (Ranges(fs, f"{base}/part-{part:06d}.{kind}", t) for kind, t in (("bin", np.uint16 if width == 2 else np.uint32), ("idx", np.uint64), ("doc", np.int64)))
                a, n = 0, doc.size // 2
                while a < n:
                    at = idx[a : min(a + READ_DOCS, n) + 1].astype(np.int64)
                    b = a + max(1, int(np.searchsorted(at, at[0] + READ_IDS, "right")) - 1)
                    at = at[: b - a + 1]
                    some = ids[int(at[0]) : int(at[-1])]
                    names = doc[2 * a : 2 * b].reshape(-1, 2)
                    wide = [some[x - at[0] : y - at[0]].astype("<u4") for x, y in zip(at, at[1:])]  # noqa: B905
                    columns = [pa.array(names[:, 0], pa.int64(), mask=names[:, 1].astype(bool)), pa.array(first + at[:-1]), pa.array(np.diff(at))]
                    if keep:
                        columns.append(pa.array([x.astype(np.int64).tolist() for x in wide], pa.list_(pa.int64())))
                    else:
                        columns.append(pa.array([zlib.crc32(x) for x in wide], pa.int64()))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids" if keep else "ids_crc32"])
                    a = b
                for x in (ids, idx, doc):
                    x.close()

    return run


def read_token_files(spark: SparkSession, folder: str, manifest: list[tuple[int, int, int, int, int]], digests: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files, memory-mapped where they are local; with
    ``digests`` ids_crc32, of the ids as little-endian unsigned 32-bit integers, in place of ids."""
    small_batches(spark)
    folder = whole_uri(spark, folder)
    parts = spark.createDataFrame(manifest, "part long, docs long, ids long, width long, base long").where(F.col("docs") > 0).repartition(max(1, len(manifest)))
    what = "ids_crc32 long" if digests else "ids array<long>"
    return parts.mapInArrow(_reader(folder, not digests), f"doc_id long, start long, n_tokens long, {what}")


def token_file_round_trip(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back as digests. An empty table gives no rows."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    return read_token_files(spark, folder, write_token_files(docs, folder, path, end_id), digests=True)
