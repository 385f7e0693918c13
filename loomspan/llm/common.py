"""What the operators of this subpackage share: inputs, the cluster's shared folder, Arrow text access."""

from __future__ import annotations

import gc
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table == "documents" else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer parts, as a file of one row group has; what follows is costly by the row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < cores else df


#: Rows in a batch that goes to Python, at most: rows are whole texts here, and both sides hold a batch.
BATCH_ROWS = 2_500


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it anywhere; and keep the session's
    Arrow batches to BATCH_ROWS rows."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root.endswith(".zip") or ".zip/" in root:
        return
    name = os.path.join(tempfile.mkdtemp(prefix="loomspan-"), "loomspan_pkg.zip")
    with zipfile.ZipFile(name, "w") as z:
        for d, dirs, files in os.walk(root):
            dirs[:] = [x for x in dirs if x != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(d, f)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    spark.sparkContext.addPyFile(name)
    _SHIPPED[app] = name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where it is unset (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    have = spark.sparkContext.getCheckpointDir()
    if have is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomspan-shared-"))
        have = spark.sparkContext.getCheckpointDir()
    return have.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; results read from it lazily, so it lives as long as that folder."""
    return f"{shared_dir(spark)}/loomspan/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def split_path(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a uri and the path in it; a plain path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its n+1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; nulls count as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


_owner: list[str] = [""]
_caches: list = []


def on_change(forget) -> None:  # noqa: ANN001
    """Call forget when a worker, which outlives its tasks, turns to another operator."""
    _caches.append(forget)


def turn_to(owner: str) -> None:
    if _owner[0] != owner:
        if _owner[0]:
            for forget in _caches:
                forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _owner[0] = owner


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int, most_rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about most_bytes of text, so a worker's memory doesn't follow the batch size."""
    turn_to(sys._getframe(1).f_globals["__name__"])  # the module whose task reads
    for b in batches:
        n, i = b.num_rows, 0
        if not n:
            continue
        offsets = texts_of(b.column(b.schema.get_field_index(column)))[1].copy()  # not a view, which would hold the texts
        while i < n:
            j = int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1
            j = max(i + 1, min(j, n, i + most_rows))
            yield b.slice(i, j - i)
            i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift), vectorised."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
