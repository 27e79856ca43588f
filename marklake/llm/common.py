"""Helpers shared by the training-data operators: shipping code, written cuts, Arrow access to bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = 8 << 20
EXAMPLE_BYTES = 1 << 16  # longer texts teach no model, which bounds what samples bring to the driver


def ship(spark: SparkSession) -> None:
    """Give every executor this package, and bound the Arrow batches of the session: JVM and Python worker each
    hold one."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(spark.conf.get(limit)).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
    shipping.ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  The session's ``spark.checkpoint.dir`` wins; where none is configured, a
    temporary one is set on a local master (tests and single-machine use), and any other is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marklake-shared-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/marklake-{tag}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: lineage ends there, so a lost executor costs no
    recomputation of what stands above, and Python stages run once however often the result is used."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, df: DataFrame) -> None:
    """Remove a cut that nothing reads any more."""
    files = df.inputFiles()
    if files:
        p = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def raw(col: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return col.cast(kind).to_pylist()


_CACHES: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called where an operator's task begins: workers serve many operators, and what another one remembers
    goes.  ``clear`` empties what this one will."""
    for other in [k for k in _CACHES if k != owner]:
        _CACHES.pop(other)()
    _CACHES[owner] = clear


def tidy() -> None:
    """Give freed memory back to the system at a task's end; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of ``column`` each (one row at least), which
    bounds what a Python worker holds whatever the length of the texts."""
    yield from _pieces(batches, column, limit)
    tidy()


def _pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        if batch.num_rows == 1 or batch.column(at).nbytes <= limit:
            yield batch
            continue
        import pyarrow.compute as pc

        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = int(size[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mod_of_id(column: str, n: int) -> Column:
    """crc32 of the id's text, modulo ``n`` (null id: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them as long as a column has them."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column out of one array for each row."""
    ends = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))
