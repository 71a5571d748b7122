"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Texts are worked on in slices of about this many bytes inside a task.
SLICE_BYTES = 1 << 20
_MADE: set[str] = set()


#: Bytes of the Arrow batches that tasks exchange with Python, where the session keeps Spark's default of 64 MB.
ARROW_BYTES = 8 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: ten thousand long texts in one would cost each task several times their size."""
    if spark.conf.get(_ARROW) == "67108864b":
        spark.conf.set(_ARROW, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; a temporary folder is made
    (and set) only where that is unset and all runs on one machine, as in local
    tests. A cluster without the setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pagemill-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    if own not in _MADE:
        # intermediate tables live as long as the application: results read them when they run
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(own)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _MADE.add(own)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string (or binary) column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def byte_runs(b: pa.RecordBatch, at: int, size: int):
    """Consecutive parts of a batch, cut after about ``size`` bytes of the text column at ``at``; no row is copied."""
    lengths = np.nan_to_num(pc.binary_length(b.column(at)).to_numpy(zero_copy_only=False).astype(float)) + 64
    ends = np.cumsum(lengths)
    start = 0
    while start < b.num_rows:
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size)) + 1
        yield b.slice(start, min(stop, b.num_rows) - start)
        start = stop


def slices(batches, *columns: str, size: int = SLICE_BYTES):
    """Lists of the named columns' values, cut after about ``size`` bytes of the first, a text column.

    Bounds what a task holds beside an Arrow batch, whatever the batch size is.
    """
    for batch in batches:
        at = [batch.schema.get_field_index(c) for c in columns]
        for part in byte_runs(batch, at[0], size):
            yield [as_bytes(part.column(at[0])), *(part.column(i).to_pylist() for i in at[1:])]


def key_groups(batches, keys: int):
    """(key, batches) of consecutive rows that agree in the first ``keys`` columns; a group is held whole, so its size must be bounded."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        values = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cut = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1
        for start, stop in pairwise([0, *cut.tolist(), b.num_rows]):
            key = tuple(int(v[start]) for v in values)
            if held and key != last:
                yield last, held
                held = []
            held.append(b.slice(start, stop - start))
            last = key
    if held:
        yield last, held


def column(parts: list[pa.RecordBatch], at: int) -> pa.Array:
    """The column at ``at`` of a group's batches."""
    return parts[0].column(at) if len(parts) == 1 else pa.concat_arrays([p.column(at) for p in parts])


def byte_rows(values: pa.Array) -> np.ndarray:
    """A binary column of values of one length as a matrix of bytes."""
    if not len(values):
        return np.empty((0, 0), np.uint8)
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(values), -1)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string such as "doc_id long, hits array<int>"; needs no session, so tasks can use it."""
    pairs = [f.split() for f in ddl.split(",")]
    return pa.schema([(name, pa.list_(_TYPES[kind[6:-1]]) if kind.startswith("array<") else _TYPES[kind]) for name, kind in pairs])


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
