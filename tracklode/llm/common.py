"""Shared plumbing: scratch tables that outlive an executor, and Arrow batch helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of an Arrow batch on its way to Python.  Spark's default of 64 MB is held several times over, in the JVM and in each worker.
BATCH_BYTES = 4 << 20
#: Rows of a Parquet batch: whole texts make Spark's default of 4096 rows tens of MB, in arrays that grow by doubling.
BATCH_ROWS = 512
#: Rows turned into Python objects at a time; an Arrow batch may hold more.
SLICE_ROWS = 128


_local_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of this process;
    on a cluster each executor would write to its own disk, so that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="tracklode-"))
    return _local_root[0]


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (``__`` for dots) for the time of a block."""
    before = {k: spark.conf.get(k.replace("__", "."), None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k.replace("__", "."))
            else:
                spark.conf.set(k.replace("__", "."), v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and return a scan of it.

    This cuts lineage: whatever reads the result needs neither the executors
    nor the shuffle files that made it, and sees one fixed set of rows even
    where ``df`` holds generated ids.  The shuffle files are freed once the
    table is written; the table goes with ``release``, or with the application.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    fs, where = file_system(spark, path)
    fs.deleteOnExit(where)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    table = spark.read.schema(schema).parquet(path)
    table._scratch = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for table in tables:
        fs, where = file_system(table.sparkSession, table._scratch)
        fs.delete(where, True)


def file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_BYTES, and its Parquet batches to BATCH_ROWS, where they are larger.

    Both are read when a result is computed, which is after an operator has
    returned, so they stay.  With Parquet batches of 4096 rows an executor of
    the check tool took 2,500 MB where it takes 1,850 MB with 512.
    """
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and idles beside the next stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: T.StructType) -> DataFrame:
    """Apply a column-wise function to small slices of each Arrow batch.

    ``make`` runs once per task and returns the function, so models and caches
    are set up once.  Only ``SLICE_ROWS`` rows are Python objects at a time.
    """
    names, out = df.columns, arrow_schema(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = f({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[x.name], x.type) for x in out], schema=out)
        del f
        give_back()

    return df.mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def struct(*fields: tuple[str, str]) -> T.StructType:
    """A schema from (name, DDL type) pairs, all nullable."""
    return T.StructType([T.StructField(n, T._parse_datatype_string(t), True) for n, t in fields])


def id_field(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema[name].dataType, True)


class Memo(dict):
    """A dict that computes missing entries and starts afresh at ``limit`` entries, to bound memory."""

    def __init__(self, compute: Callable, limit: int = 600_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.compute(key)
        return value
