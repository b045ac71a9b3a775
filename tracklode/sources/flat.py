"""Flat vector files: 32-bit floats one vector after the other, beside their 64-bit ids.

A folder holds any number of parts, each ``NAME.f32`` with ``NAME.i64``.  As a
Spark data source it is read by byte ranges, so a part of any size spreads over
many tasks, and its sizes are checked before anything is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of vectors in one task, and in one batch.
TASK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
SCHEMA = "vec_id bigint, embedding array<float>"


class FlatSizeError(ValueError):
    """A file's size does not fit the dimension, its ids or the expected number of vectors."""


@dataclass
class Rows(InputPartition):
    name: str
    first: int
    n: int


class FlatVectors(DataSource):
    """Options: ``path``; ``dim``; ``rows`` (optional), which the folder must hold; ``task_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "flat_vectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FlatReader:
        return FlatReader(self.options)


class FlatReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.dim = options["path"], int(options["dim"])
        self.rows = int(options["rows"]) if options.get("rows") else None
        self.task_bytes = int(options.get("task_bytes") or TASK_BYTES)

    def files(self):
        return pafs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[Rows]:
        fs, base = self.files()
        found = {i.path: i.size for i in fs.get_file_info(pafs.FileSelector(base)) if i.is_file}
        parts, total, width = [], 0, 4 * self.dim
        for path, size in sorted(found.items()):
            if not path.endswith(".f32"):
                continue
            name = path.removesuffix(".f32")
            n, odd = divmod(size, width)
            if odd or found.get(f"{name}.i64") != 8 * n:
                raise FlatSizeError(f"{path} has {size} bytes and {found.get(f'{name}.i64')} bytes of ids: no whole number of {self.dim}-dimensional vectors with an id each")
            step = max(1, self.task_bytes // width)
            parts += [Rows(name, at, min(step, n - at)) for at in range(0, n, step)]
            total += n
        if self.rows is not None and total != self.rows:
            raise FlatSizeError(f"{self.path} holds {total} vectors, not {self.rows}")
        return parts or [Rows("", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        fs, _ = self.files()
        width, step = 4 * self.dim, max(1, BATCH_BYTES // (4 * self.dim))
        if not part.n:
            return
        with fs.open_input_file(f"{part.name}.f32") as vectors, fs.open_input_file(f"{part.name}.i64") as ids:
            for at in range(part.first, part.first + part.n, step):
                n = min(step, part.first + part.n - at)
                values = pa.array(np.frombuffer(vectors.read_at(n * width, at * width), "<f4"))
                numbers = pa.array(np.frombuffer(ids.read_at(n * 8, at * 8), "<i8"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.dim), values)
                yield pa.RecordBatch.from_arrays([numbers, lists], names=["vec_id", "embedding"])


def read_flat(spark: SparkSession, path: str, dim: int, rows: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``vec_id, embedding`` of a folder of flat vector files."""
    spark.dataSource.register(FlatVectors)
    reader = spark.read.format("flat_vectors").option("path", path).option("dim", dim).option("task_bytes", task_bytes)
    return (reader if rows is None else reader.option("rows", rows)).load()


def write_flat(vectors: DataFrame, path: str, dim: int, vec_id: str = "vec_id", vector: str = "embedding") -> int:
    """Write vectors, a part a task, each moved into place when it is whole; returns their number.

    A vector that is null or of another dimension raises.  A repeated task
    writes its part anew under another name, and only the names that tasks
    report are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(f"{base}/.parts", recursive=True)
        name, n = uuid.uuid4().hex, 0
        with fs.open_output_stream(f"{base}/.parts/{name}.f32") as out, fs.open_output_stream(f"{base}/.parts/{name}.i64") as ids:
            for batch in batches:
                rows = batch.column(1)
                if rows.null_count or any(len(x) != dim for x in rows):
                    raise FlatSizeError(f"a vector is null or has not {dim} components")
                out.write(rows.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                ids.write(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "n"])

    total = 0
    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(f"{base}/.parts", recursive=True)
    for r in vectors.select(vec_id, vector).mapInArrow(run, "name string, n bigint").collect():  # a row a part
        if r["n"]:
            for kind in ("f32", "i64"):
                fs.move(f"{base}/.parts/{r['name']}.{kind}", f"{base}/{r['name']}.{kind}")
        total += r["n"]
    fs.delete_dir(f"{base}/.parts")
    return total
