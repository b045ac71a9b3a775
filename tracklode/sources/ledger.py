"""A ledger of replies that tasks commit to while they run, so that no retry and no later run pays for a reply twice.

Replies lie in ``bucket=XX/run=R`` folders by the first hex digits of their key
(a SHA-256).  A task asks for a few keys at a time and, before it hands them
on, writes them as one file that is moved into place.  A repeated task finds
what the attempt before it committed under the same run and asks for the rest
alone; later runs find all of it by an anti-join.  One chunk a task that dies
is the most that is asked again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expect import ExpectationError

ENTRY = "cache_key string, reply string"
#: Hex digits of a key that name its bucket.
DIGITS = 2
#: Keys that a task asks for at a time, and commits together.
CHUNK = 64


def entries(spark: SparkSession, path: str) -> DataFrame:
    """``cache_key, reply`` of all commits, one row a key; empty where there are none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not len(fs.listStatus(where)):
        return spark.createDataFrame([], ENTRY)
    lines = spark.read.schema(ENTRY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)
    return lines.filter("cache_key IS NOT NULL").groupBy("cache_key").agg(F.min("reply").alias("reply"))


class Bucket:
    """What earlier attempts of a run have committed in one bucket, and a way to commit more."""

    def __init__(self, root: str, bucket: str, run: str):
        self.fs, base = pafs.FileSystem.from_uri(root)
        self.folder = f"{base.rstrip('/')}/bucket={bucket}/run={run}"
        self.fs.create_dir(self.folder, recursive=True)

    def known(self, wanted: set[str]) -> dict[str, str]:
        """Replies of the wanted keys; files are read one at a time."""
        found = {}
        for info in self.fs.get_file_info(pafs.FileSelector(self.folder)):
            if info.path.endswith(".jsonl"):
                with self.fs.open_input_stream(info.path) as f:
                    for line in f.read().decode().splitlines():
                        entry = json.loads(line)
                        if entry["cache_key"] in wanted:
                            found[entry["cache_key"]] = entry["reply"]
        return found

    def commit(self, replies: dict[str, str]) -> None:
        if not replies:
            return
        name = f"{self.folder}/{uuid.uuid4().hex}"
        with self.fs.open_output_stream(f"{name}.part") as f:
            for key, reply in replies.items():
                f.write((json.dumps({"cache_key": key, "reply": reply}, ensure_ascii=False) + "\n").encode("utf-8", "replace"))
        self.fs.move(f"{name}.part", f"{name}.jsonl")


def ask_chunk(root: str, run: str, rows: list[dict], client: Callable[[list[dict]], list[str | None]], secret: str | None = None) -> int:
    """Ask for the rows whose keys no attempt of this run has committed; returns how many were asked for.

    Null replies are failures and are not committed.  ``secret`` never reaches the ledger.
    """
    asked = 0
    by_bucket: dict[str, list[dict]] = {}
    for row in rows:
        by_bucket.setdefault(row["cache_key"][:DIGITS], []).append(row)
    for name, own in by_bucket.items():
        bucket = Bucket(root, name, run)
        known = bucket.known({r["cache_key"] for r in own})
        left = [r for r in own if r["cache_key"] not in known]
        for at in range(0, len(left), CHUNK):
            part = left[at : at + CHUNK]
            replies = client(part)
            if len(replies) != len(part):
                raise ExpectationError("the client returned another number of replies")
            asked += len(part)
            clean = {r["cache_key"]: reply.replace(secret, "[REDACTED]") if secret else reply for r, reply in zip(part, replies, strict=True) if reply is not None}
            bucket.commit(clean)
    return asked


def ask(requests: DataFrame, root: str, client: Callable[[list[dict]], list[str | None]], run: str | None = None, secret: str | None = None) -> int:
    """Ask a client for every key of ``requests`` (``cache_key`` and what the client reads) that the ledger does not hold.

    Requests are dealt by bucket, so that a key is one task's whatever copies
    it has.  Returns how many keys were asked for.
    """
    spark = requests.sparkSession
    run = run or uuid.uuid4().hex
    missing = requests.dropDuplicates(["cache_key"]).join(entries(spark, root).select("cache_key"), "cache_key", "left_anti")
    dealt = missing.repartition(F.substring("cache_key", 1, DIGITS)).sortWithinPartitions("cache_key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                n += ask_chunk(root, run, batch.slice(at, CHUNK).to_pylist(), client, secret)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["asked"])

    return dealt.mapInArrow(work, "asked bigint").agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]
