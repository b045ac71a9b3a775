"""Streams over event files.

State is bounded: windows close by watermark, and the guard's state holds
hashes of what a trajectory has asked and seen and expires when it is silent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GUARD = "key string, seq long, duplicate_query boolean, duplicate_observation boolean, stagnant_steps long, terminate_suggested boolean"
#: Partition column of drained batches.
BATCH = "drained_batch"
STATE = "queries array<long>, observations array<long>, stagnant long"


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Events with a watermark; parquet times without a zone are read as UTC."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def daily_counts(events: DataFrame, kind: str = "event_type", ts: str = "ts") -> DataFrame:
    w = F.window(ts, "1 day")
    return events.groupBy(w, kind).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), kind, "n")


def sessions(events: DataFrame, key: str, gap: str = "6 hours", ts: str = "ts") -> DataFrame:
    w = F.session_window(ts, gap)
    return events.groupBy(w, key).agg(F.count("*").alias("n_events")).select(key, F.col("session_window.start").alias("session_start"), "n_events")


def drain(stream: DataFrame, folder: str, mode: str = "append", store: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return its result, a table in ``folder`` beside the stream's state.

    Each batch has its own folder and overwrites it when it is repeated; in
    complete mode the last batch is the result.  ``store`` is the state store
    that the stream needs, if not the session's.
    """
    spark, out = stream.sparkSession, f"{folder}/result"
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/{BATCH}=-1")  # a stream without rows has no batch

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if store:
        spark.conf.set(key, store)
    try:
        q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if store and before is not None:
            spark.conf.set(key, before)
        elif store:
            spark.conf.unset(key)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField(BATCH, T.LongType())])).parquet(out)
    if mode == "complete":
        rows = rows.filter(F.col(BATCH) == rows.agg(F.max(BATCH)).first()[0])
    return rows.drop(BATCH)


def guard(steps: DataFrame, silent_ms: int = 30 * 86_400_000) -> DataFrame:
    """Duplicate and stagnation diagnostics of ``key, seq, query, observation, ts`` rows, in order of arrival.

    ``ts`` carries the watermark; a trajectory's state goes once the watermark
    has passed its last event by ``silent_ms``.  Equal to the batch operator
    when a trajectory's rows arrive in order.
    """
    import xxhash

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        queries, seen, stagnant = state.get if state.exists else ([], [], 0)
        queries, seen = set(queries), set(seen)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples():
            q, o = (xxhash.xxh3_64_intdigest(x or "") - (1 << 63) for x in (r.query, r.observation))
            again, known = q in queries, o in seen
            stagnant = stagnant + 1 if known else 0
            queries.add(q)
            seen.add(o)
            out.append((key[0], r.seq, again, known, stagnant, stagnant >= 3))
        state.update((list(queries), list(seen), stagnant))
        last = int(rows["ts"].max().timestamp() * 1000) + silent_ms
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "seq", "duplicate_query", "duplicate_observation", "stagnant_steps", "terminate_suggested"])

    return steps.groupBy("key").applyInPandasWithState(run, GUARD, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def exactly_once(rows: DataFrame, path: str, key: str, checkpoint: str, fault: Callable[[int], None] = lambda batch_id: None) -> StreamingQuery:
    """A running stream that writes each key once to ``path``, also when it dies at any point and is started again.

    Keys that were met before are in the stream's state store, which costs a
    batch what its own rows cost, whatever came before.  A batch is written to
    its own folder and then committed by a file; a batch that dies in between
    is repeated by Spark with the same rows and the same state, overwrites its
    folder and is committed then.  ``committed`` reads committed batches alone.
    ``fault`` is called between write and commit, for tests.
    """
    spark = rows.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{BATCH}={batch_id}")
        fault(batch_id)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{batch_id}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True).close()

    return rows.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the committed batches of ``exactly_once``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return spark.createDataFrame([], schema)
    done = [int(x.getPath().getName()) for x in fs.listStatus(where)]  # one name a batch
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(f"{path}/rows")
    return rows.filter(F.col(BATCH).isin(done)).drop(BATCH)


def append_once(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that writes each key once, also when a batch is repeated after a failure.

    It compares each batch with all commits, and so needs no state of the
    stream: for logs that are small or that a new checkpoint reads anew.  Where
    the log grows, ``exactly_once`` costs a batch its own rows alone.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/batch={batch_id}"
        fresh = batch.dropDuplicates([key])
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(root) and len(fs.listStatus(root)):
            before = spark.read.schema(f"{key} {batch.schema[key].dataType.simpleString()}, batch bigint").json(path)
            done = before.filter(F.col("batch") != batch_id).select(key)
            fresh = fresh.join(done, key, "left_anti")
        fresh.write.mode("overwrite").json(target)

    return write
