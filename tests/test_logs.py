"""Logs packed into files: places, odd lines, and how many files and tasks there are."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracklode.plans import durable, reports
from tracklode.sources import files


def made(spark, tmp_path, n=400, users=40):
    """Events in no order, of which some are blank lines."""
    rows = spark.range(n).select((F.col("id") % users).alias("user"), F.col("id").alias("at"), F.when(F.col("id") % 7 == 3, "").otherwise(F.to_json(F.struct(F.col("id").alias("payload"), F.lit("e\t").alias("event_type")))).alias("line"))
    path = str(tmp_path / "logs")
    files.write_logs(rows.orderBy(F.xxhash64("at")), path, "user", "at")
    return path


def test_places_in_packed_logs_do_not_depend_on_splits(spark, tmp_path):
    path = made(spark, tmp_path)
    want = sorted((str(k % 40), k // 40, str(k)) for k in range(400) if k % 7 != 3)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    for size in (before, "97"):
        spark.conf.set(key, size)
        try:
            assert sorted(map(tuple, files.read_event_logs(spark, path).select("log", "seq", "payload").collect())) == want
        finally:
            spark.conf.set(key, before)


def test_files_follow_bytes_not_logs(spark, tmp_path):
    found = [f for _, _, names in os.walk(made(spark, tmp_path, 2_000, 1_000)) for f in names if f.startswith("part-")]
    assert len(found) <= 4  # shuffle partitions


def test_odd_logs(spark, tmp_path):
    rows = spark.createDataFrame([(None, 0, "a"), ("x", 0, None), ("x", 1, "b\tc")], "log string, at int, line string")
    files.write_logs(rows, str(tmp_path / "odd"), "log", "at")
    assert sorted(map(repr, files.read_logs(spark, str(tmp_path / "odd")).select("log", "line").collect())) == sorted(map(repr, rows.select("log", F.coalesce("line", F.lit("")).alias("line")).collect()))
    for k, (log, line) in enumerate((("a\tb", "x"), ("a", "x\ny"))):
        with pytest.raises(PySparkException):
            files.write_logs(spark.createDataFrame([(log, 0, line)], "log string, at int, line string"), str(tmp_path / f"bad{k}"), "log", "at")


def event_table(spark, tmp_path, users):
    rows = spark.range(4 * users).select(F.col("id").alias("event_id"), (F.col("id") % users).alias("user_id"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("id") * 7919, F.lit(100)))).alias("ts"), F.lit("view").alias("event_type"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_splits_of_512_bytes_share_tasks(spark, tmp_path):
    """One task a split of 512 bytes would be hundreds of tasks here, and millions on a large table."""
    d = event_table(spark, tmp_path, 500)
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("splits", "")
    try:
        got = durable.event_files_in_splits(spark, d).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup("splits") for s in seen.getJobInfo(j).stageIds]
    assert got == 2_000 and max(s.numTasks for s in stages if s) <= max(64, 2 * spark.sparkContext.defaultParallelism)


def test_event_files_of_many_users(spark, tmp_path, monkeypatch):
    paths = []
    monkeypatch.setattr(reports, "fresh_path", lambda spark, what: paths.append(str(tmp_path / f"{what}{len(paths)}")) or paths[-1])
    got = {(r["user_id"], r["seq"]): int(r["payload"]) for r in reports.event_files(spark, event_table(spark, tmp_path, 50)).collect()}
    order = {u: sorted(range(u, 200, 50), key=lambda k: (k * 7919 % 100, k)) for u in range(50)}
    assert got == {(u, s): k for u, ks in order.items() for s, k in enumerate(ks)}
    assert sum(f.startswith("part-") for _, _, names in os.walk(paths[0]) for f in names) <= 4


def test_log_faults_of_packed_logs(spark, tmp_path, monkeypatch):
    paths = []
    monkeypatch.setattr(durable, "fresh_path", lambda spark, what: paths.append(str(tmp_path / what)) or paths[-1])
    got = {r["trajectory_id"]: (r["lines"], r["bad_lines"], r["wrong_ids"]) for r in durable.log_faults(spark, event_table(spark, tmp_path, 50)).collect()}
    assert got == {str(u): (4, sum(k % 13 == 0 for k in range(u, 200, 50)), sum(k % 13 != 0 and k % 17 == 0 for k in range(u, 200, 50))) for u in range(50)}
    assert sum(f.startswith("part-") for _, _, names in os.walk(paths[0]) for f in names) <= 4
