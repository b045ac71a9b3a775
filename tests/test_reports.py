"""Ranks, samples, drained streams, run folders and set checks on small cases."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tracklode.operators import funnel, joins, selection
from tracklode.operators.expect import ExpectationError
from tracklode.sources import files, runs, shared
from tracklode.streaming import streams


def test_ranked(spark):
    rows = spark.range(0, 500, 1, 7).select("id", F.pmod("id", F.lit(9)).alias("v"))
    got = {r["id"]: r["place"] for r in selection.ranked(rows, [F.col("v"), F.desc("id")], "place").collect()}
    assert [got[i] for i in sorted(range(500), key=lambda i: (i % 9, -i))] == list(range(500))
    assert selection.ranked(rows.limit(0), [F.col("v")], "place").count() == 0


@pytest.mark.parametrize("rejected", [0, 12])
def test_audit_sample_equals_plain_python(spark, rejected):
    rows = [(f"q{i:02d}", i, i % 3 == 0, (i * 37) % 61 * 100, i != 5, i >= rejected) for i in range(40)]
    table = spark.createDataFrame(rows, "question_id string, position long, mis boolean, canonical_length long, structural_valid boolean, redundancy_pass boolean").withColumn("mismatch_count", F.col("mis").cast("int"))
    got = sorted((r["category"], r["question_id"]) for r in funnel.audit_sample(table, 11, 4, 1_000).collect())
    sound, rng = [r for r in rows if r[4]], random.Random(11)
    draw = lambda pool: rng.sample(pool, min(4, len(pool)))
    want = [("no_mismatch", r[0]) for r in draw([r for r in sound if not r[2]])] + [("action_source_mismatch", r[0]) for r in draw([r for r in sound if r[2]])] + [("redundancy_rejected", r[0]) for r in draw([r for r in sound if not r[5]])]
    want += [("long_trajectory", r[0]) for r in sorted(sound, key=lambda r: -r[3])[:4]] + [("near_16k", r[0]) for r in sorted(sound, key=lambda r: abs(r[3] - 1_000))[:4]]
    assert got == sorted(want)


def test_lock_and_takeover(spark, tmp_path):
    folder = str(tmp_path / "run")
    runs.take_lock(spark, folder)
    with pytest.raises(runs.LockedError):
        runs.take_lock(spark, folder)
    runs.take_lock(spark, folder, resume=True)
    runs.release_lock(spark, folder)
    runs.take_lock(spark, folder)


@pytest.mark.parametrize("text, want", [("a\nb\nc", ["a", "b"]), ("a\nb\n", ["a", "b"]), ("a", []), ("", []), ("\n\n a \nb", [" a "])])
def test_whole_lines(spark, tmp_path, text, want):
    (tmp_path / "r.jsonl").write_text(text)
    assert [r["line"] for r in runs.whole_lines(spark, str(tmp_path / "r.jsonl")).collect()] == want


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_drain_of_nothing_and_of_files(spark, tmp_path, mode):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        stream = spark.readStream.schema("x long").option("maxFilesPerTrigger", 1).parquet(str(source))
        stream = stream.groupBy("x").count() if mode == "complete" else stream
        rows = streams.drain(stream, str(tmp_path / f"out{k}"), mode).collect()
        assert sorted(r["x"] for r in rows) == sorted([0, 1] * k if mode == "append" else [0, 1] if k else [])
        spark.range(2).select(F.col("id").alias("x")).coalesce(1).write.mode("append").parquet(str(source))


def test_shared_root_follows_the_session():
    session = lambda root, master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: root), sparkContext=SimpleNamespace(master=master))
    assert shared.shared_root(session("/shared/", "spark://a")) == "/shared"
    assert shared.fresh_path(session("/shared", "local[2]"), "a") != shared.fresh_path(session("/shared", "local[2]"), "a")
    assert shared.shared_root(session(None, "local[2]")) == shared.shared_root(session(None, "local[2]"))
    with pytest.raises(ValueError):
        shared.shared_root(session(None, "spark://a"))


def test_agreement_and_selected_ids(spark):
    table = lambda rows: spark.createDataFrame(rows, "k long, v long")
    r = joins.agreement(table([(1, 1), (2, None), (3, 3), (4, 4)]), table([(1, 1), (2, None), (3, 9)]), "k", "v").first()
    assert (r["missing"], r["different"], r["agree"]) == (1, 1, False)
    assert joins.agreement(table([]), table([]), "k", "v").first()["agree"]
    assert joins.select_ids(table([(1, 1), (2, 2)]), table([(2, 0), (2, 1)]), "k").count() == 1
    with pytest.raises(ExpectationError):
        joins.select_ids(table([(1, 1)]), table([(7, 0)]), "k")


def test_strict_lines_raise(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n[1]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        files.read_strict(spark, str(tmp_path / "r.jsonl"), "a long").collect()
    rows, bad = files.read_tolerant(spark, str(tmp_path / "r.jsonl"), "a long")
    assert [r["a"] for r in rows.collect()] == [1] and bad.first()["bad"] == 1
