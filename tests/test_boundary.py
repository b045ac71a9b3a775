"""Model calls, flat vector files, SQL functions and the command line."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklode import __main__ as cli
from tracklode.functions import sql
from tracklode.functions import text as X
from tracklode.sources import flat, retriever


def test_calls_overlap_and_keep_their_order(spark):
    rows = spark.range(40, numPartitions=1).select(F.col("id").cast("string").alias("prompt"))

    def slow(prompt, attempt, under_way=[]):  # noqa: B006  one list a worker
        under_way.append(prompt)
        time.sleep(0.05 + 0.01 * (int(prompt) * 7 % 10))
        at_once = len(under_way)
        under_way.remove(prompt)
        return {"reply": f"r{prompt}", "prompt_tokens": at_once}

    rows = [(r["prompt"], r["call"]) for r in retriever.call_model(rows, slow, concurrency=20).collect()]
    assert [(p, c["reply"], c["status"], c["attempts"]) for p, c in rows] == [(str(k), f"r{k}", "ok", 1) for k in range(40)]
    assert 5 < max(c["prompt_tokens"] for _, c in rows) <= 20


def test_calls_that_fail_or_hang():
    waits = []

    def client(prompt, attempt):
        waits.append(time.monotonic())
        if prompt == "hang":
            time.sleep(5)
        if prompt == "never" or (prompt == "second" and attempt == 1):
            raise ValueError("busy")
        return {"reply": "yes", "prompt_tokens": 3, "completion_tokens": "many"}

    second = retriever.one_call(client, "second", 3, 0.05, 1.0)
    assert (second["status"], second["attempts"], second["reply"], second["prompt_tokens"], second["completion_tokens"], second["error"]) == ("ok", 2, "yes", 3, None, None)
    waits.clear()
    never = retriever.one_call(client, "never", 3, 0.1, 1.0)
    assert (never["status"], never["attempts"], never["reply"], never["error"]) == ("error", 3, None, "ValueError: busy")
    assert waits[1] - waits[0] >= 0.1 and waits[2] - waits[1] >= 0.2  # doubled
    hung = retriever.one_call(client, "hang", 2, 0.0, 0.1)
    assert (hung["status"], hung["attempts"]) == ("timeout", 2) and hung["latency_ms"] < 2_000


def test_flat_files_by_byte_ranges(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in r.normal(size=5)]) for k in range(101)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert flat.write_flat(df, str(tmp_path), 5) == 101
    for size in (20, 100, 1 << 20):
        back = flat.read_flat(spark, str(tmp_path), 5, 101, size)
        assert sorted((x["vec_id"], x["embedding"]) for x in back.collect()) == rows
    assert not any(".parts" in x for x in os.listdir(tmp_path))
    for dim, n in ((4, None), (5, 100)):
        with pytest.raises(Exception, match="FlatSizeError"):
            flat.read_flat(spark, str(tmp_path), dim, n).count()
    with pytest.raises(Exception, match="FlatSizeError"):
        flat.write_flat(spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<float>"), str(tmp_path / "bad"), 1)
    assert flat.write_flat(df.filter("false"), str(tmp_path / "none"), 5) == 0
    assert flat.read_flat(spark, str(tmp_path / "none"), 5).count() == 0


def test_sql_functions_equal_the_column_functions(spark):
    sql.register(spark)
    r = random.Random(2)
    bits = ["The", "a", "Cat", "dog", ",", " ", " ", "\n", "É", "ß", "an", "'s", "", "\t"]
    text = lambda: r.choice([None, "".join(r.choice(bits) for _ in range(r.randint(0, 8)))])
    rows = [(k, text(), [text() or "" for _ in range(r.randint(0, 3))]) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, p string, golds array<string>")
    want = df.select("k", X.qa_normalize("p").alias("n"), X.exact_match("p", "golds").alias("em"), X.token_f1("p", "golds").alias("f1"))
    got = spark.sql("SELECT k, qa_normalize(p) AS n, answer_em(p, golds) AS em, answer_f1(p, golds) AS f1 FROM {df}", df=df)
    assert sorted(got.collect()) == sorted(want.collect())


def test_sections_by_lateral_join(spark):
    sql.register(spark)
    df = spark.createDataFrame([(1, "Search results for: q1\n1. a\n\nSearch results for: q2 \n1. b  \n"), (2, "none"), (3, None)], "k int, o string")
    got = spark.sql("SELECT k, s.* FROM {df} AS d, LATERAL parse_sections(d.o) AS s", df=df).collect()
    assert [tuple(x) for x in sorted(got)] == [(1, 0, "q1", "Search results for: q1\n1. a"), (1, 1, "q2", "Search results for: q2 \n1. b")]
    assert spark.sql("SELECT inner_product(array(1D, 2D), array(3D, 4D))").first()[0] == 11.0


def test_command_line(spark, capsys):
    assert cli.main(["score-answer", "The answer", "answer", "other"]) == {"em": 1.0, "f1": 1.0}
    assert capsys.readouterr().out.strip() == '{"em": 1.0, "f1": 1.0}'
    assert cli.main(["score-answer", "it's a \"cat\"", "dog"])["em"] == 0.0
