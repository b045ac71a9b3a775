"""Keys that share a state: the results of each alone, with a bounded number of messages to the state store."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F
from test_durable import Clock, FakeHandle, FakeValue, played

from tracklode.streaming import ordered


class Counted(FakeValue):
    calls = 0

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "put", "clear", "appendList"):
            Counted.calls += 1
        return super().__getattribute__(name)


class CountedHandle(FakeHandle):
    getValueState = getListState = lambda self, *_: Counted()


def shared(machine, batches, silent_ms, delay_ms):
    """``played`` for the (key, milliseconds, seq, body) rows of many keys in one bucket."""
    p, now, latest, made = ordered.Bucketed(machine, silent_ms), 0, 0, []
    p.init(CountedHandle())
    for rows in [*batches, None]:
        if rows:
            frame = pd.DataFrame([(k, u * 1000, s, json.dumps(b)) for k, u, s, b in rows], columns=["key", "us", "seq", "body"])
            list(p.handleInputRows((0,), iter([frame[:3], frame[3:]]), Clock(now)))
            latest = max(latest, *(r[1] for r in rows))
        now = latest - delay_ms if rows else 10**12
        assert len(p.handle.timers) <= 1
        while due := sorted(t for t in p.handle.timers if t <= now):
            p.handle.timers -= set(due)
            for _ in due:
                made += [r for f in p.handleExpiredTimer((0,), Clock(now), None) for r in f.to_dict("records")]
    assert all(v.value is None for v in (p.waiting, p.memory, p.timer)) and not p.handle.timers
    return made


def test_keys_of_a_bucket_are_as_if_alone():
    rng = random.Random(5)
    for machine in (lambda: ordered.Budget({"v": 9}), lambda: ordered.Budget({"v": 9}, seconds=5), lambda: ordered.EarlyAnswers(4, 6)):
        rows = [(f"k{rng.randrange(30)}", rng.randrange(40_000), s, {"v": rng.randrange(4), "kind": rng.choice(("search", "answer"))}) for s in range(300)]
        rows.sort(key=lambda r: r[1] + rng.randrange(5_000))  # late by less than the watermark's delay
        batches = [rows[at : at + 50] for at in range(0, 300, 50)]
        want = [{**r, "key": k} for k in {r[0] for r in rows} for r in played(machine(), [[r[1:] for r in b if r[0] == k] for b in batches if any(r[0] == k for r in b)], 10**7, 5_000)]
        Counted.calls = 0
        got = shared(machine(), batches, 10**7, 5_000)
        order = lambda found: sorted((json.dumps(r, sort_keys=True, default=float) for r in found))
        assert order(got) == order(want) and got
        assert Counted.calls < 30 * len(batches)  # a state for each key needs several calls a key and batch


def test_a_stream_has_buckets_not_keys(spark):
    rows = spark.readStream.format("rate").load().select(F.col("value").cast("string").alias("key"), F.col("value").alias("seq"), F.unix_micros("timestamp").alias("us"), F.lit("{}").alias("body"), F.col("timestamp").alias("ts")).withWatermark("ts", "1 second")
    plan = ordered.run(rows, ordered.Budget({"v": 1}), buckets=16)._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan and "xxhash64" in plan
