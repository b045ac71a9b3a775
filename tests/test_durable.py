"""Streams in any order, ledgers that survive a crash, and reply parsing in linear time."""

import json
import os
import subprocess
import sys
import time
from collections import Counter

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tracklode.functions import protocol as P
from tracklode.operators import units
from tracklode.plans import catalog, composites
from tracklode.sources import ledger
from tracklode.streaming import ordered, reconstruction, streams

# Ordered machines ----------------------------------------------------------


class FakeValue:
    def __init__(self):
        self.value = None

    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None

    def appendList(self, rows):
        self.value = [*(self.value or []), *rows]


class FakeHandle:
    def __init__(self):
        self.timers = set()

    getValueState = getListState = lambda self, *_: FakeValue()
    listTimers = lambda self: sorted(self.timers)
    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.discard(t)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def played(machine, batches, silent_ms, delay_ms):
    """Results of one key whose rows (milliseconds, seq, body) come in batches; the watermark follows the latest row by ``delay_ms``."""
    import pandas as pd

    p, now, latest, made = ordered.Ordered(machine, silent_ms), 0, 0, []
    p.init(FakeHandle())
    for rows in [*batches, None]:
        if rows:
            list(p.handleInputRows(("k",), iter([pd.DataFrame([(u * 1000, s, json.dumps(b)) for u, s, b in rows], columns=["us", "seq", "body"])]), Clock(now)))
            latest = max(latest, *(u for u, _, _ in rows))
        now = latest - delay_ms if rows else 10**12
        while due := sorted(t for t in p.handle.timers if t <= now):
            p.handle.timers -= set(due)
            for _ in due:
                made += [r for f in p.handleExpiredTimer(("k",), Clock(now), None) for r in f.to_dict("records")]
    assert not p.waiting.exists() and not p.memory.exists() and not p.handle.timers
    return made


def test_budget_in_any_order():
    rows = [(1000 * k, k, {"v": 10, "n": 1}) for k in range(20)]
    shuffled = [[rows[k + 1], rows[k]] for k in range(0, 20, 2)]
    for batches in ([rows], shuffled, [[r] for r in rows], [rows[::-1]]):
        assert [(r["seq"], r["reason"]) for r in played(ordered.Budget({"v": 55, "n": 100}), batches, 10**6, 2_000)] == [(5, "v")]
    assert played(ordered.Budget({"v": 10_000}), [rows], 10**6, 0) == []


def test_time_budget_is_a_timer():
    rows = [(0, 0, {"v": 1}), (100_000, 1, {"v": 1})]
    assert [r["reason"] for r in played(ordered.Budget({"v": 99}, seconds=540), [rows], 10**7, 0)] == ["seconds"]
    assert played(ordered.Budget({"v": 99}, seconds=540), [[*rows, (200_000, 2, {"v": 1, "final": True})]], 10**7, 0) == []
    late = [[*rows, (600_000, 2, {"v": 99})]]  # used up after the time
    assert [r["reason"] for r in played(ordered.Budget({"v": 99}, seconds=540), late, 10**7, 0)] == ["seconds"]


def test_early_answers():
    rows = [(0, 0, {"kind": "search"}), (1_500, 1, {"kind": "answer"}), (2_000, 2, {"kind": "answer"})]
    assert [(r["round"], r["elapsed"]) for r in played(ordered.EarlyAnswers(3, 120), [rows[1:], rows[:1]], 10**6, 10_000)] == [(2, 1)]
    assert played(ordered.EarlyAnswers(2, 120), [rows], 10**6, 0) == [] and played(ordered.EarlyAnswers(3, 1), [rows], 10**6, 0) == []


def log(*kinds, r=1):
    bodies = {
        "trajectory_start": {"messages": "[]"}, "trajectory_finish": {"answer": "a"}, "round_response": {"reasoning": "why", "content": "c"}, "tool_extracted": {"extracted": "x"},
        "tool_json_parse": {"arguments": "{}", "asked": ["q"]}, "search_start": {"queries": ["q"]}, "search_finish": {"result": "h"}, "tool_response_appended": {"observation": "o"},
    }
    return [(k * 1000, k, {"kind": kind, "round": r, **bodies[kind]}) for k, kind in enumerate(kinds)]


ROUND = ("round_response", "tool_extracted", "tool_json_parse", "search_start", "search_finish", "tool_response_appended")


def test_reconstruction_gives_up_a_search_when_its_time_is_over():
    whole = played(reconstruction.Reconstruction(540), [log("trajectory_start", *ROUND, "trajectory_finish")], 10**7, 0)
    assert [r["what"] for r in whole] == ["step", "end"]
    step = whole[0]
    assert (step["step_index"], step["start_seq"], step["finish_seq"], step["end_seq"], step["observation"]) == (1, 4, 5, 6, "o")
    cut = log("trajectory_start", *ROUND[:-1])
    codes = lambda made: [r["code"].split(":")[1] for r in made if r["what"] == "error"]
    assert codes(played(reconstruction.Reconstruction(), [cut], 10**7, 0)) == ["unfinished_search_action", "trajectory_finish_count"]
    # After its time the search is given up, and what comes for it has no search.
    late = [*cut, (700_000, 50, {"kind": "tool_response_appended", "round": 1, "observation": "o"}), (700_001, 51, {"kind": "trajectory_finish", "round": 0, "answer": "a"})]
    assert codes(played(reconstruction.Reconstruction(540), [late], 10**7, 0)) == ["unfinished_search_action", "orphan_observation"]
    assert codes(played(reconstruction.Reconstruction(), [late], 10**7, 0)) == []


def test_stream_with_a_tight_watermark(spark, tmp_path):
    """Rows one batch late, a short delay: keys are released and freed while the stream goes on."""
    rows = [(f"k{k % 5}", k, 1_000 + k * 10, 1) for k in range(100)]
    for b in range(5):  # each batch holds its rows but every third one, which the next batch brings
        part = [r for r in rows if (r[1] // 20 + (r[1] % 3 == 0)) == b or (b == 4 and r[1] // 20 == 4)]
        spark.createDataFrame(part, "key string, seq long, sec long, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    spark.createDataFrame([("end", 0, 10**7, 0)], "key string, seq long, sec long, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), "key string, seq long, sec long, v int", 1)
    made = ordered.ordered_rows(stream, F.col("key"), F.col("seq"), F.timestamp_seconds("sec"), F.struct("v"), "300 seconds")
    got = streams.drain(ordered.run(made, ordered.Budget({"v": 7}), 1_000_000), str(tmp_path / "out"), store=ordered.STORE)
    assert sorted((r["key"], r["seq"]) for r in got.collect()) == [(f"k{k}", 30 + k) for k in range(5)]


def test_exactly_once_after_a_crash_at_every_batch(spark, tmp_path):
    for b in range(3):
        spark.createDataFrame([(k,) for k in range(10 * b, 10 * b + 15)], "k long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    died = []

    def fault(batch_id):
        if batch_id not in died:
            died.append(batch_id)
            raise RuntimeError("dies")

    for _ in range(4):
        stream = streams.event_stream(spark, str(tmp_path / "in"), "k long", 1)
        try:
            streams.exactly_once(stream, str(tmp_path / "out"), "k", str(tmp_path / "state"), fault).awaitTermination()
        except Exception:  # noqa: BLE001  the query's own exception
            got = [r["k"] for r in streams.committed(spark, str(tmp_path / "out"), stream.schema).collect()]
            assert len(got) == len(set(got))
    assert died == [0, 1, 2]
    assert sorted(r["k"] for r in streams.committed(spark, str(tmp_path / "out"), stream.schema).collect()) == list(range(35))


# Ledger ---------------------------------------------------------------------


def counting(folder, fail_after=None):
    """A client that writes down every key it is asked for, and dies after so many chunks."""

    def client(rows):
        calls = os.listdir(folder)
        if fail_after is not None and len(calls) >= fail_after:
            raise RuntimeError("no answer")
        name = f"{folder}/{time.time_ns()}-{os.getpid()}"
        with open(name, "w") as f:
            f.write("\n".join(r["cache_key"] for r in rows))
        return [None if r.get("n") == -1 else f"reply {r['n']} tok3n" for r in rows]

    return client


def asked(folder):
    return Counter(k for name in os.listdir(folder) for k in open(f"{folder}/{name}").read().split("\n"))


def requests(spark, n):
    return spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("cache_key"), F.col("id").alias("n"))


def test_ledger_asks_each_key_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    root = str(tmp_path / "ledger")
    twice = requests(spark, 150).unionByName(requests(spark, 150))
    assert ledger.ask(twice, root, counting(str(calls)), secret="tok3n") == 150
    assert ledger.ask(requests(spark, 200), root, counting(str(calls)), secret="tok3n") == 50
    assert ledger.ask(requests(spark, 200), root, counting(str(calls))) == 0
    assert set(asked(str(calls)).values()) == {1} and len(asked(str(calls))) == 200
    got = {r["reply"] for r in ledger.entries(spark, root).collect()}
    assert got == {f"reply {k} [REDACTED]" for k in range(200)}


def test_ledger_keeps_what_a_dead_run_committed(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    root = str(tmp_path / "ledger")
    with pytest.raises(Exception, match="no answer"):
        ledger.ask(requests(spark, 300), root, counting(str(calls), 5))
    before = ledger.entries(spark, root).count()
    assert before > 0
    ledger.ask(requests(spark, 300), root, counting(str(calls)))
    assert ledger.entries(spark, root).count() == 300
    assert set(asked(str(calls)).values()) == {1}


def test_repeated_task_asks_for_the_rest_alone(tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "CHUNK", 4)
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [{"cache_key": f"ab{k:02}", "n": k} for k in range(10)]
    with pytest.raises(RuntimeError):
        ledger.ask_chunk(str(tmp_path), "r", rows, counting(str(calls), 2))
    assert ledger.ask_chunk(str(tmp_path), "r", rows, counting(str(calls))) == 2  # the attempt before had committed 8
    assert set(asked(str(calls)).values()) == {1}
    assert ledger.ask_chunk(str(tmp_path), "r", [{"cache_key": "ab99", "n": -1}], counting(str(calls))) == 1
    assert ledger.Bucket(str(tmp_path), "ab", "r").known({"ab99"}) == {}  # failures are not kept


def test_channels_see_their_own_part_of_a_unit(spark):
    audited = units.leakage_audit(catalog.pilot_units(spark, DATA))
    rows = units.channel_requests(audited).join(audited.select("unit_id", "question", "history", "current_query_result", "current_executed_query"), "unit_id").collect()
    assert rows
    for r in rows:
        assert r["current_executed_query"] in r["prompt"]
        if r["channel"] == "intent":
            assert r["question"] in r["prompt"] and units.RESULT_MARK not in r["prompt"]
            assert r["current_query_result"] not in r["prompt"] or r["current_query_result"] in r["history"]
        else:
            assert r["prompt"].endswith(f"{units.RESULT_MARK}{r['current_query_result']}\n")
            assert "QUESTION:" not in r["prompt"].split(units.RESULT_MARK)[0] and "GOLDEN" not in r["prompt"].split(units.RESULT_MARK)[0]
    assert len({r["cache_key"] for r in rows}) == len(rows)


# Replies --------------------------------------------------------------------


@pytest.mark.parametrize("unit", ["\n", " ", "{", "}", '{"name":"search"', "search", "search{", "(search", "search:", "answer:'", "<tool_call>{", "<answer>", "<search>", "<parameter=a>", " (", "search\n", "search exact "])
def test_replies_are_read_in_linear_time(unit):
    for before, after in (("", ""), ("x\n", "\nx"), ("search", "}"), ('{"name":"search",', "")):
        began = time.process_time()
        P.read_action(before + unit * (1_000_000 // len(unit)) + after)
        assert time.process_time() - began < 4  # a second, and room for a slow machine
        began = time.process_time()
        P.find_tool_call("<function=search>" + unit * (1_000_000 // len(unit)))
        assert time.process_time() - began < 4


@pytest.mark.parametrize(
    "raw, kind, value",
    [
        ("so\n\n search\n {\"query\": \"a\"} ) ", "search", "a"), ("so ( search {\"query\": \"a\"})", "invalid", ""), ("\n( search {\"query\": [\"a\"]} )", "search", "a"), ("search {\"query\": \"a\"} x", "invalid", ""),
        ("x (\n search exact  query = 'b'", "search", "b"), ("research: 'b'", "invalid", ""), ("x\nanswer :\n\"c\"", "answer", "c"), ("<answer> a <answer> b </answer> c </answer>", "answer", "a <answer> b"),
        ('<tool_call> {"name":"search","arguments":{"query":"d"}}\n</tool_call>', "search", "d"), ("<search> e </search>", "search", "e"),
    ],
)
def test_forms_of_replies(raw, kind, value):
    a = P.read_action(raw)
    assert (a["kind"], a["query"] + a["answer"]) == (kind, value)


def test_streamed_steps_equal_the_batch_operator(spark, tmp_path):
    """Every column of every step, not only their number."""
    from tracklode.operators import trajectories
    from tracklode.plans import durable

    events, results = composites.faulty_events(spark, DATA)
    timed = events.withColumn("ts", F.expr(durable.EPOCH) + F.make_dt_interval(secs=F.col("seq") / 1000))
    batch = F.when(F.col("event_type") == "trajectory_finish", 3).otherwise(F.pmod(F.xxhash64("trajectory_id", "seq"), F.lit(3)))
    found = streams.drain(reconstruction.reconstructing(durable.replayed(timed, batch, "ts", "trajectory_id"), late="2 hours"), str(tmp_path), store=ordered.STORE)
    key = lambda df: Counter(map(str, df.select(sorted(df.columns)).collect()))
    assert key(reconstruction.candidates(found, results)) == key(trajectories.reconstruct(events, results))


# Entry ----------------------------------------------------------------------


@pytest.mark.parametrize("hidden", ["xxhash", "public_tokenizers", "corpus_pipeline", "tracklode.llm"])
def test_entry_stands_without_what_is_optional(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'op1_pii' not in q and 'pipeline' not in q and 'stream_reconstruct' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
