"""The funnel, units of running trajectories, the action adapter and preference pairs on small cases."""

import json

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tracklode.functions import protocol
from tracklode.operators import funnel, preferences, trajectories
from tracklode.plans import composites


@pytest.mark.parametrize("raw, rule, kind, value", [
    ('<tool_call> {"name": "search"} </tool_call>', "champion_native_passthrough", "invalid", ""),
    ('search {"query": " a b "}', "bare_search_json", "search", "a b"),
    ('SEARCH {"query": ["one"]}', "bare_search_json", "search", "one"),
    ('search {"query": ["one", "two"]}', "adapter_no_explicit_action", "invalid", ""),
    ('search {"query": 5}', "adapter_no_explicit_action", "invalid", ""),
    ('search {"query": [5]}', "adapter_no_explicit_action", "invalid", ""),
    ("search {broken}", "adapter_no_explicit_action", "invalid", ""),
    ("<search>\n two\nlines </search>", "smartsearch_xml_search", "search", "two\nlines"),
    ("<search> </search>", "adapter_no_explicit_action", "invalid", ""),
    ("<answer> </answer>", "smartsearch_xml_answer", "answer", ""),
    ("( Answer : yes )", "parenthesized_answer", "answer", "yes"),
    ("(answer: f(x))", "parenthesized_answer", "answer", "f(x"),
    ("answer: no", "bare_answer_prefix", "answer", "no"),
    ("I will visit it", "adapter_no_explicit_action", "forbidden_policy_tool", ""),
    ("<search>a</search> then", "adapter_no_explicit_action", "invalid", ""),
    (None, "adapter_no_explicit_action", "invalid", ""),
])
def test_adapted_actions(spark, raw, rule, kind, value):
    a = spark.createDataFrame([(raw,)], "raw string").select(protocol.adapt_action("raw").alias("a")).first()["a"]
    assert (a["adapter_rule"], a["kind"], a["query"] + a["answer"], a["matched"]) == (rule, kind, value, rule != protocol.UNADAPTED)
    assert a["proposed_tool"] == ("visit" if kind == "forbidden_policy_tool" else None)


def test_funnel_agrees_with_its_parts(spark):
    got = {r["trajectory_id"]: r["rejected_at"] for r in composites.candidate_funnel(spark, DATA).collect()}
    events, res = composites.faulty_events(spark, DATA)
    made = trajectories.reject_reasons(trajectories.reconstruct(events, res))
    good = {r["trajectory_id"]: r["structural_valid"] for r in made.collect()}
    fresh = {r["trajectory_id"]: r["redundancy_pass"] for r in trajectories.step_redundancy(made)[1].collect()}
    chars = {r["trajectory_id"]: sum(len(s["observation"]) for s in r["steps"]) for r in made.collect()}
    for r in res.collect():
        t = r["trajectory_id"]
        ok = r["question_type"] == "ordinary_qa" and r["answer_f1"] >= 0.5
        want = "outcome" if not ok else "reconstruct" if not good[t] else "redundancy" if not fresh.get(t, True) else "length" if chars[t] > 4_000 else None
        assert got.pop(t) == want
    assert not got
    counts = composites.candidate_funnel_counts(spark, DATA).collect()
    assert [r["stage"] for r in counts] == list(funnel.STAGES) and counts[0]["entered"] == res.count()
    assert all(a["passed"] == b["entered"] for a, b in zip(counts, counts[1:])) and all(r["entered"] == r["rejected"] + r["passed"] for r in counts)


def test_online_units_need_whole_chains(spark):
    shown = "Search results for: a\n1. x\n\nSearch results for: b\n1. y"
    def log(t, ok, observation):
        e = [("round_response", {"content": "<think> why </think> go"}), ("search_start", {"queries": ["a", "b"]}), ("search_finish", {"success": ok}), ("tool_response_appended", {"tool_response": observation})]
        return [(t, i, k, json.dumps({"round_idx": 1, **p})) for i, (k, p) in enumerate(e)]
    rows = log("whole", True, shown) + log("failed", False, shown) + log("short", True, shown[:30]) + log("cut", True, shown)[:2]
    units, broken = funnel.online_units(spark.createDataFrame(rows, "trajectory_id string, seq long, event_type string, payload string"))
    assert [(r["unit_id"], r["current_executed_query"], r["current_action_reasoning"]) for r in units.orderBy("unit_id").collect()] == [("whole::action_1::query_0", "a", "why"), ("whole::action_1::query_1", "b", "why")]
    assert {r["trajectory_id"] for r in broken.collect()} == {"failed", "short", "cut"}


def test_pairs_of_bad_batches(spark):
    rows = [("a", i, float(i)) for i in range(4)] + [("odd", i, 0.0) for i in range(3)] + [("twice", 0, 0.0), ("twice", 0, 1.0)] + [("gap", 0, 0.0), ("gap", 2, 1.0)]
    pairs, bad = preferences.pair_branches(spark.createDataFrame(rows, "batch string, at long, x double"), "batch", "at", "x")
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", 0, 0.0, 2.0), ("a", 1, 1.0, 3.0)]
    assert {r["batch"] for r in bad.collect()} == {"odd", "twice", "gap"}
    nothing = preferences.preference_summary(spark.createDataFrame([], "b long, chosen_policy double, rejected_policy double, chosen_reference double, rejected_reference double"), "b", 0.1).first()
    assert nothing["pairs"] == 0 and nothing["loss"] is None


def test_repeat_to(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    got = lambda n: [r["x"] for r in preferences.repeat_to(rows, [F.col("x")], n).orderBy("micro_batch").collect()]
    assert got(7) == list("abcabca") and got(2) == list("ab")


def test_termination_name(spark):
    x = spark.createDataFrame([("answer",), ("raw_fallback",), (None,)], "x string")
    assert [r[0] for r in x.select(funnel.termination_name(F.col("x"))).collect()] == ["normal_answer", "raw_fallback", None]
