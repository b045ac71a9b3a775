import json
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracklode.operators import expect, joins, profiles, selection, stages, trajectories, units, vectors, windows
from tracklode.sources import files, retriever, schemas

ROUND = 10


def search_events(traj, rnd, queries, answer="Search results for: q\n1. t\nbody", asked=None, skip=()):
    call = {"name": "search", "arguments": {"query": queries}}
    messages = [{"role": "assistant", "content": "x"}, {"role": "user", "content": answer}]
    log = [
        ("round_request", {}),
        ("round_response", {"reasoning_content": "think", "content": f"<tool_call>{json.dumps(call)}</tool_call>"}),
        ("tool_extracted", {"extractor_result": json.dumps(call)}),
        ("tool_json_parse", {"json_parse_success": True, "parsed_tool_name": "search", "parsed_tool_args": {"query": asked or queries}}),
        ("search_start", {"queries": queries}),
        ("search_finish", {"result_snapshot": answer, "success": True}),
        ("tool_response_appended", {"tool_response": answer, "messages_snapshot": messages}),
    ]
    return [(traj, rnd * ROUND + k, kind, json.dumps(p | {"round_idx": rnd})) for k, (kind, p) in enumerate(log) if kind not in skip]


def trajectory(traj, *parts, start=1, finish=1):
    first = [(traj, -k, "trajectory_start", json.dumps({"messages_snapshot": [{"role": "user", "content": "question"}]})) for k in range(start)]
    last = [(traj, 1000 + k, "trajectory_finish", json.dumps({"answer": "done"})) for k in range(finish)]
    return first + [e for p in parts for e in p] + last


CASES = {
    "clean": (trajectory("clean", search_events("clean", 1, ["q"]), search_events("clean", 2, ["q"])), 2, []),
    "double": (trajectory("double", search_events("double", 1, ["q"]) + [("double", 14.5, "search_start", '{"round_idx": 1, "queries": ["q"]}')]), 1, ["search_start_round_1"]),
    "open": (trajectory("open", search_events("open", 1, ["q"], skip=("tool_response_appended",))), 0, ["search_action_count", "search_query_count", "unfinished_search_action"]),
    "orphan": (trajectory("orphan", search_events("orphan", 1, ["q"], skip=("search_start",))), 0, ["orphan_observation", "orphan_search_finish", "search_action_count", "search_query_count"]),
    "mismatch": (trajectory("mismatch", search_events("mismatch", 1, ["q"], asked=["other"])), 1, ["query_execution_mismatch_round_1"]),
    "endless": (trajectory("endless", search_events("endless", 1, ["q"]), finish=0), 1, ["trajectory_finish_count"]),
    "unparsed": (trajectory("unparsed", search_events("unparsed", 1, ["q"], skip=("tool_json_parse",))), 0, ["orphan_observation", "orphan_search_finish", "search_action_count", "search_query_count", "search_start_round_1"]),
}


@pytest.fixture(scope="module")
def reconstructed(spark):
    events = [(t, float(s), k, p) for log, _, _ in CASES.values() for t, s, k, p in log]
    e = spark.createDataFrame(events, "trajectory_id string, seq double, event_type string, payload string")
    n = {"clean": 2}
    r = spark.createDataFrame([Row(trajectory_id=t, question_id=t, question="question", golden_answers=["done"], prediction="", search_actions=n.get(t, 1), search_queries=n.get(t, 1), rounds=n.get(t, 1)) for t in CASES])
    return e, r, trajectories.reject_reasons(trajectories.reconstruct(e, r))


def test_reconstruct(reconstructed):
    got = {r["trajectory_id"]: r for r in reconstructed[2].collect()}
    for name, (_, steps, codes) in CASES.items():
        assert len(got[name]["steps"]) == steps, name
        assert [c.removeprefix(trajectories.FAILED) for c in got[name]["reject_reason"]] == sorted(codes), name
    clean = got["clean"]
    assert clean["structural_valid"] and clean["final"]["answer"] == "done"
    assert [s["step_index"] for s in clean["steps"]] == [1, 2]
    assert clean["steps"][0]["executed_action"] == '{"arguments":{"query":["q"]},"name":"search"}'
    assert not clean["steps"][0]["action_source_mismatch"] and clean["steps"][0]["message_continuity_ok"]


def test_messages_and_redundancy(reconstructed):
    clean = reconstructed[2].filter("trajectory_id = 'clean'")
    m = clean.select(trajectories.messages().alias("m"), trajectories.messages(1).alias("one"), trajectories.prefix_text(1).alias("p")).first()
    assert [x["role"] for x in m["m"]] == ["user", "assistant", "user", "assistant", "user", "assistant"] and len(m["one"]) == 3
    assert m["m"][-1]["content"].endswith("<answer>done</answer>") and m["p"].startswith("<think>\nthink")
    counted, verdict = trajectories.step_redundancy(clean)
    assert [r["redundancy_count"] for r in counted.orderBy("step_index").collect()] == [0, 1]
    assert verdict.first()["redundancy_pass"]


def test_integrity(reconstructed):
    e, r, _ = reconstructed
    got = {x["trajectory_id"]: x["ok"] for x in trajectories.event_integrity(e, r).collect()}
    assert got["clean"] and not got["endless"] and not got["open"]


def test_units_and_audit(reconstructed):
    good, bad = units.query_units(reconstructed[2].filter("trajectory_id = 'clean'"))
    rows = {r["unit_id"]: r for r in units.leakage_audit(good).collect()}
    assert set(rows) == {"clean::action_1::query_0", "clean::action_2::query_0"} and bad.isEmpty()
    second = rows["clean::action_2::query_0"]
    assert not second["leaks"] and second["action_position"] == "late" and second["pass"]
    assert rows["clean::action_1::query_0"]["history"] == units.NO_HISTORY
    leaking = good.withColumn("leaks", F.lit(True)).withColumn("prediction", F.lit("x"))
    codes = set(units.leakage_audit(leaking).first()["violations"])
    assert codes == {"sibling_query_literal_in_reasoning", "teacher_final_answer_field_present"}


def test_judge_uses_cache(spark, reconstructed):
    good, _ = units.query_units(reconstructed[2].filter("trajectory_id = 'clean'"))
    audited = units.leakage_audit(good)

    def client(channel, prompts):
        return [f"<{channel}>1</{channel}><{channel}_failure_type>none</{channel}_failure_type><explanation>x</explanation>"] * len(prompts)

    first = units.judge(audited, client)
    assert {r["process_score"] for r in first.collect()} == {1}
    keys = units.channel_requests(audited).select("cache_key", F.lit("broken").alias("reply"))
    assert {r["process_score"] for r in units.judge(audited, client, keys).collect()} == {None}


def stage_rows(spark, n=2, **change):
    rows = []
    for stage in stages.STAGES:
        for q in range(n):
            rows.append(Row(**({"stage": stage, "question_id": f"q{q}", "answer_em": float(q), "answer_f1": 0.5, "task_success": bool(q), "search_action_count": 2, "search_query_count": 4, "valid_query_count": 3, "repeated_query_count": 1, "retrieval_success_count": 2, "process_scores": [1, 0], "trajectory_reward": 1.0, "termination_reason": "answer"} | change)))
    return spark.createDataFrame(rows, schemas.STAGE_ROWS)


def test_stages(spark):
    report = stages.compare(stage_rows(spark))
    row = report.filter("stage = 'SFT'").first()
    assert (row["answer_em"], row["valid_query_ratio"], row["mean_process_reward"]) == (0.5, 0.75, 0.5)
    assert stages.markdown(report).splitlines()[2].startswith("| Base | 0.5000 |")
    for change in ({"valid_query_count": 5}, {"process_scores": [2]}, {"answer_em": None}):
        with pytest.raises(expect.ExpectationError):
            stages.compare(stage_rows(spark, **change))
    with pytest.raises(expect.ExpectationError, match="different questions"):
        stages.compare(stage_rows(spark).filter("stage <> 'DPO' OR question_id <> 'q1'"))
    with pytest.raises(expect.ExpectationError, match="empty"):
        stages.compare(stage_rows(spark).filter("false"))


def test_advantage(spark):
    df = spark.createDataFrame([("g", 0.0), ("g", 0.25), ("h", 0.0), ("h", 0.0)], "g string, r double")
    got = [r["advantage"] for r in windows.group_advantage(df, "g", "r").orderBy("g", "r").collect()]
    assert got[0] < 0 < got[1] and math.isclose(got[0] + got[1], 0, abs_tol=1e-9) and got[2:] == [0, 0]
    with pytest.raises(Exception, match="two finite"):
        windows.group_advantage(df.limit(1), "g", "r").collect()


def test_stagnation(spark):
    flags = [False, True, True, True, False, True]
    df = spark.createDataFrame(list(enumerate(flags)), "i int, dup boolean").withColumn("k", F.lit(1))
    got = windows.stagnation(df, ["k"], ["i"], "dup").orderBy("i").collect()
    assert [r["stagnant_steps"] for r in got] == [0, 1, 2, 3, 0, 1] and [r["terminate_suggested"] for r in got] == [False] * 3 + [True] + [False] * 2


def test_budgets(spark):
    df = spark.createDataFrame([("t", 1, 100, 5.0, "search"), ("t", 2, 500, 5.0, "answer"), ("t", 3, 10, 900.0, "answer"), ("u", 1, 1, 1.0, "search")], "k string, i int, tokens int, seconds double, kind string")
    assert [tuple(r) for r in windows.budget_stop(df, ["k"], ["i"], tokens=600, seconds=540).collect()] == [("t", 2, "tokens")]
    assert [tuple(r) for r in windows.early_answers(df, ["k"], ["i"], "kind", "seconds").collect()] == [("t", 2, 5.0)]


def test_replay_audit(spark):
    df = spark.createDataFrame([("t", 0, [1], [2]), ("t", 1, [1, 2, 3], [4]), ("t", 2, [1, 9, 3, 4], [5])], "t string, g int, input_ids array<int>, generated_ids array<int>")
    bad = windows.replay_audit(df, "t", "g").collect()
    assert [(r["g"], r["first_difference"]) for r in bad] == [(2, 1)]


def test_greedy_matches_plain_python(spark):
    import hashlib

    us = []
    for k in range(60):
        us.append({"unit_id": f"u{k}", "trajectory_id": f"t{k // 2}", "source_action_query_count": 1 + k % 4, "action_idx": 1 + k % 3, "leaks": k % 11 == 0, "action_position": ("early", "middle", "late")[k % 3], "query_position": ("single", "first", "middle", "last")[k % 4], "action_query_count": ("single", "2", "3", ">3")[k % 4], "result_characteristic": ("high", "partial", "weak")[k % 3] + "_query_term_coverage", "verification_candidate": k % 5 == 0, "already_resolved_candidate": k % 7 == 0, "high_history_similarity": k % 6 == 0, "action_level_disagreement_related": k % 9 == 0})
    got = [r["unit_id"] for r in selection.greedy_pilot(spark.createDataFrame([Row(**u) for u in us]), 20, 3).orderBy("place").collect()]
    key = lambda n, u: hashlib.sha256(f"{n}:{u['unit_id']}".encode()).hexdigest()
    have, special, used, want = {n: {} for n in selection.TARGETS}, dict.fromkeys(selection.SPECIALS, 0), set(), []

    def take(u):
        want.append(u["unit_id"])
        used.add(u["trajectory_id"])
        for n in have:
            have[n][u[n]] = have[n].get(u[n], 0) + 1
        for n in special:
            special[n] += u[n]

    for u in sorted((u for u in us if u["source_action_query_count"] == 1), key=lambda u: key(3, u)):
        if u["trajectory_id"] not in used and len(want) < 20:
            take(u)
    for u in sorted((u for u in us if u["action_level_disagreement_related"]), key=lambda u: key(4, u)):
        if special["action_level_disagreement_related"] >= 15:
            break
        if u["trajectory_id"] not in used and not u["leaks"]:
            take(u)
    while len(want) < 20:
        def worth(u):
            s = sum(max(0, g[u[n]] - have[n].get(u[n], 0)) / g[u[n]] for n, g in selection.TARGETS.items())
            return s + sum(1.5 * max(0, g - special[n]) / g for n, g in selection.SPECIALS.items() if u[n]) + 0.02 * (u["action_idx"] > 1)
        take(max((u for u in us if u["trajectory_id"] not in used and not u["leaks"]), key=lambda u: (round(worth(u), 9), key(3 + len(want), u))))
    assert got == want


def test_sample_strata_and_median(spark):
    import random

    df = spark.createDataFrame([(k % 3, k) for k in range(30)], "s int, k int")
    got = sorted(r["k"] for r in selection.sample_strata(df, "s", "k", 2, 5).collect())
    rng = random.Random(5)
    want = sorted(3 * at + s for s in range(3) for at in rng.sample(range(10), 2))
    assert got == want
    three = {r["which"]: r["k"] for r in selection.short_median_over(df, "k", "s", 27).collect()}
    assert three == {"shortest": 0, "median": 15, "over": 28}


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    assert sorted((r["k"], r["v"]) for r in joins.keyed_merge(left, right, "k").collect() if r["v"]) == [(1, "a"), (2, "c")]
    with pytest.raises(Exception, match="missing key 1"):
        joins.lookup(left.select("k"), right, "k", "v").collect()
    assert joins.same_set(left, left.limit(1)).first().asDict() == {"only_left": 1, "only_right": 0}


def test_topk_ties_and_bad_vectors(spark):
    c = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.5])], "query_id long, embedding array<double>")
    assert [(r["vec_id"], r["rank"]) for r in vectors.topk(q, c, 2).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    assert vectors.topk(q.filter("false"), c, 2).count() == 0
    with pytest.raises(expect.ExpectationError):
        vectors.check_dimension(c, 2)


def test_profiles_of_nothing(spark):
    df = spark.createDataFrame([], "x double")
    assert profiles.distribution(df, "x").first().asDict() == {"n": 0, "min": 0.0, "mean": 0.0, "p50": 0.0, "p75": 0.0, "p90": 0.0, "p95": 0.0, "p99": 0.0, "max": 0.0}
    report = profiles.freeze_report(spark.createDataFrame([], schemas.RESULTS)).first()
    assert report["trajectories"] == 0 and report["mean_rounds"] == 0.0


def test_files(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"id": "1", "question": "é"}\n\n[1]\nbroken\n', encoding="utf-8")
    rows, bad = files.read_tolerant(spark, str(p), schemas.QUESTIONS)
    assert [r["question"] for r in rows.collect()] == ["é"] and bad.first()["bad"] == 2
    with pytest.raises(Exception, match="not a JSON object"):
        files.read_strict(spark, str(p), schemas.QUESTIONS).collect()
    assert files.write_lines(rows, str(tmp_path / "out")) == 1
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_lines(rows, str(tmp_path / "out"))
    with pytest.raises(expect.ExpectationError):
        files.write_table(rows.filter("false").select("id"), str(tmp_path / "csv"))
    log = tmp_path / "e.jsonl"
    log.write_text('{"event_type": "a", "trajectory_id": "t", "timestamp": 1.5, "payload": {"round_idx": 1}}\n\n{"event_type": "b", "trajectory_id": "t", "payload": {}}\n')
    assert [(r["seq"], r["event_type"], r["payload"]) for r in files.read_event_files(spark, str(log)).orderBy("seq").collect()] == [(0, "a", '{"round_idx":1}'), (2, "b", "{}")]
    assert files.config('{"m": "${V}"}', {"V": 'a"b'}) == {"m": 'a"b'}
    with pytest.raises(expect.ExpectationError):
        files.config('{"m": "${W}"}', {})


def test_sft_rows(spark, reconstructed):
    rows = files.sft_rows(reconstructed[2].filter("structural_valid"), F.col("question_id")).collect()
    assert [r["sample_id"] for r in rows] == ["sft-0001"] and len(rows[0]["messages"]) == 6


def test_retriever(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b"],), ([],)], "queries array<string>")
    client = lambda qs: [[{"id": q, "score": 1.0, "contents": f"{q}\nbody"}] for q in qs]
    got = retriever.single_query(df, client).collect()
    assert sorted((len(r["queries"]), r["invalid_action"], len(r["hits"])) for r in got) == [(0, True, 0), (1, False, 1), (2, True, 0)]

    calls = []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert retriever.with_retries(flaky)(["x"]) == ["ok"]


def test_append_once(spark, tmp_path):
    from tracklode.streaming import streams

    write = streams.append_once(str(tmp_path / "sink"), "k")
    a = spark.createDataFrame([("x", 1), ("y", 1)], "k string, v int")
    write(a, 0)
    write(a, 0)
    write(spark.createDataFrame([("y", 2), ("z", 2)], "k string, v int"), 1)
    assert sorted((r["k"], r["v"]) for r in spark.read.json(str(tmp_path / "sink")).collect()) == [("x", 1), ("y", 1), ("z", 2)]
