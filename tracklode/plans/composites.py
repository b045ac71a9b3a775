"""Queries over whole plans: the candidate funnel, failing logs, online units, audits, preference pairs and reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import protocol
from ..functions.algebra import policy_ratio
from ..operators import funnel, preferences, profiles, trajectories
from .catalog import _TURNS, RESULTS, query, results, rounded, synthetic_events, t


#: JSON text of a reasoning that calls for another query.
OTHER_CALL = json.dumps('<tool_call>{"name":"search","arguments":{"query":["other"]}}</tool_call>')


def faulty_events(spark, d):
    """The synthetic logs and results with faults by rule: the conversation modulo 5 says which.

    1 has no finish, 2 no observation, 3 no search start, and 4 another call in
    its reasoning than in its content, which is a mismatch but no failure.
    """
    events, res = synthetic_events(spark, d)
    fault = F.pmod(F.substring("trajectory_id", 2, 20).cast("bigint"), F.lit(5))
    kind = F.col("event_type")
    gone = ((fault == 1) & (kind == "trajectory_finish")) | ((fault == 2) & (kind == "tool_response_appended")) | ((fault == 3) & (kind == "search_start"))
    events = events.withColumn("payload", F.when(fault == 4, F.replace("payload", F.lit('"look it up"'), F.lit(OTHER_CALL))).otherwise(F.col("payload")))
    k = F.col("question_id").cast("bigint")
    f1 = F.pmod(k, F.lit(101)) / 100
    res = res.withColumns({"question_type": F.when(F.pmod(k, F.lit(8)) == 7, "invalid_question").otherwise("ordinary_qa"), "answer_f1": f1, "outcome_pass": f1 >= 0.8, "position": k, "action_source_mismatch": (fault == 4).cast("int")})
    return events.filter(~gone), res


_FAULTY = f"{_TURNS}, s AS (SELECT c.conv_id, c.conv_id % 5 AS fault, count(a.turn) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a USING (conv_id) GROUP BY 1)"
_CODES = """list_sort(CASE WHEN fault = 1 THEN ['trajectory_finish_count'] WHEN n = 0 OR fault IN (0, 4) THEN []::VARCHAR[]
  WHEN fault = 2 THEN ['unfinished_search_action', 'search_action_count', 'search_query_count'] ELSE ['orphan_search_finish', 'orphan_observation', 'search_action_count', 'search_query_count'] END)"""


@query(f"WITH {_FAULTY} SELECT 't' || conv_id AS trajectory_id, CASE WHEN n > 0 AND fault IN (2, 3) THEN 0 ELSE n END AS n_steps, len({_CODES}) = 0 AS structural_valid, array_to_string({_CODES}, ',') AS reasons FROM s")
def reconstruct_faulty(spark, d):
    c = trajectories.reject_reasons(trajectories.reconstruct(*faulty_events(spark, d)))
    codes = F.transform("reject_reason", lambda r: F.replace(r, F.lit(trajectories.FAILED), F.lit("")))
    return c.select("trajectory_id", F.size("steps").cast("bigint").alias("n_steps"), "structural_valid", F.array_join(F.array_sort(codes), ",").alias("reasons"))


@query(f"""WITH {_FAULTY} SELECT 't' || conv_id AS trajectory_id, n AS rounds, n AS search_actions, (fault <> 1)::INT::BIGINT AS finishes, n AS round_requests, CASE WHEN fault = 3 THEN 0 ELSE n END AS search_starts, n AS search_finishes,
CASE WHEN fault = 2 THEN 0 ELSE n END AS observations, fault IN (0, 4) OR (n = 0 AND fault <> 1) AS ok FROM s""")
def integrity_faulty(spark, d):
    return trajectories.event_integrity(*faulty_events(spark, d))


@query(f"""WITH {_FAULTY}, k AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM a WHERE conv_id % 5 = 4)
SELECT 't' || conv_id AS trajectory_id, conv_id AS source_split_position, k AS round_idx, true AS executed_query_matches_search_start, false AS executed_matches_reasoning_candidate, true AS executed_matches_content_candidate FROM k ORDER BY conv_id, k LIMIT 20""")
def mismatch_cases(spark, d):
    """The audit's first 20 cases of reasoning and content that call for different searches."""
    c = funnel.mismatch_cases(*faulty_events(spark, d))
    return c.select("trajectory_id", "source_split_position", "round_idx", "executed_query_matches_search_start", "executed_matches_reasoning_candidate", "executed_matches_content_candidate")


@query(f"""WITH {_FAULTY} SELECT 'all' AS category, conv_id::VARCHAR AS question_id, n AS step_count, CASE WHEN fault = 4 THEN n ELSE 0 END AS mismatch_count, true AS all_ok, n AS hashes FROM s WHERE len({_CODES}) = 0""")
def audit_records(spark, d):
    c = trajectories.reject_reasons(trajectories.reconstruct(*faulty_events(spark, d))).filter("structural_valid").select(*funnel.audit_record("all"))
    ok = F.col("all_actions_are_search") & F.col("all_queries_nonempty") & F.col("all_observations_present") & F.col("all_continuity_ok")
    size = lambda c: F.size(c).cast("bigint")
    return c.select("category", "question_id", F.col("step_count").cast("bigint").alias("step_count"), F.col("mismatch_count").cast("bigint").alias("mismatch_count"), ok.alias("all_ok"), F.least(size("action_hashes"), size("observation_hashes")).alias("hashes"))


def funnel_candidates(spark, d):
    events, res = faulty_events(spark, d)
    text = F.aggregate("steps", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x["observation"]))
    return funnel.candidate_funnel(events, res, text, 4_000, 0.5)


@query()
def candidate_funnel(spark, d):
    """All stages on faulty logs; the redundancy rule has no SQL, so this is tested against its parts."""
    return funnel_candidates(spark, d).select("trajectory_id", "question_id", "rejected_at", F.array_join("reasons", ",").alias("reasons"), "canonical_length")


@query()
def candidate_funnel_counts(spark, d):
    return funnel.funnel_counts(funnel_candidates(spark, d))


@query(f"""WITH {_FAULTY} SELECT count(*) FILTER (WHERE NOT o) AS outcome_rejected, count(*) FILTER (WHERE o AND len({_CODES}) > 0) AS reconstruct_rejected, count(*) FILTER (WHERE o AND len({_CODES}) = 0) AS later
FROM (SELECT *, conv_id % 8 <> 7 AND conv_id % 101 >= 50 AS o FROM s)""")
def funnel_front(spark, d):
    at = F.col("rejected_at")
    return funnel_candidates(spark, d).agg(F.count_if(at == "outcome").alias("outcome_rejected"), F.count_if(at == "reconstruct").alias("reconstruct_rejected"), F.count_if(at.isNull() | ~at.isin("outcome", "reconstruct")).alias("later"))


_ASK = r"array_to_string(list_slice(string_split_regex(text, '[ \n]+'), 1, 4), ' ')"


@query(f"""WITH x AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), a AS (SELECT conv_id, turn, {_ASK} AS q, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM x WHERE role = 'assistant' AND nxt IS NOT NULL)
SELECT 't' || conv_id || '::action_' || k || '::query_' || i AS unit_id, CASE WHEN i = 0 THEN q ELSE q || ' ' || (['origin', 'year', 'place'])[turn % 3 + 1] END AS query FROM a, (VALUES (0), (1)) v(i) WHERE conv_id % 5 NOT IN (2, 3)""")
def online_units(spark, d):
    units, _ = funnel.online_units(faulty_events(spark, d)[0])
    return units.select("unit_id", F.col("current_executed_query").alias("query"))


@query(f"WITH {_FAULTY} SELECT 't' || conv_id AS trajectory_id, n AS searches FROM s WHERE fault = 2 AND n > 0")
def online_units_broken(spark, d):
    return funnel.online_units(faulty_events(spark, d)[0])[1].groupBy("trajectory_id").agg(F.count("*").alias("searches"))


@query(r"""WITH x AS (SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS v FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'smartsearch_xml_answer' WHEN v = '' THEN 'adapter_no_explicit_action' WHEN role = 'assistant' THEN 'smartsearch_xml_search' ELSE 'bare_search_json' END AS rule,
CASE WHEN role = 'user' THEN 'answer' WHEN v = '' THEN 'invalid' ELSE 'search' END AS kind, v AS value FROM x""")
def adapted_actions(spark, d):
    """Whole turns in the forms that the adapter knows, by role."""
    tag = lambda name: F.concat(F.lit(f" <{name}> "), F.col("text"), F.lit(f"\n</{name}>\n"))
    raw = F.when(F.col("role") == "user", tag("answer")).when(F.col("role") == "assistant", tag("search")).otherwise(F.concat(F.lit("Search "), F.to_json(F.struct(F.array("text").alias("query")))))
    c = t(spark, d, "conversations").withColumn("a", protocol.adapt_action(raw))
    return c.select("conv_id", "turn", F.col("a.adapter_rule").alias("rule"), F.col("a.kind").alias("kind"), F.concat("a.query", "a.answer").alias("value"))


@query("""WITH p AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, embedding[1]::DOUBLE AS policy, embedding[2]::DOUBLE AS reference FROM embeddings),
c AS (SELECT a.pair // 8 AS batch, 0.1 * ((a.policy - b.policy) - (a.reference - b.reference)) AS x FROM p a JOIN p b ON a.pair = b.pair AND a.side = 0 AND b.side = 1),
m AS (SELECT batch, avg(greatest(-x, 0) + ln(1 + exp(-abs(x)))) AS loss, count(*) FILTER (WHERE x > 0) AS r, count(*) AS n FROM c GROUP BY 1)
SELECT round(avg(loss), 6) AS loss, round(sum(r) / sum(n), 6) AS reward_accuracy, sum(n)::BIGINT AS pairs FROM m""")
def preference_evaluation(spark, d):
    """Vectors as branches: 16 a batch, the even ones chosen and the odd ones rejected."""
    v = t(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("policy"), F.col("embedding")[1].cast("double").alias("reference"))
    k = F.expr("vec_id div 2")
    sizes = v.groupBy(F.expr("vec_id div 16").alias("batch")).agg(F.expr("count(*) div 2").alias("half"))
    rows = v.withColumns({"batch": F.expr("vec_id div 16"), "place": F.pmod(k, F.lit(8))}).join(sizes, "batch")
    rows = rows.withColumn("place", F.col("place") + F.when(F.pmod("vec_id", F.lit(2)) == 1, F.col("half")).otherwise(0))
    return rounded(preferences.preference_summary(preferences.pair_branches(rows, "batch", "place", "policy", "reference")[0], "batch", 0.1))


@query("""WITH s AS (SELECT conv_id, length(text) AS n, turn::DOUBLE AS x FROM conversations), m AS (SELECT conv_id, CASE WHEN sum(n) > 0 THEN sum(x * n) / sum(n) ELSE 0 END AS x FROM s GROUP BY 1) SELECT round(avg(x), 6) AS turn FROM m""")
def token_share_mean(spark, d):
    s = t(spark, d, "conversations").select("conv_id", F.length("text").alias("n"), F.col("turn").cast("double").alias("turn"))
    return rounded(preferences.token_share_mean(s, "conv_id", "n", "turn"))


@query("SELECT vec_id, round(exp(embedding[1]::DOUBLE - embedding[2]::DOUBLE), 6) AS ratio FROM embeddings")
def policy_ratios(spark, d):
    at = lambda k: F.col("embedding")[k].cast("double")
    return t(spark, d, "embeddings").select("vec_id", F.round(policy_ratio(at(0), at(1)), 6).alias("ratio"))


@query("""WITH e AS (SELECT conv_id, count(*) AS expected, count(*) FILTER (WHERE (conv_id + turn) % 9 <> 0) AS scored, coalesce(sum(turn % 2) FILTER (WHERE (conv_id + turn) % 9 <> 0), 0) AS good FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT c.conv_id, coalesce(expected, 0) AS expected, coalesce(scored, 0) AS scored, coalesce(good, 0)::BIGINT AS good, coalesce(expected = scored, true) AS complete FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e USING (conv_id)""")
def score_completeness(spark, d):
    """Assistant turns as units; one in nine has no score."""
    c = t(spark, d, "conversations")
    units = c.filter("role = 'assistant'").select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("unit_id"), F.pmod("turn", F.lit(2)).alias("score"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9)).alias("left"))
    joined = preferences.join_scores(c.select("conv_id").distinct(), units, units.filter("left <> 0"), "conv_id", "score")
    good = F.aggregate("scores", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return joined.select("conv_id", "expected", "scored", good.alias("good"), "complete")


@query("SELECT r_regionkey, m::BIGINT AS micro_batch FROM region, range(12) x(m), (SELECT count(*) AS k FROM region) WHERE m % k = r_regionkey")
def repeated_batches(spark, d):
    return preferences.repeat_to(t(spark, d, "region").select("r_regionkey"), [F.col("r_regionkey")], 12)


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'first' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'second' ELSE 'other' END AS provider FROM documents")
def provider_membership(spark, d):
    labels = t(spark, d, "labels")
    return funnel.provider_by_membership(t(spark, d, "documents").select("doc_id"), "doc_id", [("first", labels.filter("toxic = 1")), ("second", labels)], "other")


@query(f"WITH {RESULTS} SELECT count(*) AS rows, count(*) FILTER (WHERE question_type = 'ordinary_qa' AND answer_f1 >= 0.8) AS passed, count(*) FILTER (WHERE question_type = 'ordinary_qa' AND answer_f1 >= 0.8 AND NOT outcome_pass) AS disagree, count(*) FILTER (WHERE action_source_mismatch > 0) AS mismatched FROM r")
def outcome_recheck(spark, d):
    r = results(spark, d)
    ok = funnel.outcome()
    return r.agg(F.count("*").alias("rows"), F.count_if(ok).alias("passed"), F.count_if(ok & ~F.col("outcome_pass")).alias("disagree"), F.count_if(F.col("action_source_mismatch") > 0).alias("mismatched"))


@query("SELECT count(*) AS units, count(*) FILTER (WHERE event_type = 'click') AS success, count(*) FILTER (WHERE event_type <> 'click') AS failed, sum(event_id % 3)::BIGINT AS attempts FROM events")
def judge_run_summary(spark, d):
    status = F.when(F.col("event_type") == "click", "success").otherwise(F.col("event_type"))
    return funnel.judge_run_summary(t(spark, d, "events").select(status.alias("status"), F.pmod("event_id", F.lit(3)).alias("attempt_count")))


@query(f"""WITH {RESULTS} SELECT count(*) AS num_questions, round(avg(answer_em), 6) AS "EM", round(avg(answer_f1), 6) AS "F1", round(count(*) FILTER (WHERE search_queries > 0) / count(*), 6) AS search_rate,
round(sum(search_queries) / count(*) FILTER (WHERE search_queries > 0), 6) AS avg_queries_when_searching, round(count(*) FILTER (WHERE termination = 'force_answer') / count(*), 6) AS budget_hit_rate, count(*) FILTER (WHERE termination = 'raw_fallback') AS fallbacks FROM r""")
def evaluation_summary(spark, d):
    r = results(spark, d).withColumns({"num_queries": F.col("search_queries"), "termination_reason": F.col("termination"), "budget_hit": F.col("termination") == "force_answer", **{c: F.lit(False) for c in ("answer_before_search", "strict_protocol_valid", "logical_action_valid", "duplicate_query_count")}})
    s = profiles.evaluation_summary(r)
    return rounded(s.select("num_questions", "EM", "F1", "search_rate", "avg_queries_when_searching", "budget_hit_rate", F.col("termination_reason_distribution")["raw_fallback"].alias("fallbacks")))
