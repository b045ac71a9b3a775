"""Queries that exercise the operators on the fixture tables, each with its SQL.

The fixture tables hold no agent trajectories, so conversations stand in for
trajectories (assistant turns as actions), events for event logs (one user a
trajectory, in order of time and id), documents for passages, labels for
judge scores, and orders and line items for results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..functions import protocol
from ..functions import text as X
from ..operators import joins, overlap, profiles, selection, stages, trajectories, units, vectors, windows
from ..operators.expect import violations
from ..sources.shared import fresh_path
from ..streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def results(spark: SparkSession, d: str) -> DataFrame:
    """Orders as results: the priority is the provider, line items give rounds and tokens."""
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("rounds"), F.sum("l_quantity").cast("bigint").alias("search_queries"), F.round(F.sum("l_extendedprice")).cast("bigint").alias("total_tokens"))
    o = t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    f1 = F.round(F.pmod(F.col("o_orderkey"), F.lit(101)) / 100, 2)
    return o.select(
        F.col("o_orderkey").alias("question_id"),
        F.col("o_orderpriority").alias("provider"),
        F.when(F.pmod("o_orderkey", F.lit(8)) == 0, "invalid_question").otherwise("ordinary_qa").alias("question_type"),
        (f1 >= 0.99).cast("double").alias("answer_em"),
        f1.alias("answer_f1"),
        (f1 >= 0.8).alias("outcome_pass"),
        F.coalesce("rounds", F.lit(0)).alias("rounds"),
        F.coalesce("rounds", F.lit(0)).alias("search_actions"),
        F.coalesce("search_queries", F.lit(0)).alias("search_queries"),
        F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
        F.when(F.col("o_orderstatus") == "F", "normal_answer").when(F.col("o_orderstatus") == "O", "force_answer").otherwise("raw_fallback").alias("termination"),
        (F.pmod("o_orderkey", F.lit(7)) == 0).cast("bigint").alias("malformed_wrappers"),
        (F.pmod("o_orderkey", F.lit(5)) == 0).cast("bigint").alias("action_source_mismatch"),
    )


RESULTS = """r AS (SELECT o_orderkey AS question_id, o_orderpriority AS provider,
  CASE WHEN o_orderkey % 8 = 0 THEN 'invalid_question' ELSE 'ordinary_qa' END AS question_type,
  CASE WHEN round((o_orderkey % 101) / 100.0, 2) >= 0.99 THEN 1.0 ELSE 0.0 END::DOUBLE AS answer_em,
  round((o_orderkey % 101) / 100.0, 2)::DOUBLE AS answer_f1, round((o_orderkey % 101) / 100.0, 2) >= 0.8 AS outcome_pass,
  coalesce(rounds, 0) AS rounds, coalesce(rounds, 0) AS search_actions, coalesce(search_queries, 0) AS search_queries, coalesce(total_tokens, 0) AS total_tokens,
  CASE o_orderstatus WHEN 'F' THEN 'normal_answer' WHEN 'O' THEN 'force_answer' ELSE 'raw_fallback' END AS termination,
  CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS malformed_wrappers, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS action_source_mismatch
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS rounds, sum(l_quantity)::BIGINT AS search_queries, round(sum(l_extendedprice))::BIGINT AS total_tokens FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey)"""

_dist = "count(n_chars) AS n, min(n_chars)::DOUBLE AS min, round(avg(n_chars), 6) AS mean, " + ", ".join(f"round(quantile_cont(n_chars, {q}), 6) AS p{round(100 * q)}" for q in profiles.QUANTILES) + ", max(n_chars)::DOUBLE AS max"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums in another order differ in their last bits."""
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema))


@query(f"SELECT lang, {_dist} FROM documents GROUP BY lang")
def distribution_summary(spark, d):
    return rounded(profiles.distribution(t(spark, d, "documents"), "n_chars", "lang"))


@query("""WITH x(bucket, lo, hi) AS (VALUES """ + ", ".join(f"('<={n}', -1, {n})" for n in profiles.TOKEN_LIMITS) + f", ('>{profiles.TOKEN_LIMITS[-1]}', {profiles.TOKEN_LIMITS[-1]}, 9000000000000000000)" + """)
SELECT bucket, count(*) FILTER (WHERE n_chars > lo AND n_chars <= hi) AS n, round(count(*) FILTER (WHERE n_chars > lo AND n_chars <= hi) / count(*), 6) AS rate FROM documents, x GROUP BY bucket""")
def length_coverage(spark, d):
    return rounded(profiles.coverage(t(spark, d, "documents"), "n_chars"))


def _profile_sql(group: str, source: str = "r") -> str:
    def quality(p, cond):
        n, k = f"count(*) FILTER (WHERE {cond})", f"count(*) FILTER (WHERE {cond} AND outcome_pass)"
        return f"{n} AS {p}_n, round(coalesce(avg(answer_em) FILTER (WHERE {cond}), 0), 6) AS {p}_em, round(coalesce(avg(answer_f1) FILTER (WHERE {cond}), 0), 6) AS {p}_f1, {k} AS {p}_pass, round(CASE WHEN {n} > 0 THEN {k} / {n} ELSE 0 END, 6) AS {p}_pass_rate"

    rate = lambda c: f"round(CASE WHEN sum(search_actions) > 0 THEN sum({c}) / sum(search_actions) ELSE 0 END, 6)"
    return f"""SELECT {group} AS "group", {quality("overall", "true")}, {quality("ordinary", "question_type = 'ordinary_qa'")}, {quality("invalid", "question_type = 'invalid_question'")},
  round(avg(rounds), 6) AS mean_rounds, round(quantile_cont(rounds, 0.5), 6) AS median_rounds, round(quantile_cont(rounds, 0.95), 6) AS p95_rounds, round(avg(search_actions), 6) AS mean_search_actions, round(avg(search_queries), 6) AS mean_search_queries,
  round(avg(total_tokens), 6) AS mean_tokens, round(quantile_cont(total_tokens, 0.5), 6) AS median_tokens, round(count(*) FILTER (WHERE termination = 'force_answer') / count(*), 6) AS force_answer_rate, round(count(*) FILTER (WHERE termination = 'raw_fallback') / count(*), 6) AS raw_fallback_rate,
  {rate("malformed_wrappers")} AS malformed_wrapper_rate, {rate("action_source_mismatch")} AS action_source_mismatch_rate FROM {source} GROUP BY 1"""


@query(f"WITH {RESULTS} {_profile_sql('provider')}")
def provider_profile(spark, d):
    return rounded(profiles.group_profile(results(spark, d), "provider"))


@query(f"WITH {RESULTS}, b AS (SELECT *, CASE WHEN rounds BETWEEN 1 AND 3 THEN '1-3' WHEN rounds BETWEEN 4 AND 6 THEN '4-6' WHEN rounds BETWEEN 7 AND 12 THEN '7-12' WHEN rounds BETWEEN 13 AND 20 THEN '13-20' WHEN rounds BETWEEN 21 AND 30 THEN '21-30' WHEN rounds >= 31 THEN '31+' END AS bucket FROM r) {_profile_sql('bucket', 'b WHERE bucket IS NOT NULL')}")
def round_bucket_profile(spark, d):
    r = results(spark, d).withColumn("bucket", profiles.range_bucket("rounds")).filter("bucket IS NOT NULL")
    return rounded(profiles.group_profile(r, "bucket"))


@query(f"WITH {RESULTS}, q AS (SELECT quantile_cont(total_tokens, [0.5, 0.75, 0.9, 0.95, 0.99]) AS c FROM r), b AS (SELECT r.*, CASE WHEN total_tokens <= c[1] THEN '<=p50' WHEN total_tokens <= c[2] THEN 'p50-p75' WHEN total_tokens <= c[3] THEN 'p75-p90' WHEN total_tokens <= c[4] THEN 'p90-p95' WHEN total_tokens <= c[5] THEN 'p95-p99' ELSE '>p99' END AS bucket FROM r, q) {_profile_sql('bucket', 'b')}")
def quantile_bucket_profile(spark, d):
    return rounded(profiles.group_profile(profiles.quantile_bucket(results(spark, d), "total_tokens"), "bucket"))


@query(f"""WITH {RESULTS}, p AS (SELECT provider AS key, count(*) AS n, round(avg(answer_f1), 6) AS f1, round(avg(rounds), 6) AS rounds FROM r GROUP BY 1)
SELECT * FROM p UNION ALL SELECT 'absolute_difference', abs(a.n - b.n), round(abs(a.f1 - b.f1), 6), round(abs(a.rounds - b.rounds), 6) FROM p a, p b WHERE a.key = '1-URGENT' AND b.key = '5-LOW'""")
def provider_abs_diff(spark, d):
    p = rounded(results(spark, d).groupBy(F.col("provider").alias("key")).agg(F.count("*").alias("n"), F.avg("answer_f1").alias("f1"), F.avg("rounds").alias("rounds")))
    return rounded(profiles.abs_difference(p, "key", "1-URGENT", "5-LOW"))


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def grouping_sets_profile(spark, d):
    t(spark, d, "documents").createOrReplaceTempView("__docs")
    return spark.sql("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM __docs GROUP BY GROUPING SETS ((lang), (source), ())")


@query("SELECT l_returnflag, round(CASE WHEN sum(l_quantity) <> 0 THEN sum(l_extendedprice) / sum(l_quantity) ELSE 0 END, 6) AS ratio FROM lineitem GROUP BY 1")
def ratio_of_sums(spark, d):
    return rounded(t(spark, d, "lineitem").groupBy("l_returnflag").agg(A.ratio_or_zero(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("ratio")))


@query("""SELECT round((SELECT sum(x) FROM (SELECT o_totalprice AS x FROM orders ORDER BY 1 DESC LIMIT 10)), 4) AS top, round(sum(o_totalprice), 4) AS "all", round((SELECT sum(x) FROM (SELECT o_totalprice AS x FROM orders ORDER BY 1 DESC LIMIT 10)) / sum(o_totalprice), 9) AS top_share FROM orders""")
def top_share(spark, d):
    return profiles.top_share(t(spark, d, "orders"), "o_totalprice").select(F.round("top", 4).alias("top"), F.round("all", 4).alias("all"), F.round("top_share", 9).alias("top_share"))


@query("SELECT tokens, units, o AS output_tokens_per_unit, round((tokens * 0.158 + units * o * 1.58) / 1e6, 9) AS cost FROM (SELECT sum(n_chars)::BIGINT AS tokens, count(*) AS units FROM documents), (VALUES (64), (128), (256)) v(o)")
def cost_scenarios(spark, d):
    totals = t(spark, d, "documents").agg(F.sum("n_chars").alias("tokens"), F.count("*").alias("units"))
    return rounded(profiles.cost_scenarios(totals, "tokens", "units", (64, 128, 256), 0.158, 1.58), 9)


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def histogram(spark, d):
    return rounded(profiles.histogram(t(spark, d, "events"), "event_type"))


@query(r"SELECT w AS value, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1))) AS w FROM benchmark) GROUP BY 1")
def exploded_histogram(spark, d):
    return t(spark, d, "benchmark").select(F.explode(X.word_set("text")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


@query("""SELECT 'unique_ids' AS "check", count(*) - count(DISTINCT doc_id) AS failures FROM documents UNION ALL SELECT 'has_text', count(*) FILTER (WHERE text IS NULL OR text = '') FROM documents UNION ALL SELECT 'length_agrees', count(*) FILTER (WHERE n_chars <> length(text)) FROM documents""")
def integrity_checklist(spark, d):
    docs = t(spark, d, "documents")
    dup = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.lit("unique_ids").alias("check"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("failures"))
    return dup.unionByName(violations(docs, has_text=F.length("text") > 0, length_agrees=F.col("n_chars") == F.length("text")))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS search_starts, count(*) FILTER (WHERE event_type = 'purchase') AS observations, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') = count(*) FILTER (WHERE event_type = 'purchase') AS ok FROM events GROUP BY 1")
def event_integrity(spark, d):
    k = F.col("event_type")
    n = lambda v: F.count_if(k == v)
    return t(spark, d, "events").groupBy("user_id").agg(n("click").alias("search_starts"), n("purchase").alias("observations"), n("error").alias("errors"), F.count("*").alias("n"), (n("click") == n("purchase")).alias("ok"))


@query("SELECT role, sha256(string_agg(conv_id::VARCHAR, chr(10) ORDER BY conv_id::VARCHAR COLLATE \"C\")) AS ids FROM conversations GROUP BY role")
def id_set_hash(spark, d):
    return t(spark, d, "conversations").groupBy("role").agg(stages.ids_hash("conv_id").alias("ids"))


NORM = r"list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the'))"


@query(f"SELECT doc_id, array_to_string({NORM.format('text')}, ' ') AS norm FROM documents")
def text_normalize(spark, d):
    return t(spark, d, "documents").select("doc_id", X.qa_normalize("text").alias("norm"))


@query(f"""WITH d AS (SELECT doc_id, {NORM.format("coalesce(text, '')")} AS w FROM documents), b AS (SELECT item_id, {NORM.format("coalesce(text, '')")} AS w FROM benchmark),
dt AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY 1, 2), bt AS (SELECT item_id, x, count(*) AS c FROM (SELECT item_id, unnest(w) AS x FROM b) GROUP BY 1, 2),
p AS (SELECT doc_id, item_id, sum(least(dt.c, bt.c))::DOUBLE AS n FROM dt JOIN bt USING (x) GROUP BY 1, 2 UNION ALL SELECT doc_id, item_id, 0 FROM d, b WHERE len(d.w) = 0 AND len(b.w) = 0)
SELECT doc_id, item_id, (array_to_string(d.w, ' ') = array_to_string(b.w, ' '))::INT::DOUBLE AS em,
round(CASE WHEN len(d.w) = 0 THEN 1.0 ELSE 2 * (n / len(d.w)) * (n / len(b.w)) / (n / len(d.w) + n / len(b.w)) END, 9)::DOUBLE AS f1 FROM p JOIN d USING (doc_id) JOIN b USING (item_id)""")
def em_f1_pairs(spark, d):
    """Whole texts against every item: all pairs with a common token, or with equal texts; the others score 0."""
    bag = X.qa_normalize("text")
    n, p, g = F.col("both").cast("double"), F.col("n_doc"), F.col("n_item")
    pairs = overlap.overlaps(t(spark, d, "documents"), t(spark, d, "benchmark"), "doc_id", "item_id", bag, bag)
    f1 = F.when((p == 0) & (g == 0), 1.0).when(n == 0, 0.0).otherwise(2 * (n / p) * (n / g) / (n / p + n / g))
    return pairs.select("doc_id", "item_id", F.col("same").cast("double").alias("em"), F.round(f1, 9).alias("f1"))


WORDS = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 1))"
JACCARD = "CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) ELSE 0 END"


@query(f"""WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), b AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS x, len(w) AS n FROM d), bw AS (SELECT item_id, unnest(w) AS x, len(w) AS n FROM b),
c AS (SELECT doc_id, item_id, any_value(dw.n) AS a, any_value(bw.n) AS b, count(*) AS n FROM dw JOIN bw USING (x) GROUP BY 1, 2)
SELECT doc_id, item_id, round(n / (a + b - n), 9) AS jaccard, round(n / b, 9) AS coverage FROM c""")
def word_jaccard(spark, d):
    """Every document against every item: all pairs with a common word; the others have 0 in both columns."""
    bag = F.array_join(X.word_set("text"), " ")
    pairs = overlap.overlaps(t(spark, d, "documents"), t(spark, d, "benchmark"), "doc_id", "item_id", bag, bag).filter("both > 0")
    n, a, b = F.col("both"), F.col("n_doc"), F.col("n_item")
    return pairs.select("doc_id", "item_id", F.round(n / (a + b - n), 9).alias("jaccard"), F.round(n / b, 9).alias("coverage"))


def turn_words(spark, d):
    return t(spark, d, "conversations").withColumn("fragments", X.word_set("text"))


_REDUNDANCY = f"""w AS (SELECT conv_id, turn, {WORDS.format('text')} AS ws FROM conversations), e AS (SELECT conv_id, turn, unnest(ws) AS f FROM w),
f AS (SELECT conv_id, f, min(turn) AS first FROM e GROUP BY 1, 2), s AS (SELECT e.conv_id, turn, count(*) AS n FROM e JOIN f USING (conv_id, f) WHERE turn > first GROUP BY 1, 2),
c AS (SELECT w.conv_id, w.turn, len(ws) AS fragment_count, len(ws) AS unique_count, coalesce(n, 0) AS redundancy_count FROM w LEFT JOIN s ON w.conv_id = s.conv_id AND w.turn = s.turn)"""


@query(f"WITH {_REDUNDANCY} SELECT conv_id, turn, fragment_count::INT AS fragment_count, unique_count::INT AS unique_count, redundancy_count FROM c")
def redundancy_by_turn(spark, d):
    return windows.redundancy(turn_words(spark, d), "conv_id", "turn", "fragments").select("conv_id", "turn", "fragment_count", "unique_count", "redundancy_count")


@query(f"WITH {_REDUNDANCY} SELECT conv_id, bool_and(fragment_count > 0 AND redundancy_count <= 1) AS redundancy_pass, CASE WHEN NOT bool_and(fragment_count > 0) THEN 'redundancy_identity_unavailable' WHEN NOT bool_and(redundancy_count <= 1) THEN 'redundancy_gt_1' END AS reject_reason FROM c GROUP BY 1")
def redundancy_pass(spark, d):
    return windows.redundancy_pass(windows.redundancy(turn_words(spark, d), "conv_id", "turn", "fragments"), "conv_id")


@query(f"WITH q AS (SELECT conv_id, turn, {WORDS.format('text')} AS w FROM conversations WHERE role = 'assistant') SELECT a.conv_id, a.turn, round(coalesce(max(CASE WHEN b.turn < a.turn THEN {JACCARD.format('a.w', 'b.w')} END), 0), 9) AS max_prior_jaccard FROM q a JOIN q b USING (conv_id) GROUP BY 1, 2")
def max_prior_jaccard(spark, d):
    q = t(spark, d, "conversations").filter("role = 'assistant'")
    return rounded(windows.max_prior_jaccard(q, "conv_id", "turn", "text").select("conv_id", "turn", "max_prior_jaccard"), 9)


_GUARD = """g AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS duplicate_query,
  row_number() OVER (PARTITION BY user_id, event_type, floor(value / 25) ORDER BY ts, event_id) > 1 AS duplicate_observation FROM events),
i AS (SELECT *, sum(CASE WHEN duplicate_observation THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g),
s AS (SELECT *, sum(duplicate_observation::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS stagnant_steps FROM i)"""


@query(f"WITH {_GUARD} SELECT user_id, event_id, duplicate_query, duplicate_observation, NOT duplicate_observation AS evidence_gain, stagnant_steps, stagnant_steps >= 3 AS terminate_suggested FROM s")
def guard_diagnostics(spark, d):
    e = t(spark, d, "events").withColumn("seen", F.concat("event_type", F.lit(":"), F.floor(F.col("value") / 25).cast("string")))
    return windows.guard(e, ["user_id"], ["ts", "event_id"], "event_type", "seen").select("user_id", "event_id", "duplicate_query", "duplicate_observation", "evidence_gain", "stagnant_steps", "terminate_suggested")


def _asof(spark, d, f, out):
    e, k = t(spark, d, "events"), F.col("event_type")
    return f(e, ["user_id"], ["ts", "event_id"], k == "click", k == "view", F.col("event_id"), out).select("user_id", "event_id", out)


@query("SELECT user_id, event_id, (SELECT v.event_id FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND (v.ts, v.event_id) < (e.ts, e.event_id) ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS last_view FROM events e WHERE event_type = 'click'")
def asof_backward(spark, d):
    return _asof(spark, d, joins.asof_backward, "last_view")


@query("SELECT user_id, event_id, (SELECT v.event_id FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND (v.ts, v.event_id) > (e.ts, e.event_id) ORDER BY v.ts, v.event_id LIMIT 1) AS next_view FROM events e WHERE event_type = 'click'")
def asof_forward(spark, d):
    return _asof(spark, d, joins.asof_forward, "next_view")


@query("SELECT user_id, " + ", ".join(f"arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("view", "click", "purchase")) + " FROM events GROUP BY 1")
def latest_state(spark, d):
    return joins.latest_by_type(t(spark, d, "events"), ["user_id"], F.struct("ts", "event_id"), "event_type", ["view", "click", "purchase"], F.col("event_id"))


@query("""WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN i = 1 OR 3 * i <= n THEN 'early' WHEN 3 * i >= 2 * n THEN 'late' ELSE 'middle' END AS action_position, CASE WHEN n = 1 THEN 'single' WHEN i = 1 THEN 'first' WHEN i = n THEN 'last' ELSE 'middle' END AS query_position, CASE WHEN n = 1 THEN 'single' WHEN n IN (2, 3) THEN n::VARCHAR ELSE '>3' END AS action_query_count FROM a""")
def action_positions(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id")
    a = t(spark, d, "conversations").filter("role = 'assistant'").withColumn("i", F.row_number().over(w.orderBy("turn"))).withColumn("n", F.count("*").over(w))
    return a.select("conv_id", "turn", windows.action_position("i", "n").alias("action_position"), windows.query_position(F.col("i") - 1, "n").alias("query_position"), windows.count_class("n").alias("action_query_count"))


@query("SELECT a.conv_id, a.turn, count(b.turn) AS n_before, coalesce(string_agg(b.role, ',' ORDER BY b.turn), '') AS roles_before FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY 1, 2")
def history_prefix(spark, d):
    h = windows.history(t(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role"))
    return h.select("conv_id", "turn", F.size("history").cast("bigint").alias("n_before"), F.array_join("history", ",").alias("roles_before"))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(f"""WITH b AS (SELECT item_id, array_to_string({NORM.format('text')}, ' ') AS n FROM benchmark), o AS (SELECT doc_id, text, array_to_string({NORM.format('text')}, ' ') AS n FROM documents)
SELECT doc_id FROM o WHERE doc_id NOT IN (SELECT item_id FROM b) AND n NOT IN (SELECT n FROM b)""")
def isolation(spark, d):
    held = t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return joins.exclude(t(spark, d, "documents").select("doc_id", "text"), held, "doc_id", "text").select("doc_id")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination(spark, d):
    """Documents with a whole benchmark passage.  Its inner words find it, and the text confirms it.

    A passage may begin and end inside a word, but the words between are whole
    in any document that contains it: up to 8 of them are its key.  Documents
    give the keys of the lengths that occur, one equi-join finds the pairs, and
    only then texts are fetched by id.
    """
    most = 8
    words = lambda c: F.filter(F.split(c, r"[ \n]"), lambda w: w != "")
    gram = lambda ws, i, k: F.xxhash64(F.array_join(F.slice(ws, i, k), " "))
    items = t(spark, d, "benchmark").select("item_id", F.col("text").alias("item"), words("text").alias("w")).withColumn("k", F.least(F.size("w") - 2, F.lit(most)))
    keyed = items.filter("k > 0").select("item_id", "k", gram(F.col("w"), F.lit(2), F.col("k")).alias("key"))
    lengths = sorted(r["k"] for r in keyed.select("k").distinct().collect())  # at most ``most`` numbers
    docs, passages = t(spark, d, "documents").select("doc_id", "text"), items.select("item_id", "item")
    found = [docs.limit(0).crossJoin(passages.select("item_id").limit(0)).select("doc_id", "item_id")] if not lengths else []
    for k in lengths:
        places = F.sequence(F.lit(1), F.size("w") - k + 1)
        keys = docs.select("doc_id", words("text").alias("w")).filter(F.size("w") >= k).select("doc_id", F.explode(F.array_distinct(F.transform(places, lambda i: gram(F.col("w"), i, F.lit(k))))).alias("key"))  # noqa: B023
        found.append(keys.join(keyed.filter(F.col("k") == k).select("item_id", "key"), "key").select("doc_id", "item_id"))
    pairs = reduce(DataFrame.unionByName, found).distinct()
    hits = pairs.join(docs, "doc_id").join(passages, "item_id").filter(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    tiny = items.filter("k <= 0")
    if not tiny.isEmpty():  # passages of one or two words have no inner word
        hits = hits.unionByName(docs.join(tiny, F.contains("text", F.col("item"))).select("doc_id", "item_id"))
    return hits.distinct()


@query("SELECT p.x AS key, coalesce(r.v, l.v) AS v FROM (SELECT DISTINCT doc_id AS x FROM documents UNION SELECT DISTINCT doc_id FROM labels) p LEFT JOIN (SELECT doc_id, n_chars AS v FROM documents) l ON l.doc_id = p.x LEFT JOIN (SELECT doc_id, quality::BIGINT AS v FROM labels) r ON r.doc_id = p.x")
def keyed_merge(spark, d):
    left = t(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("v"))
    right = t(spark, d, "labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("bigint").alias("v"))
    return joins.keyed_merge(left, right, "key")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
o AS (SELECT doc_id, i, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS s, length(line) AS n FROM p)
SELECT doc_id, count(*) FILTER (WHERE s < 300 AND s + n > 100) AS overlapping, count(*) FILTER (WHERE s >= 100 AND s + n <= 300 AND n > 0) AS contained FROM o GROUP BY 1""")
def interval_overlap(spark, d):
    """Lines of each document as offsets against one span, by array functions alone."""
    sizes = F.transform(F.split("text", "\n", -1), lambda x: F.length(x))
    offsets = F.aggregate(sizes, F.array().cast("array<struct<start:int,end:int>>"), lambda acc, n: X.let(F.coalesce(F.try_element_at(acc, F.lit(-1))["end"] + 1, F.lit(0)), lambda s: F.concat(acc, F.array(F.struct(s.alias("start"), (s + n).alias("end"))))))
    spans = F.array(F.struct(F.lit(100).alias("start"), F.lit(300).alias("end"), F.lit("BODY").alias("kind")))
    docs = t(spark, d, "documents").select("doc_id", offsets.alias("o"))
    count = lambda a, v: F.size(F.filter(a, lambda x: x == v)).cast("bigint")
    return docs.select("doc_id", count(A.overlap_mask("o", spans), True).alias("overlapping"), count(A.containing_kind("o", spans), "BODY").alias("contained"))


@query("SELECT doc_id, sha256('7:' || doc_id::VARCHAR) AS key FROM documents ORDER BY 2 LIMIT 100")
def seeded_order(spark, d):
    return t(spark, d, "documents").select("doc_id", selection.seeded_key(7, "doc_id").alias("key")).orderBy("key").limit(100)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def top_by_length(spark, d):
    return selection.largest(t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 10, "doc_id")


@query("SELECT doc_id, n_chars, abs(n_chars - 4096)::DOUBLE AS distance FROM documents ORDER BY 3, 1 LIMIT 10")
def nearest_to_target(spark, d):
    return selection.nearest(t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 4096.0, 10, "doc_id")


@query("""WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS k, count(*) OVER () AS n FROM documents), o AS (SELECT doc_id, n_chars FROM documents WHERE n_chars > 4096 ORDER BY n_chars, doc_id LIMIT 1)
SELECT doc_id, n_chars, 'shortest' AS which FROM r WHERE k = 1 UNION ALL SELECT doc_id, n_chars, 'median' FROM r WHERE k = n // 2 + 1 UNION ALL SELECT doc_id, n_chars, 'over' FROM o""")
def short_median_over(spark, d):
    return selection.short_median_over(t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 4096)


def vector_topk(spark, d):
    e = t(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(vectors.topk(q, e, 5))


_TOPK = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_inner_product(q, embedding::DOUBLE[]) AS score FROM q, embeddings),
k AS (SELECT query_id, vec_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s QUALIFY rank <= 5)"""
query(f"WITH {_TOPK} SELECT * FROM k")(vector_topk)


@query(f"WITH {_TOPK} SELECT k.query_id, round(avg((e.label = f.label)::INT), 6) AS accuracy FROM k JOIN embeddings e ON e.vec_id = k.vec_id JOIN embeddings f ON f.vec_id = k.query_id WHERE k.vec_id <> k.query_id GROUP BY 1")
def vector_topk_label_accuracy(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "label")
    hits = vector_topk(spark, d).filter("vec_id <> query_id").join(e, "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return rounded(hits.groupBy("query_id").agg(F.avg((F.col("label") == F.col("own")).cast("int")).alias("accuracy")))


def stage_rows(spark, d):
    """Labelled documents as stage rows: the source's number deals them to stages."""
    docs = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    n = F.size(F.split("text", "\n", -1)).cast("bigint")
    return docs.select(
        F.element_at(F.array(*map(F.lit, stages.STAGES)), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")).alias("stage"), F.floor(F.col("doc_id") / 4).cast("string").alias("question_id"), F.col("quality").cast("double").alias("answer_em"),
        F.col("quality").cast("double").alias("answer_f1"), (F.col("quality") == 1).alias("task_success"), n.alias("search_action_count"), n.alias("search_query_count"), (n - F.col("toxic")).alias("valid_query_count"), F.col("toxic").cast("bigint").alias("repeated_query_count"),
        F.lit(1).cast("bigint").alias("retrieval_success_count"), F.array("quality", "toxic").alias("process_scores"), (F.col("quality") + 0.25 * F.col("toxic")).alias("trajectory_reward"), F.col("lang").alias("termination_reason"),
    )


_STAGE = "s AS (SELECT ['Base', 'SFT', 'DPO', 'GRPO'][(d.doc_id % 4 + 1)::INT] AS stage, (d.doc_id // 4)::VARCHAR AS question_id, quality, toxic, len(string_split(text, chr(10))) AS n, lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


@query(f"""WITH {_STAGE} SELECT stage, count(*) AS examples, round(avg(quality), 6) AS answer_em, round(avg(quality), 6) AS answer_f1, round(avg(quality), 6) AS task_success_rate, round(avg(n), 6) AS average_search_actions, round(sum(n - toxic) / sum(n), 6) AS valid_query_ratio,
round(sum(toxic) / sum(n), 6) AS repeated_query_ratio, round(count(*) / sum(n), 6) AS retrieval_success_rate, round(sum(quality + toxic) / (2 * count(*)), 6) AS mean_process_reward, round(avg(quality + 0.25 * toxic), 6) AS mean_trajectory_reward, sha256(string_agg(question_id, chr(10) ORDER BY question_id COLLATE "C")) AS question_ids_sha256 FROM s GROUP BY 1""")
def stage_aggregate(spark, d):
    return rounded(stages.aggregate(stages.validate(stage_rows(spark, d))))


@query(f"WITH {_STAGE} SELECT stage, lang AS termination_reason, count(*) AS n FROM s GROUP BY 1, 2")
def stage_terminations(spark, d):
    return stages.terminations(stage_rows(spark, d))


@query("SELECT d.doc_id, (quality + 0.25 * (quality + toxic) / 2)::DOUBLE AS reward, round(CASE WHEN quality = 1 THEN greatest(1 - 0.1 * toxic, 0.7) ELSE least(0.1 * toxic, 0.3) END + 0.1 * (lang = 'en')::INT, 9)::DOUBLE AS ablation FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def process_reward(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return x.select("doc_id", A.mini_reward(F.col("quality") == 1, F.array("quality", "toxic"), F.lit(0.25)).alias("reward"), F.round(A.ablation_reward(F.col("quality") == 1, "toxic", "toxic", F.col("lang") == "en"), 9).alias("ablation"))


@query("WITH x AS (SELECT d.doc_id, source, (quality + 0.25 * toxic)::DOUBLE AS r FROM documents d JOIN labels l ON l.doc_id = d.doc_id), g AS (SELECT source, avg(r) AS m, stddev_pop(r) AS s FROM x GROUP BY 1 HAVING count(*) >= 2) SELECT doc_id, source, round((r - m) / (s + 1e-4), 6) AS advantage FROM x JOIN g USING (source)")
def group_advantage(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("doc_id", "source", (F.col("quality") + 0.25 * F.col("toxic")).alias("r"))
    big = x.groupBy("source").count().filter("count >= 2").select("source")
    return rounded(windows.group_advantage(x.join(big, "source", "left_semi"), "source", "r").select("doc_id", "source", "advantage"))


@query("WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS e FROM embeddings) SELECT vec_id, round(0.1 * ((a - b) - (c - e)), 9) AS logit, round(greatest(-(0.1 * ((a - b) - (c - e))), 0) + ln(1 + exp(-abs(0.1 * ((a - b) - (c - e))))), 9) AS loss, round(exp(c - a) - (c - a) - 1, 9) AS kl FROM x")
def preference_losses(spark, d):
    x = t(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("abce")))
    logit = A.preference_logit("a", "b", "c", "e", F.lit(0.1))
    return rounded(x.select("vec_id", logit.alias("logit"), A.softplus_loss(logit).alias("loss"), A.kl_k3("c", "a").alias("kl")), 9)


@query(r"SELECT doc_id, '1. ' || split_part(text, chr(10), 1) || chr(10) || trim(replace(left(CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END, 400), chr(10), ' ')) AS line FROM documents")
def passage_render(spark, d):
    return t(spark, d, "documents").select("doc_id", X.ranked_passage(F.lit(1), "text").alias("line"))


@query("SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k, count(*) FILTER (WHERE json_valid(props)) AS valid FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return t(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count_if(F.try_parse_json("props").isNotNull()).alias("valid"))


@query("SELECT count(*) AS rows, sum(least(n_chars, 4096))::BIGINT AS tokens, count(*) FILTER (WHERE n_chars > 4096) AS truncated, round(count(*) FILTER (WHERE n_chars > 4096) / count(*), 6) AS truncation_rate FROM documents")
def token_audit(spark, d):
    from ..sources.files import token_audit as audit

    return rounded(audit(t(spark, d, "documents"), "n_chars", 4096))


@query("SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counts(spark, d):
    return t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def nation_totals(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), f AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS chars FROM u GROUP BY 1)
SELECT count(*) AS trajectories, count(*) FILTER (WHERE n >= 2) AS outcome, count(*) FILTER (WHERE n >= 2 AND chars <= 4000) AS length_pass, count(*) FILTER (WHERE n >= 2) - count(*) FILTER (WHERE n >= 2 AND chars <= 4000) AS length_rejected FROM f""")
def funnel(spark, d):
    f = t(spark, d, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    ok, short = F.col("n") >= 2, F.col("chars") <= 4000
    return f.agg(F.count("*").alias("trajectories"), F.count_if(ok).alias("outcome"), F.count_if(ok & short).alias("length_pass"), (F.count_if(ok) - F.count_if(ok & short)).alias("length_rejected"))


TOPICS = ("origin", "year", "place")


def synthetic_events(spark, d):
    """An event log and its results, built from conversations by rule: each assistant turn searches its first words, and the next user turn is what comes back."""
    from pyspark.sql import Window as W

    c = t(spark, d, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    turns = c.withColumn("next", F.lead("text").over(w)).filter("role = 'assistant' AND next IS NOT NULL")
    turns = turns.withColumn("round", F.row_number().over(w).cast("bigint"))
    ask = F.array_join(F.slice(F.split("text", r"[ \n]+"), 1, 4), " ")
    queries = F.array(ask, F.concat(ask, F.lit(" "), F.element_at(F.array(*map(F.lit, TOPICS)), (F.pmod("turn", F.lit(3)) + 1).cast("int"))))
    body = lambda q: F.concat(F.lit("Search results for: "), q, F.lit("\n1. "), F.col("next"))
    shown = F.array_join(F.transform("queries", body), "\n\n")
    turns = turns.withColumn("queries", queries).withColumn("observation", F.replace(shown, F.lit("\n\n\n"), F.lit("\n")))
    call = F.to_json(F.struct(F.lit("search").alias("name"), F.struct(F.col("queries").alias("query")).alias("arguments")))
    event = lambda k, kind, payload: F.struct((F.col("round") * 10 + k).alias("seq"), F.lit(kind).alias("event_type"), F.to_json(payload).alias("payload"))
    r = F.col("round").alias("round_idx")
    messages = F.array(F.struct(F.lit("assistant").alias("role"), call.alias("content")), F.struct(F.lit("user").alias("role"), F.col("observation").alias("content")))
    log = F.array(
        event(0, "round_request", F.struct(r)),
        event(1, "round_response", F.struct(r, F.lit("look it up").alias("reasoning_content"), F.concat(F.lit("<tool_call>"), call, F.lit("</tool_call>")).alias("content"))),
        event(2, "tool_extracted", F.struct(r, call.alias("extractor_result"))),
        event(3, "tool_json_parse", F.struct(r, F.lit(True).alias("json_parse_success"), F.lit("search").alias("parsed_tool_name"), F.struct(F.col("queries").alias("query")).alias("parsed_tool_args"))),
        event(4, "search_start", F.struct(r, "queries")),
        event(5, "search_finish", F.struct(r, F.col("observation").alias("result_snapshot"), F.lit(True).alias("success"))),
        event(6, "tool_response_appended", F.struct(r, F.col("observation").alias("tool_response"), messages.alias("messages_snapshot"))),
    )
    each = turns.select(F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("trajectory_id"), F.explode(log).alias("e")).select("trajectory_id", "e.*")
    ids = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question")).withColumn("trajectory_id", F.concat(F.lit("t"), F.col("conv_id").cast("string")))
    start = ids.select("trajectory_id", F.lit(0).cast("bigint").alias("seq"), F.lit("trajectory_start").alias("event_type"), F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))).alias("messages_snapshot"))).alias("payload"))
    finish = ids.select("trajectory_id", F.lit(10_000_000).cast("bigint").alias("seq"), F.lit("trajectory_finish").alias("event_type"), F.to_json(F.struct(F.col("question").alias("answer"))).alias("payload"))
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    res = ids.join(counts, "conv_id", "left").select("trajectory_id", F.col("conv_id").cast("string").alias("question_id"), "question", F.array("question").alias("golden_answers"), F.lit("").alias("prediction"), F.coalesce("n", F.lit(0)).alias("search_actions"), (2 * F.coalesce("n", F.lit(0))).alias("search_queries"), F.coalesce("n", F.lit(0)).alias("rounds"))
    return each.unionByName(start).unionByName(finish), res


def candidates(spark, d):
    return trajectories.reject_reasons(trajectories.reconstruct(*synthetic_events(spark, d)))


_TURNS = "x AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), a AS (SELECT conv_id, turn FROM x WHERE role = 'assistant' AND nxt IS NOT NULL)"


@query(f"WITH {_TURNS} SELECT 't' || c.conv_id AS trajectory_id, count(a.turn) AS n_steps, 2 * count(a.turn) AS n_queries, true AS structural_valid, '' AS reasons FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a USING (conv_id) GROUP BY 1")
def reconstruct(spark, d):
    c = candidates(spark, d)
    n = F.aggregate("steps", F.lit(0).cast("bigint"), lambda s, x: s + F.size(x["queries"]))
    return c.select("trajectory_id", F.size("steps").cast("bigint").alias("n_steps"), n.alias("n_queries"), "structural_valid", F.array_join("reject_reason", ",").alias("reasons"))


@query(f"WITH {_TURNS} SELECT 't' || c.conv_id AS trajectory_id, count(a.turn) AS rounds, count(a.turn) AS search_actions, 1::BIGINT AS finishes, count(a.turn) AS round_requests, count(a.turn) AS search_starts, count(a.turn) AS search_finishes, count(a.turn) AS observations, true AS ok FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a USING (conv_id) GROUP BY 1")
def trajectory_integrity(spark, d):
    return trajectories.event_integrity(*synthetic_events(spark, d))


@query()
def step_redundancy(spark, d):
    return trajectories.step_redundancy(candidates(spark, d))[1]


_CHAT = r"""x AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), f AS (SELECT conv_id, arg_min(text, turn) AS question FROM conversations GROUP BY 1),
a AS (SELECT conv_id, turn, nxt, array_to_string(list_slice(string_split_regex(text, '[ \n]+'), 1, 4), ' ') AS q FROM x WHERE role = 'assistant' AND nxt IS NOT NULL),
b AS (SELECT conv_id, turn, nxt, q, q || ' ' || (['origin', 'year', 'place'])[turn % 3 + 1] AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM a),
s AS (SELECT conv_id, k, '<think>' || chr(10) || 'look it up' || chr(10) || '</think>' || chr(10) || '<tool_call>' || chr(10) || '{"arguments":{"query":' || to_json([q, r]) || '},"name":"search"}' || chr(10) || '</tool_call>' AS said,
  '<tool_response>' || chr(10) || replace('Search results for: ' || q || chr(10) || '1. ' || nxt || chr(10) || chr(10) || 'Search results for: ' || r || chr(10) || '1. ' || nxt, chr(10) || chr(10) || chr(10), chr(10)) || chr(10) || '</tool_response>' AS found FROM b),
g AS (SELECT conv_id, count(*) AS n, flatten(list([{'role': 'assistant', 'content': said}, {'role': 'user', 'content': found}] ORDER BY k)) AS turns, string_agg(said || chr(10) || found, chr(10) ORDER BY k) FILTER (WHERE k <= 2) AS prefix FROM s GROUP BY 1)"""


@query(f"""WITH {_CHAT} SELECT 't' || conv_id AS trajectory_id, (2 + 2 * coalesce(n, 0))::INT AS n_messages, coalesce(length(prefix), 0)::INT AS prefix_chars,
sha256(to_json([{{'role': 'user', 'content': question}}] || coalesce(turns, []) || [{{'role': 'assistant', 'content': '<think>' || chr(10) || CASE WHEN n > 0 THEN 'look it up' ELSE '' END || chr(10) || '</think>' || chr(10) || '<answer>' || question || '</answer>'}}])) AS messages_sha256 FROM f LEFT JOIN g USING (conv_id)""")
def training_messages(spark, d):
    c = candidates(spark, d).filter("structural_valid")
    return c.select("trajectory_id", F.size(trajectories.messages()).alias("n_messages"), F.sha2(F.to_json(trajectories.messages()), 256).alias("messages_sha256"), F.length(trajectories.prefix_text(2)).alias("prefix_chars"))


def pilot_units(spark, d):
    return units.query_units(candidates(spark, d))[0]


@query(f"WITH {_TURNS} SELECT 't' || conv_id AS trajectory_id, count(*) * 2 AS n_units FROM a GROUP BY 1")
def query_units(spark, d):
    return pilot_units(spark, d).groupBy("trajectory_id").agg(F.count("*").alias("n_units"))


@query()
def unit_strata(spark, d):
    return pilot_units(spark, d).drop("_siblings", "_future_steps", "golden_answers", "history")


@query(f"""WITH {_CHAT}, u AS (SELECT conv_id, k, contains('look it up', lower(r)) AS first, q <> '' AND contains('look it up', lower(q)) AS second FROM b), v AS (SELECT conv_id, k, first AS leaks FROM u UNION ALL SELECT conv_id, k, second FROM u)
SELECT count(*) AS units, count(*) AS unique_unit_ids, count(DISTINCT conv_id) AS unique_trajectories, count(DISTINCT (conv_id, k)) AS unique_actions, 0::BIGINT AS sibling_result_leakage, count(*) FILTER (WHERE leaks) AS sibling_query_literal_in_reasoning,
0::BIGINT AS current_result_boundary_mismatch, 0::BIGINT AS current_query_or_result_missing, 0::BIGINT AS future_observation_leakage, 0::BIGINT AS raw_textual_action_present, 0::BIGINT AS teacher_final_answer_field_present, coalesce(bool_and(NOT leaks), true) AS all_pass FROM v""")
def leakage_summary(spark, d):
    return units.audit_summary(units.leakage_audit(pilot_units(spark, d)))


@query()
def greedy_pilot(spark, d):
    return selection.greedy_pilot(pilot_units(spark, d), 20, 20260905)


def fake_judge(channel: str, prompts: list[str]) -> list[str]:
    """A judge without a model: a prompt of even length is good."""
    good = [len(p) % 2 == 0 for p in prompts]
    bad = {"intent": "irrelevant", "retrieval": "retrieval_miss"}[channel]
    return [f"<{channel}>{int(g)}</{channel}>\n<{channel}_failure_type>{'none' if g else bad}</{channel}_failure_type>\n<explanation>by length</explanation>" for g in good]


@query()
def judge_scores(spark, d):
    return units.judge(units.leakage_audit(pilot_units(spark, d)), fake_judge)


@query()
def parsers_whole(spark, d):
    """Whole texts of all turns through the parsers of tool calls, boxed answers, actions and answers."""
    wrap = lambda a, b: F.concat(F.lit(a), F.col("text"), F.lit(b))
    raw = F.when(F.col("role") == "assistant", wrap("<search> ", " </search>")).otherwise(wrap("<answer> ", " </answer>"))
    c = t(spark, d, "conversations").withColumn("a", protocol.action(raw))
    value = F.when(F.col("a.kind") == "search", F.col("a.query")).otherwise(F.col("a.answer"))
    return c.select("conv_id", "turn", protocol.tool_call(wrap("<tool_call>", "")).alias("call"), X.boxed_answer(wrap("so \\boxed{", "} ends")).alias("boxed"), F.col("a.kind").alias("kind"), value.alias("value"), X.clean_answer(wrap('  The answer is "', '" ')).alias("answer"))


@query("SELECT g AS generation_idx, 0::BIGINT AS failures FROM (SELECT DISTINCT turn AS g FROM conversations WHERE turn > 0)")
def replay_audit(spark, d):
    """Turns as generations whose state is all that was said before: no transition may fail."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    said = t(spark, d, "conversations").withColumn("generated_ids", F.array(F.length("text")))
    said = said.withColumn("input_ids", F.flatten(F.collect_list("generated_ids").over(w.rowsBetween(W.unboundedPreceding, -1))))
    failed = windows.replay_audit(said, "conv_id", "turn").groupBy("turn").agg(F.count("*").alias("failures"))
    return said.filter("turn > 0").select(F.col("turn").alias("generation_idx")).distinct().join(failed.withColumnRenamed("turn", "generation_idx"), "generation_idx", "left").fillna(0, ["failures"])


@query("SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    e = streams.timed(fixture_stream(spark, d))
    return drained(streams.daily_counts(e).select("event_type", "day", "n"), "complete")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, min(ts) AS session_start, count(*) AS n_events FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    e = streams.timed(fixture_stream(spark, d))
    return drained(streams.sessions(e, "user_id"), "complete").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query(f"WITH {_GUARD} SELECT user_id::VARCHAR AS key, event_id AS seq, duplicate_query, duplicate_observation, stagnant_steps, stagnant_steps >= 3 AS terminate_suggested FROM s")
def stream_guard(spark, d):
    e = streams.timed(fixture_stream(spark, d))
    steps = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("query"), F.concat("event_type", F.lit(":"), F.floor(F.col("value") / 25).cast("string")).alias("observation"), "ts")
    return drained(streams.guard(steps), "append")


def fixture_stream(spark, d):
    schema = t(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def drained(stream, mode):
    """The rows of a stream after it has read all that is there."""
    return streams.drain(stream, fresh_path(stream.sparkSession, "drained"), mode)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of repeated words a turn over the conversations that pass the redundancy rule or not."""
    counted = windows.redundancy(turn_words(spark, d), "conv_id", "turn", "fragments")
    verdict = windows.redundancy_pass(counted, "conv_id")
    return profiles.distribution(counted.join(verdict, "conv_id"), "redundancy_count", "redundancy_pass")
