"""Query-level units: one row for each executed query with its result and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import process_score
from ..functions.protocol import judge_reply
from ..functions.text import contains_folded, coverage_bucket, ledger_key, sections, term_coverage, verification_intent
from .windows import action_position, count_class, max_prior_jaccard, query_position

NO_HISTORY = "(No previous Search action.)"


def history_text(steps: Column) -> Column:
    """Earlier actions with reasoning and observation, or a note that there are none."""
    one = lambda s: F.concat(F.lit("Previous action "), s["step_index"].cast("string"), F.lit(" reasoning:\n"), s["reasoning_before_action"], F.lit("\nPrevious executed action:\n"), s["executed_action"], F.lit("\nPrevious authoritative observation:\n"), s["observation"])
    return F.when(F.size(steps) == 0, NO_HISTORY).otherwise(F.array_join(F.transform(steps, one), "\n\n"))


def query_units(candidates: DataFrame, disagreements: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Units, and the steps whose observation does not have one section for each query.

    ``disagreements`` has ``question_id, action_index``.
    """
    step = candidates.select("trajectory_id", "question_id", "question", "golden_answers", F.size("steps").alias("n_actions"), F.col("steps").alias("__steps"), F.explode("steps").alias("s"))
    step = step.withColumns({"__sections": sections("s.observation", "s.queries"), "action_idx": F.col("s.step_index")})
    bad = step.filter("__sections IS NULL").select("trajectory_id", "action_idx", F.lit("query/result mismatch").alias("reason"))
    good = step.filter("__sections IS NOT NULL")
    each = good.select("*", F.posexplode("__sections").alias("query_idx", "z"))
    siblings = F.filter("s.queries", lambda q, i: i != F.col("query_idx"))
    reasoning = F.coalesce("s.reasoning_before_action", F.lit(""))
    count = F.size("s.queries")
    units = each.select(
        F.concat("trajectory_id", F.lit("::action_"), F.col("action_idx").cast("string"), F.lit("::query_"), F.col("query_idx").cast("string")).alias("unit_id"),
        "trajectory_id",
        "question_id",
        "question",
        "golden_answers",
        "action_idx",
        "query_idx",
        history_text(F.filter("__steps", lambda t: t["step_index"] < F.col("action_idx"))).alias("history"),
        reasoning.alias("current_action_reasoning"),
        F.col("z.query").alias("current_executed_query"),
        F.col("z.result_section").alias("current_query_result"),
        F.col("z.result_sha256").alias("current_query_result_sha256"),
        count.alias("source_action_query_count"),
        action_position("action_idx", "n_actions").alias("action_position"),
        query_position("query_idx", count).alias("query_position"),
        count_class(count).alias("action_query_count"),
        F.round(term_coverage("z.query", "z.result_section"), 6).alias("query_term_coverage"),
        coverage_bucket(term_coverage("z.query", "z.result_section")).alias("result_characteristic"),
        verification_intent(F.concat("z.query", F.lit("\n"), reasoning)).alias("verification_candidate"),
        F.exists(siblings, lambda q: (q != "") & contains_folded(reasoning, q)).alias("leaks"),
        F.transform(F.filter("__sections", lambda x: x["query_idx"] != F.col("query_idx")), lambda x: x["result_section"]).alias("_siblings"),
        (F.col("n_actions") - F.col("action_idx")).alias("_future_steps"),
    )
    units = max_prior_jaccard(units, "trajectory_id", "action_idx", "current_executed_query")
    prior = F.col("max_prior_query_jaccard")
    units = units.withColumnRenamed("max_prior_jaccard", "max_prior_query_jaccard").withColumns({"already_resolved_candidate": (F.col("action_idx") > 1) & (prior >= 0.70), "high_history_similarity": prior >= 0.55, "max_prior_query_jaccard": F.round(prior, 6)})
    if disagreements is None:
        return units.withColumn("action_level_disagreement_related", F.lit(False)), bad
    known = disagreements.select("question_id", F.col("action_index").cast("bigint").alias("action_idx"), F.lit(True).alias("action_level_disagreement_related")).distinct()
    return units.join(known, ["question_id", "action_idx"], "left").withColumn("action_level_disagreement_related", F.coalesce("action_level_disagreement_related", F.lit(False))), bad


RESULT_MARK = "CURRENT QUERY-SPECIFIC RESULT:\n"


def judge_prompt() -> Column:
    """Prompt of a unit: question, history, reasoning, query and its own result, which ends the text."""
    part = lambda title, c: F.concat(F.lit(f"{title}:\n"), c, F.lit("\n\n"))
    reasoning = F.coalesce(F.nullif("current_action_reasoning", F.lit("")), F.lit("(none recorded)"))
    return F.concat(part("QUESTION", F.col("question")), part("HISTORY BEFORE THIS ACTION", F.col("history")), part("CURRENT ACTION REASONING", reasoning), part("CURRENT EXECUTED QUERY", F.col("current_executed_query")), F.lit(RESULT_MARK), F.col("current_query_result"), F.lit("\n"))


FORBIDDEN = {"future_observation_leakage": ("future_steps", "future_observations"), "raw_textual_action_present": ("raw_textual_action",), "teacher_final_answer_field_present": ("teacher_final_answer", "final_answer", "prediction")}


def leakage_audit(units: DataFrame) -> DataFrame:
    """Units with their prompt, its hash, and the codes of what leaks into it."""
    tail = F.rtrim(F.substring_index("judge_prompt", RESULT_MARK, -1), F.lit("\n"))
    structural = [F.lit(code) for code, names in FORBIDDEN.items() if set(names) & set(units.columns)]
    found = F.array_compact(F.array(
        F.when(tail != F.rtrim("current_query_result", F.lit("\n")), "current_result_boundary_mismatch"),
        F.when(F.exists("_siblings", lambda s: F.contains(tail, s)), "sibling_result_leakage"),
        F.when(F.col("leaks"), "sibling_query_literal_in_reasoning"),
        F.when(~F.contains("judge_prompt", F.col("current_executed_query")) | ~F.contains("judge_prompt", F.col("current_query_result")), "current_query_or_result_missing"),
        *structural,
    ))
    audited = units.withColumn("judge_prompt", judge_prompt()).withColumn("violations", found)
    return audited.withColumns({"prompt_sha256": F.sha2("judge_prompt", 256), "pass": F.size("violations") == 0, "sibling_result_count_excluded": F.size("_siblings")})


def audit_summary(audited: DataFrame) -> DataFrame:
    has = lambda code: F.count_if(F.array_contains("violations", code)).alias(code)
    codes = ("sibling_result_leakage", "sibling_query_literal_in_reasoning", "current_result_boundary_mismatch", "current_query_or_result_missing", *FORBIDDEN)
    return audited.agg(F.count("*").alias("units"), F.count_distinct("unit_id").alias("unique_unit_ids"), F.count_distinct("trajectory_id").alias("unique_trajectories"), F.count_distinct("trajectory_id", "action_idx").alias("unique_actions"), *map(has, codes), F.coalesce(F.bool_and("pass"), F.lit(True)).alias("all_pass"))


def intent_prompt() -> Column:
    """What the intent channel sees of a unit: everything up to the search, and nothing of its result."""
    golden = F.to_json("golden_answers")
    reasoning = F.coalesce(F.nullif("current_action_reasoning", F.lit("")), F.lit("(none recorded)"))
    return F.concat(
        F.lit("Was the query a reasonable search for the question at this point? Nothing is known of what it found.\nReply with <intent>, <intent_failure_type> and <explanation>.\n\n"),
        *(F.concat(F.lit(f"{title}:\n"), c, F.lit("\n\n")) for title, c in (("QUESTION", F.col("question")), ("GOLDEN ANSWER", golden), ("HISTORY BEFORE THIS ACTION", F.col("history")), ("CURRENT ACTION REASONING", reasoning))),
        F.lit("CURRENT EXECUTED QUERY:\n"), F.col("current_executed_query"), F.lit("\n"),
    )


def retrieval_prompt() -> Column:
    """What the retrieval channel sees of a unit: the query and its own result alone."""
    return F.concat(
        F.lit("Does the result give what the query asks for? Nothing else is known.\nReply with <retrieval>, <retrieval_failure_type> and <explanation>.\n\n"),
        F.lit("CURRENT EXECUTED QUERY:\n"), F.col("current_executed_query"), F.lit("\n\n"), F.lit(RESULT_MARK), F.col("current_query_result"), F.lit("\n"),
    )


def channel_requests(units: DataFrame, version: str = "v3") -> DataFrame:
    """Two rows a unit: its keys, ``channel``, that channel's ``prompt`` and the ``cache_key`` of its reply."""
    each = F.array(F.struct(F.lit("intent").alias("channel"), intent_prompt().alias("prompt")), F.struct(F.lit("retrieval").alias("channel"), retrieval_prompt().alias("prompt")))
    asked = units.select("unit_id", "trajectory_id", "action_idx", "query_idx", F.explode(each).alias("r")).select("*", "r.*").drop("r")
    return asked.withColumn("cache_key", ledger_key(F.lit(version), "channel", "unit_id", F.sha2("prompt", 256)))


def judge_through(units: DataFrame, client, ledger_path: str, version: str = "v3", secret: str | None = None) -> DataFrame:
    """Scores of both channels of each unit, through a ledger in which every reply is written before it is used.

    ``client(requests)`` takes rows with ``channel`` and ``prompt`` and returns
    replies in order.  What the ledger holds is not asked again, neither by a
    later run nor by a repeated task (``sources.ledger``).
    """
    from ..sources import ledger

    requests = channel_requests(units, version)
    ledger.ask(requests.select("cache_key", "channel", "prompt"), ledger_path, client, secret=secret)
    replies = requests.join(ledger.entries(units.sparkSession, ledger_path), "cache_key", "left")
    return scored(replies)


def judge(units: DataFrame, client, cache: DataFrame | None = None, version: str = "v3") -> DataFrame:
    """Scores of both channels of each unit.

    ``client(channel, prompts)`` takes a list of prompts and returns replies;
    it is made on the executors and is the only thing that talks to a model.
    ``cache`` has ``cache_key, reply``; what it holds is not asked again.  New
    replies are not kept: ``judge_through`` writes them before it uses them.
    Returns ``unit_id, trajectory_id, action_idx, query_idx``, a struct for
    each channel and ``process_score`` (null where a reply cannot be read).
    """
    import pandas as pd

    asked = channel_requests(units, version)
    if cache is None:
        cache = units.sparkSession.createDataFrame([], "cache_key string, reply string")
    hits = asked.join(cache.select("cache_key", "reply"), "cache_key")
    misses = asked.join(cache.select("cache_key"), "cache_key", "left_anti")

    def ask(frames):
        for f in frames:
            out = []
            for channel in ("intent", "retrieval"):
                own = f[f["channel"] == channel]
                out.append(own.assign(reply=client(channel, own["prompt"].tolist()) if len(own) else []))
            yield pd.concat(out)

    return scored(hits.unionByName(misses.mapInPandas(ask, misses.selectExpr("*", "cast(null as string) reply").schema).select(*hits.columns)))


def scored(replies: DataFrame) -> DataFrame:
    """Structs of both channels and ``process_score`` of each unit, from one reply a unit and channel."""
    read = replies.withColumn("result", F.when(F.col("channel") == "intent", judge_reply("intent", "reply")).otherwise(judge_reply("retrieval", "reply")))
    keys = ["unit_id", "trajectory_id", "action_idx", "query_idx"]
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("result"))).alias(c)
    both = read.groupBy(*keys).agg(pick("intent"), pick("retrieval"))
    readable = F.col("intent.score").isNotNull() & F.col("retrieval.score").isNotNull()
    return both.withColumn("process_score", F.when(readable, process_score("intent.score", "retrieval.score")))
