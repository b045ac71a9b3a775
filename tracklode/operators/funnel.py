"""The candidate funnel as one plan, provenance by membership, and records for audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import listed
from ..functions.protocol import parsed_tool_call
from ..functions.text import reasoning_text, sections
from ..sources.shared import fresh_path
from .joins import latest_by_type
from .selection import largest, nearest, pick_samples
from .trajectories import field, flag, reconstruct, reject_reasons, step_redundancy
from .units import query_units

#: Stages in the order in which a candidate meets them; fixed values.
STAGES = ("outcome", "reconstruct", "structure", "redundancy", "length")
TERMINATIONS = {"answer": "normal_answer"}
#: Characters of a candidate's JSON in an audit; fixed value.
EXCERPT = 300


def termination_name(x: Column) -> Column:
    """A termination under the name that reports use."""
    out = x
    for old, new in TERMINATIONS.items():
        out = F.when(x == old, new).otherwise(out)
    return out


def outcome(least: float = 0.8) -> Column:
    """Whether a result passes on its own: an ordinary question answered well enough."""
    return F.coalesce((F.col("question_type") == "ordinary_qa") & (F.col("answer_f1") >= least), F.lit(False))


def outcome_disagreements(results: DataFrame, least: float = 0.8) -> DataFrame:
    """Results that pass but are not stored as passing; there should be none."""
    return results.filter(outcome(least) & ~F.coalesce("outcome_pass", F.lit(False)))


def provider_by_membership(rows: DataFrame, key: str, ledgers: list[tuple[str, DataFrame]], otherwise: str, out: str = "provider") -> DataFrame:
    """``rows`` with the provider whose ledger of keys holds the row's key; the first ledger wins."""
    found = F.lit(otherwise)
    for i, (name, ledger) in reversed(list(enumerate(ledgers))):
        mark = f"__in{i}"
        rows = rows.join(ledger.select(key).distinct().withColumn(mark, F.lit(True)), key, "left")
        found = F.when(F.col(mark), name).otherwise(found)
    return rows.withColumn(out, found).drop(*(f"__in{i}" for i in range(len(ledgers))))


def candidate_funnel(events: DataFrame, results: DataFrame, length: Column, longest: int = 16_384, least: float = 0.8) -> DataFrame:
    """Every result as a candidate with ``rejected_at`` (the first stage it fails, null if none) and ``reasons``.

    ``length`` is an expression over a candidate (``steps``, ``final``,
    ``initial_messages``).  Only logs of results that pass the first stage are
    reconstructed.
    """
    passing = results.filter(outcome(least))
    made = reject_reasons(reconstruct(events.join(passing.select("trajectory_id"), "trajectory_id", "left_semi"), passing))
    verdict = step_redundancy(made.filter("structural_valid"))[1].select("trajectory_id", "redundancy_pass")
    made = made.withColumn("canonical_length", length).join(verdict, "trajectory_id", "left")
    made = made.withColumn("redundancy_pass", F.coalesce("redundancy_pass", F.size("steps") == 0))
    failed = F.when(F.size("reconstruction_errors") > 0, "reconstruct").when(~F.col("structural_valid"), "structure").when(~F.col("redundancy_pass"), "redundancy").when(F.col("canonical_length") > longest, "length")
    made = made.withColumn("rejected_at", failed).withColumnRenamed("reject_reason", "reasons")
    others = results.filter(~outcome(least)).withColumn("rejected_at", F.lit("outcome"))
    return made.unionByName(others, allowMissingColumns=True)


def funnel_counts(candidates: DataFrame) -> DataFrame:
    """``stage, entered, rejected, passed`` of each stage, from one pass over the candidates."""
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("rejected_at"))
    at = F.coalesce(place, F.lit(len(STAGES) + 1))
    one = candidates.agg(*(F.count_if(at >= i).alias(f"e{i}") for i in range(1, len(STAGES) + 2)))
    row = lambda i: F.struct(F.lit(STAGES[i - 1]).alias("stage"), F.col(f"e{i}").alias("entered"), (F.col(f"e{i}") - F.col(f"e{i + 1}")).alias("rejected"), F.col(f"e{i + 1}").alias("passed"))
    return one.select(F.explode(F.array(*(row(i) for i in range(1, len(STAGES) + 1)))).alias("r")).select("r.*")


def funnel_units(candidates: DataFrame) -> DataFrame:
    """Query units of the candidates that pass all stages."""
    return query_units(candidates.filter("rejected_at IS NULL"))[0]


def audit_record(category: str) -> list[Column]:
    """A candidate's audit columns: checks over all steps, and hashes in place of texts."""
    every = lambda test: F.forall("steps", test)
    hashed = lambda f: F.transform("steps", lambda s: F.sha2(f(s), 256))
    return [
        F.lit(category).alias("category"),
        F.col("question_id"),
        F.size("steps").alias("step_count"),
        F.size(F.filter("steps", lambda s: s["action_source_mismatch"])).alias("mismatch_count"),
        every(lambda s: F.get_json_object(s["executed_action"], "$.name") == "search").alias("all_actions_are_search"),
        every(lambda s: F.size(s["queries"]) > 0).alias("all_queries_nonempty"),
        every(lambda s: s["observation"] != "").alias("all_observations_present"),
        every(lambda s: s["message_continuity_ok"]).alias("all_continuity_ok"),
        hashed(lambda s: s["executed_action"]).alias("action_hashes"),
        F.transform("steps", lambda s: s["observation_sha256"]).alias("observation_hashes"),
    ]


KINDS = ["round_response", "tool_extracted", "tool_json_parse", "search_start", "tool_response_appended"]


def mismatch_cases(events: DataFrame, results: DataFrame, limit: int | None = 20) -> DataFrame:
    """Rounds whose reasoning and content hold different tool calls, with what was executed; the first by ``position`` and round.

    ``results`` has ``trajectory_id, question_id, position, action_source_mismatch``;
    only those with a mismatch are looked at.  ``limit`` None gives all.
    """
    some = results.filter("action_source_mismatch > 0").select("trajectory_id", "question_id", F.col("position").cast("bigint").alias("position"))
    own = events.join(some.select("trajectory_id"), "trajectory_id", "left_semi")
    own = own.filter((F.col("event_type") != "tool_json_parse") | flag("json_parse_success"))
    own = own.withColumn("round_idx", F.coalesce(field("round_idx").try_cast("bigint"), F.lit(0)))
    last = latest_by_type(own, ["trajectory_id", "round_idx"], F.col("seq"), "event_type", KINDS, F.col("payload")).filter("round_response IS NOT NULL")
    of = lambda kind, path: F.get_json_object(kind, f"$.{path}")
    text = lambda kind, path: F.coalesce(of(kind, path), F.lit(""))
    last = last.withColumns({"reasoning": text("round_response", "reasoning_content"), "content": text("round_response", "content"), "observation": text("tool_response_appended", "tool_response")})
    last = last.withColumns({"__r": parsed_tool_call(F.col("reasoning")), "__c": parsed_tool_call(F.col("content"))}).filter("__r <> __c")
    asked = listed(F.get_json_object(of("tool_json_parse", "parsed_tool_args"), "$.query"))
    name = F.to_json(F.struct(of("tool_json_parse", "parsed_tool_name").alias("name")))
    call = F.concat(F.lit("<tool_call>"), F.regexp_replace(name, r"\}$", ""), F.when(name != "{}", ",").otherwise(""), F.lit('"arguments":'), F.coalesce(of("tool_json_parse", "parsed_tool_args"), F.lit("{}")), F.lit("}</tool_call>"))
    executed = F.when(F.col("tool_json_parse").isNotNull(), parsed_tool_call(call))  # canonical, as the candidates are
    hashed = lambda c, name: F.sha2(F.coalesce(c, F.lit("")), 256).alias(f"{name}_sha256")
    cases = last.withColumn("__e", executed).join(some, "trajectory_id").select(
        "question_id",
        F.col("position").alias("source_split_position"),
        "trajectory_id",
        "round_idx",
        hashed(F.col("reasoning"), "raw_reasoning"),
        hashed(F.col("content"), "raw_content"),
        F.left("__r", F.lit(EXCERPT)).alias("reasoning_candidate_excerpt"),
        F.left("__c", F.lit(EXCERPT)).alias("content_candidate_excerpt"),
        hashed(F.col("__r"), "reasoning_candidate"),
        hashed(F.col("__c"), "content_candidate"),
        hashed(of("tool_extracted", "extractor_result"), "extractor_result"),
        F.col("__e").alias("actual_executed_action"),
        hashed(F.col("__e"), "actual_executed_action"),
        F.length("observation").alias("observation_chars"),
        hashed(F.col("observation"), "observation"),
        F.coalesce(asked == listed(of("search_start", "queries")), F.lit(False)).alias("executed_query_matches_search_start"),
        F.coalesce(F.col("__e") == F.col("__r"), F.lit(False)).alias("executed_matches_reasoning_candidate"),
        F.coalesce(F.col("__e") == F.col("__c"), F.lit(False)).alias("executed_matches_content_candidate"),
    )
    return cases if limit is None else cases.orderBy("source_split_position", "round_idx", "trajectory_id").limit(limit)


def online_units(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units of running trajectories, and the searches that have no whole chain of events.

    Actions and queries come from ``search_start`` alone; its finish and its
    observation are the first ones of the same round after it, its reasoning is
    in the last response before it.  A chain without either, with a failed
    finish, or without one section a query is given by the second result.
    """
    from pyspark.sql import Window as W

    kind = F.col("event_type")
    e = events.filter(kind.isin("search_start", "search_finish", "tool_response_appended", "round_response")).withColumn("round_idx", field("round_idx"))
    after = W.partitionBy("trajectory_id", "round_idx").orderBy("seq").rowsBetween(1, W.unboundedFollowing)
    before = W.partitionBy("trajectory_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    then = lambda k, v: F.first(F.when(kind == k, v), ignorenulls=True).over(after)
    e = e.withColumns({
        "__ok": then("search_finish", flag("success")),
        "observation": then("tool_response_appended", F.coalesce(field("tool_response"), F.lit(""))),
        "__said": F.last(F.when(kind == "round_response", F.coalesce(field("content"), F.lit(""))), ignorenulls=True).over(before),
    }).filter(kind == "search_start")
    e = e.withColumn("queries", listed(field("queries"))).withColumn("action_idx", F.row_number().over(W.partitionBy("trajectory_id").orderBy("seq")).cast("bigint"))
    e = e.withColumn("__sections", F.when(F.col("__ok"), sections("observation", "queries")))
    whole = F.col("__sections").isNotNull()
    each = e.filter(whole).select("*", F.posexplode("__sections").alias("query_idx", "z"))
    text = lambda c: c.cast("string")
    units = each.select(
        F.concat("trajectory_id", F.lit("::action_"), text(F.col("action_idx")), F.lit("::query_"), text(F.col("query_idx"))).alias("unit_id"),
        "trajectory_id",
        "action_idx",
        "query_idx",
        F.when(F.contains("__said", F.lit("<think>")), reasoning_text(F.lit(""), F.col("__said"))).otherwise("").alias("current_action_reasoning"),
        F.col("z.query").alias("current_executed_query"),
        F.col("z.result_section").alias("current_query_result"),
        F.col("z.result_sha256").alias("current_query_result_sha256"),
        F.col("seq").alias("search_start_seq"),
    )
    return units, e.filter(~whole).select("trajectory_id", "action_idx", F.col("seq").alias("search_start_seq"))


def judge_run_summary(replies: DataFrame) -> DataFrame:
    """One row over ``status, attempt_count`` of judged units."""
    status = F.coalesce("status", F.lit("missing"))
    return replies.agg(F.count("*").alias("units"), F.count_if(status == "success").alias("success"), F.count_if(status != "success").alias("failed"), F.coalesce(F.sum("attempt_count"), F.lit(0)).alias("attempts"))


#: Categories of the alignment audit in the order in which its generator draws; fixed values.
AUDIT_SAMPLED = ("no_mismatch", "action_source_mismatch", "redundancy_rejected")
AUDIT_TARGET = 16_384


def audit_sample(candidates: DataFrame, seed: int, k: int = 10, target: int = AUDIT_TARGET) -> DataFrame:
    """``category`` and all columns of up to k candidates of each of five categories.

    Candidates have ``question_id, position, mismatch_count, canonical_length,
    structural_valid, redundancy_pass``.  Three categories are drawn by one
    seeded generator (candidates without and with mismatches by position,
    then those that the redundancy rule rejects by id); the longest and those
    nearest to a target length are taken in order, ties by position.  A
    candidate may stand in several categories.
    """
    spark, path = candidates.sparkSession, fresh_path(candidates.sparkSession, "audit")
    keys = ("question_id", "position", "mismatch_count", "canonical_length", "redundancy_pass")
    candidates.filter("structural_valid").select(*keys).write.parquet(path)  # so that logs are rebuilt twice, not for each category
    sound = spark.read.parquet(path)
    mismatch = F.when(F.col("mismatch_count") > 0, AUDIT_SAMPLED[1]).otherwise(AUDIT_SAMPLED[0])
    row = lambda category, a, b: [F.col("question_id"), F.lit(category).alias("category") if isinstance(category, str) else category.alias("category"), a.alias("__a"), b.alias("__b")]
    by_place = sound.select(*row(mismatch, F.col("position").cast("bigint"), F.lit("")))
    by_id = sound.filter(~F.col("redundancy_pass")).select(*row(AUDIT_SAMPLED[2], F.lit(0).cast("bigint"), F.col("question_id").cast("string")))
    drawn = pick_samples(by_place.unionByName(by_id), "category", [F.col("__a"), F.col("__b")], k, seed, list(AUDIT_SAMPLED)).select("question_id", "category")
    longest = largest(sound, "canonical_length", k, "position").select("question_id", F.lit("long_trajectory").alias("category"))
    near = nearest(sound, "canonical_length", target, k, "position").select("question_id", F.lit("near_16k").alias("category"))
    picked = drawn.unionByName(longest).unionByName(near)  # at most 5 k rows
    return candidates.join(F.broadcast(picked), "question_id")
