"""Trajectories from event logs.

Events have ``trajectory_id, seq, event_type, payload`` (JSON text).  The open
search of a round is not kept as state: within a round, the events between two
appended responses form an island, its first search that has a parsed call and
a response opens it, and the response that ends it closes it.  Everything else
that happens in an island is an error with a code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.algebra import canonical_action, listed
from ..functions.protocol import parsed_tool_call
from ..functions.text import nfkc_lower, observation_fragments, reasoning_text, wrapper_form
from .windows import redundancy, redundancy_pass

MESSAGES = "array<struct<role:string,content:string>>"
#: Prefix of the codes of failed reconstruction; fixed value.
FAILED = "reconstruction_failed:"


def field(path: str) -> Column:
    return F.get_json_object("payload", f"$.{path}")


def flag(path: str) -> Column:
    return F.coalesce(F.lower(field(path)).isin("true", "1"), F.lit(False))


def searches(events: DataFrame) -> DataFrame:
    """Events of each round with what was last known of it, the island, and whether a search opens."""
    kind = F.col("event_type")
    e = events.select("trajectory_id", "seq", "event_type", "payload", F.coalesce(field("round_idx").try_cast("bigint"), F.lit(0)).alias("round_idx"))
    inside = W.partitionBy("trajectory_id", "round_idx").orderBy("seq")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    last = lambda when, value: F.last(F.when(when, value), ignorenulls=True).over(upto)
    e = e.withColumns({
        "response": last(kind == "round_response", F.struct(field("reasoning_content").alias("reasoning"), field("content").alias("content"))),
        "extracted": last(kind == "tool_extracted", F.coalesce(field("extractor_result"), F.lit(""))),
        "parsed": last((kind == "tool_json_parse") & flag("json_parse_success"), F.struct(field("parsed_tool_name").alias("name"), F.coalesce(field("parsed_tool_args"), F.lit("{}")).alias("arguments"))),
        "island": F.count(F.when(kind == "tool_response_appended", 1)).over(inside.rowsBetween(W.unboundedPreceding, -1)),
    })
    able = (kind == "search_start") & F.col("parsed").isNotNull() & F.col("response").isNotNull()
    island = W.partitionBy("trajectory_id", "round_idx", "island").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    opened = F.coalesce(F.bool_or(F.col("__able")).over(island), F.lit(False))
    return e.withColumn("__able", able).withColumn("open", opened).withColumn("opens", F.col("__able") & ~F.col("open")).drop("__able")


def steps(events: DataFrame) -> DataFrame:
    """One row for each executed search with its observation, numbered along the trajectory."""
    e = searches(events)
    kind = F.col("event_type")
    start = F.when(F.col("opens"), F.struct(F.col("seq").alias("start_seq"), "response", F.coalesce("extracted", F.lit("")).alias("raw_textual_action"), F.col("parsed.arguments").alias("arguments"), listed(field("queries")).alias("queries"), field("engines").alias("proposed_engine")))
    finish = F.when((kind == "search_finish") & F.col("open"), F.struct(F.col("seq").alias("finish_seq"), F.sha2(F.coalesce(field("result_snapshot"), F.lit("")), 256).alias("search_result_sha256")))
    close = F.when((kind == "tool_response_appended") & F.col("open"), F.struct(F.col("seq").alias("end_seq"), F.coalesce(field("tool_response"), F.lit("")).alias("observation"), F.from_json(field("messages_snapshot"), MESSAGES).alias("messages")))
    islands = e.groupBy("trajectory_id", "round_idx", "island").agg(F.max_by(start, F.when(start.isNotNull(), F.col("seq"))).alias("s"), F.max_by(finish, F.when(finish.isNotNull(), F.col("seq"))).alias("f"), F.max_by(close, F.when(close.isNotNull(), F.col("seq"))).alias("c"))
    return described(islands.filter("s IS NOT NULL AND c IS NOT NULL").select("trajectory_id", "round_idx", "s.*", "f.*", "c.*"))


def described(done: DataFrame) -> DataFrame:
    """Steps with their numbers, hashes and checks, from searches with their responses and observations."""
    reasoning, content = F.coalesce("response.reasoning", F.lit("")), F.coalesce("response.content", F.lit(""))
    last = lambda k: F.try_element_at("messages", F.lit(-k))
    together = (F.size("messages") >= 2) & (last(2)["role"] == "assistant") & (last(1)["role"] == "user") & F.contains(F.coalesce(last(1)["content"], F.lit("")), F.col("observation"))
    done = done.withColumns({"__r": parsed_tool_call(reasoning), "__c": parsed_tool_call(content)})
    w = W.partitionBy("trajectory_id").orderBy("end_seq")
    return done.select(
        "trajectory_id",
        F.row_number().over(w).cast("bigint").alias("step_index"),
        "round_idx",
        reasoning_text(reasoning, content).alias("reasoning_before_action"),
        "raw_textual_action",
        F.sha2(F.concat(reasoning, F.lit("\n"), content), 256).alias("raw_response_sha256"),
        wrapper_form(reasoning, content).alias("raw_wrapper_form"),
        "queries",
        canonical_action("queries").alias("executed_action"),
        F.col("arguments").alias("executed_action_original_arguments"),
        "proposed_engine",
        F.coalesce(F.col("__r") != F.col("__c"), F.lit(False)).alias("action_source_mismatch"),
        "observation",
        F.sha2("observation", 256).alias("observation_sha256"),
        "search_result_sha256",
        F.coalesce(together, F.lit(False)).alias("message_continuity_ok"),
        "start_seq",
        "finish_seq",
        "end_seq",
    )


def errors(events: DataFrame) -> DataFrame:
    """``trajectory_id, code``: distinct failures of reconstruction found in the log itself."""
    e = searches(events)
    kind = F.col("event_type")
    asked = listed(F.get_json_object("parsed.arguments", "$.query"))
    code = lambda name: F.concat(F.lit(f"{FAILED}{name}_round_"), F.col("round_idx").cast("string"))
    found = F.array_compact(F.array(
        F.when((kind == "search_start") & ~F.col("opens"), code("search_start")),
        F.when(F.col("opens") & (asked != listed(field("queries"))), code("query_execution_mismatch")),
        F.when((kind == "search_finish") & ~F.col("open"), F.lit(f"{FAILED}orphan_search_finish")),
        F.when((kind == "tool_response_appended") & ~F.col("open"), F.lit(f"{FAILED}orphan_observation")),
    ))
    inline = e.select("trajectory_id", F.explode(found).alias("code"))
    closes = F.bool_or(kind == "tool_response_appended")
    unfinished = e.groupBy("trajectory_id", "round_idx", "island").agg(F.bool_or("opens").alias("o"), closes.alias("c")).filter("o AND NOT c").select("trajectory_id", F.lit(f"{FAILED}unfinished_search_action").alias("code"))
    counts = events.groupBy("trajectory_id").agg(*(F.count_if(kind == k).alias(k) for k in ("trajectory_start", "trajectory_finish")))
    ends = counts.select("trajectory_id", F.explode(F.array_compact(F.array(*(F.when(F.col(k) != 1, f"{FAILED}{k}_count") for k in ("trajectory_start", "trajectory_finish"))))).alias("code"))
    return inline.unionByName(unfinished).unionByName(ends).distinct()


def reconstruct(events: DataFrame, results: DataFrame) -> DataFrame:
    """One candidate a result: steps in order, initial messages, final reasoning and answer, and failure codes.

    ``results`` has ``trajectory_id, question_id, question, golden_answers,
    search_actions, search_queries, prediction``.  A log without exactly one
    start and one finish has these codes alone and no candidate.
    """
    kind = F.col("event_type")
    ends = events.groupBy("trajectory_id").agg(
        F.from_json(F.max_by(F.when(kind == "trajectory_start", field("messages_snapshot")), F.when(kind == "trajectory_start", F.col("seq"))), MESSAGES).alias("initial_messages"),
        F.min_by(F.when(kind == "trajectory_finish", field("answer")), F.when(kind == "trajectory_finish", F.col("seq"))).alias("__answer"),
        F.max_by(F.struct(F.coalesce(field("reasoning_content"), F.lit("")).alias("r"), F.coalesce(field("content"), F.lit("")).alias("c")), F.when(kind == "round_response", F.col("seq"))).alias("__last"),
    )
    return assemble(results, steps(events), ends, errors(events))


def assemble(results: DataFrame, made: DataFrame, ends: DataFrame, codes: DataFrame) -> DataFrame:
    """Candidates of results from steps, what the log's ends say, and distinct codes of failures."""
    packed = made.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_index", *[c for c in made.columns if c not in ("trajectory_id", "step_index")]))).alias("steps"), F.count("*").alias("__n"), F.sum(F.size("queries")).alias("__q"))  # one trajectory's rounds
    codes = codes.groupBy("trajectory_id").agg(F.array_sort(F.collect_set("code")).alias("__codes"))
    r = results.join(ends, "trajectory_id", "left").join(packed, "trajectory_id", "left").join(codes, "trajectory_id", "left")
    none = F.array().cast("array<string>")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    all_codes = F.coalesce("__codes", F.when(F.col("initial_messages").isNull() & F.col("__last").isNull(), F.array(F.lit(f"{FAILED}trajectory_start_count"), F.lit(f"{FAILED}trajectory_finish_count"))), none)
    fatal = F.filter(all_codes, lambda c: c.rlike("trajectory_(start|finish)_count$"))
    more = F.array_compact(F.array(F.when(zero("__n") != zero("search_actions"), f"{FAILED}search_action_count"), F.when(zero("__q") != zero("search_queries"), f"{FAILED}search_query_count")))
    return r.select(
        *results.columns,
        F.coalesce("initial_messages", F.array().cast(MESSAGES)).alias("initial_messages"),
        F.coalesce("steps", F.array().cast(packed.schema["steps"].dataType)).alias("steps"),
        F.struct(F.coalesce(reasoning_text(F.col("__last.r"), F.col("__last.c")), F.lit("")).alias("reasoning"), F.coalesce(F.nullif("__answer", F.lit("")), "prediction", F.lit("")).alias("answer")).alias("final"),
        F.when(F.size(fatal) > 0, fatal).otherwise(F.array_sort(F.array_distinct(F.concat(all_codes, more)))).alias("reconstruction_errors"),
    )


def reject_reasons(candidates: DataFrame) -> DataFrame:
    """``candidates`` with sorted distinct ``reject_reason`` codes and ``structural_valid``."""
    some = lambda test: F.exists("steps", test)
    blank = F.trim(F.col("final.answer")) == ""
    empty = lambda s: (F.size(s["queries"]) == 0) | F.exists(s["queries"], lambda q: q.isNull() | (F.trim(q) == ""))
    found = F.array_compact(F.array(
        F.when(~F.exists("initial_messages", lambda m: m["role"] == "user"), "missing_user_question"),
        F.when(blank, "missing_answer"),
        F.when(blank & (F.size("steps") == 0), "missing_assistant_segment"),
        F.when(some(empty), "empty_query"),
        F.when(some(lambda s: s["observation"] == ""), "unpaired_action_observation"),
        F.when(some(lambda s: ~s["message_continuity_ok"]), "structural_invalid"),
    ))
    reasons = F.when(F.size("reconstruction_errors") > 0, F.col("reconstruction_errors")).otherwise(F.array_sort(F.array_distinct(found)))
    return candidates.withColumn("reject_reason", reasons).withColumn("structural_valid", F.size("reject_reason") == 0)


def search_turn(step: Column) -> Column:
    return F.concat(F.lit("<think>\n"), step["reasoning_before_action"], F.lit("\n</think>\n<tool_call>\n"), step["executed_action"], F.lit("\n</tool_call>"))


def response_turn(step: Column) -> Column:
    return F.concat(F.lit("<tool_response>\n"), step["observation"], F.lit("\n</tool_response>"))


def answer_turn(final: Column) -> Column:
    return F.concat(F.lit("<think>\n"), final["reasoning"], F.lit("\n</think>\n<answer>"), final["answer"], F.lit("</answer>"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(through_step: int | None = None) -> Column:
    """Chat messages of a candidate: all of it, or up to a step and without the answer."""
    own = F.col("steps") if through_step is None else F.slice("steps", 1, through_step)
    turns = F.flatten(F.transform(own, lambda s: F.array(message("assistant", search_turn(s)), message("user", response_turn(s)))))
    parts = [F.col("initial_messages"), turns]
    if through_step is None:
        parts.append(F.array(message("assistant", answer_turn(F.col("final")))))
    return F.concat(*parts)


def prefix_text(through_step: int) -> Column:
    return F.array_join(F.flatten(F.transform(F.slice("steps", 1, through_step), lambda s: F.array(search_turn(s), response_turn(s)))), "\n")


def step_redundancy(candidates: DataFrame, key: str = "trajectory_id") -> tuple[DataFrame, DataFrame]:
    """Repeated results of each step, and the verdict of each trajectory."""
    each = candidates.select(key, F.explode("steps").alias("s")).select(key, F.col("s.step_index").alias("step_index"), observation_fragments(nfkc_lower(F.col("s.observation"))).alias("fragments"))
    counted = redundancy(each, key, "step_index", "fragments")
    return counted, redundancy_pass(counted, key)


def event_integrity(events: DataFrame, results: DataFrame) -> DataFrame:
    """Counts of each trajectory's events against its result, and whether all agree."""
    kind = F.col("event_type")
    rounds = F.when(kind == "round_request", F.coalesce(field("round_idx"), F.lit("0")))
    counts = events.groupBy("trajectory_id").agg(
        F.count_if(kind == "trajectory_finish").alias("finishes"),
        F.count_distinct(rounds).alias("round_requests"),  # a retried request counts once
        F.count_if(kind == "search_start").alias("search_starts"),
        F.count_if(kind == "search_finish").alias("search_finishes"),
        F.count_if(kind == "tool_response_appended").alias("observations"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = results.select("trajectory_id", "rounds", "search_actions").join(counts, "trajectory_id", "left").fillna(0)
    ok = (F.col("finishes") == 1) & (F.col("round_requests") == zero("rounds")) & (F.col("search_starts") == zero("search_actions")) & (F.col("search_finishes") == F.col("search_starts")) & (F.col("observations") == F.col("search_starts"))
    return joined.withColumn("ok", ok)


def log_faults(lines: DataFrame, expected: Column, fields: tuple[str, ...] = ("trajectory_id",)) -> DataFrame:
    """Of each log file its lines, those that are no JSON objects, and those whose trajectory is not the file's.

    ``lines`` has ``path, line`` without blank lines; ``expected`` is the id that
    a line's path stands for.  A line without an id counts as another one's.
    """
    ok = F.ltrim("line").startswith("{") & F.try_parse_json("line").isNotNull()
    own = F.coalesce(*(F.get_json_object("line", f"$.{c}") for c in fields), F.lit(""))
    read = lines.select("path", expected.alias("expected"), F.coalesce(ok, F.lit(False)).alias("ok"), own.alias("own"))
    return read.groupBy("path", "expected").agg(F.count("*").alias("lines"), F.count_if(~F.col("ok")).alias("bad_lines"), F.count_if(F.col("ok") & (F.col("own") != F.col("expected"))).alias("wrong_ids"))
