"""Trajectories from a running event log.

The batch operator's islands become keyed state: what was last said in each
round and the search that is open there.  A step is handed on when its
response is appended, an error when it happens, and what only the end can tell
(an unfinished search, missing start or finish, the final answer) when the
trajectory has been silent or its time budget is used up.  Everything is in
order of the log, however the stream was shuffled (``ordered``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import listed
from ..operators import trajectories
from ..operators.trajectories import FAILED, MESSAGES, field, flag
from .ordered import DAY_MS, Machine, milliseconds, ordered_rows, run


def body():
    """What the state machine reads of an event, so that no payload is parsed in Python."""
    args = F.coalesce(field("parsed_tool_args"), F.lit("{}"))
    kind = F.col("event_type")
    when = lambda k, c: F.when(kind == k, c)
    called = (kind == "tool_json_parse") & flag("json_parse_success")
    return F.struct(
        kind.alias("kind"),
        F.coalesce(field("round_idx").try_cast("bigint"), F.lit(0)).alias("round"),
        when("round_response", field("reasoning_content")).alias("reasoning"),
        when("round_response", field("content")).alias("content"),
        when("tool_extracted", F.coalesce(field("extractor_result"), F.lit(""))).alias("extracted"),
        F.when(called, args).alias("arguments"),
        F.when(called, listed(F.get_json_object(args, "$.query"))).alias("asked"),
        when("search_start", listed(field("queries"))).alias("queries"),
        when("search_start", field("engines")).alias("engines"),
        when("search_finish", F.sha2(F.coalesce(field("result_snapshot"), F.lit("")), 256)).alias("result"),
        when("tool_response_appended", F.coalesce(field("tool_response"), F.lit(""))).alias("observation"),
        F.when(kind.isin("tool_response_appended", "trajectory_start"), field("messages_snapshot")).alias("messages"),
        when("trajectory_finish", field("answer")).alias("answer"),
    )


class Reconstruction(Machine):
    """Rows of three kinds (``what``): ``step``, ``error`` with its code, and one ``end`` a trajectory."""

    output = """trajectory_id string, what string, code string, step_index bigint, round_idx bigint, start_seq bigint, finish_seq bigint, end_seq bigint, reasoning string, content string, raw_textual_action string,
        arguments string, queries array<string>, proposed_engine string, observation string, search_result_sha256 string, messages string, answer string, responded boolean"""

    def __init__(self, seconds: float | None = None):
        self.seconds = seconds

    def fresh(self) -> dict:
        return {"starts": 0, "finishes": 0, "steps": 0, "rounds": {}, "open": [], "initial": None, "answer": None, "last": None, "late": False}

    def error(self, key: str, code: str) -> dict:
        return {"trajectory_id": key, "what": "error", "code": f"{FAILED}{code}"}

    def take(self, key, memory, us, seq, body):
        memory.setdefault("first_ms", milliseconds(us))
        kind, name = body["kind"], str(body["round"])
        now = memory["rounds"].setdefault(name, {}) if kind not in ("trajectory_start", "trajectory_finish") else {}
        if kind == "trajectory_start":
            memory["starts"] += 1
            if body.get("messages") is not None:
                memory["initial"] = body["messages"]
        elif kind == "trajectory_finish":
            memory["finishes"] += 1
            memory["answer"] = body.get("answer") if memory["finishes"] == 1 else memory["answer"]
        elif kind == "round_response":
            now["response"] = memory["last"] = [body.get("reasoning"), body.get("content")]
        elif kind == "tool_extracted":
            now["extracted"] = body["extracted"]
        elif kind == "tool_json_parse" and "arguments" in body:
            now["call"] = [body["arguments"], body["asked"]]
        elif kind == "search_start":
            if "call" not in now or "response" not in now or now.get("search"):
                return [self.error(key, f"search_start_round_{name}")]
            (arguments, asked), (reasoning, content) = now["call"], now["response"]
            now["search"] = {"start_seq": seq, "reasoning": reasoning, "content": content, "raw_textual_action": now.get("extracted", ""), "arguments": arguments, "queries": body["queries"], "proposed_engine": body.get("engines")}
            if asked != body["queries"]:
                return [self.error(key, f"query_execution_mismatch_round_{name}")]
        elif kind == "search_finish":
            if not now.get("search"):
                return [self.error(key, "orphan_search_finish")]
            now["search"] |= {"finish_seq": seq, "search_result_sha256": body["result"]}
        elif kind == "tool_response_appended":
            if not now.get("search"):
                return [self.error(key, "orphan_observation")]
            memory["steps"] += 1
            step = now.pop("search")
            return [step | {"trajectory_id": key, "what": "step", "step_index": memory["steps"], "round_idx": body["round"], "end_seq": seq, "observation": body["observation"], "messages": body.get("messages")}]
        return []

    def unfinished(self, key, memory):
        """Searches that are open now are given up; what comes for them later has no search."""
        left = [r for r in memory["rounds"].values() if r.pop("search", None)]
        return [self.error(key, "unfinished_search_action")] * bool(left)

    def deadline(self, memory):
        return None if self.seconds is None or memory["late"] or memory["finishes"] or "first_ms" not in memory else memory["first_ms"] + int(self.seconds * 1000)

    def time_out(self, key, memory):
        memory["late"] = True
        return self.unfinished(key, memory)

    def end(self, key, memory):
        made = self.unfinished(key, memory)
        made += [self.error(key, f"trajectory_{w}_count") for w, n in (("start", memory["starts"]), ("finish", memory["finishes"])) if n != 1]
        reasoning, content = memory["last"] or (None, None)
        return [*made, {"trajectory_id": key, "what": "end", "messages": memory["initial"], "answer": memory["answer"], "reasoning": reasoning, "content": content, "responded": memory["last"] is not None}]


def reconstructing(events: DataFrame, ts: str = "ts", late: str = "10 minutes", silent_ms: int = DAY_MS, seconds: float | None = None) -> DataFrame:
    """Steps, errors and ends of a stream of events ``trajectory_id, seq, event_type, payload`` and a time."""
    rows = ordered_rows(events, F.col("trajectory_id"), F.col("seq"), F.col(ts), body(), late)
    return run(rows, Reconstruction(seconds), silent_ms)


def candidates(found: DataFrame, results: DataFrame) -> DataFrame:
    """The batch operator's candidates from what a stream has handed on."""
    response = F.struct(F.col("reasoning").alias("reasoning"), F.col("content").alias("content")).alias("response")
    steps = found.filter("what = 'step'").select(
        "trajectory_id", "round_idx", "start_seq", response, "raw_textual_action", "arguments", "queries", "proposed_engine", "finish_seq", "search_result_sha256", "end_seq", "observation", F.from_json("messages", MESSAGES).alias("messages")
    )
    last = F.when(F.col("responded"), F.struct(F.coalesce("reasoning", F.lit("")).alias("r"), F.coalesce("content", F.lit("")).alias("c")))
    ends = found.filter("what = 'end'").select("trajectory_id", F.from_json("messages", MESSAGES).alias("initial_messages"), F.col("answer").alias("__answer"), last.alias("__last"))
    codes = found.filter("what = 'error'").select("trajectory_id", "code").distinct()
    return trajectories.assemble(results, trajectories.described(steps), ends, codes)
