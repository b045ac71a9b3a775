"""Stage evaluation: one profile a training stage over the same questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import ratio_or_zero
from .expect import ExpectationError, require, require_rows

#: Stages and the columns each row must have; fixed values.
STAGES = ("Base", "SFT", "DPO", "GRPO")
REQUIRED = ("question_id", "answer_em", "answer_f1", "task_success", "search_action_count", "search_query_count", "valid_query_count", "repeated_query_count", "retrieval_success_count", "process_scores", "trajectory_reward", "termination_reason")


def ids_hash(x: str) -> Column:
    """SHA-256 of the sorted ids, one a line; repeated ids count."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(x).cast("string"))), "\n"), 256)


def validate(rows: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ExpectationError(f"missing columns: {missing}")
    n = F.col("search_query_count")
    return require(
        require_rows(rows, "stage rows"),
        required=~F.greatest(*(F.col(c).isNull() for c in REQUIRED)),
        valid_queries=F.col("valid_query_count") <= n,
        repeated_queries=F.col("repeated_query_count") <= n,
        binary_scores=F.forall("process_scores", lambda s: F.coalesce(s.isin(0, 1), F.lit(False))),
    )


def aggregate(rows: DataFrame, by: str = "stage") -> DataFrame:
    """Rates and means of each stage with the hash of its questions."""
    queries = F.sum("search_query_count")
    good = F.sum(F.aggregate("process_scores", F.lit(0).cast("bigint"), lambda s, v: s + v.cast("bigint")))
    return rows.groupBy(by).agg(
        F.count("*").alias("examples"),
        F.avg("answer_em").alias("answer_em"),
        F.avg("answer_f1").alias("answer_f1"),
        F.avg(F.col("task_success").cast("int")).alias("task_success_rate"),
        F.avg("search_action_count").alias("average_search_actions"),
        ratio_or_zero(F.sum("valid_query_count"), queries).alias("valid_query_ratio"),
        ratio_or_zero(F.sum("repeated_query_count"), queries).alias("repeated_query_ratio"),
        ratio_or_zero(F.sum("retrieval_success_count"), queries).alias("retrieval_success_rate"),
        ratio_or_zero(good, F.sum(F.size("process_scores"))).alias("mean_process_reward"),
        F.avg("trajectory_reward").alias("mean_trajectory_reward"),
        ids_hash("question_id").alias("question_ids_sha256"),
    )


def terminations(rows: DataFrame, by: str = "stage") -> DataFrame:
    return rows.groupBy(by, "termination_reason").agg(F.count("*").alias("n"))


def compare(rows: DataFrame) -> DataFrame:
    """``aggregate`` of exactly the four stages over one set of questions."""
    report = aggregate(validate(rows))
    seen = report.select("stage", "question_ids_sha256").collect()  # one row a stage
    if {r["stage"] for r in seen} != set(STAGES):
        raise ExpectationError(f"exactly the stages {STAGES} are needed, not {sorted(r['stage'] for r in seen)}")
    if len({r["question_ids_sha256"] for r in seen}) != 1:
        raise ExpectationError("the stages have different questions")
    return report


def markdown(report: DataFrame) -> str:
    """The comparison as a Markdown table, in the order of the stages."""
    head = ("Model", "EM", "F1", "Success", "Avg Search", "Valid Query", "Process Reward")
    columns = ("answer_em", "answer_f1", "task_success_rate", "average_search_actions", "valid_query_ratio", "mean_process_reward")
    rows = {r["stage"]: r for r in report.collect()}
    lines = ["| " + " | ".join(head) + " |", "|---" + "|---:" * len(columns) + "|"]
    lines += [f"| {s} | " + " | ".join(f"{rows[s][c]:.4f}" for c in columns) + " |" for s in STAGES if s in rows]
    return "\n".join(lines) + "\n"
