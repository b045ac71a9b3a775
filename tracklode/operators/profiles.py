"""Distributions, group profiles, cross-tabs and reports.

A missing number counts as 0 wherever a profile says so: callers coalesce
first, and these functions do not skip zeros.  Each report is one pass with
map-side aggregation; nothing but its rows leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.algebra import mean_or_zero, percentile_or_zero, ratio_or_zero
from ..functions.text import _c

#: Reported quantiles, ranges of rounds and length limits; fixed values.
QUANTILES = (0.50, 0.75, 0.90, 0.95, 0.99)
ROUND_BUCKETS = ((1, 3), (4, 6), (7, 12), (13, 20), (21, 30), (31, None))
TOKEN_LIMITS = (4096, 8192, 12288, 16384, 24576, 32768)


def distribution_columns(x) -> list[Column]:
    """n, min, mean, p50..p99 and max of a column; 0.0 for no rows."""
    v = _c(x).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [F.count(v).alias("n"), zero(F.min(v)).alias("min"), zero(F.avg(v)).alias("mean"), *(percentile_or_zero(v, q).alias(f"p{round(100 * q)}") for q in QUANTILES), zero(F.max(v)).alias("max")]


def distribution(df: DataFrame, x, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*distribution_columns(x))


def coverage(df: DataFrame, length, limits: tuple[int, ...] = TOKEN_LIMITS) -> DataFrame:
    """``bucket, n, rate``: rows up to each limit, and rows over the last."""
    v = _c(length)
    counts = df.agg(F.count("*").alias("all"), *(F.count_if(v <= t).alias(f"<={t}") for t in limits), F.count_if(v > limits[-1]).alias(f">{limits[-1]}"))
    names = [*(f"<={t}" for t in limits), f">{limits[-1]}"]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("bucket"), F.col(f"`{n}`").alias("n")) for n in names))).alias("x")
    return counts.select("all", each).select("x.bucket", "x.n", ratio_or_zero(F.col("x.n"), F.col("all")).alias("rate"))


def with_percentage(profile: DataFrame, n: str = "n", out: str = "percentage") -> DataFrame:
    """A profile's rows with their share of all rows counted in it, in percent; 0.0 where nothing is counted."""
    whole = profile.agg(F.coalesce(F.sum(n), F.lit(0)).alias("__all"))  # one row
    return profile.crossJoin(F.broadcast(whole)).withColumn(out, 100 * ratio_or_zero(F.col(n), F.col("__all"))).drop("__all")


def range_bucket(x, buckets=ROUND_BUCKETS) -> Column:
    """Name of the bucket that holds the value; null if none does (0 rounds)."""
    v, out = _c(x), F.lit(None).cast("string")
    for low, high in reversed(buckets):
        inside = v >= low if high is None else v.between(low, high)
        out = F.when(inside, f"{low}+" if high is None else f"{low}-{high}").otherwise(out)
    return out


def quantile_bucket(df: DataFrame, x: str, out: str = "bucket", cuts: DataFrame | None = None) -> DataFrame:
    """``df`` with the quantile range of ``x``: up to p50, then half-open ranges, then above p99.

    ``cuts`` is one row with p50..p99, where they are known already (``quantiles.exact_quantiles``).
    """
    if cuts is None:
        cuts = df.agg(F.percentile(x, F.array(*map(F.lit, QUANTILES))).alias("__cuts"))  # one row
    else:
        cuts = cuts.select(F.array(*(F.col(f"p{round(100 * q)}") for q in QUANTILES)).alias("__cuts"))
    names = ["<=p50", "p50-p75", "p75-p90", "p90-p95", "p95-p99", ">p99"]
    joined = df.crossJoin(F.broadcast(cuts))
    name = F.lit(names[-1])
    for k in reversed(range(len(QUANTILES))):
        name = F.when(F.col(x) <= F.col("__cuts")[k], names[k]).otherwise(name)
    return joined.withColumn(out, name).drop("__cuts")


def quality_columns(prefix: str, where: Column) -> list[Column]:
    """EM, F1, passes and pass rate of the rows that meet a condition."""
    n = F.count_if(where)
    passed = F.count_if(where & F.col("outcome_pass"))
    some = lambda c: F.coalesce(F.avg(F.when(where, F.coalesce(F.col(c), F.lit(0.0)))), F.lit(0.0))
    return [n.alias(f"{prefix}_n"), some("answer_em").alias(f"{prefix}_em"), some("answer_f1").alias(f"{prefix}_f1"), passed.alias(f"{prefix}_pass"), ratio_or_zero(passed, n).alias(f"{prefix}_pass_rate")]


def group_profile(results: DataFrame, group) -> DataFrame:
    """One wide row a group: quality of ordinary, invalid and all questions, effort, tokens and protocol rates."""
    kind = F.col("question_type")
    actions = F.sum(F.coalesce("search_actions", F.lit(0)))
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda c: F.count_if(c) / F.count("*")
    return results.groupBy(_c(group).alias("group")).agg(
        *quality_columns("overall", F.lit(True)),
        *quality_columns("ordinary", kind == "ordinary_qa"),
        *quality_columns("invalid", kind == "invalid_question"),
        mean_or_zero(num("rounds")).alias("mean_rounds"),
        percentile_or_zero(num("rounds"), 0.5).alias("median_rounds"),
        percentile_or_zero(num("rounds"), 0.95).alias("p95_rounds"),
        mean_or_zero(num("search_actions")).alias("mean_search_actions"),
        mean_or_zero(num("search_queries")).alias("mean_search_queries"),
        mean_or_zero(num("total_tokens")).alias("mean_tokens"),
        percentile_or_zero(num("total_tokens"), 0.5).alias("median_tokens"),
        share(F.col("termination") == "force_answer").alias("force_answer_rate"),
        share(F.col("termination") == "raw_fallback").alias("raw_fallback_rate"),
        ratio_or_zero(F.sum(num("malformed_wrappers")), actions).alias("malformed_wrapper_rate"),
        ratio_or_zero(F.sum(num("action_source_mismatch")), actions).alias("action_source_mismatch_rate"),
    )


def abs_difference(profile: DataFrame, key: str, a: str, b: str, name: str = "absolute_difference") -> DataFrame:
    """``profile`` with a row of |a - b| for every numeric column of the two groups."""
    numeric = [f.name for f in profile.schema if f.name != key and f.dataType.typeName() in ("double", "long", "integer")]
    pick = lambda c, g: F.max(F.when(F.col(key) == g, F.col(c)))
    row = profile.agg(*(F.abs(pick(c, a) - pick(c, b)).alias(c) for c in numeric))
    return profile.unionByName(row.withColumn(key, F.lit(name)), allowMissingColumns=True)


def histogram(df: DataFrame, x, name: str = "value") -> DataFrame:
    """``value, n`` and each value's share of all rows."""
    counts = df.groupBy(_c(x).alias(name)).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(name, "n", (F.col("n") / F.col("__all")).alias("share"))


def top_share(df: DataFrame, x: str, k: int = 10) -> DataFrame:
    """Share of the column's sum that its k largest values hold."""
    top = df.select(x).orderBy(F.desc(x)).limit(k).agg(F.coalesce(F.sum(x), F.lit(0)).alias("top"))
    return top.crossJoin(df.agg(F.sum(x).alias("all"))).select("top", "all", ratio_or_zero("top", "all").alias("top_share"))


def cost_scenarios(totals: DataFrame, tokens_in: str, units: str, outputs: tuple[int, ...], price_in: float, price_out: float) -> DataFrame:
    """Price of a one-row total for several output sizes a unit; prices are per million tokens."""
    each = F.explode(F.array(*map(F.lit, outputs))).alias("output_tokens_per_unit")
    cost = (F.col(tokens_in) * price_in + F.col(units) * F.col("output_tokens_per_unit") * price_out) / 1e6
    return totals.select(tokens_in, units, each).withColumn("cost", cost)


def stable_rank(df: DataFrame, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def freeze_report(results: DataFrame) -> DataFrame:
    """The whole corpus as one row: data, quality, agent, token, protocol and infrastructure measures."""
    num = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    total = lambda c: F.coalesce(F.sum(num(c)), F.lit(0))
    kind = F.col("question_type")
    n = F.count("*")
    malformed = total("raw_spaced_tool_call") + total("raw_tool_call_no_gt")
    is_end = lambda name: F.count_if(F.col("termination") == name)
    requests = F.coalesce(F.col("request_inputs"), F.array().cast("array<bigint>"))
    return results.agg(
        n.alias("trajectories"),
        F.count_distinct("question_id").alias("unique_question_ids"),
        *quality_columns("ordinary", kind == "ordinary_qa"),
        *quality_columns("invalid_question", kind == "invalid_question"),
        *quality_columns("overall", F.lit(True)),
        total("rounds").alias("total_rounds"),
        mean_or_zero(num("rounds")).alias("mean_rounds"),
        percentile_or_zero(num("rounds"), 0.5).alias("median_rounds"),
        percentile_or_zero(num("rounds"), 0.95).alias("p95_rounds"),
        total("search_actions").alias("search_actions"),
        total("search_queries").alias("search_queries"),
        mean_or_zero(num("search_actions")).alias("mean_search_actions"),
        mean_or_zero(num("search_queries")).alias("mean_search_queries"),
        F.count_if(num("search_actions") > 0).alias("searching_questions"),
        ratio_or_zero(F.count_if(num("search_actions") > 0), n).alias("search_rate"),
        F.count_if(F.coalesce("answer_produced", F.lit(False))).alias("answer_count"),
        ratio_or_zero(F.count_if(F.coalesce("answer_produced", F.lit(False))), n).alias("answer_rate"),
        *(is_end(x).alias(x) for x in ("normal_answer", "force_answer", "raw_fallback")),
        total("input_tokens").alias("total_input"),
        total("output_tokens").alias("total_output"),
        total("total_tokens").alias("total"),
        mean_or_zero(num("total_tokens")).alias("mean_trajectory_cumulative"),
        percentile_or_zero(num("total_tokens"), 0.5).alias("p50_trajectory_cumulative"),
        percentile_or_zero(num("total_tokens"), 0.95).alias("p95_trajectory_cumulative"),
        F.coalesce(F.max(num("total_tokens")), F.lit(0)).alias("max_trajectory_cumulative"),
        F.coalesce(F.max(F.array_max(requests)), F.lit(0)).alias("max_single_request_input"),
        F.coalesce(F.sum(F.size(F.filter(requests, lambda x: x > 128_000))), F.lit(0)).alias("requests_over_128k"),
        total("raw_canonical_exact").alias("canonical_exact"),
        total("raw_spaced_tool_call").alias("spaced_tool_call"),
        total("raw_tool_call_no_gt").alias("tool_call_missing_gt"),
        total("parser_bare_json_fallback").alias("bare_json_fallback"),
        total("parser_invalid_json").alias("invalid_json"),
        total("parser_none").alias("parser_none"),
        total("action_source_mismatch").alias("action_source_mismatch"),
        ratio_or_zero(total("action_source_mismatch"), total("search_actions")).alias("action_source_mismatch_rate"),
        malformed.alias("malformed_wrapper_count"),
        ratio_or_zero(malformed, total("search_actions")).alias("malformed_wrapper_rate"),
        total("retriever_http_requests").alias("retriever_requests"),
        total("retriever_failures").alias("retriever_failures"),
        (total("retriever_http_requests") - total("retriever_failures")).alias("retriever_successes"),
        total("message_continuity_edges").alias("message_continuity_edges"),
        total("message_continuity_failed_edges").alias("message_continuity_failures"),
        total("env_query_rewrite_count").alias("environment_query_rewrites"),
        total("visit_attempts").alias("visit_attempts"),
        total("visit_executed").alias("visit_executions"),
        F.count_if(F.coalesce("gold_leakage", F.lit(False))).alias("gold_leakage"),
        F.count_if(~F.coalesce("state_ok", F.lit(False))).alias("state_machine_failures"),
    )


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """The evaluator's summary of scored results, as one row with a histogram of terminations."""
    n = F.count("*")
    queries = F.coalesce(F.col("num_queries"), F.lit(0))
    rate = lambda c: F.count_if(F.coalesce(F.col(c).cast("boolean"), F.lit(False))) / n
    searched = F.count_if(queries > 0)
    one = rows.agg(
        n.alias("num_questions"),
        F.avg("answer_em").alias("EM"),
        F.avg("answer_f1").alias("F1"),
        (searched / n).alias("search_rate"),
        (1 - searched / n).alias("no_search_rate"),
        F.avg(queries).alias("avg_queries_all"),
        ratio_or_zero(F.sum(queries), searched).alias("avg_queries_when_searching"),
        *(rate(c).alias(f"{c}_rate") for c in ("answer_before_search", "strict_protocol_valid", "logical_action_valid", "budget_hit")),
        (F.count_if(F.col("termination_reason") == "max_rounds") / n).alias("max_rounds_failure_rate"),
        rate("duplicate_query_count").alias("duplicate_query_rate"),
    )
    ends = rows.groupBy("termination_reason").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("termination_reason", F.lit("null")), "count")))).alias("termination_reason_distribution"))
    return one.crossJoin(ends)  # one row each
