"""Running computations along trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.algebra import first_difference
from ..functions.text import _c, jaccard_sets, word_set


def before(by: list[str], *order) -> W:
    return W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def redundancy(steps: DataFrame, by: str, order: str, fragments: str) -> DataFrame:
    """``fragment_count, unique_count, redundancy_count`` of each step: distinct fragments that an earlier step had.

    Exploded and joined on (trajectory, fragment) with the fragment's first
    step, so no step carries the history of its trajectory.
    """
    each = steps.select(by, order, F.explode(F.array_distinct(fragments)).alias("__f"))
    first = each.groupBy(by, "__f").agg(F.min(order).alias("__first"))
    seen = each.join(first, [by, "__f"]).filter(F.col(order) > F.col("__first")).groupBy(by, order).agg(F.count("*").alias("redundancy_count"))
    sized = steps.withColumns({"fragment_count": F.size(fragments), "unique_count": F.size(F.array_distinct(fragments))})
    return sized.join(seen, [by, order], "left").withColumn("redundancy_count", F.coalesce("redundancy_count", F.lit(0).cast("bigint")))


def redundancy_pass(counted: DataFrame, by: str) -> DataFrame:
    """A trajectory passes if every step has fragments and repeats at most one."""
    parsed = F.bool_and(F.col("fragment_count") > 0)
    low = F.bool_and(F.col("redundancy_count") <= 1)
    reason = F.when(~parsed, "redundancy_identity_unavailable").when(~low, "redundancy_gt_1")
    return counted.groupBy(by).agg((parsed & low).alias("redundancy_pass"), reason.alias("reject_reason"))


def max_prior_jaccard(queries: DataFrame, by: str, action: str, text: str, out: str = "max_prior_jaccard") -> DataFrame:
    """Greatest word-set similarity of each query with a query of an earlier action of its trajectory.

    A trajectory's queries are few (tens), so they travel as one array.
    """
    sets = queries.withColumn("__w", word_set(text))
    history = sets.groupBy(by).agg(F.collect_list(F.struct(F.col(action).alias("a"), F.col("__w").alias("w"))).alias("__h"))
    earlier = F.filter("__h", lambda h: h["a"] < F.col(action))
    best = F.array_max(F.transform(earlier, lambda h: jaccard_sets(F.col("__w"), h["w"])))
    return sets.join(history, by).withColumn(out, F.coalesce(best, F.lit(0.0))).drop("__w", "__h")


def seen_before(rows: DataFrame, by: list[str], order: list[str], value, out: str) -> DataFrame:
    """Whether the same value stood earlier in the trajectory."""
    w = W.partitionBy(*by, _c(value)).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(w) > 1)


def stagnation(rows: DataFrame, by: list[str], order: list[str], duplicate: str, limit: int = 3) -> DataFrame:
    """``stagnant_steps``: length of the current run of duplicates, and ``terminate_suggested`` from ``limit`` on."""
    w = W.partitionBy(*by).orderBy(*order)
    island = rows.withColumn("__island", F.sum(F.when(F.col(duplicate), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(*by, "__island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    run = F.sum(F.col(duplicate).cast("bigint")).over(inside)
    return island.withColumn("stagnant_steps", run).withColumn("terminate_suggested", F.col("stagnant_steps") >= limit).drop("__island")


def guard(rows: DataFrame, by: list[str], order: list[str], query, observation) -> DataFrame:
    """The monitor's diagnostics: repeated queries, repeated observations, evidence gain and stagnation."""
    seen = seen_before(seen_before(rows, by, order, query, "duplicate_query"), by, order, observation, "duplicate_observation")
    return stagnation(seen, by, order, "duplicate_observation").withColumn("evidence_gain", ~F.col("duplicate_observation"))


def replay_audit(records: DataFrame, by: str, order: str, state: str = "input_ids", action: str = "generated_ids") -> DataFrame:
    """Transitions whose state does not begin with the state and action before it, with the first difference."""
    w = W.partitionBy(by).orderBy(order)
    expected = records.withColumn("__e", F.concat(F.lag(state).over(w), F.lag(action).over(w))).filter(F.col("__e").isNotNull())
    at = first_difference("__e", F.slice(state, F.lit(1), F.size("__e")))
    return expected.withColumn("first_difference", at).drop("__e").filter(F.col("first_difference").isNotNull())


def budget_stop(rows: DataFrame, by: list[str], order: list[str], **limits: float) -> DataFrame:
    """Where each trajectory ends by a budget: the first row at which the running sum of a named column reaches its limit.

    Trajectories that stay under all limits are absent.  ``reason`` names the
    first column, in the order given, that is used up at that row.
    """
    upto = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sums = {f"__{c}": F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto) for c in limits}
    reason = F.coalesce(*(F.when(F.col(f"__{c}") >= limit, F.lit(c)) for c, limit in limits.items()))
    over = rows.withColumns(sums).withColumn("reason", reason).filter("reason IS NOT NULL")
    return over.groupBy(*by).agg(F.min_by(F.struct(*order, "reason"), F.struct(*order)).alias("stop")).select(*by, "stop.*")


def early_answers(rows: DataFrame, by: list[str], order: list[str], kind: str, elapsed: str, min_rounds: int = 3, min_seconds: float = 120.0) -> DataFrame:
    """The first answer of each trajectory that comes before so many rounds and seconds: it would be sent back once."""
    w = W.partitionBy(*by).orderBy(*order)
    numbered = rows.withColumn("round", F.row_number().over(w)).filter(F.col(kind) == "answer")
    first = numbered.groupBy(*by).agg(F.min_by(F.struct("round", elapsed), "round").alias("a")).select(*by, "a.*")
    return first.filter((F.col("round") < min_rounds) & (F.col(elapsed) < min_seconds))


def action_position(index, total) -> Column:
    i, n = _c(index), _c(total)
    return F.when((i == 1) | (3 * i <= n), "early").when(3 * i >= 2 * n, "late").otherwise("middle")


def query_position(index, count) -> Column:
    i, n = _c(index), _c(count)
    return F.when(n == 1, "single").when(i == 0, "first").when(i == n - 1, "last").otherwise("middle")


def count_class(count) -> Column:
    n = _c(count)
    return F.when(n == 1, "single").when(n.isin(2, 3), n.cast("string")).otherwise(">3")


def history(rows: DataFrame, by: list[str], order: list[str], item: Column, out: str = "history") -> DataFrame:
    """Items of all earlier rows of the trajectory, in order."""
    return rows.withColumn(out, F.collect_list(item).over(before(by, *order)))


def group_advantage(rewards: DataFrame, group: str, reward: str, epsilon: float = 1e-4, sample: bool = False) -> DataFrame:
    """(reward - mean) / (deviation + epsilon) inside each group; raises for groups under two rows or values that are not finite.

    Grouped and joined rather than windowed, so a large group is not sorted in one task.
    """
    deviation = F.stddev_samp(reward) if sample else F.stddev_pop(reward)
    bad = (F.count("*") < 2) | F.bool_or(F.col(reward).isNull() | F.isnan(reward) | F.abs(reward).isin(float("inf")))
    stats = rewards.groupBy(group).agg(F.avg(reward).alias("__m"), deviation.alias("__s"), bad.alias("__bad"))
    value = F.when(F.col("__bad"), F.raise_error(F.lit("a group needs two finite rewards")).cast("double")).otherwise((F.col(reward) - F.col("__m")) / (F.col("__s") + epsilon))
    return rewards.join(stats, group).withColumn("advantage", value).drop("__m", "__s", "__bad")
