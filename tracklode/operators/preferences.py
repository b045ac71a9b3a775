"""Preference pairs, token-weighted means, and scores joined with the rollouts they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import preference_logit, ratio_or_zero, softplus_loss


def pair_branches(rows: DataFrame, batch: str, position: str, *values: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of batches that hold their chosen rows first and their rejected rows after, and the batches that cannot be paired.

    ``position`` counts from 0 inside a batch.  A pair has ``batch, pair`` and
    ``chosen_x, rejected_x`` for each value.  A batch with an odd number of
    rows, or whose positions are not 0, 1, 2, ... each once, is bad.
    """
    n, half = F.count("*"), F.col("__n") / 2
    shape = rows.groupBy(batch).agg(n.alias("__n"), F.count_distinct(position).alias("__d"), F.min(position).alias("__lo"), F.max(position).alias("__hi"))
    good = F.coalesce((F.col("__n") % 2 == 0) & (F.col("__d") == F.col("__n")) & (F.col("__lo") == 0) & (F.col("__hi") == F.col("__n") - 1), F.lit(False))
    bad = shape.filter(~good).select(batch, F.col("__n").alias("rows"))
    first = F.col(position) < half
    side = lambda name, when: [F.max(F.when(when, F.col(v))).alias(f"{name}_{v}") for v in values]
    pair = F.pmod(F.col(position), half.cast("bigint")).alias("pair")
    paired = rows.join(shape.filter(good).select(batch, "__n"), batch).groupBy(batch, pair).agg(*side("chosen", first), *side("rejected", ~first))
    return paired, bad


def preference_summary(pairs: DataFrame, batch: str, beta: float) -> DataFrame:
    """``loss, reward_accuracy, pairs``: the mean of the batches' mean losses, and the share of pairs with a positive logit.

    ``pairs`` has chosen and rejected ``policy`` and ``reference`` log-probabilities.
    """
    logit = preference_logit("chosen_policy", "rejected_policy", "chosen_reference", "rejected_reference", F.lit(beta))
    each = pairs.select(batch, logit.alias("__logit")).groupBy(batch).agg(F.avg(softplus_loss(F.col("__logit"))).alias("loss"), F.count_if(F.col("__logit") > 0).alias("right"), F.count("__logit").alias("pairs"))
    return each.agg(F.avg("loss").alias("loss"), ratio_or_zero(F.sum("right"), F.sum("pairs")).alias("reward_accuracy"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def token_share_mean(segments: DataFrame, trajectory: str, tokens: str, *values: str) -> DataFrame:
    """One row: each value's mean over trajectories, where a trajectory's value is the mean over its tokens.

    So a segment weighs its share of the trajectory's tokens, and no trajectory weighs more than another.
    """
    total = F.sum(tokens)
    each = segments.groupBy(trajectory).agg(*(ratio_or_zero(F.sum(F.col(v) * F.col(tokens)), total).alias(v) for v in values))
    return each.agg(*(F.avg(v).alias(v) for v in values))


def join_scores(rollouts: DataFrame, units: DataFrame, scores: DataFrame, key: str, score: str) -> DataFrame:
    """Rollouts with ``scores`` (their own, in order of ``unit_id``), ``expected``, ``scored`` and ``complete``.

    Units and scores are counted before the joins; a rollout without either is complete.
    """
    expected = units.groupBy(key).agg(F.count("*").alias("expected"))
    own = scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("unit_id", F.col(score).alias("v")))).alias("own"))  # one rollout's queries
    joined = rollouts.join(expected, key, "left").join(own, key, "left")
    values = F.transform(F.coalesce("own", F.array().cast(own.schema["own"].dataType)), lambda x: x["v"])
    joined = joined.withColumns({"scores": values, "expected": F.coalesce("expected", F.lit(0))}).drop("own")
    return joined.withColumn("scored", F.size("scores").cast("bigint")).withColumn("complete", F.col("scored") == F.col("expected"))


def repeat_to(rows: DataFrame, order: list[Column], count: int) -> DataFrame:
    """``rows`` in order, begun again until there are ``count``; ``micro_batch`` numbers them from 0."""
    from pyspark.sql import Window as W

    some = rows.orderBy(*order).limit(count)  # at most count rows go into one task
    numbered = some.withColumn("__k", F.row_number().over(W.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(W.partitionBy()))
    places = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")), lambda j: F.pmod(j, F.col("__n")) == F.col("__k"))
    return numbered.withColumn("micro_batch", F.explode(places)).drop("__k", "__n")
