"""Joins over keyed and ordered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import qa_normalize
from .expect import ExpectationError


def lookup(left: DataFrame, right: DataFrame, key: str, required: str) -> DataFrame:
    """Left join whose rows raise where ``required`` finds no partner."""
    joined = left.join(right, key, "left")
    missing = F.raise_error(F.concat(F.lit("missing key "), F.col(key).cast("string"))).cast(joined.schema[required].dataType)
    return joined.withColumn(required, F.when(F.col(required).isNull(), missing).otherwise(F.col(required)))


def keyed_merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have one, the right one wins."""
    values = [c for c in left.columns if c != key]
    r = right.select(F.col(key).alias("__k"), F.lit(True).alias("__has"), *(F.col(c).alias(f"__{c}") for c in values))
    both = left.join(r, F.col(key) == F.col("__k"), "full_outer")
    return both.select(F.coalesce(key, "__k").alias(key), *(F.when(F.col("__has"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in values))


def exclude(pool: DataFrame, held_out: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of ``pool`` whose id and normalized text are both absent from ``held_out``: two hash anti joins."""
    ids = held_out.select(F.col(key).alias("__id"))
    texts = held_out.select(qa_normalize(text).alias("__norm"))
    kept = pool.join(ids, F.col(key) == F.col("__id"), "left_anti").withColumn("__n", qa_normalize(text))
    return kept.join(texts, F.col("__n") == F.col("__norm"), "left_anti").drop("__n")


def asof_backward(events: DataFrame, by: list[str], order: list[str], is_query: Column, is_state: Column, value: Column, out: str) -> DataFrame:
    """Query events with the value of the last state event before them."""
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn(out, F.last(F.when(is_state, value), ignorenulls=True).over(before)).filter(is_query)


def asof_forward(events: DataFrame, by: list[str], order: list[str], is_query: Column, is_state: Column, value: Column, out: str) -> DataFrame:
    """Query events with the value of the first state event after them."""
    after = W.partitionBy(*by).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    return events.withColumn(out, F.first(F.when(is_state, value), ignorenulls=True).over(after)).filter(is_query)


def latest_by_type(events: DataFrame, by: list[str], order: Column, kind: str, kinds: list[str], value: Column) -> DataFrame:
    """Last value of each event type by key, one column a type."""
    return events.groupBy(*by).agg(*(F.max_by(F.when(F.col(kind) == k, value), F.when(F.col(kind) == k, order)).alias(k) for k in kinds))


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of a are not in b, and of b not in a, as multisets."""
    return a.exceptAll(b).agg(F.count("*").alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right")))


def agreement(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys of ``left`` without a partner, partners with another value, and whether all agree."""
    r = right.select(F.col(key).alias("__k"), F.col(value).alias("__v"), F.lit(True).alias("__has"))
    both = left.join(r, F.col(key) == F.col("__k"), "left")
    missing, other = F.count_if(F.col("__has").isNull()), F.count_if(F.col("__has") & ~F.col(value).eqNullSafe(F.col("__v")))
    return both.agg(missing.alias("missing"), other.alias("different"), (missing + other == 0).alias("agree"))


def select_ids(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of a list of ids; an id without a row raises."""
    absent = wanted.join(rows.select(key), key, "left_anti").limit(5).collect()
    if absent:
        raise ExpectationError(f"no rows for {key} {[r[key] for r in absent]}")
    return rows.join(wanted.select(key).distinct(), key, "left_semi")
