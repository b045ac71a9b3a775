"""Expectations: named conditions over a table, reported or enforced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpectationError(ValueError):
    """A table breaks a named condition."""


def violations(df: DataFrame, **conditions: Column) -> DataFrame:
    """``check, failures``: rows for which each condition is false or null."""
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))
    return unpivot(counts, list(conditions), "check", "failures")


def unpivot(df: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
    """One row for each of the columns of a table with one row."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns))).alias("__x")).select("__x.*")


def require(df: DataFrame, **conditions: Column) -> DataFrame:
    """``df``, after checking that every row meets every condition."""
    failed = violations(df, **conditions).filter("failures > 0").collect()  # one row a condition
    if failed:
        raise ExpectationError(", ".join(f"{r['check']}: {r['failures']} rows" for r in failed))
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    if df.isEmpty():
        raise ExpectationError(f"{what} is empty")
    return df


def guarded(df: DataFrame, **conditions: Column) -> DataFrame:
    """``df`` whose rows raise where a condition fails, when they are read."""
    for name, ok in conditions.items():
        df = df.filter(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"expectation failed: {name}")).cast("boolean")))
    return df
