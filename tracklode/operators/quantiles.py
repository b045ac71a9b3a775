"""Exact quantiles by refining range counts, in bounded state.

Spark's exact percentile keeps every different value of a group in one buffer.
Here a quantile is the value at one or two places of its group's order.  Each
pass counts a group's values in ``BINS`` ranges (a map-side aggregation, so a
group of any size is spread over all tasks), finds the bin that holds each
place, and goes on inside it; a bin's own least and greatest value bound the
next pass, so every pass makes progress and equal values end at once.  When a
range holds at most ``FEW`` values these are sorted.  The values are written
once as two columns and are never sorted or shuffled as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import _c
from ..sources.shared import fresh_path

BINS, FEW = 1_024, 4_096


def _written(df: DataFrame, what: str) -> DataFrame:
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _inside(data: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values with the range of their group that holds them, if one does; a group's ranges are few and do not overlap."""
    few = ranges.select("g", "low", "high").distinct().groupBy("g").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    hit = F.filter("ranges", lambda r: (F.col("v") >= r["low"]) & (F.col("v") <= r["high"]))
    return data.join(few, "g").select("g", "v", F.get(hit, 0).alias("r")).filter("r IS NOT NULL").select("g", "v", "r.low", "r.high")


def places(data: DataFrame, wanted: DataFrame, bins: int = BINS, few: int = FEW) -> DataFrame:
    """``g, k, value``: the value at place ``k`` (from 0) of each group's order.

    ``data`` has ``g, v`` (no nulls, finite); ``wanted`` has ``g, k`` and the
    group's ``low``, ``high`` and ``n``.
    """
    left = _written(wanted.select("g", "k", "low", "high", F.col("k").alias("at"), "n").distinct(), "places")
    width = "(high / 2 - low / 2)"  # halves, as the difference of two doubles may not be one
    number = F.expr(f"CAST(least({bins - 1}, floor((v / 2 - low / 2) / {width} * {bins})) AS INT)")
    while not (todo := left.filter(f"low < high AND n > {few}")).isEmpty():
        counted = _inside(data, todo).withColumn("bin", number).groupBy("g", "low", "high", "bin").agg(F.count("*").alias("c"), F.min("v").alias("from"), F.max("v").alias("to"))
        before = W.partitionBy("g", "low", "high").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # at most ``bins`` rows
        counted = counted.withColumn("b", F.coalesce(F.sum("c").over(before), F.lit(0)))
        found = todo.join(counted, ["g", "low", "high"]).filter("at >= b AND at < b + c")
        found = found.select("g", "k", F.col("from").alias("low"), F.col("to").alias("high"), (F.col("at") - F.col("b")).alias("at"), F.col("c").alias("n"))
        left = _written(left.filter(f"NOT (low < high AND n > {few})").unionByName(found), "places")
    one = left.filter("low = high").select("g", "k", F.col("low").alias("value"))
    rest = left.filter("low < high")
    values = _inside(data, rest).groupBy("g", "low", "high").agg(F.sort_array(F.collect_list("v")).alias("values"))  # at most ``few`` values
    some = rest.join(values, ["g", "low", "high"]).select("g", "k", F.get("values", F.col("at").cast("int")).alias("value"))
    return one.unionByName(some)


def exact_quantiles(df: DataFrame, by: list[str], x, shares: dict[str, float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """``by``, ``n, min, mean, max`` and a column for each named share, with linear interpolation between neighbours.

    Null values and NaN do not count; a group without values has no row.
    """
    key = F.to_json(F.struct(*by)) if by else F.lit("{}")
    own = [F.col(c).alias(f"__by{k}") for k, c in enumerate(by)]
    data = _written(df.select(*own, key.alias("g"), _c(x).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)"), "values")
    groups = data.groupBy("g").agg(*(F.first(f"__by{k}").alias(f"__by{k}") for k in range(len(by))), F.count("*").alias("n"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"))
    groups = _written(groups, "groups")
    named = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(share)).alias("share")) for name, share in shares.items()))).alias("s")
    asked = groups.select("g", "n", F.col("min").alias("low"), F.col("max").alias("high"), named).withColumn("place", F.col("s.share") * (F.col("n") - 1))
    asked = asked.withColumns({"first": F.floor("place"), "second": F.ceil("place")})
    wanted = asked.select("g", "n", "low", "high", F.explode(F.array("first", "second")).alias("k"))
    value = _written(places(data.select("g", "v"), wanted, bins, few), "quantiles")
    at = lambda k: value.select("g", F.col("k").alias(k), F.col("value").alias(f"at_{k}"))
    both = asked.select("g", "s.name", "place", "first", "second").join(at("first"), ["g", "first"]).join(at("second"), ["g", "second"])
    interpolated = F.col("at_first") + (F.col("at_second") - F.col("at_first")) * (F.col("place") - F.col("first"))
    wide = both.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, interpolated)).alias(name) for name in shares))
    return groups.join(wide, "g").select(*(F.col(f"__by{k}").alias(c) for k, c in enumerate(by)), "n", "min", "mean", *shares, "max")
