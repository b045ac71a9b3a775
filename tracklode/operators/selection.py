"""Orders, top-k, samples and the greedy stratified selection."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import _c
from ..sources.shared import fresh_path


def seeded_key(seed: int, x) -> Column:
    """Key of a deterministic shuffle."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), _c(x).cast("string")), 256)


def nearest(df: DataFrame, x: str, target: float, k: int, tie: str) -> DataFrame:
    """The k rows whose value is nearest to a target; ties by ``tie``."""
    return df.withColumn("distance", F.abs(F.col(x) - F.lit(target))).orderBy("distance", tie).limit(k)


def largest(df: DataFrame, x: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(x), tie).limit(k)


def short_median_over(df: DataFrame, x: str, tie: str, cutoff: int) -> DataFrame:
    """The shortest row, the middle row of n (place n // 2 from 0) and the shortest strictly over a cutoff.

    The middle is found by counting values, so the table is never sorted as
    a whole in one task.
    """
    # Rows a value; the running count needs one row a distinct value only.
    order = F.struct(F.col(x), F.col(tie))
    n = df.count()
    shortest = df.orderBy(x, tie).limit(1).withColumn("which", F.lit("shortest"))
    over = df.filter(F.col(x) > cutoff).orderBy(x, tie).limit(1).withColumn("which", F.lit("over"))
    if n == 0:
        return shortest.unionByName(over)
    cut = df.agg(F.percentile(x, F.lit(0.0 if n == 1 else (n // 2) / (n - 1))).alias("m")).first()["m"]
    value = round(cut) if df.schema[x].dataType.typeName() in ("integer", "long", "short", "byte") else cut
    below = df.filter(F.col(x) < value).count()
    middle = df.filter(F.col(x) == value).orderBy(order).limit(n // 2 - below + 1).orderBy(F.desc(order)).limit(1).withColumn("which", F.lit("median"))
    return shortest.unionByName(middle).unionByName(over)


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with each row's place, from 0, in a total order.

    Rows are sorted in ranges and numbered inside each; the ranges' counts,
    one row a range, give their offsets.  The sorted rows are written once, as
    ranges drawn a second time may be cut elsewhere.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "ranked")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    df.orderBy(*order).select("*", F.spark_partition_id().alias("__range"), inside.alias("__inside")).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__start"))
    return rows.join(F.broadcast(starts), "__range").withColumn(out, F.col("__start") + F.col("__inside")).drop("__range", "__inside", "__start")


def sample_strata(df: DataFrame, stratum: str, order: str, k: int, seed: int) -> DataFrame:
    """k rows of each stratum: the places Python's ``random.Random(seed).sample`` picks from the stratum in order, strata in order of name."""
    return pick_samples(df, stratum, [F.col(order)], k, seed, None)


def pick_samples(df: DataFrame, stratum: str, order: list[Column], k: int, seed: int, names: list | None) -> DataFrame:
    """As ``sample_strata``, with one generator running through the strata in the order of ``names``.

    Only the strata's sizes and the picked places, k a stratum, are on the driver.
    """
    spark = df.sparkSession
    placed = ranked(df, [F.col(stratum), *order], "__place")
    sizes = {r[stratum]: (r["n"], r["first"]) for r in placed.groupBy(stratum).agg(F.count("*").alias("n"), F.min("__place").alias("first")).collect()}
    rng = random.Random(seed)
    picks = []
    for name in sorted(sizes) if names is None else names:
        n, first = sizes.get(name, (0, 0))
        picks += [(first + at,) for at in rng.sample(range(n), min(k, n))]
    chosen = spark.createDataFrame(picks, "__place bigint")
    return placed.join(F.broadcast(chosen), "__place", "left_semi").drop("__place")  # at most k rows a stratum


#: Wanted numbers by stratum and by special trait of the pilot sample; fixed values.
TARGETS = {
    "action_position": {"early": 40, "middle": 40, "late": 40},
    "query_position": {"single": 4, "first": 38, "middle": 40, "last": 38},
    "action_query_count": {"single": 4, "2": 32, "3": 42, ">3": 42},
    "result_characteristic": {"high_query_term_coverage": 40, "partial_query_term_coverage": 40, "weak_query_term_coverage": 40},
}
SPECIALS = {"verification_candidate": 20, "already_resolved_candidate": 20, "high_history_similarity": 20, "action_level_disagreement_related": 15}


def greedy_pilot(units: DataFrame, count: int, seed: int) -> DataFrame:
    """``unit_id, place``: a pilot sample, one unit a trajectory, by the deficits of its strata.

    Rare single-query units come first, then units near known disagreements up
    to their quota (which may pass ``count``), then always the unit that fills
    the largest deficits; ties go to the greater seeded hash.  Each choice
    depends on all before it, so each is one grouped maximum over the units:
    the driver holds the chosen rows and the strata's counts, nothing else.
    """
    spark = units.sparkSession
    columns = ["unit_id", "trajectory_id", "source_action_query_count", "action_idx", "leaks", *TARGETS, *SPECIALS]
    pool = units.select(*columns).persist()
    chosen: list = []
    have = {name: Counter() for name in TARGETS}
    special: Counter = Counter()

    def take(u) -> None:
        chosen.append(u)
        for name in TARGETS:
            have[name][u[name]] += 1
        special.update(name for name in SPECIALS if u[name])

    def unused(df: DataFrame) -> DataFrame:
        return df.filter(~F.col("trajectory_id").isin([u["trajectory_id"] for u in chosen])) if chosen else df

    def first_by_key(df: DataFrame, n: int, limit: int) -> list:
        """The first unit of each trajectory in the order of a seeded hash."""
        keyed = df.withColumn("__key", seeded_key(n, "unit_id"))
        first = keyed.groupBy("trajectory_id").agg(F.min_by(F.struct(*columns, "__key"), "__key").alias("u")).select("u.*")
        return first.orderBy("__key").limit(limit).collect()  # at most `limit` rows

    for u in first_by_key(pool.filter("source_action_query_count = 1"), seed, count):
        take(u)
    related = "action_level_disagreement_related"
    quota = SPECIALS[related] - special[related]
    if quota > 0:
        for u in first_by_key(unused(pool.filter(F.col(related) & ~F.col("leaks"))), seed + 1, quota):
            take(u)
    while len(chosen) < count:
        worth = F.lit(0.0)
        for name, goal in TARGETS.items():
            of = F.lit(None).cast("double")
            for value, target in goal.items():
                of = F.when(F.col(name) == value, max(0, target - have[name][value]) / max(1, target)).otherwise(of)
            worth = worth + of
        for name, target in SPECIALS.items():
            worth = worth + F.when(F.col(name), 1.5 * max(0, target - special[name]) / max(1, target)).otherwise(0.0)
        worth = worth + F.when(F.col("action_idx") > 1, 0.02).otherwise(0.0)
        best = unused(pool.filter(~F.col("leaks"))).agg(F.max_by(F.struct(*columns), F.struct(worth.alias("worth"), seeded_key(seed + len(chosen), "unit_id").alias("tie"))).alias("u")).first()["u"]
        if best is None:
            raise ValueError("too few trajectories for the requested count")
        take(best)
    pool.unpersist()
    return spark.createDataFrame([(u["unit_id"], k) for k, u in enumerate(chosen)], "unit_id string, place long")
