"""Positions of rows in a total order inside groups, without a task that holds a whole group.

Rows are dealt by range over (group, order), so that a group of any size spreads
over many partitions; each (partition, group) cell is counted, and running
sums of those counts turn places inside a cell into places inside the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, release


def ranked(df: DataFrame, group: str, order: list[str], rank: str = "rank", total: str = "n", sums: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``df`` with ``rank`` (from 0, by ``order``) and ``total`` rows of its group, written to the scratch folder.

    ``group`` must not be null; nulls come first in ``order``.  Rows equal in
    ``order`` are told apart by their place in the input.  ``sums`` maps a
    numeric column to the names of its running sum before each row and of its
    sum over the group.
    """
    sums = sums or {}
    keys = [group, *order, "__tie"]
    dealt = df.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys).sortWithinPartitions(*keys)
    written = materialize(dealt.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "dealt")
    dealt = written.withColumn("__part", F.shiftright("__at", 33))
    cell = [F.min("__at").alias("__first"), F.count("*").alias("__n"), *(F.sum(c).alias(f"__sum_{c}") for c in sums)]
    cells = dealt.groupBy("__part", group).agg(*cell)
    before, whole = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(group)
    made = {"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), total: F.sum("__n").over(whole)}
    for c, (_, all_of_it) in sums.items():
        made |= {f"__before_{c}": F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)), all_of_it: F.sum(f"__sum_{c}").over(whole)}
    cells = cells.withColumns(made).drop("__n", *(f"__sum_{c}" for c in sums))
    out = dealt.join(cells, ["__part", group]).withColumn(rank, F.col("__at") - F.col("__first") + F.col("__before"))
    inside = W.partitionBy("__part", group).orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    for c, (so_far, _) in sums.items():
        out = out.withColumn(so_far, F.col(f"__before_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    out = materialize(out.drop("__at", "__part", "__first", "__before", *(f"__before_{c}" for c in sums)), "ranked")
    release(written)
    return out
