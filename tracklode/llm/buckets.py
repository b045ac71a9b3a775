"""Candidate pairs inside hash buckets, streamed over sorted rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, struct


def bucket_pairs(keys: DataFrame, pivots: int, keep=None, rest: bool = True) -> DataFrame:
    """``a, b, large, likely``: every member of a bucket with each of the bucket's first ``pivots`` members.

    ``keys`` has ``key, hi`` and maybe further bigint columns.  A bucket of n
    gives at most pivots * n pairs and one of up to pivots + 1 members all of
    them; in larger buckets ``large`` marks the pairs of the first member, so
    that each member beside it is named once for the bucket.
    ``keep(x, y)`` gets the further columns of both sides and says how likely
    pairs are (0: not); the greatest value is given.  Unlikely pairs are given
    only if they are large, as later steps look at them, and not at all without
    ``rest``.

    Rows arrive sorted by key, so a bucket is one run.  Only its first members
    are held, however long it is.
    """
    schema = struct(("a", "bigint"), ("b", "bigint"), ("large", "boolean"), ("likely", "int"))
    out = arrow_schema(schema)

    def run(batches):
        key, held, before = None, None, 0
        for batch in batches:
            columns = np.stack([c.to_numpy() for c in batch.columns], 1)
            if not len(columns):
                continue
            ks = columns[:, 0]
            edges = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]])
            sizes = np.diff(np.r_[edges, len(ks)])
            # Members held from the batch before stand in front of this batch's first run; ``gap`` more were passed over.
            same = ks[0] == key
            ahead = len(held) if same else 0
            gap = before - ahead if same else 0
            rows = np.concatenate([held, columns]) if ahead else columns
            starts = np.r_[0, edges[1:] + ahead]
            skip = np.zeros(len(edges), np.int64)
            skip[0] = ahead
            total = sizes + skip
            long = total > pivots
            long[0] |= total[0] + gap > pivots
            for p in range(pivots):
                # Every new member after place p pairs with the member at place p.  The first member's pairs with
                # other pivots held from before come again: the bucket may be a large one only by now.
                first = np.maximum(p + 1, skip * (p > 0))
                n = np.maximum(total - first, 0)
                which = np.repeat(np.arange(len(edges)), n)
                if not len(which):
                    continue
                place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
                a, b = rows[starts[which] + p], rows[starts[which] + place]
                large = long[which] if p == 0 else np.zeros(len(which), bool)
                likely = (keep(a[:, 2:], b[:, 2:]) if keep else np.ones(len(a))).astype(np.int32)
                some = (likely > 0) | large if rest else likely > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (a[:, 1], b[:, 1], large, likely)], schema=out)
            last = int(total[-1])
            before = last + (gap if len(edges) == 1 else 0)
            key, held = ks[-1], rows[starts[-1] : starts[-1] + min(last, pivots)].copy()

    pairs = keys.repartition("key").sortWithinPartitions("key", "hi").mapInArrow(run, schema)
    return pairs.groupBy("a", "b").agg(F.max("large").alias("large"), F.max("likely").alias("likely"))


def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """``a, b`` of the pairs whose sides have different labels; ``label`` has ``hi, label``."""
    side = lambda x: label.select(F.col("hi").alias(x), F.col("label").alias(f"l{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter("la <> lb").select("a", "b")


def mixed_pairs(keys: DataFrame, keep, block: int) -> DataFrame:
    """``a, b`` of all pairs inside the buckets of ``keys`` that ``keep(x, y)`` says are likely.

    ``keys`` has ``key, hi`` and further bigint columns, which ``keep`` gets.  A
    bucket is dealt into blocks of about ``block`` members and each pair of
    blocks is a run of its own, so a bucket of any length is spread over tasks
    and a task holds two blocks.
    """
    columns = keys.columns[1:]
    blocks = keys.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = keys.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("hi"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *columns)
    schema = struct(("a", "bigint"), ("b", "bigint"))
    out = arrow_schema(schema)

    def compare(rows: np.ndarray) -> pa.RecordBatch:
        """Whole runs: each row with the rows behind it, at every distance at once."""
        starts = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)])
        end = np.repeat(np.r_[starts[1:], len(rows)], np.diff(np.r_[starts, len(rows)]))
        at, ahead, found = np.arange(len(rows)), 1, []
        while len(at := at[at + ahead < end[at]]):
            x, y = rows[at], rows[at + ahead]
            met = ((x[:, 1] == x[:, 2]) | (x[:, 3] != y[:, 3])) & keep(x[:, 5:], y[:, 5:])
            found.append(np.stack([x[met, 4], y[met, 4]], 1))
            ahead += 1
        pairs = np.concatenate([np.empty((0, 2), np.int64), *found])
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=out)

    def run(batches):
        held = None
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], 1)
            rows = rows if held is None else np.concatenate([held, rows])
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield compare(rows[:cut])
            held = rows[cut:]
        if held is not None and len(held):
            yield compare(held)

    order = ("key", "i", "j")
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema).distinct()
