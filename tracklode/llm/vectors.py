"""Operator 10: near-duplicate embeddings by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and cut into
steps of ``WIDTH``; ``PROJECTIONS`` steps make the bucket of one of ``TABLES``
tables.  At a cosine of 0.9 a pair shares a bucket in at least one table with
probability 0.998, at 0.95 with more than 0.999999.

1. Equal vectors become one class.
2. ``FIRST`` of the tables pair each class with the first of its bucket.  Exact
   cosines in double precision give links, links give components, so that a
   group of very many near copies is (nearly) one component from here on.
3. In all tables each class is paired with the first ``PIVOTS`` of its bucket
   that stand in another component.  Only links between components are kept,
   one a pair of components; a 128-bit sign sketch that comes with each row
   drops pairs far from the threshold before they are written.
4. Buckets with more classes, in more than one component still, are compared
   as wholes, by pairs of blocks, between components.
5. All links of a vector lie inside its component.  They are counted there by
   blocks of ``BLOCK`` vectors, so no pair is ever written, and a component
   that holds a third of all vectors is spread over tasks.

So pairs are written only between components, and never for all members of a
group.  Components go by 64 bits of a hash in steps 3 and 4.

Null vectors, zero vectors and vectors with null or non-finite components are
linked with nothing, as are vectors of different dimension.  Rows with a null
id count as links of others but name no component.  Repeated rows are copies
like others.  An empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import bucket_pairs, mixed_pairs
from .common import arrow_schema, id_field, materialize, release, struct
from .graph import components

PROJECTIONS, TABLES, FIRST, WIDTH, PIVOTS, BLOCK = 14, 96, 4, 2.0, 16, 256
#: Sketch bits (of 128) that may differ; at a cosine of 0.9, 18 do on average, with a deviation of 4.
FAR_BITS = 40


def directions(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections and shifts of all tables, and the sketch's directions."""
    rng = np.random.default_rng([20240301, dim])
    return rng.standard_normal((dim, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS), rng.standard_normal((dim, 128))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def valid(values) -> bool:
    if values is None or len(values) == 0 or any(x is None for x in values):
        return False
    v = np.asarray(values, np.float64)
    return bool(np.isfinite(v).all() and v.any())


def classes_of(rows: DataFrame, vec_col: str, id_col: str) -> DataFrame:
    """``id_col, cid`` (digest of the vector, null if it links with nothing), ``hi`` and ``vector`` as doubles of each row."""
    schema = T.StructType([id_field(rows, id_col), *struct(("cid", "binary"), ("hi", "bigint"), ("vector", "array<double>"))])
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            vectors = [np.asarray(v, np.float64) + 0.0 if valid(v) else None for v in batch.column(1).to_pylist()]
            digests = [None if v is None else xxhash.xxh3_128_digest(v.tobytes()) for v in vectors]
            his = [d and int.from_bytes(d[:8], "big", signed=True) for d in digests]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out[0].type), pa.array(digests, out[1].type), pa.array(his, out[2].type), pa.array(vectors, out[3].type)], schema=out)

    return rows.select(id_col, F.col(vec_col).alias("__v")).mapInArrow(run, schema)


def table_rows(classes: DataFrame, tables: int = TABLES) -> DataFrame:
    """``key, hi, group, s0, s1``: the bucket of each class in each of the first tables, with its group and its sketch."""
    schema = struct(("key", "bigint"), ("hi", "bigint"), ("group", "bigint"), ("s0", "bigint"), ("s1", "bigint"))
    out = arrow_schema(schema)

    def run(batches):
        known: dict[int, tuple] = {}
        for batch in batches:
            hi, group = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = batch.column(2).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, which in by_dim.items():
                if dim not in known:
                    known.clear()
                    known[dim] = directions(dim)
                lines, shifts, signs = known[dim]
                lines, shifts = lines[:, : tables * PROJECTIONS], shifts[: tables * PROJECTIONS]
                mult = np.random.default_rng([7, dim]).integers(1, 1 << 63, PROJECTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                for at in range(0, len(which), 256):
                    part = which[at : at + 256]
                    v = unit(np.array([vectors[i] for i in part]))
                    steps = np.floor((v @ lines + shifts) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(part), tables, PROJECTIONS)
                    h = np.broadcast_to(np.arange(tables, dtype=np.uint64) + np.uint64(dim * TABLES), (len(part), tables)).copy()
                    for k in range(PROJECTIONS):
                        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + steps[:, :, k] * mult[k]
                    h ^= h >> np.uint64(32)
                    bits = np.packbits(v @ signs > 0, axis=1).view(np.int64)
                    each = lambda x: pa.array(np.repeat(x, tables))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64).ravel()), each(hi[part]), each(group[part]), each(bits[:, 0]), each(bits[:, 1])], schema=out)

    return classes.select("hi", group_id().alias("group"), "vector").mapInArrow(run, schema)


def group_id() -> F.Column:
    """A component's label as 64 bits."""
    return F.xxhash64("label")


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of ``group, s0, s1`` are of different groups and not far apart."""
    return (x[:, 0] != y[:, 0]) & (np.bitwise_count((x[:, 1:] ^ y[:, 1:]).view(np.uint64)).sum(1) <= FAR_BITS)


def cosine(x: str, y: str) -> F.Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def confirm(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """``a, b``: labels of classes that a pair of 64-bit ids links by a cosine of ``least`` or more, each once."""
    side = lambda x: classes.select(F.col("hi").alias(x), F.col("label").alias(f"l{x}"), F.col("unit").alias(f"v{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter((F.size("va") == F.size("vb")) & (cosine("va", "vb") >= least))
    return both.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()


def merged(classes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """``classes`` with the labels that hold after the pairs have joined their components."""
    links = materialize(confirm(pairs, classes, least), "links")
    joined = components(links).select(F.col("node").alias("label"), F.col("label").alias("__to"))
    after = classes.join(joined, "label", "left").withColumn("label", F.coalesce("__to", "label")).drop("__to")
    after = materialize(after.select(classes.columns), "vectors")
    release(links)
    return after


def count_links(members: DataFrame, least: float) -> DataFrame:
    """``cid, others``: rows linked with each class inside its component, by pairs of blocks.

    ``members`` has ``cid, label, unit, copies, blocks`` (how many blocks the component has).
    """
    dealt = members.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("cid", "label", "unit", "copies", "block", other)
    dealt = dealt.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "unit", "copies")
    schema = struct(("cid", "binary"), ("others", "bigint"))
    out = arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, copies = table.column("block").to_numpy(), table.column("copies").to_numpy()
        v = np.array(table.column("unit").to_pylist())
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        others = np.zeros(len(block), np.int64)
        linked = v[x] @ v[y].T >= least
        if i == j:
            np.fill_diagonal(linked, False)
            others[x] = linked @ copies[y]
        else:
            others[x] = linked @ copies[y]
            others[y] = linked.T @ copies[x]
        return pa.Table.from_arrays([table.column("cid"), pa.array(others)], schema=out)

    return dealt.groupBy("label", "i", "j").applyInArrow(run, schema).groupBy("cid").agg(F.sum("others").alias("others"))


def near_duplicates(rows: DataFrame, least: float = 0.9, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``id_col, n_links, component_id, kept`` of each row."""
    rows = materialize(classes_of(rows, vec_col, id_col), "vectors")
    one = rows.filter(F.col("cid").isNotNull()).groupBy("cid").agg(F.min(id_col).alias("low"), F.count("*").alias("copies"), F.first("hi").alias("hi"), F.first("vector").alias("vector"))
    scale = F.array_max(F.transform("vector", F.abs))
    scaled = F.transform("vector", lambda x: x / scale)
    norm = F.sqrt(F.aggregate(F.col("scaled"), F.lit(0.0), lambda s, x: s + x * x))
    one = one.withColumn("scaled", scaled).withColumn("unit", F.transform("scaled", lambda x: x / norm)).drop("scaled")
    single = materialize(one.withColumn("label", F.col("cid")), "vectors")

    first = merged(single, bucket_pairs(table_rows(single, FIRST), 1, near, rest=False), least)
    release(single)
    keys = materialize(table_rows(first), "tables")
    classes = merged(first, bucket_pairs(keys, PIVOTS, near, rest=False), least)
    release(first)

    # Buckets with members beyond the pivots that are not in one component: compare what is in different ones.
    large = keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > PIVOTS + 1).select("key")
    now = keys.join(large, "key").drop("group").join(classes.select("hi", group_id().alias("group")), "hi")
    now = materialize(now.select("key", "hi", "group", "s0", "s1"), "tables")
    release(keys)
    several = now.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x <> y").select("key")
    mixed = materialize(now.join(several, "key"), "tables")
    release(now)
    if not mixed.isEmpty():
        before, classes = classes, merged(classes, mixed_pairs(mixed, near, BLOCK), least)
        release(before)
    release(mixed)

    sizes = classes.groupBy("label").agg(F.count("*").alias("members")).filter("members > 1")
    sizes = sizes.select("label", F.ceil(F.col("members") / BLOCK).alias("blocks"))
    inside = materialize(classes.select("cid", "low", "unit", "copies", "label").join(sizes, "label"), "inside")
    lows = inside.groupBy("label").agg(F.min("low").alias("component_id"))
    counted = count_links(inside.drop("low"), least).join(inside.select("cid", "label"), "cid").join(lows, "label").select("cid", "others", "component_id")
    done = classes.select("cid", "low", "copies").join(counted, "cid", "left")
    done = materialize(done.select("cid", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id")), "done")
    good = rows.filter(F.col("cid").isNotNull()).select(id_col, "cid").join(done, "cid").select(id_col, "n_links", "component_id")
    rest = rows.filter(F.col("cid").isNull()).select(id_col, F.lit(0).cast("bigint").alias("n_links"), F.col(id_col).alias("component_id"))
    return good.unionByName(rest).select(id_col, "n_links", "component_id", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN low ON low.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
