"""Operator 4: near-duplicate documents by MinHash with tensored banding.

Two small collections of ``SIDE`` half-keys (``HALF`` minhashes each) are
computed per document, and a table key is a pair of one half-key from each:
SIDE * SIDE tables from 2 * SIDE * HALF minhashes.  Links are confirmed on the
full shingle sets.

1. Equal shingle sets become one class (grouped minimum; copies never pair).
2. Classes are dealt by table key and sorted; inside a bucket every class is
   paired with the first ``PIVOTS`` classes, so a bucket of n makes at most
   PIVOTS * n candidates, and small buckets are covered completely.
3. Candidates whose sketches differ too much in size, or agree in almost no
   half-key, are dropped before they are written; the rest are confirmed on
   full sets.
4. Classes of larger buckets that did not all end up in one component are
   compared exactly, block by block, only across components: what stands
   outside the main component around a bucket's first class meets all that
   stands around it, and nothing but links leaves a pair of blocks.
5. Components of confirmed links.

A text without words, a null text or a null id is linked with nothing; its
``component_id`` is its own id.  Ties do not arise: ids are compared by value,
and rows with equal ids and texts are treated alike.  An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import apart, bucket_pairs
from .common import arrow_schema, id_field, map_rows, materialize, release, struct
from .graph import components

SIDE, HALF, PIVOTS = 9, 2, 2
#: Bits of each half-key in the sketch that comes with a table row, and in how many of the 2 * SIDE a likely pair agrees.
#: At a similarity of 0.8, 12 agree on average and fewer than 5 about once in 50,000 pairs.
FIELD, AGREE = 3, 5
#: Classes and shingles of a block in the exact comparison around a pivot.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Sizes are compared as logarithms of this base; similarity 0.8 allows a ratio of 1.25, under 5 steps.
SIZE_BASE = 1.05

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(1, 1 << 63, 2 * SIDE * HALF, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, 2 * SIDE * HALF, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Distinct shingle hashes of texts; words are runs of characters other than blank and TAB..CR, with A-Z lower-cased."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        width = min(self.width, len(words))
        n = len(words) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = mix(out * _MIX + h[k : k + n])
        return np.unique(out)


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x 2 * SIDE) half-keys; all sets must have members."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    lows = [np.minimum.reduceat(joined * a + b, starts) for a, b in zip(_ODD, _ADD, strict=True)]
    return np.stack([mix(fold(lows[k * HALF : (k + 1) * HALF], k)) for k in range(2 * SIDE)], 1).astype(np.int64)


def fold(lows: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(len(lows[0]), salt + 1, np.uint64)
    for x in lows:
        h = mix(h * _MIX + x)
    return h


def signatures(docs: DataFrame, width: int, text_col: str, id_col: str) -> DataFrame:
    """``id_col, text_hash, n, cid`` (digest of the set), ``hi`` (64 bits of it) and the half-keys of each row."""
    schema = T.StructType([id_field(docs, id_col), *struct(("text_hash", "bigint"), ("n", "bigint"), ("cid", "binary"), ("hi", "bigint"), ("halves", "array<bigint>"))])

    def make():
        shingle = Shingler(width)

        def f(cols):
            sets = [shingle(t) for t in cols["__text"]]
            some = [s for s in sets if len(s)]
            keys = iter(half_keys(some).tolist() if some else ())
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            return {
                id_col: cols[id_col],
                "text_hash": cols["text_hash"],
                "n": [len(s) for s in sets],
                "cid": digests,
                "hi": [d and int.from_bytes(d[:8], "big", signed=True) for d in digests],
                "halves": [next(keys) if len(s) else None for s in sets],
            }

        return f

    return map_rows(docs.select(id_col, F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("text_hash")), make, schema)


def table_keys(classes: DataFrame) -> DataFrame:
    """``key, hi, sketch``: one row for each pair of a half-key of the first collection and one of the second.

    The sketch holds the size of the set (10 bits) and FIELD bits of each half-key.
    """
    first = F.slice("halves", 1, SIDE)
    second = F.slice("halves", SIDE + 1, SIDE)
    pairs = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x, y))))
    size = F.least(F.floor(F.log("n") / math.log(SIZE_BASE)), F.lit(1023)).cast("bigint")
    sketch = F.aggregate("halves", size, lambda s, h: F.shiftleft(s, FIELD).bitwiseOR(h.bitwiseAND(F.lit((1 << FIELD) - 1))))
    return classes.select(F.explode(pairs).alias("key"), "hi", sketch.alias("sketch"))


def likely(share: tuple[int, int]):
    """In how many half-keys two sketches agree, or 0 if they can hardly belong to sets that reach the similarity."""
    steps = math.floor(math.log(share[1] / share[0]) / math.log(SIZE_BASE)) + 1
    bits = 2 * SIDE * FIELD

    def keep(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = x[:, 0].view(np.uint64), y[:, 0].view(np.uint64)
        size = np.abs((x >> np.uint64(bits)).astype(np.int64) - (y >> np.uint64(bits)).astype(np.int64)) <= steps
        differ = x ^ y
        agree = np.zeros(len(x), np.int64)
        for k in range(2 * SIDE):
            agree += (differ >> np.uint64(k * FIELD)) & np.uint64((1 << FIELD) - 1) == 0
        return np.where(size & (agree >= AGREE), agree, 0)

    return keep


def confirm(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``a, b`` (digests) of the pairs (``a, b`` as 64-bit ids) whose sets reach the similarity."""
    num, den = share
    mine = pairs.join(sets.select(F.col("hi").alias("b"), F.col("cid").alias("cb"), F.col("members").alias("mb")), "b")
    mine = mine.join(sets.select(F.col("hi").alias("a"), F.col("cid").alias("ca"), F.col("members").alias("ma")), "a").select("ca", "cb", "ma", "mb")
    both = F.size(F.array_intersect("ma", "mb"))
    return mine.filter(den * both >= num * (F.size("ma") + F.size("mb") - both)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def needed_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int, text_col: str, id_col: str) -> DataFrame:
    """``hi, cid, members`` of the classes in ``ids``, from one text of each."""
    wanted = classes.join(ids, "hi", "left_semi").select(F.col("row.id").alias("__id"), F.col("row.text_hash").alias("text_hash"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("text_hash"))
    texts = texts.join(wanted, ["__id", "text_hash"], "left_semi").dropDuplicates(["__id", "text_hash"])
    schema = struct(("hi", "bigint"), ("cid", "binary"), ("members", "array<bigint>"))

    def make():
        shingle = Shingler(width)

        def f(cols):
            sets = [np.sort(shingle(t).view(np.int64)) for t in cols["__text"]]
            digests = [xxhash.xxh3_128_digest(np.sort(s.view(np.uint64)).tobytes()) for s in sets]
            return {"hi": [int.from_bytes(d[:8], "big", signed=True) for d in digests], "cid": digests, "members": sets}

        return f

    return map_rows(texts.select("__text"), make, schema)


def outsiders(large: DataFrame, label: DataFrame) -> DataFrame:
    """``a, hi, label, minor, left, right`` of the classes around each pivot ``a`` of large buckets, where they lie in more than one component.

    A pivot stands for the buckets it is the first member of.  ``minor`` marks
    what lies outside the most frequent component around a pivot: of two
    classes that were not compared, and are still apart, at least one is so
    marked.  ``left`` and ``right`` say into how many blocks of about BLOCK
    classes and BLOCK_SHINGLES shingles the minor classes and all of them go.
    """
    side = lambda x: label.select(F.col("hi").alias(x), "n", F.col("label").alias("lb"))
    around = large.select("a", "b").join(side("b"), "b").unionByName(large.select("a").distinct().join(side("a"), "a").withColumn("b", F.col("a")))
    around = materialize(around, "around")
    blocks = lambda rows, weight: F.greatest(F.ceil(rows / BLOCK), F.ceil(weight / BLOCK_SHINGLES), F.lit(1))
    each = around.groupBy("a", "lb").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    main = each.groupBy("a").agg(F.max(F.struct("k", "lb", "n")).alias("main"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("labels")).filter("labels > 1")
    main = main.select("a", "main.lb", blocks(F.col("k") - F.col("main.k"), F.col("n") - F.col("main.n")).alias("left"), blocks(F.col("k"), F.col("n")).alias("right"))
    mixed = around.withColumnRenamed("lb", "label").join(main, "a")
    return mixed.select("a", F.col("b").alias("hi"), "label", (F.col("label") != F.col("lb")).alias("minor"), "left", "right")


def block_links(own: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``a, b`` (digests): confirmed links between components around each pivot, by pairs of blocks.

    The minor classes around a pivot meet all classes around it.  Both sides
    are dealt into blocks, so a pivot with very many classes is spread over
    tasks; a pair of blocks is compared through the sorted shingles of one
    side, and only links come out, one for a minor class and a component.
    """
    # A class is a row of the right side in each block of the left, and if it is minor also the other way round.
    place = lambda c: F.pmod(F.xxhash64("hi"), F.col(c))
    upto = lambda c: F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1)
    at = lambda i, j, is_left: F.struct(i.alias("i"), j.alias("j"), F.lit(is_left).alias("is_left"))
    right = F.transform(upto("left"), lambda i: at(i, place("right"), False))
    left = F.filter(F.transform(upto("right"), lambda j: at(place("left"), j, True)), lambda _: F.col("minor"))
    each = own.join(sets, "hi").withColumn("at", F.explode(F.concat(right, left)))
    each = each.select("a", "hi", "label", "minor", "cid", "members", "at.*")
    schema = struct(("a", "binary"), ("b", "binary"))
    out = arrow_schema(schema)
    num, den = share

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("is_left").to_numpy()
        xs, ys = table.filter(pa.array(side)).combine_chunks(), table.filter(pa.array(~side)).combine_chunks()
        found: list[tuple[bytes, bytes]] = []
        if len(xs) and len(ys):
            x_label, x_cid, y_cid = xs.column("label").to_pylist(), xs.column("cid").to_pylist(), ys.column("cid").to_pylist()
            codes: dict[bytes, int] = {}
            y_label = np.array([codes.setdefault(v, len(codes)) for v in ys.column("label").to_pylist()])
            x_hi, y_hi, y_minor = xs.column("hi").to_numpy(), ys.column("hi").to_numpy(), ys.column("minor").to_numpy()
            y_values, y_at = flat(ys.column("members"))
            y_size = np.diff(y_at)
            owner = np.repeat(np.arange(len(ys)), y_size)
            order = np.argsort(y_values, kind="stable")
            y_values, owner = y_values[order], owner[order]
            x_values, x_at = flat(xs.column("members"))
            low, high = np.searchsorted(y_values, x_values, "left"), np.searchsorted(y_values, x_values, "right")
            for k in range(len(xs)):
                lo, n_hits = low[x_at[k] : x_at[k + 1]], (high - low)[x_at[k] : x_at[k + 1]]
                hits = np.arange(n_hits.sum()) + np.repeat(lo - (np.cumsum(n_hits) - n_hits), n_hits)
                both = np.bincount(owner[hits], minlength=len(ys))
                linked = den * both >= num * (len(lo) + y_size - both)
                # Of two minor classes either meets the other once as the left side.
                linked &= (y_label != codes.get(x_label[k], -1)) & (~y_minor | (x_hi[k] < y_hi))
                hit = np.flatnonzero(linked)
                for y in hit[np.unique(y_label[hit], return_index=True)[1]]:
                    found.append((x_cid[k], y_cid[y]))
        return pa.Table.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], schema=out)

    return each.groupBy("a", "i", "j").applyInArrow(compare, schema)


def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and borders of a column of lists."""
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.array([len(x) for x in whole], np.int64) if whole.null_count else np.diff(whole.offsets.to_numpy())
    return whole.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)]


def near_duplicates(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of each row; similarity is share[0] / share[1] or more."""
    rows = materialize(signatures(docs, width, text_col, id_col), "signatures")
    linked = rows.filter((F.col("n") > 0) & F.col(id_col).isNotNull())
    classes = linked.groupBy("cid").agg(F.min(F.struct(F.col(id_col).alias("id"), "text_hash")).alias("row"), F.first("hi").alias("hi"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    classes = materialize(classes.withColumn("low", F.col("row.id")), "classes")

    found = materialize(bucket_pairs(table_keys(classes), PIVOTS, likely(share)), "candidates")

    close = found.filter("likely > 0")
    ids = close.select(F.explode(F.array("a", "b")).alias("hi")).distinct()
    sets = materialize(needed_sets(docs, classes, ids, width, text_col, id_col), "sets")

    # First each class with its likeliest partner; then the pairs that are still apart.
    star = close.groupBy("b").agg(F.max(F.struct("likely", "a")).alias("a")).select("a.a", "b")
    links = materialize(confirm(star, sets, share), "confirmed")
    label = materialize(labels(classes, components(links)), "labels")
    links = materialize(links.unionByName(confirm(apart(close, label), sets, share)), "confirmed")
    label = materialize(labels(classes, components(links)), "labels")

    # Large buckets with more than one component: compare exactly what is outside a bucket's main component with all its members.
    own = materialize(outsiders(found.filter("large"), label), "outsiders")
    if not own.isEmpty():
        sets = materialize(needed_sets(docs, classes, own.select("hi").distinct(), width, text_col, id_col), "sets")
        links = materialize(links.unionByName(block_links(own, sets, share)), "confirmed")
    joined = components(links)

    lows = classes.select("cid", "low").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    lows = materialize(lows.select("cid", "low", F.coalesce("label", "cid").alias("label")), "lows")
    smallest = lows.filter("label <> cid").select("label").distinct()
    shared = lows.join(smallest, "label", "left_semi").groupBy("label").agg(F.min("low").alias("component_id"))
    lows = materialize(lows.join(shared, "label", "left").select("cid", F.coalesce("component_id", "low").alias("component_id")), "lows")
    done = linked.select(id_col, "n", "cid").join(lows, "cid").select(id_col, "n", "component_id")
    rest = rows.filter((F.col("n") == 0) | F.col(id_col).isNull()).select(id_col, "n", F.col(id_col).alias("component_id"))
    return done.unionByName(rest).select(id_col, F.col("n").alias("n_shingles"), "component_id", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"))


def labels(classes: DataFrame, joined: DataFrame) -> DataFrame:
    """``hi, n, label`` of the classes; a class without links is its own label."""
    return classes.select("hi", "n", "cid").join(joined.withColumnRenamed("node", "cid"), "cid", "left").select("hi", "n", F.coalesce("label", "cid").alias("label"))


#: The exact rule by all shared shingles and a transitive closure, for shingles of four words at 0.8.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s FROM words),
held AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS n FROM held a JOIN held b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * n >= 80 * (na + nb - n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS id, doc_id AS c FROM documents WHERE doc_id IS NOT NULL UNION SELECT ways.b, reached.c FROM reached JOIN ways ON ways.a = reached.id),
lowest AS (SELECT id, min(c) AS c FROM reached GROUP BY id)
SELECT doc_id, len(s) AS n_shingles, c AS component_id, coalesce(doc_id = c, true) AS kept FROM sets LEFT JOIN lowest ON id = doc_id"""
