"""Operator 11: Merkle manifest of a dataset, by fractal traversal of aligned blocks.

Every row is a leaf, the SHA-256 of its fields (each as byte count, ``:``,
value; ``-`` if null).  The leaves of a group ascend by id; while there are
several nodes, every ``ARITY`` consecutive ones become the hash of their hex
digests.  The subroots, ordered by group (null first, bytewise), likewise
become the root.

1. Leaves get their rank inside their group without gathering the group (``ranks``).
2. A block of ``ARITY ** HEIGHT`` aligned leaves is traversed in one task: for
   each band of ``BAND`` levels it keeps one finished subtree, which the paths
   are read from, and grows the next one by a leaf a step, with a stack of
   unfinished runs; so it emits path after path and holds a few subtrees.
3. Block roots are the leaves of the next pass, until each group has one node;
   the subroots are traversed as one more group.  Paths of the upper passes are
   joined below those of their blocks, from the top down.

A proof is the raw digests of the siblings, level by level, left to right; how
many there are on each level follows from rank and size.  Null ids are leaves
like others and come first; equal rows are leaves of their own, in any order;
a null or empty text is a field like others, and a text of any length is
hashed as one value by the JVM.  Extra columns are neither hashed nor
returned, so their names cannot clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, materialize, small_batches, struct
from .ranks import ranked

#: Children of a node; fixed value of the format.
ARITY = 3
#: Levels of a block (729 leaves), and of a band inside it.
HEIGHT, BAND = 6, 2
#: Rows that a task hands on at a time.
ROWS_OUT = 2_000

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def node(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


class Growth:
    """A subtree over leaves ``at`` to ``stop`` that grows by a leaf a step; its nodes on levels ``low`` to ``top`` are kept."""

    def __init__(self, leaves: list[bytes], at: int, stop: int, low: int, top: int):
        self.leaves, self.at, self.stop, self.low, self.top = leaves, at, stop, low, top
        self.kept: list[list[bytes]] = [[] for _ in range(low, top + 1)]
        self.runs: list[list[bytes]] = [[] for _ in range(top)]

    def push(self, level: int, digest: bytes) -> None:
        while True:
            if level >= self.low:
                self.kept[level - self.low].append(digest)
            if level == self.top:
                return
            run = self.runs[level]
            run.append(digest)
            if len(run) < ARITY:
                return
            digest = node(run)
            run.clear()
            level += 1

    def step(self) -> None:
        if self.at < self.stop:
            self.push(0, self.leaves[self.at])
            self.at += 1
            if self.at == self.stop:
                for level, run in enumerate(self.runs):  # the last run of a level may be short
                    if run:
                        digest = node(run)
                        run.clear()
                        self.push(level + 1, digest)

    def finish(self) -> Growth:
        while self.at < self.stop:
            self.step()
        return self


def traverse(leaves: list[bytes], height: int) -> tuple[bytes, Iterator[bytes]]:
    """The node ``height`` levels above ``leaves``, and the siblings on the way there of one leaf after the other."""
    if not height:
        return leaves[0], iter([b""] * len(leaves))
    bands = [(low, min(low + BAND, height)) for low in range(0, height, BAND)]
    grow = lambda k, at: Growth(leaves, at, min(at + ARITY ** bands[k][1], len(leaves)), *bands[k])
    existing = [grow(k, 0).finish() for k in range(len(bands))]
    root = existing[-1].kept[-1][0]

    def paths() -> Iterator[bytes]:
        desired = [grow(k, ARITY**top) if ARITY**top < len(leaves) else None for k, (_, top) in enumerate(bands)]
        for leaf in range(len(leaves)):
            path = []
            for k, (low, top) in enumerate(bands):
                span = ARITY**top
                if leaf and leaf % span == 0:
                    existing[k] = desired[k].finish()
                    desired[k] = grow(k, leaf + span) if leaf + span < len(leaves) else None
                inside = leaf % span
                for level in range(low, top):
                    at = inside // ARITY**level
                    run = at - at % ARITY
                    nodes = existing[k].kept[level - low]
                    path += nodes[run:at] + nodes[at + 1 : run + ARITY]
            yield b"".join(path)
            for growth in desired:
                if growth:
                    growth.step()

    return root, paths()


def levels(n: int) -> int:
    """Levels above ``n`` nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def climb_once(nodes: DataFrame, carried: list[str], most: int) -> DataFrame:
    """``grp, rank, n, *carried`` with ``path`` inside the block, and ``top`` (the block's root) in the first row of a block."""
    names = ["grp", "rank", "n", *carried]
    schema = T.StructType([nodes.schema[c] for c in names] + list(struct(("path", "binary"), ("top", "binary"))))
    out, size = arrow_schema(schema), ARITY**most
    small_batches(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, paths, tops = [], [], []  # slices of whole blocks
        parts, leaves, block, height = [], [], None, 0

        def close():
            nonlocal parts, leaves
            if leaves:
                root, found = traverse(leaves, height)
                ready.extend(parts)
                paths.extend(found)
                tops.extend([root, *[None] * (len(leaves) - 1)])
            parts, leaves = [], []

        def made():
            table = pa.Table.from_batches(ready).select(names).combine_chunks()
            columns = [*(table.column(k).combine_chunks() for k in range(len(names))), pa.array(paths, out.field("path").type), pa.array(tops, out.field("top").type)]
            ready.clear(), paths.clear(), tops.clear()
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            since = 0
            for at, (grp, rank, n, digest) in enumerate(zip(get("grp"), get("rank"), get("n"), get("digest"), strict=True)):
                if (grp, rank // size) != block:
                    if at > since:
                        parts.append(batch.slice(since, at - since))
                    close()
                    since, block, height = at, (grp, rank // size), min(most, levels(n))
                    if len(paths) >= ROWS_OUT:
                        yield made()
                leaves.append(digest)
            if batch.num_rows > since:
                parts.append(batch.slice(since))
        close()
        if ready:
            yield made()

    dealt = nodes.withColumn("__block", F.expr(f"rank div {size}")).repartition("grp", "__block").sortWithinPartitions("grp", "rank").drop("__block")
    return dealt.mapInArrow(run, schema)


def climb(nodes: DataFrame, carried: list[str], height: int) -> list[DataFrame]:
    """Passes of blocks from ``grp, rank, n, digest, *carried`` up to one node a group."""
    size, passes = ARITY**height, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        passes.append(materialize(climb_once(nodes, carried, height), "paths"))
        if most <= size:
            return passes
        above = passes[-1].filter(f"top IS NOT NULL AND n > {size}")
        nodes = above.select("grp", F.expr(f"rank div {size}").alias("rank"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("digest"))
        carried, most = [], -(-most // size)


def finished(done: DataFrame, height: int) -> DataFrame:
    """``grp, subroot`` of the groups that end in this pass."""
    return done.filter(f"top IS NOT NULL AND n <= {ARITY**height}").select("grp", F.col("top").alias("subroot"))


def descend(passes: list[DataFrame], ends: DataFrame, height: int) -> DataFrame:
    """The rows of the first pass with whole paths, and with the columns that ``ends`` has for their group."""
    size, more = ARITY**height, [c for c in ends.columns if c != "grp"]
    above = None
    for done in reversed(passes):
        blocks = finished(done, height).select("grp").join(ends, "grp").select("grp", F.lit(0).cast("bigint").alias("__block"), F.lit(b"").alias("__above"), *more)
        if above is not None:
            blocks = blocks.unionByName(above.select("grp", F.col("rank").alias("__block"), F.col("path").alias("__above"), *more))
        rows = done.drop("top").withColumn("__block", F.expr(f"rank div {size}"))
        above = rows.join(blocks, ["grp", "__block"]).withColumn("path", F.concat("path", "__above")).drop("__block", "__above")
    return above


def leaf_hash(values: list[Column]) -> Column:
    """Hex SHA-256 of the fields."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, also: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """One row a leaf: id, ``leaf``, ``subroot``, ``root`` (hex), ``proof`` (hex of all siblings up to the root), ``rank, n`` in the group, ``group_rank, n_groups``.

    ``also`` adds binary columns, computed where the leaf is.
    """
    also = also or {}
    grp = F.coalesce(F.concat(F.lit("v"), F.col(group_col).cast("string")), F.lit(""))  # null first, else bytewise
    leaves = docs.select(F.col(id_col).alias("id"), grp.alias("grp"), F.unhex(leaf_hash([F.col(c) for c in fields])).alias("digest"), *(v.alias(k) for k, v in also.items()))
    carried = ["id", "digest", *also]
    passes = climb(ranked(leaves, "grp", ["id", "digest"]), carried, height)

    subroots = finished(passes[0], height)
    for done in passes[1:]:
        subroots = subroots.unionByName(finished(done, height))
    ordered = ranked(subroots.withColumn("all", F.lit("")), "all", ["grp"])
    upper = climb(ordered.select(F.col("all").alias("grp"), "rank", "n", F.col("subroot").alias("digest"), F.col("grp").alias("of")), ["digest", "of"], height)
    roots = finished(upper[-1], height).select("grp", F.col("subroot").alias("root"))
    ends = descend(upper, roots, height).select(F.col("of").alias("grp"), F.col("digest").alias("subroot"), "root", F.col("rank").alias("group_rank"), F.col("n").alias("n_groups"), F.col("path").alias("group_path"))
    rows = descend(passes, materialize(ends, "ends"), height)
    hexed = lambda *c: F.lower(F.hex(F.concat(*c)))
    return rows.select(
        F.col("id").alias(id_col), hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"),
        hexed("path", "group_path").alias("proof"), "rank", "n", "group_rank", "n_groups", *also,
    )


def fold(leaf: str, proof: str = "proof") -> str:
    """SQL expression: the root that hex digest ``leaf`` and the row's proof lead to."""
    powers = f"array({', '.join(f'{ARITY**k}L' for k in range(39))})"

    def climb(start: str, at: str, rank: str, n: str) -> str:
        steps = f"filter({powers}, p -> p < {n})"
        place, run = f"({rank} div p) % {ARITY}", f"least({ARITY}, ({n} + p - 1) div p - {rank} div p + ({rank} div p) % {ARITY})"
        left = f"substring({proof}, int(acc.at * 64 + 1), int(64 * ({place})))"
        right = f"substring({proof}, int((acc.at + {place}) * 64 + 1), int(64 * ({run} - 1 - {place})))"
        return f"aggregate({steps}, named_struct('h', {start}, 'at', {at}), (acc, p) -> named_struct('h', sha2(concat({left}, acc.h, {right}), 256), 'at', bigint(acc.at + {run} - 1)))"

    lower = climb(leaf, "0L", "rank", "n")
    # The second climb starts where the first one ended in the proof.
    return f"transform(array({lower}), low -> {climb('low.h', 'low.at', 'group_rank', 'n_groups')}.h)[0]"


def audit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", height: int = HEIGHT) -> DataFrame:
    """Proofs of all rows, and whether they hold after line ends were deleted in texts whose crc32 of the id is even."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    changed = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text_col else F.col(c) for c in FIELDS]
    read = F.when(hit, F.unhex(leaf_hash(changed)))
    rows = manifest(docs, id_col, also={"read": read}, height=height)
    rows = rows.withColumn("folded_root", F.expr(fold("coalesce(lower(hex(read)), leaf)")))
    return rows.select(id_col, "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The format's rules as recursive SQL: a tree by levels, and paths followed upwards.
SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, text, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n,
    list_reduce([ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')], lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT) % 2 = 1 AS hit
  FROM documents),
texts AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front,
    CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS now FROM docs),
leaves AS (
  SELECT doc_id, source, rank, n, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(front || coalesce(strlen(now) || ':' || now, '-')) AS changed FROM texts),
tree AS (
  SELECT 0 AS lvl, source, rank AS i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lvl + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lvl, source, i // 3, n),
subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, rank AS i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY lvl, i // 3, n),
runs AS (
  SELECT lvl, source, i // 3 AS run, list(h ORDER BY i) AS hs FROM tree WHERE n > 1 GROUP BY ALL),
upper_runs AS (
  SELECT lvl, i // 3 AS run, list(h ORDER BY i) AS hs FROM upper WHERE n > 1 GROUP BY ALL),
low AS (
  SELECT 0 AS lvl, source, doc_id, rank AS i, n, changed AS h, '' AS proof, rank AS leaf_rank FROM leaves
  UNION ALL
  SELECT low.lvl + 1, low.source, doc_id, i // 3, (n + 2) // 3, sha256(array_to_string(hs[:i % 3] || [h] || hs[i % 3 + 2:], '')), proof || array_to_string(hs[:i % 3] || hs[i % 3 + 2:], ''), leaf_rank
  FROM low JOIN runs ON runs.lvl = low.lvl AND runs.source IS NOT DISTINCT FROM low.source AND run = i // 3 WHERE n > 1),
high AS (
  SELECT 0 AS lvl, low.source, doc_id, leaf_rank, subroot, subroots.rank AS i, subroots.n, h, proof FROM low JOIN subroots ON subroots.source IS NOT DISTINCT FROM low.source WHERE low.n = 1
  UNION ALL
  SELECT high.lvl + 1, source, doc_id, leaf_rank, subroot, i // 3, (n + 2) // 3, sha256(array_to_string(hs[:i % 3] || [h] || hs[i % 3 + 2:], '')), proof || array_to_string(hs[:i % 3] || hs[i % 3 + 2:], '')
  FROM high JOIN upper_runs ON upper_runs.lvl = high.lvl AND run = i // 3 WHERE n > 1)
SELECT high.doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, high.h AS folded_root, high.h = u.h AS verified
FROM high JOIN leaves ON leaves.source IS NOT DISTINCT FROM high.source AND leaves.rank = leaf_rank, (SELECT h FROM upper WHERE n = 1) u
WHERE high.n = 1"""
