"""Operator 13: mixing sources to target weights by a low-discrepancy schedule.

1. A source's target is its weight's share of all words, at most ``CAP`` times
   the words it has; what that leaves is shared again by weight until no target
   is above.  The driver sees two sums a round.
2. The words of a source, in id order, are cut into blocks of ``BLOCK`` words.
   Its blocks are shuffled anew for each pass over the source, the shorter last
   one stands at the end of a pass.
3. The schedule is the van der Corput sequence: slot t has the point whose
   bits are those of t reversed, and points map to sources through cumulative
   slot counts.  That is built from the other side: a source owns a range of
   reversed numbers, cut into chunks that tasks expand.  With at least twice as
   many points as slots, each source's range holds at least the slots it needs.
4. Slots get their rank inside their source; the rank says which pass and which
   place of the shuffled blocks the slot takes.  The last slot of a source ends
   at its target, so a source's words are its target, rounded.

Documents of any length, sources and blocks are dealt by range (``ranks``), so
a hot source is in no task as a whole.  Null and empty texts and texts of white
space have size 0 and are taken 0 times; null sources are one source, the last
one; null ids come first; rows equal in id and size are interchangeable, and
each is a document of its own.  Extra columns are not read, so their names
cannot clash.  An empty table gives an empty result.  Results follow from the
rows alone, not from how they are dealt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .ranks import ranked

#: Weights of the sources in order, repeated; passes over a source at most; words of a block.
WEIGHTS, CAP, BLOCK = (1, 2, 3), 3, 2_048
#: Points that one row expands to.
CHUNK = 4_096
SEED = "mix"


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``id, grp, size`` with the place of each document in its source: ``start`` and ``source_size`` in words; ``row`` tells rows apart."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    grp = F.coalesce(F.concat(F.lit("v"), F.col(source_col).cast("string")), F.lit("w"))  # bytewise, null last
    rows = docs.select(F.col(id_col).alias("id"), grp.alias("grp"), size.alias("size"), F.monotonically_increasing_id().alias("row"))
    return ranked(rows, "grp", ["id", "size"], sums={"size": ("start", "source_size")})


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``target`` of sources with ``weight`` and ``source_size``: shares of all words, at most ``cap`` times each size."""
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    words, weight = int(whole[0]), int(whole[1])
    level = (words, weight)
    above = lambda at: f"CAST(weight AS DECIMAL(19)) * {at[0]} > CAST(source_size AS DECIMAL(19)) * {cap * at[1]}"
    while True:
        full = sources.filter(above(level)).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        now = (words - cap * int(full[0]), weight - int(full[1]))
        if now == level:
            break
        level = now
    share = f"CAST(weight * {level[0]}L AS DOUBLE) / {level[1] or 1}D"
    return sources.withColumn("target", F.expr(f"CASE WHEN {above(level)} THEN CAST({cap} * source_size AS DOUBLE) ELSE {share} END"))


def expanded(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """A row for each whole number from ``low`` up to ``high`` (excluded), in two steps, so that no row expands to more than a task can do."""
    chunks = df.filter(f"{low} < {high}").withColumn("__chunk", F.explode(F.expr(f"sequence({low} div {CHUNK}, ({high} - 1) div {CHUNK})")))
    chunks = chunks.repartition("grp", "__chunk")
    return chunks.withColumn(name, F.explode(F.expr(f"sequence(greatest({low}, __chunk * {CHUNK}), least({high}, (__chunk + 1) * {CHUNK}) - 1)"))).drop("__chunk")


def schedule(sources: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """Slots ``grp, slot, block, words``: in the order of ``slot``, take the first ``words`` words of the source's ``block``."""
    to_take = "CAST(floor(target + 0.5) AS BIGINT)"
    plan = sources.filter("source_size > 0").withColumn("to_take", F.expr(to_take))
    plan = plan.withColumns({"full": F.expr(f"source_size div {block}"), "blocks": F.expr(f"(source_size + {block - 1}) div {block}")})
    plan = plan.withColumn("slots", F.expr(f"(to_take div source_size) * blocks + (to_take % source_size + {block - 1}) div {block}"))
    plan = ranked(plan.select("grp", "source_size", "to_take", "full", "blocks", "slots").withColumn("all", F.lit("")), "all", ["grp"], sums={"slots": ("before", "every")})
    total = plan.agg(F.coalesce(F.max("every"), F.lit(0))).first()[0]
    bits = max(1, (2 * total - 1).bit_length())
    edge = lambda x: F.expr(f"(CAST({x} AS DECIMAL(19)) * {2**bits} + {max(total, 1) - 1}) div {max(total, 1)}")
    plan = plan.withColumns({"low": edge("before"), "high": edge("before + slots")}).drop("rank", "n", "all", "before", "every")

    points = expanded(plan, "low", "high", "point").withColumn("slot", F.expr(f"CAST(conv(reverse(lpad(bin(point), {bits}, '0')), 2, 10) AS BIGINT)"))
    slots = ranked(points.drop("low", "high", "point"), "grp", ["slot"]).filter("rank < slots")
    slots = slots.withColumns({"pass": F.expr("rank div blocks"), "place": F.expr("rank % blocks")})
    words = f"least({block}, source_size - place * {block}, to_take - pass * source_size - place * {block})"
    slots = slots.select("grp", "slot", "pass", "place", "full", F.expr(words).alias("words"))

    passes = plan.filter("slots > 0").withColumn("pass", F.explode(F.expr("sequence(0L, (slots - 1) div blocks)")))
    shuffled = expanded(passes.select("grp", "pass", "full", F.lit(0).cast("bigint").alias("low")), "low", "full", "block")
    key = F.md5(F.concat_ws(":", F.lit(seed), "pass", "grp", "block"))
    shuffled = ranked(shuffled.select("grp", "pass", "block", key.alias("key"), F.concat("pass", "grp").alias("of")), "of", ["key", "block"], rank="place").select("grp", "pass", "place", "block")
    even = slots.filter("place < full").join(shuffled, ["grp", "pass", "place"]).select("grp", "slot", "block", "words")
    return even.unionByName(slots.filter("place >= full").select("grp", "slot", F.col("full").alias("block"), "words"))


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """What each block holds of each document: ``grp, block, row, id``, ``inside`` (place in the block), ``start`` (place in the document) and ``piece_words``."""
    cut = rows.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    low, high = f"greatest(start, block * {block})", f"least(start + size, (block + 1) * {block})"
    return cut.select("grp", "block", "row", "id", F.expr(f"{low} - block * {block}").alias("inside"), F.expr(f"{low} - start").alias("start"), F.expr(f"{high} - {low}").alias("piece_words"))


def weighted(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``grp, source_size, weight`` of all sources, weights in source order."""
    sources = rows.groupBy("grp").agg(F.sum("size").alias("source_size")).withColumn("all", F.lit(""))
    cycle = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    return ranked(sources, "all", ["grp"]).select("grp", "source_size", cycle.alias("weight"))


def mixed(rows: DataFrame, sources: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """The mix as copies to make, in the order of ``slot`` and ``inside``: ``words`` words of document ``row`` from word ``start`` on."""
    found = schedule(sources, block, seed).join(pieces(rows, block), ["grp", "block"])
    return found.withColumn("words", F.least("words", F.col("inside") + F.col("piece_words")) - F.col("inside")).filter("words > 0").drop("piece_words")


def report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """A row a document: id, ``size, source_size, target`` (its source's) and ``taken`` (words of it in the mix)."""
    rows = sized(docs, id_col, source_col, text_col)
    sources = materialize(targets(weighted(rows, weights), cap), "targets")
    taken = mixed(rows, sources, block, seed).groupBy("row").agg(F.sum("words").alias("taken"))
    whole = rows.join(taken, "row", "left").join(sources.select("grp", "target"), "grp")
    return whole.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


#: The same rules in SQL, for the default weights, cap, block and seed.
SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce('v' || source, 'w') AS grp, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, row_number() OVER () AS row FROM documents),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, size, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized),
sources AS (
  SELECT grp, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY grp) - 1) % 3 AS weight FROM sized GROUP BY grp),
fill AS (
  SELECT 0 AS step, sum(source_size)::HUGEINT AS r, sum(weight)::HUGEINT AS w FROM sources
  UNION ALL
  SELECT step + 1, sum(source_size)::HUGEINT - coalesce(sum(3 * source_size) FILTER (weight * r > 3 * source_size * w), 0)::HUGEINT, sum(weight)::HUGEINT - coalesce(sum(weight) FILTER (weight * r > 3 * source_size * w), 0)::HUGEINT
  FROM fill, sources GROUP BY step, r, w HAVING sum(source_size) - coalesce(sum(3 * source_size) FILTER (weight * r > 3 * source_size * w), 0) <> r),
targets AS (
  SELECT grp, source_size, CASE WHEN weight * r > 3 * source_size * w THEN (3 * source_size)::DOUBLE ELSE (weight * r)::DOUBLE / w END AS target
  FROM sources, (SELECT r, w FROM fill ORDER BY step DESC LIMIT 1)),
takes AS (
  SELECT *, floor(target + 0.5)::BIGINT AS to_take, source_size // 2048 AS whole, (source_size + 2047) // 2048 AS blocks FROM targets WHERE source_size > 0),
counted AS (
  SELECT *, (to_take // source_size) * blocks + (to_take % source_size + 2047) // 2048 AS slots FROM takes),
ends AS (
  SELECT *, sum(slots) OVER (ORDER BY grp) - slots AS before, sum(slots) OVER () AS every FROM counted),
bits AS (
  SELECT k AS bits FROM range(1, 62) t(k), (SELECT max(every) AS every FROM ends) WHERE 1::HUGEINT << k >= 2 * every ORDER BY k LIMIT 1),
edges AS (
  SELECT *, ((before::HUGEINT * (1::HUGEINT << bits) + every - 1) // every)::BIGINT AS low, (((before + slots)::HUGEINT * (1::HUGEINT << bits) + every - 1) // every)::BIGINT AS high FROM ends, bits WHERE slots > 0),
points AS (
  SELECT * EXCLUDE (low, high), unnest(range(low, high)) AS point FROM edges),
numbered AS (
  SELECT *, list_sum([((point >> k) & 1) << (bits - 1 - k) FOR k IN range(0, bits)])::BIGINT AS slot FROM points),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY slot) - 1 AS rank FROM numbered),
slots AS (
  SELECT grp, slot, rank // blocks AS pass, rank % blocks AS place, whole, least(2048, source_size - (rank % blocks) * 2048, to_take - (rank // blocks) * source_size - (rank % blocks) * 2048) AS words FROM ranks WHERE rank < slots),
passes AS (
  SELECT grp, whole, unnest(range(0, (slots - 1) // blocks + 1)) AS pass FROM counted WHERE slots > 0),
blocks AS (
  SELECT grp, pass, unnest(range(0, whole)) AS block FROM passes),
shuffled AS (
  SELECT *, row_number() OVER (PARTITION BY grp, pass ORDER BY md5('mix:' || pass || ':' || grp || ':' || block), block) - 1 AS place FROM blocks),
scheduled AS (
  SELECT slots.grp, block, words FROM slots JOIN shuffled USING (grp, pass, place) WHERE place < whole
  UNION ALL SELECT grp, whole, words FROM slots WHERE place >= whole),
cut AS (
  SELECT *, unnest(range(start // 2048, (start + size - 1) // 2048 + 1)) AS block FROM placed WHERE size > 0),
taken AS (
  SELECT row, sum(greatest(0, least(words, least(start + size, (block + 1) * 2048) - block * 2048) - greatest(start, block * 2048) + block * 2048))::BIGINT AS taken FROM scheduled JOIN cut USING (grp, block) GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed JOIN targets USING (grp) LEFT JOIN taken USING (row)"""
