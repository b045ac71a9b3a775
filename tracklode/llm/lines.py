"""Operator 9: line dedup by winnowing over line hashes.

Lines are hashed in two ways.  A real line of ``LEAST`` or more words is a
fingerprint of its own, so every line that stood before goes, however short the
run that it is in.  But passages that repeat seldom fill whole lines: of the
benchmark passages in the fixture documents nearly all begin and end inside
one.  So the text is also taken as if it were wrapped anew at every word: the
line of a word is the run of ``NOISE`` words from it on, whatever line ends
stand between.  Of each ``WINDOW`` such lines in a row the one with the least
hash is a fingerprint, and a document with fewer of them still has one.  So:

- every line of ``LEAST`` or more words that stood in the corpus before goes;
- every run of ``NOISE + WINDOW - 1`` = 50 or more words that stood before
  shares a fingerprint with an earlier place and is found;
- of other text, nothing with fewer than ``NOISE`` words in a row is removed.

Positions are joined with the first occurrence of their line (a grouped
minimum, so a passage in a third of all documents makes one row per document
and fingerprint, never pairs).  Fingerprints that touch make one match, which
is extended both ways word by word (real lines need no more than the lines
beside them, which are fingerprints too): less than ``WINDOW`` words to either side
can be missing, as there would be another fingerprint beyond them, so only so
many words of context are fetched.  Where the line of an outer fingerprint
recurs in its first document, these few words may stay.

Documents stand in order of (id, hash of the text); within a document later
places are later, so a document that repeats itself keeps the first run.  Equal
hashes in one window are all fingerprints; of neighbouring ones with one hash
only so many stay that their lines touch, so a text of equal lines has few.  Of a line that is cut only the repeated words go; a line whose words all
go, goes with its end.

Null text stays null, an empty text stays empty, and a text may become empty.
Rows with equal id and text are one document and are treated alike; null ids
come first.  Texts of any length are read whole, in steps of ``STEP`` bytes,
and cost in proportion to their words.  An empty table gives an empty result.
Other columns are passed through by ``dedup`` whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, arrow_schema, map_rows, materialize, release, small_batches, struct

NOISE, WINDOW = 26, 25
#: Words of a real line that is a fingerprint.
LEAST = 3
#: Bytes that are hashed at a time.
STEP = 1 << 18
BLANKS = " \t\n\v\f\r"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240302)
#: A value for each byte; blanks count for nothing.
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[list(BLANKS.encode())] = True
_VALUE[_SPACE] = 0
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_space = re.compile(rb"[ \t\n\v\f\r]")
_word = re.compile(r"[^ \t\n\v\f\r]+")


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and the byte that it starts at, by differences of one running polynomial over the bytes."""
    parts, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        end = _space.search(raw, at + STEP) if at + STEP < len(raw) else None
        stop = end.start() if end else len(raw)
        b = np.frombuffer(raw, np.uint8, stop - at, at)
        up, down = powers(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUE[b] * up[: len(b)], out=total[1:])
        edges = np.flatnonzero(np.diff(np.r_[True, _SPACE[b], True]))
        first, after = edges[::2], edges[1::2]
        parts.append(mix((total[after] - total[first]) * down[first]))
        starts.append(first + at)
        at = stop
    return np.concatenate(parts), np.concatenate(starts)


def line_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of the NOISE words from each word on, put together from runs of 1, 2, 4, ... words."""
    if len(words) < NOISE:
        return np.zeros(0, np.uint64)
    n, run, size, done, out = len(words) - NOISE + 1, words, 1, 0, None
    while True:
        if NOISE & size:
            piece = run[done : done + n]
            out = piece if out is None else mix(out * _MIX + piece)
            done += size
        if done == NOISE:
            return out
        run = mix(run[:-size] * _MIX + run[size:])
        size *= 2


def windowed(f, x: np.ndarray, width: int) -> np.ndarray:
    """The minimum or maximum ``f`` of each ``width`` elements in a row."""
    n, run, size = len(x) - width + 1, x, 1
    if n < 1:
        return x[:0]
    while 2 * size <= width:
        run = f(run[:-size], run[size:])
        size *= 2
    return f(run[:n], run[width - size : width - size + n])


def fingerprints(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the fingerprints of documents whose words, so many each, stand one after the other.

    A line is selected if it is the least of some window of its document, that
    is, if the greatest of the least hashes of the windows around it is its own.
    """
    hashes, ends = line_hashes(words), np.cumsum(counts)
    room = (np.repeat(ends, counts) - np.arange(len(words)))[: len(hashes)]  # words up to the end of the document
    low = windowed(np.minimum, hashes, WINDOW)
    low = np.where(room[: len(low)] >= NOISE + WINDOW - 1, low, np.uint64(0))  # no window goes over the end
    edge = np.zeros(WINDOW - 1, np.uint64)
    chosen = hashes == windowed(np.maximum, np.r_[edge, low, edge], WINDOW)[: len(hashes)] if len(low) else np.zeros(len(hashes), bool)
    chosen &= room >= NOISE
    for k in np.flatnonzero((counts >= NOISE) & (counts < NOISE + WINDOW - 1)):  # less than one window
        part = slice(ends[k] - counts[k], ends[k] - NOISE + 1)
        chosen[part] = hashes[part] == hashes[part].min()
    places = np.flatnonzero(chosen)
    key = hashes[places]
    owner = np.searchsorted(ends, places, "right")
    edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]), True]) if len(places) else np.zeros(1, np.int64)
    if len(edges) <= len(places):
        places = np.concatenate([thinned(places[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    return hashes[places], places


def real_lines(raw: bytes, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and number of words of each line of LEAST or more words."""
    line = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), starts)
    edges = np.flatnonzero(np.diff(line, prepend=-1, append=-1)) if len(line) else np.zeros(1, np.int64)
    first, after = edges[:-1], edges[1:]
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    long = after - first >= LEAST
    first, n = first[long], (after - first)[long]
    return mix((total[first + n] - total[first]) * down[first] + n.astype(np.uint64)), first, n


def thinned(equal: np.ndarray) -> np.ndarray:
    """Of places with one hash the first two, the last, and so many between that their lines touch."""
    if len(equal) < 4:
        return equal
    kept = [equal[0], equal[1]]
    for place, after in zip(equal[2:-1], equal[3:], strict=True):
        if after - kept[-1] > NOISE:
            kept.append(place)
    return np.array([*kept, equal[-1]])


def scan(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``id, text_hash, words, prints`` of each row with a text; words are 32 bits of their hashes, and ``n`` is a real line's number of words, else 0."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *struct(("text_hash", "bigint"), ("words", "array<int>"), ("prints", "array<struct<gram:bigint,pos:int,n:int>>"))])
    kinds = arrow_schema(schema)

    def make():
        def f(cols):
            raw = [t.encode("utf-8", "surrogatepass") for t in cols["__text"]]
            joined = b"\n".join(raw)
            words, starts = word_hashes(joined)
            upto = np.r_[0, np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raw]))]
            grams, places = fingerprints(words, np.diff(upto))
            own, first, sizes = real_lines(joined, words, starts)
            grams, places, sizes = np.r_[grams, own], np.r_[places, first], np.r_[np.zeros(len(places), np.int64), sizes]
            order = np.argsort(places, kind="stable")
            grams, places, sizes = grams[order], places[order], sizes[order]
            owner = np.searchsorted(upto, places, "right") - 1
            pair = pa.StructArray.from_arrays([pa.array(grams.view(np.int64)), pa.array((places - upto[owner]).astype(np.int32)), pa.array(sizes.astype(np.int32))], fields=list(kinds.field("prints").type.value_type))
            lists = lambda borders, values: pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), values)
            return {"id": cols["id"], "text_hash": cols["text_hash"], "words": lists(upto, pa.array(words.astype(np.uint32).view(np.int32))), "prints": lists(np.searchsorted(places, upto), pair)}

        return f

    return map_rows(docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("text_hash")), make, schema)


CONTEXT = "before:array<int>,after:array<int>"
RUN = "start:int,end:int,left_doc:bigint,left_pos:int,right_doc:bigint,right_pos:int," + CONTEXT


def runs_and_contexts(wanted: DataFrame) -> DataFrame:
    """``doc, id, text_hash, runs, asked`` of documents with matches ``own`` or whose places ``asked`` other documents match.

    A run is a row of fingerprints that touch.  The words before it (nearest
    first) and after it come along, and those around each place that is asked for.
    """
    schema = T.StructType([wanted.schema[c] for c in ("doc", "id", "text_hash")] + list(struct(("runs", f"array<struct<{RUN}>>"), ("asked", f"array<struct<pos:int,{CONTEXT}>>"))))
    out = arrow_schema(schema)

    def around(words, start, end):
        return {"before": words[max(0, start - WINDOW + 1) : start][::-1], "after": words[end : end + WINDOW - 1]}

    def joined(matches):
        mine: list[dict] = []
        for m in sorted(matches or (), key=lambda m: m["pos"]):
            right = {"end": m["pos"] + NOISE, "right_doc": m["first_doc"], "right_pos": m["first_pos"]}
            if mine and m["pos"] <= mine[-1]["end"]:
                mine[-1] |= right
            else:
                mine.append({"start": m["pos"], "left_doc": m["first_doc"], "left_pos": m["first_pos"], **right})
        return mine

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                words, edges = part.column(3).values.to_numpy(), part.column(3).offsets.to_numpy()  # words are never Python objects
                runs, asked = [], []
                for k, (own, places) in enumerate(zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)):
                    mine = words[edges[k] : edges[k + 1]]
                    runs.append([r | around(mine, r["start"], r["end"]) for r in joined(own)])
                    asked.append([{"pos": p, **around(mine, p, p + NOISE)} for p in places or ()])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(runs, out.field("runs").type), pa.array(asked, out.field("asked").type)], schema=out)

    return wanted.select("doc", "id", "text_hash", "words", "own", "asked").mapInArrow(run, schema)


def agree(x, y) -> F.Column:
    """How many elements two arrays have in common from the start."""
    n = F.least(F.size(x), F.size(y))
    same = F.array_position(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p == q), False)
    return F.when(same == 0, n).otherwise(same.cast("int") - 1)


def deletions(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``id, text_hash, gone``: ranges of words (from 0, end exclusive) to delete in documents that repeat earlier runs."""
    lines = materialize(scan(docs, text_col, id_col), "lines")
    prints = lines.select("id", "text_hash", F.explode("prints").alias("p")).select("id", "text_hash", "p.gram", "p.pos", "p.n")
    # Most lines stand once: a count finds the others before anything wider is moved.
    often = materialize(prints.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "often")
    prints = materialize(prints.join(often, "gram").withColumn("doc", F.xxhash64("id", "text_hash")), "prints")
    release(often)
    first = prints.groupBy("gram").agg(F.min(F.struct("id", "text_hash", "pos", "doc")).alias("first"))
    # Written first, so that the join stands between two exchanges, where a hot line can be split.
    first = materialize(first.select("gram", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos")), "firsts")
    matches = prints.join(first, "gram").filter("doc <> first_doc OR pos <> first_pos").select("id", "text_hash", "doc", "pos", "n", "first_doc", "first_pos").distinct()
    found_lines = materialize(matches, "matches")
    matches = found_lines.filter("n = 0")
    release(prints, first)

    own = matches.groupBy("doc").agg(F.collect_list(F.struct("pos", "first_doc", "first_pos")).alias("own"))  # at most one document's fingerprints
    asked = matches.select(F.col("first_doc").alias("doc"), F.col("first_pos").alias("pos")).distinct().groupBy("doc").agg(F.collect_list("pos").alias("asked"))
    found = materialize(runs_and_contexts(lines.select("id", "text_hash", "words", F.xxhash64("id", "text_hash").alias("doc")).join(own.join(asked, "doc", "full_outer"), "doc")), "runs")
    release(lines)

    contexts = found.select("doc", F.explode("asked").alias("a")).groupBy("doc", "a.pos").agg(F.first("a.before").alias("b"), F.first("a.after").alias("f"))
    contexts = materialize(contexts, "contexts")
    side = lambda x, c: contexts.select(F.col("doc").alias(f"{x}_doc"), F.col("pos").alias(f"{x}_pos"), F.col(c).alias(x))
    runs = found.select("id", "text_hash", F.explode("runs").alias("r")).select("id", "text_hash", "r.*")
    runs = runs.join(side("left", "b"), ["left_doc", "left_pos"]).join(side("right", "f"), ["right_doc", "right_pos"])
    whole = runs.select("id", "text_hash", (F.col("start") - agree("before", "left")).alias("start"), (F.col("end") + agree("after", "right")).alias("end"))
    real = found_lines.filter("n > 0").select("id", "text_hash", F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("end"))
    whole = whole.unionByName(real).distinct()
    gone = materialize(whole.groupBy("id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone")), "gone")  # at most one document's runs
    release(found, contexts, found_lines)
    return gone


def cut(text: str, gone: list[dict]) -> tuple[str, int]:
    """The text without the words in the ranges, and how many words those are."""
    step = np.zeros(max(r["end"] for r in gone) + 2, np.int64)
    for r in gone:
        step[r["start"]] += 1
        step[r["end"]] -= 1
    away = (np.cumsum(step) > 0).tolist()
    lines = [(x, [m.span() for m in _word.finditer(x)]) for x in text.split("\n")]
    away += [False] * (sum(len(spans) for _, spans in lines) - len(away))
    total = sum(len(spans) for _, spans in lines)
    kept, k = [], 0
    for line, spans in lines:
        n = len(spans)
        bad = away[k : k + n]
        if not n:
            # A blank line goes with the words around it.
            around = [away[i] for i in (k - 1, k) if 0 <= i < total]
            if not (around and all(around)):
                kept.append(line)
        elif not any(bad):
            kept.append(line)
        elif not all(bad):
            parts = []
            for i, (start, _) in enumerate(spans):
                if not bad[i]:
                    parts.append(line[start if i else 0 : spans[i + 1][0] if i + 1 < n else len(line)])
            kept.append("".join(parts).rstrip(BLANKS) if bad[-1] else "".join(parts))
        k += n
    return "\n".join(kept), sum(away)


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", count_col: str | None = None) -> DataFrame:
    """``docs`` without the words of repeated runs; ``count_col`` gets the number of deleted words."""
    small_batches(docs.sparkSession)
    gone = deletions(docs, text_col, id_col)
    whole = docs.select(F.struct("*").alias("row"))  # packed, so that no column of the caller's can clash
    text = F.col("row").getField(text_col)
    same = F.col("row").getField(id_col).eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("text_hash"))
    made = struct(("text", "string"), ("n", "bigint"))
    kind = pa.struct(list(arrow_schema(made)))

    def write(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        return pa.array([None if t is None else dict(zip(("text", "n"), cut(t, r), strict=True)) for t, r in zip(texts.to_pylist(), ranges.to_pylist(), strict=True)], kind)

    # A merge join at every size: the texts move once, by key, and the plan does not change as the deletions grow.
    joined = whole.join(gone.hint("merge"), same, "left")
    # Only texts that change go to Python.
    changed = F.col("gone").isNotNull()
    new = F.arrow_udf(write, made)(F.when(changed, text), F.col("gone"))
    joined = joined.select("row", changed.alias("changed"), new.alias("new"))
    row = F.col("row").withField(text_col, F.when(F.col("changed"), F.col("new.text")).otherwise(text))
    extra = [F.coalesce("new.n", F.lit(0)).alias(count_col)] if count_col else []
    return joined.select(row.alias("row"), *extra).select("row.*", *([count_col] if count_col else []))
