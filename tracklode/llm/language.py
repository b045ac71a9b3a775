"""Operator 3: language identification.

Multinomial naive Bayes over hashed character n-grams (pairs and triples).
Text is lower-cased and every run of non-letters becomes one mark, so that
digits, symbols and markup carry no evidence.  The model is fitted on a
bounded sample of labelled rows, about ``PER_LANGUAGE`` for each label, taken
by a hash of id and text; whole texts are counted.  All labels are learned, with
no prior: each is as likely as any other before the text is seen.  The
log-probability matrix is kept in blocks of ``BLOCK`` labels (16 MB).  One block
at a time is built from the counts, broadcast, and scored with numpy gathers and
sums per text; the blocks' best labels and masses are put together by row.  So
memory does not grow with the labels, while texts are read once a block.  Long
texts are scored whole.

Null text, or text without letters, gives ``und`` with score 0; so does every
text if nothing is labelled.  Equal scores go to the label that sorts first.
Rows with a null id or a null label are never learned from but still get a
prediction.  Repeated rows are scored alike; an empty table gives an empty
result.  ``accept`` passes other columns through whatever their names;
``predict`` returns those it is asked to keep.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_field, map_rows, materialize, small_batches, struct
from .ranks import ranked

BITS = 16
#: Labels of one matrix.
BLOCK = 64
PER_LANGUAGE = 2_000
#: Fineness of the sampling rate.
SHARES = 1 << 40
#: n-grams that count as independent evidence; longer texts are scaled to as many.
EVIDENCE = 40.0
#: Code points of texts that are scored in one numpy batch.
BATCH_CHARS = 100_000

_other = regex.compile(r"[^\p{L}\p{M}]+")


def grams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of all texts one after the other, and how many n-grams each text has."""
    clean = [f" {x} " if (x := _other.sub(" ", t.lower()).strip()) else "" for t in texts]
    codes = np.frombuffer("".join(clean).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(x) for x in clean], np.int64)
    ends = np.cumsum(sizes)
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    two = np.zeros(n, np.uint64)
    two[:-1] = codes[:-1] * np.uint64(0x9E3779B1) + codes[1:] * np.uint64(0x85EBCA77)
    three = np.zeros(n, np.uint64)
    three[:-2] = two[:-2] * np.uint64(0x27D4EB2F) + codes[2:] * np.uint64(0xC2B2AE3D)
    # Each position keeps its pair and its triple; those that would cross into the next text repeat the pair inside it.
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = ends[owner] - np.arange(n)
    spread = lambda h: ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    both = np.stack([spread(two + np.uint64(1)), spread(three + np.uint64(2))], 1)
    keep = np.stack([left > 1, left > 2], 1)
    counts = np.maximum(sizes - 1, 0) + np.maximum(sizes - 2, 0)
    return both[keep], counts


class Model:
    """Counts of buckets by label in a written table, and their matrices block by block."""

    def __init__(self, counts: DataFrame, n_labels: int):
        self.counts, self.n_blocks = counts, max(1, -(-n_labels // BLOCK))

    def block(self, k: int) -> tuple[list[str], np.ndarray]:
        """Labels of a block, sorted, and their (labels x buckets) log-probabilities with add-half smoothing."""
        found = self.counts.filter(F.expr(f"rank div {BLOCK} = {k}")).select("label", "bucket", "n").toPandas()  # at most BLOCK x 2 ** BITS rows
        labels = sorted(set(found["label"]))
        place = {x: k for k, x in enumerate(labels)}
        table = np.full((len(labels), 1 << BITS), 0.5)
        table[[place[x] for x in found["label"]] if len(found) else [], found["bucket"].to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
        return labels, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows of each label whose hash falls under per_language / rows of that label; only a count reaches the driver."""
    labelled = docs.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    labels = ranked(labelled.groupBy("label").agg(F.count("*").alias("size")).withColumn("all", F.lit("")), "all", ["label"]).select("label", "size", "rank")
    n_labels = labels.count()
    under = F.expr(f"CAST(least({SHARES}, CAST({SHARES} AS DECIMAL(38)) * {per_language} div size) AS BIGINT)")
    rows = labelled.join(labels, "label").filter(F.pmod(F.xxhash64("id", "text"), F.lit(SHARES)) < under).select("label", "rank", "text")
    schema = struct(("label", "string"), ("rank", "bigint"), ("bucket", "int"), ("n", "bigint"))

    def make():
        def f(cols):
            out = {n: [] for n in schema.names}
            by: dict[tuple, list[str]] = {}
            for label, rank, text in zip(cols["label"], cols["rank"], cols["text"], strict=True):
                by.setdefault((label, rank), []).append(text)
            for (label, rank), texts in by.items():
                bucket, n = np.unique(grams(texts)[0], return_counts=True)
                out["label"] += [label] * len(bucket)
                out["rank"] += [rank] * len(bucket)
                out["bucket"] += bucket.tolist()
                out["n"] += n.tolist()
            return out

        return f

    counts = map_rows(rows, make, schema).groupBy("label", "rank", "bucket").agg(F.sum("n").alias("n"))
    return Model(materialize(counts, "counts"), n_labels)


def part_scores(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the best label's place (-1 without letters or labels), its scaled log-probability, and the mass of all labels beside it."""
    bucket, counts = grams([t or "" for t in texts])
    some = np.flatnonzero(counts)
    best, top, mass = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
    if len(table) and len(some):
        starts = (np.cumsum(counts) - counts)[some]
        total = np.stack([np.add.reduceat(row[bucket], starts, dtype=np.float64) for row in table], 1)
        total *= np.minimum(1.0, EVIDENCE / counts[some])[:, None]
        best[some], top[some] = total.argmax(1), total.max(1)
        mass[some] = np.exp(total - total.max(1, keepdims=True)).sum(1)
    return best, top, mass


def score(texts: list[str | None], labels: list[str], table: np.ndarray) -> tuple[list[str], list[float]]:
    """Labels and scores by one block."""
    best, _, mass = part_scores(texts, table)
    return [labels[k] if k >= 0 else "und" for k in best.tolist()], [1 / m if m else 0.0 for m in mass.tolist()]


def by_size(texts: list[str | None]):
    """The texts in order, in parts of about BATCH_CHARS code points."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size > BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``."""
    if model.n_blocks > 1:
        return predict_in_blocks(docs, model, text_col, keep)
    shared = docs.sparkSession.sparkContext.broadcast(model.block(0))
    schema = T.StructType([*(id_field(docs, c) for c in keep), *struct(("lang_pred", "string"), ("score", "double"))])

    def make():
        labels, table = shared.value

        def f(cols):
            names: list[str] = []
            scores: list[float] = []
            for part in by_size(cols["__text"]):
                a, b = score(part, labels, table)
                names += a
                scores += b
            return {c: cols[c] for c in keep} | {"lang_pred": names, "score": scores}

        return f

    return map_rows(docs.select(*keep, F.col(text_col).alias("__text")), make, schema)


def predict_in_blocks(docs: DataFrame, model: Model, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The same with any number of labels: a pass over the texts for each block, and a grouped sum of what the passes found."""
    rows = materialize(docs.select(F.struct(*keep).alias("kept"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "rows")
    schema = struct(("row", "bigint"), ("label", "string"), ("top", "double"), ("mass", "double"))
    found = None
    for k in range(model.n_blocks):
        shared = docs.sparkSession.sparkContext.broadcast(model.block(k))

        def make(shared=shared):
            labels, table = shared.value

            def f(cols):
                out = {n: [] for n in schema.names}
                at = 0
                for part in by_size(cols["text"]):
                    for row, place, top, mass in zip(cols["row"][at : at + len(part)], *(x.tolist() for x in part_scores(part, table)), strict=True):
                        if place >= 0:
                            for n, v in zip(schema.names, (row, labels[place], top, mass), strict=True):
                                out[n].append(v)
                    at += len(part)
                return out

            return f

        passed = materialize(map_rows(rows.select("row", "text"), make, schema), "passed")
        shared.destroy()
        found = passed if found is None else found.unionByName(passed)
    best = found.groupBy("row").agg(F.max("top").alias("t"), F.min(F.struct((-F.col("top")).alias("t"), "label")).alias("b"), F.collect_list(F.struct("top", "mass")).alias("parts"))  # a row a block
    mass = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["mass"] * F.exp(x["top"] - F.col("t")))
    best = best.select("row", F.col("b.label").alias("label"), (1 / mass).alias("p"))
    made = rows.select("row", "kept").join(best, "row", "left")
    return made.select(*(F.col("kept").getField(c).alias(c) for c in keep), F.coalesce("label", F.lit("und")).alias("lang_pred"), F.coalesce("p", F.lit(0.0)).alias("score"))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Fit on the rows that are not held out, predict all: ``id_col, held_out, lang_pred, score``."""
    model = fit(docs.filter(~held_out(id_col)), text_col, label_col, id_col)
    return predict(docs, model, text_col, (id_col,)).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, least: float = 0.5, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is recognised with a score of ``least`` or more.

    Only the text goes to Python.  Texts without letters have score 0.
    """
    small_batches(docs.sparkSession)
    model = fit(docs.filter(~held_out(id_col)), text_col, label_col, id_col)
    if model.n_blocks > 1:
        packed = docs.select(F.struct(*docs.columns).alias("all"), F.col(text_col).alias("text"))
        return predict_in_blocks(packed, model, "text", ("all",)).filter(F.col("score") >= least).select("all.*")
    shared = docs.sparkSession.sparkContext.broadcast(model.block(0))

    @F.pandas_udf("double")
    def certainty(texts: pd.Series) -> pd.Series:
        labels, table = shared.value
        found: list[float] = []
        for part in by_size(texts.tolist()):
            found += score(part, labels, table)[1]
        return pd.Series(found, dtype="float64")

    return docs.filter(certainty(F.col(text_col)) >= least)
