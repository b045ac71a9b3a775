"""Exact vector search by inner product, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import passage_snippet, passage_title

#: Components of the queries that one pass over the corpus holds; more queries take more passes.
BLOCK_VALUES = 4_000_000
#: Corpus rows and scores that are held at a time, whatever the sizes of a batch and of the block of queries.
TILE_ROWS, TILE_SCORES = 1_024, 1 << 18


def topk(queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "query_id", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, vec_id, score, rank`` of the k nearest corpus vectors of each query; ties by ``vec_id``.

    A block of queries of bounded size is broadcast; each task keeps the k
    best of its rows, and only those are shuffled.  Null vectors and vectors
    of another dimension are passed over.
    """
    spark = corpus.sparkSession
    q = queries.filter(F.col(vector).isNotNull()).select(query_id, vector)
    dims = [r[0] for r in q.select(F.size(vector)).distinct().collect()]
    parts = []
    for dim in dims:
        own = q.filter(F.size(vector) == dim).orderBy(query_id)
        for ids, matrix in blocks(own, query_id, vector, max(1, BLOCK_VALUES // max(1, dim))):
            parts.append(one_pass(spark.sparkContext.broadcast((ids, matrix)), corpus, k, vec_id, vector, dim))
    schema = f"__q long, {vec_id} long, score double"
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        found = found.unionByName(p)
    order = W.partitionBy("__q").orderBy(F.desc("score"), vec_id)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("__q").alias(query_id), vec_id, "score", "rank")


def blocks(q: DataFrame, query_id: str, vector: str, size: int):
    """Ids and matrices of at most ``size`` queries."""
    ids, rows = [], []
    for r in q.toLocalIterator():
        ids.append(r[query_id])
        rows.append(r[vector])
        if len(ids) == size:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)


def keep_best(scores: np.ndarray, own: np.ndarray, top_s: np.ndarray, top_i: np.ndarray, held: np.ndarray) -> None:
    """Put the scores (queries x rows) of the rows ``own`` into the queries' lists of the k best, in place; ties by id, NaN last."""
    k = top_s.shape[1]
    last = np.where(held == k, top_s[:, -1], -np.inf)
    q, r = np.nonzero(~(scores < last[:, None]))  # the others are behind a full list
    if not len(q):
        return
    some = np.unique(q)
    old_q, old_k = np.nonzero(np.arange(k) < held[some, None])
    old_q = some[old_q]
    all_q, all_s, all_i = np.r_[old_q, q], np.r_[top_s[old_q, old_k], scores[q, r]], np.r_[top_i[old_q, old_k], own[r]]
    order = np.lexsort((all_i, -all_s, all_q))
    all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
    place = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
    best = place < k
    top_s[all_q[best], place[best]], top_i[all_q[best], place[best]] = all_s[best], all_i[best]
    held[some] = np.minimum(k, np.bincount(all_q, minlength=len(held))[some])


def one_pass(shared, corpus: DataFrame, k: int, vec_id: str, vector: str, dim: int) -> DataFrame:
    schema = pa.schema([("__q", pa.int64()), (vec_id, pa.int64()), ("score", pa.float64())])

    def run(batches):
        ids, matrix = shared.value
        top_s = np.full((len(ids), k), -np.inf)
        top_i = np.zeros((len(ids), k), np.int64)
        held = np.zeros(len(ids), np.int64)  # how many of a query's places are taken
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(at, TILE_ROWS)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                own = part.column(0).to_numpy()
                step = max(1, TILE_SCORES // len(own))
                for low in range(0, len(ids), step):
                    keep_best(matrix[low : low + step] @ v.T, own, top_s[low : low + step], top_i[low : low + step], held[low : low + step])
        for low in range(0, len(ids), TILE_ROWS):
            some = np.arange(k) < held[low : low + TILE_ROWS, None]
            which = np.repeat(ids[low : low + TILE_ROWS], held[low : low + TILE_ROWS])
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(top_i[low : low + TILE_ROWS][some]), pa.array(top_s[low : low + TILE_ROWS][some])], schema=schema)

    rows = corpus.filter(F.col(vector).isNotNull() & (F.size(vector) == dim)).select(F.col(vec_id).cast("bigint").alias(vec_id), vector)
    return rows.mapInArrow(run, f"__q long, {vec_id} long, score double")


def render(hits: DataFrame, passages: DataFrame, query: str = "query", query_id: str = "query_id", vec_id: str = "vec_id", contents: str = "contents") -> DataFrame:
    """``query_id, observation``: a header and the ranked passages of each query."""
    with_text = hits.join(passages.select(vec_id, contents), vec_id)
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), passage_title(contents), F.lit("\n"), passage_snippet(contents))
    grouped = with_text.groupBy(query_id, query).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))  # k rows a query
    return grouped.select(query_id, F.concat(F.lit("Search results for: "), F.col(query), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")).alias("observation"))


def check_dimension(corpus: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    from .expect import require

    return require(corpus, dimension=F.size(vector) == dim)
