"""Top k of vectors in tiles: equal to a full sort, in memory that follows neither batch nor queries."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tracklode.operators import vectors


class Corpus:
    """Stands for a table: keeps the function that runs in a task."""

    select = filter = lambda self, *a: self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def passed(ids, matrix, batches, k=5):
    shared = type("Shared", (), {"value": (ids, matrix)})
    return vectors.one_pass(shared, Corpus(), k, "vec_id", "embedding", matrix.shape[1]).run(iter(batches))


def batch(ids, rows):
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(rows), pa.list_(pa.float32()))], ["vec_id", "embedding"])


def test_tiles_equal_a_full_sort(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE_ROWS", 7)
    monkeypatch.setattr(vectors, "TILE_SCORES", 20)
    rng = np.random.default_rng(3)
    rows, matrix = rng.integers(-2, 3, (60, 4)).astype(np.float32), rng.integers(-2, 3, (9, 4)).astype(np.float64)  # many ties
    own, ids = rng.permutation(60), np.arange(9) * 10
    for k in (1, 5, 80):
        got = sorted(t for b in passed(ids, matrix, [batch(own[:33], rows[:33]), batch(own[33:33], rows[33:33]), batch(own[33:], rows[33:])], k) for t in zip(*(c.to_pylist() for c in b.columns)))
        scores = matrix @ rows.T.astype(np.float64)
        want = [(int(q), int(own[r]), float(s[r])) for q, s in zip(ids, scores) for r in np.lexsort((own, -s))[:k]]
        assert got == sorted(want)


def test_memory_of_a_task_does_not_follow_batch_times_queries(spark):
    rng = np.random.default_rng(4)
    big, ids = batch(np.arange(6_000), rng.normal(size=(6_000, 8)).astype(np.float32)), np.arange(2_000)
    matrix = rng.normal(size=(2_000, 8))
    tracemalloc.start()
    n = sum(b.num_rows for b in passed(ids, matrix, [big]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_000 and peak < 40_000_000  # one matrix of all scores would be 96 MB
