"""Token overlap of every document with every item of a bounded table.

The items become an inverted index, which is broadcast: token, then item and
count.  Each document looks its own tokens up and adds what both hold, so
whole texts are compared, all items are candidates, and the work is the
postings that are hit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Documents whose pairs are one Arrow batch.
SLICE_ROWS = 128


def index(bags: list[str]) -> tuple[dict[str, int], list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of each token its number, the items that have it and how often; and the size of each item."""
    known: dict[str, int] = {}
    items: list[list[int]] = []
    counts: list[list[int]] = []
    for k, bag in enumerate(bags):
        for token, n in Counter(bag.split()).items():
            at = known.setdefault(token, len(items))
            if at == len(items):
                items.append([])
                counts.append([])
            items[at].append(k)
            counts[at].append(n)
    return known, [np.array(x, np.int64) for x in items], [np.array(x, np.int64) for x in counts], np.array([len(b.split()) for b in bags], np.int64)


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, doc_bag: Column, item_bag: Column) -> DataFrame:
    """``doc_id, item_id, both, n_doc, n_item, same`` of all pairs that share a token or are equal.

    Bags are tokens joined by blanks; ``both`` is the size of the multiset
    intersection, ``same`` whether the bags are equal in order too.
    """
    found = items.select(item_id, item_bag.alias("bag")).collect()
    bags = [r["bag"] for r in found]
    shared = docs.sparkSession.sparkContext.broadcast((pa.array([r[item_id] for r in found], to_arrow_schema(items.select(item_id).schema)[0].type), bags, index(bags)))
    schema = T.StructType([docs.schema[doc_id], items.schema[item_id], *(T.StructField(n, T.LongType()) for n in ("both", "n_doc", "n_item")), T.StructField("same", T.BooleanType())])
    arrow_out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bags, (known, at_items, at_counts, sizes) = shared.value
        equal: dict[str, list[int]] = {}
        for k, bag in enumerate(bags):
            equal.setdefault(bag, []).append(k)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                rows, hits, both, n_doc, same = [], [], [], [], []
                for row, bag in enumerate(part.column(1).to_pylist()):
                    tokens = bag.split()
                    own = [(known[t], n) for t, n in Counter(tokens).items() if t in known]
                    total = np.zeros(len(bags), np.int64)
                    if own:
                        total += np.bincount(np.concatenate([at_items[t] for t, _ in own]), np.concatenate([np.minimum(at_counts[t], n) for t, n in own]), len(bags)).astype(np.int64)
                    alike = np.zeros(len(bags), bool)
                    alike[equal.get(bag, [])] = True
                    hit = np.flatnonzero((total > 0) | alike)
                    rows.append(np.full(len(hit), row))
                    hits.append(hit)
                    both.append(total[hit])
                    n_doc.append(np.full(len(hit), len(tokens)))
                    same.append(alike[hit])
                hit = np.concatenate(hits)
                columns = [part.column(0).take(pa.array(np.concatenate(rows))), ids.take(pa.array(hit)), *map(pa.array, (np.concatenate(both), np.concatenate(n_doc), sizes[hit], np.concatenate(same)))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_out, strict=True)], schema=arrow_out)

    return docs.select(doc_id, doc_bag.alias("bag")).mapInArrow(run, schema)
