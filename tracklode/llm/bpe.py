"""Operator 2: byte-level BPE encoding and decoding.

The merges of a piece run over a segment tree on its byte positions.  Leaf i
holds ``rank * n + i`` of the pair that starts at byte i (live parts only), so
the root is the leftmost pair of minimum rank.  A merge is three point updates
of logarithmic cost: the merged part, its left neighbour, and the part that
disappears.  A piece of n bytes takes O(n log n), also for one very long run.

Nulls encode as empty texts; an empty text has no tokens.  Repeated rows give
repeated results; an empty table gives an empty result.  Other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, id_field, map_rows, struct

NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    size = 1 << max(0, (n - 2).bit_length())
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends
    before = list(range(-1, n))  # before[i]: start of the part that ends at i

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while tree[1] < NONE:
        i = tree[1] % n
        j = end[i]
        k = end[j]
        end[i], before[k] = k, i
        put(j, NONE) if j < n - 1 else None
        r = get(piece[i : end[k]]) if k < n else None
        put(i, NONE if r is None else r * n + i)
        h = before[i]
        if h >= 0:
            r = get(piece[h:k])
            put(h, NONE if r is None else r * n + h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks = load_ranks(ranks_path)
        self.find = regex.compile(pattern).findall
        self.pieces = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        #: Piece to its ids.  Long pieces are seldom met twice and not kept.
        self.memo = Memo(lambda piece: tuple(merge(piece.encode(), self.ranks)))

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        memo, ranks = self.memo, self.ranks
        for piece in self.find(text or ""):
            ids += memo[piece] if len(piece) < 64 else merge(piece.encode(), ranks)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec per Python worker; its memo lasts over tasks."""
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col, ids array<int>, n_tokens`` of each row of ``docs``."""
    schema = T.StructType([id_field(docs, id_col), *struct(("ids", "array<int>"), ("n_tokens", "bigint"))])

    def make():
        c = codec(ranks_path, pattern)

        def f(cols):
            ids = [c.encode(x) for x in cols["__text"]]
            return {id_col: cols[id_col], "ids": ids, "n_tokens": [len(x) for x in ids]}

        return f

    return map_rows(docs.select(id_col, F.col(text_col).alias("__text")), make, schema)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """``id_col, decoded binary`` of rows with token ids; null ids decode to no bytes."""
    schema = T.StructType([id_field(tokens, id_col), *struct(("decoded", "binary"))])

    def make():
        c = codec(ranks_path, pattern)
        return lambda cols: {id_col: cols[id_col], "decoded": [c.decode(x or []) for x in cols["__ids"]]}

    return map_rows(tokens.select(id_col, F.col(ids_col).alias("__ids")), make, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode each text, decode its ids, and return digests of both.

    The two steps share one pass, so the ids never leave the Python worker.
    """
    schema = T.StructType([id_field(docs, id_col), *struct(("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string"))])

    def make():
        c = codec(ranks_path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        decimal = [str(i) for i in range(len(c.pieces))]

        def f(cols):
            out = {id_col: cols[id_col], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in cols["__text"]:
                ids = c.encode(text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha(",".join(map(decimal.__getitem__, ids)).encode()))
                out["decoded_sha256"].append(sha(c.decode(ids)))
            return out

        return f

    return map_rows(docs.select(id_col, F.col(text_col).alias("__text")), make, schema)
