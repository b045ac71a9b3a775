"""Operator 12: alignment of two tokenizations by union-find.

Tokens of both tokenizers over one text are the nodes of a bipartite graph, an
edge joins two whose byte ranges overlap, and the connected components are
exactly the smallest groups whose ends agree.  A component's members link every
A token with every B token.

1. Texts are encoded where they lie.  A text is taken apart where neither
   vocabulary has a token across (a blank or line end after other text), and
   the parts' tokens, components and links are remembered, as words recur.
   Texts that are changed on the way by a tokenizer are encoded whole.
2. A batch of documents keeps its different id pairs once; a document refers to
   them by place.  Pairs are counted (documents that hold them) by sums over
   the batches' own counts.
3. Each batch gets the counts of its pairs back, one row a pair and batch, and
   its documents add them up.  So a pair that all documents hold is moved once
   a batch, and no table of all pairs is held anywhere.

Null and empty texts, and texts whose joined token bytes differ from blank and
text, have no tokens: zeros, and an empty ``groups_sha256``.  Null ids are ids
like others; repeated rows are documents of their own and count each.  Texts
are never cut; a very long text is one task's row and one batch's entry.  Only
id and text are read, so extra columns cannot clash.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, arrow_schema, give_back, id_field, materialize, small_batches, struct

#: A batch of documents ends after so many documents, or (document, pair) entries.
BATCH_DOCS, BATCH_ENTRIES = 1_024, 600_000
#: Pairs in one written row.
PAIRS_PER_ROW = 20_000
#: Parts up to this length are remembered; so many make a generation, and two are kept.
PART_CHARS, PARTS_KEPT = 64, 120_000
#: Characters of new parts that are encoded as one text, and links of a group that are spread out there.
CHARS_TOGETHER, LINKS_SPREAD = 200_000, 4_096

#: A part: blanks and line ends with what follows them.  Texts with other white space are split with care for what stands before.
PARTS = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
OTHER_SPACE = re.compile(r"[^\S \n]").search
CAREFUL = re.compile(r"(?<=\S)(?=[ \n])").split


def components(a_ends: list[int], b_ends: list[int]) -> list[tuple[list[int], list[int]]]:
    """Connected components of overlapping tokens, as (A places, B places), in text order."""
    n = len(a_ends)
    parent = list(range(n + len(b_ends)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    i = j = 0
    while i < n and j < len(b_ends):
        a, b = find(i), find(n + j)
        if a != b:
            parent[max(a, b)] = min(a, b)
        if a_ends[i] <= b_ends[j]:
            i, j = i + 1, j + (a_ends[i] == b_ends[j])
        else:
            j += 1
    found: dict[int, tuple[list[int], list[int]]] = {}
    for x in range(len(parent)):
        members = found.setdefault(find(x), ([], []))
        members[x >= n].append(x if x < n else x - n)
    return list(found.values())


def roots(n_a: int, n_b: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over many edges at once: the least node of each node's component (A nodes first).

    Every root that an edge leads away from is hooked to the least root it
    meets, then all paths are halved until they are flat, until no edge joins
    two components.
    """
    parent = np.arange(n_a + n_b)
    b = b + n_a
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return parent
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


class Aligner:
    """What texts' two tokenizations have in common: (groups as text, n_a, n_b, n_groups, n_links, {pair: links})."""

    NOTHING = ("", 0, 0, 0, 0, {})

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        # The byte-level vocabulary writes each byte as one character: printable ones as they are, the others from U+0100 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for word, k in vocabulary.items():
            self.a_bytes[k] = word.encode() if word in added else bytes(map(byte.__getitem__, word))

        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        hexed = re.compile("<0x([0-9A-F]{2})>").fullmatch
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := hexed(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.written = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        # A part may be encoded apart from what stands before, if no token of B reaches across its start.
        self.separable = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces) and [pieces[k] for k in self.b.encode("\n")] == ["▁", "<0x0A>"]
        self.young, self.old = {}, {}  # parts met since the last change of generations, and before

    def compare(self, text: bytes, a: list[int], b: list[int]):
        """One text's groups and links; None if the bytes of the tokens are not those of the text."""
        a_parts, b_parts = [self.a_bytes[k] for k in a], [self.b_bytes[k] for k in b]
        if b"".join(a_parts) != text or b"".join(b_parts) != text:
            return None
        found = components(list(itertools.accumulate(map(len, a_parts))), list(itertools.accumulate(map(len, b_parts))))
        links, n_links, written = {}, 0, []
        for a_places, b_places in found:
            a_ids, b_ids = [a[k] for k in a_places], [b[k] for k in b_places]
            written.append(f"{','.join(map(str, a_ids))}|{','.join(map(str, b_ids))}")
            n_links += len(a_ids) * len(b_ids)
            for (x, k), (y, m) in itertools.product(Counter(a_ids).items(), Counter(b_ids).items()):
                pair = x << 32 | y
                links[pair] = links.get(pair, 0) + k * m
        return ";".join(written), len(a), len(b), len(found), n_links, links

    def encode(self, parts: str) -> tuple[list[int], list[int]]:
        """Tokens of parts that may stand anywhere in a text."""
        return self.a.encode(parts, add_special_tokens=False).ids, self.b.encode("\n" + parts)[2:]

    def part(self, part: str):
        """What is kept of a part: groups as text, four numbers, pairs with one link each, pairs with any number of links."""
        known = self.compare(part.encode(), *self.encode(part))
        return known and (*known[:5], (), tuple(known[5].items()))

    def whole(self, text: str):
        return self.compare(b" " + text.encode(), self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)) or self.NOTHING

    def together(self, parts: list[str]) -> list:
        """``part`` of many parts that end in no white space, encoded as one text."""
        raw = [p.encode() for p in parts]
        a_ids, b_ids = self.encode("".join(parts))
        text = b"".join(raw)
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != text or b"".join(map(self.b_bytes.__getitem__, b_ids)) != text:
            return list(map(self.part, parts))
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_ends, b_ends, ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b]), np.cumsum(list(map(len, raw)))
        a_at, b_at = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        if (a_ends[a_at] != ends).any() or (b_ends[b_at] != ends).any():
            return list(map(self.part, parts))
        # Between two neighbouring ends lies one token of each: an edge.
        cuts = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        cuts = cuts[np.diff(cuts, prepend=0) > 0]
        edges = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
        root = roots(len(a), len(b), *edges)
        first = np.flatnonzero(root[: len(a)] == np.arange(len(a)))  # the first A token of each group
        first_b = np.searchsorted(root[len(a) :], first)  # roots of B ascend too
        n_as, n_bs = np.diff(first, append=len(a)), np.diff(first_b, append=len(b))
        linked = n_as * n_bs
        shown = np.where(linked > LINKS_SPREAD, 0, linked)
        which = np.repeat(np.arange(len(first)), shown)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(shown) - shown, shown)
        pairs = (a[first[which] + inside // n_bs[which]] << 32 | b[first_b[which] + inside % n_bs[which]]).tolist()

        group = np.searchsorted(first, a_at + 1).tolist()  # groups up to the end of each part
        pair_ends, link_ends = np.cumsum(shown).tolist(), np.cumsum(linked).tolist()
        a_text, b_text = list(map(self.written.__getitem__, a_ids)), list(map(self.written.__getitem__, b_ids))
        starts, starts_b = [*first.tolist(), len(a)], [*first_b.tolist(), len(b)]
        groups = [f"{a_text[i]}|{b_text[j]}" if (n := starts[g + 1]) == i + 1 and starts_b[g + 1] == j + 1 else f"{','.join(a_text[i:n])}|{','.join(b_text[j : starts_b[g + 1]])}" for g, (i, j) in enumerate(zip(first.tolist(), first_b.tolist(), strict=True))]
        found, g, i, j, p, links = [], 0, 0, 0, 0, 0
        for part, h, i2, j2 in zip(parts, group, (a_at + 1).tolist(), (b_at + 1).tolist(), strict=True):
            p2, links2 = pair_ends[h - 1], link_ends[h - 1]
            if p2 - p == links2 - links:
                found.append((groups[g] if h == g + 1 else ";".join(groups[g:h]), i2 - i, j2 - j, h - g, links2 - links, tuple(pairs[p:p2]), ()))
            else:  # a group of very many tokens
                found.append(self.part(part))
            g, i, j, p, links = h, i2, j2, p2, links2
        return found

    def align(self, texts: list[str | None]) -> list:
        if not self.separable:
            return [self.whole(t) if t else self.NOTHING for t in texts]
        if len(self.young) > PARTS_KEPT:
            self.young, self.old = {}, self.young
        young, old, split = self.young, self.old, []
        new: dict[str, None] = {}
        for text in texts:
            parts = (CAREFUL if OTHER_SPACE(text) else PARTS)(" " + text) if text else []
            times = Counter(parts)
            split.append((parts, times))
            for part in [p for p in times if p not in young]:
                if part in old:
                    young[part] = old[part]
                else:
                    new[part] = None
        passing = {}  # parts too long to keep
        keep = lambda part, known: (young if len(part) <= PART_CHARS else passing).__setitem__(part, known)
        batch, chars = [], 0
        for part in [*new, None]:
            if batch and (part is None or chars > CHARS_TOGETHER):
                for p, known in zip(batch, self.together(batch), strict=True):
                    keep(p, known)
                batch, chars = [], 0
            if part is not None:
                if part[-1].isspace():
                    keep(part, self.part(part))
                else:
                    batch.append(part)
                    chars += len(part)
        return [self.add(text, parts, times, passing) for text, (parts, times) in zip(texts, split, strict=True)]

    def add(self, text: str | None, parts: list[str], times: Counter, passing: dict):
        if not parts:
            return self.NOTHING
        young, links = self.young, {}
        n_a = n_b = n_groups = n_links = 0
        for part, k in times.items():
            known = young[part] if part in young else passing[part]
            if known is None:
                return self.whole(text)
            _, a, b, groups, linked, pairs, counted = known
            n_a += k * a
            n_b += k * b
            n_groups += k * groups
            n_links += k * linked
            for pair in pairs:
                links[pair] = links.get(pair, 0) + k
            for pair, m in counted:
                links[pair] = links.get(pair, 0) + k * m
        written = ";".join([(young[p] if p in young else passing[p])[0] for p in parts])
        return written, n_a, n_b, n_groups, n_links, links


def narrow(values: np.ndarray) -> bytes:
    """Little-endian bytes in the least width that holds all values."""
    return values.astype(np.min_scalar_type(values.max() if len(values) else 0)).tobytes()


def wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // n}" if n else "<u1").astype(np.int64)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def encoded(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (places of their pairs in the batch's list, links of each) and rows of the batches' lists."""
    schema = T.StructType([
        T.StructField("batch", T.LongType()), id_field(docs, id_col), *struct(*((n, "bigint") for n in NUMBERS), ("groups_sha256", "string"), ("n_pairs", "int"), ("places", "binary"), ("links", "binary")),
        *struct(("base", "int"), ("pairs", "array<bigint>"), ("docs", "array<int>")),
    ])
    out = arrow_schema(schema)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(a_path, b_path).align
        batch, n_docs, entries = TaskContext.get().partitionId() << 32, 0, 0
        places: dict[int, int] = defaultdict(itertools.count().__next__)
        held: list[np.ndarray] = []

        def rows(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in out], schema=out)

        def listed() -> Iterator[pa.RecordBatch]:
            pairs = np.fromiter(places, np.int64, len(places))
            counts = np.bincount(np.concatenate(held), minlength=len(pairs)) if len(pairs) else pairs
            for at in range(0, len(pairs), PAIRS_PER_ROW):
                part = slice(at, at + PAIRS_PER_ROW)
                yield rows(1, batch=[batch], base=[at], pairs=[pairs[part]], docs=[counts[part].astype(np.int32)])

        for table in batches:
            for at in range(0, table.num_rows, SLICE_ROWS):
                part = table.slice(at, SLICE_ROWS)
                made = {n: [] for n in (*NUMBERS, "groups_sha256", "n_pairs", "places", "links")}
                for groups, *numbers, links in align(part.column(1).to_pylist()):
                    for n, v in zip(NUMBERS, numbers, strict=True):
                        made[n].append(v)
                    where = np.fromiter(map(places.__getitem__, links), np.int64, len(links))
                    held.append(where.astype(np.int32))
                    entries += len(where)
                    made["groups_sha256"].append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                    made["n_pairs"].append(len(where))
                    made["places"].append(narrow(where))
                    made["links"].append(narrow(np.fromiter(links.values(), np.int64, len(links))))
                yield rows(part.num_rows, batch=[batch] * part.num_rows, **{id_col: part.column(0)}, **made)
                n_docs += part.num_rows
                if n_docs >= BATCH_DOCS or entries >= BATCH_ENTRIES:
                    yield from listed()
                    batch, n_docs, entries = batch + 1, 0, 0
                    places.clear()
                    places.default_factory = itertools.count().__next__
                    held.clear()
        yield from listed()
        give_back()

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def add_up(schema: T.StructType, id_col: str):
    out = arrow_schema(schema)

    def f(docs: pa.Table, known: pa.Table) -> pa.Table:
        places = known.column("place").to_numpy()
        counts, best = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        counts[places], best[places] = known.column("n").to_numpy(), known.column("best").to_numpy()
        n_best, count_sum = [], []
        for n, at, links in zip(docs.column("n_pairs").to_pylist(), docs.column("places").to_pylist(), docs.column("links").to_pylist(), strict=True):
            at, links = wide(at, n), wide(links, n)
            n_best.append(int(best[at] @ links))
            count_sum.append(int(counts[at] @ links))
        made = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.Table.from_arrays([made[x.name] if x.name in made else docs.column(x.name).cast(x.type) for x in out], schema=out)

    return f


def pair_counts(listed: DataFrame) -> DataFrame:
    """``pair, n, best``: documents that hold an id pair linked, and 1 if no other pair of its A id has more."""
    counts = materialize(listed.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32)), "pairs")
    return counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    rows = materialize(encoded(docs, a_path, b_path, id_col, text_col), "aligned")
    listed = rows.filter("pairs IS NOT NULL").select("batch", "base", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "x")).select("batch", (F.col("base") + F.col("at")).alias("place"), F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    known = listed.join(pair_counts(listed), "pair").select(F.col("batch").alias("of"), "place", "n", "best")
    texts = rows.filter("pairs IS NULL").drop("base", "pairs", "docs")
    schema = T.StructType([id_field(docs, id_col), *struct(*((n, "bigint") for n in (*NUMBERS, "n_best", "count_sum")), ("groups_sha256", "string"))])
    return texts.groupBy("batch").cogroup(known.groupBy("of")).applyInArrow(add_up(schema, id_col), schema)
