"""Operator 6: best-fit packing by minimum bin slack.

Three steps, none of which gathers documents anywhere:

1. Each text is tokenized where it lies; pieces of at most ``capacity`` tokens
   (ids, start, length, crc32) go to the shared scratch folder.
2. The driver sees only how many pieces have each length: at most ``capacity``
   numbers, whatever the corpus.  Per bin it takes the largest length left and
   finds, by a bitset subset-sum over the lengths left, the fullest
   combination that goes with it.  A combination is removed as often as the
   counts allow at once, so the work follows the number of different
   combinations, not of bins.
3. Every piece gets its rank among the pieces of its length: a count per
   (length, salt), running sums of those counts, and a row number inside the
   salt.  A length that holds a third of all pieces gets proportionally many
   salts.  Rank and plan give sequence and offset.

Null text counts as empty and still has its end id.  Literals of special tokens
in a text are encoded as the library's plain call does, as those tokens.  Long
texts are tokenized whole, by their blank-separated chunks, and cut into
pieces.  Ties are broken by
(id, piece, crc32); rows equal in all of these are interchangeable.  Repeated
rows are packed once each.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import Memo, id_field, map_rows, materialize, struct

#: The splitting pattern in the tokenizer file; fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces of one length that share a row-number task.
ROWS_PER_SALT = 2_000


class WordIds:
    """Token ids of whole texts as little-endian 32-bit bytes, through memos of words.

    The tokenizer drops white space and no token spans it, so a text's ids are
    the ids of its blank-separated chunks.  A chunk of characters below U+0250
    is stable under NFC, and is split and lower-cased here to make the memo of
    pieces small; any other chunk goes to the tokenizer as it is.
    """

    plain = re.compile("[\x21-\x7e\xa1-ɏ]+").fullmatch

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Literals of added tokens in a text become those tokens, as in the library's plain call.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda _: None
        self.find = regex.compile(WORD_PATTERN).findall
        # The file's byte-level step writes each byte as one character: printable ones as they are, the others from U+0100 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        self.bytewise = {b: b for b in printable} | {b: 0x100 + k for k, b in enumerate(others)}
        self.pieces = Memo(self.piece, 400_000)
        self.words = Memo(self.word, 500_000)

    def piece(self, text: str) -> bytes:
        """Ids of one normalized piece, by the tokenizer's merges alone."""
        tokens = self.tokenizer.model.tokenize(text.encode().decode("latin-1").translate(self.bytewise))
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, chunk: str) -> bytes:
        if len(chunk) < 48 and self.plain(chunk) and not self.added(chunk) and unicodedata.is_normalized("NFC", chunk):
            return b"".join(map(self.pieces.__getitem__, self.find(chunk.lower())))
        return self.whole(chunk)

    def encode(self, text: str) -> bytes:
        words, out = self.words, []
        for line in text.split("\n"):
            chunks = line.split(" ")
            if len(line) < 48 * len(chunks) or max(map(len, chunks)) < 48:
                out += map(words.__getitem__, chunks)
            else:  # long chunks are seldom met twice and not kept
                out += (words[c] if len(c) < 48 else self.whole(c) for c in chunks)
        return b"".join(out)


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id", encoder=WordIds) -> DataFrame:
    """Pieces of every text: ``id_col, piece, start, length, ids_crc32``."""
    schema = T.StructType([id_field(docs, id_col), *struct(("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"))])
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encode = encoder(tokenizer_path).encode

        def f(cols):
            out = {n: [] for n in schema.names}
            for key, text in zip(cols[id_col], cols["__text"], strict=True):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for n, v in zip(schema.names, (key, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[n].append(v)
            return out

        return f

    return map_rows(docs.select(id_col, F.col(text_col).alias("__text")), make, schema)


def fullest(space: int, lengths: list[int], left: dict[int, int]) -> dict[int, int]:
    """The combination of lengths (at most ``left`` of each) whose sum is the largest up to ``space``.

    Bit s of the set is on if some combination sums to s.  Copies of a length
    enter in blocks of 1, 2, 4, ...; the set before each block is kept, to
    walk back from the best sum.
    """
    mask, reach, steps = (1 << (space + 1)) - 1, 1, []
    for length in lengths:
        copies = min(left[length], space // length) if length <= space else 0
        block = 1
        while copies > 0:
            block = min(block, copies)
            steps.append((length, block, reach))
            reach |= (reach << (length * block)) & mask
            copies -= block
            block *= 2
        if reach >> space & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, block, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + block
            at -= length * block
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many, {length: copies}), by minimum bin slack with the largest length left in each bin."""
    left, bins = {n: c for n, c in counts.items() if c > 0}, []
    lengths = sorted(left, reverse=True)
    while lengths:
        first = lengths[0]
        left[first] -= 1
        used = fullest(capacity - first, lengths, left)
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        bins.append((times, used))
        for n, k in used.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n]]
    return bins


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id", encoder=WordIds) -> DataFrame:
    """Pieces with their places: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``."""
    return place(cut(docs, tokenizer_path, capacity, end_id, text_col, id_col, encoder), capacity, id_col)


def place(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Sequence and offset of pieces with their lengths."""
    spark = pieces.sparkSession
    pieces = materialize(pieces.withColumn("__r", F.xxhash64(F.monotonically_increasing_id())), "pieces")  # __r deals rows out, equal ones too
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    # For each length its runs of ranks: (first rank, first sequence, copies in a bin, offset of the first copy).
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = dict.fromkeys(counts, 0), 0
    for times, used in plan(counts, capacity):
        offset = 0
        for n in sorted(used, reverse=True):
            runs.setdefault(n, []).append((taken[n], sequence, used[n], offset))
            taken[n] += used[n] * times
            offset += n * used[n]
        sequence += times
    tables = spark.sparkContext.broadcast({n: np.array(v, np.int64).T for n, v in runs.items()})  # runs follow the combinations, bounded by capacity

    salts = {n: max(1, -(-c // ROWS_PER_SALT)) for n, c in counts.items()}
    by_length = F.from_json(F.lit(json.dumps([salts.get(n, 1) for n in range(1, capacity + 1)])), "array<int>")
    salted = pieces.withColumn("__salt", F.pmod("__r", F.element_at(by_length, F.col("length").cast("int"))))
    cells = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select("length", "__salt", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = W.partitionBy("length", "__salt").orderBy(id_col, "piece", "ids_crc32")
    ranked = salted.join(cells, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.row_number().over(inside) - 1)

    columns = [id_col, "piece", "start", "length", "ids_crc32"]
    schema = T.StructType([ranked.schema[c] for c in columns] + list(struct(("sequence_id", "bigint"), ("offset", "bigint"))))

    def make():
        table = tables.value

        def f(cols):
            sequences, offsets = [], []
            for n, rank in zip(cols["length"], cols["__rank"], strict=True):
                first, seq, copies, offset = table[n]
                k = int(np.searchsorted(first, rank, side="right")) - 1
                r = rank - int(first[k])
                sequences.append(int(seq[k]) + r // int(copies[k]))
                offsets.append(int(offset[k]) + r % int(copies[k]) * n)
            return {c: cols[c] for c in columns} | {"sequence_id": sequences, "offset": offsets}

        return f

    return map_rows(ranked.select(*columns, "__rank"), make, schema)
