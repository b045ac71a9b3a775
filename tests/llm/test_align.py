"""Alignment against the libraries on whole texts and plain cuts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tracklode.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "word", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\r", "é", "▁", "<|endoftext|>", "<s>", "</s>", "<0x41>", "'s", "don't", "日本語", "😀", "👩‍👩‍👧", " ", " ", "\x1c", "123", ";", "}", ")", "...", "ﬁ", "é", "\x00", "x" * 70, "====="]


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(A, B)


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {}
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    for x in printable:
        byte[chr(x)] = x
    for k, x in enumerate(x for x in range(256) if x not in printable):
        byte[chr(256 + k)] = x

    def tokens(text):
        if not text:
            return None
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_bytes = [bytes(byte[c] for c in a.id_to_token(k)) for k in a_ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in b_ids for p in [b.id_to_piece(k)]]
        whole = (" " + text).encode()
        return (a_ids, a_bytes, b_ids, b_bytes) if b"".join(a_bytes) == whole == b"".join(b_bytes) else None

    return tokens


def cut(tokens):
    """Groups between the offsets where tokens of both end."""
    a_ids, a_bytes, b_ids, b_bytes = tokens
    a_ends, b_ends = np.cumsum(list(map(len, a_bytes))).tolist(), np.cumsum(list(map(len, b_bytes))).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        m, n = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
        groups.append((a_ids[i:m], b_ids[j:n]))
        i, j = m, n
    return groups


def linked(groups):
    return Counter(x << 32 | y for a, b in groups for x in a for y in b)


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def texts():
    r = random.Random(5)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(3_000)]


def test_parts_equal_the_libraries(aligner, libraries):
    made = texts() + ["ab" * 3_000, "́" * 500 + "x", "日本" * 400, "aé\U0001f600" * 300, " ", "\n", "x "]
    for at in range(0, len(made), 100):
        for text, got in zip(made[at : at + 100], aligner.align(made[at : at + 100]), strict=True):
            tokens = libraries(text)
            if tokens is None:
                assert got == aligner.NOTHING
            else:
                groups = cut(tokens)
                assert got == (written(groups), len(tokens[0]), len(tokens[2]), len(groups), sum(linked(groups).values()), linked(groups))


def test_large_groups_and_generations(libraries, monkeypatch):
    monkeypatch.setattr(align, "LINKS_SPREAD", 2)
    monkeypatch.setattr(align, "PARTS_KEPT", 50)
    monkeypatch.setattr(align, "CHARS_TOGETHER", 30)
    aligner, made = align.Aligner(A, B), texts()[:800]
    for at in range(0, len(made), 40):
        for text, got in zip(made[at : at + 40], aligner.align(made[at : at + 40]), strict=True):
            tokens = libraries(text)
            groups = cut(tokens) if tokens else []
            assert got[0] == written(groups) and got[5] == linked(groups)


def test_union_find_equals_plain_cuts():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(1, 60)
        a, b = sorted({n, *(r.randint(1, n) for _ in range(r.randint(0, 30)))}), sorted({n, *(r.randint(1, n) for _ in range(r.randint(0, 30)))})
        want, i, j = [], 0, 0
        for end in sorted(set(a) & set(b)):
            m, k = a.index(end) + 1, b.index(end) + 1
            want.append((list(range(i, m)), list(range(j, k))))
            i, j = m, k
        assert align.components(a, b) == want
        cuts = np.array(sorted({*a, *b}))
        root = align.roots(len(a), len(b), np.searchsorted(a, cuts), np.searchsorted(b, cuts))
        for places, others in want:
            assert set(root[places]) == set(root[[len(a) + x for x in others]]) == {places[0]}


def report(rows, libraries):
    docs, counts = [], Counter()
    for i, text in rows:
        tokens = libraries(text)
        groups = cut(tokens) if tokens else []
        docs.append((i, tokens, groups, linked(groups)))
        counts.update(set(docs[-1][3]))
    most = Counter()
    for pair, n in counts.items():
        most[pair >> 32] = max(most[pair >> 32], n)
    out = Counter()
    for i, tokens, groups, links in docs:
        best = sum(k for pair, k in links.items() if counts[pair] == most[pair >> 32])
        out[(i, len(tokens[0]) if tokens else 0, len(tokens[2]) if tokens else 0, len(groups), sum(links.values()), best, sum(k * counts[p] for p, k in links.items()), hashlib.sha256(written(groups).encode()).hexdigest() if groups else "")] += 1
    return out


def test_align_is_the_plain_count(spark, libraries, monkeypatch):
    """Several batches, null and odd ids and texts, repeated rows, a long text, clashing columns."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows += list(enumerate(texts()[:300], 10_000)) + [(None, "null id"), (5, None), (6, ""), (7, "▁ away"), rows[3], rows[3], (8, "tail of words " * 5_000)]
    monkeypatch.setattr(align, "BATCH_DOCS", 128)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in ("__text", "batch", "n", "pair", "places", "docs", "links", "best")})
    columns = ["doc_id", *align.NUMBERS, "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, align.align(docs, A, B).select(columns).collect())) == report(rows, libraries)


def test_align_of_nothing(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    assert [tuple(r) for r in align.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_query_reads_all_documents(spark):
    got = queries.op12_align(spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
