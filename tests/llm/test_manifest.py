"""Merkle manifest against a plain tree and against its SQL."""

import hashlib
import zlib
from collections import Counter

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from tracklode.llm import manifest, queries

DDL = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Root, and for each leaf the runs on its way: (position, run)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[k : k + 3] for k in range(0, len(level), 3)]
        for k, i in enumerate(at):
            paths[k].append((i % 3, runs[i // 3]))
        level, at = [h(*r) for r in runs], [i // 3 for i in at]
    return level[0], paths


def plain(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        members = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[s] = (members, *tree([leaf(r) for r in members]))
    root, upper = tree([made[s][1] for s in order])
    out = Counter()
    for k, s in enumerate(order):
        members, subroot, paths = made[s]
        for r, path in zip(members, paths, strict=True):
            path = path + upper[k]
            siblings = "".join("".join(run[:at] + run[at + 1 :]) for at, run in path)
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                now = (*r[:4], r[4].replace("\n", ""))
            folded = leaf(now)
            for at, run in path:
                folded = h(*run[:at], folded, *run[at + 1 :])
            out[(r[0], leaf(r), subroot, root, h(siblings), folded, folded == root)] += 1
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 4, 9, 10, 28, 243, 244, 700, 729])
def test_traversal_is_the_plain_tree(m):
    leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(m)]
    root, paths = tree([x.hex() for x in leaves])
    found_root, found = manifest.traverse(leaves, manifest.levels(m))
    assert found_root.hex() == root
    assert [p.hex() for p in found] == ["".join("".join(run[:at] + run[at + 1 :]) for at, run in p) for p in paths]


def test_traversal_keeps_a_few_subtrees():
    """No subtree holds more nodes than its band has, whatever the block."""
    leaves = [bytes(32)] * 729
    growth = manifest.Growth(leaves, 0, 729, 4, 6).finish()
    assert sum(map(len, growth.kept)) == 9 + 3 + 1 and not any(growth.runs)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_is_the_plain_tree(spark, height):
    """Several passes of blocks, a hot source, null and odd ids, sources and texts, repeated rows, clashing columns."""
    rows = [(k, "hot" if k % 3 else f"s{k % 7}", "en", 5, f"line {k}\nmore" if k % 5 else "flat") for k in range(200)]
    rows += [(None, None, None, None, None), (1, None, "fr", 0, ""), (-7, "", "é", 3, "a\nb"), (900, "é", None, 1, "\n"), (901, "zé\U0001f600", "x", 2, None), rows[5], rows[5], (902, "v", "x", 100_000, "long text\n" * 10_000)]
    docs = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("x") for c in ("grp", "rank", "n", "digest", "path", "top", "id", "read", "proof", "root", "__at", "all")})
    assert Counter(map(tuple, manifest.audit(docs, height=height).collect())) == plain(rows)


def test_manifest_of_nothing_and_of_one(spark):
    assert manifest.audit(spark.createDataFrame([], DDL)).count() == 0
    row = (4, "a", "en", 1, "x")
    assert Counter(map(tuple, manifest.audit(spark.createDataFrame([row], DDL)).collect())) == plain([row])


def test_manifest_is_its_sql(spark, duck):
    from conftest import DATA

    same_rows(queries.op11_manifest(spark, DATA), duck, manifest.SQL)
