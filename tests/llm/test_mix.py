"""Mixing against plain Python and against its SQL."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from tracklode.llm import mix, queries

DDL = "doc_id long, source string, text string"
CLASH = ("grp", "row", "size", "start", "slot", "block", "words", "rank", "n", "all", "target", "weight", "place", "pass")


def words(n, k=0):
    return " ".join(f"w{k}x{i}" for i in range(n))


def fill(sizes, weights, cap):
    """Targets as exact fractions."""
    left, target, full = set(sizes), {}, Fraction(sum(sizes.values()))
    while left:
        share = full / sum(weights[s] for s in left)
        over = [s for s in left if weights[s] * share > cap * sizes[s]]
        if not over:
            return target | {s: weights[s] * share for s in left}
        for s in over:
            target[s] = Fraction(cap * sizes[s])
            full -= cap * sizes[s]
            left.remove(s)
    return target


def plain(rows, block, cap=3, seed="mix"):
    """Words taken of each row, and the sources of the slots in order."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    by_source = defaultdict(list)
    for k, r in enumerate(rows):
        by_source["w" if r[1] is None else "v" + r[1]].append(k)
    names = sorted(by_source, key=str.encode)
    sizes = {s: sum(size[k] for k in by_source[s]) for s in names}
    target = fill(sizes, {s: 1 + k % 3 for k, s in enumerate(names)}, cap)
    take = {s: int(target[s] + Fraction(1, 2)) for s in names}
    counts = {s: take[s] // sizes[s] * -(-sizes[s] // block) + -(-(take[s] % sizes[s]) // block) for s in names if sizes[s]}
    every, taken, mix_slots = sum(counts.values()), Counter(), []
    bits = max(1, (2 * every - 1).bit_length())
    before = 0
    for s, n in counts.items():
        members = sorted(by_source[s], key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, size[k]))
        stream = [k for k in members for _ in range(size[k])]
        low, high = -(-before * 2**bits // every), -(-(before + n) * 2**bits // every)
        before += n
        slots = sorted(int(f"{p:0{bits}b}"[::-1], 2) for p in range(low, high))[:n]
        assert len(slots) == n
        full, blocks = sizes[s] // block, -(-sizes[s] // block)
        for r, slot in enumerate(slots):
            e, place = divmod(r, blocks)
            order = sorted(range(full), key=lambda j: (hashlib.md5(f"{seed}:{e}:{s}:{j}".encode()).hexdigest(), j)) + [full]
            n_words = min(block, sizes[s] - place * block, take[s] - e * sizes[s] - place * block)
            at = order[place] * block
            taken.update(stream[at : at + n_words])
            mix_slots.append((slot, s, n_words))
    out = Counter((r[0], size[k], sizes[s], float(target[s]), taken[k]) for s in names for k in by_source[s] for r in [rows[k]])
    return out, sorted(mix_slots), {s: (take[s], target[s]) for s in names}


def corpus():
    rows = [(k, "hot", words(3 + k % 11, k)) for k in range(120)]
    rows += [(200 + k, f"s{k % 6}", words(k % 9, k)) for k in range(60)]
    rows += [(None, None, "a b c"), (300, None, None), (301, "empty", ""), (302, "empty", " \t\n"), (303, "one", "word"), (304, "long", words(2_000)), (305, "é", "ü ü ü"), (306, "zz", words(7)), (306, "zz", words(7)), (307, "v", "x y z")]
    return rows


@pytest.mark.parametrize("block", [1, 5, 64])
def test_mix_is_the_plain_schedule(spark, block):
    rows = corpus()
    docs = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("x") for c in CLASH})
    got = Counter((r[0], r[1], r[2], round(r[3], 9), r[4]) for r in mix.report(docs, block=block).collect())
    want, _, _ = plain(rows, block)
    assert got == Counter({(a, b, c, round(d, 9), e): n for (a, b, c, d, e), n in want.items()})


def test_sources_meet_their_targets_and_documents_their_cap(spark):
    rows = spark.createDataFrame(corpus(), DDL)
    made = mix.sized(rows, "doc_id", "source", "text")
    sources = mix.targets(mix.weighted(made))
    copies = mix.mixed(made, sources, block=8).collect()
    taken = Counter()
    for r in copies:
        taken[r["grp"]] += r["words"]
    for r in sources.collect():
        assert taken[r["grp"]] == int(r["target"] + 0.5)
    assert all(r["taken"] <= 3 * r["size"] for r in mix.report(rows, block=8).collect())
    # Every prefix of the mix holds about each source's share.
    slots, shares = sorted({(r["slot"], r["grp"]) for r in copies}), Counter()
    total = Counter(s for _, s in slots)
    for at, (_, s) in enumerate(slots, 1):
        shares[s] += 1
        if at <= len(slots) * 0.9:
            assert all(abs(shares[x] - total[x] * at / len(slots)) <= 0.05 * len(slots) for x in total)


def test_targets_equal_the_exact_fill(spark):
    sizes = {"a": 1, "b": 1_000, "c": 10, "d": 0, "e": 3, "f": 500}
    sources = spark.createDataFrame([(s, n, 1 + k % 3) for k, (s, n) in enumerate(sizes.items())], "grp string, source_size long, weight long")
    got = {r["grp"]: r["target"] for r in mix.targets(sources).collect()}
    want = fill(sizes, {s: 1 + k % 3 for k, s in enumerate(sizes)}, 3)
    assert got == pytest.approx({s: float(t) for s, t in want.items()})


def test_reruns_agree_however_the_rows_are_dealt(spark):
    docs = spark.createDataFrame(corpus(), DDL)
    one = Counter(map(tuple, mix.report(docs.repartition(1), block=4).collect()))
    assert one == Counter(map(tuple, mix.report(docs.repartition(7, "text"), block=4).collect()))


def test_mix_of_nothing(spark):
    assert mix.report(spark.createDataFrame([], DDL)).count() == 0
    assert [tuple(r) for r in mix.report(spark.createDataFrame([(1, "a", None)], DDL)).collect()] == [(1, 0, 0, 0.0, 0)]


def test_mix_is_its_sql(spark, duck):
    same_rows(queries.op13_mix(spark, DATA), duck, mix.SQL)
