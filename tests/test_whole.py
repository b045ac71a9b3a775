"""Queries that do the whole job against plain Python: whole texts, all rows, all candidates."""

import re
from collections import Counter

from conftest import DATA

from tracklode.plans import catalog


def fixture(spark, tmp_path, **tables):
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def texts(spark, d):
    read = lambda n, k: [(r[k], r["text"]) for r in spark.read.parquet(f"{d}/{n}.parquet").collect()]
    return read("documents", "doc_id"), read("benchmark", "item_id")


#: Document 1 has the passage after its first 400 characters; no residue of an id modulo 40 is shared.
PASSAGE = "the old mill stood by a river, and the river was wide"
SMALL = {
    "documents": ([(1, "filler " * 100 + PASSAGE), (2, PASSAGE.upper()), (3, ""), (4, "nothing shared"), (5, None), (2, "river river")], "doc_id long, text string"),
    "benchmark": ([(107, PASSAGE), (108, "The"), (109, "river river river")], "item_id long, text string"),
}


def test_em_f1_pairs(spark, tmp_path):
    def tokens(x):
        return [w for w in re.sub(r"[^\w\s]", "", (x or "").lower()).split() if w not in ("a", "an", "the")]

    for d in (fixture(spark, tmp_path, **SMALL), DATA):
        docs, items = texts(spark, d)
        docs, items = [(i, tokens(x)) for i, x in docs], [(i, tokens(x)) for i, x in items]
        want = Counter()
        for i, p in docs:
            bag = Counter(p)
            for j, g in items:
                n = sum((bag & Counter(g)).values())
                if n or p == g:
                    want[(i, j, float(p == g), round(round(2 * n / (len(p) + len(g)), 9), 6) if n else 1.0)] += 1
        got = Counter((r["doc_id"], r["item_id"], r["em"], round(r["f1"], 6)) for r in catalog.em_f1_pairs(spark, d).collect())
        assert sorted((got - want).elements()) == sorted((want - got).elements()) == []
        if d != DATA:
            assert got[(2, 107, 1.0, 1.0)] == 1 and any(k[:2] == (1, 107) for k in got) and got[(3, 108, 1.0, 1.0)] == 1


def test_word_jaccard(spark, tmp_path):
    words = lambda x: {w for w in re.findall(r"\w+", (x or "").lower()) if len(w) > 1}
    for d in (fixture(spark, tmp_path, **SMALL), DATA):
        docs, items = texts(spark, d)
        docs, items = [(i, words(x)) for i, x in docs], [(i, words(x)) for i, x in items]
        want = Counter((i, j, round(round(len(a & b) / len(a | b), 9), 6), round(round(len(a & b) / len(b), 9), 6)) for i, a in docs for j, b in items if a & b)
        got = Counter((r["doc_id"], r["item_id"], round(r["jaccard"], 6), round(r["coverage"], 6)) for r in catalog.word_jaccard(spark, d).collect())
        assert sorted((got - want).elements()) == sorted((want - got).elements()) == []
        if d != DATA:
            assert any(k[:2] == (1, 107) and k[3] == 1.0 for k in got)


def test_contamination_of_all_lengths(spark, tmp_path):
    """Passages of one word to many, inside words and over line ends, against plain containment."""
    tables = {
        "documents": ([(1, "xxthe old mill stood by a river, and the river was widexx"), (2, "a b c d\ne f"), (3, ""), (4, None), (5, "zb c dz"), (6, "one two three")], "doc_id long, text string"),
        "benchmark": ([(1, PASSAGE), (2, "b c d"), (3, "two"), (4, "e t"), (5, "d\ne f"), (6, "one two")], "item_id long, text string"),
    }
    d = fixture(spark, tmp_path, **tables)
    want = sorted((i, j) for i, x in tables["documents"][0] for j, y in tables["benchmark"][0] if x and y in x)
    assert sorted(map(tuple, catalog.contamination(spark, d).collect())) == want


def test_events_hold_whole_turns(spark, tmp_path):
    """The next turn and the question are whole in observations, answers and gold answers, and a repeat after 200 characters counts."""
    said = "first words " * 30 + "\n2. the same late result\n3. another late result"
    turns = [(7, 0, "user", "a question of more than twenty characters"), (7, 1, "assistant", "look for this one thing"), (7, 2, "user", said), (7, 3, "assistant", "and for that other thing"), (7, 4, "user", "other " * 60 + said)]
    d = fixture(spark, tmp_path, conversations=(turns, "conv_id long, turn long, role string, text string"))
    c = catalog.candidates(spark, d).first()
    assert c["structural_valid"] and c["golden_answers"] == [turns[0][3]] and c["final"]["answer"] == turns[0][3]
    assert [s["observation"].count(x[3]) for s, x in zip(c["steps"], (turns[2], turns[4]), strict=True)] == [2, 2]
    assert catalog.step_redundancy(spark, d).first()["reject_reason"] == "redundancy_gt_1"
    for u in catalog.pilot_units(spark, d).collect():
        assert u["current_query_result"].endswith("3. another late result")


def test_parsers_whole(spark, tmp_path):
    said = [(1, 0, "user", "nested {a {b} c}\nand {d}"), (1, 1, "assistant", "one long call\nof\nthree lines"), (1, 2, "user", "short"), (1, 3, "assistant", "word " * 500 + "\nlast")]
    d = fixture(spark, tmp_path, conversations=(said, "conv_id long, turn long, role string, text string"))
    got = {r["turn"]: r for r in catalog.parsers_whole(spark, d).collect()}
    for _, k, role, text in said:
        assert (got[k]["boxed"], got[k]["value"], got[k]["answer"]) == (text, text, text)
        assert got[k]["kind"] == ("search" if role == "assistant" else "answer")
        if role == "assistant":
            assert got[k]["call"] == text
