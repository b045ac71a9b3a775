"""Numbered lines of files in many splits, locks with owners, and exact quantiles in small ranges."""

import random

import pytest

from tracklode.operators import quantiles
from tracklode.sources import files, runs


@pytest.fixture()
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64")
    yield spark
    spark.conf.set(key, before)


def test_lines_are_numbered_across_splits(small_splits, tmp_path):
    r, want = random.Random(4), {}
    for name, end in (("a", "\n"), ("b", ""), ("c", "\n\n"), ("empty", None)):
        lines = ["" if r.random() < 0.2 else "x" * r.randint(0, 90) + "é€" for _ in range(200)] if end is not None else []
        lines = [*lines, "last"] if end is not None else []
        (tmp_path / name).write_bytes(("\n".join(lines) + (end or "")).encode())
        want[name] = lines + [""] * (end == "\n\n")
    rows = files.numbered_lines(small_splits, str(tmp_path)).collect()
    for name, lines in want.items():
        got = sorted((x["number"], x["line"], x["cut_off"]) for x in rows if x["path"].endswith(f"/{name}"))
        assert got == [(k + 1, line, name == "b" and k == len(lines) - 1) for k, line in enumerate(lines)]


def test_strict_error_names_path_and_line(small_splits, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(['{"a": 1}'] * 50 + ["", "[1]"] + ['{"a": 2}'] * 50))
    with pytest.raises(Exception, match=r"x\.jsonl:52: \[1\]"):
        files.read_strict(small_splits, str(tmp_path), "a int").collect()
    (tmp_path / "x.jsonl").write_text("\n".join(['{"a": 1}'] * 50 + [""] + ['{"a": 2}'] * 50))
    assert files.read_strict(small_splits, str(tmp_path), "a int").count() == 100


def test_cut_off_lines_go(small_splits, tmp_path):
    (tmp_path / "whole").write_text("a\nb\n")
    (tmp_path / "cut").write_text("c\n\nd\n{half")
    (tmp_path / "one").write_text("half")
    assert sorted(x["line"] for x in runs.whole_lines(small_splits, str(tmp_path)).collect()) == ["a", "b", "c", "d"]


def test_second_resumer_leaves_a_fresh_lock(spark, tmp_path):
    folder = str(tmp_path)
    dead = runs.take_lock(spark, folder)
    assert runs.holder(spark, folder) == dead
    with pytest.raises(runs.LockedError):
        runs.take_lock(spark, folder)
    first = runs.take_lock(spark, folder, resume=dead)
    with pytest.raises(runs.LockedError):
        runs.take_lock(spark, folder, resume=dead)  # saw the same dead writer, but came second
    assert runs.holder(spark, folder) == first
    runs.release_lock(spark, folder)
    assert runs.holder(spark, folder) is None
    assert runs.take_lock(spark, folder, resume=True) == runs.holder(spark, folder)


def plain(values, share):
    values = sorted(values)
    place = share * (len(values) - 1)
    low = values[int(place)]
    return low + (values[min(int(place) + 1, len(values) - 1)] - low) * (place - int(place))


@pytest.mark.parametrize("bins, few", [(64, 32), (1_024, 4_096)])
def test_quantiles_equal_sorting(spark, bins, few):
    """A hot group, ties, one value, wide and tiny ranges, nulls and NaN."""
    r = random.Random(8)
    groups = {
        "hot": [r.gauss(0, 1) for _ in range(3_000)], "ties": [float(r.randint(0, 3)) for _ in range(500)], "one": [7.5], "equal": [2.0] * 400,
        "wide": [r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300) for _ in range(300)] + [1.7e308, -1.7e308], "close": [1.0 + k * 2.0**-52 for k in range(200)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None), ("hot", float("nan")), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {x["g"]: x for x in quantiles.exact_quantiles(df, ["g"], "v", shares, bins, few).collect()}
    assert set(got) == {*groups, None}
    for g, vs in [*groups.items(), (None, [1.0, 3.0])]:
        assert got[g]["n"] == len(vs) and got[g]["min"] == min(vs) and got[g]["max"] == max(vs)
        for name, share in shares.items():
            assert got[g][name] == pytest.approx(plain(vs, share), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"p50": 0.5}).count() == 0
