"""Every catalogue query against its SQL, and the ones without SQL for rows."""

import pytest
from conftest import DATA, same_rows

from tracklode.plans import catalog, composites, durable, reports  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, DATA), duck, catalog.SQL[name])


def test_leakage_summary(spark):
    r = catalog.leakage_summary(spark, DATA).first()
    assert r["all_pass"] == (r["sibling_query_literal_in_reasoning"] == 0 and r["sibling_result_leakage"] == 0)
    assert r["units"] == r["unique_unit_ids"]


def test_step_redundancy(spark):
    assert {r["reject_reason"] for r in catalog.step_redundancy(spark, DATA).collect()} <= {None, "redundancy_gt_1", "redundancy_identity_unavailable"}


def test_judge_scores(spark):
    rows = catalog.judge_scores(spark, DATA).collect()
    assert rows and all(r["process_score"] == int(r["intent"]["score"] == 1 and r["retrieval"]["score"] == 1) for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
