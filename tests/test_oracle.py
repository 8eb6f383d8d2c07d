"""Spark vs DuckDB on the smallest tables for a representative set of queries
(the full set runs with `python tests/oracle.py /root/testdata/sf0.01`)."""

import pytest

import __spark_entry__ as E
from conftest import SF0001
from oracle import compare, duck

FAST = [
    "attribute_frequency",
    "cooccurrence_weights",
    "recommend_5",
    "similar_pairs",
    "pair_graph_features",
    "value_type_profile",
    "last_decision",
    "profile_stats",
    "queue_max",
    "pair_sample_tally",
    "sample_pages_read",
    "incidence_read",
    "nested_value_counts_read",
    "upserted_samples",
    "cluster_membership_rewritten",
    "decision_log_appended",
    "feature_progress",
    "last_updates",
    "queue_related",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF0001)
    assert r["status"] == "OK", r


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["sample_id", "attribute", "total_weight", "rank"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
