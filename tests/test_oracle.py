"""Queries against their SQL. A spread of queries runs by default; ORACLE_ALL=1 runs every one."""

import os
from pathlib import Path

import pytest

from check_oracle import compare, connect
from feedloom.plans.catalog import load
from feedloom.sources.tables import Tables

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
SPREAD = (
    "time_cutoffs", "split_summary", "popularity_topk", "explore_recall", "user_item_state", "capped_feedback", "overview",
    "feed_breakdown", "top_items", "item_cf_neighbors", "title_tfidf", "eval_queries_all", "ranking_metrics", "merge_sources",
    "quality_prior", "hard_negatives", "evaluate_alerts", "stream_state",
)
NAMES = list(load()) if os.environ.get("ORACLE_ALL") else SPREAD


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    query = load()[name]
    df = query.build(Tables(spark, FOLDER))
    if query.oracle is None:
        assert df.count() > 0
    else:
        assert compare(df, connect(FOLDER), query.oracle) == ""


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
