"""Seconds per headline query: one JSON line.

BENCH_SF_DIR names the data directory, BENCH_CPUS the cores, BENCH_QUERIES a subset of names.
Every query runs to the end into Spark's no-op sink, once, in a warm session.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from feedloom.plans.catalog import load
from feedloom.session import build_session
from feedloom.sources.tables import Tables

HEADLINE = (
    "write_split", "split_summary", "popularity_topk", "overview", "feed_breakdown", "top_items", "latency_percentiles",
    "timeseries_day", "user_item_state", "visit_index", "capped_feedback", "title_tfidf", "content_profile",
    "item_cf_neighbors", "cf_recall", "visual_recall", "svd_factors", "eval_queries_all", "ranking_metrics",
    "half_life_selection", "merge_sources", "quality_prior", "ranker_features", "source_caps", "mmr_rerank", "mix_dynamic",
    "exposure_labels", "hard_negatives", "evaluate_alerts", "stream_state",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "feedloom-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="20g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load()
    # start the JVM's file listing, code generation and Python workers outside the clock
    warm = Tables(spark, folder)
    warm.interactions.groupBy("item_id").count().write.format("noop").mode("overwrite").save()
    warm.users.limit(8).repartition(int(cpus)).mapInPandas(lambda b: b, warm.users.schema).count()
    seconds: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        catalog[name].build(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
