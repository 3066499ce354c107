import numpy as np
from pyspark.sql import functions as F

from feedloom.functions import grouping


def test_order_statistics_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in np.round(rng.lognormal(3, 2, 500), 2)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = grouping.order_statistics(df, "x", [("a", 0.5, "linear"), ("b", 0.95, "linear"), ("c", 0.8, "ceil"), ("d", 0.5, "floor")]).first()
    ordered = sorted(values)
    assert got["n"] == 500 and got["low"] == ordered[0] and got["high"] == ordered[-1]
    assert abs(got["a"] - np.quantile(values, 0.5)) < 1e-9
    assert abs(got["b"] - np.quantile(values, 0.95)) < 1e-9
    assert got["c"] == ordered[399] and got["d"] == ordered[249]


def test_order_statistics_inside_brackets(spark, monkeypatch):
    # large groups read only a bracket around each point; equal values may fill it
    monkeypatch.setattr(grouping, "SKETCH_ACCURACY", 50)
    rng = np.random.default_rng(2)
    values = [float(v) for v in np.concatenate([rng.normal(0, 1, 3000), np.full(1500, 0.25)])]
    df = spark.createDataFrame([("g", v) for v in values], "k string, x double")
    got = grouping.order_statistics(df, "x", [("a", 0.5, "linear"), ("b", 0.9, "ceil"), ("c", 0.05, "floor")], ["k"]).first()
    ordered = np.sort(values)
    assert abs(got["a"] - np.quantile(values, 0.5)) < 1e-9
    assert got["b"] == ordered[int(np.ceil(0.9 * 4500)) - 1]
    assert got["c"] == ordered[int(np.floor(0.05 * 4499))]


def test_reference_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 10, 20, 30, 40)], "x double")
    got = grouping.order_statistics(df, "x", [("p50", 0.5, "linear"), ("p95", 0.95, "linear"), ("p99", 0.99, "linear")]).first()
    assert [round(got[c], 6) for c in ("p50", "p95", "p99")] == [20.0, 38.0, 39.6]


def test_sum_before_equals_plain_window(spark):
    rng = np.random.default_rng(3)
    # one hot key holds most rows
    rows = [(int(rng.random() < 0.2), int(t), f"e{i}", float(rng.integers(1, 5))) for i, t in enumerate(rng.integers(0, 100, 400))]
    df = spark.createDataFrame(rows, "k int, t int, id string, w double")
    got = {r["id"]: r["s"] for r in grouping.sum_before(df, ["k"], F.floor(F.col("t") / 7), ["t", "id"], F.col("w"), "s").collect()}
    totals = {0: 0.0, 1: 0.0}
    for k, _t, ident, w in sorted(rows, key=lambda r: (r[1], r[2])):
        assert abs(got[ident] - totals[k]) < 1e-9
        totals[k] += w


def test_dense_index_is_a_permutation(spark):
    ids = [5, 1029, 7, 2053, 100000, 3]
    df = spark.createDataFrame([(i,) for i in ids], "item_id long")
    got = {r["item_id"]: r["item_index"] for r in grouping.dense_index(df, "item_id").collect()}
    assert sorted(got.values()) == list(range(6))
    assert [i for i, _ in sorted(got.items(), key=lambda e: e[1])] == sorted(ids, key=lambda i: (i % 1024, i))


def test_values_of_one_group_are_made_once_and_not_joined_by_a_constant(spark):
    df = spark.range(2000).select((F.col("id") * 7 % 1000).cast("double").alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = grouping.order_statistics(df, "x", [("p50", 0.5, "linear"), ("p95", 0.95, "linear")])
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "Range" not in plan
    assert (found.first()["n"], found.first()["p50"]) == (2000, 499.5)
