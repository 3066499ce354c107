"""Chronological splits, their checks and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import sample_key
from ..functions.grouping import order_statistics, top_n
from ..values import HOUR_MS

SPLITS = ("train", "validation", "test")


def time_cutoffs(interactions: DataFrame) -> DataFrame:
    """One row: train_cutoff and validation_cutoff at sorted index ceil(.8n)-1 and ceil(.9n)-1.

    Times are counted once per value; hourly totals then locate the hour of each border, and only
    that hour's distinct times are ordered. Fails when the three splits would not be strictly
    ordered and non-empty.
    """
    counts = interactions.groupBy("ts_ms").agg(F.count(F.lit(1)).alias("c")).withColumn(
        "hour", F.floor(F.col("ts_ms") / HOUR_MS)
    )
    everything = Window.partitionBy(F.lit(0))
    # one row per hour of the log's time span
    hours = (
        counts.groupBy("hour")
        .agg(F.sum("c").alias("c"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
        .withColumn("upto", F.sum("c").over(everything.orderBy("hour")))
        .withColumn("n", F.sum("c").over(everything))
        .withColumn("first_ms", F.min("lo").over(everything))
        .withColumn("last_ms", F.max("hi").over(everything))
    )
    borders = F.explode(
        F.array(*[F.struct(F.lit(name).alias("border"), F.ceil(F.round(F.col("n") * share, 9)).alias("rank"))
                  for name, share in (("train", 0.8), ("validation", 0.9))])
    )
    located = (
        hours.select("hour", "upto", "c", "n", "first_ms", "last_ms", borders.alias("b"))
        .filter((F.col("b.rank") <= F.col("upto")) & (F.col("b.rank") > F.col("upto") - F.col("c")))
        .select("hour", "n", "first_ms", "last_ms", "b.border", (F.col("b.rank") - F.col("upto") + F.col("c")).alias("rank"))
    )
    inside = Window.partitionBy("border").orderBy("ts_ms")
    exact = (
        counts.join(F.broadcast(located), "hour")
        .withColumn("upto", F.sum("c").over(inside))
        .filter(F.col("upto") >= F.col("rank"))
        .agg(
            F.max("n").alias("n"), F.max("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"),
            F.min(F.when(F.col("border") == "train", F.col("ts_ms"))).alias("train_cutoff"),
            F.min(F.when(F.col("border") == "validation", F.col("ts_ms"))).alias("validation_cutoff"),
        )
    )
    ordered = (F.col("train_cutoff") < F.col("validation_cutoff")) & (F.col("validation_cutoff") < F.col("last_ms"))
    checked = F.when(ordered, F.col("train_cutoff")).otherwise(
        F.raise_error(F.lit("interactions cannot form strict chronological splits")).cast("bigint")
    )
    return exact.select("n", "first_ms", checked.alias("train_cutoff"), "validation_cutoff", "last_ms")


def time_split(interactions: DataFrame, train_cutoff, validation_cutoff) -> DataFrame:
    """Adds ``split``; rows with equal timestamps always fall on the same side.

    The borders are the two numbers of ``time_cutoffs``; as literals they reach the scan.
    """
    return interactions.withColumn(
        "split",
        F.when(F.col("ts_ms") <= train_cutoff, "train")
        .when(F.col("ts_ms") <= validation_cutoff, "validation")
        .otherwise("test"),
    )


def split_summary(split_rows: DataFrame) -> DataFrame:
    """Rows, users, items, time range per split and whether it starts after the previous one ends."""
    by_user = (
        split_rows.groupBy("split", "user_id")
        .agg(F.count(F.lit(1)).alias("c"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
        .groupBy("split")
        .agg(
            F.sum("c").alias("rows"),
            F.count(F.lit(1)).alias("users"),
            F.min("lo").alias("first_ms"),
            F.max("hi").alias("last_ms"),
        )
    )
    by_item = (
        split_rows.select("split", "item_id").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("items"))
    )
    summary = by_user.join(by_item, "split")
    # three rows: the previous split's end comes from a self join on its name
    earlier = F.when(F.col("split") == "train", "validation").when(F.col("split") == "validation", "test")
    ends = summary.select(earlier.alias("split"), F.col("last_ms").alias("previous_last_ms"))
    return summary.join(ends, "split", "left").withColumn(
        "leak_free", F.coalesce(F.col("first_ms") > F.col("previous_last_ms"), F.lit(True))
    )


def user_activity_distribution(interactions: DataFrame) -> DataFrame:
    """min / p50 / p95 / max interactions per user at index floor(q*(n-1)), and the mean."""
    per_user = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
    points = order_statistics(per_user, "c", [("p50", 0.5, "floor"), ("p95", 0.95, "floor")])
    total = per_user.agg(F.avg("c").alias("mean"))
    return points.select(
        F.col("n").alias("users"), F.col("low").alias("min"), "p50", "p95", F.col("high").alias("max"),
        total.scalar().alias("mean"),
    )


def duplicate_counts(interactions: DataFrame) -> DataFrame:
    """Repeated rows and repeated (user, item) pairs; neither is removed."""
    pairs = interactions.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("c"), F.count_distinct("ts_ms").alias("d")
    )
    return pairs.agg(
        F.sum("c").alias("rows"),
        F.sum(F.col("c") - F.col("d")).alias("duplicate_rows"),
        F.sum(F.col("c") - 1).alias("duplicate_pairs"),
    )


def item_set_difference(left: DataFrame, right: DataFrame, samples: int = 10) -> DataFrame:
    """Ids on one side only: the total per side and the first ``samples`` ids of each."""
    both = (
        left.select("item_id").distinct().withColumn("l", F.lit(1))
        .join(right.select("item_id").distinct().withColumn("r", F.lit(1)), "item_id", "full_outer")
        .filter(F.col("l").isNull() | F.col("r").isNull())
        .select(F.when(F.col("r").isNull(), "left_only").otherwise("right_only").alias("side"), "item_id")
    )
    totals = both.groupBy("side").agg(F.count(F.lit(1)).alias("total"))
    return top_n(both, ["side"], [F.col("item_id")], samples).join(totals, "side")


def user_histories(split_rows: DataFrame) -> DataFrame:
    """One row per user of all users with the train items and times in time order; empty arrays if none.

    The list per user is the output format; it holds that user's train rows only.
    """
    everyone = split_rows.select("user_id").distinct()
    train = (
        split_rows.filter(F.col("split") == "train")
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("ts_ms", "item_id"))).alias("h"))
    )
    empty = F.array().cast("array<bigint>")
    return everyone.join(train, "user_id", "left").select(
        "user_id",
        F.coalesce(F.col("h.item_id"), empty).alias("item_ids"),
        F.coalesce(F.col("h.ts_ms"), empty).alias("timestamps_ms"),
    )


def select_users(
    users: DataFrame, seed: int, purpose: str, limit: int | None, always: DataFrame | None = None
) -> DataFrame:
    """All users, or the first ``limit`` by digest; users in ``always`` come first within the limit."""
    unique = users.select("user_id").distinct()
    if limit is None:
        return unique
    if always is not None:
        marked = always.select("user_id").distinct().withColumn("first", F.lit(0))
        unique = unique.join(marked, "user_id", "left")
    else:
        unique = unique.withColumn("first", F.lit(None).cast("int"))
    key = sample_key(seed, purpose, F.col("user_id"))
    return (
        unique.select("user_id", F.coalesce("first", F.lit(1)).alias("first"), key.alias("digest"))
        .orderBy("first", "digest", "user_id")
        .limit(limit)
        .select("user_id")
    )


def interaction_matrix(interactions: DataFrame, feedback: DataFrame, cutoff) -> DataFrame:
    """Long user x item matrix: 1.0 per distinct pair plus the summed feedback weight, as of the cutoff."""
    base = (
        interactions.filter(F.col("ts_ms") <= cutoff).select("user_id", "item_id").distinct()
        .withColumn("weight", F.lit(1.0))
    )
    extra = feedback.filter(F.col("ts_ms") <= cutoff).select("user_id", "item_id", F.col("weight").cast("double"))
    return base.unionByName(extra).groupBy("user_id", "item_id").agg(F.sum("weight").alias("weight"))


def data_version(parts: dict[str, DataFrame], seed: int, policy: str, key: str) -> DataFrame:
    """16 hex characters over the contents of the inputs, the seed and the policy.

    Rows are hashed, digests folded per prefix and the folded digests hashed again, so the value
    does not depend on the order or the partitioning of rows.
    """
    folded = None
    for name, df in sorted(parts.items()):
        one = content_digest(df, df.columns).select(F.lit(name).alias("name"), "rows", "digest")
        folded = one if folded is None else folded.unionByName(one)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))),
                                      lambda p: F.concat_ws("=", p["name"], p["digest"])), ";")
    return folded.agg(joined.alias("inputs")).select(
        F.substring(F.sha2(F.concat_ws("|", "inputs", F.lit(str(seed)), F.lit(policy), F.lit(key)), 256), 1, 16)
        .alias("data_version")
    )


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free digest of a table: row digests are folded by prefix with sums of 32-bit pieces.

    Sums combine in map tasks; only 4096 prefixes reach the last step.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    pieces = [F.conv(F.substring("h", 4 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(4)]
    folded = (
        df.select(row.alias("h"))
        .groupBy(F.substring("h", 1, 3).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("c"), *[F.sum(p).cast("string").alias(f"s{i}") for i, p in enumerate(pieces)])
    )
    line = F.concat_ws(":", "prefix", F.col("c").cast("string"), *[f"s{i}" for i in range(4)])
    return folded.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256).alias("digest"),
    )
