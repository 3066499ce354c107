"""Cutoff-bounded popularity features and the rankings built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.exprs import as_of, finite, hash_uniform, score_key
from ..functions.grouping import sum_before, top_n
from ..session import materialise

#: Rows of user and pool that one task orders.
TASK_ROWS = 2_000_000
#: Rows of a ranked list that every task may hold, some 3 MB.
SHARED_ROWS = 1 << 16


def popularity_features(events: DataFrame, cutoff, half_life_days: float = 7.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per item: cumulative, 1/7/30-day windows (age inclusive), decayed sum and recent growth.

    ``events`` has item_id, ts_ms, weight. A negative or non-finite weight fails the job.
    ``keys`` are further grouping columns; a ``half_life`` column among them replaces the scalar.
    """
    if half_life_days <= 0:
        raise ValueError("half life must be positive")
    weight = F.when(finite(F.col("weight")) & (F.col("weight") >= 0), F.col("weight").cast("double")).otherwise(
        F.raise_error(F.lit("event weights must be finite and non-negative")).cast("double")
    )
    life = F.col("half_life") if "half_life" in keys else F.lit(float(half_life_days))
    rows = as_of(events, cutoff).withColumn("w", weight).withColumn("age", cutoff - F.col("ts_ms"))

    def within(days: int) -> Column:
        return F.sum(F.when(F.col("age") <= days * V.DAY_MS, F.col("w")).otherwise(0.0))

    decay = F.exp(F.lit(-0.6931471805599453) * F.col("age") / (life * V.DAY_MS))
    return (
        rows.groupBy("item_id", *keys)
        .agg(
            F.sum("w").alias("cumulative"),
            within(1).alias("d1"),
            within(7).alias("d7"),
            within(30).alias("d30"),
            F.sum(F.col("w") * decay).alias("decay"),
        )
        .withColumn("growth", F.col("d1") - (F.col("d7") - F.col("d1")) / 6.0)
    )


def popularity_score(snapshot: Column | None = None) -> Column:
    """Decay first; cumulative count, then a verified snapshot score, only break ties."""
    score = F.col("decay") + 1e-6 * F.col("cumulative")
    return score if snapshot is None else score + 1e-9 * snapshot


def popular_items(features: DataFrame, n: int) -> DataFrame:
    """Top n by score; ties by the text form of the id."""
    scored = features.withColumn("score", popularity_score())
    return scored.orderBy(score_key("score").desc(), F.col("item_id").cast("string")).limit(n)


def snapshot_available(available_at: Column, at) -> Column:
    """Counters may be used only when their publication time is known and not in the future."""
    return available_at.isNotNull() & (available_at <= at)


def fallback_popular(
    items: DataFrame, snapshots: DataFrame, behaviour: DataFrame, semantics_start: int, now: int, n: int
) -> DataFrame:
    """Popularity without a trained model: viewable impressions plus verified catalog counters.

    ``items``: item_id, status, popularity_score, stats_version, stats_available_at;
    ``snapshots``: stats_version, stats_available_at. A null time never matches.
    """
    views = behaviour.filter(
        (F.col("event_type") == "impression") & (F.col("received_ms") >= semantics_start)
    ).select("item_id", F.col("received_ms").alias("ts_ms"), F.lit(1.0).alias("weight"))
    features = popularity_features(views, F.lit(now)).select("item_id", "cumulative", "decay")
    verified = snapshots.select("stats_version", "stats_available_at").distinct().withColumn("verified", F.lit(True))
    known = items.filter(F.col("status") == "online").join(verified, ["stats_version", "stats_available_at"], "left")
    usable = F.col("verified").isNotNull() & snapshot_available(F.col("stats_available_at"), F.lit(now))
    scored = known.join(features, "item_id", "left").select(
        "item_id",
        F.coalesce("cumulative", F.lit(0.0)).alias("cumulative"),
        F.coalesce("decay", F.lit(0.0)).alias("decay"),
        F.when(usable, F.col("popularity_score")).otherwise(0.0).alias("snapshot"),
    )
    ranked = scored.withColumn("score", popularity_score(F.col("snapshot")))
    return (
        ranked.orderBy(score_key("score").desc(), F.col("item_id").cast("string"))
        .limit(n)
        .select(
            "item_id", "score",
            F.when(F.col("score") > 0, 1.0).otherwise(0.1).alias("confidence"),
            F.floor("cumulative").cast("bigint").alias("support"),
        )
    )


def exposure_counts(items: DataFrame, exposures: DataFrame) -> DataFrame:
    """Exposures per online item; zero where never served."""
    counts = exposures.groupBy("item_id").agg(F.count(F.lit(1)).alias("exposure_count"))
    online = items.filter(F.col("status") == "online").select("item_id")
    return online.join(counts, "item_id", "left").withColumn(
        "exposure_count", F.coalesce("exposure_count", F.lit(0)).cast("bigint")
    )


def explore_recall(users: DataFrame, counts: DataFrame, seed: int, n: int) -> DataFrame:
    """Per user the n best of the 2n least exposed items, with a small reproducible jitter.

    The pool has exactly 2n rows whatever the catalog size, so it is carried as one array next to
    every user instead of being joined. Users are dealt to tasks by their number before the pool unfolds beside them,
    so only ids travel and a task orders a bounded number of rows.
    """
    pool = counts.orderBy("exposure_count", F.col("item_id").cast("string")).limit(2 * n)
    packed = pool.agg(F.collect_list(F.struct("item_id", "exposure_count")).alias("pool"))
    tasks = max(1, math.ceil(users.count() * 2 * n / TASK_ROWS))
    dealt = users.select("user_id").repartition(max(tasks, users.sparkSession.sparkContext.defaultParallelism), "user_id")
    rows = dealt.select("user_id", F.explode(packed.scalar()).alias("p")).select(
        "user_id", F.col("p.item_id").alias("item_id"), F.col("p.exposure_count").alias("support")
    )
    jitter = hash_uniform(seed, F.col("user_id"), F.col("item_id")) * 0.01
    scored = rows.withColumn("raw_score", F.lit(1.0) / (F.lit(1.0) + F.col("support")) + jitter)
    return top_n(scored, ["user_id"], [score_key("raw_score").desc(), F.col("item_id").cast("string")], n)


def popular_recall(users: DataFrame, features: DataFrame, n: int) -> DataFrame:
    """The same n popular items for every user; n is a constant, so the list travels as an array."""
    top = popular_items(features, n).withColumn("row", F.struct("score", "cumulative", "item_id"))
    packed = top.agg(F.collect_list("row").alias("pool"))
    return users.select("user_id", F.explode(packed.scalar()).alias("p")).select(
        "user_id", F.col("p.item_id").alias("item_id"), F.col("p.score").alias("raw_score"),
        F.floor("p.cumulative").cast("bigint").alias("support"),
    )


def walked(needs: DataFrame, ranked: DataFrame) -> DataFrame:
    """user_id with the first ``n`` rows of ``ranked`` (place from 0); ``needs``: user_id, n.

    Users are dealt to tasks before their places unfold. A ranking read to no great depth goes to every task, a deeper one is joined.
    """
    most = needs.agg(F.max("n").alias("n"), F.sum("n").alias("rows")).first()
    head = materialise(ranked.filter(F.col("place") < (most["n"] or 0)))
    tasks = max(math.ceil((most["rows"] or 0) / TASK_ROWS), needs.sparkSession.sparkContext.defaultParallelism)
    dealt = needs.filter(F.col("n") > 0).repartition(tasks, "user_id")
    places = dealt.select("user_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)).alias("place"))
    return places.join(F.broadcast(head) if (most["n"] or 0) <= SHARED_ROWS else head, "place")


def popular_walk(needs: DataFrame, features: DataFrame) -> DataFrame:
    """user_id, item_id, rank: as many of the most popular items as each user needs (user_id, n), in the order of ``popular_items``."""
    scored = features.select("item_id", (-score_key(popularity_score())).alias("order_score"), F.col("item_id").cast("string").alias("text"), F.lit(1).alias("one"))
    ranked = sum_before(scored, ["one"], F.floor("order_score"), ["order_score", "text"], F.lit(1.0), "place")
    found = walked(needs, ranked.select("item_id", F.col("place").cast("bigint").alias("place")))
    return found.select("user_id", "item_id", F.col("place").alias("rank"))


def explore_walk(needs: DataFrame, counts: DataFrame, seed: int) -> DataFrame:
    """user_id, item_id, rank: the n best of the 2n least exposed items by jittered score, n as each user needs it (user_id, n).

    With n rows wanted beside those a user has seen, the list is whole wherever the catalog has as many.
    """
    placed = counts.withColumn("one", F.lit(1)).withColumn("text", F.col("item_id").cast("string"))
    ranked = sum_before(placed, ["one"], F.col("exposure_count"), ["exposure_count", "text"], F.lit(1.0), "place")
    pool = ranked.select("item_id", "exposure_count", F.col("place").cast("bigint").alias("place"))
    rows = walked(needs.select("user_id", (F.col("n") * 2).alias("n")), pool)
    jitter = hash_uniform(seed, F.col("user_id"), F.col("item_id")) * 0.01
    scored = rows.withColumn("raw_score", F.lit(1.0) / (F.lit(1.0) + F.col("exposure_count")) + jitter)
    order = Window.partitionBy("user_id").orderBy(score_key("raw_score").desc(), F.col("item_id").cast("string"))
    best = scored.select("user_id", "item_id", (F.row_number().over(order) - 1).alias("rank"))
    return best.join(needs, "user_id").filter(F.col("rank") < F.col("n")).select("user_id", "item_id", "rank")
