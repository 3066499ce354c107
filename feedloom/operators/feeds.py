"""Feeds for all users: fallback plan, the three feeds, the chain from lists to snapshots, pages and clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from .behaviour import exclude_seen, online_only
from .merge import TEXT_ID, quality_prior
from .mixing import apply_source_caps, mmr_rerank, place_boosts


def fallback_plan(
    users: DataFrame, unified: DataFrame, svd: DataFrame, popular: DataFrame, explore: DataFrame, seen: DataFrame, limit: int,
    items: DataFrame | None = None,
) -> DataFrame:
    """Ordered rows per user from the first source that has any: unified, then SVD, then popular; a
    shortfall is filled by explore rows not yet in the list.

    Inputs: user_id, item_id, source, rank. ``users``: user_id, dataset_user_id and, where known, ``model_failed``:
    the unified model raised an error for this user, so its rows do not count. The reason tells which step was
    taken. Seen items, and offline ones where ``items`` is given, leave after the choice, before the fill and the cut.
    """
    def shown(rows: DataFrame) -> DataFrame:
        fresh = exclude_seen(rows, seen)
        return fresh if items is None else online_only(fresh, items)

    failing = F.coalesce("model_failed", F.lit(False)) if "model_failed" in users.columns else F.lit(False)
    names = ["user_id", "item_id", "source", "rank"]
    tiers = None
    for tier, rows in enumerate((unified, svd, popular)):
        part = rows.select(*names).withColumn("tier", F.lit(tier))
        tiers = part if tiers is None else tiers.unionByName(part)
    mapped = users.select("user_id", F.col("dataset_user_id").isNotNull().alias("mapped"), failing.alias("failed"))
    # unmapped users have no personal model
    usable = tiers.join(mapped, "user_id").filter((F.col("mapped") | (F.col("tier") == 2)) & ~((F.col("tier") == 0) & F.col("failed"))).drop("failed")
    first = usable.groupBy("user_id").agg(F.min("tier").alias("best"), F.max("mapped").alias("mapped"))
    chosen = shown(usable.join(first.select("user_id", "best"), "user_id").filter(F.col("tier") == F.col("best"))).withColumn("step", F.lit(0))
    counts = chosen.groupBy("user_id").agg(F.count(F.lit(1)).alias("held"))
    plan = mapped.join(first.select("user_id", "best"), "user_id", "left").join(counts, "user_id", "left").na.fill(0, ["held"])
    short = plan.filter(F.col("held") < limit).select("user_id")
    fill = shown(explore.select(*names)).join(short, "user_id", "left_semi")
    fill = fill.join(chosen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").withColumn("step", F.lit(1))
    order = Window.partitionBy("user_id").orderBy("step", "rank", F.expr(TEXT_ID))
    rows = (
        chosen.select(*names, "step").unionByName(fill.select(*names, "step"))
        .withColumn("place", F.row_number().over(order) - 1)
        .filter(F.col("place") < limit)
    )
    reason = (
        F.when(F.col("best") == 1, "unified_model_unavailable_svd_fallback")
        .when((F.coalesce("best", F.lit(2)) == 2) & F.col("mapped") & F.col("failed"), "deep_model_failed_popular_fallback")
        .when((F.coalesce("best", F.lit(2)) == 2) & ~F.col("mapped"), "cold_start")
        .when(F.coalesce("best", F.lit(2)) == 2, "personalized_model_unavailable")
        .when(F.col("held") < limit, "candidate_shortfall")
    )
    reasons = plan.select("user_id", reason.alias("fallback_reason"))
    return rows.join(reasons, "user_id").select("user_id", "item_id", "source", F.col("place").alias("rank"), "fallback_reason")


def ranked_union(merged: DataFrame, ranker: DataFrame | None = None, limit: int = 500) -> DataFrame:
    """Personal lists from the union of the sources, under the source caps: user_id, item_id, source, rank.

    ``ranker`` has user_id, item_id, score; without it the quality prior ranks.
    """
    if ranker is None:
        ordered = quality_prior(merged).select(
            "user_id", "item_id", F.col("primary_source").alias("source"), F.col("place").alias("rank")
        )
    else:
        place = Window.partitionBy("user_id").orderBy(F.round("score", 9).desc(), F.expr(TEXT_ID))
        ordered = merged.join(ranker, ["user_id", "item_id"]).select(
            "user_id", "item_id", F.col("primary_source").alias("source"), (F.row_number().over(place) - 1).alias("rank")
        )
    return apply_source_caps(ordered, limit).select("user_id", "item_id", "source", "rank")


def feed_lists(
    users: DataFrame, unified: DataFrame, svd: DataFrame, popular: DataFrame, explore: DataFrame, seen: DataFrame, limit: int,
    items: DataFrame | None = None,
) -> DataFrame:
    """Lists of the three feeds of every user: user_id, feed_type, item_id, source, rank, fallback_reason.

    The personalized feed follows ``fallback_plan``; the popular one takes popular rows and fills a shortfall with
    explore rows, the explore one takes explore rows; seen items are in none, nor are offline ones where ``items`` is given,
    so none of them takes a place under the limit. Only the personalized feed has a reason.
    """
    none = popular.filter(F.lit(False))
    personal = fallback_plan(users, unified, svd, popular, explore, seen, limit, items)
    known = fallback_plan(users, none, none, popular, explore, seen, limit, items)
    place = Window.partitionBy("user_id").orderBy("rank", F.expr(TEXT_ID))
    fresh = exclude_seen(explore.select("user_id", "item_id", "source", "rank"), seen).join(users.select("user_id"), "user_id", "left_semi")
    if items is not None:
        fresh = online_only(fresh, items)
    fresh = fresh.withColumn("rank", F.row_number().over(place) - 1).filter(F.col("rank") < limit)
    no_reason = F.lit(None).cast("string")
    names = ["user_id", "feed_type", "item_id", "source", "rank", "fallback_reason"]
    return (
        personal.withColumn("feed_type", F.lit("personalized")).select(*names)
        .unionByName(known.withColumn("feed_type", F.lit("popular")).withColumn("fallback_reason", no_reason).select(*names))
        .unionByName(fresh.withColumn("feed_type", F.lit("explore")).withColumn("fallback_reason", no_reason).select(*names))
    )


def snapshot_heads(users: DataFrame, reasons: DataFrame, now: int, seed: int, model_version: str | None, minutes: int) -> DataFrame:
    """One snapshot per user and feed: snapshot_id, user_id, feed_type, model_version, seed, fallback_reason, created_ms,
    expires_ms. ``reasons``: user_id, feed_type, fallback_reason.

    Ids and seeds are digests of user, feed, time and ``seed``, so a repeated job makes the same snapshots.
    """
    feeds = F.array(*[F.lit(f) for f in V.FEEDS])
    heads = users.select("user_id", F.explode(feeds).alias("feed_type"))
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "user_id", "feed_type"), 256), 1, 8), 16, 10).cast("bigint") % (1 << 31)
    ident = F.substring(F.sha2(F.concat_ws(":", F.lit("snapshot"), "user_id", "feed_type", F.lit(str(now)), "seed"), 256), 1, 32)
    told = reasons.filter(F.col("fallback_reason").isNotNull()).select("user_id", "feed_type", "fallback_reason").distinct()
    return (
        heads.withColumn("seed", drawn).withColumn("snapshot_id", ident).join(told, ["user_id", "feed_type"], "left")
        .select(
            "snapshot_id", "user_id", "feed_type", F.lit(model_version).cast("string").alias("model_version"), "seed", "fallback_reason",
            F.lit(now).cast("bigint").alias("created_ms"), F.lit(now + minutes * V.MINUTE_MS).cast("bigint").alias("expires_ms"),
        )
    )


def build_feeds(lists: DataFrame, heads: DataFrame, items: DataFrame, boosts: DataFrame, limit: int) -> DataFrame:
    """Rows of the snapshots: snapshot_id, position, item_id, source, forced.

    ``lists`` as ``feed_lists`` has them, ``heads`` as ``snapshot_heads``; ``boosts``: user_id, feed_type, item_id,
    position, priority. Offline items leave first and last; lists are cut to the limit, put in diversity order, and
    boosts then take their places. All feeds go through one pass, each under its snapshot's id.
    """
    keys = heads.select("user_id", "feed_type", "snapshot_id")
    named = online_only(lists, items).join(keys, ["user_id", "feed_type"])
    place = Window.partitionBy("snapshot_id").orderBy("rank", F.expr(TEXT_ID))
    cut = named.select("snapshot_id", "item_id", "source", (F.row_number().over(place) - 1).alias("rank")).filter(F.col("rank") < limit)
    diverse = mmr_rerank(cut.withColumnRenamed("snapshot_id", "user_id"), items)
    wanted = online_only(boosts, items).join(keys, ["user_id", "feed_type"]).drop("user_id", "feed_type").withColumnRenamed("snapshot_id", "user_id")
    placed = online_only(place_boosts(diverse, wanted, limit), items)
    order = Window.partitionBy("user_id").orderBy("rank")
    return placed.select(
        F.col("user_id").alias("snapshot_id"), (F.row_number().over(order) - 1).alias("position"), "item_id", "source", "forced"
    )


def feed_pages(snapshots: DataFrame, items: DataFrame, offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows, pages) of one page per snapshot.

    The page covers snapshot positions [offset, offset + limit); invalidated and offline rows are
    hidden and the remaining rows are numbered from 0. has_more tells whether a visible row follows.
    """
    visible = online_only(snapshots.filter(F.col("invalidated_ms").isNull()), items)
    inside = visible.filter((F.col("position") >= offset) & (F.col("position") < offset + limit))
    order = Window.partitionBy("snapshot_id").orderBy("position")
    rows = inside.select(
        "snapshot_id", "user_id", "item_id", "source", F.col("position").alias("snapshot_position"),
        (F.row_number().over(order) - 1).alias("position"),
    )
    page = (F.col("position") >= offset) & (F.col("position") < offset + limit)
    counts = visible.groupBy("snapshot_id").agg(
        F.count_if(page).alias("returned_count"), F.max("position").alias("last")
    )
    all_pages = snapshots.select("snapshot_id", "user_id").distinct().join(counts, "snapshot_id", "left").select(
        "snapshot_id", "user_id", F.coalesce("returned_count", F.lit(0)).alias("returned_count"),
        F.coalesce(F.col("last") >= offset + limit, F.lit(False)).alias("has_more"),
    )
    return rows, all_pages


def expire_snapshots(heads: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(snapshots still alive, one row with ``deleted_expired_snapshots`` and ``retained_active_snapshots``)."""
    alive = F.col("expires_ms") > now
    counts = heads.agg(F.count_if(~alive).alias("deleted_expired_snapshots"), F.count_if(alive).alias("retained_active_snapshots"))
    return heads.filter(alive), counts


def invalidate_snapshots(snapshots: DataFrame, operations: DataFrame) -> DataFrame:
    """Marks open rows at the first time their item went offline after the snapshot was made.

    A later restore does not revive a row. ``operations``: item_id, status, at_ms.
    """
    offline = operations.filter(F.col("status") == "offline").select("item_id", "at_ms")
    hits = snapshots.select("snapshot_id", "position", "item_id", "created_ms").join(offline, "item_id").filter(
        F.col("at_ms") >= F.col("created_ms")
    ).groupBy("snapshot_id", "position").agg(F.min("at_ms").alias("off_ms"))
    return snapshots.join(hits, ["snapshot_id", "position"], "left").withColumn(
        "invalidated_ms", F.coalesce("invalidated_ms", "off_ms")
    ).drop("off_ms")
