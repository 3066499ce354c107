"""Dashboard aggregates over requests, exposures and behaviour events.

Windows are half-open ``[start, end)`` in epoch milliseconds. Each fact table is scanned once per
report; event ids are unique after de-duplication, so conditional counts need no distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values as V
from ..functions.exprs import ratio, score_key
from ..functions.grouping import order_statistics, top_n
from .behaviour import EVENT_KEY

PERCENTILES = [("p50", 0.5, "linear"), ("p95", 0.95, "linear"), ("p99", 0.99, "linear")]


def between(df: DataFrame, ts: str, start: int, end: int) -> DataFrame:
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end))


def percentiles(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """min / p50 / p95 / p99 / max with linear interpolation."""
    return order_statistics(df, column, PERCENTILES, keys).select(
        *keys, "n", F.col("low").alias("min"), "p50", "p95", "p99", F.col("high").alias("max")
    )


def zero_percentiles(df: DataFrame, column: str) -> DataFrame:
    """Percentiles of one column; an empty input gives a row of zeros."""
    names = ["min", "p50", "p95", "p99", "max"]
    # a global aggregate always yields one row
    return percentiles(df, column).agg(
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("n"),
        *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in names],
    )


def active_users(requests: DataFrame, events: DataFrame, start: int, end: int) -> DataFrame:
    """Distinct users with a request, or with any event other than an impression."""
    asked = between(requests, "created_ms", start, end).select("user_id")
    acted = between(events, "received_ms", start, end).filter(F.col("event_type") != "impression").select("user_id")
    return asked.union(acted).distinct().agg(F.count(F.lit(1)).alias("active_users"))


def viewable_clicks(events: DataFrame, start: int, end: int) -> DataFrame:
    """Clicks whose exposure was seen inside the window."""
    rows = between(events, "received_ms", start, end)
    seen = rows.filter(F.col("event_type") == "impression").select(*EVENT_KEY)
    return rows.filter(F.col("event_type") == "click").join(seen, list(EVENT_KEY), "left_semi")


COUNTS = ("impressions", "clicks", "viewable_clicks", "likes", "not_interested", "shares", "revisits", "dwell_ms", "dwells", "acted")


def outcome_counts(events: DataFrame, start: int, end: int, semantics_start: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts per exposure (request, user, item, position) inside the window.

    A click is viewable when its exposure was seen in the window: both sit in the same group, so
    no self join of the events is needed.
    """
    first = max(start, semantics_start)
    late = F.col("received_ms") >= first

    def count(kind: str, extra: Column | None = None) -> Column:
        test = F.col("event_type") == kind
        return F.count_if(test if extra is None else test & extra)

    grouped = between(events, "received_ms", start, end).groupBy(*EVENT_KEY, *carry).agg(
        count("impression", late).alias("impressions"),
        count("click").alias("clicks"),
        count("click", late).alias("late_clicks"),
        count("like").alias("likes"),
        count("not_interested").alias("not_interested"),
        count("share").alias("shares"),
        count("revisit").alias("revisits"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "dwell", F.col("dwell_ms"))), F.lit(0)).alias("dwell_ms"),
        count("dwell").alias("dwells"),
        F.count_if(F.col("event_type") != "impression").alias("acted"),
    )
    return grouped.withColumn(
        "viewable_clicks", F.when(F.col("impressions") > 0, F.col("late_clicks")).otherwise(0)
    ).drop("late_clicks")


def _summed(names) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]


def overview(
    requests: DataFrame, exposures: DataFrame, events: DataFrame, start: int, end: int, semantics_start: int
) -> DataFrame:
    """One row of counts and rates. Every fact table is read once."""
    by_user = outcome_counts(events, start, end, semantics_start).groupBy("user_id").agg(*_summed(COUNTS))
    asked = between(requests, "created_ms", start, end).groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"))
    served = between(exposures, "created_ms", start, end).agg(F.count(F.lit(1))).scalar()
    joined = by_user.join(asked, "user_id", "full_outer").na.fill(0)
    row = joined.agg(
        *_summed(("requests", *COUNTS)),
        F.count_if(F.col("revisits") > 0).alias("revisit_users"),
        F.count_if((F.col("requests") > 0) | (F.col("acted") > 0)).alias("active_users"),
    ).withColumn("exposures", served)
    return row.select(
        "requests", "exposures", "active_users", "impressions", "clicks", "likes", "shares", "revisits", "revisit_users",
        "viewable_clicks",
        ratio(F.col("clicks"), F.col("exposures")).alias("served_ctr"),
        ratio(F.col("viewable_clicks"), F.col("impressions")).alias("viewable_ctr"),
        ratio(F.col("dwell_ms"), F.col("dwells")).alias("average_dwell_ms"),
    )


def feed_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in V.FEEDS], "feed_type string")


def feed_breakdown(
    requests: DataFrame, exposures: DataFrame, events: DataFrame, start: int, end: int, semantics_start: int
) -> DataFrame:
    """Per feed: counts, served and viewable CTR and the share of all exposures; absent feeds show zeros.

    ``exposures`` and ``events`` carry the feed of their request. Events count only when they
    belong to a persisted exposure.
    """
    zero = [F.lit(0).cast("bigint").alias(c) for c in
            ("impressions", "clicks", "viewable_clicks", "likes", "not_interested")]
    asked = between(requests, "created_ms", start, end).groupBy("feed_type").agg(F.count(F.lit(1)).alias("requests"))
    served = between(exposures, "created_ms", start, end).groupBy("feed_type").agg(F.count(F.lit(1)).alias("exposures"))
    place = ["request_id", "item_id", "position"]
    acted = (
        outcome_counts(events, start, end, semantics_start, ("feed_type",))
        .join(exposures.select(*place), place, "left_semi")
        .groupBy("feed_type")
        .agg(*_summed(("impressions", "clicks", "viewable_clicks", "likes", "not_interested")))
    )
    nil = F.lit(0).cast("bigint")
    stacked = (
        asked.select("feed_type", "requests", nil.alias("exposures"), *zero)
        .unionByName(served.select("feed_type", nil.alias("requests"), "exposures", *zero))
        .unionByName(acted.withColumn("requests", nil).withColumn("exposures", nil))
    )
    names = ["requests", "exposures", "impressions", "clicks", "viewable_clicks", "likes", "not_interested"]
    summed = stacked.groupBy("feed_type").agg(*[F.sum(c).alias(c) for c in names])
    total = between(exposures, "created_ms", start, end).agg(F.count(F.lit(1))).scalar()
    filled = summed.join(F.broadcast(feed_dimension(requests.sparkSession)), "feed_type", "right").na.fill(0, names)
    return filled.select(
        "feed_type", *names,
        ratio(F.col("clicks"), F.col("exposures")).alias("served_ctr"),
        ratio(F.col("viewable_clicks"), F.col("impressions")).alias("viewable_ctr"),
        ratio(F.col("exposures"), total).alias("share"),
    )


def _count(kind: str) -> Column:
    return F.count_if(F.col("event_type") == kind)


def engagement_by_feed(events: DataFrame, start: int, end: int) -> DataFrame:
    """Shares, revisits, revisiting users and mean dwell per feed."""
    rows = between(events, "received_ms", start, end)
    by_user = rows.groupBy("feed_type", "user_id").agg(
        _count("share").alias("shares"), _count("revisit").alias("revisits"),
        F.sum(F.when(F.col("event_type") == "dwell", F.col("dwell_ms"))).alias("dwell"), _count("dwell").alias("dwells"),
    )
    summed = by_user.groupBy("feed_type").agg(
        F.sum("shares").alias("shares"), F.sum("revisits").alias("revisits"),
        F.count_if(F.col("revisits") > 0).alias("revisit_users"),
        F.coalesce(F.sum("dwell"), F.lit(0)).alias("dwell"), F.sum("dwells").alias("dwells"),
    )
    names = ["shares", "revisits", "revisit_users", "dwell", "dwells"]
    filled = summed.join(F.broadcast(feed_dimension(events.sparkSession)), "feed_type", "right").na.fill(0, names)
    return filled.select(
        "feed_type", "shares", "revisits", "revisit_users",
        ratio(F.col("dwell"), F.col("dwells")).alias("average_dwell_ms"),
    )


def top_items(
    items: DataFrame, exposures: DataFrame, events: DataFrame, start: int, end: int, semantics_start: int, n: int = 10
) -> DataFrame:
    """Most exposed items with their conditional counts. Both facts are reduced to items before joining."""
    served = between(exposures, "created_ms", start, end)
    counts = served.groupBy("item_id").agg(F.count(F.lit(1)).alias("exposures"))
    place = ["request_id", "item_id", "position"]
    acted = (
        outcome_counts(events, start, end, semantics_start)
        .join(served.select(*place), place, "left_semi")
        .groupBy("item_id")
        .agg(*_summed(("impressions", "clicks", "viewable_clicks", "likes")))
    )
    names = ["impressions", "clicks", "viewable_clicks", "likes"]
    ranked = (
        counts.join(acted, "item_id", "left").na.fill(0, names)
        .join(items.select("item_id", "title"), "item_id")
        .orderBy(F.col("exposures").desc(), F.col("clicks").desc(), "item_id")
        .limit(n)
    )
    return ranked.select(
        "item_id", "title", "exposures", *names,
        ratio(F.col("clicks"), F.col("exposures")).alias("served_ctr"),
        ratio(F.col("viewable_clicks"), F.col("impressions")).alias("viewable_ctr"),
    )


def source_share(exposures: DataFrame, start: int, end: int) -> DataFrame:
    """Exposures, requests and share of the total per candidate source."""
    rows = between(exposures, "created_ms", start, end)
    per_request = rows.groupBy("source", "request_id").agg(F.count(F.lit(1)).alias("c"))
    summed = per_request.groupBy("source").agg(
        F.sum("c").alias("exposures"), F.count(F.lit(1)).alias("requests")
    )
    total = rows.agg(F.count(F.lit(1))).scalar()
    return summed.withColumn("share", ratio(F.col("exposures"), total))


def time_series(df: DataFrame, ts: str, start: int, end: int, semantics_start: int | None = None) -> DataFrame:
    """Counts per hour up to a span of 48 hours, per day beyond it; UTC aligned, empty buckets are zero.

    The spine holds one row per bucket of the requested range; the last bucket ends just before ``end``.
    """
    width = V.HOUR_MS if end - start <= 48 * V.HOUR_MS else V.DAY_MS
    since = start if semantics_start is None else max(start, semantics_start)
    slot = (F.floor(F.col(ts) / width) * width).cast("bigint")
    counted = between(df, ts, since, end).groupBy(slot.alias("bucket_ms")).agg(F.count(F.lit(1)).alias("value"))
    spine = df.sparkSession.range(start // width, (end - 1) // width + 1).select(
        (F.col("id") * width).alias("bucket_ms")
    )
    return spine.join(counted, "bucket_ms", "left").select(
        "bucket_ms", F.coalesce("value", F.lit(0)).cast("bigint").alias("value")
    )


def dashboard_records(
    overview_row: DataFrame, feeds: DataFrame, sources: DataFrame, tops: DataFrame
) -> DataFrame:
    """The four reports stacked in one relation for a flat export."""
    parts = [
        overview_row.withColumn("section", F.lit("overview")).withColumn("key", F.lit("all")),
        feeds.withColumn("section", F.lit("feed")).withColumnRenamed("feed_type", "key"),
        sources.withColumn("section", F.lit("source")).withColumnRenamed("source", "key"),
        tops.withColumn("section", F.lit("top_item")).withColumn("key", F.col("item_id").cast("string")).drop("item_id"),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked


def request_trace(requests: DataFrame, exposures: DataFrame, events: DataFrame) -> DataFrame:
    """Per request: its ordered exposures and ordered events as text lists. A page is at most 10,000 rows."""
    shown = exposures.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "item_id", "source"))).alias("shown")
    )
    acted = events.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("received_ms", "event_id"))).alias("acted")
    )
    return requests.join(shown, "request_id", "left").join(acted, "request_id", "left").select(
        "request_id", "user_id", "feed_type", "created_ms",
        F.coalesce("shown", F.expr("array()").cast("array<struct<position:int,item_id:bigint,source:string>>")).alias("shown"),
        F.coalesce("acted", F.expr("array()").cast("array<struct<received_ms:bigint,event_id:string>>")).alias("acted"),
    )


def recent_events(events: DataFrame, exposures: DataFrame, n: int = 20) -> DataFrame:
    """Last n events per user with the feed and the source that showed the item."""
    last = top_n(events, ["user_id"], [F.col("received_ms").desc(), F.col("event_id")], n)
    return last.join(
        exposures.select("request_id", "item_id", "position", "source"), ["request_id", "item_id", "position"], "left"
    )


def search_items(items: DataFrame, text: str, status: str | None, limit: int, offset: int) -> DataFrame:
    """Page of items whose id or title contains the text, most popular first, with the total.

    Case is ignored; ties go to the text form of the id.
    """
    needle = text.lower()
    match = F.col("item_id").cast("string").contains(needle) | F.lower("title").contains(needle)
    found = items.filter(match)
    if status:
        found = found.filter(F.col("status") == status)
    total = found.agg(F.count(F.lit(1))).scalar()
    page = found.orderBy(score_key("popularity_score").desc(), F.col("item_id").cast("string")).offset(offset).limit(limit)
    return page.select("item_id", "title", "status", total.alias("total"))
