"""Behaviour events: validation, de-duplication, visits, user-item state and training feedback.

An event has event_id, event_type, request_id, user_id, item_id, position, dwell_ms, received_ms.
Server receive time orders and bounds everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.exprs import dwell_affinity, feedback_disposition, feedback_weight, finite
from ..functions.grouping import first_by, order_statistics, sum_before, top_n

EVENT_KEY = ("request_id", "user_id", "item_id", "position")
PAYLOAD = ("event_type", "request_id", "user_id", "item_id", "position", "dwell_ms")


def reject_reason() -> Column:
    """First rule a client event breaks; null when it is valid."""

    def bad_id(name: str) -> Column:
        size = F.length(F.col(name).cast("string"))
        return F.col(name).isNull() | (size < 1) | (size > V.ID_MAX_CHARS)

    dwell = F.col("dwell_ms")
    return (
        F.when(bad_id("event_id"), "event_id")
        .when(F.col("event_type").isNull() | ~F.col("event_type").isin(*V.CLIENT_EVENT_TYPES), "event_type")
        .when(bad_id("request_id"), "request_id")
        .when(bad_id("item_id"), "item_id")
        .when(F.col("position").isNull() | ~F.col("position").between(0, V.POSITION_MAX), "position")
        .when((F.col("event_type") == "dwell") & dwell.isNull(), "dwell_missing")
        .when((F.col("event_type") == "dwell") & ~dwell.between(V.DWELL_MIN_MS, V.DWELL_MAX_MS), "dwell_range")
        .when((F.col("event_type") != "dwell") & dwell.isNotNull(), "dwell_unexpected")
    )


def validate_events(events: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` and stores the old name favorite as like."""
    kind = F.when(F.col("event_type") == "favorite", "like").otherwise(F.col("event_type"))
    return events.withColumn("reject_reason", reject_reason()).withColumn("event_type", kind)


def referential_check(events: DataFrame, exposures: DataFrame) -> DataFrame:
    """Adds ``matched``: the event names a persisted exposure of that user."""
    known = exposures.select(*EVENT_KEY).distinct().withColumn("__known", F.lit(True))
    return events.join(known, list(EVENT_KEY), "left").withColumn("matched", F.col("__known").isNotNull()).drop("__known")


def deduplicate(events: DataFrame) -> DataFrame:
    """One event per (request, user, item, position, type): the first received; dwell keeps its maximum.

    All parts are combinable aggregates, so repeated deliveries collapse before the shuffle.
    """
    return events.groupBy(*EVENT_KEY, "event_type").agg(
        F.min(F.struct("received_ms", "event_id")).alias("first"),
        F.max("dwell_ms").alias("dwell_ms"),
        F.max("received_ms").alias("last_ms"),
        (F.count(F.lit(1)) - 1).alias("repeats"),
    ).select(
        F.col("first.event_id").alias("event_id"), "event_type", *EVENT_KEY, "dwell_ms",
        F.col("first.received_ms").alias("received_ms"), "last_ms", "repeats",
    )


def id_conflicts(events: DataFrame) -> DataFrame:
    """Event ids that were used with different payloads."""
    payload = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in PAYLOAD]), 256)
    ends = events.groupBy("event_id").agg(
        F.min(payload).alias("low"), F.max(payload).alias("high"), F.count(F.lit(1)).alias("deliveries")
    )
    return ends.filter(F.col("low") != F.col("high")).select("event_id", "deliveries")


def visits(events: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Impressions with ``visit_index`` = 1 + earlier requests that showed the item to the user.

    Events are de-duplicated, so a request shows an item once and each impression is one visit.
    ``carry`` names further columns of the impression to keep.
    """
    kept = ["user_id", "item_id", "request_id", "received_ms", "event_id", "position", *carry]
    seen = events.filter(F.col("event_type") == "impression").select(*kept)
    day = F.floor(F.col("received_ms") / V.DAY_MS)
    counted = sum_before(seen, ["user_id", "item_id"], day, ["received_ms", "event_id"], F.lit(1.0), "earlier")
    return counted.withColumn("visit_index", (F.col("earlier") + 1).cast("bigint")).drop("earlier")


def revisit_events(events: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """A derived event for every impression in a second or later request."""
    again = visits(events, carry).filter(F.col("visit_index") > 1)
    return again.select(
        F.concat_ws(":", F.lit("revisit"), "request_id", "item_id", "position").alias("event_id"),
        F.lit("revisit").alias("event_type"), *EVENT_KEY, F.lit(None).cast("bigint").alias("dwell_ms"),
        "received_ms", "visit_index", *carry,
    )


def state_aggregates() -> list[Column]:
    """Order-free counters per (user, item); batch and streaming use the same ones."""

    def count(kind: str) -> Column:
        return F.count_if(F.col("event_type") == kind)

    dwell = F.col("event_type") == "dwell"
    return [
        count("impression").alias("exposure_count"),
        count("click").alias("click_count"),
        count("like").alias("like_count"),
        count("share").alias("share_count"),
        F.sum(F.when(dwell, F.col("dwell_ms")).otherwise(0)).alias("dwell_ms_total"),
        F.count_if(dwell).alias("dwell_event_count"),
        F.sum(F.when(dwell, dwell_affinity(F.col("dwell_ms"))).otherwise(0.0)).alias("dwell_affinity"),
        F.max((F.col("event_type") == "not_interested").cast("int")).alias("not_interested"),
        F.max("last_ms").alias("last_event_ms"),
    ]


def finish_state(state: DataFrame) -> DataFrame:
    """Affinity in closed form: increments are non-negative and clamped at 8, and not_interested
    is sticky at -4, so the order of events does not matter. Each (request, item) shows at most
    one impression, hence revisits = impressions - 1."""
    revisits = F.greatest(F.lit(0), F.col("exposure_count") - 1)
    total = (
        F.col("click_count") * 1.0 + F.col("like_count") * 3.0 + F.col("share_count") * 4.0
        + revisits * 1.5 + F.col("dwell_affinity")
    )
    return (
        state.withColumn("revisit_count", revisits.cast("bigint"))
        .withColumn(
            "affinity",
            F.when(F.col("not_interested") == 1, V.STATE_NOT_INTERESTED).otherwise(F.least(F.lit(V.STATE_CEILING), total)),
        )
        .drop("dwell_affinity")
    )


def user_item_state(events: DataFrame) -> DataFrame:
    """Counters, dwell totals, sticky flag and affinity per (user, item). Derived revisit events
    in the input are ignored: they follow from the impressions."""
    once = deduplicate(events.filter(F.col("event_type") != "revisit"))
    return finish_state(once.groupBy("user_id", "item_id").agg(*state_aggregates()))


def profile_summary(state: DataFrame, n: int = 20) -> DataFrame:
    """Profile of every user: sums over the state, and the n best positive and negative items as lists of (item_id, weight)."""
    names = {
        "impressions": "exposure_count", "clicks": "click_count", "likes": "like_count", "dwell_ms": "dwell_ms_total",
        "dwell_events": "dwell_event_count", "shares": "share_count", "revisits": "revisit_count",
        "not_interested": "not_interested",
    }
    sums = state.groupBy("user_id").agg(
        *[F.sum(column).alias(name) for name, column in names.items()], F.max("last_event_ms").alias("updated_ms")
    )

    def items(side: str) -> Column:
        ranked = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "item_id", "weight"))))
        return F.transform(ranked, lambda x: F.struct(x["item_id"].alias("item_id"), x["weight"].alias("weight"))).alias(f"{side}_items")

    # a list has at most n items
    lists = profile_items(state, n).groupBy(F.col("user_id").alias("owner")).agg(items("positive"), items("negative"))
    none = F.array().cast(lists.schema["positive_items"].dataType)
    joined = sums.join(lists, sums["user_id"].eqNullSafe(lists["owner"]), "left").drop("owner")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("positive_items", "negative_items")})


def profile_items(state: DataFrame, n: int = 20) -> DataFrame:
    """Top n positive items (affinity desc, latest first) and top n negative items per user."""
    disliked = F.col("not_interested") == 1
    side = F.when((F.col("affinity") > 0) & ~disliked, "positive").when((F.col("affinity") < 0) | disliked, "negative")
    strength = F.when(F.col("side") == "positive", -F.col("affinity")).otherwise(F.col("affinity"))
    rows = state.withColumn("side", side).filter(F.col("side").isNotNull()).withColumn("strength", strength)
    best = top_n(
        rows, ["user_id", "side"], [F.col("strength"), F.col("last_event_ms").desc(), F.col("item_id")], n
    )
    return best.select("user_id", "side", "rank", "item_id", F.col("affinity").alias("weight"))


def seen_pairs(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(user, item) a feed must not show again."""
    seen = events.filter(F.col("event_type").isin("impression", "click", "like", "not_interested")).select(
        "user_id", "item_id"
    )
    if state is not None:
        seen = seen.unionByName(state.filter(F.col("not_interested") == 1).select("user_id", "item_id"))
    return seen.distinct()


def exclude_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    return candidates.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def online_only(candidates: DataFrame, items: DataFrame) -> DataFrame:
    return candidates.join(items.filter(F.col("status") == "online").select("item_id"), "item_id", "left_semi")


def classify_feedback(events: DataFrame) -> DataFrame:
    """Adds weight and disposition; both are null where the event is not feedback."""
    kind, dwell = F.col("event_type"), F.col("dwell_ms")
    return events.withColumn("weight", feedback_weight(kind, dwell)).withColumn(
        "disposition", feedback_disposition(kind, dwell)
    )


def screen_events(events: DataFrame, users: DataFrame, known_users: DataFrame, known_items: DataFrame) -> DataFrame:
    """First delivery of every event with ``skip_reason`` (null when usable) and its repeats.

    ``events`` carries raw text in item_id and received_at; ``users`` maps user_id to
    dataset_user_id.
    """
    once = events.groupBy("event_id").agg(
        F.min(F.struct("received_at", "event_type", "user_id", "item_id", "dwell_ms")).alias("e"),
        (F.count(F.lit(1)) - 1).alias("repeats"),
    ).select("event_id", "e.*", "repeats")
    rows = (
        classify_feedback(once)
        .withColumn("item", F.expr("try_cast(item_id AS bigint)"))
        .withColumn("received_ms", F.unix_millis(F.try_to_timestamp("received_at")))
        .join(users.select("user_id", "dataset_user_id"), "user_id", "left")
        .join(
            known_users.select(F.col("user_id").alias("dataset_user_id")).distinct().withColumn("ku", F.lit(1)),
            "dataset_user_id", "left",
        )
        .join(known_items.select(F.col("item_id").alias("item")).distinct().withColumn("ki", F.lit(1)), "item", "left")
    )
    reason = (
        F.when(F.col("weight").isNull(), "unsupported_event_type")
        .when(F.col("dataset_user_id").isNull(), "unmapped_user")
        .when(F.col("item").isNull(), "invalid_item_id")
        .when(F.col("ku").isNull(), "unknown_dataset_user")
        .when(F.col("ki").isNull(), "missing_item_metadata")
        .when(F.col("received_ms").isNull(), "invalid_received_at")
    )
    return rows.withColumn("skip_reason", reason).select(
        "event_id", "event_type", F.col("dataset_user_id").alias("user_id"), F.col("item").alias("item_id"),
        "dwell_ms", "received_ms", "weight", "disposition", "skip_reason", "repeats",
    )


def skip_counts(screened: DataFrame) -> DataFrame:
    """Rows per skip reason, repeated deliveries included."""
    first = screened.filter(F.col("skip_reason").isNotNull()).groupBy(F.col("skip_reason").alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )
    repeated = screened.agg(F.lit("duplicate_event_id").alias("reason"), F.sum("repeats").alias("n")).filter(F.col("n") > 0)
    return first.unionByName(repeated)


def capped_feedback(events: DataFrame, cap: float = V.FEEDBACK_CAP) -> DataFrame:
    """Positive weights per (user, item) consume a budget in (time, event id) order; any negative
    event on the pair cancels all its positives.

    ``events`` comes from ``classify_feedback``. The running sum works day by day, so a pair with
    very many events is never ordered in one task.
    """
    positive = F.col("disposition") == "positive"
    day = F.floor(F.col("received_ms") / V.DAY_MS)
    spent = sum_before(
        events, ["user_id", "item_id"], day, ["received_ms", "event_id"],
        F.when(positive, F.col("weight")).otherwise(0.0), "spent",
    )
    conflict = events.filter(F.col("disposition") == "negative").select("user_id", "item_id").distinct()
    rows = spent.join(conflict.withColumn("__conflict", F.lit(True)), ["user_id", "item_id"], "left")
    applied = F.least(F.lit(cap), F.col("spent") + F.col("weight")) - F.least(F.lit(cap), F.col("spent"))
    conflicted = positive & F.col("__conflict").isNotNull()
    return (
        rows.withColumn(
            "applied", F.when(conflicted, 0.0).when(positive, applied).otherwise(F.col("weight"))
        )
        .withColumn(
            "disposition",
            F.when(conflicted, "ignored_negative_conflict")
            .when(positive & (F.col("applied") <= 0), "ignored_positive_cap")
            .otherwise(F.col("disposition")),
        )
        .withColumn("weight", F.col("applied"))
        .drop("applied", "spent", "__conflict")
    )


def budget_events(events: DataFrame) -> DataFrame:
    """The classified events that spend a budget or cancel a pair; context events do neither."""
    names = ["event_id", "user_id", "item_id", "received_ms", "weight", "disposition"]
    return events.filter(F.col("disposition").isin("positive", "negative")).select(*names)


def positive_feedback(events: DataFrame) -> DataFrame:
    """user_id, item_id, received_ms, disposition of the ``budget_events`` that stay positive under cap and conflicts."""
    names = ["user_id", "item_id", "received_ms", "disposition"]
    return capped_feedback(events).filter(F.col("disposition") == "positive").select(*names)


def feedback_cutoffs(feedback: DataFrame) -> DataFrame:
    """Split borders on the distinct times of positive feedback, clamped so that no split is empty."""
    times = feedback.filter(F.col("disposition") == "positive").select("received_ms").distinct()
    # indexes min(ceil(.8n)-1, n-3) and min(max(first+1, ceil(.9n)-1), n-2) counted from 0
    points = order_statistics(
        times, "received_ms", [("a", 0.8, "ceil"), ("b", 0.9, "ceil")]
    ).select("n", "low", "high", "a", "b")
    ends = times.orderBy(F.col("received_ms").desc()).limit(3).agg(
        F.array_sort(F.collect_list("received_ms")).alias("tail")
    )
    tail = ends.scalar()
    enough = F.col("n") >= 3
    first = F.least(F.col("a").cast("bigint"), tail[0])
    # the next distinct time after the train border
    rows = points.select("n", F.when(enough, first).otherwise(
        F.raise_error(F.lit("feedback needs three distinct times")).cast("bigint")
    ).alias("train_cutoff"), F.col("b").cast("bigint").alias("b"), tail[1].alias("last_but_one"))
    following = times.filter(F.col("received_ms") > rows.select("train_cutoff").scalar()).agg(
        F.min("received_ms").alias("next")
    )
    return rows.select(
        "n", "train_cutoff",
        F.least(F.greatest(following.scalar(), F.col("b")), F.col("last_but_one")).alias("validation_cutoff"),
    )


def feedback_split(feedback: DataFrame) -> DataFrame:
    """Positive feedback with its chronological split."""
    row = feedback_cutoffs(feedback).select(F.struct("*").alias("r")).scalar()
    return feedback.filter(F.col("disposition") == "positive").withColumn(
        "split",
        F.when(F.col("received_ms") <= row["train_cutoff"], "train")
        .when(F.col("received_ms") <= row["validation_cutoff"], "validation")
        .otherwise("test"),
    )


def retrain_dataset(base: DataFrame, feedback: DataFrame) -> DataFrame:
    """Rows of the next training run: every base row trains; positive feedback is split by time.

    Fails when the feedback window does not start after the base log.
    """
    last = base.agg(F.max("ts_ms")).scalar()
    late = F.when(F.col("received_ms") > last, F.col("received_ms")).otherwise(
        F.raise_error(F.lit("feedback must start after the base log")).cast("bigint")
    )
    online = feedback_split(feedback.withColumn("received_ms", late)).select(
        "split", "user_id", "item_id", F.col("received_ms").alias("ts_ms")
    )
    return base.select(F.lit("train").alias("split"), "user_id", "item_id", "ts_ms").unionByName(online)


def training_feedback(feedback: DataFrame) -> DataFrame:
    """All feedback known at the training border; it is kept apart from the interaction rows."""
    border = feedback_cutoffs(feedback).select("train_cutoff").scalar()
    return feedback.filter(F.col("received_ms") <= border)


def check_feedback(feedback: DataFrame) -> DataFrame:
    """Counts what a feedback file must not contain: repeated ids and non-finite weights."""
    ids = feedback.groupBy("event_id").agg(F.count(F.lit(1)).alias("c"), F.count_if(~finite(F.col("weight"))).alias("bad"))
    return ids.agg(
        F.sum("c").alias("rows"), F.sum(F.col("c") - 1).alias("repeated_ids"), F.sum("bad").alias("bad_weights")
    )


def export_events(events: DataFrame, users: DataFrame) -> DataFrame:
    """Clicks and likes of mapped users, one row per event; non-numeric item ids are left out."""
    weight = F.when(F.col("event_type") == "click", 1).otherwise(3)
    mapped = users.filter(F.col("dataset_user_id").isNotNull()).select("user_id", "dataset_user_id")
    return (
        events.filter(F.col("event_type").isin("click", "like"))
        .join(mapped, "user_id")
        .select(
            F.col("dataset_user_id").alias("user"),
            F.expr("try_cast(cast(item_id AS string) AS bigint)").alias("item"),
            F.col("received_ms").alias("timestamp"),
            "event_type", weight.cast("bigint").alias("weight"), "event_id",
        )
        .filter(F.col("item").isNotNull())
    )


def latest_request(requests: DataFrame) -> DataFrame:
    """Newest request per user."""
    return requests.groupBy("user_id").agg(F.max(F.struct("created_ms", "request_id", "feed_type")).alias("r")).select(
        "user_id", F.col("r.request_id").alias("request_id"), F.col("r.created_ms").alias("created_ms"),
        F.col("r.feed_type").alias("feed_type"),
    )


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First occurrence per key in the given order (never an arbitrary one)."""
    return first_by(df, keys, order, [c for c in df.columns if c not in keys])


