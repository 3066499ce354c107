"""Operations tables: item status batches, boosts, alerts, models, audit of stored assets.

Plain files have no in-place update, so every change is a new row of a log or a rewritten table
computed by joins; current state is the latest row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.exprs import ratio
from ..functions.grouping import latest_by, order_statistics
from .dashboard import active_users, between

# ---------------------------------------------------------------- item status


def check_batches(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Outcome per batch: applied, missing_items, replay or conflict.

    ``requests``: batch_id, admin_id, key, item_id, status, at_ms (one row per item). A batch applies
    only when every item exists. Later batches with the same (admin, key) replay the first when
    their payload is equal and conflict otherwise.
    """
    known = items.select("item_id").distinct().withColumn("__known", F.lit(1))
    member = F.xxhash64("item_id", "status")
    batches = requests.join(known, "item_id", "left").groupBy("batch_id", "admin_id", "key").agg(
        F.min("at_ms").alias("at_ms"),
        F.count(F.lit(1)).alias("items"),
        (F.count(F.lit(1)) - F.count("__known")).alias("missing"),
        F.bit_xor(member).alias("x"),
        F.sum(F.pmod(member, F.lit(1 << 31))).alias("s"),
    )
    payload = F.struct("items", "x", "s")
    accepted = F.when(F.col("missing") == 0, F.struct("at_ms", "batch_id", payload.alias("p")))
    firsts = batches.groupBy("admin_id", "key").agg(F.min(accepted).alias("first"))
    outcome = (
        F.when(F.col("first").isNull() | (F.col("first.at_ms") > F.col("at_ms")), "missing_items")
        .when(F.col("first.batch_id") == F.col("batch_id"), "applied")
        .when(F.col("first.p") == payload, "replay")
        .otherwise("conflict")
    )
    return batches.join(firsts, ["admin_id", "key"]).select(
        "batch_id", "admin_id", "key", "at_ms", "items", "missing", outcome.alias("outcome")
    )


def apply_status_batches(items: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with new status and version, audit log). The version grows only with a real change."""
    applied = check_batches(requests, items).filter(F.col("outcome") == "applied").select("batch_id")
    steps = requests.join(applied, "batch_id").join(
        items.select("item_id", F.col("status").alias("initial"), "status_version"), "item_id"
    )
    order = Window.partitionBy("item_id").orderBy("at_ms", "batch_id")
    before = F.coalesce(F.lag("status").over(order), F.col("initial"))
    changed = (F.col("before") != F.col("status")).cast("int")
    action = (
        F.when(F.col("changed") == 0, "item_status_noop")
        .when(F.col("status") == "offline", "item_offline").otherwise("item_restore")
    )
    audit = (
        steps.withColumn("before", before)
        .withColumn("changed", changed)
        .withColumn("version", F.col("status_version") + F.sum("changed").over(order))
        .select("batch_id", "admin_id", "item_id", "at_ms", action.alias("action"), "before", F.col("status").alias("after"), "version")
    )
    last = latest_by(audit, ["item_id"], ["at_ms", "batch_id"], ["after", "version"])
    updated = items.join(last.select("item_id", "after", "version"), "item_id", "left").select(
        "item_id", F.coalesce("after", "status").alias("status"), F.coalesce("version", "status_version").alias("status_version")
    )
    return updated, audit


def item_status_as_of(operations: DataFrame, at_ms: int | None = None) -> DataFrame:
    """Status per item from the audit log (item_id, status, operation_id, at_ms)."""
    rows = operations if at_ms is None else operations.filter(F.col("at_ms") <= at_ms)
    return rows.groupBy("item_id").agg(
        F.max_by("status", F.struct("at_ms", "operation_id")).alias("status"), F.count(F.lit(1)).alias("operations")
    )


def operations_log(operations: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """Newest n operations with the name of their user."""
    newest = operations.orderBy(F.col("at_ms").desc(), F.col("operation_id").desc()).limit(n)
    return newest.join(users.select("user_id", "username"), "user_id", "left")


# ---------------------------------------------------------------- boosts


def check_boosts(campaigns: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` to boost campaigns: unknown item or user, time order, audience rules, ranges."""
    known = items.select("item_id").distinct().withColumn("__item", F.lit(1))
    listed = campaigns.select("campaign_id", F.explode(F.array_distinct("user_ids")).alias("user_id"))
    strangers = listed.join(users.select("user_id").distinct(), "user_id", "left_anti").select("campaign_id").distinct()
    joined = campaigns.join(known, "item_id", "left").join(
        strangers.withColumn("__stranger", F.lit(1)), "campaign_id", "left"
    )
    size = F.size("user_ids")
    reason = (
        F.when(F.col("__item").isNull(), "unknown_item")
        .when((F.col("audience") == "users") & (size == 0), "user_ids_required")
        .when((F.col("audience") == "all") & (size > 0), "user_ids_not_allowed")
        .when(F.col("__stranger").isNotNull(), "unknown_user")
        .when(F.col("ends_ms") <= F.col("starts_ms"), "time_order")
        .when(~F.col("position").between(0, 49), "position")
        .when(~F.col("priority").between(-1000, 1000), "priority")
    )
    return joined.withColumn("reject_reason", reason).drop("__item", "__stranger")


def boost_log(campaigns: DataFrame, switches: DataFrame, at_ms: int) -> DataFrame:
    """Current campaigns: the created state with the last activation or deactivation before ``at_ms``.

    ``switches``: campaign_id, active, at_ms, operation_id.
    """
    last = switches.filter(F.col("at_ms") <= at_ms).groupBy("campaign_id").agg(
        F.max_by("active", F.struct("at_ms", "operation_id")).alias("__active"), F.count(F.lit(1)).alias("changes")
    )
    return campaigns.join(last, "campaign_id", "left").withColumn("active", F.coalesce("__active", "active")).drop(
        "__active"
    ).na.fill(0, ["changes"])


# ---------------------------------------------------------------- alerts


def alert_metrics(requests: DataFrame, exposures: DataFrame, events: DataFrame, items: DataFrame, now: int, minutes: int = 60) -> DataFrame:
    """The nine alert metrics over the trailing window, one row per metric."""
    start = now - max(1, minutes) * V.MINUTE_MS
    asked, served = between(requests, "created_ms", start, now), between(exposures, "created_ms", start, now)
    kinds = between(events, "received_ms", start, now).agg(
        *[F.count_if(F.col("event_type") == k).alias(n) for k, n in
          (("impression", "impressions"), ("click", "clicks"), ("like", "likes"))]
    )
    count = F.count(F.lit(1))
    row = (
        kinds.withColumn("requests", asked.agg(count).scalar())
        .withColumn("exposures", served.agg(count).scalar())
        .withColumn("active_users", active_users(requests, events, start, now).scalar())
        .withColumn("latency_p95", F.coalesce(
            order_statistics(asked, "latency_ms", [("p95", 0.95, "linear")]).select("p95").scalar(), F.lit(0.0)))
        .withColumn("offline_items", items.filter(F.col("status") == "offline").agg(count).scalar())
        .withColumn("ctr", ratio(F.col("clicks"), F.col("exposures")))
    )
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in V.ALERT_METRICS])
    return row.select(F.explode(cells).alias("c")).select("c.metric", "c.value")


def breach(value: Column, operator: Column, threshold: Column) -> Column:
    return (
        F.when(operator == ">", value > threshold).when(operator == ">=", value >= threshold)
        .when(operator == "<", value < threshold).when(operator == "<=", value <= threshold).otherwise(False)
    )


def evaluate_alerts(rules: DataFrame, metrics: DataFrame, events: DataFrame, now: int) -> DataFrame:
    """New event table after one evaluation, with the transition of every touched row.

    Rules: rule_id, metric, operator, threshold, severity, enabled. Events: event_id, rule_id, status,
    observed, triggered_ms, resolved_ms, evaluated_ms. A breach without an open event opens one, with
    one refreshes the newest; a recovered rule resolves its newest open event. Other rows stay.
    """
    live = rules.filter("enabled").join(metrics, "metric").withColumn(
        "firing", breach(F.col("value"), F.col("operator"), F.col("threshold"))
    )
    newest = events.filter(F.col("status") == "open").groupBy("rule_id").agg(
        F.max(F.struct("triggered_ms", "event_id")).alias("n")
    ).select("rule_id", F.col("n.event_id").alias("open_id"))
    state = live.join(newest, "rule_id", "left").select("rule_id", "value", "firing", "open_id")
    touched = events.join(
        state.filter(F.col("open_id").isNotNull()).select(F.col("open_id").alias("event_id"), "value", "firing"), "event_id", "left"
    )
    hit = F.col("firing").isNotNull()
    updated = touched.select(
        "event_id", "rule_id",
        F.when(hit & ~F.col("firing"), "resolved").otherwise(F.col("status")).alias("status"),
        F.when(hit, F.col("value")).otherwise(F.col("observed")).alias("observed"),
        "triggered_ms",
        F.when(hit & ~F.col("firing"), F.lit(now)).otherwise(F.col("resolved_ms")).alias("resolved_ms"),
        F.when(hit, F.lit(now)).otherwise(F.col("evaluated_ms")).alias("evaluated_ms"),
        F.when(hit & F.col("firing"), "refreshed").when(hit, "resolved").otherwise("unchanged").alias("transition"),
    )
    fresh = state.filter(F.col("firing") & F.col("open_id").isNull()).select(
        F.concat_ws(":", F.lit("alert"), "rule_id", F.lit(str(now))).alias("event_id"), "rule_id", F.lit("open").alias("status"),
        F.col("value").alias("observed"), F.lit(now).alias("triggered_ms"), F.lit(None).cast("bigint").alias("resolved_ms"),
        F.lit(now).alias("evaluated_ms"), F.lit("triggered").alias("transition"),
    )
    return updated.unionByName(fresh)


def acknowledge_alerts(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome per acknowledgement (event_id, user_id, at_ms): only open events can be acknowledged."""
    state = events.select("event_id", "status")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("status") == "open", "acknowledged").otherwise("not_open")
    return requests.join(state, "event_id", "left").withColumn("outcome", outcome)


def maintain_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rule table after a change log (rule_id, op, name, metric, operator, threshold, severity, enabled, at_ms).

    A rule exists by the table or by a ``create`` with a name, a known metric and a known operator; its severity is
    warn and it is enabled unless told otherwise. An ``update`` sets some columns of an existing rule; it is refused
    if it names a metric, which is fixed, or an unknown operator or severity, or sets nothing, and not found without a
    rule. A ``delete`` removes the rule. Columns take their last non-null value.
    """
    op, known = F.col("op"), F.col("operator").isin(*V.ALERT_OPERATORS)
    names = ["name", "metric", "operator", "threshold", "severity", "enabled"]
    graded = F.col("severity").isNull() | F.col("severity").isin(*V.ALERT_SEVERITIES)
    said = F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in names], F.lit(False))
    valid = (op == "delete") | graded & F.when(op == "create", F.col("metric").isin(*V.ALERT_METRICS) & known & F.col("name").isNotNull()).otherwise(
        F.col("metric").isNull() & (F.col("operator").isNull() | known) & said
    )
    start = rules.select("rule_id", F.lit("create").alias("op"), *names, F.lit(-1).cast("bigint").alias("at_ms"))
    log = start.unionByName(changes.filter(valid).select("rule_id", "op", *names, "at_ms"))
    folded = log.groupBy("rule_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at_ms"))).alias(c) for c in names],
        F.max(F.when(F.col("op") == "delete", F.col("at_ms"))).alias("deleted"),
        F.max(F.col("op") == "create").alias("created"),
    )
    kept = folded.filter(F.col("deleted").isNull() & F.col("created")).drop("deleted", "created")
    return kept.withColumn("severity", F.coalesce("severity", F.lit("warn"))).withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def cascade_delete(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Alert events whose rule still exists."""
    return events.join(rules.select("rule_id"), "rule_id", "left_semi")


# ---------------------------------------------------------------- models

PROTOCOL_FIELDS = (
    "candidate_universe", "cohort_aggregation", "k", "negative_sampling", "negatives_per_query", "positive_labels",
    "popularity_scope", "popularity_feature_rule", "shared_queries_across_models", "untimed_likes_views_used",
)


def register_models(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registry after upserts: known window and counts survive missing values, the newest is active.

    Columns: version, window_start, window_end, sample_count, event_count, created_ms.
    """
    facts = ["window_start", "window_end", "sample_count", "event_count"]
    both = registry.select("version", *facts, "created_ms").unionByName(incoming.select("version", *facts, "created_ms"))
    merged = both.groupBy("version").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("created_ms"))).alias(c) for c in facts],
        F.max("created_ms").alias("created_ms"),
    )
    newest = merged.agg(F.max(F.struct("created_ms", "version")).alias("n")).select("n.version").scalar()
    return merged.withColumn("status", F.when(F.col("version") == newest, "active").otherwise("inactive"))


def compare_models(models: DataFrame, versions: list[str]) -> DataFrame:
    """Metric rows per version with deltas from the first version.

    Deltas exist only when all versions share the ten protocol fields and the protocol is not empty.
    ``models``: version, protocol_json, metrics_json.
    """
    unique = list(dict.fromkeys(versions))
    if not 2 <= len(unique) <= 10:
        raise ValueError("select between 2 and 10 versions")
    chosen = models.filter(F.col("version").isin(*unique))
    missing = set(unique) - {r["version"] for r in chosen.select("version").distinct().collect()}  # ten at most
    if missing:
        raise ValueError(f"no model has version {', '.join(sorted(missing))}")
    key = F.to_json(F.struct(*[F.coalesce(F.get_json_object("protocol_json", f"$.{f}"), F.lit("")).alias(f) for f in PROTOCOL_FIELDS]))
    keyed = chosen.withColumn("key", key)
    empty = F.count_if((F.col("version") == unique[0]) & (F.col("protocol_json") == "{}"))
    verdict = keyed.agg(((F.count_distinct("key") == 1) & (empty == 0)).alias("compatible")).scalar()
    rows = keyed.select("version", F.explode(F.from_json("metrics_json", "map<string,double>")).alias("metric", "value"))
    base = rows.filter(F.col("version") == unique[0]).select("metric", F.col("value").alias("base"))
    return rows.join(base, "metric", "left").withColumn("compatible", verdict).select(
        "version", "metric", "value", F.when(F.col("compatible"), F.col("value") - F.col("base")).alias("delta"), "compatible"
    )


def run_history(runs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(newest n runs, counts per status)."""
    newest = runs.orderBy(F.col("created_ms").desc(), F.col("run_id")).limit(n)
    return newest, runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("created_ms").alias("last_ms"))


# ---------------------------------------------------------------- stored assets


def audit_assets(assets: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per asset or missing id: digest, size of its duplicate group, state.

    ``assets``: asset_id, content; ``catalog``: item_id. Duplicate groups are counted by digest, so a
    very common content never gathers in one task as rows.
    """
    hashed = assets.select("asset_id", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    groups = hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    known = catalog.select(F.col("item_id").alias("asset_id")).distinct().withColumn("__known", F.lit(1))
    state = F.when(F.col("digest").isNull(), "missing").when(F.col("__known").isNull(), "unexpected").otherwise("matched")
    return (
        hashed.join(known, "asset_id", "full_outer").withColumn("state", state).join(groups, "digest", "left")
        .select("asset_id", "digest", "copies", "state")
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    """Counts and rates of an asset audit."""
    known = F.count_if(F.col("state") != "unexpected")
    repeated = F.sum(F.when(F.col("copies") > 1, 1.0 / F.col("copies")))
    return audit.agg(
        F.count("digest").alias("assets"), F.count_if(F.col("state") == "matched").alias("matched"),
        F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "unexpected").alias("unexpected"),
        F.coalesce(F.round(repeated, 0), F.lit(0.0)).cast("bigint").alias("duplicate_groups"),
        ratio(F.count_if(F.col("state") == "matched"), known).alias("coverage"),
    )


def top_duplicates(audit: DataFrame, n: int) -> DataFrame:
    """The n largest groups of equal content with their first asset."""
    groups = audit.filter(F.col("copies") > 1).groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min("asset_id").alias("first_asset")
    )
    return groups.orderBy(F.col("copies").desc(), "digest").limit(n)
