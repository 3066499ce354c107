"""Behaviour events and the training feedback made from them."""

from pyspark.sql import functions as F

from ..functions.exprs import as_of
from ..operators import behaviour as B
from ..session import materialise
from .data import train_cut
from .registry import query

R = 6
LABEL = """CASE event_type WHEN 'view' THEN 'impression' WHEN 'purchase' THEN 'dwell' WHEN 'error' THEN 'favorite'
    ELSE event_type END"""


def raw_client_events(t):
    """Client events with every kind of fault, straight from the event table."""
    kind = F.col("event_type")
    name = F.when(kind == "view", "impression").when(kind == "purchase", "dwell").when(kind == "error", "favorite").otherwise(kind)
    return t.raw("events").select(
        F.col("event_id").cast("string").alias("event_id"), name.alias("event_type"),
        F.col("user_id").alias("request_id"), "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        (F.get_json_object("props", "$.k").cast("bigint") * 103).alias("position"),
        F.when((kind == "purchase") & (F.col("value") < 40) | (kind == "view") & (F.col("value") > 60),
               F.floor(F.col("value") * 100).cast("bigint")).alias("dwell_ms"),
    )


@query(
    "event_rejects",
    f"""e AS (SELECT {LABEL} AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) * 103 AS position,
        CASE WHEN event_type = 'purchase' AND value < 40 OR event_type = 'view' AND value > 60
            THEN CAST(floor(value * 100) AS BIGINT) END AS dwell FROM events),
    r AS (SELECT CASE WHEN kind NOT IN ('impression', 'click', 'like', 'favorite', 'dwell', 'share', 'not_interested') THEN 'event_type'
        WHEN position NOT BETWEEN 0 AND 9999 THEN 'position' WHEN kind = 'dwell' AND dwell IS NULL THEN 'dwell_missing'
        WHEN kind = 'dwell' AND dwell NOT BETWEEN 750 AND 600000 THEN 'dwell_range'
        WHEN kind <> 'dwell' AND dwell IS NOT NULL THEN 'dwell_unexpected' ELSE 'accepted' END AS outcome,
        CASE WHEN kind = 'favorite' THEN 'like' ELSE kind END AS event_type FROM e)
    SELECT outcome, event_type, count(*) AS n FROM r GROUP BY outcome, event_type""",
)
def _(t):
    checked = B.validate_events(raw_client_events(t))
    return checked.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"), "event_type").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "referential_check",
    """SELECT b.event_type, count(*) AS events, count(*) FILTER (e.item_id IS NOT NULL) AS matched
    FROM behaviour b LEFT JOIN (SELECT * FROM exposures WHERE source <> 'explore') e ON e.request_id = b.request_id
        AND e.user_id = b.user_id AND e.item_id = b.item_id AND e.position = b.position GROUP BY b.event_type""",
)
def _(t):
    kept = t.exposures.filter(F.col("source") != "explore")
    return B.referential_check(t.behaviour, kept).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("matched").alias("matched")
    )


_REPEATED = """rep AS (SELECT event_id, event_type, request_id, user_id, item_id, position, dwell_ms, received_ms FROM behaviour
    UNION ALL SELECT event_id || ':again', event_type, request_id, user_id, item_id, position, dwell_ms + 5000, received_ms + 60000
        FROM behaviour WHERE event_type IN ('dwell', 'like')
    UNION ALL SELECT event_id, event_type, request_id, user_id, item_id, position + 1, dwell_ms, received_ms + 1000
        FROM behaviour WHERE event_type = 'share')"""


def repeated(t):
    names = ["event_id", "event_type", "request_id", "user_id", "item_id", "position", "dwell_ms", "received_ms"]
    base = t.behaviour.select(*names)
    longer = (
        base.filter(F.col("event_type").isin("dwell", "like"))
        .withColumn("event_id", F.concat("event_id", F.lit(":again")))
        .withColumn("dwell_ms", F.col("dwell_ms") + 5000)
        .withColumn("received_ms", F.col("received_ms") + 60000)
    )
    moved = (
        base.filter(F.col("event_type") == "share")
        .withColumn("position", F.col("position") + 1)
        .withColumn("received_ms", F.col("received_ms") + 1000)
    )
    return base.unionByName(longer).unionByName(moved)


@query(
    "dedup_events",
    _REPEATED + """ SELECT request_id, user_id, item_id, position, event_type, arg_min(event_id, received_ms) AS event_id,
        max(dwell_ms) AS dwell_ms, min(received_ms) AS received_ms, max(received_ms) AS last_ms, count(*) - 1 AS repeats
    FROM rep GROUP BY request_id, user_id, item_id, position, event_type""",
)
def _(t):
    return B.deduplicate(repeated(t)).withColumn("position", F.col("position").cast("bigint"))


@query(
    "id_conflicts",
    _REPEATED + """ SELECT event_id, count(*) AS deliveries FROM rep GROUP BY event_id
    HAVING count(DISTINCT (event_type, request_id, user_id, item_id, position, dwell_ms)) > 1""",
)
def _(t):
    return B.id_conflicts(repeated(t))


@query(
    "visit_index",
    """SELECT user_id, item_id, request_id, position, received_ms, event_id,
        row_number() OVER (PARTITION BY user_id, item_id ORDER BY received_ms, event_id) AS visit_index
    FROM behaviour WHERE event_type = 'impression'""",
)
def _(t):
    return B.visits(t.behaviour)


_VISITS = """vis AS (SELECT user_id, item_id, request_id, position, received_ms, feed_type,
    row_number() OVER (PARTITION BY user_id, item_id ORDER BY received_ms, event_id) AS visit_index
    FROM behaviour WHERE event_type = 'impression')"""
_ALL = _VISITS + """, ev AS (SELECT event_id, event_type, request_id, user_id, item_id, position, feed_type, dwell_ms, received_ms FROM behaviour
    UNION ALL SELECT 'revisit:' || request_id || ':' || item_id || ':' || position, 'revisit', request_id, user_id, item_id, position,
        feed_type, NULL, received_ms FROM vis WHERE visit_index > 1)"""


def all_events(t):
    """Behaviour with the derived revisit events."""
    names = ["event_id", "event_type", "request_id", "user_id", "item_id", "position", "dwell_ms", "received_ms"]
    again = B.revisit_events(t.behaviour, ("feed_type",))
    return t.behaviour.select(*names, "feed_type").unionByName(again.select(*names, "feed_type"))


@query(
    "revisit_events",
    _VISITS + """ SELECT 'revisit:' || request_id || ':' || item_id || ':' || position AS event_id, request_id, user_id, item_id,
        position, received_ms, visit_index FROM vis WHERE visit_index > 1""",
)
def _(t):
    return B.revisit_events(t.behaviour).drop("event_type", "dwell_ms")


STATE = """dd AS (SELECT user_id, item_id, event_type, max(dwell_ms) AS dwell_ms, max(received_ms) AS last_ms
        FROM behaviour GROUP BY request_id, user_id, item_id, position, event_type),
    agg AS (SELECT user_id, item_id, count(*) FILTER (event_type = 'impression') AS exposure_count,
        count(*) FILTER (event_type = 'click') AS click_count, count(*) FILTER (event_type = 'like') AS like_count,
        count(*) FILTER (event_type = 'share') AS share_count,
        CAST(coalesce(sum(dwell_ms) FILTER (event_type = 'dwell'), 0) AS BIGINT) AS dwell_ms_total,
        count(*) FILTER (event_type = 'dwell') AS dwell_event_count,
        coalesce(sum(CASE WHEN dwell_ms < 750 THEN 0 WHEN dwell_ms < 5000 THEN 0.25 WHEN dwell_ms < 30000 THEN 0.75 ELSE 1.5 END)
            FILTER (event_type = 'dwell'), 0) AS da,
        max(CASE WHEN event_type = 'not_interested' THEN 1 ELSE 0 END) AS not_interested, max(last_ms) AS last_event_ms
        FROM dd GROUP BY user_id, item_id),
    state AS (SELECT user_id, item_id, exposure_count, click_count, like_count, share_count, dwell_ms_total, dwell_event_count,
        not_interested, last_event_ms, greatest(0, exposure_count - 1) AS revisit_count,
        CAST(CASE WHEN not_interested = 1 THEN -4 ELSE least(8, click_count + 3 * like_count + 4 * share_count
            + 1.5 * greatest(0, exposure_count - 1) + da) END AS DOUBLE) AS affinity FROM agg)"""


@query("user_item_state", STATE + " SELECT * FROM state")
def _(t):
    return B.user_item_state(t.behaviour)


_SIDES = STATE + """, s AS (SELECT *, CASE WHEN affinity > 0 AND not_interested = 0 THEN 'positive'
        WHEN affinity < 0 OR not_interested = 1 THEN 'negative' END AS side FROM state),
    r AS (SELECT user_id, side, item_id, affinity AS weight, row_number() OVER (PARTITION BY user_id, side ORDER BY
        CASE WHEN side = 'positive' THEN -affinity ELSE affinity END, last_event_ms DESC, item_id) - 1 AS rank FROM s WHERE side IS NOT NULL)"""


@query(
    "profile_summary",
    _SIDES + """, l AS (SELECT user_id, string_agg(item_id || ':' || weight, ',' ORDER BY rank) FILTER (side = 'positive') AS p,
        string_agg(item_id || ':' || weight, ',' ORDER BY rank) FILTER (side = 'negative') AS n FROM r WHERE rank < 20 GROUP BY user_id),
    u AS (SELECT user_id, CAST(sum(exposure_count) AS BIGINT) AS impressions, CAST(sum(click_count) AS BIGINT) AS clicks,
        CAST(sum(like_count) AS BIGINT) AS likes, CAST(sum(dwell_ms_total) AS BIGINT) AS dwell_ms,
        CAST(sum(dwell_event_count) AS BIGINT) AS dwell_events, CAST(sum(share_count) AS BIGINT) AS shares,
        CAST(sum(revisit_count) AS BIGINT) AS revisits, CAST(sum(not_interested) AS BIGINT) AS not_interested,
        max(last_event_ms) AS updated_ms FROM state GROUP BY user_id)
    SELECT u.*, coalesce(p, '') AS positive_items, coalesce(n, '') AS negative_items FROM u LEFT JOIN l ON l.user_id IS NOT DISTINCT FROM u.user_id""",
)
def _(t):
    """The two lists as text: item:weight, best first."""
    rows = B.profile_summary(materialise(B.user_item_state(t.behaviour)))

    def text(name):
        return F.array_join(F.transform(name, lambda x: F.concat(x["item_id"].cast("string"), F.lit(":"), x["weight"].cast("string"))), ",")

    return rows.withColumns({c: text(c) for c in ("positive_items", "negative_items")})


@query("profile_items", _SIDES + "\n    SELECT user_id, side, item_id, weight, rank FROM r WHERE rank < 20")
def _(t):
    return B.profile_items(B.user_item_state(t.behaviour))


_SEEN = """seen AS (SELECT DISTINCT user_id, item_id FROM behaviour WHERE event_type IN ('impression', 'click', 'like', 'not_interested'))"""


@query(
    "exclude_seen",
    _SEEN + """ SELECT c.user_id, c.item_id, c.source FROM candidates c LEFT JOIN seen s ON s.user_id = c.user_id AND s.item_id = c.item_id
    WHERE s.user_id IS NULL""",
)
def _(t):
    return B.exclude_seen(t.candidates, B.seen_pairs(t.behaviour)).select("user_id", "item_id", "source")


@query(
    "online_only",
    "SELECT c.user_id, c.item_id, c.source FROM candidates c JOIN items i ON i.item_id = c.item_id WHERE i.status = 'online'",
)
def _(t):
    return B.online_only(t.candidates, t.items).select("user_id", "item_id", "source")


_FEEDBACK = """fb AS (SELECT event_id, event_type, user_id, item_id, received_ms,
    CAST(CASE event_type WHEN 'impression' THEN 0 WHEN 'click' THEN 1 WHEN 'like' THEN 3 WHEN 'share' THEN 4
        WHEN 'not_interested' THEN -2 WHEN 'dwell' THEN CASE WHEN dwell_ms < 5000 THEN 0.25 WHEN dwell_ms < 30000 THEN 0.75 ELSE 1.5 END
        END AS DOUBLE) AS weight,
    CASE event_type WHEN 'impression' THEN 'context' WHEN 'not_interested' THEN 'negative' ELSE 'positive' END AS disposition
    FROM behaviour)"""
_CAPPED = _FEEDBACK + """, run AS (SELECT *, sum(CASE WHEN disposition = 'positive' THEN weight ELSE 0 END) OVER (PARTITION BY user_id, item_id
        ORDER BY received_ms, event_id) AS cum, max(CASE WHEN disposition = 'negative' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, item_id) AS neg FROM fb),
    app AS (SELECT *, CASE WHEN disposition <> 'positive' THEN weight WHEN neg = 1 THEN 0
        ELSE least(6, cum) - least(6, cum - weight) END AS applied FROM run),
    capped AS (SELECT event_id, event_type, user_id, item_id, received_ms, applied AS weight, CASE WHEN disposition <> 'positive' THEN disposition
        WHEN neg = 1 THEN 'ignored_negative_conflict' WHEN applied <= 0 THEN 'ignored_positive_cap' ELSE disposition END AS disposition FROM app)"""


@query("classify_feedback", _FEEDBACK + " SELECT event_type, weight, disposition, count(*) AS n FROM fb GROUP BY event_type, weight, disposition")
def _(t):
    return B.classify_feedback(t.behaviour).groupBy("event_type", "weight", "disposition").agg(F.count(F.lit(1)).alias("n"))


def capped(t):
    """Feedback read several times by the split, hence written once."""
    names = ["event_id", "event_type", "user_id", "item_id", "received_ms", "weight", "disposition"]
    return materialise(B.capped_feedback(B.classify_feedback(t.behaviour)).select(*names))


@query("capped_feedback", _CAPPED + " SELECT event_id, weight, disposition FROM capped")
def _(t):
    return capped(t).select("event_id", "weight", "disposition")


_FSPLIT = """ts AS (SELECT received_ms, row_number() OVER (ORDER BY received_ms) - 1 AS i, count(*) OVER () AS n
        FROM (SELECT DISTINCT received_ms FROM capped WHERE disposition = 'positive')),
    ix AS (SELECT max(n) AS n, least(ceil(max(n) * 0.8) - 1, max(n) - 3) AS a FROM ts),
    iy AS (SELECT n, a, least(greatest(a + 1, ceil(n * 0.9) - 1), n - 2) AS b FROM ix),
    cut AS (SELECT max(CASE WHEN i = a THEN received_ms END) AS c1, max(CASE WHEN i = b THEN received_ms END) AS c2 FROM ts, iy)"""


@query(
    "feedback_split",
    _CAPPED + ", " + _FSPLIT + """ SELECT CASE WHEN received_ms <= c1 THEN 'train' WHEN received_ms <= c2 THEN 'validation' ELSE 'test' END AS split,
        count(*) AS n, round(sum(weight), 6) AS weight FROM capped, cut WHERE disposition = 'positive' GROUP BY 1""",
)
def _(t):
    return B.feedback_split(capped(t)).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), R).alias("weight")
    )


_LATE = _CAPPED.replace("FROM behaviour)", "FROM (SELECT * REPLACE (received_ms + 315360000000 AS received_ms) FROM behaviour))")


@query(
    "retrain_dataset",
    _LATE + ", " + _FSPLIT + """, d AS (SELECT 'train' AS split, user_id, item_id, ts_ms FROM interactions UNION ALL
        SELECT CASE WHEN received_ms <= c1 THEN 'train' WHEN received_ms <= c2 THEN 'validation' ELSE 'test' END, user_id, item_id, received_ms
        FROM capped, cut WHERE disposition = 'positive')
    SELECT split, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, CAST(sum(ts_ms // 1000) AS BIGINT) AS seconds
    FROM d GROUP BY split""",
)
def _(t):
    shifted = t.behaviour.withColumn("received_ms", F.col("received_ms") + 315360000000)
    # several steps of the budget read the events, and each would prune and group the lines anew
    events = materialise(B.budget_events(B.classify_feedback(shifted)))
    rows = B.retrain_dataset(t.interactions, materialise(B.positive_feedback(events)))
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"),
        F.sum(F.floor(F.col("ts_ms") / 1000)).alias("seconds"),
    )


@query(
    "training_feedback",
    _CAPPED + ", " + _FSPLIT + " SELECT disposition, count(*) AS n FROM capped, cut WHERE received_ms <= c1 GROUP BY disposition",
)
def _(t):
    return B.training_feedback(capped(t)).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


_RAW = """raw AS (SELECT 'e' || event_id AS event_id, CASE event_type WHEN 'view' THEN 'impression' WHEN 'purchase' THEN 'like'
        WHEN 'error' THEN 'not_interested' ELSE event_type END AS event_type, user_id * 10 AS user_id,
        CASE WHEN value > 90 THEN 'x' ELSE '' END || (CAST(json_extract_string(props, '$.k') AS BIGINT) * 30) AS item_id,
        CASE WHEN value < 1 THEN 'unknown' ELSE '2024-01-02 03:04:05' END AS received_at FROM events),
    scr AS (SELECT event_id, CASE WHEN r.event_type = 'signup' THEN 'unsupported_event_type' WHEN u.dataset_user_id IS NULL THEN 'unmapped_user'
        WHEN TRY_CAST(item_id AS BIGINT) IS NULL THEN 'invalid_item_id'
        WHEN u.dataset_user_id NOT IN (SELECT user_id FROM interactions) THEN 'unknown_dataset_user'
        WHEN TRY_CAST(item_id AS BIGINT) NOT IN (SELECT item_id FROM items) THEN 'missing_item_metadata'
        WHEN received_at = 'unknown' THEN 'invalid_received_at' END AS reason FROM raw r LEFT JOIN users u ON u.user_id = r.user_id)"""


@query(
    "skip_reasons",
    _RAW + """ SELECT reason, count(*) AS n FROM scr WHERE reason IS NOT NULL GROUP BY reason
    UNION ALL SELECT 'duplicate_event_id', count(*) FROM events WHERE value > 50 AND event_type = 'click' HAVING count(*) > 0""",
)
def _(t):
    kind = F.col("event_type")
    name = F.when(kind == "view", "impression").when(kind == "purchase", "like").when(kind == "error", "not_interested").otherwise(kind)
    rows = t.raw("events")
    rows = rows.unionByName(rows.filter((F.col("value") > 50) & (kind == "click"))).select(
        F.concat(F.lit("e"), F.col("event_id")).alias("event_id"), name.alias("event_type"),
        (F.col("user_id") * 10).alias("user_id"),
        F.concat(F.when(F.col("value") > 90, "x").otherwise(""),
                 (F.get_json_object("props", "$.k").cast("bigint") * 30).cast("string")).alias("item_id"),
        F.when(F.col("value") < 1, "unknown").otherwise("2024-01-02 03:04:05").alias("received_at"),
        F.lit(None).cast("bigint").alias("dwell_ms"),
    )
    screened = B.screen_events(rows, t.users, t.interactions.select("user_id"), t.items)
    return B.skip_counts(screened)


@query(
    "feedback_check",
    _CAPPED + """ SELECT count(*) AS rows, count(*) - count(DISTINCT event_id) AS repeated_ids,
        count(*) FILTER (isnan(weight) OR isinf(weight)) AS bad_weights FROM capped""",
)
def _(t):
    return B.check_feedback(capped(t))


@query(
    "export_events",
    """SELECT dataset_user_id AS user, item_id AS item, received_ms AS timestamp, event_type,
        CAST(CASE event_type WHEN 'click' THEN 1 ELSE 3 END AS BIGINT) AS weight, event_id
    FROM behaviour b JOIN users u ON u.user_id = b.user_id WHERE dataset_user_id IS NOT NULL AND event_type IN ('click', 'like')""",
)
def _(t):
    return B.export_events(t.behaviour, t.users)


@query(
    "latest_request",
    """SELECT user_id, created_ms, request_id, feed_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY created_ms DESC, request_id DESC) AS pick FROM requests) WHERE pick = 1""",
)
def _(t):
    return B.latest_request(t.requests)


@query(
    "dedup_first",
    "SELECT user_id, item_id, min(ts_ms) AS ts_ms FROM interactions GROUP BY user_id, item_id",
)
def _(t):
    return B.keep_first(t.interactions, ["user_id", "item_id"], ["ts_ms"])


@query(
    "event_user_join",
    """SELECT username, is_active, event_type, count(*) AS n FROM behaviour b JOIN users u ON u.user_id = b.user_id
    GROUP BY username, is_active, event_type""",
)
def _(t):
    # counted per user before the join: one row per user and type meets the dimension
    counts = t.behaviour.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(t.users, "user_id").select("username", "is_active", "event_type", "n")


@query(
    "as_of_filter",
    """SELECT item_id, count(*) AS n, max(ts_ms) AS last_ms FROM interactions, split_cuts WHERE ts_ms <= c1 GROUP BY item_id""",
)
def _(t):
    return as_of(t.interactions, train_cut(t)).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts_ms").alias("last_ms"))
