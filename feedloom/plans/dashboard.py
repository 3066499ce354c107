"""Dashboard reports over the full span of the tables."""

from pyspark.sql import functions as F

from .. import values as V
from ..functions import exprs as E
from ..operators import dashboard as D
from .behaviour import _ALL, all_events
from .registry import query

R = 6
START, END, SEEN = 788918400000, 1020211200000, 852076800000  # 1995-01-01, 2002-05-01, 1997-01-01
_WIN = f"BETWEEN {START} AND {END - 1}"


def rounded(df, *names):
    for name in names:
        df = df.withColumn(name, F.round(name, R))
    return df


_MARK = _ALL + f""", seen AS (SELECT DISTINCT request_id, user_id, item_id, position FROM ev WHERE event_type = 'impression'
        AND received_ms >= {SEEN} AND received_ms < {END}),
    mk AS (SELECT ev.*, event_type = 'impression' AND received_ms >= {SEEN} AS imp, event_type = 'click' AND received_ms >= {SEEN}
        AND seen.item_id IS NOT NULL AS vc FROM ev LEFT JOIN seen USING (request_id, user_id, item_id, position) WHERE received_ms {_WIN})"""
_RATE = "CASE WHEN {1} = 0 THEN 0.0::DOUBLE ELSE round(CAST({0} AS DOUBLE) / {1}, 6) END"


@query(
    "overview",
    _MARK + f""", a AS (SELECT count(*) FILTER (imp) AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
        count(*) FILTER (vc) AS viewable_clicks, count(*) FILTER (event_type = 'like') AS likes,
        count(*) FILTER (event_type = 'share') AS shares, count(*) FILTER (event_type = 'revisit') AS revisits,
        count(DISTINCT user_id) FILTER (event_type = 'revisit') AS revisit_users,
        coalesce(avg(dwell_ms) FILTER (event_type = 'dwell'), 0) AS dw FROM mk),
    b AS (SELECT (SELECT count(*) FROM requests WHERE created_ms {_WIN}) AS requests,
        (SELECT count(*) FROM exposures WHERE created_ms {_WIN}) AS exposures,
        (SELECT count(*) FROM (SELECT user_id FROM requests WHERE created_ms {_WIN} UNION SELECT user_id FROM ev
            WHERE event_type <> 'impression' AND received_ms {_WIN})) AS active_users)
    SELECT requests, exposures, active_users, impressions, clicks, likes, shares, revisits, revisit_users, viewable_clicks,
        {_RATE.format('clicks', 'exposures')} AS served_ctr, {_RATE.format('viewable_clicks', 'impressions')} AS viewable_ctr,
        round(dw, 6) AS average_dwell_ms FROM a, b""",
)
def _(t):
    return rounded(
        D.overview(t.requests, t.exposures, all_events(t), START, END, SEEN), "served_ctr", "viewable_ctr", "average_dwell_ms"
    )


_FEEDSQL = _MARK + f""", f AS (SELECT unnest(['personalized', 'popular', 'explore']) AS feed_type),
    q AS (SELECT feed_type, count(*) AS requests FROM requests WHERE created_ms {_WIN} GROUP BY feed_type),
    x AS (SELECT feed_type, count(*) AS exposures FROM exposures WHERE created_ms {_WIN} GROUP BY feed_type),
    a AS (SELECT feed_type, count(*) FILTER (imp) AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
        count(*) FILTER (vc) AS viewable_clicks, count(*) FILTER (event_type = 'like') AS likes,
        count(*) FILTER (event_type = 'not_interested') AS not_interested FROM mk GROUP BY feed_type),
    fb AS (SELECT f.feed_type, coalesce(requests, 0) AS requests, coalesce(exposures, 0) AS exposures, coalesce(impressions, 0) AS impressions,
        coalesce(clicks, 0) AS clicks, coalesce(viewable_clicks, 0) AS viewable_clicks, coalesce(likes, 0) AS likes,
        coalesce(not_interested, 0) AS not_interested FROM f LEFT JOIN q USING (feed_type) LEFT JOIN x USING (feed_type) LEFT JOIN a USING (feed_type)),
    feeds AS (SELECT *, {_RATE.format('clicks', 'exposures')} AS served_ctr, {_RATE.format('viewable_clicks', 'impressions')} AS viewable_ctr,
        {_RATE.format('exposures', '(SELECT sum(exposures) FROM fb)')} AS share FROM fb)"""


@query("feed_breakdown", _FEEDSQL + " SELECT * FROM feeds")
def feed_breakdown(t):
    return rounded(
        D.feed_breakdown(t.requests, t.exposures, t.behaviour, START, END, SEEN), "served_ctr", "viewable_ctr", "share"
    )


@query(
    "engagement_by_feed",
    _ALL + f""" SELECT feed_type, count(*) FILTER (event_type = 'share') AS shares, count(*) FILTER (event_type = 'revisit') AS revisits,
        count(DISTINCT user_id) FILTER (event_type = 'revisit') AS revisit_users,
        round(coalesce(avg(dwell_ms) FILTER (event_type = 'dwell'), 0), 6) AS average_dwell_ms
    FROM ev WHERE received_ms {_WIN} GROUP BY feed_type""",
)
def _(t):
    return rounded(D.engagement_by_feed(all_events(t), START, END), "average_dwell_ms")


_TOP = _MARK + f""", xi AS (SELECT item_id, count(*) AS exposures FROM exposures WHERE created_ms {_WIN} GROUP BY item_id),
    a2 AS (SELECT item_id, count(*) FILTER (imp) AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
        count(*) FILTER (vc) AS viewable_clicks, count(*) FILTER (event_type = 'like') AS likes FROM mk GROUP BY item_id),
    tp AS (SELECT xi.item_id, title, exposures, coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks,
        coalesce(viewable_clicks, 0) AS viewable_clicks, coalesce(a2.likes, 0) AS likes
        FROM xi JOIN (SELECT item_id, title FROM items) USING (item_id) LEFT JOIN a2 USING (item_id) ORDER BY exposures DESC, coalesce(clicks, 0) DESC, xi.item_id LIMIT 10),
    tops AS (SELECT *, {_RATE.format('clicks', 'exposures')} AS served_ctr, {_RATE.format('viewable_clicks', 'impressions')} AS viewable_ctr FROM tp)"""


@query("top_items", _TOP + " SELECT * FROM tops")
def top_items(t):
    return rounded(
        D.top_items(t.items, t.exposures, t.behaviour, START, END, SEEN), "served_ctr", "viewable_ctr"
    )


_SRC = f"""src AS (SELECT source, count(*) AS exposures, count(DISTINCT request_id) AS requests,
    round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM exposures WHERE created_ms {_WIN}), 6) AS share
    FROM exposures WHERE created_ms {_WIN} GROUP BY source)"""


@query("source_share", _SRC + " SELECT * FROM src")
def source_share(t):
    return rounded(D.source_share(t.exposures, START, END), "share")


_PCT = """round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.95), 6) AS p95, round(quantile_cont({0}, 0.99), 6) AS p99,
    round(CAST(max({0}) AS DOUBLE), 6) AS max"""


@query(
    "latency_percentiles",
    f"SELECT feed_type, count(*) AS n, round(min(latency_ms), 6) AS min, {_PCT.format('latency_ms')} FROM requests GROUP BY feed_type",
)
def _(t):
    return rounded(D.percentiles(t.requests, "latency_ms", ("feed_type",)), "min", "p50", "p95", "p99", "max")


@query(
    "dwell_percentiles",
    f"""SELECT count(*) AS n, round(CAST(min(dwell_ms) AS DOUBLE), 6) AS min, {_PCT.format('dwell_ms')} FROM behaviour
    WHERE event_type = 'dwell' AND received_ms {_WIN}""",
)
def _(t):
    dwell = D.between(t.behaviour.filter(F.col("event_type") == "dwell"), "received_ms", START, END)
    return rounded(D.zero_percentiles(dwell, "dwell_ms"), "min", "p50", "p95", "p99", "max")


@query(
    "active_users",
    f"""SELECT count(*) AS active_users FROM (SELECT user_id FROM requests WHERE created_ms {_WIN} UNION SELECT user_id FROM behaviour
    WHERE event_type <> 'impression' AND received_ms {_WIN})""",
)
def _(t):
    return D.active_users(t.requests, t.behaviour, START, END)


@query(
    "viewable_clicks",
    f"""SELECT c.event_id, c.item_id, c.position FROM (SELECT * FROM behaviour WHERE event_type = 'click' AND received_ms {_WIN}) c
    SEMI JOIN (SELECT DISTINCT user_id, request_id, item_id, position FROM behaviour WHERE event_type = 'impression' AND received_ms {_WIN}) i
    USING (user_id, request_id, item_id, position)""",
)
def _(t):
    return D.viewable_clicks(t.behaviour, START, END).select("event_id", "item_id", "position")


@query(
    "exposure_outcomes",
    f"""SELECT e.source, count(*) AS exposures, count(c.event_id) AS clicked FROM exposures e LEFT JOIN behaviour c
    ON c.request_id = e.request_id AND c.item_id = e.item_id AND c.position = e.position AND c.event_type = 'click'
        AND c.received_ms >= {SEEN} AND c.received_ms < {END} GROUP BY e.source""",
)
def _(t):
    # the time bound belongs to the right side, so unmatched exposures stay
    clicks = D.between(t.behaviour.filter(F.col("event_type") == "click"), "received_ms", SEEN, END)
    keys = ["request_id", "item_id", "position"]
    joined = t.exposures.join(clicks.select(*keys, "event_id"), keys, "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("exposures"), F.count("event_id").alias("clicked"))


def _series(span, table, ts, start, end, where="TRUE"):
    return f"""SELECT s.b AS bucket_ms, count(x.{ts}) AS value FROM (SELECT unnest(range({start // span * span},
        {(end - 1) // span * span + 1}, {span})) AS b) s LEFT JOIN (SELECT {ts} FROM {table} WHERE {where} AND {ts} >= {start}
        AND {ts} < {end}) x ON x.{ts} // {span} * {span} = s.b GROUP BY s.b"""


@query("timeseries_day", _series(V.DAY_MS, "requests", "created_ms", START, END))
def _(t):
    return D.time_series(t.requests, "created_ms", START, END)


_HOUR = 1704067200000  # 2024-01-01; the hourly report covers at most 48 hours by definition


@query("timeseries_hour", _series(V.HOUR_MS, "clickstream", "ts_ms", _HOUR, _HOUR + 48 * V.HOUR_MS, "event_type = 'click'"))
def _(t):
    clicks = t.clickstream.filter(F.col("event_type") == "click")
    return D.time_series(clicks, "ts_ms", _HOUR, _HOUR + 48 * V.HOUR_MS)


@query(
    "time_range",
    f"SELECT count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM clickstream WHERE ts_ms >= {_HOUR} AND ts_ms < {_HOUR + 366 * V.DAY_MS}",
)
def _(t):
    rows = E.time_range(t.clickstream, _HOUR, _HOUR + 366 * V.DAY_MS)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query(
    "request_trace",
    """x AS (SELECT request_id, string_agg(item_id || '@' || source, ',' ORDER BY position) AS shown FROM exposures GROUP BY request_id),
    e AS (SELECT request_id, string_agg(event_id, ',' ORDER BY received_ms, event_id) AS acted FROM behaviour GROUP BY request_id)
    SELECT r.request_id, r.user_id, r.feed_type, r.created_ms, coalesce(shown, '') AS shown, coalesce(acted, '') AS acted
    FROM requests r LEFT JOIN x USING (request_id) LEFT JOIN e USING (request_id)""",
)
def _(t):
    trace = D.request_trace(t.requests, t.exposures, t.behaviour)
    shown = F.transform("shown", lambda s: F.concat(s["item_id"].cast("string"), F.lit("@"), s["source"]))
    return trace.withColumn("shown", F.array_join(shown, ",")).withColumn("acted", F.array_join("acted.event_id", ","))


@query(
    "user_debug",
    """r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY received_ms DESC, event_id) - 1 AS rank FROM behaviour)
    SELECT r.user_id, rank, event_id, event_type, r.feed_type, source FROM r LEFT JOIN exposures e ON e.request_id = r.request_id
        AND e.item_id = r.item_id AND e.position = r.position WHERE rank < 20""",
)
def _(t):
    return D.recent_events(t.behaviour, t.exposures).select("user_id", "rank", "event_id", "event_type", "feed_type", "source")


@query(
    "search_items",
    """f AS (SELECT * FROM items WHERE (CAST(item_id AS VARCHAR) LIKE '%ring%' OR lower(title) LIKE '%ring%') AND status = 'online')
    SELECT item_id, title, status, (SELECT count(*) FROM f) AS total FROM f
    ORDER BY round(ln(1 + views) + 2 * ln(1 + likes), 9) DESC, CAST(item_id AS VARCHAR) LIMIT 50 OFFSET 10""",
)
def _(t):
    return D.search_items(t.items, "ring", "online", 50, 10)


@query(
    "dashboard_records",
    _TOP + ", " + _SRC + ", " + _FEEDSQL[len(_MARK) + 2:] + """
    SELECT 'feed' AS section, feed_type AS key, requests, exposures, impressions, clicks, likes, served_ctr, viewable_ctr, share, NULL::VARCHAR AS title FROM feeds
    UNION ALL SELECT 'source', source, requests, exposures, NULL, NULL, NULL, NULL, NULL, share, NULL FROM src
    UNION ALL SELECT 'top_item', CAST(item_id AS VARCHAR), NULL, exposures, impressions, clicks, likes, served_ctr, viewable_ctr, NULL, title FROM tops
    UNION ALL SELECT 'overview', 'all', (SELECT count(*) FROM requests), (SELECT count(*) FROM exposures), count(*) FILTER (imp),
        count(*) FILTER (event_type = 'click'), count(*) FILTER (event_type = 'like'),
        round(CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) / (SELECT count(*) FROM exposures), 6),
        round(CAST(count(*) FILTER (vc) AS DOUBLE) / count(*) FILTER (imp), 6), NULL, NULL FROM mk WHERE event_type <> 'revisit'""",
)
def _(t):
    rows = D.dashboard_records(
        rounded(D.overview(t.requests, t.exposures, t.behaviour, START, END, SEEN), "served_ctr", "viewable_ctr"),
        feed_breakdown(t), source_share(t), top_items(t),
    )
    return rows.select(
        "section", "key", "requests", "exposures", "impressions", "clicks", "likes", "served_ctr", "viewable_ctr", "share", "title"
    )
