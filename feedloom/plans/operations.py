"""Operations tables, alerts, models, sources and sinks."""

import uuid

from pyspark.sql import functions as F

from .. import values as V
from ..operators import operations as O
from ..operators import split
from ..session import materialise, shared_dir
from ..sources import files, sinks
from .dashboard import END, START
from .data import digest_sql, prepared, split_rows
from .ranking import _OPS, campaigns, operations
from .registry import query

R = 6


def fresh_path(t, name):
    return f"{shared_dir(t.spark).rstrip('/')}/feedloom-{name}-{uuid.uuid4().hex}"


def batches(t):
    """Status batches: each order is one request over the parts of its lines."""
    lines = t.raw("lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_partkey").alias("part")).distinct()
    orders = t.raw("orders").select(
        F.col("o_orderkey").alias("batch_id"), (F.col("o_custkey") % 5).alias("admin_id"),
        F.concat(F.lit("key-"), (F.col("o_orderkey") % 4999).cast("string")).alias("key"),
        F.when(F.col("o_orderstatus") == "F", "offline").otherwise("online").alias("status"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at_ms"),
    )
    # parts beyond the catalog stand for unknown ids
    item = F.when(F.col("part") % 101 == 0, F.col("part") + 10_000_000).otherwise(F.col("part"))
    return lines.join(orders, "batch_id").withColumn("item_id", item).drop("part")


_BATCH = """bt AS (SELECT DISTINCT l_orderkey AS batch_id, CASE WHEN l_partkey % 101 = 0 THEN l_partkey + 10000000 ELSE l_partkey END AS item_id,
        o_custkey % 5 AS admin_id, 'key-' || (o_orderkey % 4999) AS key, CASE WHEN o_orderstatus = 'F' THEN 'offline' ELSE 'online' END AS status, epoch_ms(o_orderdate) AS at_ms
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    bs AS (SELECT batch_id, admin_id, key, min(at_ms) AS at_ms, count(*) AS items, count(*) FILTER (item_id NOT IN (SELECT item_id FROM items)) AS missing,
        string_agg(item_id || status, ',' ORDER BY item_id) AS payload FROM bt GROUP BY batch_id, admin_id, key),
    fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY admin_id, key ORDER BY at_ms, batch_id) AS pick FROM bs WHERE missing = 0) WHERE pick = 1),
    oc AS (SELECT bs.batch_id, bs.admin_id, bs.key, bs.at_ms, bs.items, bs.missing, CASE WHEN fs.batch_id IS NULL OR fs.at_ms > bs.at_ms THEN 'missing_items'
        WHEN fs.batch_id = bs.batch_id THEN 'applied' WHEN fs.payload = bs.payload THEN 'replay' ELSE 'conflict' END AS outcome
        FROM bs LEFT JOIN fs ON fs.admin_id = bs.admin_id AND fs.key = bs.key),
    sp AS (SELECT bt.*, i.status AS initial FROM bt JOIN oc ON oc.batch_id = bt.batch_id AND outcome = 'applied' JOIN items i ON i.item_id = bt.item_id),
    bf AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY item_id ORDER BY at_ms, batch_id), initial) AS before FROM sp),
    au AS (SELECT *, 1 + sum(CASE WHEN before <> status THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY at_ms, batch_id) AS version FROM bf)"""


def versioned_items(t):
    return t.items.select("item_id", "status", F.lit(1).cast("bigint").alias("status_version"))


@query("status_batch_outcomes", _BATCH + " SELECT * FROM oc")
def _(t):
    return O.check_batches(batches(t), t.items)


@query(
    "status_batch_audit",
    _BATCH + """ SELECT batch_id, admin_id, item_id, at_ms, CASE WHEN before = status THEN 'item_status_noop' WHEN status = 'offline' THEN 'item_offline' ELSE 'item_restore' END AS action,
        before, status AS after, CAST(version AS BIGINT) AS version FROM au""",
)
def _(t):
    return O.apply_status_batches(versioned_items(t), batches(t))[1]


@query(
    "status_batch_items",
    _BATCH + """, la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY at_ms DESC, batch_id DESC) AS pick FROM au) WHERE pick = 1)
    SELECT i.item_id, coalesce(la.status, i.status) AS status, CAST(coalesce(la.version, 1) AS BIGINT) AS status_version FROM items i LEFT JOIN la ON la.item_id = i.item_id""",
)
def _(t):
    return O.apply_status_batches(versioned_items(t), batches(t))[0]


@query(
    "item_status_as_of",
    _OPS + """ SELECT item_id, arg_max(status, (at_ms, operation_id)) AS status, count(*) AS operations FROM op WHERE at_ms <= 946684800000 GROUP BY item_id""",
)
def _(t):
    return O.item_status_as_of(operations(t), 946684800000)


@query(
    "operations_log",
    """SELECT o_orderkey AS operation_id, epoch_ms(o_orderdate) AS at_ms, user_id, username FROM orders JOIN users ON user_id = o_custkey
    ORDER BY at_ms DESC, operation_id DESC LIMIT 100""",
)
def _(t):
    rows = t.raw("orders").select(
        F.col("o_orderkey").alias("operation_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at_ms"), F.col("o_custkey").alias("user_id")
    )
    return O.operations_log(rows, t.users, 100).select("operation_id", "at_ms", "user_id", "username")


@query(
    "boost_checks",
    """c AS (SELECT s_suppkey AS id, s_suppkey * 3 % 97 AS item_id, s_suppkey % 5 = 0 AS everyone, CAST(floor(s_acctbal) AS INTEGER) AS priority,
        CASE WHEN s_nationkey < 20 THEN 5000 ELSE 10 END AS ends FROM supplier),
    r AS (SELECT CASE WHEN item_id NOT IN (SELECT item_id FROM items WHERE views >= 901) THEN 'unknown_item'
        WHEN NOT everyone AND id + 20 NOT IN (SELECT user_id FROM users WHERE dataset_user_id IS NOT NULL) THEN 'unknown_user'
        WHEN NOT everyone AND id + 7 NOT IN (SELECT user_id FROM users WHERE dataset_user_id IS NOT NULL) THEN 'unknown_user'
        WHEN NOT everyone AND id NOT IN (SELECT user_id FROM users WHERE dataset_user_id IS NOT NULL) THEN 'unknown_user'
        WHEN priority NOT BETWEEN -1000 AND 1000 THEN 'priority' ELSE 'accepted' END AS outcome FROM c)
    SELECT outcome, count(*) AS n FROM r GROUP BY outcome""",
)
def _(t):
    known = t.users.filter(F.col("dataset_user_id").isNotNull())
    checked = O.check_boosts(campaigns(t), t.items.filter(F.col("views") >= 901), known)
    return checked.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "boost_log",
    """sw AS (SELECT o_custkey AS id, o_orderstatus = 'O' AS active, epoch_ms(o_orderdate) AS at_ms, o_orderkey AS op FROM orders WHERE epoch_ms(o_orderdate) <= 946684800000)
    SELECT s_suppkey AS campaign_id, CAST(coalesce((SELECT arg_max(active, (at_ms, op)) FROM sw WHERE id = s_suppkey), s_nationkey <> 3) AS INTEGER) AS active,
        (SELECT count(*) FROM sw WHERE id = s_suppkey) AS changes FROM supplier""",
)
def _(t):
    switches = t.raw("orders").select(
        F.col("o_custkey").alias("campaign_id"), (F.col("o_orderstatus") == "O").alias("active"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at_ms"), F.col("o_orderkey").alias("operation_id"),
    )
    return O.boost_log(campaigns(t), switches, 946684800000).select("campaign_id", F.col("active").cast("int").alias("active"), "changes")


_NOW, _SPAN = END, (END - START) // V.MINUTE_MS
_METRICS = f"""ev AS (SELECT count(*) FILTER (event_type = 'impression') AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
        count(*) FILTER (event_type = 'like') AS likes FROM behaviour WHERE received_ms >= {START} AND received_ms < {END}),
    mv AS (SELECT impressions, clicks, likes, (SELECT count(*) FROM requests) AS requests, (SELECT count(*) FROM exposures) AS exposures,
        (SELECT count(*) FROM (SELECT user_id FROM requests UNION SELECT user_id FROM behaviour WHERE event_type <> 'impression' AND received_ms < {END})) AS active_users,
        (SELECT quantile_cont(latency_ms, 0.95) FROM requests) AS latency_p95, (SELECT count(*) FROM items WHERE status = 'offline') AS offline_items FROM ev),
    met AS (""" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST({'clicks / CAST(exposures AS DOUBLE)' if m == 'ctr' else m} AS DOUBLE) AS value FROM mv" for m in V.ALERT_METRICS
) + ")"


def metrics(t):
    return O.alert_metrics(t.requests, t.exposures, t.behaviour, t.items, _NOW, _SPAN)


@query("alert_metrics", _METRICS + " SELECT metric, round(value, 6) AS value FROM met")
def _(t):
    return metrics(t).withColumn("value", F.round("value", R))


def rules(t):
    names = F.array(*[F.lit(m) for m in V.ALERT_METRICS])
    signs = F.array(*[F.lit(o) for o in V.ALERT_OPERATORS])
    return t.raw("supplier").select(
        F.col("s_suppkey").alias("rule_id"), names[(F.col("s_suppkey") % 9).cast("int")].alias("metric"),
        signs[F.col("s_nationkey") % 4].alias("operator"), (F.col("s_acctbal") * 2).alias("threshold"),
        (F.col("s_nationkey") != 3).alias("enabled"), F.col("s_name").alias("name"),
        F.array(*[F.lit(x) for x in V.ALERT_SEVERITIES])[(F.col("s_suppkey") % 3).cast("int")].alias("severity"),
    )


def alert_events(t):
    size = t.raw("supplier").count()
    return t.raw("orders").select(
        F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("event_id"), (F.col("o_custkey") % (size * 3)).alias("rule_id"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"), (F.col("o_totalprice") / 4).alias("observed"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("triggered_ms"), F.lit(None).cast("bigint").alias("resolved_ms"),
        F.lit(0).cast("bigint").alias("evaluated_ms"),
    )


_RULES = "rl AS (SELECT s_suppkey AS rule_id, ([" + ", ".join(f"'{m}'" for m in V.ALERT_METRICS) + """])[CAST(s_suppkey % 9 AS INTEGER) + 1] AS metric,
    (['>', '>=', '<', '<='])[s_nationkey % 4 + 1] AS operator, s_acctbal * 2 AS threshold, s_nationkey <> 3 AS enabled, s_name AS name,
    (['info', 'warn', 'critical'])[CAST(s_suppkey % 3 AS INTEGER) + 1] AS severity FROM supplier)"""
_ALERTS = _METRICS + ", " + _RULES + """, ae AS (SELECT 'a' || o_orderkey AS event_id, o_custkey % (3 * (SELECT count(*) FROM supplier)) AS rule_id,
        CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'resolved' END AS status, o_totalprice / 4 AS observed, epoch_ms(o_orderdate) AS triggered_ms FROM orders),
    fi AS (SELECT rule_id, value, CASE operator WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold WHEN '<' THEN value < threshold ELSE value <= threshold END AS firing
        FROM rl JOIN met USING (metric) WHERE enabled),
    nw AS (SELECT rule_id, arg_max(event_id, (triggered_ms, event_id)) AS open_id FROM ae WHERE status = 'open' GROUP BY rule_id),
    st AS (SELECT fi.*, open_id FROM fi LEFT JOIN nw ON nw.rule_id = fi.rule_id)"""


@query(
    "evaluate_alerts",
    _ALERTS + f""" SELECT ae.event_id, ae.rule_id, CASE WHEN NOT st.firing THEN 'resolved' ELSE ae.status END AS status, round(coalesce(st.value, ae.observed), 6) AS observed, triggered_ms,
        CASE WHEN NOT st.firing THEN {_NOW} END AS resolved_ms, CASE WHEN st.rule_id IS NULL THEN 0 ELSE {_NOW} END AS evaluated_ms,
        CASE WHEN st.firing THEN 'refreshed' WHEN st.rule_id IS NOT NULL THEN 'resolved' ELSE 'unchanged' END AS transition FROM ae LEFT JOIN st ON st.open_id = ae.event_id
    UNION ALL SELECT 'alert:' || rule_id || ':{_NOW}', rule_id, 'open', round(value, 6), {_NOW}, NULL, {_NOW}, 'triggered' FROM st WHERE firing AND open_id IS NULL""",
)
def _(t):
    return O.evaluate_alerts(rules(t), metrics(t), alert_events(t), _NOW).withColumn("observed", F.round("observed", R))


@query(
    "acknowledge_alerts",
    """q AS (SELECT 'a' || (o_orderkey + o_orderkey % 2 * 10000000) AS event_id, o_custkey AS user_id FROM orders),
    ae AS (SELECT 'a' || o_orderkey AS event_id, o_orderstatus FROM orders)
    SELECT CASE WHEN o_orderstatus IS NULL THEN 'not_found' WHEN o_orderstatus = 'O' THEN 'acknowledged' ELSE 'not_open' END AS outcome, count(*) AS n
    FROM q LEFT JOIN ae USING (event_id) GROUP BY 1""",
)
def _(t):
    key = F.col("o_orderkey")
    asked = t.raw("orders").select(
        F.concat(F.lit("a"), (key + key % 2 * 10000000).cast("string")).alias("event_id"), F.col("o_custkey").alias("user_id")
    )
    return O.acknowledge_alerts(alert_events(t), asked).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def rule_changes(t):
    """A change log from the orders: updates, creations and deletions, some of them refused."""
    size, key = t.raw("supplier").count(), F.col("o_orderkey")
    urgent, made = F.col("o_orderpriority") == "1-URGENT", key % 7 == 0
    return t.raw("orders").select(
        (F.col("o_custkey") % (2 * size)).alias("rule_id"),
        F.when(urgent & (key % 40 == 0), "delete").when(made, "create").otherwise("update").alias("op"),
        F.when(made & (key % 2 == 0), F.concat(F.lit("rule "), key.cast("string"))).alias("name"),
        F.when(made, F.when(key % 5 == 0, "bogus").otherwise("ctr")).when(key % 3 == 0, "clicks").alias("metric"),
        F.when(made, ">").when(key % 11 == 0, "~").alias("operator"), F.round("o_totalprice", 2).alias("threshold"),
        F.when(key % 13 == 0, "loud").when(key % 4 == 0, "critical").alias("severity"), F.lit(None).cast("boolean").alias("enabled"),
        (F.unix_millis(F.col("o_orderdate").cast("timestamp")) * 100000 + key).alias("at_ms"),
    )


_CHANGED = _RULES + """, ch AS (SELECT o_custkey % (2 * (SELECT count(*) FROM supplier)) AS rule_id,
        CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 40 = 0 THEN 'delete' WHEN o_orderkey % 7 = 0 THEN 'create' ELSE 'update' END AS op,
        CASE WHEN o_orderkey % 14 = 0 THEN 'rule ' || o_orderkey END AS name,
        CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'bogus' ELSE 'ctr' END WHEN o_orderkey % 3 = 0 THEN 'clicks' END AS metric,
        CASE WHEN o_orderkey % 7 = 0 THEN '>' WHEN o_orderkey % 11 = 0 THEN '~' END AS operator, round(o_totalprice, 2) AS threshold,
        CASE WHEN o_orderkey % 13 = 0 THEN 'loud' WHEN o_orderkey % 4 = 0 THEN 'critical' END AS severity, epoch_ms(o_orderdate) * 100000 + o_orderkey AS at_ms FROM orders),
    ok AS (SELECT * FROM ch WHERE op = 'delete' OR coalesce(severity, '') <> 'loud' AND CASE WHEN op = 'create' THEN metric = 'ctr' AND name IS NOT NULL
        ELSE metric IS NULL AND operator IS NULL END),
    lg AS (SELECT rule_id, 'create' AS op, name, metric, operator, threshold, severity, enabled, -1 AS at_ms FROM rl
        UNION ALL SELECT rule_id, op, name, metric, operator, threshold, severity, NULL, at_ms FROM ok),
    nr AS (SELECT rule_id, arg_max(name, at_ms) FILTER (name IS NOT NULL) AS name, arg_max(metric, at_ms) FILTER (metric IS NOT NULL) AS metric,
        arg_max(operator, at_ms) FILTER (operator IS NOT NULL) AS operator, arg_max(threshold, at_ms) AS threshold,
        coalesce(arg_max(severity, at_ms) FILTER (severity IS NOT NULL), 'warn') AS severity, coalesce(arg_max(enabled, at_ms) FILTER (enabled IS NOT NULL), TRUE) AS enabled
        FROM lg GROUP BY rule_id HAVING bool_or(op = 'create') AND NOT bool_or(op = 'delete'))"""


@query(
    "alert_rules",
    _CHANGED + " SELECT rule_id, name, metric, operator, round(threshold, 6) AS threshold, severity, CAST(enabled AS INTEGER) AS enabled FROM nr",
)
def _(t):
    return O.maintain_rules(rules(t), rule_changes(t)).withColumn("enabled", F.col("enabled").cast("int")).withColumn("threshold", F.round("threshold", R))


@query(
    "alert_cascade",
    _CHANGED + """, ae AS (SELECT o_custkey % (3 * (SELECT count(*) FROM supplier)) AS rule_id, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'resolved' END AS status FROM orders)
    SELECT status, severity, count(*) AS n FROM ae JOIN nr USING (rule_id) GROUP BY status, severity""",
)
def _(t):
    """Alert events whose rule is left after the change log, by status and severity of the rule."""
    left = materialise(O.maintain_rules(rules(t), rule_changes(t)))
    kept = O.cascade_delete(alert_events(t), left).join(left.select("rule_id", "severity"), "rule_id")
    return kept.groupBy("status", "severity").agg(F.count(F.lit(1)).alias("n"))


def registry(t, part):
    rows = t.raw("orders").groupBy((F.col("o_custkey") % 200).alias("v"), (F.col("o_orderkey") % 2).alias("part")).agg(
        F.min(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("window_start"),
        F.max(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("window_end"),
        F.count(F.lit(1)).alias("sample_count"), F.count_if(F.col("o_orderstatus") == "O").alias("event_count"), F.max("o_orderkey").alias("created_ms"),
    )
    return rows.filter(F.col("part") == part).select(
        F.concat(F.lit("m"), F.col("v").cast("string")).alias("version"),
        F.when(F.col("v") % 3 != part, F.col("window_start")).alias("window_start"), "window_end",
        F.when(F.col("v") % 4 != part, F.col("sample_count")).alias("sample_count"), "event_count", "created_ms",
    )


@query(
    "register_model",
    """b AS (SELECT o_custkey % 200 AS v, o_orderkey % 2 AS part, min(epoch_ms(o_orderdate)) AS ws, max(epoch_ms(o_orderdate)) AS we, count(*) AS sc,
        count(*) FILTER (o_orderstatus = 'O') AS ec, max(o_orderkey) AS cr FROM orders GROUP BY 1, 2),
    n AS (SELECT v, CASE WHEN v % 3 <> part THEN ws END AS ws, we, CASE WHEN v % 4 <> part THEN sc END AS sc, ec, cr FROM b),
    m AS (SELECT v, arg_max(ws, cr) FILTER (ws IS NOT NULL) AS window_start, arg_max(we, cr) AS window_end, arg_max(sc, cr) FILTER (sc IS NOT NULL) AS sample_count,
        arg_max(ec, cr) AS event_count, max(cr) AS created_ms FROM n GROUP BY v)
    SELECT 'm' || v AS version, window_start, window_end, sample_count, event_count, created_ms,
        CASE WHEN created_ms = (SELECT max(created_ms) FROM m) THEN 'active' ELSE 'inactive' END AS status FROM m""",
)
def _(t):
    return O.register_models(registry(t, 0), registry(t, 1))


def model_reports(t):
    """One model per market segment; metrics are plain averages, protocols differ in k."""
    rows = t.raw("customer").groupBy("c_mktsegment").agg(
        F.round(F.avg("c_acctbal"), 4).alias("recall"), F.round(F.avg(F.col("c_nationkey").cast("double")), 4).alias("ndcg")
    )
    k = F.when(F.col("c_mktsegment") == "MACHINERY", "20").otherwise("10")
    return rows.select(
        F.col("c_mktsegment").alias("version"),
        F.concat(F.lit('{"k":"'), k, F.lit('","negatives_per_query":"100"}')).alias("protocol_json"),
        F.to_json(F.struct("recall", "ndcg")).alias("metrics_json"),
    )


_MODELS = """mr AS (SELECT c_mktsegment AS version, round(avg(c_acctbal), 4) AS recall, round(avg(CAST(c_nationkey AS DOUBLE)), 4) AS ndcg FROM customer GROUP BY 1),
    ml AS (SELECT version, 'recall' AS metric, recall AS value FROM mr UNION ALL SELECT version, 'ndcg', ndcg FROM mr)"""


@query(
    "compare_models",
    _MODELS + """ SELECT m.version, m.metric, round(m.value, 6) AS value, round(m.value - b.value, 6) AS delta, 1 AS compatible FROM ml m
    JOIN ml b ON b.metric = m.metric AND b.version = 'BUILDING' WHERE m.version IN ('BUILDING', 'HOUSEHOLD', 'FURNITURE')""",
)
def _(t):
    rows = O.compare_models(model_reports(t), ["BUILDING", "HOUSEHOLD", "FURNITURE"])
    return rows.select("version", "metric", F.round("value", R).alias("value"), F.round("delta", R).alias("delta"), F.col("compatible").cast("int").alias("compatible"))


@query(
    "compare_models_incompatible",
    _MODELS + " SELECT version, metric, round(value, 6) AS value, CAST(NULL AS DOUBLE) AS delta, 0 AS compatible FROM ml WHERE version IN ('BUILDING', 'MACHINERY')",
)
def _(t):
    rows = O.compare_models(model_reports(t), ["BUILDING", "MACHINERY"])
    return rows.select("version", "metric", F.round("value", R).alias("value"), F.round("delta", R).alias("delta"), F.col("compatible").cast("int").alias("compatible"))


@query(
    "metric_key_compat",
    """SELECT lang, round(avg(quality), 6) AS recall FROM documents JOIN labels ON labels.doc_id = documents.doc_id GROUP BY lang""",
)
def _(t):
    from ..operators.evaluation import metric_key_compat

    means = t.raw("documents").select("doc_id", "lang").join(t.raw("labels").select("doc_id", "quality"), "doc_id").groupBy("lang").agg(
        F.avg(F.col("quality").cast("double")).alias("q"), F.count(F.lit(1)).alias("n")
    )
    name = F.when(F.col("n") % 2 == 0, "sampled_all_items").otherwise("full_catalog")
    reports = means.withColumn("metrics_json", F.concat(F.lit('{"'), name, F.lit('":{"recall":'), F.col("q").cast("string"), F.lit("}}")))
    return metric_key_compat(reports).select("lang", F.round("recall", R).alias("recall"))


def runs(t):
    return t.raw("orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("status"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_ms")
    )


@query("run_history", "SELECT o_orderkey AS run_id, o_orderpriority AS status, epoch_ms(o_orderdate) AS created_ms FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(t):
    return O.run_history(runs(t), 50)[0]


@query("run_status_counts", "SELECT o_orderpriority AS status, count(*) AS n, max(epoch_ms(o_orderdate)) AS last_ms FROM orders GROUP BY 1")
def _(t):
    return O.run_history(runs(t), 50)[1]


_ASSET = """hs AS (SELECT page_id AS asset_id, sha256(html) AS digest FROM pages), gr AS (SELECT digest, count(*) AS copies FROM hs GROUP BY digest),
    ca AS (SELECT DISTINCT p_partkey AS item_id FROM part WHERE p_size > 3),
    ad AS (SELECT coalesce(asset_id, item_id) AS asset_id, hs.digest, copies, CASE WHEN hs.digest IS NULL THEN 'missing' WHEN item_id IS NULL THEN 'unexpected' ELSE 'matched' END AS state
        FROM hs FULL OUTER JOIN ca ON ca.item_id = hs.asset_id LEFT JOIN gr ON gr.digest = hs.digest)"""


def audit(t):
    return O.audit_assets(t.file_assets, t.items.filter(F.col("likes") > 3))


@query("audit_assets", _ASSET + " SELECT * FROM ad")
def _(t):
    return audit(t)


@query(
    "audit_summary",
    _ASSET + """ SELECT count(digest) AS assets, count(*) FILTER (state = 'matched') AS matched, count(*) FILTER (state = 'missing') AS missing,
        count(*) FILTER (state = 'unexpected') AS unexpected, (SELECT count(*) FROM gr WHERE copies > 1) AS duplicate_groups,
        round(count(*) FILTER (state = 'matched') / CAST(count(*) FILTER (state <> 'unexpected') AS DOUBLE), 6) AS coverage FROM ad""",
)
def _(t):
    return O.audit_summary(audit(t)).withColumn("coverage", F.round("coverage", R))


@query(
    "duplicate_assets",
    """h AS (SELECT doc_id, sha256(text) AS digest FROM documents) SELECT digest, count(*) AS copies, min(doc_id) AS first_asset FROM h GROUP BY digest
    HAVING count(*) > 1 ORDER BY copies DESC, digest LIMIT 100""",
)
def _(t):
    texts = t.documents.select(F.col("item_id").alias("asset_id"), F.col("title").alias("content"))
    return O.top_duplicates(O.audit_assets(texts, t.documents), 100)


# ---------------------------------------------------------------- sources and sinks, written and read back


@query(
    "read_interactions",
    "SELECT count(*) AS rows, count(DISTINCT user_id) AS users, CAST(sum(item_id) AS BIGINT) AS items, max(ts_ms) AS last_ms FROM interactions WHERE user_id > 0 AND item_id > 0",
)
def _(t):
    path = fresh_path(t, "interactions")
    sinks.write_csv(t.interactions.select(F.col("user_id").alias("user"), F.col("item_id").alias("item"), F.col("ts_ms").alias("timestamp")), path)
    rows, _rejects = files.read_interactions(t.spark, path)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users"), F.sum("item_id").alias("items"), F.max("ts_ms").alias("last_ms"))


@query("read_interactions_rejects", "SELECT CASE WHEN user_id <= 0 THEN 'user' ELSE 'item' END AS reason, count(*) AS n FROM interactions WHERE user_id <= 0 OR item_id <= 0 GROUP BY 1")
def _(t):
    path = fresh_path(t, "interactions")
    sinks.write_csv(t.interactions.select(F.col("user_id").alias("user"), F.col("item_id").alias("item"), F.col("ts_ms").alias("timestamp")), path)
    return files.read_interactions(t.spark, path)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("read_titles", "SELECT item_id, title FROM items WHERE item_id > 0")
def _(t):
    path = fresh_path(t, "titles")
    sinks.write_csv(t.items.select(F.col("item_id").alias("item"), F.concat(F.lit("  "), "title").alias("title")), path)
    return files.read_titles(t.spark, path)[0]


@query("read_item_stats", "SELECT item_id, likes, views FROM items WHERE item_id > 0")
def _(t):
    path = fresh_path(t, "stats")
    t.items.select(F.concat_ws("\t", "item_id", "likes", "views").alias("value")).write.text(path)
    return files.read_item_stats(t.spark, path)[0]


@query("write_split", "SELECT split, user_id, item_id, ts_ms FROM split_rows")
def _(t):
    path = fresh_path(t, "split")
    sinks.write_split(split_rows(t), path)
    return t.spark.read.schema("user_id bigint, item_id bigint, ts_ms bigint, split string").parquet(path)


@query("write_user_history", "SELECT u.user_id, count(s.item_id) AS items FROM (SELECT DISTINCT user_id FROM split_rows) u LEFT JOIN (SELECT * FROM split_rows WHERE split = 'train') s USING (user_id) GROUP BY u.user_id")
def _(t):
    path = fresh_path(t, "history")
    sinks.write_user_history(split.user_histories(prepared(t)), path)
    back = t.spark.read.schema("user_id bigint, item_ids array<bigint>, timestamps_ms array<bigint>").json(path)
    return back.select("user_id", F.size("item_ids").cast("bigint").alias("items"))


@query(
    "load_items",
    """SELECT 'v' || p_partkey AS item_id, concat_ws(' ', p_name, p_brand, p_type) AS title, CAST(p_size AS BIGINT) AS likes, CAST(floor(p_retailprice) AS BIGINT) AS views,
        round(CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE ln(1 + floor(p_retailprice)) + 2 * ln(1 + p_size) END, 6) AS popularity_score,
        CASE WHEN p_size % 3 = 0 THEN 's1' END AS stats_version FROM part""",
)
def _(t):
    raw = t.raw("part").select(
        F.concat(F.lit("v"), "p_partkey").alias("videoID"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("item_title"),
        F.col("p_size").alias("like_count"), F.floor("p_retailprice").alias("view_count"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")).alias("hot_score"),
        F.when(F.col("p_size") % 3 == 0, "s1").otherwise("s0").alias("stats_snapshot_version"), F.lit("2024-01-01T00:00:00Z").alias("stats_available_at"),
    )
    repeated = raw.withColumn("line", F.lit(1)).unionByName(raw.withColumn("item_title", F.lit("later copy")).withColumn("line", F.lit(2)))
    rows = files.normalise_items(repeated, "s1", "2024-01-01T00:00:00Z")
    return rows.select("item_id", "title", "likes", "views", F.round("popularity_score", R).alias("popularity_score"), "stats_version")


@query(
    "stats_snapshot",
    """SELECT substr(sha256('2024-01-01T00:00:00Z|abc'), 1, 16) AS snapshot_version, '2024-01-01T00:00:00Z' AS available_at, 'abc' AS source_hash, 'stats.tsv' AS source_name,
        count(*) AS row_count, count(*) FILTER (likes = 0) AS zero_likes, count(*) FILTER (views = 0) AS zero_views, count(*) FILTER (likes > views) AS likes_above_views,
        'enabled' AS policy FROM items""",
)
def _(t):
    return files.stats_snapshot(t.items, "2024-01-01T00:00:00Z", "abc", "stats.tsv")


@query("read_split", "SELECT split, user_id, item_id, ts_ms FROM split_rows")
def _(t):
    path = fresh_path(t, "split-files")
    sinks.write_split_files(split_rows(t), path)
    parts = [files.read_split(t.spark, f"{path}/{name}").withColumn("split", F.lit(name)) for name in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("split", "user_id", "item_id", "ts_ms")


@query(
    "read_feedback",
    """SELECT 'f' || o_orderkey AS event_id, o_custkey AS user_id, o_orderkey % 1000 AS item_id, epoch_ms(o_orderdate) AS ts_ms, CASE WHEN o_orderstatus = 'F' THEN 'like' ELSE 'click' END AS event_type,
        round(CAST(o_totalprice AS DOUBLE), 4) AS weight, 'positive, "sure"' AS disposition, CAST(o_orderdate AS VARCHAR) AS received_at FROM orders""",
)
def _(t):
    path = fresh_path(t, "feedback")
    rows = t.raw("orders").select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("event_id"), F.col("o_custkey").alias("user_id"),
        (F.col("o_orderkey") % 1000).alias("item_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp_ms"),
        F.when(F.col("o_orderstatus") == "F", "like").otherwise("click").alias("event_type"), F.col("o_totalprice").alias("weight"),
        F.lit('positive, "sure"').alias("disposition"), F.col("o_orderdate").cast("string").alias("received_at"),
    )
    sinks.write_csv(rows, path)
    return files.read_feedback(t.spark, path).withColumn("weight", F.round("weight", 4))


_LOADED = """lo AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, concat_ws(' ', p_name, p_brand, p_type) || ', "new"' AS title, CAST(p_size + 1 AS BIGINT) AS likes,
        CAST(floor(p_retailprice) AS BIGINT) AS views, 'online' AS status, 1 AS status_version FROM part WHERE p_size > 25),
    kn AS (SELECT CAST(item_id AS VARCHAR) AS item_id, title, likes, views, status, 7 AS status_version FROM items WHERE likes < 40)"""


def loaded_items(t):
    """An item file with other spellings of its columns, written and loaded again."""
    path = fresh_path(t, "items")
    rows = t.raw("part").filter("p_size > 25").select(
        F.col("p_partkey").alias("video_id"), F.concat(F.concat_ws(" ", "p_name", "p_brand", "p_type"), F.lit(', "new"')).alias("video_title"),
        (F.col("p_size") + 1).alias("num_likes"), F.floor("p_retailprice").alias("num_views"),
    )
    sinks.write_csv(rows, path)
    return files.load_items(t.spark, path)


@query("load_items_file", _LOADED + " SELECT item_id, title, likes, views, round(ln(1 + views) + 2 * ln(1 + likes), 6) AS popularity_score FROM lo")
def _(t):
    return loaded_items(t).select("item_id", "title", "likes", "views", F.round("popularity_score", R).alias("popularity_score"))


@query(
    "upsert_items",
    _LOADED + """ SELECT item_id, title, likes, views, status, status_version FROM kn WHERE item_id NOT IN (SELECT item_id FROM lo)
    UNION ALL SELECT lo.item_id, lo.title, lo.likes, lo.views, coalesce(kn.status, lo.status), coalesce(kn.status_version, lo.status_version) FROM lo LEFT JOIN kn ON kn.item_id = lo.item_id""",
)
def _(t):
    """The catalog after a load, written and read back: facts from the file, status from the catalog."""
    names = ["item_id", "title", "likes", "views", "status", "status_version"]
    known = t.items.filter("likes < 40").select(F.col("item_id").cast("string").alias("item_id"), "title", "likes", "views", "status", F.lit(7).alias("status_version"))
    path = fresh_path(t, "catalog")
    sinks.write_items(files.upsert_items(known, loaded_items(t).select(*names)), path)
    return t.spark.read.schema("item_id string, title string, likes bigint, views bigint, status string, status_version int").parquet(path).withColumn(
        "status_version", F.col("status_version").cast("int")
    )


@query("publish_table", "SELECT item_id, title FROM items")
def _(t):
    root = fresh_path(t, "publish")
    sinks.publish_table(t.items.select("item_id", "title"), root, "v1", ["item_id"])
    return sinks.read_published(t.spark, root)


@query(
    "publish_pointer",
    digest_sql("pt", "items", ["item_id", "title"]) + " SELECT 'v2' AS version, rows, digest FROM pt",
)
def _(t):
    """The pointer after two publications."""
    root = fresh_path(t, "publish")
    sinks.publish_table(t.items.filter("likes > 10").select("item_id", "title"), root, "v1", ["item_id"])
    pointer = sinks.publish_table(t.items.select("item_id", "title"), root, "v2", ["item_id"])
    again = sinks.read_pointer(t.spark, root)
    if again != pointer:
        raise ValueError("the pointer read is not the one published")
    return t.spark.createDataFrame([(again["version"], again["rows"], again["digest"])], "version string, rows bigint, digest string")


@query("stats_join", """SELECT count(*) AS items, count(s.likes) AS verified FROM items i LEFT JOIN (SELECT item_id, likes FROM items WHERE likes % 2 = 0) s ON s.item_id = i.item_id AND s.likes = i.likes""")
def _(t):
    stats = t.items.filter(F.col("likes") % 2 == 0).select("item_id", "likes", F.lit(1).alias("v"))
    return t.items.join(stats, ["item_id", "likes"], "left").agg(F.count(F.lit(1)).alias("items"), F.count("v").alias("verified"))


