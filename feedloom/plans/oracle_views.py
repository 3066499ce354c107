"""DuckDB text of the table views, used as common table expressions by the checking SQL."""

from .. import values as V

_SOURCES = "[" + ", ".join(f"'{name}'" for name in V.SOURCES) + "]"
_KINDS = (
    ("impression", 0, "l_quantity >= 15"),
    ("click", 1, "l_returnflag = 'A'"),
    ("like", 2, "l_discount >= 0.09"),
    ("share", 3, "l_discount = 0"),
    ("not_interested", 4, "l_returnflag = 'R' AND l_tax >= 0.08"),
    ("dwell", 5, "l_quantity >= 25 AND l_extendedprice BETWEEN 750 AND 600000"),
)
_EVENTS = " UNION ALL ".join(
    f"""SELECT '{kind}:' || request_id || ':' || item_id AS event_id, '{kind}' AS event_type, request_id, user_id,
    item_id, position, feed_type,
    {"CAST(floor(l_extendedprice) AS BIGINT)" if kind == "dwell" else "CAST(NULL AS BIGINT)"} AS dwell_ms,
    created_ms + (position * 8 + {k}) * 60000 AS received_ms FROM served_lines WHERE {rule}"""
    for kind, k, rule in _KINDS
)

VIEWS: dict[str, str] = {
    "interactions": """SELECT o_custkey AS user_id, l_partkey AS item_id, epoch_ms(o_orderdate) AS ts_ms
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "items": """SELECT p_partkey AS item_id, concat_ws(' ', p_name, p_brand, p_type) AS title,
        CAST(p_size AS BIGINT) AS likes, CAST(floor(p_retailprice) AS BIGINT) AS views,
        CASE WHEN p_size = 7 THEN 'offline' ELSE 'online' END AS status, p_size >= 40 AS is_cold FROM part""",
    "users": """SELECT c_custkey AS user_id, CASE WHEN c_acctbal >= 0 THEN c_custkey END AS dataset_user_id,
        c_name AS username, c_mktsegment <> 'HOUSEHOLD' AS is_active FROM customer""",
    "requests": """SELECT o_orderkey AS request_id, o_custkey AS user_id,
        CASE o_orderkey % 3 WHEN 0 THEN 'personalized' WHEN 1 THEN 'popular' ELSE 'explore' END AS feed_type,
        epoch_ms(o_orderdate) AS created_ms, o_totalprice / 1000 AS latency_ms FROM orders""",
    "served_lines": """SELECT k.request_id, k.item_id, row_number() OVER (PARTITION BY k.request_id
            ORDER BY l_linenumber, k.item_id) - 1 AS position, l_suppkey, l_extendedprice, l_quantity, l_discount,
            l_tax, l_returnflag, r.user_id, r.feed_type, r.created_ms
        FROM (SELECT l_orderkey AS request_id, l_partkey AS item_id, l_linenumber, l_suppkey, l_extendedprice,
                l_quantity, l_discount, l_tax, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_partkey
                ORDER BY l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS pick
              FROM lineitem) k JOIN requests r ON r.request_id = k.request_id WHERE pick = 1""",
    "exposures": f"""SELECT request_id, user_id, item_id, position, feed_type,
        ({_SOURCES})[CAST(l_suppkey % 7 AS INTEGER) + 1] AS source, created_ms FROM served_lines""",
    "behaviour": _EVENTS,
    "clickstream": """SELECT * FROM (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, user_id,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
        CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'like'
            WHEN 'error' THEN 'not_interested' END AS event_type,
        CAST(floor(value * 1000) AS BIGINT) AS dwell_ms FROM events) WHERE event_type IS NOT NULL""",
    "candidates": f"""SELECT o_custkey AS user_id, l_partkey AS item_id,
        ({_SOURCES})[CAST(l_suppkey % 7 AS INTEGER) + 1] AS source,
        round(max(l_extendedprice) / 50000 - 0.2, 6) AS raw_score, round(1.0::DOUBLE - max(l_discount) * 4, 6) AS confidence,
        count(*) AS support, max(l_returnflag) <> 'N' AS eligible, any_value(is_cold) AS is_cold
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN items ON items.item_id = l_partkey
        GROUP BY o_custkey, l_partkey, l_suppkey % 7""",
    "split_cuts": """SELECT max(CASE WHEN rn = ceil(0.8 * n) THEN ts_ms END) AS c1,
        max(CASE WHEN rn = ceil(0.9 * n) THEN ts_ms END) AS c2, min(ts_ms) AS lo, max(ts_ms) AS hi, max(n) AS n
        FROM (SELECT ts_ms, row_number() OVER (ORDER BY ts_ms) AS rn, count(*) OVER () AS n FROM interactions)""",
    "split_rows": """SELECT user_id, item_id, ts_ms, CASE WHEN ts_ms <= c1 THEN 'train' WHEN ts_ms <= c2
        THEN 'validation' ELSE 'test' END AS split FROM interactions, split_cuts""",
    "train_pairs": "SELECT DISTINCT user_id, item_id FROM split_rows WHERE split = 'train'",
}
