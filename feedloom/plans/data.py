"""Splits, ingest checks and popularity."""

from pyspark.sql import functions as F

from ..operators import popularity, split
from ..session import materialise
from .registry import query

R = 6


def cutoffs(t):
    return split.time_cutoffs(t.interactions)


def borders(t):
    """Both borders as numbers, computed once per data set."""
    if "borders" not in t.memo:
        t.memo["borders"] = cutoffs(t).first()
    return t.memo["borders"]


def split_rows(t):
    return split.time_split(t.interactions, borders(t).train_cutoff, borders(t).validation_cutoff)


def prepared(t):
    """The split table as later jobs read it: written once per data set."""
    if "prepared" not in t.memo:
        t.memo["prepared"] = materialise(split_rows(t))
    return t.memo["prepared"]


def train_events(t):
    return t.interactions.withColumn("weight", F.lit(1.0))


def train_cut(t):
    return F.lit(borders(t).train_cutoff)


@query("time_cutoffs", "SELECT n, lo AS first_ms, c1 AS train_cutoff, c2 AS validation_cutoff, hi AS last_ms FROM split_cuts")
def _(t):
    return cutoffs(t)


@query("split_counts", "SELECT split, count(*) AS n FROM split_rows GROUP BY split")
def _(t):
    return split_rows(t).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_summary",
    """s AS (SELECT split, count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items,
        min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM split_rows GROUP BY split)
    SELECT split, rows, users, items, first_ms, last_ms, CASE WHEN split = 'train' THEN 1
        ELSE CAST(first_ms > (SELECT max(last_ms) FROM s p WHERE p.last_ms < s.last_ms) AS INTEGER) END AS leak_free FROM s""",
)
def _(t):
    return split.split_summary(split_rows(t)).select(
        "split", "rows", "users", "items", "first_ms", "last_ms", F.col("leak_free").cast("int").alias("leak_free")
    )


@query(
    "floor_distribution",
    """c AS (SELECT user_id, count(*) AS c FROM interactions GROUP BY user_id),
    r AS (SELECT c, row_number() OVER (ORDER BY c) AS rn, count(*) OVER () AS n FROM c)
    SELECT max(n) AS users, CAST(min(c) AS DOUBLE) AS min,
        CAST(max(CASE WHEN rn = floor(0.5 * (n - 1)) + 1 THEN c END) AS DOUBLE) AS p50,
        CAST(max(CASE WHEN rn = floor(0.95 * (n - 1)) + 1 THEN c END) AS DOUBLE) AS p95,
        CAST(max(c) AS DOUBLE) AS max, round(avg(c), 6) AS mean FROM r""",
)
def _(t):
    return split.user_activity_distribution(t.interactions).withColumn("mean", F.round("mean", R))


@query(
    "duplicate_counts",
    """SELECT CAST((SELECT count(*) FROM interactions) AS BIGINT) AS rows,
        (SELECT count(*) FROM interactions) - (SELECT count(*) FROM (SELECT DISTINCT * FROM interactions)) AS duplicate_rows,
        (SELECT count(*) FROM interactions) - (SELECT count(*) FROM (SELECT DISTINCT user_id, item_id FROM interactions))
            AS duplicate_pairs""",
)
def _(t):
    return split.duplicate_counts(t.interactions)


@query(
    "item_set_diff",
    """l AS (SELECT DISTINCT l_partkey AS item_id FROM lineitem), r AS (SELECT DISTINCT vec_id AS item_id FROM embeddings),
    d AS (SELECT 'left_only' AS side, item_id FROM l WHERE item_id NOT IN (SELECT item_id FROM r)
        UNION ALL SELECT 'right_only', item_id FROM r WHERE item_id NOT IN (SELECT item_id FROM l)),
    n AS (SELECT side, item_id, row_number() OVER (PARTITION BY side ORDER BY item_id) - 1 AS rank,
        count(*) OVER (PARTITION BY side) AS total FROM d)
    SELECT side, item_id, rank, total FROM n WHERE rank < 10""",
)
def _(t):
    lines = t.raw("lineitem").select(F.col("l_partkey").alias("item_id"))
    return split.item_set_difference(lines, t.visual_vectors).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "user_histories",
    """SELECT u.user_id, coalesce(string_agg(item_id, ',' ORDER BY ts_ms, item_id), '') AS item_ids,
        coalesce(string_agg(ts_ms, ',' ORDER BY ts_ms, item_id), '') AS timestamps_ms
    FROM (SELECT DISTINCT user_id FROM split_rows) u
    LEFT JOIN (SELECT * FROM split_rows WHERE split = 'train') s ON s.user_id = u.user_id GROUP BY u.user_id""",
)
def _(t):
    return split.user_histories(split_rows(t)).select(
        "user_id", F.array_join("item_ids", ",").alias("item_ids"), F.array_join("timestamps_ms", ",").alias("timestamps_ms")
    )


@query(
    "select_users",
    """u AS (SELECT DISTINCT user_id FROM interactions),
    f AS (SELECT DISTINCT user_id FROM behaviour WHERE event_type = 'share')
    SELECT user_id FROM u ORDER BY CASE WHEN user_id IN (SELECT user_id FROM f) THEN 0 ELSE 1 END,
        sha256('42:train-users:' || user_id), user_id LIMIT 500""",
)
def _(t):
    shared = t.behaviour.filter(F.col("event_type") == "share")
    return split.select_users(t.interactions, 42, "train-users", 500, always=shared)


@query(
    "interaction_matrix",
    """f AS (SELECT user_id, item_id, received_ms AS ts_ms, CASE event_type WHEN 'click' THEN 1.0 WHEN 'like' THEN 3.0
        WHEN 'share' THEN 4.0 WHEN 'not_interested' THEN -2.0 WHEN 'dwell' THEN 1.5 ELSE 0.0 END AS weight FROM behaviour),
    a AS (SELECT user_id, item_id, 1.0 AS weight FROM train_pairs UNION ALL
        SELECT user_id, item_id, weight FROM f, split_cuts WHERE ts_ms <= c1)
    SELECT user_id, item_id, CAST(sum(weight) AS DOUBLE) AS weight FROM a GROUP BY user_id, item_id""",
)
def _(t):
    kinds = {"click": 1.0, "like": 3.0, "share": 4.0, "not_interested": -2.0, "dwell": 1.5}
    weight = F.lit(0.0)
    for kind, value in kinds.items():
        weight = F.when(F.col("event_type") == kind, value).otherwise(weight)
    feedback = t.behaviour.select("user_id", "item_id", F.col("received_ms").alias("ts_ms"), weight.alias("weight"))
    return split.interaction_matrix(t.interactions, feedback, train_cut(t))


_POP = """pop AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS cumulative,
        CAST(count(*) FILTER (age <= 86400000) AS DOUBLE) AS d1, CAST(count(*) FILTER (age <= 604800000) AS DOUBLE) AS d7,
        CAST(count(*) FILTER (age <= 2592000000) AS DOUBLE) AS d30, sum(exp(-ln(2) * age / 604800000.0)) AS decay
    FROM (SELECT item_id, c1 - ts_ms AS age FROM interactions, split_cuts WHERE ts_ms <= c1) GROUP BY item_id)"""


@query(
    "popularity_features",
    _POP + """ SELECT item_id, cumulative, d1, d7, d30, round(decay, 6) AS decay, round(d1 - (d7 - d1) / 6, 6) AS growth FROM pop""",
)
def _(t):
    features = popularity.popularity_features(train_events(t), train_cut(t))
    return features.select(
        "item_id", "cumulative", "d1", "d7", "d30", F.round("decay", R).alias("decay"), F.round("growth", R).alias("growth")
    )


@query(
    "popularity_topk",
    _POP + """ SELECT item_id, round(decay + 1e-6 * cumulative, 6) AS score FROM pop
    ORDER BY round(decay + 1e-6 * cumulative, 9) DESC, CAST(item_id AS VARCHAR) LIMIT 20""",
)
def popularity_topk(t):
    features = popularity.popularity_features(train_events(t), train_cut(t))
    return popularity.popular_items(features, 20).select("item_id", F.round("score", R).alias("score"))


@query(
    "popular_fallback",
    """lim AS (SELECT max(received_ms) AS now FROM behaviour),
    e AS (SELECT item_id, now - received_ms AS age FROM behaviour, lim WHERE event_type = 'impression'
        AND received_ms >= 852076800000 AND received_ms <= now),
    f AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS cumulative, sum(exp(-ln(2) * age / 604800000.0)) AS decay FROM e GROUP BY item_id),
    i AS (SELECT p_partkey AS item_id, ln(1 + floor(p_retailprice)) + 2 * ln(1 + p_size) AS pop,
        CASE WHEN p_size % 3 = 0 THEN NULL ELSE 's' || (p_size % 3) END AS version,
        CASE WHEN p_size % 4 = 0 THEN NULL ELSE 915148800000 + p_size END AS seen_at FROM part WHERE p_size <> 7),
    s AS (SELECT i.item_id, coalesce(cumulative, 0) AS cumulative, coalesce(decay, 0) + 1e-6 * coalesce(cumulative, 0)
        + 1e-9 * CASE WHEN version = 's1' AND seen_at IS NOT NULL THEN pop ELSE 0 END AS score FROM i LEFT JOIN f ON f.item_id = i.item_id)
    SELECT item_id, round(score, 6) AS score, CASE WHEN score > 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS confidence,
        CAST(floor(cumulative) AS BIGINT) AS support FROM s ORDER BY round(score, 9) DESC, CAST(item_id AS VARCHAR) LIMIT 100""",
)
def _(t):
    now = t.behaviour.agg(F.max("received_ms")).first()[0]
    size = F.col("p_size")
    items = t.raw("part").select(
        F.col("p_partkey").alias("item_id"),
        F.when(size == 7, "offline").otherwise("online").alias("status"),
        (F.log1p(F.floor("p_retailprice").cast("double")) + 2 * F.log1p(size.cast("double"))).alias("popularity_score"),
        F.when(size % 3 != 0, F.concat(F.lit("s"), (size % 3).cast("string"))).alias("stats_version"),
        F.when(size % 4 != 0, F.lit(915148800000) + size).alias("stats_available_at"),
    )
    known = items.filter(F.col("stats_version") == "s1").select("stats_version", "stats_available_at")
    top = popularity.fallback_popular(items, known, t.behaviour, 852076800000, now, 100)
    return top.withColumn("score", F.round("score", R))


@query(
    "explore_recall",
    """c AS (SELECT i.item_id, count(e.request_id) AS cnt FROM items i LEFT JOIN exposures e ON e.item_id = i.item_id
        WHERE i.status = 'online' GROUP BY i.item_id),
    pool AS (SELECT * FROM c ORDER BY cnt, CAST(item_id AS VARCHAR) LIMIT 40),
    s AS (SELECT c_custkey AS user_id, item_id, cnt, 1.0::DOUBLE / (1 + cnt) + 0.01::DOUBLE *
        (('0x' || substr(sha256('7:' || c_custkey || ':' || item_id), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE) AS score
        FROM customer, pool),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, CAST(item_id AS VARCHAR)) - 1 AS rank FROM s)
    SELECT user_id, item_id, rank, cnt AS support, round(score, 6) AS raw_score FROM r WHERE rank < 20""",
)
def _(t):
    counts = popularity.exposure_counts(t.items, t.exposures)
    return popularity.explore_recall(t.users, counts, 7, 20).select(
        "user_id", "item_id", F.col("rank").cast("bigint").alias("rank"), "support", F.round("raw_score", R).alias("raw_score")
    )


@query(
    "least_exposed",
    """SELECT i.item_id, count(e.request_id) AS exposure_count FROM items i LEFT JOIN exposures e ON e.item_id = i.item_id
    WHERE i.status = 'online' GROUP BY i.item_id""",
)
def _(t):
    return popularity.exposure_counts(t.items, t.exposures)


@query(
    "popular_recall",
    _POP + """, top AS (SELECT item_id, cumulative, decay + 1e-6 * cumulative AS score FROM pop
        ORDER BY round(decay + 1e-6 * cumulative, 9) DESC, CAST(item_id AS VARCHAR) LIMIT 50)
    SELECT c_custkey AS user_id, item_id, round(score, 6) AS raw_score, CAST(floor(cumulative) AS BIGINT) AS support FROM customer, top""",
)
def _(t):
    features = popularity.popularity_features(train_events(t), train_cut(t))
    return popularity.popular_recall(t.users, features, 50).withColumn("raw_score", F.round("raw_score", R))


def digest_sql(name, source, columns):
    """Common table expressions that end in ``name`` (rows, digest): the SQL of ``content_digest``."""
    row = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in columns)
    sums = ", ".join(f"sum(('0x' || substr(h, {4 + 8 * i}, 8))::UBIGINT) AS s{i}" for i in range(4))
    return f"""{name}_h AS (SELECT sha256(concat_ws('|', {row})) AS h FROM {source}),
    {name}_f AS (SELECT substr(h, 1, 3) AS p, count(*) AS c, {sums} FROM {name}_h GROUP BY 1),
    {name} AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS rows, sha256(coalesce(string_agg(concat_ws(':', p, c, s0, s1, s2, s3), '|' ORDER BY p), '')) AS digest FROM {name}_f)"""


_VERSIONED = {"interactions": ["user_id", "item_id", "ts_ms"], "items": ["item_id", "title", "likes", "views"]}


@query(
    "data_version",
    ", ".join(digest_sql(f"v_{n}", n, c) for n, c in _VERSIONED.items())
    + """ SELECT substr(sha256('interactions=' || v_interactions.digest || ';items=' || v_items.digest || '|42|time-80-10-10|v1'), 1, 16) AS data_version
    FROM v_interactions, v_items""",
)
def _(t):
    parts = {"interactions": t.interactions.select(*_VERSIONED["interactions"]), "items": t.items.select(*_VERSIONED["items"])}
    return split.data_version(parts, 42, "time-80-10-10", "v1")
