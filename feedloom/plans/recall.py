"""Candidate generation: content, co-occurrence, factors and vectors."""

from pyspark.sql import functions as F

from ..operators import behaviour as B
from ..operators import content, factors, item_cf, vectors
from ..session import materialise
from .behaviour import STATE
from .data import split_rows, train_cut
from .registry import query

R = 6

TFIDF = r"""tt AS (SELECT item_id, regexp_replace(lower(title), '\s\s+', ' ', 'g') AS x FROM items WHERE length(title) > 0),
    tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, substr(x, s, w) AS term FROM
        (SELECT item_id, x, w, unnest(range(1, length(x) - w + 2)) AS s FROM tt, (VALUES (2), (3), (4)) v(w))) GROUP BY item_id, term),
    vis AS (SELECT DISTINCT item_id FROM train_pairs),
    voc0 AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf WHERE item_id IN (SELECT item_id FROM vis) GROUP BY term
        HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 8192),
    voc AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, ln((1.0 + (SELECT count(*) FROM vis)) / (1.0 + df)) + 1 AS idf FROM voc0),
    iw AS (SELECT item_id, term_id, (1 + ln(tf)) * idf AS w FROM tf JOIN voc USING (term)),
    iv AS (SELECT item_id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM iw)"""


def train_rows(t):
    return t.interactions.filter(F.col("ts_ms") <= train_cut(t))


def tfidf(t):
    terms = content.title_terms(t.items)
    vocab = content.vocabulary(terms, t.items, train_rows(t))
    return vocab, content.item_vectors(terms, vocab)


@query("title_vocabulary", TFIDF + " SELECT term, term_id, df, round(idf, 6) AS idf FROM voc")
def _(t):
    return tfidf(t)[0].withColumn("term_id", F.col("term_id").cast("bigint")).withColumn("idf", F.round("idf", R))


@query("title_tfidf", TFIDF + " SELECT item_id, term_id, round(w, 6) AS w FROM iv")
def _(t):
    long_form = content.unpack_vectors(tfidf(t)[1], "item_id")
    return long_form.select("item_id", F.col("term_id").cast("bigint").alias("term_id"), F.round("w", R).alias("w"))


PROFILE = TFIDF + """, pw AS (SELECT user_id, term_id, sum(w) AS w FROM train_pairs JOIN iv USING (item_id) GROUP BY user_id, term_id),
    pv AS (SELECT user_id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY user_id)) AS w FROM pw)"""


def titles(t):
    """The vocabulary and the title vectors, written once for the steps that share them."""
    terms = content.title_terms(t.items)
    vocab = materialise(content.vocabulary(terms, t.items, train_rows(t)))
    return vocab, materialise(content.item_vectors(terms, vocab))


def profiles(t, item_vectors, vocab=None):
    weights = content.pair_weights(t.interactions, None, train_cut(t))
    return content.content_profiles(weights, item_vectors, vocab)


@query(
    "content_profile",
    PROFILE + " SELECT user_id, count(*) AS terms, round(max(w), 6) AS heaviest, round(sum(w), 6) AS mass FROM pv GROUP BY user_id",
)
def _(t):
    vocab, vectors_ = titles(t)
    rows = profiles(t, vectors_, vocab)
    return rows.select(
        "user_id", F.size("terms").cast("bigint").alias("terms"), F.round(F.array_max("weights"), R).alias("heaviest"),
        F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), R).alias("mass"),
    )


@query(
    "content_recall",
    PROFILE + """, sc AS (SELECT user_id, item_id, sum(pv.w * iv.w) AS s FROM pv JOIN iv USING (term_id) GROUP BY user_id, item_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) - 1 AS rank FROM sc WHERE round(s, 9) > 0)
    SELECT user_id, item_id, rank, round(s, 6) AS raw_score, CASE WHEN item_id IN (SELECT item_id FROM vis) THEN 0 ELSE 1 END AS is_cold
    FROM rk WHERE rank < 150""",
)
def _(t):
    vocab, vectors_ = titles(t)
    best = vectors.top_items_per_user(profiles(t, vectors_, vocab), vectors_, 150, width=8192, floor=0.0)
    seen = train_rows(t).select("item_id").distinct().withColumn("warm", F.lit(True))
    return best.join(seen, "item_id", "left").select(
        "user_id", "item_id", F.col("rank").cast("bigint").alias("rank"), F.round("raw_score", R).alias("raw_score"),
        F.col("warm").isNull().cast("int").alias("is_cold"),
    )


@query(
    "content_profile_feedback",
    STATE + ", " + TFIDF + """, pw AS (SELECT user_id, term_id, sum(w) AS w FROM train_pairs JOIN iv USING (item_id) GROUP BY user_id, term_id),
    pv AS (SELECT user_id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY user_id)) AS w FROM pw),
    lk AS (SELECT user_id, term_id, least(4, affinity) * w AS w FROM state JOIN iv USING (item_id) WHERE affinity > 0 AND not_interested = 0),
    bo AS (SELECT user_id, term_id, sum(w) AS w FROM (SELECT * FROM pv UNION ALL SELECT * FROM lk) GROUP BY user_id, term_id),
    sv AS (SELECT user_id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY user_id)) AS w FROM bo)
    SELECT user_id, count(*) AS terms, round(sum(w), 6) AS mass FROM sv GROUP BY user_id""",
)
def _(t):
    vocab, vectors_ = titles(t)
    rows = content.serving_profiles(profiles(t, vectors_, vocab), B.user_item_state(t.behaviour), vectors_, vocab)
    return rows.select(
        "user_id", F.size("terms").cast("bigint").alias("terms"),
        F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), R).alias("mass"),
    )


_CO = """sup AS (SELECT item_id, count(*) AS s FROM train_pairs GROUP BY item_id),
    co AS (SELECT a.item_id AS item_i, b.item_id AS item_j, count(*) AS support FROM train_pairs a JOIN train_pairs b
        ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY a.item_id, b.item_id HAVING count(*) >= 2)"""
NEIGHBORS = _CO + """, sym AS (SELECT item_i AS item_id, item_j AS neighbor_id, support FROM co UNION ALL SELECT item_j, item_i, support FROM co),
    nb0 AS (SELECT sym.*, support / sqrt(a.s * b.s) AS score FROM sym JOIN sup a ON a.item_id = sym.item_id JOIN sup b ON b.item_id = sym.neighbor_id),
    nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, neighbor_id) - 1 AS rank FROM nb0) WHERE rank < 50)"""


@query("cooccurrence", _CO + " SELECT item_i, item_j, support FROM co")
def _(t):
    return item_cf.cooccurrence(train_rows(t))


@query("item_cf_neighbors", NEIGHBORS + " SELECT item_id, neighbor_id, support, rank, round(score, 6) AS score FROM nb")
def _(t):
    return item_cf.item_neighbors(t.interactions, train_cut(t)).select(
        "item_id", "neighbor_id", "support", F.col("rank").cast("bigint").alias("rank"), F.round("score", R).alias("score")
    )


@query(
    "cf_recall",
    NEIGHBORS + """, sc AS (SELECT user_id, neighbor_id AS item_id, sum(score) AS s, count(*) AS support FROM train_pairs JOIN nb USING (item_id)
        GROUP BY user_id, neighbor_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) - 1 AS rank FROM sc WHERE s > 0)
    SELECT user_id, item_id, rank, support, round(s, 6) AS raw_score FROM rk WHERE rank < 100""",
)
def _(t):
    neighbors = item_cf.item_neighbors(t.interactions, train_cut(t))
    return item_cf.cf_recall(item_cf.cf_weights(train_rows(t)), neighbors, 100).select(
        "user_id", "item_id", F.col("rank").cast("bigint").alias("rank"), "support", F.round("raw_score", R).alias("raw_score")
    )


@query(
    "cf_weights",
    STATE + """, lk AS (SELECT user_id, item_id, affinity FROM state WHERE affinity > 0 AND not_interested = 0)
    SELECT coalesce(p.user_id, l.user_id) AS user_id, coalesce(p.item_id, l.item_id) AS item_id,
        CAST(CASE WHEN affinity IS NULL THEN 1 ELSE least(4, CASE WHEN p.user_id IS NULL THEN 0 ELSE 1 END + affinity) END AS DOUBLE) AS w
    FROM train_pairs p FULL OUTER JOIN lk l ON l.user_id = p.user_id AND l.item_id = p.item_id""",
)
def _(t):
    return item_cf.cf_weights(train_rows(t), B.user_item_state(t.behaviour))


VISUAL = """vx AS (SELECT vec_id AS item_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
    vp0 AS (SELECT user_id, pos, sum(x) AS x FROM (SELECT user_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos
        FROM train_pairs JOIN vx USING (item_id)) GROUP BY user_id, pos),
    vp AS (SELECT user_id, list(x ORDER BY pos) AS p FROM vp0 GROUP BY user_id),
    vu AS (SELECT user_id, [x / greatest(sqrt(list_dot_product(p, p)), 1e-8) FOR x IN p] AS u FROM vp)"""


def visual_profiles(t):
    return vectors.vector_profiles(train_rows(t), vectors.usable(t.visual_vectors))


def visual_items(t):
    return vectors.usable(t.visual_vectors).select("item_id", F.col("embedding").cast("array<double>").alias("weights"))


@query("visual_profile", VISUAL + " SELECT user_id, round(list_sum(u), 6) AS mass, round(u[1], 6) AS first, round(list_max(u), 6) AS top FROM vu")
def _(t):
    return visual_profiles(t).select(
        "user_id", F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), R).alias("mass"),
        F.round(F.col("weights")[0], R).alias("first"), F.round(F.array_max("weights"), R).alias("top"),
    )


@query(
    "visual_recall",
    VISUAL + """, sc AS (SELECT user_id, item_id, list_dot_product(u, v) AS s FROM vu, vx),
    rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) - 1 AS rank FROM sc)
    SELECT user_id, item_id, rank, round(s, 6) AS raw_score FROM rk WHERE rank < 150""",
)
def _(t):
    return vectors.top_items_per_user(visual_profiles(t), visual_items(t), 150).select(
        "user_id", "item_id", F.col("rank").cast("bigint").alias("rank"), F.round("raw_score", R).alias("raw_score")
    )


@query(
    "vector_recall",
    STATE + ", " + VISUAL + """, lk AS (SELECT user_id, item_id, least(4, affinity) AS w FROM state WHERE affinity > 0 AND not_interested = 0),
    fm0 AS (SELECT user_id, pos, sum(w * x) / sum(w) AS x FROM (SELECT user_id, w, unnest(v) AS x, generate_subscripts(v, 1) AS pos
        FROM lk JOIN vx USING (item_id)) GROUP BY user_id, pos),
    fm AS (SELECT user_id, list(x ORDER BY pos) AS f FROM fm0 GROUP BY user_id),
    mv AS (SELECT user_id, CASE WHEN f IS NULL THEN u ELSE [z[1] + 0.2::DOUBLE * z[2] FOR z IN list_transform(range(1, len(u) + 1), lambda i: [u[i], f[i]])] END AS m,
        f IS NULL AS same FROM vu LEFT JOIN fm USING (user_id)),
    nu AS (SELECT user_id, CASE WHEN same THEN m ELSE [x / greatest(sqrt(list_dot_product(m, m)), 1e-8) FOR x IN m] END AS u FROM mv),
    sc AS (SELECT user_id, item_id, list_dot_product(u, v) AS s FROM nu, vx),
    rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) - 1 AS rank FROM sc)
    SELECT user_id, item_id, rank, round(s, 6) AS raw_score FROM rk WHERE rank < 200""",
)
def _(t):
    users = vectors.feedback_embeddings(
        visual_profiles(t), B.user_item_state(t.behaviour), vectors.usable(t.visual_vectors)
    )
    return vectors.top_items_per_user(users, visual_items(t), 200).select(
        "user_id", "item_id", F.col("rank").cast("bigint").alias("rank"), F.round("raw_score", R).alias("raw_score")
    )


def svd(t, rank=32):
    pairs = train_rows(t).select("user_id", "item_id").distinct().withColumn("weight", F.lit(1.0))
    return factors.svd_factors(pairs, rank)


@query("svd_factors")
def _(t):
    users, items = svd(t)
    return users.select(F.lit("user").alias("side"), F.col("user_id").alias("id"), "weights").unionByName(
        items.select(F.lit("item").alias("side"), F.col("item_id").alias("id"), "weights")
    )


@query("observed_mse")
def _(t):
    users, items = svd(t)
    return factors.observed_error(train_rows(t).select("user_id", "item_id").distinct(), users, items)


@query("svd_recall")
def _(t):
    users, items = svd(t)
    return factors.svd_recall(users, items, B.user_item_state(t.behaviour), 150)


@query("pca_embeddings")
def _(t):
    return factors.pca_embeddings(t.visual_vectors, train_rows(t), 16)


@query("content_reduction")
def _(t):
    long_form = content.unpack_vectors(tfidf(t)[1], "item_id")
    return factors.reduced_content(long_form, train_rows(t), 32)


@query(
    "cold_coverage",
    TFIDF + """, cold AS (SELECT i.item_id FROM items i WHERE is_cold)
    SELECT count(*) AS targets, count(v.item_id) AS covered, round(coalesce(count(v.item_id) / CAST(count(*) AS DOUBLE), 0), 6) AS coverage
    FROM (SELECT s.item_id FROM split_rows s JOIN cold USING (item_id) WHERE split = 'test') x
    LEFT JOIN (SELECT DISTINCT item_id FROM iv) v USING (item_id)""",
)
def _(t):
    # cold items are the flagged part of the catalog; the rest counts as trained on
    targets = split_rows(t).filter(F.col("split") == "test")
    known = t.items.filter(~F.col("is_cold"))
    return content.cold_coverage(targets.select("item_id"), known, tfidf(t)[1]).withColumn("coverage", F.round("coverage", R))
