"""Evaluation queries, metrics and the choices based on them."""

from pyspark.sql import functions as F

from ..operators import content, evaluation as E
from ..operators import item_cf, popularity, vectors
from ..session import materialise
from .data import _POP, borders, prepared, train_cut, train_events
from .recall import NEIGHBORS, PROFILE, profiles, svd, titles, train_rows
from .registry import query

R = 6
SEED = 42


def rounded(df, *names):
    for name in names:
        df = df.withColumn(name, F.round(name, R))
    return df


def unit_sql(*parts: str) -> str:
    key = " || ':' || ".join(parts)
    return f"(('0x' || substr(sha256({key}), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE)"


def queries_sql(split: str, universe: str, known: str, purpose: str, name: str = "qs") -> str:
    """CTEs building a query set called ``name``; the universe is a relation of item_id."""
    return f"""uni_{name} AS ({universe}),
    ix_{name} AS (SELECT item_id, row_number() OVER (ORDER BY item_id % 1024, item_id) - 1 AS i, count(*) OVER () AS n FROM uni_{name}),
    mu_{name} AS (SELECT list(c ORDER BY c) AS m FROM (SELECT c FROM (SELECT unnest(range(greatest(1, CAST(floor(0.382::DOUBLE * n) AS BIGINT)),
        greatest(1, CAST(floor(0.382::DOUBLE * n) AS BIGINT)) + 4096)) AS c, n FROM (SELECT max(n) AS n FROM ix_{name})) WHERE gcd(c, n) = 1 ORDER BY c LIMIT 64)),
    pos_{name} AS (SELECT DISTINCT user_id, item_id FROM split_rows WHERE split = '{split}' AND item_id IN (SELECT item_id FROM uni_{name})
        AND user_id IN (SELECT user_id FROM train_pairs)),
    exc_{name} AS (SELECT DISTINCT user_id, item_id FROM split_rows WHERE split IN ({known}) AND item_id IN (SELECT item_id FROM uni_{name})
        AND user_id IN (SELECT user_id FROM pos_{name})),
    h_{name} AS (SELECT user_id, count(*) AS h FROM exc_{name} GROUP BY user_id HAVING (SELECT max(n) FROM ix_{name}) - count(*) >= 100),
    st_{name} AS (SELECT user_id, h, n, m[CAST(floor({unit_sql("'42:" + purpose + ":step'", "user_id")} * len(m)) AS BIGINT) + 1] AS step,
        CAST(floor({unit_sql("'42:" + purpose + ":start'", "user_id")} * n) AS BIGINT) AS start
        FROM h_{name}, (SELECT max(n) AS n FROM ix_{name}), mu_{name}),
    dr_{name} AS (SELECT user_id, j, (step * j + start) % n AS i FROM (SELECT *, unnest(range(0, least(100 + h, n))) AS j FROM st_{name})),
    al_{name} AS (SELECT d.user_id, x.item_id, row_number() OVER (PARTITION BY d.user_id ORDER BY j) AS pick FROM dr_{name} d
        JOIN ix_{name} x ON x.i = d.i ANTI JOIN exc_{name} e ON e.user_id = d.user_id AND e.item_id = x.item_id),
    {name} AS (SELECT user_id, item_id, 1 AS label FROM pos_{name} WHERE user_id IN (SELECT user_id FROM h_{name})
        UNION ALL SELECT user_id, item_id, 0 FROM al_{name} WHERE pick <= 100)"""


WARM = queries_sql("validation", "SELECT DISTINCT item_id FROM train_pairs", "'train', 'validation'", "validation")
ALL = queries_sql("validation", "SELECT item_id FROM items", "'train', 'validation'", "full-validation")


def parts(t):
    rows = prepared(t)
    known = rows.filter(F.col("split") != "test")
    return rows.filter(F.col("split") == "validation"), known, rows.filter(F.col("split") == "train")


def warm_queries(t):
    targets, known, train = parts(t)
    return E.eval_queries(targets, known, train, train, purpose="validation", seed=SEED)


def all_queries(t):
    targets, known, train = parts(t)
    return E.eval_queries(targets, known, train, t.items, purpose="full-validation", seed=SEED)


@query("eval_queries_warm", WARM + " SELECT user_id, item_id, CAST(label AS BIGINT) AS label FROM qs")
def _(t):
    return warm_queries(t).withColumn("label", F.col("label").cast("bigint"))


@query("eval_queries_all", ALL + " SELECT user_id, item_id, CAST(label AS BIGINT) AS label FROM qs")
def _(t):
    return all_queries(t).withColumn("label", F.col("label").cast("bigint"))


@query("sample_negatives", ALL + " SELECT user_id, count(*) AS n, CAST(sum(item_id) AS BIGINT) AS total FROM qs WHERE label = 0 GROUP BY user_id")
def _(t):
    return all_queries(t).filter(F.col("label") == 0).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("item_id").alias("total")
    )


@query(
    "eval_queries_catalog",
    """p AS (SELECT DISTINCT user_id, item_id FROM split_rows WHERE split = 'test'),
    x AS (SELECT DISTINCT user_id, item_id FROM split_rows WHERE user_id IN (SELECT user_id FROM p) EXCEPT SELECT user_id, item_id FROM p)
    SELECT 'positive' AS kind, user_id, count(*) AS n, CAST(sum(item_id) AS BIGINT) AS total FROM p GROUP BY user_id
    UNION ALL SELECT 'excluded', user_id, count(*), CAST(sum(item_id) AS BIGINT) FROM x GROUP BY user_id""",
)
def _(t):
    rows = prepared(t)
    positives, excluded = E.catalog_queries(rows.filter(F.col("split") == "test"), rows, t.items)
    both = positives.withColumn("kind", F.lit("positive")).unionByName(excluded.withColumn("kind", F.lit("excluded")))
    return both.groupBy("kind", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("item_id").alias("total"))


@query(
    "cohort_stats",
    WARM + """, pr AS (SELECT DISTINCT user_id, item_id FROM split_rows WHERE split = 'validation' AND user_id IN (SELECT user_id FROM train_pairs))
    SELECT (SELECT count(*) FROM pr) AS target_positives, (SELECT count(*) FROM pos_qs) AS scorable_positives,
        (SELECT count(DISTINCT user_id) FROM pos_qs) AS users_with_positives, (SELECT count(*) FROM h_qs) AS eligible_users,
        (SELECT count(DISTINCT user_id) FROM qs) AS evaluated_users,
        round((SELECT count(*) FROM pos_qs) / CAST((SELECT count(*) FROM pr) AS DOUBLE), 6) AS item_coverage""",
)
def _(t):
    targets, known, train = parts(t)
    return rounded(E.cohort_stats(targets, known, train, train, warm_queries(t)), "item_coverage")


def metrics_sql(scored: str, keys: str = "") -> str:
    """Metrics over a relation with user_id, item_id, label, score and optional key columns."""
    k = keys + ", " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY {k}user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM {scored}),
    pq AS (SELECT {k}user_id, count(*) FILTER (label = 1 AND rank <= 10) AS hits, sum(label) AS positives,
        coalesce(sum(1 / log2(rank + 1)) FILTER (label = 1 AND rank <= 10), 0) AS gain FROM rk GROUP BY {k}user_id HAVING sum(label) > 0),
    id AS (SELECT n, (SELECT sum(1 / log2(r + 1)) FROM range(1, 11) t(r) WHERE r <= n) AS best FROM range(1, 11) s(n)),
    mt AS (SELECT {k}count(*) AS queries, CAST(sum(positives) AS BIGINT) AS positives, round(avg(hits / CAST(positives AS DOUBLE)), 6) AS recall,
        round(avg(gain / best), 6) AS ndcg, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hitrate
        FROM pq JOIN id ON id.n = least(positives, 10){group})"""


_POPSCORED = _POP + ", sq AS (SELECT qs.*, coalesce(decay + 1e-6 * cumulative, 0) AS score, cumulative FROM qs LEFT JOIN pop USING (item_id))"


def popular_scored(t, queries):
    features = popularity.popularity_features(train_events(t), train_cut(t))
    scores = features.select("item_id", popularity.popularity_score().alias("score"))
    return queries.join(scores, "item_id", "left").na.fill(0.0, ["score"])


METRICS = ("recall", "ndcg", "hitrate")


@query("ranking_metrics", ALL + ", " + _POPSCORED + ", " + metrics_sql("sq") + " SELECT * FROM mt")
def _(t):
    return rounded(E.ranking_metrics(popular_scored(t, all_queries(t))), *METRICS)


@query(
    "bucket_metrics",
    ALL + ", " + _POPSCORED + """, bk AS (SELECT unnest(['cold', 'tail_1', 'tail_2_4', 'head_5_plus']) AS bucket),
    sb AS (SELECT user_id, item_id, label, score, CASE WHEN cumulative IS NULL THEN 'cold' WHEN cumulative = 1 THEN 'tail_1'
        WHEN cumulative <= 4 THEN 'tail_2_4' ELSE 'head_5_plus' END AS bucket FROM sq WHERE label = 1
        UNION ALL SELECT user_id, item_id, label, score, bucket FROM sq, bk WHERE label = 0), """ + metrics_sql("sb", "bucket") + " SELECT * FROM mt",
)
def _(t):
    features = popularity.popularity_features(train_events(t), train_cut(t))
    return rounded(E.bucket_metrics(popular_scored(t, all_queries(t)), features, []), *METRICS)


_AN = "'{0}-' || substr(sha256('evaluation:{0}:' || {1}), 1, 10)"


@query(
    "badcases",
    ALL + ", " + _POPSCORED + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM sq),
    b AS (SELECT user_id, count(*) AS candidate_count, count(*) FILTER (label = 1) AS positive_count, min(rank) FILTER (label = 1) AS best,
        string_agg({_AN.format('i', 'item_id')}, ',' ORDER BY item_id) FILTER (label = 1) AS positive_item_ids,
        string_agg(rank, ',' ORDER BY item_id) FILTER (label = 1) AS positive_ranks FROM rk GROUP BY user_id
        HAVING max(rank) FILTER (label = 1) > 10 ORDER BY user_id LIMIT 5)
    SELECT {_AN.format('u', 'user_id')} AS user_id, candidate_count, positive_count, positive_item_ids, positive_ranks,
        CASE WHEN best > 10 THEN 'no_positive_in_top_k' ELSE 'some_positives_below_top_k' END AS reason FROM b""",
)
def _(t):
    cases = E.badcases(popular_scored(t, all_queries(t)))
    return cases.withColumn("positive_item_ids", F.array_join("positive_item_ids", ",")).withColumn(
        "positive_ranks", F.array_join("positive_ranks", ",")
    )


@query(
    "half_life_selection",
    ALL + """, hl AS (SELECT unnest([1.0::DOUBLE, 7.0::DOUBLE, 30.0::DOUBLE]) AS half_life),
    ph AS (SELECT item_id, half_life, sum(exp(-ln(2) * (c1 - ts_ms) / (half_life * 86400000))) + 1e-6 * count(*) AS score
        FROM interactions, split_cuts, hl WHERE ts_ms <= c1 GROUP BY item_id, half_life),
    sh AS (SELECT q.*, hl.half_life, coalesce(score, 0) AS score FROM qs q CROSS JOIN hl LEFT JOIN ph ON ph.item_id = q.item_id AND ph.half_life = hl.half_life), """
    + metrics_sql("sh", "half_life") + """
    SELECT *, CASE WHEN half_life = (SELECT half_life FROM mt ORDER BY ndcg DESC, recall DESC, half_life LIMIT 1) THEN 1 ELSE 0 END AS selected FROM mt""",
)
def _(t):
    scores = E.popularity_by_half_life(t.interactions, borders(t).train_cutoff)
    return rounded(E.half_life_selection(all_queries(t), scores), *METRICS)


@query("random_baseline", ALL + f", sq AS (SELECT qs.*, {unit_sql(chr(39) + '42' + chr(39), 'user_id', 'item_id')} AS score FROM qs), " + metrics_sql("sq") + " SELECT * FROM mt")
def _(t):
    return rounded(E.ranking_metrics(E.random_scores(all_queries(t), SEED)), *METRICS)


_SCORERS = ALL + ", " + _POP + ", " + NEIGHBORS + ", " + PROFILE + f""",
    cfs AS (SELECT q.user_id, q.item_id, sum(nb.score) AS score FROM qs q JOIN nb ON nb.neighbor_id = q.item_id
        JOIN train_pairs p ON p.user_id = q.user_id AND p.item_id = nb.item_id GROUP BY q.user_id, q.item_id),
    cts AS (SELECT q.user_id, q.item_id, sum(iv.w * pv.w) AS score FROM qs q JOIN iv ON iv.item_id = q.item_id
        JOIN pv ON pv.user_id = q.user_id AND pv.term_id = iv.term_id GROUP BY q.user_id, q.item_id),
    ls AS (SELECT qs.*, 'popular' AS scorer, coalesce(decay + 1e-6 * cumulative, 0) AS score FROM qs LEFT JOIN pop USING (item_id)
        UNION ALL SELECT qs.*, 'random', {unit_sql("'42'", 'user_id', 'item_id')} FROM qs
        UNION ALL SELECT qs.*, 'item_cf', coalesce(score, 0) FROM qs LEFT JOIN cfs USING (user_id, item_id)
        UNION ALL SELECT qs.*, 'content', coalesce(score, 0) FROM qs LEFT JOIN cts USING (user_id, item_id))"""


def content_scores(t, queries):
    """Profile times title vector for the queried pairs only."""
    vocab, item_vectors = titles(t)
    return content.pair_dots(queries, profiles(t, item_vectors, vocab), item_vectors, vocab)


def source_scores(t, queries):
    """One long table of all scorers that need no factorisation."""
    neighbors = item_cf.item_neighbors(t.interactions, train_cut(t))
    cf = item_cf.cf_scores(queries, item_cf.cf_weights(train_rows(t)), neighbors).select("user_id", "item_id", "score")
    scored = {
        "popular": popular_scored(t, queries),
        "random": E.random_scores(queries, SEED),
        "item_cf": queries.join(cf, ["user_id", "item_id"], "left").na.fill(0.0, ["score"]),
        "content": content_scores(t, queries),
    }
    names = ["user_id", "item_id", "label", "score"]
    stacked = None
    for scorer, rows in scored.items():
        part = rows.select(*names, F.lit(scorer).alias("scorer"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


@query("source_metrics", _SCORERS + ", " + metrics_sql("ls", "scorer") + " SELECT * FROM mt")
def _(t):
    """The scorers of ``evaluate_sources`` that SQL can follow."""
    return rounded(E.ranking_metrics(source_scores(t, materialise(all_queries(t))), ["scorer"]), *METRICS)


def three_scores(t, queries, model):
    """model, content and popular scores of the queried pairs; ``model``: user_id, item_id, model."""
    rows = popular_scored(t, content_scores(t, queries).withColumnRenamed("score", "content")).withColumnRenamed("score", "popular")
    return rows.join(model, ["user_id", "item_id"], "left")


_HYBRID = _SCORERS + """,
    hy AS (SELECT c.user_id, c.item_id, c.label, c.score AS content, p.score AS popular, CASE WHEN c.item_id IN (SELECT item_id FROM train_pairs) THEN m.score END AS model
        FROM (SELECT * FROM ls WHERE scorer = 'content') c JOIN (SELECT * FROM ls WHERE scorer = 'popular') p ON p.user_id = c.user_id AND p.item_id = c.item_id
        JOIN (SELECT * FROM ls WHERE scorer = 'item_cf') m ON m.user_id = c.user_id AND m.item_id = c.item_id),
    h1 AS (SELECT *, coalesce(model, -1e12) AS mm, model IS NULL AND content > 0 AS cold, model IS NOT NULL AS known, count(*) OVER (PARTITION BY user_id) AS n FROM hy),
    h2 AS (SELECT *, count(*) FILTER (cold) OVER (PARTITION BY user_id) AS colds, least(7, count(*) FILTER (known) OVER (PARTITION BY user_id)) AS warms,
        row_number() OVER (PARTITION BY user_id ORDER BY round(mm, 9) DESC, item_id) - 1 AS rm, row_number() OVER (PARTITION BY user_id ORDER BY round(content, 9) DESC, item_id) - 1 AS rc,
        row_number() OVER (PARTITION BY user_id ORDER BY round(popular, 9) DESC, item_id) - 1 AS rp,
        CASE WHEN known THEN row_number() OVER (PARTITION BY user_id, known ORDER BY round(mm, 9) DESC, item_id) - 1 END AS w,
        CASE WHEN cold THEN row_number() OVER (PARTITION BY user_id, cold ORDER BY round(content, 9) DESC, item_id) - 1 END AS c FROM h1),
    h3 AS (SELECT *, CASE WHEN w < 7 THEN w WHEN c < 3 THEN warms + c END AS lead, CASE WHEN n <= 1 THEN 1 ELSE 0.55::DOUBLE * (1 - rm / (n - 1)::DOUBLE) + 0.35::DOUBLE * (1 - rc / (n - 1)::DOUBLE)
        + 0.1::DOUBLE * (1 - rp / (n - 1)::DOUBLE) END AS b FROM h2),
    h4 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lead NULLS LAST, round(b, 9) DESC, item_id) - 1 AS place FROM h3),
    hs AS (SELECT user_id, item_id, label, CASE WHEN colds = 0 THEN mm ELSE n - place END AS score FROM h4)"""


@query("hybrid_metrics", _HYBRID + ", " + metrics_sql("hs") + " SELECT * FROM mt")
def _(t):
    """The hybrid scorer over co-occurrence scores as the model, which SQL can follow."""
    queries = materialise(all_queries(t))
    known = train_rows(t).select("item_id").distinct()
    neighbors = item_cf.item_neighbors(t.interactions, train_cut(t))
    cf = item_cf.cf_scores(queries, item_cf.cf_weights(train_rows(t)), neighbors).select("user_id", "item_id", F.col("score").alias("model"))
    model = queries.select("user_id", "item_id").join(known, "item_id", "left_semi").join(cf, ["user_id", "item_id"], "left").na.fill(0.0, ["model"])
    return rounded(E.ranking_metrics(E.hybrid_scores(three_scores(t, queries, model))), *METRICS)


def wide_scores(t, queries, factored):
    """model, content, popular, item_cf (with its support) and explore scores of the queried pairs, each made once."""
    model = vectors.pair_scores(queries.select("user_id", "item_id"), *factored).select("user_id", "item_id", F.col("score").alias("model"))
    neighbors = item_cf.item_neighbors(t.interactions, train_cut(t))
    cf = item_cf.cf_scores(queries, item_cf.cf_weights(train_rows(t)), neighbors).select("user_id", "item_id", F.col("score").alias("item_cf"), F.col("support").alias("cf_support"))
    rows = three_scores(t, queries, model).join(cf, ["user_id", "item_id"], "left")
    return materialise(E.random_scores(rows, SEED).withColumnRenamed("score", "explore"))


def policy_scores(t, queries, wide):
    """Scores of the safe and of the dynamic policy for the queried pairs, from ``wide_scores``."""
    from .. import values as V
    from ..operators import merge, mixing

    names = {"model": "model", "content_profile": "content", "item_cf": "item_cf", "popular": "popular", "explore": "explore"}
    each = F.array(*[F.struct(F.lit(n).alias("source"), F.col(c).cast("double").alias("raw_score")) for n, c in names.items()])
    cold = F.col("model").isNull().alias("is_cold")
    rows = wide.select("user_id", "item_id", cold, F.coalesce("cf_support", F.lit(0)).cast("bigint").alias("support"), F.explode(each).alias("s"))
    rows = rows.select("user_id", "item_id", "is_cold", "support", "s.*").filter(F.col("raw_score").isNotNull())
    counts = train_rows(t).select("user_id", "item_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("history_count"))
    candidates = materialise(merge.source_candidates(rows, counts).withColumn("eligible", F.lit(True)))
    context = merge.user_context(candidates, counts).withColumn("warm_user", F.lit(True))
    most = queries.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return {p: merge.policy_score(mixing.mix_policy(candidates, context, p, most or 1), queries) for p in (V.SAFE_POLICY, V.DYNAMIC_POLICY)}


def stacked(scored):
    """Scorers by name as one long table."""
    found = None
    for scorer, rows in scored.items():
        part = rows.select("user_id", "item_id", "label", "score", F.lit(scorer).alias("scorer"))
        found = part if found is None else found.unionByName(part)
    return found


def factor_scores(wide):
    """The factorisation alone, and with content for what it does not know."""
    three = wide.drop("item_cf", "cf_support", "explore")
    return {"svd": wide.withColumn("score", F.coalesce("model", F.lit(-1e12))), "svd_content_fallback": E.hybrid_scores(three)}


@query("evaluate_svd")
def _(t):
    """Metrics of the factorisation alone, with content for what it does not know, and under both mixing policies."""
    queries = materialise(all_queries(t))
    wide = wide_scores(t, queries, svd(t))
    return E.ranking_metrics(stacked(factor_scores(wide) | policy_scores(t, queries, wide)), ["scorer"])


@query("evaluate_sources")
def _(t):
    """Metrics of every scorer on the same queries; ``hybrid_all_sources`` is the policy that the gate selects over all and over warm queries."""
    from .. import values as V

    factored = [materialise(side) for side in svd(t)]
    kinds = {V.SAFE_POLICY: "safe", V.DYNAMIC_POLICY: "dynamic"}
    queries, warm = materialise(all_queries(t)), materialise(warm_queries(t))
    wide = wide_scores(t, queries, factored)
    policies = policy_scores(t, queries, wide)
    zero = {"popular": "popular", "random": "explore", "item_cf": "item_cf", "content": "content"}
    scored = {n: wide.withColumn("score", F.coalesce(F.col(c), F.lit(0.0))) for n, c in zero.items()}
    full = materialise(E.ranking_metrics(stacked(scored | factor_scores(wide) | policies), ["scorer"]))
    narrow = E.ranking_metrics(stacked(policy_scores(t, warm, wide_scores(t, warm, factored))), ["scorer"])
    name = F.when(F.col("scorer") == V.SAFE_POLICY, kinds[V.SAFE_POLICY]).when(F.col("scorer") == V.DYNAMIC_POLICY, kinds[V.DYNAMIC_POLICY])
    cells = [m.select(name.alias("policy"), F.lit(scope).alias("scope"), "recall", "ndcg") for scope, m in (("full", full), ("warm", narrow))]
    chosen = E.policy_gate(cells[0].unionByName(cells[1]).filter(F.col("policy").isNotNull())).first()["selected_policy"]
    best = full.filter(F.col("scorer") == chosen).withColumn("scorer", F.lit("hybrid_all_sources"))
    return rounded(full.unionByName(best), *METRICS)


@query(
    "catalog_metrics",
    _POP + """, p AS (SELECT DISTINCT user_id, item_id FROM split_rows WHERE split = 'test'),
    x AS (SELECT DISTINCT user_id, item_id FROM split_rows WHERE user_id IN (SELECT user_id FROM p) EXCEPT SELECT user_id, item_id FROM p),
    sc AS (SELECT u.user_id, i.item_id, coalesce(decay + 1e-6 * cumulative, 0) AS s FROM (SELECT DISTINCT user_id FROM p) u CROSS JOIN items i
        LEFT JOIN pop ON pop.item_id = i.item_id ANTI JOIN x ON x.user_id = u.user_id AND x.item_id = i.item_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) - 1 AS rank FROM sc),
    hh AS (SELECT user_id, count(*) AS hits, sum(1 / log2(rank + 2)) AS gain FROM rk JOIN p USING (user_id, item_id) WHERE rank < 10 GROUP BY user_id),
    pn AS (SELECT user_id, count(*) AS n FROM p GROUP BY user_id),
    id AS (SELECT n, (SELECT sum(1 / log2(r + 1)) FROM range(1, 11) t(r) WHERE r <= n) AS best FROM range(1, 11) s(n))
    SELECT count(*) AS queries, round(avg(coalesce(hits, 0) / CAST(pn.n AS DOUBLE)), 6) AS recall, round(avg(coalesce(gain, 0) / best), 6) AS ndcg,
        round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hitrate FROM pn LEFT JOIN hh USING (user_id) JOIN id ON id.n = least(pn.n, 10)""",
)
def _(t):
    rows = prepared(t)
    positives, excluded = E.catalog_queries(rows.filter(F.col("split") == "test"), rows, t.items)
    return rounded(E.catalog_metrics(catalog_popular(t, positives, excluded), positives), *METRICS)


def catalog_popular(t, positives, excluded, k=10):
    """The k most popular items a user may be scored on.

    A user with h excluded items finds k others among the first h + k of the popularity order, so
    each user walks only that far down the ranked catalog.
    """
    from ..functions.exprs import score_key
    from ..functions.grouping import sum_before, top_n

    features = popularity.popularity_features(train_events(t), train_cut(t))
    scored = t.items.select("item_id").join(
        features.select("item_id", popularity.popularity_score().alias("score")), "item_id", "left"
    ).na.fill(0.0, ["score"]).withColumn("one", F.lit(1)).withColumn("order_score", -score_key("score"))
    ranked = sum_before(scored, ["one"], F.floor(F.col("order_score")), ["order_score", "item_id"], F.lit(1.0), "place")
    sizes = excluded.groupBy("user_id").agg(F.count(F.lit(1)).alias("h"))
    users = positives.select("user_id").distinct().join(sizes, "user_id", "left").na.fill(0, ["h"])
    walk = users.select("user_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("h") + (k - 1))).alias("place"))
    shown = walk.join(ranked.select(F.col("place").cast("bigint").alias("place"), "item_id"), "place")
    allowed = shown.join(excluded, ["user_id", "item_id"], "left_anti")
    return top_n(allowed, ["user_id"], [F.col("place")], k)


_DIGEST = """dg AS (SELECT sha256(concat_ws('|', user_id, item_id, label)) AS h FROM qs),
    df AS (SELECT substr(h, 1, 3) AS p, count(*) AS c, sum(('0x' || substr(h, 4, 8))::UBIGINT) AS s0, sum(('0x' || substr(h, 12, 8))::UBIGINT) AS s1,
        sum(('0x' || substr(h, 20, 8))::UBIGINT) AS s2, sum(('0x' || substr(h, 28, 8))::UBIGINT) AS s3 FROM dg GROUP BY 1)
    SELECT CAST(sum(c) AS BIGINT) AS rows, sha256(string_agg(concat_ws(':', p, c, s0, s1, s2, s3), '|' ORDER BY p)) AS digest FROM df"""


@query("query_set_digest", ALL + ", " + _DIGEST)
def _(t):
    return E.query_set_digest(all_queries(t))


@query(
    "cohort_match",
    """SELECT 'same' AS pair, 1 AS comparable, 1 AS equal UNION ALL SELECT 'same queries, other scores', 1, 0 UNION ALL SELECT 'other queries', 0, 0""",
)
def _(t):
    """Evaluations over equal query sets with equal and with unequal metrics, and over unequal query sets."""
    left, right = materialise(warm_queries(t)), E.eval_queries(*parts(t), t.items, purpose="other", seed=7)
    a, b = E.ranking_metrics(E.random_scores(left, SEED)), E.ranking_metrics(E.random_scores(right, SEED))
    worse = E.ranking_metrics(left.withColumn("score", -F.col("label").cast("double")))
    cases = {"same": (left, left, a, a), "same queries, other scores": (left, left, a, worse), "other queries": (left, right, a, b)}
    found = None
    for name, case in cases.items():
        one = E.cohort_match(*case).select(F.lit(name).alias("pair"), F.col("comparable").cast("int").alias("comparable"), F.col("equal").cast("int").alias("equal"))
        found = one if found is None else found.unionByName(one)
    return found


@query(
    "policy_gate",
    """m AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'safe' ELSE 'dynamic' END AS policy, CASE WHEN l_returnflag = 'A' THEN 'full' ELSE 'warm' END AS scope,
        avg(l_discount) AS recall, avg(l_tax) AS ndcg FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2),
    c AS (SELECT max(recall) FILTER (policy = 'dynamic' AND scope = 'full') AS dfr, max(ndcg) FILTER (policy = 'dynamic' AND scope = 'full') AS dfn,
        max(recall) FILTER (policy = 'dynamic' AND scope = 'warm') AS dwr, max(ndcg) FILTER (policy = 'dynamic' AND scope = 'warm') AS dwn,
        max(recall) FILTER (policy = 'safe' AND scope = 'full') AS sfr, max(ndcg) FILTER (policy = 'safe' AND scope = 'full') AS sfn,
        max(recall) FILTER (policy = 'safe' AND scope = 'warm') AS swr, max(ndcg) FILTER (policy = 'safe' AND scope = 'warm') AS swn FROM m),
    g AS (SELECT CAST(dfr >= 0.99 * sfr AS INTEGER) AS full_recall_within_1pct, CAST(dfn >= 0.99 * sfn AS INTEGER) AS full_ndcg_within_1pct,
        CAST(dwr >= 0.99 * swr AS INTEGER) AS warm_recall_within_1pct, CAST(dwn >= 0.99 * swn AS INTEGER) AS warm_ndcg_within_1pct,
        CAST(dfr + dfn + dwr + dwn >= sfr + sfn + swr + swn AS INTEGER) AS composite_not_worse FROM c)
    SELECT *, CASE WHEN full_recall_within_1pct + full_ndcg_within_1pct + warm_recall_within_1pct + warm_ndcg_within_1pct + composite_not_worse = 5
        THEN 'dynamic_confidence_v2' ELSE 'safe_svd_content_v2' END AS selected_policy FROM g""",
)
def _(t):
    rows = t.raw("lineitem").filter(F.col("l_returnflag").isin("A", "R")).groupBy(
        F.when(F.col("l_linestatus") == "O", "safe").otherwise("dynamic").alias("policy"),
        F.when(F.col("l_returnflag") == "A", "full").otherwise("warm").alias("scope"),
    ).agg(F.avg("l_discount").alias("recall"), F.avg("l_tax").alias("ndcg"))
    return E.policy_gate(rows)


@query(
    "auc",
    """s AS (SELECT CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS label, round(l_discount * 0.5 + l_tax * 0.3 + l_quantity * 0.01, 9) AS score, l_linestatus AS part FROM lineitem),
    r AS (SELECT part, label, rank() OVER (PARTITION BY part ORDER BY score) + (count(*) OVER (PARTITION BY part, score) - 1) / 2.0 AS rk FROM s),
    a AS (SELECT part, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, sum(rk) FILTER (label = 1) AS w FROM r GROUP BY part)
    SELECT part, positives, negatives, round((w - positives * (positives + 1) / 2.0) / (CAST(positives AS DOUBLE) * negatives), 6) AS auc FROM a""",
)
def _(t):
    rows = t.raw("lineitem").select(
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("label"),
        (F.col("l_discount") * 0.5 + F.col("l_tax") * 0.3 + F.col("l_quantity") * 0.01).alias("score"),
        F.col("l_linestatus").alias("part"),
    )
    return rounded(E.auc(rows, ["part"]), "auc")
