"""Union of sources, re-ranking, mixing and feeds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.exprs import calibrate, hash_uniform
from ..operators import behaviour as B
from ..operators import evaluation as E
from ..operators import feeds, fusion, merge, mixing, popularity, training
from ..session import materialise
from .data import _POP, train_cut, train_events
from .evaluation import ALL, all_queries, metrics_sql, popular_scored, unit_sql
from .recall import svd, titles, profiles, train_rows, visual_items, visual_profiles
from .registry import query

R = 6


def rounded(df, *names):
    for name in names:
        df = df.withColumn(name, F.round(name, R))
    return df


_LIMIT = "CASE source " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in V.SOURCE_LIMITS.items()) + " END"
_ORD = "CASE source " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(V.SOURCES)) + " END"
_OK = "eligible AND NOT (source = 'item_cf' AND (raw_score <= 0 OR support <= 0)) AND confidence >= 0"
_CAL = """CASE WHEN source = 'svd' THEN 0.5 + 0.5 * (1 - 2 / (exp(2 * raw_score) + 1))
    WHEN source IN ('dssm', 'content', 'visual') THEN greatest(0, least(1, 0.5 + 0.5 * raw_score))
    WHEN source IN ('item_cf', 'popular') THEN ln(1 + greatest(0, raw_score)) / (1 + ln(1 + greatest(0, raw_score)))
    ELSE greatest(0, least(1, raw_score)) END"""
ADMIT = f"""adm0 AS (SELECT *, row_number() OVER (PARTITION BY user_id, source ORDER BY round(raw_score, 9) DESC, CAST(item_id AS VARCHAR)) - 1 AS rk
        FROM candidates WHERE {_OK}),
    adm AS (SELECT *, CAST(1 - rk / CAST(greatest(1, count(*) OVER (PARTITION BY user_id, source) - 1) AS DOUBLE) AS DOUBLE) AS nrm, {_CAL} AS cal,
        {_ORD} AS so FROM adm0 WHERE rk < {_LIMIT})"""
MERGED = ADMIT + """, un AS (SELECT user_id, item_id, bool_or(is_cold) AS is_cold, arg_max(source, nrm * 1000 - so) AS primary_source, """ + ", ".join(
    f"coalesce(max(nrm) FILTER (source = '{n}'), 0) AS s_{n}, coalesce(max(cal) FILTER (source = '{n}'), 0) AS c_{n}, "
    f"max(CASE WHEN source = '{n}' THEN 1 ELSE 0 END) AS m_{n}" for n in V.SOURCES
) + " FROM adm GROUP BY user_id, item_id)"


def merged(t):
    return merge.merge_sources(t.candidates)


@query("mix_eligibility", f"SELECT source, count(*) AS n FROM candidates WHERE {_OK} GROUP BY source")
def _(t):
    return t.candidates.filter(merge.usable_candidate() & merge.confident()).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "confidence_threshold",
    "SELECT source, count(*) AS n FROM candidates WHERE confidence >= CASE source WHEN 'svd' THEN 0.8 WHEN 'visual' THEN 0.7 ELSE 0.0 END GROUP BY source",
)
def _(t):
    return t.candidates.filter(merge.confident({"svd": 0.8, "visual": 0.7})).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("calibrate", f"SELECT user_id, item_id, source, round({_CAL}, 9) AS calibrated FROM candidates")
def _(t):
    return t.candidates.select("user_id", "item_id", "source", F.round(calibrate(F.col("source"), F.col("raw_score")), 9).alias("calibrated"))


@query("rank_normalize", ADMIT + " SELECT user_id, item_id, source, rk AS rank_in_source, round(nrm, 6) AS normalized_score FROM adm")
def _(t):
    return merge.admit_candidates(t.candidates).select(
        "user_id", "item_id", "source", F.col("rank_in_source").cast("bigint").alias("rank_in_source"),
        F.round("normalized_score", R).alias("normalized_score"),
    )


@query(
    "merge_sources",
    MERGED + " SELECT user_id, item_id, primary_source, CAST(is_cold AS INTEGER) AS is_cold, " + ", ".join(
        f"round(CAST(s_{n} AS DOUBLE), 6) AS s_{n}, round(CAST(c_{n} AS DOUBLE), 9) AS c_{n}, CAST(m_{n} AS DOUBLE) AS m_{n}" for n in V.SOURCES
    ) + " FROM un",
)
def _(t):
    cells = []
    for i, n in enumerate(V.SOURCES):
        cells += [F.round(F.col("scores")[i], R).alias(f"s_{n}"), F.round(F.col("calibrated")[i], 9).alias(f"c_{n}"), F.col("mask")[i].alias(f"m_{n}")]
    return merged(t).select("user_id", "item_id", "primary_source", F.col("is_cold").cast("int").alias("is_cold"), *cells)


@query("source_evidence", ADMIT + " SELECT user_id, item_id, source, round(raw_score, 6) AS raw_score, rk AS rank_in_source, round(confidence, 6) AS confidence, support FROM adm")
def _(t):
    rows = merge.source_evidence(merged(t)).select("user_id", "item_id", F.explode("evidence").alias("source", "e"))
    return rows.select(
        "user_id", "item_id", "source", F.round("e.raw_score", R).alias("raw_score"),
        F.col("e.rank_in_source").cast("bigint").alias("rank_in_source"), F.round("e.confidence", R).alias("confidence"), F.col("e.support").alias("support"),
    )


@query(
    "union_stats",
    ADMIT + f""" SELECT c.source, c.offered, c.available, a.admitted, c.offered - c.available AS filtered FROM
        (SELECT source, count(*) AS offered, count(*) FILTER ({_OK}) AS available FROM candidates GROUP BY source) c
        JOIN (SELECT source, count(*) AS admitted FROM adm GROUP BY source) a USING (source)""",
)
def _(t):
    return merge.union_stats(t.candidates)


@query("union_sizes", MERGED + " SELECT count(*) AS users, min(c) AS min, round(avg(c), 6) AS mean, max(c) AS max FROM (SELECT user_id, count(*) AS c FROM un GROUP BY user_id)")
def _(t):
    return rounded(merge.union_sizes(merged(t)), "mean")


PRIOR = MERGED + """, wc AS (SELECT *, NOT is_cold AND m_svd = 1 AS w, is_cold AND m_content = 1 AS c, 0.55 * s_svd + 0.35 * s_content + 0.1 * s_popular AS bl FROM un),
    wn AS (SELECT *, row_number() OVER (PARTITION BY user_id, w ORDER BY round(s_svd, 9) DESC, CAST(item_id AS VARCHAR)) AS wr,
        row_number() OVER (PARTITION BY user_id, c ORDER BY round(s_content, 9) DESC, CAST(item_id AS VARCHAR)) AS cr FROM wc),
    hd AS (SELECT *, CASE WHEN w AND wr <= 7 THEN 0 WHEN c AND cr <= 3 THEN 1 ELSE 2 END AS head FROM wn),
    pr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY head, CASE head WHEN 0 THEN wr WHEN 1 THEN cr ELSE 0 END,
        CASE WHEN head = 2 THEN round(bl, 9) END DESC NULLS LAST, CAST(item_id AS VARCHAR)) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM hd),
    pp AS (SELECT *, 1 - place / CAST(greatest(1, n - 1) AS DOUBLE) AS prior FROM pr)"""


@query("quality_prior", PRIOR + " SELECT user_id, item_id, head, place, round(prior, 6) AS prior FROM pp")
def _(t):
    return merge.quality_prior(merged(t)).select(
        "user_id", "item_id", "head", F.col("place").cast("bigint").alias("place"), F.round("prior", R).alias("prior")
    )


_RANKER = PRIOR + f", rn AS (SELECT *, {unit_sql(chr(39) + '11' + chr(39), 'user_id', 'item_id')} AS rs FROM pp)"


def with_ranker(t):
    return merged(t).withColumn("rs", hash_uniform(11, F.col("user_id"), F.col("item_id")))


@query(
    "prior_blend",
    _RANKER + """, rr AS (SELECT *, 1 - (row_number() OVER (PARTITION BY user_id ORDER BY round(rs, 9) DESC, CAST(item_id AS VARCHAR)) - 1)
        / CAST(greatest(1, n - 1) AS DOUBLE) AS sh FROM rn), fb AS (SELECT *, 0.7 * sh + 0.3 * prior AS fs FROM rr)
    SELECT user_id, item_id, round(fs, 6) AS final_score, row_number() OVER (PARTITION BY user_id ORDER BY round(fs, 9) DESC, CAST(item_id AS VARCHAR)) - 1 AS final_rank FROM fb""",
)
def _(t):
    return merge.prior_blend(with_ranker(t), "rs", 0.3).select(
        "user_id", "item_id", F.round("final_score", R).alias("final_score"), F.col("final_rank").cast("bigint").alias("final_rank")
    )


@query(
    "protected_rerank",
    _RANKER + """, ph AS (SELECT *, head < 2 AS hh, count(*) OVER (PARTITION BY user_id, head < 2) AS hn,
        row_number() OVER (PARTITION BY user_id, head < 2 ORDER BY place) - 1 AS st, row_number() OVER (PARTITION BY user_id, head < 2 ORDER BY round(rs, 9) DESC, item_id) - 1 AS ln FROM rn),
    pk AS (SELECT *, CASE WHEN hh THEN 0.4 * (1 - st / CAST(greatest(1, hn - 1) AS DOUBLE)) + 0.6 * (1 - ln / CAST(greatest(1, hn - 1) AS DOUBLE)) ELSE rs END AS k FROM ph)
    SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY hh DESC, round(k, 9) DESC, item_id) - 1 AS final_rank FROM pk""",
)
def _(t):
    return merge.protected_rerank(with_ranker(t), "rs", 0.4).select("user_id", "item_id", F.col("final_rank").cast("bigint").alias("final_rank"))


def _ranked(rows, *order):
    """All rows with their rank from 0 within the user."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - 1)


_HIST = """hc AS (SELECT user_id, count(*) AS c FROM train_pairs GROUP BY user_id),
    hf AS (SELECT user_id, c, ln(1 + c) / greatest(1, ln(1 + (SELECT max(c) FROM hc))) AS density,
        (c >= 5)::INT + (c >= 10)::INT + (c >= 20)::INT + (c >= 50)::INT AS bucket FROM hc),
    pc AS (SELECT item_id, count(*) AS c FROM split_rows WHERE split = 'train' GROUP BY item_id),
    pf AS (SELECT item_id, c, (c >= 0)::INT + (c >= 1)::INT + (c >= 2)::INT + (c >= 4)::INT + (c >= 8)::INT + (c >= 16)::INT + (c >= 32)::INT
        + (c >= 64)::INT AS bucket FROM pc)"""


def history(t):
    counts = train_rows(t).select("user_id", "item_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
    return merge.feature_normalisers(counts, "user_id", "c", V.HISTORY_BOUNDS)


def item_counts(t):
    counts = train_rows(t).groupBy("item_id").agg(F.count(F.lit(1)).alias("c"))
    return merge.feature_normalisers(counts, "item_id", "c", V.POPULARITY_BOUNDS)


@query("feature_normalisers", _HIST + " SELECT user_id, c, round(density, 6) AS density, bucket FROM hf")
def _(t):
    return rounded(history(t), "density")


def features(t):
    return merge.ranker_features(merged(t), history(t), item_counts(t), t.visual_vectors)


_CONT = [f"s_{n}" for n in V.SOURCES] + [f"c_{n}" for n in V.SOURCES] + [f"m_{n}" for n in V.SOURCES]
FEATURES = MERGED + ", " + _HIST + f""", ft AS (SELECT un.user_id, un.item_id, {', '.join(_CONT)}, coalesce(hf.density, 0) AS density, CAST(is_cold AS INTEGER) AS cold,
    CASE WHEN un.item_id IN (SELECT vec_id FROM embeddings) THEN 1 ELSE 0 END AS visual, coalesce(pf.bucket, 0) AS popularity_bucket,
    coalesce(hf.bucket, 0) AS history_bucket, {_ORD.replace('CASE source', 'CASE primary_source')} + 1 AS primary_code
    FROM un LEFT JOIN hf ON hf.user_id = un.user_id LEFT JOIN pf ON pf.item_id = un.item_id)"""
_SUM = " + ".join(f"{i + 1} * {c}" for i, c in enumerate([*_CONT, "density", "cold", "visual"]))


def check_features(df, *more):
    """Position-weighted sum of the continuous block, which depends on every cell and its place."""
    total = sum(((i + 1) * F.col("continuous")[i] for i in range(24)), F.lit(0.0))
    return df.select("user_id", "item_id", F.round(total, R).alias("checksum"), "popularity_bucket", "history_bucket", "primary_code", *more)


@query("ranker_features", FEATURES + f" SELECT user_id, item_id, round({_SUM}, 6) AS checksum, popularity_bucket, history_bucket, primary_code FROM ft")
def _(t):
    return check_features(features(t))


def _without(names, flag="TRUE", cold="cold"):
    """SQL form of hiding sources: cells become 0 where the flag holds."""
    cells = []
    for c in _CONT:
        hit = c.split("_", 1)[1] in names
        cells.append(f"CASE WHEN {flag} THEN 0 ELSE {c} END AS {c}" if hit else c)
    return ", ".join([*cells, "density", f"{cold} AS cold", "visual"])


_ARG = "CASE " + " ".join(
    f"WHEN m_{n} > 0 AND s_{n} >= greatest({', '.join(f'CASE WHEN m_{o} > 0 THEN s_{o} ELSE -1 END' for o in V.SOURCES)}) THEN {i + 1}"
    for i, n in enumerate(V.SOURCES)
) + " END"


@query(
    "source_ablation",
    FEATURES + f""", ab AS (SELECT user_id, item_id, popularity_bucket, history_bucket, {_without(('svd',))} FROM ft)
    SELECT user_id, item_id, round({_SUM}, 6) AS checksum, popularity_bucket, history_bucket, {_ARG} AS primary_code FROM ab
    WHERE {' + '.join(f'm_{n}' for n in V.SOURCES)} > 0""",
)
def _(t):
    return check_features(merge.source_ablation(features(t), "svd"))


_SIM = f"""(m_dssm > 0 OR m_content > 0 OR m_visual > 0) AND {unit_sql("'42:simulate-cold'", 'user_id', 'item_id')} < 0.5"""


@query(
    "simulate_cold",
    FEATURES + f""", fs AS (SELECT *, {_SIM} AS sim FROM ft),
    sm AS (SELECT user_id, item_id, sim, popularity_bucket, history_bucket, primary_code AS old,
        {_without(('svd', 'item_cf'), 'sim', 'CASE WHEN sim THEN 1 ELSE cold END')} FROM fs)
    SELECT user_id, item_id, round({_SUM}, 6) AS checksum, popularity_bucket, history_bucket, CASE WHEN sim THEN {_ARG} ELSE old END AS primary_code,
        CASE WHEN sim THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sm""",
)
def _(t):
    return check_features(training.simulate_cold(features(t)), "weight")


@query(
    "cold_dropout",
    FEATURES + f""", fs AS (SELECT *, {unit_sql("'42:cold-dropout'", 'user_id', 'item_id')} < 0.3 AS sim FROM ft),
    sm AS (SELECT user_id, item_id, sim, popularity_bucket, history_bucket, primary_code AS old,
        {_without(('svd', 'item_cf'), 'sim', 'CASE WHEN sim THEN 1 ELSE cold END')} FROM fs)
    SELECT user_id, item_id, round({_SUM}, 6) AS checksum, popularity_bucket, history_bucket,
        CASE WHEN sim THEN CASE WHEN {' + '.join(f'm_{n}' for n in V.SOURCES)} > 0 THEN {_ARG} ELSE 1 END ELSE old END AS primary_code FROM sm""",
)
def _(t):
    return check_features(training.cold_dropout(features(t), 0.3))


_FUSE = ALL + ", " + _POP + f""", fq AS (SELECT qs.user_id, qs.item_id, label, coalesce(decay + 1e-6 * cumulative, 0) AS ts,
        {unit_sql("'5'", 'qs.user_id', 'qs.item_id')} AS vs, items.is_cold FROM qs LEFT JOIN pop USING (item_id) JOIN items ON items.item_id = qs.item_id),
    fr AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY round(ts, 9) DESC, item_id) - 1 AS tr,
        row_number() OVER (PARTITION BY user_id ORDER BY round(vs, 9) DESC, item_id) - 1 AS vr FROM fq),
    fu AS (SELECT *, 1 - tr / CAST(greatest(1, n - 1) AS DOUBLE) AS tn, 1 - vr / CAST(greatest(1, n - 1) AS DOUBLE) AS vn FROM fr)"""


def fusion_rows(t):
    queries = popular_scored(t, all_queries(t)).withColumnRenamed("score", "text_score")
    visual = queries.withColumn("visual_score", hash_uniform(5, F.col("user_id"), F.col("item_id")))
    return visual.join(t.items.select("item_id", "is_cold"), "item_id")


@query(
    "late_fusion",
    _FUSE + """ SELECT user_id, item_id, round((1 - CASE WHEN is_cold THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END) * tn + CASE WHEN is_cold THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END * vn, 6) AS fusion FROM fu""",
)
def _(t):
    return rounded(merge.late_fusion(fusion_rows(t), 0.2, 0.5).select("user_id", "item_id", "fusion"), "fusion")


@query(
    "serving_fusion",
    _FUSE.replace("AS vs, items", "AS v0, items.item_id % 4 <> 0 AS img, items").replace("fr AS (SELECT *,", "fz AS (SELECT *, CASE WHEN img THEN v0 ELSE -1 END AS vs FROM fq), fr AS (SELECT *,").replace("AS vr FROM fq)", "AS vr, row_number() OVER (PARTITION BY user_id ORDER BY item_id DESC) - 1 AS br FROM fz)") + """,
    sf AS (SELECT *, 0.75 * (1 - br / CAST(greatest(1, n - 1) AS DOUBLE)) + 0.25 * CASE WHEN img THEN 0.8 * tn + 0.2 * vn ELSE tn END AS sc FROM fu)
    SELECT user_id, item_id, round(sc, 6) AS serving_score, row_number() OVER (PARTITION BY user_id ORDER BY round(sc, 9) DESC, CAST(item_id AS VARCHAR)) - 1 AS rank FROM sf""",
)
def _(t):
    rows = fusion_rows(t).withColumn("visual_score", F.when(F.col("item_id") % 4 != 0, F.col("visual_score"))).withColumn(
        "base_score", F.col("item_id").cast("double")
    )
    return merge.serving_fusion(rows, 0.2, 0.2).select(
        "user_id", "item_id", F.round("serving_score", R).alias("serving_score"), F.col("rank").cast("bigint").alias("rank")
    )


_GRID = _FUSE + """, gp AS (SELECT unnest([{'policy': 'text_only', 'weight': 0.0::DOUBLE}, {'policy': 'visual_only', 'weight': 1.0::DOUBLE}, {'policy': 'static_0.16', 'weight': 0.16::DOUBLE},
        {'policy': 'static_0.17', 'weight': 0.17::DOUBLE}, {'policy': 'static_0.175', 'weight': 0.175::DOUBLE}, {'policy': 'static_0.18', 'weight': 0.18::DOUBLE},
        {'policy': 'static_0.19', 'weight': 0.19::DOUBLE}], recursive := true)),
    gs AS (SELECT unnest(['sampled_all_items', 'warm', 'cold']) AS scope),
    gr AS (SELECT user_id, item_id, label, policy, weight, scope, (1 - weight) * tn + weight * vn AS score FROM fu, gp, gs
        WHERE label = 0 OR scope = 'sampled_all_items' OR scope = CASE WHEN is_cold THEN 'cold' ELSE 'warm' END), """ + metrics_sql("gr", "policy, weight, scope")


@query("fusion_metrics", _GRID + " SELECT * FROM mt")
def _(t):
    return rounded(fusion.fusion_metrics(fusion_rows(t)), "recall", "ndcg", "hitrate")


@query(
    "fusion_selection",
    _GRID.replace("round(avg(hits / CAST(positives AS DOUBLE)), 6)", "avg(hits / CAST(positives AS DOUBLE))").replace("round(avg(gain / best), 6)", "avg(gain / best)") + """,
    wd AS (SELECT policy, weight, """ + ", ".join(
        f"coalesce(max({m}) FILTER (scope = '{s}'), 0) AS {a}{m[0]}" for s, a in (("sampled_all_items", "a"), ("warm", "w"), ("cold", "c")) for m in ("recall", "ndcg")
    ) + """ FROM mt GROUP BY policy, weight),
    jd AS (SELECT w.*, w.ar >= 0.995 * b.ar AND w.an >= 0.995 * b.an AND w.wr >= 0.995 * b.wr AND w.wn >= 0.995 * b.wn AS safe,
        w.ar >= 1.01 * b.ar OR w.an >= 1.01 * b.an OR w.cr >= 1.03 * b.cr OR w.cn >= 1.03 * b.cn AS better,
        round(w.an + w.ar + 0.25 * (w.cn + w.cr), 9) AS value FROM wd w, (SELECT * FROM wd WHERE policy = 'text_only') b)
    SELECT policy, weight, CAST(safe AS INTEGER) AS safe, CAST(better AS INTEGER) AS better, round(value, 6) AS value,
        CASE WHEN policy = (SELECT policy FROM jd WHERE policy LIKE 'static%' ORDER BY (safe AND better) DESC, value DESC, weight LIMIT 1) THEN 1 ELSE 0 END AS selected FROM jd""",
)
def _(t):
    chosen = fusion.fusion_selection(materialise(fusion.fusion_metrics(fusion_rows(t))))
    return chosen.select(
        "policy", "weight", F.col("safe").cast("int").alias("safe"), F.col("better").cast("int").alias("better"), F.round("value", R).alias("value"), "selected"
    )


def mixer_candidates(t):
    """The same candidates under the mixer's source names."""
    name = F.when(F.col("source") == "svd", "model").when(F.col("source") == "content", "content_profile").otherwise(F.col("source"))
    return t.candidates.withColumn("source", name).filter(F.col("source").isin(*V.MIX_SOURCES))


@query(
    "source_candidates",
    """mc AS (SELECT *, CASE source WHEN 'svd' THEN 'model' WHEN 'content' THEN 'content_profile' ELSE source END AS src FROM candidates
        WHERE source IN ('svd', 'content', 'item_cf', 'popular', 'explore')),
    hc AS (SELECT user_id, count(*) AS h FROM train_pairs GROUP BY user_id)
    SELECT mc.user_id, item_id, src AS source, raw_score, round(CASE WHEN src = 'model' THEN 1 - 1 / (exp(2 * raw_score) + 1) WHEN src IN ('content_profile', 'item_cf')
        THEN least(1, raw_score) WHEN src = 'popular' THEN CASE WHEN raw_score > 0 THEN 1.0 ELSE 0.1 END ELSE 0.05 END, 6) AS confidence,
        CAST(CASE src WHEN 'model' THEN coalesce(h, 0) WHEN 'content_profile' THEN greatest(1, coalesce(h, 0)) WHEN 'item_cf' THEN support
        WHEN 'popular' THEN greatest(0, floor(raw_score)) ELSE 0 END AS BIGINT) AS support
    FROM mc LEFT JOIN hc ON hc.user_id = mc.user_id WHERE src NOT IN ('content_profile', 'item_cf') OR raw_score > 0""",
)
def _(t):
    counts = history(t).select("user_id", F.col("c").alias("history_count"))
    rows = merge.source_candidates(mixer_candidates(t).drop("eligible", "confidence"), counts)
    return rows.select("user_id", "item_id", "source", "raw_score", F.round("confidence", R).alias("confidence"), "support")


_MIXOK = """mx AS (SELECT user_id, item_id, CASE source WHEN 'svd' THEN 'model' ELSE 'content_profile' END AS source, is_cold,
        row_number() OVER (PARTITION BY user_id, source ORDER BY round(raw_score, 9) DESC, CAST(item_id AS VARCHAR)) - 1 AS r0
        FROM candidates WHERE source IN ('svd', 'content') AND eligible),
    my AS (SELECT *, row_number() OVER (PARTITION BY user_id, source ORDER BY r0) - 1 AS r FROM mx WHERE source = 'model' OR is_cold),
    mz AS (SELECT *, CASE WHEN source = 'model' THEN 10 * (r // 7) + r % 7 ELSE 10 * (r // 3) + 7 + r % 3 END AS slot FROM my)"""


@query(
    "mix_safe_warm",
    _MIXOK + """ SELECT user_id, item_id, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY slot) - 1 AS rank FROM mz) WHERE rank < 50""",
)
def _(t):
    model = mixer_candidates(t)
    return mixing.mix_safe_warm(model, 50).select("user_id", "item_id", "source", F.col("rank").cast("bigint").alias("rank"))


@query(
    "policy_score",
    ALL + ", " + _MIXOK + """, ls AS (SELECT user_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY slot) - 1 AS rank FROM mz) WHERE rank < 50)
    SELECT q.user_id, q.item_id, CAST(CASE WHEN rank IS NULL THEN -1e12 ELSE count(*) OVER (PARTITION BY q.user_id) - rank END AS DOUBLE) AS score
    FROM qs q LEFT JOIN ls ON ls.user_id = q.user_id AND ls.item_id = q.item_id""",
)
def _(t):
    """The safe policy's lists as a scorer of the query set."""
    ranked = mixing.mix_safe_warm(mixer_candidates(t), 50).select("user_id", "item_id", "rank")
    return merge.policy_score(ranked, materialise(all_queries(t))).select("user_id", "item_id", "score")


def contexts(t):
    counts = history(t).select("user_id", F.col("c").alias("history_count"))
    found = merge.user_context(mixer_candidates(t), counts)
    return found.join(t.users.select("user_id", F.col("dataset_user_id").isNotNull().alias("warm_user")), "user_id")


@query(
    "user_context",
    """hc AS (SELECT user_id, count(*) AS h FROM train_pairs GROUP BY user_id)
    SELECT c.user_id, coalesce(max(support) FILTER (source = 'item_cf'), 0) AS cf_support, round(coalesce(max(confidence) FILTER (source = 'content'), 0), 6) AS content_confidence,
        coalesce(any_value(h), 0) AS history_count FROM candidates c LEFT JOIN hc ON hc.user_id = c.user_id WHERE source IN ('svd', 'content', 'item_cf', 'popular', 'explore') GROUP BY c.user_id""",
)
def _(t):
    return rounded(contexts(t).drop("warm_user"), "content_confidence")


@query("mix_dynamic")
def _(t):
    return mixing.mix_policy(mixer_candidates(t), contexts(t), V.DYNAMIC_POLICY, 50)


@query("mix_safe")
def _(t):
    return mixing.mix_policy(mixer_candidates(t), contexts(t), V.SAFE_POLICY, 50)


def liked(t):
    return t.behaviour.filter(F.col("event_type") == "like").select("user_id", "item_id").distinct()


@query("policy_diagnostics")
def _(t):
    mixed = materialise(mixing.mix_policy(mixer_candidates(t), contexts(t), V.DYNAMIC_POLICY, 50))
    return mixing.policy_diagnostics(mixed, liked(t))


_HEADS = """tp AS (SELECT * FROM (SELECT user_id, source, item_id, row_number() OVER (PARTITION BY user_id, source ORDER BY round(raw_score, 9) DESC, CAST(item_id AS VARCHAR)) AS rn
        FROM candidates WHERE eligible) WHERE rn <= 10)"""


@query(
    "source_hitrates",
    _HEADS + """, lk AS (SELECT DISTINCT user_id, item_id FROM behaviour WHERE event_type = 'like'),
    ht AS (SELECT source, count(DISTINCT tp.user_id) AS h FROM tp JOIN lk ON lk.user_id = tp.user_id AND lk.item_id = tp.item_id GROUP BY source)
    SELECT s.source, coalesce(h, 0) AS users_hit, round(coalesce(h, 0) / CAST((SELECT count(DISTINCT user_id) FROM candidates) AS DOUBLE), 6) AS hitrate_at_k
    FROM (SELECT DISTINCT source FROM tp) s LEFT JOIN ht ON ht.source = s.source""",
)
def _(t):
    return rounded(mixing.source_diagnostics(t.candidates, liked(t))[0], "hitrate_at_k")


_PAIRS = ", ".join(f"('{a}', '{b}')" for i, a in enumerate(sorted(V.SOURCES)) for b in sorted(V.SOURCES)[i + 1:])


@query(
    "source_jaccard",
    f"""pn AS (SELECT * FROM (VALUES {_PAIRS}) v(a, b)), us AS (SELECT DISTINCT user_id FROM candidates),
    cs AS (SELECT DISTINCT user_id, item_id, source FROM candidates),
    bt AS (SELECT x.user_id, x.source AS a, y.source AS b, count(*) AS k FROM cs x JOIN cs y ON y.user_id = x.user_id AND y.item_id = x.item_id AND x.source < y.source GROUP BY 1, 2, 3),
    sz AS (SELECT user_id, source, count(*) AS c FROM cs GROUP BY user_id, source),
    jj AS (SELECT a, b, us.user_id, coalesce(k, 0) AS k, coalesce(p.c, 0) + coalesce(q.c, 0) - coalesce(k, 0) AS un FROM us CROSS JOIN pn LEFT JOIN bt USING (user_id, a, b)
        LEFT JOIN sz p ON p.user_id = us.user_id AND p.source = a LEFT JOIN sz q ON q.user_id = us.user_id AND q.source = b)
    SELECT a AS "left", b AS "right", count(*) AS users, round(avg(CASE WHEN un = 0 THEN 0.0 ELSE k / CAST(un AS DOUBLE) END), 6) AS jaccard FROM jj GROUP BY a, b""",
)
def _(t):
    return rounded(mixing.source_overlap(t.candidates), "jaccard")


@query(
    "source_head_jaccard",
    _HEADS + f""", pn AS (SELECT * FROM (VALUES {_PAIRS}) v(a, b)), us AS (SELECT DISTINCT user_id FROM tp),
    bt AS (SELECT x.user_id, x.source AS a, y.source AS b, count(*) AS k FROM tp x JOIN tp y ON y.user_id = x.user_id AND y.item_id = x.item_id AND x.source < y.source GROUP BY 1, 2, 3),
    sz AS (SELECT user_id, source, count(*) AS c FROM tp GROUP BY user_id, source),
    jj AS (SELECT a, b, us.user_id, coalesce(k, 0) AS k, coalesce(p.c, 0) + coalesce(q.c, 0) - coalesce(k, 0) AS un FROM us CROSS JOIN pn LEFT JOIN bt USING (user_id, a, b)
        LEFT JOIN sz p ON p.user_id = us.user_id AND p.source = a LEFT JOIN sz q ON q.user_id = us.user_id AND q.source = b)
    SELECT a AS "left", b AS "right", count(*) AS users, round(avg(CASE WHEN un = 0 THEN 0.0 ELSE k / CAST(un AS DOUBLE) END), 6) AS jaccard FROM jj GROUP BY a, b""",
)
def _(t):
    return rounded(mixing.source_diagnostics(t.candidates, liked(t))[1], "jaccard")


def prior_lists(t):
    return merge.quality_prior(merged(t)).select("user_id", "item_id", F.col("primary_source").alias("source"), F.col("place").alias("rank"))


@query("source_caps")
def _(t):
    return mixing.apply_source_caps(prior_lists(t), 500)


@query("mmr_rerank")
def _(t):
    return mixing.mmr_rerank(prior_lists(t), t.items)


_TOK = """tk AS (SELECT item_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(title, '([A-Za-z0-9]+|[一-鿿])'), lambda x: length(x) > 1
        OR strlen(x) > length(x)), lambda x: lower(x)))) AS tok FROM items)"""


@query("title_tokens", _TOK + " SELECT item_id, array_to_string(tok, ' ') AS tokens FROM tk")
def _(t):
    from ..functions.exprs import title_tokens

    return t.items.select("item_id", F.array_join(title_tokens(F.col("title")), " ").alias("tokens"))


@query(
    "diversity_metrics",
    PRIOR + ", " + _TOK + """, ds AS (SELECT user_id, item_id, place, tok FROM pp JOIN tk USING (item_id) WHERE place < 50),
    dp AS (SELECT a.user_id, b.place - a.place AS gap, CASE WHEN len(a.tok) = 0 OR len(b.tok) = 0 THEN 0.0 ELSE len(list_intersect(a.tok, b.tok)) /
        CAST(len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok)) AS DOUBLE) END AS j FROM ds a JOIN ds b ON a.user_id = b.user_id AND a.place < b.place),
    dm AS (SELECT user_id, avg(j) FILTER (gap = 1) AS adj, avg(j) AS al FROM dp GROUP BY user_id),
    du AS (SELECT user_id, count(DISTINCT x) AS u FROM (SELECT user_id, unnest(tok) AS x FROM ds) GROUP BY user_id)
    SELECT d.user_id, count(*) AS evaluated_items, count(*) - count(DISTINCT item_id) AS duplicate_items, max(coalesce(u, 0)) AS unique_title_tokens,
        round(coalesce(max(adj), 0), 6) AS adjacent_title_similarity, round(1 - coalesce(max(al), 0), 6) AS intra_list_diversity
    FROM ds d LEFT JOIN dm USING (user_id) LEFT JOIN du USING (user_id) GROUP BY d.user_id""",
)
def _(t):
    return rounded(mixing.diversity_metrics(prior_lists(t), t.items), "adjacent_title_similarity", "intra_list_diversity")


def campaigns(t):
    """Boost campaigns derived from suppliers: one item each, some for everybody, some for listed users."""
    rows = t.raw("supplier")
    key = F.col("s_suppkey")
    listed = F.when(key % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(key, key + 7, key + 20))
    return rows.select(
        key.alias("campaign_id"), (key * 3 % 97).alias("item_id"),
        F.when(key % 5 == 0, "all").otherwise("users").alias("audience"), listed.alias("user_ids"),
        F.when(key % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("personalized"))).alias("feed_types"),
        (key % 10).cast("int").alias("position"), F.floor("s_acctbal").cast("int").alias("priority"),
        (F.lit(1000) + key).alias("created_ms"), F.lit(0).alias("starts_ms"),
        F.when(F.col("s_nationkey") < 20, 5000).otherwise(10).alias("ends_ms"), (F.col("s_nationkey") != 3).alias("active"),
    ).filter(F.col("campaign_id") >= 0)


_BOOST = """bc AS (SELECT s_suppkey AS id, s_suppkey * 3 % 97 AS item_id, s_suppkey % 5 = 0 AS everyone, CAST(s_suppkey % 10 AS INTEGER) AS position,
        CAST(floor(s_acctbal) AS INTEGER) AS priority, 1000 + s_suppkey AS created FROM supplier WHERE s_nationkey < 20 AND s_nationkey <> 3),
    bu AS (SELECT c_custkey AS user_id, bc.* FROM customer, bc WHERE everyone UNION ALL
        SELECT DISTINCT c_custkey, bc.* FROM bc JOIN (VALUES (0), (7), (20)) o(d) ON TRUE JOIN customer ON c_custkey = id + d WHERE NOT everyone),
    bb AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY priority DESC, created, id) AS pick FROM bu)"""


@query("active_boosts", _BOOST + " SELECT user_id, item_id, id AS campaign_id, priority, position FROM bb WHERE pick = 1")
def _(t):
    return mixing.active_boosts(campaigns(t), t.users, "personalized", 1500)


_PLACED = PRIOR + ", " + _BOOST + """, bo AS (SELECT user_id, list({'item': item_id, 'at': position} ORDER BY priority, CAST(item_id AS VARCHAR) DESC) AS b FROM bb WHERE pick = 1 GROUP BY user_id),
    ls AS (SELECT user_id, list({'item_id': item_id, 'forced': 0, 'source': primary_source} ORDER BY place) AS o FROM pp
        WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM bb WHERE pick = 1) GROUP BY user_id),
    fo AS (SELECT coalesce(ls.user_id, bo.user_id) AS user_id, coalesce(o, []) AS o, coalesce(b, []) AS b, 1 AS i FROM ls FULL OUTER JOIN bo ON bo.user_id = ls.user_id
        UNION ALL SELECT user_id, list_concat(list_concat(o[1:least(b[i]['at'], len(o), 499)], [{'item_id': b[i]['item'], 'forced': 1, 'source': 'forced'}]),
            o[least(b[i]['at'], len(o), 499) + 1:]), b, i + 1 FROM fo WHERE i <= len(b)),
    fl AS (SELECT user_id, o[1:500] AS o FROM fo WHERE i = len(b) + 1)"""


@query(
    "place_boosts",
    "RECURSIVE " + _PLACED + """ SELECT user_id, rank - 1 AS rank, e.item_id, e.forced, e.source FROM (SELECT user_id, unnest(o) AS e, generate_subscripts(o, 1) AS rank FROM fl)""",
)
def _(t):
    boosts = mixing.active_boosts(campaigns(t), t.users, "personalized", 1500)
    rows = mixing.place_boosts(prior_lists(t), boosts, 500)
    return rows.withColumn("forced", F.col("forced").cast("int")).withColumn("rank", F.col("rank").cast("bigint"))


def recalled(t, factored=None):
    """Candidates of the real recall chain for every user; ``factored``: the factors of users and items, if there already."""
    from ..operators import content, factors, item_cf, vectors

    train = train_rows(t)
    users, items = factored or svd(t)
    vocab, title_vectors = titles(t)
    neighbors = item_cf.item_neighbors(t.interactions, train_cut(t))
    pop = popularity.popularity_features(train_events(t), train_cut(t))
    counts = popularity.exposure_counts(t.items, t.exposures)
    one = F.lit(1).cast("bigint")
    embedded = vectors.feedback_embeddings(visual_profiles(t), B.user_item_state(t.behaviour), vectors.usable(t.visual_vectors))
    parts_ = {
        "dssm": vectors.top_items_per_user(embedded, visual_items(t), V.SOURCE_LIMITS["dssm"]).withColumn("support", one),
        "svd": factors.svd_recall(users, items, None, V.SOURCE_LIMITS["svd"]).withColumn("support", one),
        "content": vectors.top_items_per_user(
            profiles(t, title_vectors, vocab), title_vectors, V.SOURCE_LIMITS["content"], width=8192, floor=0.0
        ).withColumn("support", one),
        "visual": vectors.top_items_per_user(visual_profiles(t), visual_items(t), V.SOURCE_LIMITS["visual"]).withColumn("support", one),
        "item_cf": item_cf.cf_recall(item_cf.cf_weights(train), neighbors, V.SOURCE_LIMITS["item_cf"]),
        "popular": popularity.popular_recall(t.users, pop, V.SOURCE_LIMITS["popular"]),
        "explore": popularity.explore_recall(t.users, counts, 7, V.SOURCE_LIMITS["explore"]),
    }
    stacked = None
    for source, rows in parts_.items():
        part = rows.select("user_id", "item_id", "raw_score", F.col("support").cast("bigint").alias("support"), F.lit(source).alias("source"))
        stacked = part if stacked is None else stacked.unionByName(part)
    warm = train.select("item_id").distinct().withColumn("__warm", F.lit(1))
    return stacked.join(warm, "item_id", "left").select(
        "user_id", "item_id", "source", "raw_score", "support", F.lit(True).alias("eligible"), F.lit(1.0).alias("confidence"),
        F.col("__warm").isNull().alias("is_cold"),
    )


def shared_union(t):
    """Users whose candidates are ranked by the unified model: those it was trained on."""
    known = train_rows(t).select("user_id").distinct()
    union = merged(t).withColumn("source", F.col("primary_source")).filter(F.col("source") != "explore").join(known, "user_id", "left_semi")
    return _ranked(union, F.expr(merge.TEXT_ID))


def serving_users(t):
    """Users with the state of their models; those of inactive accounts count as failed."""
    return t.users.select("user_id", "dataset_user_id", (~F.col("is_active")).alias("model_failed"))


def served_sources(t):
    """unified, svd, popular and explore lists of all users."""
    return shared_union(t), *[_ranked(t.candidates.filter(F.col("source") == n), F.col("item_id")) for n in ("svd", "popular", "explore")]


_SEEN = "SELECT DISTINCT user_id, item_id FROM behaviour WHERE event_type IN ('impression', 'click', 'like', 'not_interested')"


def _fall_sql(p, tiers):
    """The fallback plan over a table of tiers, as common table expressions that end in ``{p}oo`` and ``{p}pl``."""
    return f"""{p}us AS (SELECT t.* FROM {tiers} t JOIN users u ON u.user_id = t.user_id WHERE (dataset_user_id IS NOT NULL OR tier = 2) AND NOT (tier = 0 AND NOT is_active)),
    {p}fi AS (SELECT user_id, min(tier) AS best FROM {p}us GROUP BY user_id),
    {p}ch AS (SELECT t.* FROM {p}us t JOIN {p}fi f ON f.user_id = t.user_id AND tier = best ANTI JOIN sn ON sn.user_id = t.user_id AND sn.item_id = t.item_id),
    {p}pl AS (SELECT u.user_id, dataset_user_id IS NOT NULL AS mapped, NOT is_active AS failed, best, coalesce(c, 0) AS held FROM users u LEFT JOIN {p}fi f ON f.user_id = u.user_id
        LEFT JOIN (SELECT user_id, count(*) AS c FROM {p}ch GROUP BY user_id) k ON k.user_id = u.user_id),
    {p}al AS (SELECT user_id, item_id, source, rank, 0 AS step FROM {p}ch UNION ALL SELECT ex.user_id, ex.item_id, 'explore', rank, 1 FROM ex JOIN {p}pl l ON l.user_id = ex.user_id AND held < 5
        ANTI JOIN sn ON sn.user_id = ex.user_id AND sn.item_id = ex.item_id ANTI JOIN {p}ch c ON c.user_id = ex.user_id AND c.item_id = ex.item_id),
    {p}oo AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step, rank, CAST(item_id AS VARCHAR)) - 1 AS place FROM {p}al)"""


_FALL = MERGED + f""", tr AS (SELECT user_id, item_id, primary_source AS source, 0 AS tier, row_number() OVER (PARTITION BY user_id ORDER BY CAST(item_id AS VARCHAR)) - 1 AS rank
        FROM un WHERE primary_source <> 'explore' AND user_id IN (SELECT user_id FROM train_pairs)
        UNION ALL SELECT user_id, item_id, 'svd', 1, row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1 FROM candidates WHERE source = 'svd'
        UNION ALL SELECT user_id, item_id, 'popular', 2, row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1 FROM candidates WHERE source = 'popular'),
    po AS (SELECT * FROM tr WHERE tier = 2),
    ex AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1 AS rank FROM candidates WHERE source = 'explore'),
    sn AS ({_SEEN}), {_fall_sql('', 'tr')}, {_fall_sql('p', 'po')},
    pe AS (SELECT oo.user_id, 'personalized' AS feed_type, item_id, source, place AS rank, CASE WHEN best = 1 THEN 'unified_model_unavailable_svd_fallback'
        WHEN coalesce(best, 2) = 2 AND mapped AND failed THEN 'deep_model_failed_popular_fallback' WHEN coalesce(best, 2) = 2 AND NOT mapped THEN 'cold_start'
        WHEN coalesce(best, 2) = 2 THEN 'personalized_model_unavailable' WHEN held < 5 THEN 'candidate_shortfall' END AS fallback_reason FROM oo JOIN pl ON pl.user_id = oo.user_id WHERE place < 5),
    ep AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank) - 1 AS place FROM (SELECT ex.* FROM ex ANTI JOIN sn ON sn.user_id = ex.user_id AND sn.item_id = ex.item_id)),
    fd AS (SELECT * FROM pe UNION ALL SELECT user_id, 'popular', item_id, source, place, NULL FROM poo WHERE place < 5
        UNION ALL SELECT user_id, 'explore', item_id, 'explore', place, NULL FROM ep WHERE place < 5)"""


@query("fallback_plan", _FALL + " SELECT user_id, item_id, source, rank, fallback_reason FROM pe")
def _(t):
    rows = feeds.fallback_plan(serving_users(t), *served_sources(t), B.seen_pairs(t.behaviour), 5)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query("feed_lists", _FALL + " SELECT * FROM fd")
def _(t):
    rows = feeds.feed_lists(serving_users(t), *served_sources(t), B.seen_pairs(t.behaviour), 5)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


NOW, TTL = 946684800000, 30


def heads(t, lists):
    return feeds.snapshot_heads(serving_users(t), lists, NOW, 42, "m1", TTL)


@query(
    "feed_snapshots",
    _FALL + f""", rs AS (SELECT DISTINCT user_id, feed_type, fallback_reason FROM fd WHERE fallback_reason IS NOT NULL),
    hd AS (SELECT user_id, feed_type, ('0x' || substr(sha256(concat_ws(':', '42', user_id, feed_type)), 1, 8))::UBIGINT::BIGINT % 2147483648 AS seed
        FROM users CROSS JOIN (VALUES ('personalized'), ('popular'), ('explore')) f(feed_type))
    SELECT substr(sha256(concat_ws(':', 'snapshot', hd.user_id, hd.feed_type, '{NOW}', seed)), 1, 32) AS snapshot_id, hd.user_id, hd.feed_type, 'm1' AS model_version, seed, fallback_reason,
        {NOW} AS created_ms, {NOW + TTL * V.MINUTE_MS} AS expires_ms FROM hd LEFT JOIN rs ON rs.user_id = hd.user_id AND rs.feed_type = hd.feed_type""",
)
def _(t):
    lists = feeds.feed_lists(serving_users(t), *served_sources(t), B.seen_pairs(t.behaviour), 5)
    return heads(t, lists)


def feed_pools(t, factored, unified, seen, limit):
    """svd, popular and explore rows of the feeds, each as deep as its user needs: ``limit`` rows beside the seen ones, of online items."""
    from ..operators import vectors

    online = t.items.filter(F.col("status") == "online").select("item_id").distinct()
    held = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("held"))
    needs = materialise(t.users.select("user_id").distinct().join(held, "user_id", "left").select("user_id", (F.coalesce("held", F.lit(0)) + limit).alias("n")))
    # factors alone serve users whom the unified model does not
    served = unified.select("user_id").distinct().withColumn("served", F.lit(True))
    left = serving_users(t).join(served, "user_id", "left").filter(F.col("dataset_user_id").isNotNull() & (F.col("model_failed") | F.col("served").isNull()))
    users, items = factored
    best = vectors.top_items_per_user(
        users.join(left.select("user_id"), "user_id", "left_semi"), items.join(online, "item_id", "left_semi"), limit, skip=seen
    )
    features = popularity.popularity_features(train_events(t), train_cut(t)).join(online, "item_id", "left_semi")
    rows = {
        "svd": best, "popular": popularity.popular_walk(needs, features),
        "explore": popularity.explore_walk(needs, popularity.exposure_counts(t.items, t.exposures), 7),
    }
    return [rows[n].select("user_id", "item_id", F.lit(n).alias("source"), F.col("rank").cast("int").alias("rank")) for n in ("svd", "popular", "explore")]


@query("build_feeds")
def _(t):
    """All three feeds from the recall chain, as rows of their snapshots."""
    limit = 100
    factored = [materialise(side) for side in svd(t)]
    union = merge.merge_sources(materialise(recalled(t, factored))).select("user_id", "item_id", "primary_source", "is_cold", "scores", "mask")
    seen = materialise(B.seen_pairs(t.behaviour))
    unified = materialise(feeds.ranked_union(B.exclude_seen(B.online_only(union, t.items), seen), limit=limit))
    lists = materialise(feeds.feed_lists(serving_users(t), unified, *feed_pools(t, factored, unified, seen, limit), seen, limit, t.items))
    boosts = None
    for feed in V.FEEDS:
        part = mixing.active_boosts(campaigns(t), t.users, feed, 1500).withColumn("feed_type", F.lit(feed))
        boosts = part if boosts is None else boosts.unionByName(part)
    return feeds.build_feeds(lists, heads(t, lists), t.items, boosts, limit)


@query(
    "expire_snapshots",
    f"""SELECT count(*) FILTER (created_ms + {30 * V.DAY_MS} <= 883612800000) AS deleted_expired_snapshots,
        count(*) FILTER (created_ms + {30 * V.DAY_MS} > 883612800000) AS retained_active_snapshots FROM requests""",
)
def _(t):
    made = t.requests.select(F.col("request_id").alias("snapshot_id"), (F.col("created_ms") + 30 * V.DAY_MS).alias("expires_ms"))
    return feeds.expire_snapshots(made, 883612800000)[1]


def snapshots(t):
    """Served requests as snapshots: one row per position, some invalidated."""
    return t.served_lines.select(
        F.col("request_id").alias("snapshot_id"), "user_id", "item_id", "position",
        F.array(*[F.lit(s) for s in V.SOURCES])[(F.col("l_suppkey") % 7).cast("int")].alias("source"),
        "created_ms", "feed_type", F.when(F.col("l_tax") >= 0.07, F.col("created_ms") + 1).alias("invalidated_ms"),
    )


_SNAP = """sn AS (SELECT request_id AS snapshot_id, user_id, item_id, position, CASE WHEN l_tax >= 0.07 THEN 1 END AS inv FROM served_lines),
    vs AS (SELECT sn.* FROM sn JOIN items USING (item_id) WHERE inv IS NULL AND status = 'online')"""


@query("feed_pages", _SNAP + " SELECT snapshot_id, user_id, item_id, position AS snapshot_position, row_number() OVER (PARTITION BY snapshot_id ORDER BY position) - 1 AS position FROM vs WHERE position >= 1 AND position < 4")
def _(t):
    rows, _pages = feeds.feed_pages(snapshots(t), t.items, 1, 3)
    return rows.drop("source").withColumn("position", F.col("position").cast("bigint")).withColumn("snapshot_position", F.col("snapshot_position").cast("bigint"))


@query(
    "page_requests",
    _SNAP + """ SELECT s.snapshot_id, s.user_id, coalesce(max(c), 0) AS returned_count, CAST(coalesce(max(l) >= 4, FALSE) AS INTEGER) AS has_more
    FROM (SELECT DISTINCT snapshot_id, user_id FROM sn) s LEFT JOIN (SELECT snapshot_id, count(*) FILTER (position >= 1 AND position < 4) AS c, max(position) AS l
        FROM vs GROUP BY snapshot_id) v USING (snapshot_id) GROUP BY s.snapshot_id, s.user_id""",
)
def _(t):
    _rows, pages = feeds.feed_pages(snapshots(t), t.items, 1, 3)
    return pages.withColumn("has_more", F.col("has_more").cast("int"))


def operations(t):
    """Status changes of items, from the orders that returned them."""
    rows = t.raw("lineitem").join(t.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderstatus"), "l_orderkey")
    return rows.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)).select(
        F.col("l_partkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", "offline").otherwise("online").alias("status"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at_ms"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("operation_id"),
    )


_OPS = """op AS (SELECT l_partkey AS item_id, CASE WHEN o_orderstatus = 'F' THEN 'offline' ELSE 'online' END AS status, epoch_ms(o_orderdate) AS at_ms,
    l_orderkey * 8 + l_linenumber AS operation_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 45)"""


@query(
    "invalidate_snapshots",
    _OPS + """, sn AS (SELECT request_id AS snapshot_id, item_id, position, created_ms, CASE WHEN l_tax >= 0.07 THEN created_ms + 1 END AS inv FROM served_lines)
    SELECT snapshot_id, position, coalesce(any_value(inv), min(at_ms)) AS invalidated_ms FROM sn LEFT JOIN op ON op.item_id = sn.item_id AND op.status = 'offline' AND at_ms >= created_ms
    GROUP BY snapshot_id, position""",
)
def _(t):
    return feeds.invalidate_snapshots(snapshots(t), operations(t)).select("snapshot_id", F.col("position").cast("bigint").alias("position"), "invalidated_ms")


def manifests(t):
    """Candidate manifests of the served rows, with JSON score arrays."""
    row = snapshots(t)
    cells = F.to_json(F.array(*[F.when(F.col("source") == n, 1.0).otherwise(0.0) for n in V.SOURCES]))
    return row.select("snapshot_id", "item_id", F.col("source").alias("primary_source"), cells.alias("source_scores_json"))


@query(
    "exposure_labels",
    """ac AS (SELECT request_id, item_id, max(event_type = 'impression') AS imp, max(event_type = 'click') AS clk, max(event_type IN ('like', 'share')) AS pos,
        max(CASE WHEN event_type = 'dwell' THEN dwell_ms ELSE 0 END) AS dw FROM behaviour GROUP BY request_id, item_id)
    SELECT s.request_id AS snapshot_id, s.item_id, dataset_user_id, round(CASE WHEN imp THEN greatest(CASE WHEN pos THEN 1.0 ELSE 0.0 END, CASE WHEN clk THEN 0.8 ELSE 0.0 END,
        least(0.8, dw / 30000.0)) END, 6)::DOUBLE AS label, round(CASE WHEN imp THEN least(3.0, sqrt(position + 1.0)) END, 6) AS sample_weight
    FROM served_lines s JOIN users u ON u.user_id = s.user_id LEFT JOIN ac ON ac.request_id = s.request_id AND ac.item_id = s.item_id
    WHERE dataset_user_id IS NOT NULL AND feed_type = 'personalized' AND created_ms <= 978307200000 - 86400000""",
)
def labels(t):
    rows = snapshots(t)
    heads = rows.select("snapshot_id", "user_id", "feed_type", "created_ms").distinct()
    shown = rows.select("snapshot_id", F.col("snapshot_id").alias("request_id"), "user_id", "item_id", "position")
    out = training.exposure_labels(manifests(t), heads, t.users, shown, t.behaviour, 978307200000)
    return rounded(out.select("snapshot_id", "item_id", "dataset_user_id", "label", "sample_weight"), "label", "sample_weight")


@query(
    "label_audit",
    """ac AS (SELECT request_id, item_id, max(event_type = 'impression') AS imp, max(event_type IN ('like', 'share', 'click')) AS pos,
        max(CASE WHEN event_type = 'dwell' THEN dwell_ms ELSE 0 END) AS dw FROM behaviour GROUP BY request_id, item_id),
    lb AS (SELECT imp, imp AND (pos OR dw > 0) AS p FROM served_lines s JOIN users u ON u.user_id = s.user_id LEFT JOIN ac ON ac.request_id = s.request_id AND ac.item_id = s.item_id
        WHERE dataset_user_id IS NOT NULL AND feed_type = 'personalized' AND created_ms <= 978307200000 - 86400000)
    SELECT count(*) AS candidate_rows, count(*) FILTER (imp) AS labeled_rows, count(*) FILTER (p) AS positive_rows, count(*) FILTER (imp AND NOT p) AS negative_rows,
        count(*) FILTER (imp IS NULL OR NOT imp) AS unlabeled_rows, 'usable' AS status FROM lb""",
)
def _(t):
    return training.label_audit(labels(t))


@query(
    "exposure_training_rows",
    FEATURES + """, ac AS (SELECT request_id, item_id, max(event_type = 'impression') AS imp FROM behaviour GROUP BY request_id, item_id),
    lb AS (SELECT dataset_user_id AS user_id, s.item_id FROM served_lines s JOIN users u ON u.user_id = s.user_id JOIN ac ON ac.request_id = s.request_id AND ac.item_id = s.item_id
        WHERE imp AND dataset_user_id IS NOT NULL AND feed_type = 'personalized' AND created_ms <= 978307200000 - 86400000)
    SELECT popularity_bucket, history_bucket, primary_code, count(*) AS n FROM lb JOIN ft ON ft.user_id = lb.user_id AND ft.item_id = lb.item_id GROUP BY ALL""",
)
def _(t):
    rows = labels(t).withColumn("feature_schema_version", F.lit(V.FEATURE_SCHEMA))
    wide = F.from_json("source_scores_json", "array<double>").alias("scores")
    kept = rows.join(manifests(t).select("snapshot_id", "item_id", wide), ["snapshot_id", "item_id"]).withColumn("mask", F.col("scores"))
    joined = training.exposure_training_rows(kept, features(t))
    return joined.groupBy("popularity_bucket", "history_bucket", "primary_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "hard_negatives",
    MERGED + f""", lk AS (SELECT DISTINCT user_id, item_id FROM behaviour WHERE event_type = 'like'),
    pl AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(greatest({', '.join('s_' + n for n in V.SOURCES)}), 9) DESC, item_id) - 1 AS slot,
        count(*) OVER (PARTITION BY user_id) AS size FROM (SELECT un.* FROM un ANTI JOIN lk ON lk.user_id = un.user_id AND lk.item_id = un.item_id)),
    ps AS (SELECT lk.user_id, lk.item_id, size, CAST(floor({unit_sql("'42:replay-hard'", 'lk.user_id', 'lk.item_id')} * size) AS BIGINT) AS start
        FROM lk JOIN un ON un.user_id = lk.user_id AND un.item_id = lk.item_id JOIN (SELECT DISTINCT user_id, size FROM pl WHERE size >= 4) z ON z.user_id = lk.user_id)
    SELECT ps.user_id, ps.item_id, k, pl.item_id AS negative_id FROM ps CROSS JOIN (VALUES (0), (1), (2), (3)) v(k) JOIN pl ON pl.user_id = ps.user_id AND pl.slot = (start + k) % ps.size""",
)
def _(t):
    liked = t.behaviour.filter(F.col("event_type") == "like").select("user_id", "item_id").distinct()
    return training.hard_negatives(merged(t), liked, liked)


@query("weighted_negatives")
def _(t):
    train = train_rows(t)
    return training.weighted_negatives(train, train, train)


@query("ranker_auc")
def _(t):
    """Factorisation machine and linear baseline on liked against other candidates, by AUC."""
    liked = t.behaviour.filter(F.col("event_type") == "like").select("user_id", "item_id").distinct().withColumn("label", F.lit(1.0))
    rows = materialise(features(t).join(liked, ["user_id", "item_id"], "left").na.fill(0.0, ["label"]).withColumn("weight", F.lit(1.0)))
    stacked = None
    for kind in ("fm", "linear"):
        scored = training.ranker_score(training.ranker_train(rows, kind), rows).select(
            F.lit(kind).alias("model"), "score", F.col("label").cast("int").alias("label")
        )
        stacked = scored if stacked is None else stacked.unionByName(scored)
    return E.auc(stacked, ["model"])
