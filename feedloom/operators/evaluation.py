"""Evaluation queries, sampled negatives and ranking metrics.

A query set is a long table (user_id, item_id, label); scores come as (user_id, item_id, score),
with a scorer column when several are compared. All users are evaluated at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.exprs import hash_uniform, ratio, score_key
from ..functions.grouping import dense_index, top_n
from .popularity import popularity_score
from .split import content_digest, select_users

MULTIPLIERS = 64


def coprime_multipliers(n: int) -> list[int]:
    """Up to 64 steps coprime to n, from 0.382 n upwards; each walks all of 0..n-1 without repeats."""
    start = max(1, int(0.382 * n))
    return [c for c in range(start, start + 4096) if math.gcd(c, n) == 1][:MULTIPLIERS]


def sample_negatives(
    users: DataFrame, excluded: DataFrame, universe: DataFrame, count: int, seed: int, purpose: str
) -> DataFrame:
    """user_id, item_id: exactly ``count`` distinct items outside the user's exclusions.

    ``users`` has user_id and h, the number of excluded items inside the universe; users with fewer
    than ``count`` other items get none. A user's draws are an arithmetic walk through the numbered
    universe with a step coprime to its size: they never repeat, so the first ``count + h`` of them
    must hold ``count`` allowed items. Work is users * count plus the size of the exclusions, never
    users * catalog, and no draw has to be repeated.
    """
    index = dense_index(universe.select("item_id").distinct(), "item_id")
    n = index.count()
    if n == 0:
        return excluded.select("user_id", "item_id").limit(0)
    steps = F.array(*[F.lit(c) for c in coprime_multipliers(n)])
    pick = F.floor(hash_uniform(seed, purpose, "step", F.col("user_id")) * F.size(steps)).cast("int")
    start = F.floor(hash_uniform(seed, purpose, "start", F.col("user_id")) * n).cast("bigint")
    last = F.least(F.lit(count) + F.col("h"), F.lit(n)) - 1
    draws = (
        users.filter(F.lit(n) - F.col("h") >= count)
        .select("user_id", steps[pick].cast("bigint").alias("step"), start.alias("start"), last.cast("bigint").alias("last"))
        .select("user_id", "step", "start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("j"))
        .select("user_id", "j", ((F.col("step") * F.col("j") + F.col("start")) % n).alias("item_index"))
    )
    allowed = draws.join(index, "item_index").select("user_id", "item_id", "j").join(
        excluded.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti"
    )
    return top_n(allowed, ["user_id"], [F.col("j")], count).select("user_id", "item_id")


def eval_queries(
    targets: DataFrame, known: DataFrame, users: DataFrame, universe: DataFrame, *, purpose: str, seed: int,
    limit: int | None = None, negatives: int = V.NEGATIVES,
) -> DataFrame:
    """Queries with sampled negatives: user_id, item_id, label.

    Positives are the targets of known users inside ``universe``: the model's items for the warm
    protocol, the whole catalog for the all-items protocol. A user takes part with at least one
    positive and ``negatives`` unseen items.
    """
    inside = universe.select("item_id").distinct()
    members = users.select("user_id").distinct()
    positives = (
        targets.select("user_id", "item_id").distinct()
        .join(inside, "item_id", "left_semi").join(members, "user_id", "left_semi").select("user_id", "item_id")
    )
    with_positives = positives.select("user_id").distinct()
    excluded = (
        known.select("user_id", "item_id").unionByName(positives).distinct()
        .join(inside, "item_id", "left_semi").join(with_positives, "user_id", "left_semi").select("user_id", "item_id")
    )
    size = inside.agg(F.count(F.lit(1))).scalar()
    sizes = excluded.groupBy("user_id").agg(F.count(F.lit(1)).alias("h")).filter(size - F.col("h") >= negatives)
    chosen = sizes if limit is None else sizes.join(
        select_users(sizes, seed, f"evaluate-{purpose}", limit), "user_id", "left_semi"
    )
    sampled = sample_negatives(chosen, excluded, inside, negatives, seed, purpose)
    kept = positives.join(chosen.select("user_id"), "user_id", "left_semi")
    return kept.select("user_id", "item_id", F.lit(1).alias("label")).unionByName(
        sampled.select("user_id", "item_id", F.lit(0).alias("label"))
    )


def cohort_stats(targets: DataFrame, known: DataFrame, users: DataFrame, universe: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: target and scorable positives, coverage, eligible and evaluated users."""
    inside = universe.select("item_id").distinct().withColumn("__in", F.lit(1))
    pairs = targets.select("user_id", "item_id").distinct().join(users.select("user_id").distinct(), "user_id", "left_semi")
    marked = pairs.join(inside, "item_id", "left")
    per_user = marked.groupBy("user_id").agg(F.count(F.lit(1)).alias("t"), F.count("__in").alias("s"))
    both = (
        known.select("user_id", "item_id").unionByName(pairs).distinct()
        .join(inside.select("item_id"), "item_id", "left_semi")
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("h"))
    )
    size = inside.agg(F.count(F.lit(1))).scalar()
    joined = per_user.join(both, "user_id", "left")
    eligible = (F.col("s") > 0) & (size - F.coalesce("h", F.lit(0)) >= V.NEGATIVES)
    evaluated = queries.select("user_id").distinct().agg(F.count(F.lit(1))).scalar()
    return joined.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("target_positives"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("scorable_positives"),
        F.count_if(F.col("s") > 0).alias("users_with_positives"),
        F.count_if(eligible).alias("eligible_users"),
    ).select(
        "*", evaluated.alias("evaluated_users"),
        ratio(F.col("scorable_positives"), F.col("target_positives")).alias("item_coverage"),
    )


def catalog_queries(
    targets: DataFrame, known: DataFrame, catalog: DataFrame, allowed: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Unsampled protocol: positives per user, and the items a user must not be scored on
    (known items that are not positives)."""
    inside = catalog.select("item_id").distinct()
    positives = targets.select("user_id", "item_id").distinct().join(inside, "item_id", "left_semi")
    if allowed is not None:
        positives = positives.join(allowed.select("item_id").distinct(), "item_id", "left_semi")
    excluded = (
        known.select("user_id", "item_id").distinct().join(inside, "item_id", "left_semi")
        .join(positives.select("user_id").distinct(), "user_id", "left_semi")
        .join(positives, ["user_id", "item_id"], "left_anti")
    )
    return positives.select("user_id", "item_id"), excluded.select("user_id", "item_id")


def _ideal(k: int) -> Column:
    """Best possible gain for 1..k positives as a constant lookup."""
    total, values = 0.0, []
    for rank in range(1, k + 1):
        total += 1.0 / math.log2(rank + 1)
        values.append(F.lit(total))
    return F.array(*values)


def query_metrics(scored: DataFrame, keys: list[str], k: int = V.METRIC_K) -> DataFrame:
    """Recall, NDCG and hit rate at k per query. Ranks follow score, then item id."""
    window = Window.partitionBy(*keys, "user_id").orderBy(score_key("score").desc(), F.col("item_id"))
    hit = (F.col("label") == 1) & (F.col("rank") <= k)
    per_query = (
        scored.withColumn("rank", F.row_number().over(window))
        .groupBy(*keys, "user_id")
        .agg(
            F.count_if(hit).alias("hits"),
            F.sum("label").alias("positives"),
            F.sum(F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"),
        )
        .filter(F.col("positives") > 0)
    )
    return query_shares(per_query, keys, k)


def query_shares(per_query: DataFrame, keys: list[str], k: int = V.METRIC_K) -> DataFrame:
    """Recall, NDCG and hit rate from the hits, positives and gain of each query."""
    best = _ideal(k)[F.least(F.col("positives"), F.lit(k)).cast("int") - 1]
    return per_query.select(
        *keys, "user_id", "positives",
        (F.col("hits") / F.col("positives")).alias("recall"),
        (F.col("gain") / best).alias("ndcg"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hitrate"),
    )


def ranking_metrics(scored: DataFrame, keys: list[str] | None = None, k: int = V.METRIC_K) -> DataFrame:
    """Macro means over queries; zeros when there is no query and no grouping."""
    return mean_metrics(query_metrics(scored, keys or [], k), keys or [])


def mean_metrics(per_query: DataFrame, keys: list[str]) -> DataFrame:
    """Macro means over the shares of each query."""
    means = per_query.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("positives").alias("positives"),
        *[F.coalesce(F.avg(name), F.lit(0.0)).alias(name) for name in ("recall", "ndcg", "hitrate")],
    )
    return means.na.fill(0, ["positives"])


def catalog_metrics(top: DataFrame, positives: DataFrame, k: int = V.METRIC_K) -> DataFrame:
    """Metrics from each user's k best catalog items (user_id, item_id, rank from 0)."""
    wanted = positives.withColumn("__p", F.lit(1))
    found = top.filter(F.col("rank") < k).join(wanted, ["user_id", "item_id"]).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("hits"), F.sum(1.0 / F.log2(F.col("rank") + 2.0)).alias("gain")
    )
    sizes = positives.groupBy("user_id").agg(F.count(F.lit(1)).alias("positives"))
    rows = sizes.join(found, "user_id", "left").na.fill(0, ["hits"]).na.fill(0.0, ["gain"])
    best = _ideal(k)[F.least(F.col("positives"), F.lit(k)).cast("int") - 1]
    return rows.agg(
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.avg(F.col("hits") / F.col("positives")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg(F.col("gain") / best), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)), F.lit(0.0)).alias("hitrate"),
    )


def popularity_bucket(count: Column) -> Column:
    return (
        F.when(count.isNull() | (count <= 0), "cold").when(count == 1, "tail_1")
        .when(count <= 4, "tail_2_4").otherwise("head_5_plus")
    )


BUCKETS = ("cold", "tail_1", "tail_2_4", "head_5_plus")


def bucket_metrics(scored: DataFrame, counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Metrics per popularity bucket of the positives; negatives stay in every bucket of their query.

    ``counts`` has item_id and cumulative. Queries without a positive in the bucket drop out.
    """
    keys = keys or []
    known = scored.join(counts.select("item_id", "cumulative"), "item_id", "left")
    buckets = F.when(F.col("label") == 1, F.array(popularity_bucket(F.col("cumulative")))).otherwise(
        F.array(*[F.lit(b) for b in BUCKETS])
    )
    return ranking_metrics(known.withColumn("bucket", F.explode(buckets)), [*keys, "bucket"])


def badcases(scored: DataFrame, k: int = V.METRIC_K, limit: int = 5) -> DataFrame:
    """First queries (by user id) with a positive below rank k, with anonymous ids."""

    def anonymous(prefix: str, ident: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit("evaluation"), F.lit(prefix), ident.cast("string")), 256)
        return F.concat(F.lit(prefix + "-"), F.substring(digest, 1, 10))

    window = Window.partitionBy("user_id").orderBy(score_key("score").desc(), F.col("item_id"))
    positive = F.col("label") == 1
    per_query = (
        scored.withColumn("rank", F.row_number().over(window))
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("candidate_count"),
            F.array_sort(F.collect_list(F.when(positive, F.struct("item_id", "rank")))).alias("p"),
            F.min(F.when(positive, F.col("rank"))).alias("best"),
            F.max(F.when(positive, F.col("rank"))).alias("worst"),
        )
        .filter(F.col("worst") > k)
        .orderBy("user_id")
        .limit(limit)
    )
    return per_query.select(
        anonymous("u", F.col("user_id")).alias("user_id"),
        "candidate_count",
        F.size("p").cast("bigint").alias("positive_count"),
        F.transform("p", lambda e: anonymous("i", e["item_id"])).alias("positive_item_ids"),
        F.transform("p", lambda e: e["rank"]).alias("positive_ranks"),
        F.when(F.col("best") > k, "no_positive_in_top_k").otherwise("some_positives_below_top_k").alias("reason"),
    )


def popularity_by_half_life(events: DataFrame, cutoff, half_lives=V.HALF_LIVES) -> DataFrame:
    """item_id, half_life, score for every half-life in one pass over the events."""
    age = F.lit(cutoff) - F.col("ts_ms")
    decays = [F.sum(F.exp(F.lit(-math.log(2.0)) * age / (h * V.DAY_MS))).alias(f"d{i}") for i, h in enumerate(half_lives)]
    wide = events.filter(F.col("ts_ms") <= cutoff).groupBy("item_id").agg(
        F.count(F.lit(1)).cast("double").alias("cumulative"), *decays
    )
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("half_life"), F.col(f"d{i}").alias("decay"))
                               for i, h in enumerate(half_lives)]))
    long = wide.select("item_id", "cumulative", rows.alias("e")).select("item_id", "cumulative", "e.half_life", "e.decay")
    return long.withColumn("score", popularity_score())


def half_life_selection(queries: DataFrame, scores: DataFrame) -> DataFrame:
    """Metrics per half-life and the chosen one: best NDCG, then recall, then the shorter half-life."""
    lives = scores.select("half_life").distinct().agg(F.collect_set("half_life").alias("all"))
    rows = queries.withColumn("all", lives.scalar()).select("user_id", "item_id", "label", F.explode("all").alias("half_life"))
    scored = rows.join(scores.select("item_id", "half_life", "score"), ["item_id", "half_life"], "left").na.fill(0.0, ["score"])
    metrics = ranking_metrics(scored, ["half_life"])
    best = metrics.agg(
        F.max(F.struct(score_key("ndcg"), score_key("recall"), -F.col("half_life"), F.col("half_life").alias("chosen"))).alias("b")
    ).select("b.chosen")
    return metrics.withColumn("selected", (F.col("half_life") == best.scalar()).cast("int"))


def random_scores(queries: DataFrame, seed: int) -> DataFrame:
    """Reproducible score per (user, item)."""
    return queries.withColumn("score", hash_uniform(seed, F.col("user_id"), F.col("item_id")))


def hybrid_scores(scored: DataFrame, warm: int = 7, cold: int = 3) -> DataFrame:
    """Model scores with content for items the model does not know: rows with ``score`` in place of the three scores.

    ``scored``: user_id, item_id, label, model (null for unknown items), content, popular. Where a user has unknown items
    with a content score, the first ``warm`` by model and the first ``cold`` of those by content lead, the rest follows
    by 0.55 model + 0.35 content + 0.10 popularity, each as a share of its rank; the score is the place from the end.
    Other users keep the model's scores. Lists are query sets, bounded by their protocol.
    """
    unknown = -1e12
    model = F.coalesce("model", F.lit(unknown))
    usable = F.col("model").isNull() & (F.col("content") > 0)
    user = Window.partitionBy("user_id")

    def rank(score: str | Column, *more: Column) -> Column:
        return F.row_number().over(Window.partitionBy("user_id", *more).orderBy(score_key(score).desc(), "item_id")) - 1

    rows = scored.withColumn("__m", model).withColumn("__cold", usable).withColumn("__known", F.col("model").isNotNull())
    rows = rows.withColumns({
        "__n": F.count(F.lit(1)).over(user), "__colds": F.count_if("__cold").over(user), "__warms": F.least(F.count_if("__known").over(user), F.lit(warm)),
        "__rm": rank("__m"), "__rc": rank("content"), "__rp": rank("popular"),
        "__w": F.when(F.col("__known"), rank("__m", F.col("__known"))), "__c": F.when(F.col("__cold"), rank("content", F.col("__cold"))),
    })
    share = lambda c: F.when(F.col("__n") <= 1, 1.0).otherwise(1.0 - F.col(c) / F.greatest(F.lit(1), F.col("__n") - 1))
    lead = F.when(F.col("__w") < warm, F.col("__w")).when(F.col("__c") < cold, F.col("__warms") + F.col("__c"))
    rows = rows.withColumn("__b", 0.55 * share("__rm") + 0.35 * share("__rc") + 0.10 * share("__rp")).withColumn("__lead", lead)
    place = Window.partitionBy("user_id").orderBy(F.col("__lead").asc_nulls_last(), score_key("__b").desc(), "item_id")
    rows = rows.withColumn("__place", F.row_number().over(place) - 1)
    score = F.when(F.col("__colds") == 0, F.col("__m")).otherwise((F.col("__n") - F.col("__place")).cast("double"))
    return rows.select(*[c for c in scored.columns if c not in ("model", "content", "popular")], score.alias("score"))


def query_set_digest(queries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Digest of a query set, independent of row order."""
    return content_digest(queries, keys or ["user_id", "item_id", "label"])


def cohort_match(left: DataFrame, right: DataFrame, left_metrics: DataFrame, right_metrics: DataFrame,
                 tolerance: float = 1e-12) -> DataFrame:
    """Two evaluations are comparable only over equal query sets; then their metrics must agree."""
    names = ("recall", "ndcg", "hitrate")
    a, b = query_set_digest(left), query_set_digest(right)
    joined = a.select(F.col("digest").alias("left_digest"), *[left_metrics.select(n).scalar().alias(f"l_{n}") for n in names])
    joined = joined.withColumn("right_digest", b.select("digest").scalar())
    for n in names:
        joined = joined.withColumn(f"r_{n}", right_metrics.select(n).scalar())
    same = F.col("left_digest") == F.col("right_digest")
    close = F.lit(True)
    for n in names:
        close = close & (F.abs(F.col(f"l_{n}") - F.col(f"r_{n}")) <= tolerance)
    return joined.select(same.alias("comparable"), (same & close).alias("equal"))


def metric_key_compat(reports: DataFrame, column: str = "metrics_json", name: str = "recall") -> DataFrame:
    """Value of the all-items cohort under its present or its old key."""
    new = F.get_json_object(column, f"$.sampled_all_items.{name}")
    old = F.get_json_object(column, f"$.full_catalog.{name}")
    return reports.withColumn(name, F.coalesce(new, old).cast("double"))


def policy_gate(metrics: DataFrame) -> DataFrame:
    """Checks on rows (policy, scope, recall, ndcg): dynamic keeps 99 % of safe everywhere and the sum does not drop."""
    cells = metrics.groupBy().agg(
        *[
            F.max(F.when((F.col("policy") == p) & (F.col("scope") == s), F.col(m))).alias(f"{p}_{s}_{m}")
            for p in ("safe", "dynamic") for s in ("full", "warm") for m in ("recall", "ndcg")
        ]
    )
    parts = [(s, m) for s in ("full", "warm") for m in ("recall", "ndcg")]
    checks = {
        f"{s}_{m}_within_1pct": F.col(f"dynamic_{s}_{m}") >= 0.99 * F.col(f"safe_{s}_{m}") for s, m in parts
    }
    total = lambda p: sum((F.col(f"{p}_{s}_{m}") for s, m in parts), F.lit(0.0))
    checks["composite_not_worse"] = total("dynamic") >= total("safe")
    every = F.lit(True)
    for check in checks.values():
        every = every & check
    return cells.select(
        *[check.cast("int").alias(name) for name, check in checks.items()],
        F.when(every, V.DYNAMIC_POLICY).otherwise(V.SAFE_POLICY).alias("selected_policy"),
    )


def auc(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums with mean ranks for ties.

    Scores are counted per distinct value first; cumulative counts run over coarse score buckets,
    then inside a bucket, so no task orders all rows.
    """
    keys = keys or []
    group = [*keys, "__s"]
    by_score = scored.withColumn("__s", score_key("score")).groupBy(*group).agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")
    )
    bucket = F.floor(F.col("__s") * 1024)
    totals = by_score.groupBy(*keys, bucket.alias("__b")).agg(F.sum("n").alias("bn"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("below", F.coalesce(F.sum("bn").over(before), F.lit(0))).drop("bn")
    inside = Window.partitionBy(*keys, "__b").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    rows = by_score.withColumn("__b", bucket).withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    joined = rows.join(carried, [*keys, "__b"])
    wins = F.col("p") * (F.col("below") + F.col("inner") + F.col("n") / 2.0)
    return joined.groupBy(*keys).agg(
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(wins).alias("wins")
    ).select(*keys, "positives", "negatives", ratio(F.col("wins"), F.col("positives") * F.col("negatives")).alias("auc"))
