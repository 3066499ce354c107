"""Union of candidate sources with evidence per source, and the orders built on the union.

Candidates: user_id, item_id, source, raw_score, eligible, confidence, support, is_cold. At most one
row per (user, item, source). Ties in these orders go to the text form of the item id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.exprs import bucket_of, calibrate, finite, rank_share, score_key
from ..functions.grouping import top_n

TEXT_ID = "cast(item_id as string)"


def at(name: str) -> int:
    """Index of a source in the seven-wide arrays."""
    return V.SOURCES.index(name)


def _by_source(values: Mapping[str, float]) -> Column:
    expr = F.lit(None).cast("double")
    for name, value in values.items():
        expr = F.when(F.col("source") == name, F.lit(float(value))).otherwise(expr)
    return expr


def usable_candidate() -> Column:
    """Eligible and finite; item-CF rows also need a positive score and support."""
    weak_cf = (F.col("source") == "item_cf") & ((F.col("raw_score") <= 0) | (F.col("support") <= 0))
    return F.coalesce(F.col("eligible"), F.lit(False)) & finite(F.col("raw_score")) & ~F.coalesce(weak_cf, F.lit(False))


def confident(thresholds: Mapping[str, float] | None = None) -> Column:
    limits = {**V.SOURCE_MIN_CONFIDENCE, **(thresholds or {})}
    return finite(F.col("confidence")) & (F.col("confidence") >= _by_source(limits))


def admit_candidates(
    candidates: DataFrame, limits: Mapping[str, int] | None = None, thresholds: Mapping[str, float] | None = None
) -> DataFrame:
    """Best rows per (user, source) with rank_in_source and normalized_score.

    The largest limit is applied before the shuffle, each source's own limit behind it.
    """
    sizes = {**V.SOURCE_LIMITS, **(limits or {})}
    order = [score_key("raw_score").desc(), F.expr(TEXT_ID)]
    ranked = top_n(
        candidates.filter(usable_candidate() & confident(thresholds)), ["user_id", "source"], order,
        max(sizes.values()), "rank_in_source",
    ).filter(F.col("rank_in_source") < _by_source(sizes))
    group = Window.partitionBy("user_id", "source")
    return ranked.withColumn(
        "normalized_score", rank_share(F.col("rank_in_source"), F.count(F.lit(1)).over(group))
    )


def merge_sources(
    candidates: DataFrame, limits: Mapping[str, int] | None = None, thresholds: Mapping[str, float] | None = None
) -> DataFrame:
    """One row per (user, item): seven-wide arrays in source order and the primary source.

    The primary source has the highest normalised score, the earlier source on ties.
    """
    admitted = admit_candidates(candidates, limits, thresholds).withColumn(
        "calibrated", calibrate(F.col("source"), F.col("raw_score"))
    )

    def wide(column: str, default=None) -> Column:
        cells = [F.max(F.when(F.col("source") == name, F.col(column))) for name in V.SOURCES]
        if default is not None:
            cells = [F.coalesce(cell, F.lit(default)) for cell in cells]
        return F.array(*cells)

    order = F.expr(" ".join(["CASE source", *[f"WHEN '{n}' THEN {-i}" for i, n in enumerate(V.SOURCES)], "END"]))
    return (
        admitted.withColumn("__order", order)
        .groupBy("user_id", "item_id")
        .agg(
            wide("normalized_score", 0.0).alias("scores"),
            wide("calibrated", 0.0).alias("calibrated"),
            F.array(*[F.max((F.col("source") == name).cast("double")) for name in V.SOURCES]).alias("mask"),
            wide("raw_score").alias("raw_scores"),
            wide("rank_in_source").alias("ranks"),
            wide("confidence").alias("confidences"),
            wide("support").alias("supports"),
            F.max(F.struct("normalized_score", "__order", "source")).alias("best"),
            F.max("is_cold").alias("is_cold"),
        )
        .withColumn("primary_source", F.col("best.source"))
        .drop("best")
    )


def source_evidence(merged: DataFrame) -> DataFrame:
    """Map of the present sources to their evidence."""
    names = F.array(*[F.lit(n) for n in V.SOURCES])
    facts = F.transform(
        F.sequence(F.lit(0), F.lit(len(V.SOURCES) - 1)),
        lambda i: F.struct(
            F.get(F.col("raw_scores"), i).alias("raw_score"), F.get(F.col("scores"), i).alias("normalized_score"),
            F.get(F.col("ranks"), i).alias("rank_in_source"), F.get(F.col("confidences"), i).alias("confidence"),
            F.get(F.col("supports"), i).alias("support"), (F.get(F.col("mask"), i) > 0).alias("eligible"),
        ),
    )
    return merged.withColumn("evidence", F.map_filter(F.map_from_arrays(names, facts), lambda _, e: e["eligible"]))


def union_stats(candidates: DataFrame, limits: Mapping[str, int] | None = None) -> DataFrame:
    """Per source: offered, available, admitted and filtered rows over all users."""
    sizes = {**V.SOURCE_LIMITS, **(limits or {})}
    ok = usable_candidate() & confident()
    per_user = candidates.groupBy("user_id", "source").agg(
        F.count(F.lit(1)).alias("offered"), F.count_if(ok).alias("available")
    )
    return (
        per_user.withColumn("admitted", F.least(F.col("available").cast("double"), _by_source(sizes)).cast("bigint"))
        .groupBy("source")
        .agg(*[F.sum(c).alias(c) for c in ("offered", "available", "admitted")])
        .withColumn("filtered", F.col("offered") - F.col("available"))
    )


def union_sizes(merged: DataFrame) -> DataFrame:
    """Smallest, mean and largest union over users."""
    return merged.groupBy("user_id").agg(F.count(F.lit(1)).alias("c")).agg(
        F.count(F.lit(1)).alias("users"), F.min("c").alias("min"), F.avg("c").alias("mean"), F.max("c").alias("max")
    )


def source_candidates(scores: DataFrame, history: DataFrame) -> DataFrame:
    """Mixer candidates from scorer output (user_id, item_id, source, raw_score, support, is_cold).

    ``history`` has user_id and history_count. Confidence is a fixed function of source and score;
    content and item-CF rows exist only for positive scores.
    """
    raw = F.col("raw_score")
    confidence = (
        F.when(F.col("source") == "model", 0.5 + 0.5 * F.tanh(raw))
        .when(F.col("source").isin("content_profile", "item_cf"), F.least(F.lit(1.0), raw))
        .when(F.col("source") == "popular", F.when(raw > 0, 1.0).otherwise(0.1))
        .otherwise(F.lit(0.05))
    )
    count = F.coalesce("history_count", F.lit(0))
    support = (
        F.when(F.col("source") == "model", count)
        .when(F.col("source") == "content_profile", F.greatest(F.lit(1), count))
        .when(F.col("source") == "item_cf", F.col("support"))
        .when(F.col("source") == "popular", F.greatest(F.lit(0), F.floor(raw)))
        .otherwise(F.lit(0))
    )
    positive = ~F.col("source").isin("content_profile", "item_cf") | (raw > 0)
    eligible = F.when(F.col("source") == "item_cf", F.col("support") > 0).otherwise(finite(raw))
    return scores.join(history, "user_id", "left").filter(positive).select(
        "user_id", "item_id", "source", "raw_score", confidence.alias("confidence"),
        support.cast("bigint").alias("support"), eligible.alias("eligible"), "is_cold",
    )


def user_context(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Per user: history count, best item-CF support and best content confidence."""
    best = candidates.groupBy("user_id").agg(
        F.coalesce(F.max(F.when(F.col("source") == "item_cf", F.col("support"))), F.lit(0)).alias("cf_support"),
        F.coalesce(F.max(F.when(F.col("source") == "content_profile", F.col("confidence"))), F.lit(0.0)).alias("content_confidence"),
    )
    return best.join(history, "user_id", "left").na.fill(0, ["history_count"])


def warm_cold_head(
    rows: DataFrame, *, warm: Column, cold: Column, warm_score: Column, cold_score: Column, blend: Column,
    tie: Column | None = None,
) -> DataFrame:
    """Order per user: the first 7 warm rows, then the first 3 cold rows, then the rest by blend.

    Adds ``head`` (0 warm, 1 cold, 2 rest), ``place`` from 0 and ``prior`` = 1 - place / max(1, n - 1).
    """
    tie = F.expr(TEXT_ID) if tie is None else tie

    def number(flag: Column, score: Column) -> Column:
        return F.row_number().over(
            Window.partitionBy("user_id").orderBy(F.when(flag, 0).otherwise(1), score_key(score).desc(), tie)
        )

    marked = rows.withColumn("__warm", warm).withColumn("__cold", cold & ~warm)
    numbered = marked.withColumn("__w", number(F.col("__warm"), warm_score)).withColumn(
        "__c", number(F.col("__cold"), cold_score)
    )
    head = F.when(F.col("__warm") & (F.col("__w") <= 7), 0).when(F.col("__cold") & (F.col("__c") <= 3), 1).otherwise(2)
    rest = F.when(F.col("head") == 0, -F.col("__w")).when(F.col("head") == 1, -F.col("__c")).otherwise(score_key(blend))
    final = Window.partitionBy("user_id").orderBy("head", rest.desc(), tie)
    return (
        numbered.withColumn("head", head)
        .withColumn("place", F.row_number().over(final) - 1)
        .withColumn("prior", rank_share(F.col("place"), F.count(F.lit(1)).over(Window.partitionBy("user_id"))))
        .drop("__warm", "__cold", "__w", "__c")
    )


def quality_prior(merged: DataFrame) -> DataFrame:
    """The stable 7 warm / 3 cold preference over the union."""
    score, mask = F.col("scores"), F.col("mask")
    return warm_cold_head(
        merged,
        warm=~F.col("is_cold") & (mask[at("svd")] > 0),
        cold=F.col("is_cold") & (mask[at("content")] > 0),
        warm_score=score[at("svd")],
        cold_score=score[at("content")],
        blend=0.55 * score[at("svd")] + 0.35 * score[at("content")] + 0.10 * score[at("popular")],
    )


def rank_normalize(rows: DataFrame, score: str, name: str, keys: tuple[str, ...] = ("user_id",), tie: Column | None = None) -> DataFrame:
    """Adds ``name`` = 1 - rank / max(1, n - 1) by score within the group."""
    tie = F.col("item_id") if tie is None else tie
    order = Window.partitionBy(*keys).orderBy(score_key(score).desc(), tie)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn(name, rank_share(F.row_number().over(order) - 1, size))


def prior_blend(merged: DataFrame, ranker: str, weight: float) -> DataFrame:
    """Rank by (1 - w) * normalised ranker order + w * quality prior."""
    both = rank_normalize(quality_prior(merged), ranker, "ranker_share", tie=F.expr(TEXT_ID))
    blended = both.withColumn("final_score", (1.0 - weight) * F.col("ranker_share") + weight * F.col("prior"))
    order = Window.partitionBy("user_id").orderBy(score_key("final_score").desc(), F.expr(TEXT_ID))
    return blended.withColumn("final_rank", F.row_number().over(order) - 1)


def protected_rerank(merged: DataFrame, ranker: str, weight: float) -> DataFrame:
    """The 7 + 3 head stays on top, ordered by w * stable rank + (1 - w) * ranker rank; the rest by ranker."""
    rows = quality_prior(merged).withColumn("__head", (F.col("head") < 2).cast("int"))
    group = Window.partitionBy("user_id", "__head")
    size = F.count(F.lit(1)).over(group)
    stable = F.row_number().over(group.orderBy("place")) - 1
    learned = F.row_number().over(group.orderBy(score_key(ranker).desc(), "item_id")) - 1
    scored = rows.withColumn("__stable", rank_share(stable, size)).withColumn("__learned", rank_share(learned, size))
    key = F.when(F.col("__head") == 1, weight * F.col("__stable") + (1.0 - weight) * F.col("__learned")).otherwise(F.col(ranker))
    order = Window.partitionBy("user_id").orderBy(F.col("__head").desc(), score_key(key).desc(), "item_id")
    return scored.withColumn("final_rank", F.row_number().over(order) - 1).drop("__head", "__stable", "__learned")


def policy_score(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """List position turned back into a score n - rank; absent items get -1e12."""
    sizes = queries.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    placed = queries.join(ranked.select("user_id", "item_id", "rank"), ["user_id", "item_id"], "left").join(sizes, "user_id")
    return placed.withColumn("score", F.coalesce((F.col("n") - F.col("rank")).cast("double"), F.lit(-1e12))).drop("n", "rank")


def feature_normalisers(counts: DataFrame, key: str, count: str, bounds: tuple[int, ...]) -> DataFrame:
    """Density log1p(n) / max(1, log1p(max)) and the bucket index of a count."""
    top = counts.agg(F.greatest(F.lit(1.0), F.log1p(F.max(count).cast("double")))).scalar()
    return counts.select(
        key, count, (F.log1p(F.col(count).cast("double")) / top).alias("density"), bucket_of(F.col(count), bounds).alias("bucket")
    )


def ranker_features(merged: DataFrame, history: DataFrame, popularity: DataFrame, visual: DataFrame) -> DataFrame:
    """24 continuous and 3 categorical columns per candidate.

    ``history``: user_id, density, bucket; ``popularity``: item_id, bucket; ``visual``: item_id of
    items with a vector.
    """
    users = history.select("user_id", F.col("density").alias("history_density"), F.col("bucket").alias("history_bucket"))
    items = popularity.select("item_id", F.col("bucket").alias("popularity_bucket"))
    seen = visual.select("item_id").distinct().withColumn("__visual", F.lit(1.0))
    joined = merged.join(users, "user_id", "left").join(items, "item_id", "left").join(seen, "item_id", "left")
    code = F.expr(" ".join(["CASE primary_source", *[f"WHEN '{n}' THEN {i + 1}" for i, n in enumerate(V.SOURCES)], "END"]))
    extra = F.array(
        F.coalesce("history_density", F.lit(0.0)), F.col("is_cold").cast("double"), F.coalesce("__visual", F.lit(0.0))
    )
    return joined.select(
        "user_id", "item_id", F.concat("scores", "calibrated", "mask", extra).alias("continuous"),
        F.coalesce("popularity_bucket", F.lit(0)).alias("popularity_bucket"),
        F.coalesce("history_bucket", F.lit(0)).alias("history_bucket"),
        code.alias("primary_code"),
    )


def primary_of(continuous: Column) -> Column:
    """Code 1..7 of the present source with the highest normalised score, the first on ties."""
    size = len(V.SOURCES)
    held = F.zip_with(
        F.slice(continuous, 1, size), F.slice(continuous, 2 * size + 1, size), lambda s, m: F.when(m > 0, s).otherwise(-1.0)
    )
    return F.array_position(held, F.array_max(held)).cast("int")


def drop_sources(features: DataFrame, when: Column, names: tuple[str, ...], *, cold: bool = False) -> DataFrame:
    """Zero the score, calibrated score and mask of some sources where ``when`` holds; the primary
    source is recomputed. ``cold`` also raises the cold flag."""
    size = len(V.SOURCES)
    gone = {block * size + at(n) for block in range(3) for n in names}
    cells = [
        F.when(F.col("__when"), F.lit(0.0)).otherwise(F.col("continuous")[i]) if i in gone
        else (F.when(F.col("__when"), F.lit(1.0)).otherwise(F.col("continuous")[i]) if cold and i == 3 * size + 1
              else F.col("continuous")[i])
        for i in range(3 * size + 3)
    ]
    changed = features.withColumn("__when", when).withColumn("__new", F.array(*cells))
    return (
        changed.withColumn(
            "primary_code", F.when(F.col("__when"), primary_of(F.col("__new"))).otherwise(F.col("primary_code"))
        )
        .withColumn("continuous", F.col("__new"))
        .drop("__new", "__when")
    )


def source_ablation(features: DataFrame, name: str) -> DataFrame:
    """Features without one source; rows that no other source holds leave."""
    left = drop_sources(features, F.lit(True), (name,))
    size = len(V.SOURCES)
    return left.filter(F.exists(F.slice("continuous", 2 * size + 1, size), lambda m: m > 0))


def late_fusion(rows: DataFrame, warm_weight: float, cold_weight: float) -> DataFrame:
    """(1 - w) * rank(text) + w * rank(visual) per user, with w by warm or cold item.

    ``rows``: user_id, item_id, text_score, visual_score, is_cold. The offline form ranks every row.
    """
    ranked = rank_normalize(rank_normalize(rows, "text_score", "text_rank"), "visual_score", "visual_rank")
    weight = F.when(F.col("is_cold"), cold_weight).otherwise(warm_weight)
    return ranked.withColumn("fusion", (1.0 - weight) * F.col("text_rank") + weight * F.col("visual_rank"))


def serving_fusion(rows: DataFrame, warm_weight: float, cold_weight: float) -> DataFrame:
    """0.75 * base rank + 0.25 * content fusion; items without an image use the text rank alone.

    ``visual_score`` is null where there is no image.
    """
    filled = rows.withColumn("__image", F.col("visual_score").isNotNull()).withColumn(
        "visual_score", F.coalesce("visual_score", F.lit(-1.0))
    )
    fused = late_fusion(filled, warm_weight, cold_weight)
    content = F.when(F.col("__image"), F.col("fusion")).otherwise(F.col("text_rank"))
    served = rank_normalize(fused, "base_score", "base_rank").withColumn(
        "serving_score", 0.75 * F.col("base_rank") + 0.25 * content
    )
    order = Window.partitionBy("user_id").orderBy(score_key("serving_score").desc(), F.expr(TEXT_ID))
    return served.withColumn("rank", F.row_number().over(order) - 1).drop("__image")


