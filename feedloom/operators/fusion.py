"""Choice of the visual weight: a grid of late-fusion weights against text-only and visual-only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.exprs import score_key
from .evaluation import mean_metrics, query_shares
from .merge import rank_normalize

SCOPES = ("sampled_all_items", "warm", "cold")


def fusion_policies() -> list[tuple[str, float]]:
    return [("text_only", 0.0), ("visual_only", 1.0), *[(f"static_{w:g}", w) for w in V.FUSION_WEIGHTS]]


def fusion_metrics(rows: DataFrame, k: int = V.METRIC_K) -> DataFrame:
    """Metrics per policy and scope from one ranking of text and visual scores.

    ``rows``: user_id, item_id, label, text_score, visual_score, is_cold. Warm and cold scopes keep
    the negatives of a query and only its warm or cold positives. A policy orders the user's rows once; a positive's rank
    in a scope is its rank among all rows less the positives before it that the scope leaves out, so only positives
    become rows per policy and scope.
    """
    ranked = rank_normalize(rank_normalize(rows, "text_score", "text_rank"), "visual_score", "visual_rank")
    positive, cold = F.col("label") == 1, F.coalesce("is_cold", F.lit(False))
    scope = F.when(cold, SCOPES[2]).otherwise(SCOPES[1])
    cells = []
    for i, (policy, weight) in enumerate(fusion_policies()):
        score = (1.0 - weight) * F.col("text_rank") + weight * F.col("visual_rank")
        order = Window.partitionBy("user_id").orderBy(score_key(score).desc(), "item_id")
        before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = ranked.withColumns({
            f"__r{i}": F.row_number().over(order),
            f"__w{i}": F.sum((positive & ~cold).cast("int")).over(before),
            f"__c{i}": F.sum((positive & cold).cast("int")).over(before),
        })
        inside = F.col(f"__r{i}") - F.when(cold, F.col(f"__w{i}")).otherwise(F.col(f"__c{i}"))
        for name, rank in ((F.lit(SCOPES[0]), F.col(f"__r{i}")), (scope, inside)):
            cells.append(F.struct(F.lit(policy).alias("policy"), F.lit(weight).alias("weight"), name.alias("scope"), rank.cast("bigint").alias("rank")))
    keys = ["policy", "weight", "scope"]
    placed = ranked.filter(positive).select("user_id", F.inline(F.array(*cells)))
    per_query = placed.groupBy(*keys, "user_id").agg(
        F.count_if(F.col("rank") <= k).alias("hits"),
        F.count(F.lit(1)).alias("positives"),
        F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"),
    )
    return mean_metrics(query_shares(per_query, keys, k), keys)


def fusion_selection(metrics: DataFrame) -> DataFrame:
    """Gates per weight and the selected one.

    Safe: all-items and warm recall and NDCG keep 99.5 % of text only. Better: all-items gain 1 % or
    cold gains 3 % in recall or NDCG. Among weights that are both (else all), the best
    ndcg + recall + 0.25 * (cold ndcg + cold recall) wins, then the smaller weight.
    """
    wide = metrics.groupBy("policy", "weight").agg(
        *[
            F.coalesce(F.max(F.when(F.col("scope") == s, F.col(m))), F.lit(0.0)).alias(f"{s}_{m}")
            for s in SCOPES for m in ("recall", "ndcg")
        ]
    )
    base = wide.filter(F.col("policy") == "text_only").select(F.struct("*").alias("b")).scalar()

    def keeps(scope: str, metric: str, factor: float):
        return F.col(f"{scope}_{metric}") >= factor * base[f"{scope}_{metric}"]

    safe = keeps(SCOPES[0], "recall", 0.995) & keeps(SCOPES[0], "ndcg", 0.995)
    safe = safe & keeps("warm", "recall", 0.995) & keeps("warm", "ndcg", 0.995)
    better = keeps(SCOPES[0], "recall", 1.01) | keeps(SCOPES[0], "ndcg", 1.01)
    better = better | keeps("cold", "recall", 1.03) | keeps("cold", "ndcg", 1.03)
    value = F.col(f"{SCOPES[0]}_ndcg") + F.col(f"{SCOPES[0]}_recall") + 0.25 * (F.col("cold_ndcg") + F.col("cold_recall"))
    judged = wide.withColumn("safe", safe).withColumn("better", better).withColumn("value", F.round(value, 9))
    candidate = F.col("policy").startswith("static_")
    best = judged.filter(candidate).agg(
        F.max(F.struct((F.col("safe") & F.col("better")).cast("int"), "value", -F.col("weight"), "policy")).alias("m")
    ).select("m.policy")
    return judged.withColumn("selected", (F.col("policy") == best.scalar()).cast("int"))
