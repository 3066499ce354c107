"""Per-group work that stays safe when one group holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

INDEX_BUCKETS = 1024
SKETCH_ACCURACY = 100_000


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group with their rank from 0.

    The bound on ``row_number`` lets Spark limit every group before the shuffle, so a hot group
    sends at most ``n`` rows per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(rank, F.row_number().over(window))
        .filter(F.col(rank) <= n)
        .withColumn(rank, F.col(rank) - 1)
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Row with the smallest ordering key of every group, found by a combinable minimum."""
    names = list(dict.fromkeys([*order, *carry]))
    best = df.groupBy(*keys).agg(F.min(F.struct(*names)).alias("__first"))
    return best.select(*keys, *[F.col(f"__first.{name}").alias(name) for name in names if name not in keys])


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Row with the largest ordering key of every group."""
    names = list(dict.fromkeys([*order, *carry]))
    best = df.groupBy(*keys).agg(F.max(F.struct(*names)).alias("__last"))
    return best.select(*keys, *[F.col(f"__last.{name}").alias(name) for name in names if name not in keys])


def dense_index(df: DataFrame, ident: str, index: str = "item_index") -> DataFrame:
    """Number unique ids 0..n-1 in the order (id mod 1024, id).

    Bucket sizes are counted first and only the 1024 counts are ordered globally; rows are
    ordered inside their bucket.
    """
    rows = df.withColumn("__bucket", F.pmod(F.col(ident), F.lit(INDEX_BUCKETS)))
    sizes = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__bucket").orderBy(ident)
    return (
        rows.withColumn("__rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__bucket")
        .withColumn(index, F.col("__offset") + F.col("__rank") - 1)
        .drop("__bucket", "__rank", "__offset")
    )


def sum_before(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group.

    ``bucket`` must not decrease along ``order`` (an hour of the timestamp, say). Totals per bucket
    are combined first, so no task ever orders more than one bucket of a group.
    """
    rows = df.withColumn("__bucket", bucket).withColumn("__value", value)
    totals = rows.groupBy(*keys, "__bucket").agg(F.sum("__value").alias("__total"))
    past = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("__carried", F.coalesce(F.sum("__total").over(past), F.lit(0.0))).drop("__total")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0.0)))
        .join(carried, [*keys, "__bucket"])
        .withColumn(name, F.col("__carried") + F.col("__inside"))
        .drop("__bucket", "__value", "__inside", "__carried")
    )


def order_statistics(
    df: DataFrame, value: str, points: Sequence[tuple[str, float, str]], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact order statistics per group: one row with ``n``, ``low``, ``high`` and one double per point.

    A point is ``(name, fraction, mode)``: ``ceil`` takes sorted row ceil(q*n), ``floor`` takes
    index floor(q*(n-1)), ``linear`` interpolates at q*(n-1). A mergeable sketch brackets each
    point; exact counts below the bracket and an ordering of the few values inside it give the
    exact answer, so no task sorts or holds a whole large group.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    lone = not keys
    if lone:
        # the values are read twice, what they are made from only once
        data, keys = materialise(data).withColumn("__all", F.lit(0)), ["__all"]
    # brackets from tight to wide; a group uses the first that spans a few of its rows
    slacks = (3.0 / SKETCH_ACCURACY, 1e-3, 0.1, 1.0)
    cuts = [min(1.0, max(0.0, q + side * slack)) for slack in slacks for side in (-1, 1) for _, q, _ in points]
    sketch = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("__v").alias("low"),
        F.max("__v").alias("high"),
        F.percentile_approx("__v", [float(c) for c in cuts], SKETCH_ACCURACY).alias("__cut"),
    )

    def bracket(point: int, side: int) -> Column:
        at = [F.col("__cut")[(2 * rung + side) * len(points) + point] for rung in range(len(slacks))]
        return F.coalesce(*[F.when(F.col("n") * slack >= 3, cut) for slack, cut in zip(slacks, at)], at[-1])

    targets = []
    for i, (_, q, mode) in enumerate(points):
        if mode == "ceil":
            # guard against products such as 0.1 * 30 = 3.0000000000000004
            rank = F.greatest(F.lit(1.0), F.ceil(F.round(F.lit(q) * F.col("n"), 9)).cast("double"))
            part = F.lit(0.0)
        else:
            exact = F.round(F.lit(q) * (F.col("n") - 1), 9)
            rank = F.floor(exact).cast("double") + 1
            part = (exact - F.floor(exact)) if mode == "linear" else F.lit(0.0)
        targets.append(
            F.struct(
                F.lit(i).alias("point"),
                rank.alias("rank"),
                part.alias("part"),
                bracket(i, 0).alias("lo"),
                bracket(i, 1).alias("hi"),
            )
        )
    per_group = sketch.select(*keys, "n", "low", "high", F.array(*targets).alias("__targets"))
    # one histogram row per value inside a bracket, one for everything below it
    facts = ["n", "low", "high", "rank", "part"]
    # one group has one row of brackets, so that every task may hold it; joined by a constant key all values would meet in one partition
    met = data.crossJoin(F.broadcast(per_group.drop("__all"))) if lone else data.join(per_group, keys)
    histogram = (
        met.select(*keys, "__v", "n", "low", "high", F.explode("__targets").alias("t"))
        .filter(F.col("__v") <= F.col("t.hi"))
        .select(
            *keys, "n", "low", "high", "t.point", "t.rank", "t.part",
            F.when(F.col("__v") >= F.col("t.lo"), F.col("__v")).alias("__v"),
        )
        .groupBy(*keys, "point", "__v")
        .agg(F.count(F.lit(1)).alias("__c"), *[F.max(f).alias(f) for f in facts])
    )
    window = Window.partitionBy(*keys, "point").orderBy(F.col("__v").asc_nulls_first())
    below = F.max(F.when(F.col("__v").isNull(), F.col("__upto")))
    answer = (
        histogram.withColumn("__upto", F.sum("__c").over(window))
        .groupBy(*keys, "point")
        .agg(
            # the wanted rows must lie inside the bracket; a sketch that missed them stops the job
            F.assert_true(
                (F.coalesce(below, F.lit(0)) < F.max("rank")) & (F.max("__upto") >= F.least(F.max("n"), F.max("rank") + F.when(F.max("part") > 0, 1).otherwise(0))),
                F.lit("order statistic outside its bracket"),
            ).alias("__held"),
            F.min(F.when(F.col("__upto") >= F.col("rank"), F.col("__v"))).alias("__low"),
            F.min(F.when(F.col("__upto") >= F.col("rank") + 1, F.col("__v"))).alias("__high"),
            *[F.max(f).alias(f) for f in facts],
        )
        .withColumn(
            "__answer",
            F.col("__low") + F.col("part") * (F.coalesce(F.col("__high"), F.col("__low")) - F.col("__low")),
        )
    )
    result = answer.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("n", "low", "high")],
        *[F.max(F.when(F.col("point") == i, F.col("__answer"))).alias(name) for i, (name, _, _) in enumerate(points)],
        F.max("__held").alias("__held"),
    ).filter(F.col("__held").isNull()).drop("__held")
    return result.drop("__all") if lone else result
