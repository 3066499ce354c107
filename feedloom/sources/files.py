"""Text sources with explicit schemas. Nothing is inferred; bad rows are returned, not dropped silently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import finite
from ..functions.grouping import first_by

FEEDBACK_COLUMNS = (
    "event_id", "user_id", "item_id", "timestamp_ms", "event_type", "weight", "disposition", "received_at",
)
SPLIT_COLUMNS = ("user_id", "item_id", "timestamp_ms")
# Accepted spellings of item columns, first match wins.
ITEM_ALIASES = {
    "item_id": ("item_id", "video_id", "videoID", "item"),
    "title": ("title", "item_title", "video_title"),
    "likes": ("likes", "like_count", "num_likes"),
    "views": ("views", "view_count", "num_views"),
    "popularity_score": ("popularity_score", "popularity", "hot_score"),
    "stats_snapshot_version": ("stats_snapshot_version",),
    "stats_available_at": ("stats_available_at",),
}


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def read_exact(spark: SparkSession, path: str, names: Sequence[str], sep: str = ",") -> DataFrame:
    """CSV whose header must be exactly ``names``; another header fails the job. Values stay text.

    A byte-order mark in front of the header is accepted.
    """
    header = spark.read.text(path).first()
    found = header[0].lstrip("﻿").strip() if header else ""
    if [h.strip().strip('"') for h in found.split(sep)] != list(names):
        raise ValueError(f"header of {path} must be {sep.join(names)}")
    reader = spark.read.schema(_text_schema(names)).option("header", True).option("sep", sep)
    # without enforcing, Spark compares every file's own header with the schema
    return reader.option("enforceSchema", False).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)


def positive_int(name: str) -> Column:
    value = F.expr(f"try_cast(trim({name}) AS bigint)")
    return F.when(value > 0, value)


def read_interactions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a ``user,item,timestamp`` file of positive integers; repeats are kept."""
    raw = read_exact(spark, path, ("user", "item", "timestamp"))
    parsed = raw.select(
        "*", positive_int("user").alias("user_id"), positive_int("item").alias("item_id"), positive_int("timestamp").alias("ts_ms")
    )
    whole = F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("ts_ms").isNotNull()
    reason = F.when(F.col("user_id").isNull(), "user").when(F.col("item_id").isNull(), "item").otherwise("timestamp")
    return (
        parsed.filter(whole).select("user_id", "item_id", "ts_ms"),
        parsed.filter(~whole).select("user", "item", "timestamp", reason.alias("reason")),
    )


def _unique_rejects(parsed: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    counts = parsed.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.count(F.lit(1)).alias("__c"))
    joined = parsed.join(counts, "item_id", "left").withColumn(
        "reason", F.coalesce(reason, F.when(F.col("__c") > 1, "duplicate_item"))
    ).drop("__c")
    return joined.filter(F.col("reason").isNull()).drop("reason"), joined.filter(F.col("reason").isNotNull())


def read_titles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of an ``item,title`` file: titles trimmed, not blank, one per item."""
    raw = read_exact(spark, path, ("item", "title"))
    parsed = raw.select(positive_int("item").alias("item_id"), F.trim("title").alias("title"))
    blank = F.col("title").isNull() | (F.length("title") == 0)
    return _unique_rejects(parsed, F.when(F.col("item_id").isNull(), "item").when(blank, "title"))


def read_item_stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a headerless ``item, likes, views`` tab file; blank lines are skipped."""
    raw = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    cells = F.split("value", "\t")
    number = lambda i: F.expr(f"try_cast(trim(get(cells, {i})) AS bigint)")
    parsed = raw.select(cells.alias("cells")).select(
        number(0).alias("item_id"), number(1).alias("likes"), number(2).alias("views"), F.size("cells").alias("fields")
    )
    bad = (F.col("fields") != 3) | F.col("item_id").isNull() | (F.col("item_id") <= 0)
    counts = F.col("likes").isNull() | F.col("views").isNull() | (F.col("likes") < 0) | (F.col("views") < 0)
    rows, rejects = _unique_rejects(parsed, F.when(bad, "line").when(counts, "counts"))
    return rows.drop("fields"), rejects


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Processed interactions; a value that is no integer fails the job."""
    raw = read_exact(spark, path, SPLIT_COLUMNS)
    return raw.select(*[F.col(n).cast("bigint").alias("ts_ms" if n == "timestamp_ms" else n) for n in SPLIT_COLUMNS])


def read_feedback(spark: SparkSession, path: str | None) -> DataFrame:
    """Feedback file with eight fixed columns; no path means an empty table. A repeated event id or a
    non-finite weight fails the job that reads the result."""
    if path is None:
        schema = "event_id string, user_id bigint, item_id bigint, ts_ms bigint, event_type string, weight double, disposition string, received_at string"
        return spark.createDataFrame([], schema)
    raw = read_exact(spark, path, FEEDBACK_COLUMNS)
    weight = F.col("weight").cast("double")
    checked = F.when(finite(weight), weight).otherwise(F.raise_error(F.lit("feedback weight is not finite")).cast("double"))
    repeated = raw.groupBy("event_id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).scalar()
    first = F.when(F.coalesce(repeated, F.lit(1)) == 1, F.col("event_id")).otherwise(
        F.raise_error(F.lit("feedback has repeated event ids")).cast("string")
    )
    return raw.select(
        first.alias("event_id"), F.col("user_id").cast("bigint").alias("user_id"), F.col("item_id").cast("bigint").alias("item_id"),
        F.col("timestamp_ms").cast("bigint").alias("ts_ms"), "event_type", checked.alias("weight"), "disposition", "received_at",
    )


def normalise_items(raw: DataFrame, snapshot_version: str | None = None, available_at: str | None = None) -> DataFrame:
    """Item table from any accepted spelling of its columns.

    The first row of an item wins (by ``line`` when present). Popularity is log1p(views) + 2 log1p(likes)
    unless a finite value is given. Counters keep their provenance only when they match the verified
    snapshot; otherwise they cannot rank.
    """
    present = set(raw.columns)

    def pick(name: str) -> Column:
        spelled = [F.nullif(F.trim(F.col(a).cast("string")), F.lit("")) for a in ITEM_ALIASES[name] if a in present]
        return F.coalesce(*spelled) if spelled else F.lit(None).cast("string")

    def count(name: str) -> Column:
        return F.greatest(F.lit(0), F.coalesce(F.floor(pick(name).try_cast("double")).cast("bigint"), F.lit(0)))

    line = F.col("line") if "line" in present else F.lit(0).cast("bigint")
    rows = raw.select(
        pick("item_id").alias("item_id"), line.alias("line"), pick("title").alias("title"), count("likes").alias("likes"),
        count("views").alias("views"), pick("popularity_score").try_cast("double").alias("given"),
        pick("stats_snapshot_version").alias("stats_version"), pick("stats_available_at").alias("stats_available_at"),
    ).filter(F.col("item_id").isNotNull())
    first = first_by(rows, ["item_id"], ["line", "title"], ["likes", "views", "given", "stats_version", "stats_available_at"])
    counted = F.log1p(F.col("views").cast("double")) + 2 * F.log1p(F.col("likes").cast("double"))
    popularity = F.when(F.col("given").isNull(), counted).when(finite(F.col("given")), F.col("given")).otherwise(0.0)
    verified = F.lit(snapshot_version is not None) & (F.col("stats_version") == F.lit(snapshot_version)) & (
        F.col("stats_available_at").eqNullSafe(F.lit(available_at))
    )
    return first.select(
        "item_id", F.coalesce("title", F.concat(F.lit("Item "), "item_id")).alias("title"), "likes", "views",
        popularity.alias("popularity_score"),
        F.when(verified, F.col("stats_version")).alias("stats_version"),
        F.when(verified, F.col("stats_available_at")).alias("stats_available_at"),
        F.lit("online").alias("status"), F.lit(1).alias("status_version"),
    )


def load_items(spark: SparkSession, path: str, **snapshot: str | None) -> DataFrame:
    """Item file with a header in any accepted spelling."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return normalise_items(raw.withColumn("line", F.monotonically_increasing_id()), **snapshot)


def upsert_items(known: DataFrame, loaded: DataFrame) -> DataFrame:
    """Catalog after a load: loaded rows replace the facts of known items, whose status stays."""
    kept = known.join(loaded.select("item_id"), "item_id", "left_anti")
    status = known.select("item_id", F.col("status").alias("__s"), F.col("status_version").alias("__v"))
    fresh = loaded.join(status, "item_id", "left").withColumn("status", F.coalesce("__s", "status")).withColumn(
        "status_version", F.coalesce("__v", "status_version")
    ).drop("__s", "__v")
    return kept.select(*loaded.columns).unionByName(fresh)


def stats_snapshot(stats: DataFrame, available_at: str | None, source_hash: str, source_name: str) -> DataFrame:
    """Provenance row of cumulative counters; without a publication time they are disabled for ranking."""
    version = F.substring(F.sha2(F.concat_ws("|", F.coalesce(F.lit(available_at), F.lit("")), F.lit(source_hash)), 256), 1, 16)
    return stats.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("likes") == 0).alias("zero_likes"),
        F.count_if(F.col("views") == 0).alias("zero_views"),
        F.count_if(F.col("likes") > F.col("views")).alias("likes_above_views"),
    ).select(
        version.alias("snapshot_version"), F.lit(available_at).cast("string").alias("available_at"),
        F.lit(source_hash).alias("source_hash"), F.lit(source_name).alias("source_name"), "row_count", "zero_likes", "zero_views",
        "likes_above_views", F.lit("enabled" if available_at else "disabled").alias("policy"),
    )
