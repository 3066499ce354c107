"""The driver's parquet tables seen as recommendation facts.

Columns are selected at the scan, times become epoch milliseconds, and every view reads its
whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.exprs import epoch_ms
from ..session import TABLE_CONF, configure, prepare_session

ORDINALS = {name: i for i, name in enumerate(("impression", "click", "like", "share", "not_interested", "dwell"))}


class Tables:
    """Lazily built views over one data directory."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare_session(spark)
        configure(self.spark, TABLE_CONF)
        self.folder = folder.rstrip("/")
        self.memo: dict = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def interactions(self) -> DataFrame:
        """user_id, item_id, ts_ms; repeats are kept."""
        lines = self.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item_id"))
        orders = self.raw("orders").select(
            "o_orderkey", F.col("o_custkey").alias("user_id"), epoch_ms("o_orderdate").alias("ts_ms")
        )
        return lines.join(orders, "o_orderkey").select("user_id", "item_id", "ts_ms")

    @cached_property
    def items(self) -> DataFrame:
        """item_id, title, likes, views, status, is_cold."""
        return self.raw("part").select(
            F.col("p_partkey").alias("item_id"),
            F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"),
            F.col("p_size").cast("bigint").alias("likes"),
            F.floor("p_retailprice").cast("bigint").alias("views"),
            F.when(F.col("p_size") == 7, "offline").otherwise("online").alias("status"),
            (F.col("p_size") >= 40).alias("is_cold"),
            (F.log1p(F.floor("p_retailprice").cast("double")) + 2 * F.log1p(F.col("p_size").cast("double"))).alias(
                "popularity_score"
            ),
        )

    @cached_property
    def users(self) -> DataFrame:
        """user_id, dataset_user_id (null where unmapped), username, is_active."""
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("dataset_user_id"),
            F.col("c_name").alias("username"),
            (F.col("c_mktsegment") != "HOUSEHOLD").alias("is_active"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        key = F.col("o_orderkey") % 3
        return self.raw("orders").select(
            F.col("o_orderkey").alias("request_id"),
            F.col("o_custkey").alias("user_id"),
            F.when(key == 0, "personalized").when(key == 1, "popular").otherwise("explore").alias("feed_type"),
            epoch_ms("o_orderdate").alias("created_ms"),
            (F.col("o_totalprice") / 1000).alias("latency_ms"),
        )

    @cached_property
    def served_lines(self) -> DataFrame:
        """One line per (request, item) with its position in the request.

        Repeated lines collapse in a combinable minimum on (request, item) first, so a request with very
        many lines is spread over its items; what is ordered per request is a page, whose positions
        are bounded by contract. The window and the join share one layout by request.
        """
        kept = ["l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag"]
        lines = (
            self.raw("lineitem")
            .select("l_orderkey", "l_partkey", *kept)
            .groupBy("l_orderkey", "l_partkey")
            .agg(F.min(F.struct(*kept)).alias("line"))
        )
        place = Window.partitionBy("l_orderkey").orderBy(F.col("line.l_linenumber"), F.col("l_partkey"))
        numbered = lines.select(
            F.col("l_orderkey").alias("request_id"),
            F.col("l_partkey").alias("item_id"),
            (F.row_number().over(place) - 1).alias("position"),
            *[F.col(f"line.{name}").alias(name) for name in kept],
        )
        return numbered.join(self.requests.select("request_id", "user_id", "feed_type", "created_ms"), "request_id")

    @cached_property
    def exposures(self) -> DataFrame:
        names = F.array(*[F.lit(s) for s in V.SOURCES])
        return self.served_lines.select(
            "request_id", "user_id", "item_id", "position", "feed_type",
            names[(F.col("l_suppkey") % 7).cast("int")].alias("source"), "created_ms",
        )

    @cached_property
    def behaviour(self) -> DataFrame:
        """Events of the served rows: one struct per event type that applies, exploded once."""
        rules = {
            "impression": F.col("l_quantity") >= 15,
            "click": F.col("l_returnflag") == "A",
            "like": F.col("l_discount") >= 0.09,
            "share": F.col("l_discount") == 0,
            "not_interested": (F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.08),
            "dwell": (F.col("l_quantity") >= 25)
            & F.col("l_extendedprice").between(V.DWELL_MIN_MS, V.DWELL_MAX_MS),
        }
        dwell = F.floor("l_extendedprice").cast("bigint")
        slots = [
            F.when(
                rule,
                F.struct(
                    F.lit(name).alias("event_type"),
                    F.lit(ORDINALS[name]).alias("k"),
                    (dwell if name == "dwell" else F.lit(None).cast("bigint")).alias("dwell_ms"),
                ),
            )
            for name, rule in rules.items()
        ]
        rows = self.served_lines.withColumn("e", F.explode(F.array_compact(F.array(*slots))))
        return rows.select(
            F.concat_ws(":", "e.event_type", "request_id", "item_id").alias("event_id"),
            F.col("e.event_type").alias("event_type"),
            "request_id", "user_id", "item_id", "position", "feed_type",
            F.col("e.dwell_ms").alias("dwell_ms"),
            (F.col("created_ms") + (F.col("position") * 8 + F.col("e.k")) * F.lit(V.MINUTE_MS).cast("bigint")).alias(
                "received_ms"
            ),
        )

    @cached_property
    def clickstream(self) -> DataFrame:
        kind = (
            F.when(F.col("event_type") == "view", "impression")
            .when(F.col("event_type") == "click", "click")
            .when(F.col("event_type") == "purchase", "like")
            .when(F.col("event_type") == "error", "not_interested")
        )
        return (
            self.raw("events")
            .select(
                "event_id", epoch_ms("ts").alias("ts_ms"), "user_id",
                F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
                kind.alias("event_type"),
                F.floor(F.col("value") * 1000).cast("bigint").alias("dwell_ms"),
            )
            .filter(F.col("event_type").isNotNull())
        )

    @cached_property
    def candidates(self) -> DataFrame:
        """Scored candidates per user and source, straight from the order lines."""
        names = F.array(*[F.lit(s) for s in V.SOURCES])
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item_id"),
            "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag",
        )
        orders = self.raw("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
        rows = lines.join(orders, "o_orderkey").withColumn("source", names[(F.col("l_suppkey") % 7).cast("int")])
        scored = rows.groupBy("user_id", "item_id", "source").agg(
            (F.max("l_extendedprice") / 50000 - 0.2).alias("raw_score"),
            (F.lit(1.0) - F.max("l_discount") * 4).alias("confidence"),
            F.count(F.lit(1)).alias("support"),
            (F.max("l_returnflag") != "N").alias("eligible"),
        )
        return scored.join(self.items.select("item_id", "is_cold"), "item_id").select(
            "user_id", "item_id", "source", F.round("raw_score", 6).alias("raw_score"),
            F.round("confidence", 6).alias("confidence"), "support", "eligible", "is_cold",
        )

    @cached_property
    def visual_vectors(self) -> DataFrame:
        """item_id, embedding. Items without a vector have no image."""
        return self.raw("embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("title"))

    @cached_property
    def file_assets(self) -> DataFrame:
        return self.raw("pages").select(F.col("page_id").alias("asset_id"), F.col("html").alias("content"))
