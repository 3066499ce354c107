"""Structured Streaming over behaviour events. Every stream uses the same transformations as its
batch twin, so a drained stream equals the batch result.

Late data: the watermark is ten minutes on receive time by default.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import dwell_affinity, ratio
from ..operators import behaviour as B
from ..operators import operations as O
from ..session import shared_dir

WATERMARK = "10 minutes"


def read_stream(spark: SparkSession, schema, folder: str, glob: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def with_event_time(events: DataFrame, ms: str = "received_ms", delay: str = WATERMARK) -> DataFrame:
    return events.withColumn("received_at", F.timestamp_millis(ms)).withWatermark("received_at", delay)


def stream_events(events: DataFrame) -> DataFrame:
    """Client events with their reject reason; favorite is stored as like."""
    return B.validate_events(events)


def stream_dedup(events: DataFrame) -> DataFrame:
    """Current event per (request, user, item, position, type): first received, dwell raised to its longest, repeats counted.

    Update mode; the state is one row per event. ``stream_conflicts`` reports ids that two different events use.
    """
    return B.deduplicate(events)


def stream_conflicts(events: DataFrame) -> DataFrame:
    """Event ids used with different payloads so far and how often each was delivered; update mode."""
    return B.id_conflicts(events)


def stream_validate(events: DataFrame, exposures: DataFrame) -> DataFrame:
    """Stream-static join: events that name a persisted exposure of that user. Every micro-batch reads ``exposures`` anew."""
    return events.join(exposures.select(*B.EVENT_KEY), list(B.EVENT_KEY), "left_semi")


def stream_state(events: DataFrame) -> DataFrame:
    """Counters per (user, item) as ``user_item_state`` has them; update mode, exact in any order of arrival.

    The state holds the distinct (request, position, type, dwell) of a pair, so a repeated delivery adds nothing and a
    longer dwell replaces the shorter one when the counters are taken.
    """
    kinds = events.filter(F.col("event_type") != "revisit")
    entry = F.struct("request_id", "position", "event_type", F.coalesce("dwell_ms", F.lit(-1)).alias("dwell_ms"))
    folded = kinds.groupBy("user_id", "item_id").agg(F.collect_set(entry).alias("__all"), F.max("received_ms").alias("last_event_ms"))
    # sorted, so the last of equal keys has the longest dwell
    ordered = folded.withColumn("__all", F.array_sort("__all"))

    def newer(e: Column, i: Column) -> Column:
        after = F.get("__all", i + 1)
        same = (after["request_id"] == e["request_id"]) & (after["position"] == e["position"]) & (after["event_type"] == e["event_type"])
        return ~F.coalesce(same, F.lit(False))

    once = ordered.withColumn("__once", F.filter("__all", newer))

    def count(kind: str) -> Column:
        return F.size(F.filter("__once", lambda e: e["event_type"] == kind)).cast("bigint")

    dwells = F.transform(F.filter("__once", lambda e: e["event_type"] == "dwell"), lambda e: e["dwell_ms"])
    return once.select(
        "user_id", "item_id", *[count(k).alias(f"{n}_count") for k, n in (("impression", "exposure"), ("click", "click"), ("like", "like"), ("share", "share"))],
        F.aggregate(dwells, F.lit(0).cast("bigint"), lambda total, d: total + d).alias("dwell_ms_total"), F.size(dwells).cast("bigint").alias("dwell_event_count"),
        F.aggregate(dwells, F.lit(0.0), lambda total, d: total + dwell_affinity(d)).alias("dwell_affinity"),
        F.exists("__once", lambda e: e["event_type"] == "not_interested").cast("int").alias("not_interested"), "last_event_ms",
    )


def stream_timeseries(events: DataFrame, width: str = "1 hour", delay: str = WATERMARK) -> DataFrame:
    """Tumbling counts per event type; a window is final when the watermark passes its end."""
    timed = with_event_time(events, delay=delay)
    return timed.groupBy(F.window("received_at", width), "event_type").agg(F.count(F.lit(1)).alias("value")).select(
        F.unix_millis("window.start").alias("bucket_ms"), "event_type", "value"
    )


def alert_facts(requests: DataFrame, exposures: DataFrame, events: DataFrame) -> DataFrame:
    """Requests, exposures and events as one kind of row: kind, user_id, latency_ms, received_ms."""
    none = F.lit(None).cast("double").alias("latency_ms")
    return (
        requests.select(F.lit("request").alias("kind"), "user_id", F.col("latency_ms").cast("double").alias("latency_ms"), F.col("created_ms").alias("received_ms"))
        .unionByName(exposures.select(F.lit("exposure").alias("kind"), "user_id", none, F.col("created_ms").alias("received_ms")))
        .unionByName(events.select(F.col("event_type").alias("kind"), "user_id", none, "received_ms"))
    )


def stream_alert_metrics(facts: DataFrame, items: DataFrame, width: str = "60 minutes", slide: str = "1 minute") -> DataFrame:
    """The nine alert metrics of every trailing window, one row per window end; final when the watermark passes it.

    Active users are a set and latencies a frequency table in the state, both bounded by one window.
    """
    kind = F.col("kind")
    asks = (kind == "request") | ~kind.isin("request", "exposure", "impression")
    counts = [F.count_if(kind == k).alias(n) for k, n in
              (("request", "requests"), ("exposure", "exposures"), ("impression", "impressions"), ("click", "clicks"), ("like", "likes"))]
    offline = items.agg(F.count_if(F.col("status") == "offline")).first()[0]  # one number
    windows = with_event_time(facts).groupBy(F.window("received_at", width, slide)).agg(
        *counts, F.size(F.collect_set(F.when(asks, F.col("user_id")))).cast("bigint").alias("active_users"),
        F.coalesce(F.percentile("latency_ms", 0.95), F.lit(0.0)).alias("latency_p95"),
    )
    return windows.select(
        F.unix_millis("window.end").alias("now_ms"), "requests", "exposures", "impressions", "clicks", "likes",
        ratio(F.col("clicks"), F.col("exposures")).alias("ctr"), "active_users", "latency_p95", F.lit(offline).cast("bigint").alias("offline_items"),
    )


def stream_revisits(events: DataFrame) -> DataFrame:
    """Derived revisit events: the first impression of a second or later request, numbered in order of receipt; update mode.

    The state of a (user, item) is its distinct impressions. It has no expiry: a visit counts however long ago. A pair
    that changes gives all its revisits again, so readers keep the newest row per event id.
    """
    shown = events.filter(F.col("event_type") == "impression")
    entry = F.struct("request_id", "received_ms", "event_id", F.col("position").cast("bigint").alias("position"))
    pairs = shown.groupBy("user_id", "item_id").agg(F.array_sort(F.collect_set(entry)).alias("__all"))

    def opens(e: Column, i: Column) -> Column:
        """The first of the sorted impressions of its request."""
        return (i == 0) | ~F.get("__all", i - 1)["request_id"].eqNullSafe(e["request_id"])

    visits = F.array_sort(F.transform(
        F.filter("__all", opens), lambda e: F.struct(e["received_ms"].alias("received_ms"), e["event_id"].alias("id"), e["request_id"].alias("request_id"), e["position"].alias("position"))
    ))
    numbered = pairs.select("user_id", "item_id", F.posexplode(visits).alias("place", "v")).filter("place > 0")
    return numbered.select(
        F.concat_ws(":", F.lit("revisit"), "v.request_id", "item_id", "v.position").alias("event_id"), "v.request_id", "user_id", "item_id",
        "v.position", "v.received_ms", (F.col("place") + 1).cast("bigint").alias("visit_index"),
    )


def _run(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], root: str, arrivals: Iterable[Callable[[], object]]) -> None:
    """After every arrival start the query again from its checkpoint, over what is available by then."""
    for arrive in arrivals:
        arrive()
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(
            write
        ).start().awaitTermination()


NOTHING = (lambda: None,)


def drain(
    stream: DataFrame, mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None,
    arrivals: Iterable[Callable[[], object]] = NOTHING,
) -> DataFrame:
    """Run a stream over everything available and return what it wrote.

    Each micro-batch is one folder named by its number and overwritten on a retry, so a batch that is
    replayed after a failure leaves no second copy. Update-mode readers keep the newest batch per key.
    ``arrivals`` bring in data: the query runs once after each of them and takes up where it stopped.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/feedloom-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{root}/out/batch_number={number}")

    _run(stream, mode, write, root, arrivals)
    return spark.read.schema(stream.schema).option("basePath", f"{root}/out").parquet(f"{root}/out") if transform is None else (
        spark.read.parquet(f"{root}/out")
    )


def _newest(batch: DataFrame, number: int, ms: str, folder: str) -> tuple[int | None, int | None]:
    """Newest time of all earlier micro-batches and of this one, which is left in the folder."""
    spark, earlier = batch.sparkSession, None
    if number:
        known = spark.read.schema("newest bigint, batch_number bigint").option("basePath", folder).parquet(folder)
        earlier = known.filter(F.col("batch_number") < number).agg(F.max("newest")).first()[0]
    batch.agg(F.max(ms).alias("newest")).write.mode("overwrite").parquet(f"{folder}/batch_number={number}")
    return earlier, spark.read.schema("newest bigint").parquet(f"{folder}/batch_number={number}").first()[0]


def drain_late(stream: DataFrame, delay_ms: int, ms: str = "received_ms", arrivals: Iterable[Callable[[], object]] = NOTHING) -> DataFrame:
    """Rows that came behind the watermark, which stateful operators drop: older than the newest of the earlier micro-batches less ``delay_ms``.

    Every micro-batch leaves its newest time in a row of its own, so a restarted or replayed query finds the same watermark.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/feedloom-late-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        earlier, _ = _newest(batch, number, ms, f"{root}/marks")
        late = batch.filter(F.lit(False)) if earlier is None else late_rows(batch, earlier - delay_ms, ms)
        late.write.mode("overwrite").parquet(f"{root}/out/batch_number={number}")

    _run(stream, "append", write, root, arrivals)
    return spark.read.schema(stream.schema).option("basePath", f"{root}/out").parquet(f"{root}/out")


def drain_alerts(
    stream: DataFrame, rules: DataFrame, evaluate: Callable[[DataFrame, int], DataFrame], opened: DataFrame, ms: str = "received_ms",
    arrivals: Iterable[Callable[[], object]] = NOTHING,
) -> DataFrame:
    """Alert events after the rules were evaluated behind every micro-batch, at the newest time the stream has shown.

    ``evaluate(facts, now)`` gives the metrics from all facts so far; ``opened`` are the events there were before. Each
    evaluation writes the event table anew, from the one before it, so a replayed batch repeats its evaluation only.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/feedloom-alerts-{uuid.uuid4().hex}"
    names = opened.columns

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/facts/batch_number={number}")
        facts = spark.read.schema(stream.schema).option("basePath", f"{root}/facts").parquet(f"{root}/facts")
        now = max((x for x in _newest(batch, number, ms, f"{root}/marks") if x is not None), default=None)
        if now is None:
            opened.write.mode("overwrite").parquet(f"{root}/events/{number}")
            return
        before = spark.read.schema(opened.schema).parquet(f"{root}/events/{number - 1}") if number else opened
        after = O.evaluate_alerts(rules, evaluate(facts, now + 1), before, now + 1)
        O.cascade_delete(after, rules).select(*names).write.mode("overwrite").parquet(f"{root}/events/{number}")

    _run(stream, "append", write, root, arrivals)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/events")
    last = max(int(f.getPath().getName()) for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder))
    return spark.read.schema(opened.schema).parquet(f"{root}/events/{last}")


class Fold:
    """A table kept by a stream: ``rows`` makes state rows of events, ``merge`` combines state rows with each other, in any
    order, and ``finish`` reads the result from them."""

    def __init__(self, rows: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame]):
        self.rows, self.merge, self.finish = rows, merge, finish


def _current_rows(events: DataFrame) -> DataFrame:
    return events.select(
        *B.EVENT_KEY, "event_type", F.struct("received_ms", "event_id").alias("first"), "dwell_ms",
        F.col("received_ms").alias("last_ms"), F.lit(1).cast("bigint").alias("n"),
    )


def _merge_current(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*B.EVENT_KEY, "event_type").agg(
        F.min("first").alias("first"), F.max("dwell_ms").alias("dwell_ms"), F.max("last_ms").alias("last_ms"), F.sum("n").alias("n")
    )


def _finish_current(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("first.event_id").alias("event_id"), "event_type", *B.EVENT_KEY, "dwell_ms", F.col("first.received_ms").alias("received_ms"),
        "last_ms", (F.col("n") - 1).alias("repeats"),
    )


#: Rows of ``stream_dedup``, by merging.
CURRENT = Fold(_current_rows, _merge_current, _finish_current)


def _id_rows(events: DataFrame) -> DataFrame:
    payload = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in B.PAYLOAD]), 256)
    digest = events.select("event_id", payload.alias("__p"))
    # 120 bits of the digest, as numbers
    words = [F.conv(F.substring("__p", 1 + 15 * i, 15), 16, 10).cast("bigint").alias(f"p{i}") for i in range(2)]
    return digest.select("event_id", *words, F.lit(False).alias("mixed"), F.lit(1).cast("bigint").alias("deliveries"))


def _merge_ids(rows: DataFrame) -> DataFrame:
    differ = (F.min("p0") != F.max("p0")) | (F.min("p1") != F.max("p1"))
    return rows.groupBy("event_id").agg(
        F.min("p0").alias("p0"), F.min("p1").alias("p1"), (F.max("mixed") | differ).alias("mixed"), F.sum("deliveries").alias("deliveries")
    )


def _finish_ids(rows: DataFrame) -> DataFrame:
    return rows.filter("mixed").select("event_id", "deliveries")


#: Rows of ``stream_conflicts``, by merging.
CONFLICTS = Fold(_id_rows, _merge_ids, _finish_ids)


def _pair_rows(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") != "revisit").select(*B.EVENT_KEY, "event_type", "dwell_ms", F.col("received_ms").alias("last_ms"))


def _merge_pairs(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*B.EVENT_KEY, "event_type").agg(F.max("dwell_ms").alias("dwell_ms"), F.max("last_ms").alias("last_ms"))


def _finish_pairs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "item_id").agg(*B.state_aggregates())


#: Rows of ``stream_state``, by merging: the state is the distinct events, so no row grows with its pair.
PAIRS = Fold(_pair_rows, _merge_pairs, _finish_pairs)


#: Every so many micro-batches the parts of a folded table become one.
MERGE_EVERY = 8


def drain_fold(stream: DataFrame, fold: Fold, arrivals: Iterable[Callable[[], object]] = NOTHING) -> DataFrame:
    """Fold everything available into a table, micro-batch by micro-batch, and return what it gives at the end.

    The state is a table, not an operator's store: every micro-batch merges its rows and writes them under its number,
    every ``MERGE_EVERY``-th one together with the parts before it, and readers merge the parts there are. These are ordinary
    shuffles that may spill: no task holds its share of all keys on the heap, a restart loads nothing, and a
    replayed micro-batch overwrites its own part only.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/feedloom-fold-{uuid.uuid4().hex}"
    empty = fold.merge(fold.rows(spark.createDataFrame([], stream.schema)))
    last = -1

    def parts(number: int) -> DataFrame:
        first = max(0, (number + 1) // MERGE_EVERY * MERGE_EVERY - 1)
        return spark.read.schema(empty.schema).parquet(*[f"{root}/state/{i}" for i in range(first, number + 1)])

    def write(batch: DataFrame, number: int) -> None:
        nonlocal last
        rows = fold.rows(batch)
        if number and (number + 1) % MERGE_EVERY == 0:
            rows = parts(number - 1).unionByName(rows)
        fold.merge(rows).write.mode("overwrite").parquet(f"{root}/state/{number}")
        last = number

    _run(stream, "append", write, root, arrivals)
    return fold.finish(empty if last < 0 else fold.merge(parts(last)))


def latest_update(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows of an update-mode stream: the newest batch per key."""
    names = [c for c in updates.columns if c not in (*keys, "batch_number")]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch_number").alias("r"))
    return newest.select(*keys, "r.*")


def late_rows(batch: DataFrame, watermark_ms: int, ms: str = "received_ms") -> DataFrame:
    """Rows older than the watermark, for a side table."""
    return batch.filter(F.col(ms) < watermark_ms)
