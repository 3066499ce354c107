"""Shared pieces of the text operators: bounded Arrow batches, bitmap filter, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, prepare_session

#: Rows and bytes Spark packs into one Arrow batch: a task holds one batch, however long the texts.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20
#: Bits of the broadcast bitmap in ``maybe_among``; its size never depends on the data.
BITMAP_BITS = 1 << 21


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: shipped package, bounded Arrow batches."""
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def by_size(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``size`` bytes of the string column, one row at least."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + (n or 0) > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def flagged(df: DataFrame, key: str, wanted: DataFrame, flag: str, size: int = BITMAP_BITS) -> DataFrame:
    """Rows of ``df`` with a flag: whether the 64-bit hash ``key`` may occur in ``wanted`` (same column).

    The wanted hashes set bits of one bitmap of a fixed ``size`` in bits, which is broadcast. Some
    unwanted rows are flagged, wanted ones always; an exact join of the flagged rows follows. It keeps the
    texts of the other rows out of that join's shuffle.
    """
    word = (F.expr(f"pmod({key}, {size})") / 64).cast("int").alias("__word")
    bit = f"shiftleft(1L, cast(pmod({key}, 64) AS int))"
    bits = wanted.select(word, F.expr(bit).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    return (
        df.select("*", word).join(F.broadcast(bits), "__word", "left")
        .withColumn(flag, F.coalesce(F.expr(f"(__bits & {bit}) != 0"), F.lit(False))).drop("__word", "__bits")
    )


def maybe_among(df: DataFrame, key: str, wanted: DataFrame, size: int = BITMAP_BITS) -> DataFrame:
    """Rows of ``df`` whose hash may occur in ``wanted``; see ``flagged``."""
    return flagged(df, key, wanted, "__among", size).filter("__among").drop("__among")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, root) for every node of an edge, root the smallest node of its component.

    Alternating large-star and small-star steps. Every step is a combinable minimum per node and an
    equi-join that adaptive execution can split, so a hub with any number of neighbours never meets in
    one task. Each round's edges are written to the shared folder and read back.
    """
    pairs = edges.select(
        F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    ).filter("lo < hi").distinct()
    current, state = materialise(pairs), None
    while True:
        # large star: neighbours above a node move to the smallest node around it
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(low, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        )
        # small star: neighbours below a node, and the node, move to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).filter("lo < hi")
        small = small.unionByName(low.select(F.col("m").alias("lo"), "hi")).distinct()
        current = materialise(small)
        seen = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.countDistinct("hi")
        ).first()
        # a fixed point is a forest of stars: every node above has one root
        if seen[0] == seen[2] and (state == tuple(seen) or _stars(current)):
            break
        state = tuple(seen)
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """No root lies below another node."""
    roots, nodes = edges.select(F.col("lo").alias("x")), edges.select(F.col("hi").alias("x"))
    return roots.join(nodes, "x", "left_semi").isEmpty()
