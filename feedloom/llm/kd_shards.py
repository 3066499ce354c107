"""Shards of near-equal bytes by a K-d tree over the rows' metadata.

A node that still holds several shards is cut at a weighted median along its widest dimension, with
weights of the rows' bytes; a node of k shards gives floor(k/2) of them to its lower side, so any number of
shards works. Medians come from histograms that are refined until the cut is exact to ``TOLERANCE`` of a
shard; the driver sees histograms of fixed size, never rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Bins of one histogram, and how far from the median a cut may lie, as a part of one shard.
BINS = 2048
TOLERANCE = 1e-3
#: Rows are numbered inside this many parts of a shard, so no task orders a whole shard.
PARTS = 256
#: Bytes a row takes besides its text.
ROW_BYTES = 16

LOW_BITS = 31  # a dimension's value fills the upper bits of a cut position, a hash of the row the lower


def metadata(docs: DataFrame, key: str, text: str, dimensions: dict[str, Column]) -> DataFrame:
    """key, size, crc and the dimensions as whole numbers from 0 to 2**31 - 1, with a row number; written once."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("k"),
        (F.octet_length(body) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        *[F.coalesce(c, F.lit(0)).cast("double").alias(f"d_{name}") for name, c in dimensions.items()],
    ).withColumn("row", F.monotonically_increasing_id())
    return materialise(rows)


def _scaled(rows: DataFrame, names: list[str]) -> DataFrame:
    """Dimensions scaled to whole numbers by their overall range; ``tie`` spreads equal values."""
    ends = rows.agg(*[f(f"d_{n}").alias(f"{w}_{n}") for n in names for w, f in (("lo", F.min), ("hi", F.max))]).first()
    top = (1 << LOW_BITS) - 1
    scaled = []
    for n in names:
        low, high = ends[f"lo_{n}"], ends[f"hi_{n}"]
        width = (high - low) if low is not None and high > low else 1.0
        scaled.append(F.round((F.col(f"d_{n}") - F.lit(low or 0.0)) / width * top).cast("bigint").alias(n))
    tie = F.expr(f"pmod(xxhash64(row), {1 << LOW_BITS})").alias("tie")
    return rows.select("k", "size", "crc", "row", tie, *scaled)


def _entry(table: dict[int, int]) -> Column:
    """The table's entry for the row's node; one entry per node, at most as many as shards."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("node"))


def shard_tree(rows: DataFrame, names: list[str], shards: int) -> tuple[DataFrame, list[tuple[int, str, int]]]:
    """Rows with their leaf ``node``, and the cuts in order: (node, dimension, position). Node ids: the lower side of node n is 2n, the upper 2n+1, the root 1.

    Each of the log2(shards) levels is a handful of aggregations over the metadata, whose new nodes are then
    written and read back.
    """
    holds, cuts = {1: shards}, []
    placed = rows.withColumn("node", F.lit(1))
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return placed, cuts
    while any(k > 1 for k in holds.values()):
        open_nodes = [n for n, k in holds.items() if k > 1]
        spans = placed.filter(F.col("node").isin(open_nodes)).groupBy("node").agg(
            F.sum("size").alias("size"),
            *[f(n).alias(f"{w}_{n}") for n in names for w, f in (("lo", F.min), ("hi", F.max))],
        )
        facts = {r["node"]: r for r in spans.collect()}  # one row per open node
        widest, goal, window = {}, {}, {}
        for n in open_nodes:
            r = facts.get(n)
            if r is None:  # no rows: its shards stay empty
                continue
            widest[n] = max(names, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"], -names.index(d)))
            goal[n] = r["size"] * (holds[n] // 2) / holds[n]
            window[n] = (r[f"lo_{widest[n]}"] << LOW_BITS, (r[f"hi_{widest[n]}"] + 1) << LOW_BITS, 0)
        position = _position(widest, names)
        exact: dict[int, int] = {}
        slack = TOLERANCE * total / shards
        while len(exact) < len(goal):
            todo = [n for n in goal if n not in exact]
            step = {n: max(1, -((window[n][0] - window[n][1]) // BINS)) for n in todo}
            low, high = (_entry({n: window[n][i] for n in todo}) for i in (0, 1))
            bins = (
                placed.filter(F.col("node").isin(todo)).withColumn("at", position)
                .filter((F.col("at") >= low) & (F.col("at") < high))
                .groupBy("node", F.call_function("div", F.col("at") - low, _entry(step)).alias("bin"))
                .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
            )
            counted: dict[int, dict[int, tuple[int, int]]] = {n: {} for n in todo}
            for r in bins.collect():  # open nodes x BINS rows at most
                counted[r["node"]][r["bin"]] = (r["size"], r["rows"])
            for n in todo:
                low, high, before = window[n]
                for b in sorted(counted[n]):
                    inside, count = counted[n][b]
                    if before + inside >= goal[n]:
                        break
                    before += inside
                first, last = low + b * step[n], low + (b + 1) * step[n]
                under, over = goal[n] - before, before + inside - goal[n]
                if min(under, over) <= slack or count == 1 or step[n] == 1:  # close, or one row or position
                    exact[n] = first if under < over else last
                else:
                    window[n] = (first, min(last, high), before)
        cuts += [(n, widest[n], exact[n]) for n in goal]
        placed = materialise(placed.withColumn("node", _descend(cuts[len(cuts) - len(goal) :], names)))
        for n in open_nodes:
            k = holds.pop(n)
            holds[2 * n], holds[2 * n + 1] = k // 2, k - k // 2
            if n not in goal:
                holds[2 * n] = holds[2 * n + 1] = 1
    return placed, cuts


def _position(widest: dict[int, str], names: list[str]) -> Column:
    """Place of a row along its node's dimension: value, then the hash that spreads equal values."""
    value = None
    for name in names:
        nodes = [n for n, d in widest.items() if d == name]
        if nodes:
            test = F.col("node").isin(nodes)
            value = F.when(test, F.col(name)) if value is None else value.when(test, F.col(name))
    return F.shiftleft(value, LOW_BITS) + F.col("tie")


def _descend(cuts: list[tuple[int, str, int]], names: list[str]) -> Column:
    """Node after the cuts of one level."""
    node = F.col("node")
    if not cuts:
        return node
    position = _position({n: d for n, d, _ in cuts}, names)
    border = _entry({n: at for n, _, at in cuts})
    return F.when(border.isNull(), node).otherwise(node * 2 + (position >= border).cast("int"))


def _shard_numbers(cuts: list[tuple[int, str, int]], shards: int) -> dict[int, int]:
    """Leaves from left to right, numbered from 0 by the shards that lie to their left."""
    inner, numbers = {n for n, _, _ in cuts}, {}

    def visit(node: int, k: int, first: int) -> None:
        if node in inner and k > 1:
            visit(2 * node, k // 2, first)
            visit(2 * node + 1, k - k // 2, first + k // 2)
        else:
            numbers[node] = first

    visit(1, shards, 0)
    return numbers


def shard_by_bytes(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text",
    dimensions: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: ``key``, ``size``, ``text_crc32``, ``shard`` from 0, ``slot`` from 0 without gaps, ``grown_shard`` (null).

    Give the number of shards, or the bytes a shard should hold. Sizes are UTF-8 bytes plus 16; null texts count
    as empty. Null dimensions count as 0. Equal values are told apart by a hash of the row, so neither ties,
    repeated rows nor one hot source can make a shard too large; a single row above a shard's share stays whole.
    An empty table gives no rows. Only key, text and the dimensions are read.
    """
    if dimensions is None:
        dimensions = {"length": F.log1p(F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("double")), "content": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))}
    names = list(dimensions)
    rows = metadata(docs, key, text, dimensions)
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    scaled = materialise(_scaled(rows, names))
    placed, cuts = shard_tree(scaled, names, shards)
    numbers = _shard_numbers(cuts, shards)
    placed = placed.select("k", "size", "crc", "row", _entry(numbers).cast("int").alias("shard")).withColumn(
        "part", F.expr(f"pmod(xxhash64(row), {PARTS})")
    )
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("row")
    # shards x PARTS offsets: bounded by parameters
    return (
        placed.withColumn("r", F.row_number().over(inside)).join(F.broadcast(offsets), ["shard", "part"])
        .select(
            F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard",
            (F.col("first") + F.col("r") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
