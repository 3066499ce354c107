"""Near duplicates among embeddings by comparing PCA-ordered tiles.

Unit vectors are rotated to their principal axes. Leading dimensions are accumulated first; what the rest can add is
at most the product of the suffix norms, so most pairs stop after a few dimensions. Two vectors within the
threshold are close in every coordinate, hence rows are dealt to cells of a grid over the first axes, crowded cells are
cut further, and a tile meets only tiles of neighbouring cells whose boxes come close enough.

Equal vectors of one label are one class. A tile pair gives, per class, the number of vectors linked to it, and a
forest of its links: never a row per pair, however crowded a group of near copies is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise
from .whitening import finite, folded, matrix, usual_width

#: Axes of the grid, further axes that cut a crowded cell, leading coordinates a tile's box has.
AXES, FINER, BOX = 3, 3, 8
#: Classes in a tile, about.
TILE = 4096
#: Rows of one tile compared with the other tile at a time, and pairs continued at a time.
SLAB, PIECE = 512, 1 << 18
#: Dimensions after which bounds are looked at.
STEPS = (8, 16, 32, 64, 128, 256, 512, 1024)
#: A share of surviving pairs from which whole slabs go on instead of single pairs.
DENSE = 0.25
#: Wider than the rounding of a rotated product; decisions within it are made on the vectors as they are.
SLACK = 1e-9


def _unit(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows divided by their norms; scaled first, so that no square leaves the range of doubles."""
    x = matrix(column, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(rows: DataFrame, width: int) -> np.ndarray:
    """Orthogonal matrix whose columns are the principal axes of the unit vectors, widest first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width)
        for batch in batches:
            u = _unit(batch.column(0), width)
            n, total = n + len(u), total + u.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(total)], names=["dim", "n", "total"]
        )

    found = rows.mapInArrow(sums, "dim int, n bigint, total double").groupBy("dim").agg(F.sum("total") / F.sum("n")).orderBy("dim").collect()
    mean = np.array([r[1] for r in found])

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([(_unit(batch.column(0), width) - mean).tobytes()], pa.binary())], names=["block"])

    return np.linalg.svd(folded(rows.mapInArrow(centred, "block binary"), width))[2].T


def _placed(rows: DataFrame, kind: str, width: int, axes: np.ndarray, reach: float) -> DataFrame:
    """(k, label, class, cell, finer, box, v): class digest, grid cells and leading coordinates of every row."""
    across, lead = min(AXES + FINER, width), min(BOX, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = matrix(batch.column(2), width) + 0.0  # no negative zeros
            p = _unit(batch.column(2), width) @ axes
            cells = np.zeros((len(p), AXES + FINER), dtype=np.int32)
            cells[:, :across] = np.floor(p[:, :across] / reach)
            box = np.concatenate([p[:, :lead], np.linalg.norm(p[:, lead:], axis=1)[:, None]], axis=1)
            stored = [row.tobytes() for row in raw]
            # all vectors have one length, so what is left of a digest's input is the label
            names = [hashlib.blake2b(v + w.encode(), digest_size=16).digest() for v, w in zip(stored, batch.column(1).to_pylist())]

            def lists(x: np.ndarray, of: pa.DataType) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), of))

            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.binary()), lists(cells[:, :AXES], pa.int32()),
                 lists(cells[:, AXES:], pa.int32()), lists(box, pa.float64()), pa.array(stored, pa.binary())],
                names=["k", "label", "class", "cell", "finer", "box", "v"],
            )

    schema = f"k {kind}, label string, class binary, cell array<int>, finer array<int>, box array<double>, v binary"
    return rows.select("k", "label", "v").mapInArrow(run, schema)


def _tiles(classes: DataFrame) -> DataFrame:
    """Classes with the number of their tile: a grid cell, a finer cell where that is crowded, a part of it if still so."""
    spot, finer = ["label", "cell"], ["label", "cell", "finer"]
    crowded = classes.groupBy(*spot).agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > TILE).select(*spot, F.lit(True).alias("cut"))
    cut = classes.join(crowded, spot, "left").withColumn("finer", F.when(F.col("cut"), F.col("finer")).otherwise(F.array().cast("array<int>"))).drop("cut")
    parts = (
        cut.groupBy(*finer).agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > TILE)
        .select(*finer, F.ceil(F.col("many") / TILE).alias("parts"))
    )
    both = cut.join(parts, finer, "left")
    part = F.pmod(F.xxhash64("class"), F.coalesce("parts", F.lit(1)))
    return both.withColumn("tile", F.xxhash64(*finer, part)).drop("parts")


def _meeting(tiles: DataFrame, lead: int, reach: float) -> DataFrame:
    """(a, b): tiles of one label whose boxes leave a link possible, each pair once, and every tile with itself."""
    bounds = [f(F.get("box", F.lit(i))).alias(f"{n}{i}") for i in range(lead + 1) for n, f in (("low", F.min), ("high", F.max))]
    boxes = materialise(tiles.groupBy("label", "cell", "tile").agg(*bounds))
    around = F.array(*[F.array(*[F.lit(d) for d in step]) for step in np.ndindex(*[3] * AXES)])
    shifted = F.transform(around, lambda step: F.zip_with("cell", step, lambda c, d: c + d - 1))
    one = boxes.select("label", F.explode(shifted).alias("cell"), *[F.col(c).alias(f"a_{c}") for c in boxes.columns if c not in ("label", "cell")])
    two = boxes.select("label", "cell", *[F.col(c).alias(f"b_{c}") for c in boxes.columns if c not in ("label", "cell")])
    gap = F.lit(0.0)
    for i in range(lead + 1):
        side = F.greatest(F.lit(0.0), F.col(f"a_low{i}") - F.col(f"b_high{i}"), F.col(f"b_low{i}") - F.col(f"a_high{i}"))
        gap = gap + side * side
    return one.join(two, ["label", "cell"]).filter((F.col("a_tile") <= F.col("b_tile")) & (gap <= reach * reach)).select(
        F.col("a_tile").alias("a"), F.col("b_tile").alias("b")
    )


def _stages(width: int) -> list[tuple[int, int]]:
    ends = [s for s in STEPS if s < width] + [width]
    return list(zip([0, *ends[:-1]], ends))


def _suffix_norms(p: np.ndarray) -> np.ndarray:
    """Norms of p[:, end:] for the end of every stage, as rows."""
    return np.stack([np.linalg.norm(p[:, end:], axis=1) for _, end in _stages(p.shape[1])])


def _linked(x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray, sx: np.ndarray, sy: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y reach the cosine. x and y are rotated unit vectors, raw ones as they came."""
    total = np.zeros((len(x), len(y)))
    stages = _stages(x.shape[1])
    for at, (start, end) in enumerate(stages):
        total += x[:, start:end] @ y[:, start:end].T
        alive = total + np.outer(sx[at], sy[at]) >= cosine - SLACK
        if end == x.shape[1] or np.count_nonzero(alive) < DENSE * alive.size:
            break
    i, j = np.nonzero(alive)
    out = np.zeros(alive.shape, dtype=bool)
    for first in range(0, len(i), PIECE):
        a, b = i[first : first + PIECE], j[first : first + PIECE]
        part = total[a, b]
        for later in range(at + 1, len(stages)):
            start, end = stages[later]
            part = part + np.einsum("ij,ij->i", x[a, start:end], y[b, start:end])
            keep = part + sx[later][a] * sy[later][b] >= cosine - SLACK
            a, b, part = a[keep], b[keep], part[keep]
        sure = part >= cosine + SLACK
        near = np.flatnonzero(~sure)
        one, two = raw_x[a[near]], raw_y[b[near]]
        exact = np.einsum("ij,ij->i", one, two) / (np.linalg.norm(one, axis=1) * np.linalg.norm(two, axis=1))
        sure[near] = exact >= cosine
        out[a[sure], b[sure]] = True
    return out


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def compare_tiles(a: tuple, b: tuple | None, axes: np.ndarray, cosine: float) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(classes, vectors linked to each, place of the root of each) for two tiles, or one with itself.

    A tile is (classes, weights, raw vectors); links of one class with itself are not counted.
    """
    def ready(tile: tuple) -> tuple:
        raw = tile[2]
        u = raw / np.abs(raw).max(axis=1, keepdims=True)
        u = (u / np.linalg.norm(u, axis=1, keepdims=True)) @ axes
        return raw, u, _suffix_norms(u)

    raw_a, x, sx = ready(a)
    raw_b, y, sy = (raw_a, x, sx) if b is None else ready(b)
    shift = 0 if b is None else len(x)
    weight_b = a[1] if b is None else b[1]
    counts = np.zeros(len(x) + (0 if b is None else len(y)), dtype=np.int64)
    parent = np.arange(len(counts))
    for start in range(0, len(x), SLAB):
        rows = slice(start, min(start + SLAB, len(x)))
        links = _linked(x[rows], y, raw_a[rows], raw_b, sx[:, rows], sy, cosine)
        if b is None:
            own = np.arange(len(links))
            links[own, own + start] = False
        if not links.any():
            continue
        counts[rows] += links @ weight_b
        if b is not None:
            counts[shift:] += a[1][rows] @ links
        while True:
            parent = _roots(parent)
            one, two = parent[rows], parent[shift : shift + len(y)]
            i, j = np.nonzero(links & (one[:, None] != two[None, :]))
            if not len(i):
                break
            np.minimum.at(parent, np.maximum(one[i], two[j]), np.minimum(one[i], two[j]))
    return a[0] + ([] if b is None else b[0]), counts, _roots(parent)


def _links(pairs: DataFrame, tiles: DataFrame, width: int, axes: np.ndarray, cosine: float) -> DataFrame:
    """(class, links, root): per tile pair the classes with links, vectors linked to them, a class of their component."""
    shared = tiles.sparkSession.sparkContext.broadcast(axes)  # width x width

    def tile(row: pa.RecordBatch, side: str, i: int) -> tuple:
        names, many, raw = (row.column(f"{side}_{c}")[i].values for c in ("class", "many", "v"))
        flat = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.float64).reshape(-1, width)
        return names.to_pylist(), many.to_numpy().astype(np.int64), flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = batch.column("same").to_pylist()
            for i in range(batch.num_rows):
                a = tile(batch, "a", i)
                b = None if same[i] else tile(batch, "b", i)
                names, counts, root = compare_tiles(a, b, shared.value, cosine)
                there = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[p] for p in there], pa.binary()), pa.array(counts[there]),
                     pa.array([names[root[p]] for p in there], pa.binary())], names=["class", "links", "root"],
                )

    packed = materialise(
        tiles.groupBy("tile").agg(F.collect_list(F.struct("class", "many", "v")).alias("rows"))
        .select("tile", *[F.col(f"rows.{c}").alias(c) for c in ("class", "many", "v")])
    )
    one, two = (packed.select(*[F.col(c).alias(f"{s}_{c}" if c != "tile" else s) for c in packed.columns]) for s in "ab")
    none = [F.when(F.col("a") != F.col("b"), F.col(f"b_{c}")).alias(f"b_{c}") for c in ("class", "many", "v")]
    work = pairs.join(one, "a").join(two, "b").select((F.col("a") == F.col("b")).alias("same"), "a_class", "a_many", "a_v", *none)
    return work.mapInArrow(run, "class binary, links bigint, root binary")


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98
) -> DataFrame:
    """Per row: ``key``, ``n_links``, ``component_id``, ``kept``.

    Two vectors of one label, not null, link when their cosine is at least ``cosine`` (over 0). ``n_links`` counts the
    other rows linked to the row itself, repeated rows and equal vectors included; ``component_id`` is the smallest
    key reachable by links, the row itself included, where null keys count as larger than any key; ``kept`` tells
    whether it is the row's own. Vectors that are null, zero or empty, hold null or non-finite components or are not of
    the most frequent length, and rows without a label, link with nothing. An empty table gives no rows. Other
    columns are not read.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("k"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    good = rows.filter(F.col("label").isNotNull() & finite("v") & F.exists("v", lambda c: c != 0))
    width = usual_width(good, "v")
    if width == 0:
        found = rows.select("k", F.lit(0).cast("bigint").alias("n_links"), F.col("k").alias("c"))
    else:
        good = good.filter(F.size("v") == width)
        axes = principal_axes(good.select("v"), width)
        reach = math.sqrt(2 - 2 * cosine) + SLACK
        placed = materialise(_placed(good, kind, width, axes, reach))
        first = ["label", "cell", "finer", "box", "v"]
        classes = materialise(
            placed.groupBy("class").agg(F.min("k").alias("low"), F.count(F.lit(1)).alias("many"), *[F.first(c).alias(c) for c in first])
        )
        tiles = materialise(_tiles(classes))
        pairs = _meeting(tiles, min(BOX, width), reach)
        links = materialise(_links(pairs, tiles, width, axes, cosine))
        joined = components(links, "class", "root")
        lows = joined.join(classes, joined["node"] == classes["class"]).groupBy("root").agg(F.min("low").alias("least"))
        least = joined.join(lows, "root").select(F.col("node").alias("class"), "least")
        counts = links.groupBy("class").agg(F.sum("links").alias("links"))
        # classes of one row without links need no entry of their own
        named = (
            classes.select("class", "many", "low").join(counts, "class", "left").join(least, "class", "left")
            .filter("many > 1 OR links IS NOT NULL")
            .select("class", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "low").alias("c"))
        )
        valid = placed.select("k", "class").join(named, "class", "left").select("k", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("c", "k").alias("c"))
        usable = F.col("label").isNotNull() & finite("v") & F.exists("v", lambda c: c != 0) & (F.size("v") == width)
        others = rows.filter(~F.coalesce(usable, F.lit(False))).select("k", F.lit(0).cast("bigint").alias("n_links"), F.col("k").alias("c"))
        found = valid.unionByName(others)
    return found.select(
        F.col("k").alias(key), "n_links", F.col("c").alias("component_id"), F.col("k").eqNullSafe(F.col("c")).alias("kept")
    )
