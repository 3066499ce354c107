"""Trie of conversation prefixes by fixed-length block hashing.

Turns are hashed once and their texts left behind. ``BLOCK`` turns make a block; conversations meet by what they hold
before a block and by the block's digest, so copies are one row from then on. Where all that share a
prefix go on with one block, its turns are nodes as they are; only blocks whose siblings diverge are compared turn
by turn.

A node's place is the smallest conversation through it and its depth. So each conversation owns one stretch of
nodes, hung below a node of a smaller conversation, and sums over subtrees are sums along stretches plus what
hangs on them; totals of stretches are added up by pointer jumping, in rounds that double the distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Turns in a block, and turns or blocks ordered by one task at a time.
BLOCK, CHUNK = 8, 256
#: Hashes are pairs of 64-bit words with these seeds.
SEEDS = (11, 12)


def _before(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], values: dict[str, Column], whole) -> DataFrame:
    """``df`` with each value combined over the earlier rows of its group by ``whole`` (an aggregate; 0 is neutral).

    ``chunk`` must not fall along ``order``: chunks are combined first, so no task orders a whole long group.
    """
    rows = df.withColumn("__chunk", chunk)
    sums = rows.groupBy(*keys, "__chunk").agg(*[whole(v).alias(f"__{n}") for n, v in values.items()])
    past = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "__chunk", *[F.coalesce(whole(F.col(f"__{n}")).over(past), F.lit(0).cast("bigint")).alias(f"__{n}") for n in values])
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumns({f"__in_{n}": F.coalesce(whole(v).over(inside), F.lit(0).cast("bigint")) for n, v in values.items()})
    both = here.join(carried, [*keys, "__chunk"])
    out = {n: _both(whole, F.col(f"__{n}"), F.col(f"__in_{n}")) for n in values}
    return both.withColumns(out).drop("__chunk", *[f"__{n}" for n in values], *[f"__in_{n}" for n in values])


def _both(whole, a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b) if whole is F.bit_xor else a + b


def numbered_turns(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, pos, h0, h1, bytes): the turns of every conversation from 0, hashed, with the bytes of their texts."""
    r, x = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    slim = turns.filter(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("bigint").alias("c"), F.col(turn).cast("bigint").alias("t"),
        *[F.xxhash64(F.lit(s), r, x).alias(f"h{i}") for i, s in enumerate(SEEDS)], F.octet_length(x).cast("bigint").alias("bytes"),
    )
    chunk = F.coalesce(F.floor(F.col("t") / CHUNK), F.lit(-(1 << 62)))
    order = [F.col("t").asc_nulls_first(), F.col("h0"), F.col("h1")]
    return _before(slim, ["c"], chunk, order, {"pos": F.lit(1).cast("bigint")}, F.sum).select("c", "pos", "h0", "h1", "bytes")


def rebuilt(own: DataFrame, stride: int = 5, heads: int = 9) -> DataFrame:
    """Conversations that begin with the first h turns of c - c % stride and go on with their own behind the first h.

    h is crc32(c as text) % heads. Conversations without turns keep a row with null ``pos``.
    """
    head = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    convs = own.select("c").distinct().withColumn("h", head).withColumn("donor", F.col("c") - F.col("c") % stride)
    first = own.filter(F.col("pos") < heads - 1)
    lengths = first.groupBy(F.col("c").alias("donor")).agg(F.count(F.lit(1)).alias("there"))
    sized = convs.join(lengths, "donor", "left").withColumn("given", F.least("h", F.coalesce("there", F.lit(0))).cast("bigint"))
    sized = materialise(sized.select("c", "h", "donor", "given"))
    lent = (
        sized.join(first.withColumnRenamed("c", "donor"), "donor").filter(F.col("pos") < F.col("h"))
        .select("c", "pos", "h0", "h1", "bytes")
    )
    kept = own.join(sized, "c").filter(F.col("pos") >= F.col("h")).select("c", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "h0", "h1", "bytes")
    return lent.unionByName(kept).unionByName(sized.select("c"), allowMissingColumns=True)


def _blocks(turns: DataFrame) -> DataFrame:
    """(c, b, size, before0, before1, c0_j, c1_j, bytes_j): blocks with the hash of all blocks before and running hashes."""
    at = F.col("pos") % BLOCK
    columns = [f"{n}_{j}" for j in range(BLOCK) for n in ("h0", "h1", "bytes")]
    blocks = turns.groupBy("c", F.floor(F.col("pos") / BLOCK).cast("bigint").alias("b")).agg(
        F.count(F.lit(1)).cast("int").alias("size"),
        *[F.max(F.when(at == j, F.col(n))).alias(f"{n}_{j}") for j in range(BLOCK) for n in ("h0", "h1", "bytes")],
    ).select("c", "b", "size", *columns)
    for j in range(BLOCK):  # running hash of the first turns of the block; null behind its last turn
        seeds = [F.lit(s) if j == 0 else F.col(f"c{i}_{j - 1}") for i, s in enumerate(SEEDS)]
        there = F.col(f"h0_{j}").isNotNull()
        blocks = blocks.withColumns({f"c{i}_{j}": F.when(there, F.xxhash64(seeds[i], f"h0_{j}", f"h1_{j}")) for i in range(2)})
    blocks = blocks.drop(*[f"h{i}_{j}" for i in range(2) for j in range(BLOCK)])
    digests = {f"d{i}": F.coalesce(*[F.col(f"c{i}_{j}") for j in reversed(range(BLOCK))]) for i in range(2)}
    blocks = materialise(blocks.withColumns(digests))
    value = {f"before{i}": F.xxhash64(F.col("b"), f"d{i}") for i in range(2)}
    return _before(blocks, ["c"], F.floor(F.col("b") / CHUNK), [F.col("b")], value, F.bit_xor)


def _nodes(blocks: DataFrame) -> DataFrame:
    """(x0, x1, up0, up1, depth, n_convs, low, bytes) of every node but the root, by id and the id of its parent."""
    prefix = ["b", "before0", "before1"]
    carried = [f"{n}_{j}" for j in range(BLOCK) for n in ("c0", "c1", "bytes")]
    groups = materialise(
        blocks.groupBy(*prefix, "d0", "d1").agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("low"), *[F.first(c).alias(c) for c in carried]
        )
    )

    def node(i: int, j: int) -> Column:
        return F.col(f"before{i}").bitwiseXOR(F.xxhash64(F.col("b"), f"c{i}_{j}"))

    each = [
        F.struct(
            *[node(i, j).alias(f"x{i}") for i in range(2)],
            *[(node(i, j - 1) if j else F.col(f"before{i}")).alias(f"up{i}") for i in range(2)],
            (F.col("b") * BLOCK + j + 1).alias("depth"), F.col(f"bytes_{j}").alias("bytes"), F.col(f"c0_{j}").isNotNull().alias("there"),
        )
        for j in range(BLOCK)
    ]
    unfolded = ["x0", "x1", "up0", "up1", "depth", "n_convs", "low", "bytes"]

    def turn_by_turn(some: DataFrame) -> DataFrame:
        flat = some.select("n_convs", "low", F.explode(F.array(*each)).alias("t")).filter("t.there")
        return flat.select(*[F.col(f"t.{c}") if c not in ("n_convs", "low") else F.col(c) for c in unfolded])

    siblings = groups.groupBy(*prefix).agg(F.count(F.lit(1)).alias("kinds"))
    marked = groups.join(siblings, prefix)
    alone = turn_by_turn(marked.filter("kinds = 1"))
    diverging = turn_by_turn(marked.filter("kinds > 1")).groupBy("x0", "x1", "up0", "up1", "depth").agg(
        F.sum("n_convs").alias("n_convs"), F.min("low").alias("low"), F.max("bytes").alias("bytes")
    )
    return alone.unionByName(diverging.select(*unfolded))


def _end_digests(ends: DataFrame) -> DataFrame:
    """(x0, x1, ends_sha256): per node with conversations that end there, (x0, x1, c), the hash of their sorted numbers.

    A hash has one order of input: numbers stream through the task of their node, sorted by Spark, and are not held.
    """
    counted = ends.groupBy("x0", "x1").agg(F.count(F.lit(1)).alias("many"), F.min("c").alias("c"))
    single = counted.filter("many = 1").select("x0", "x1", F.sha2(F.col("c").cast("string").cast("binary"), 256).alias("ends_sha256"))
    several = ends.join(counted.filter("many > 1").select("x0", "x1"), ["x0", "x1"])
    ordered = several.repartition("x0", "x1").sortWithinPartitions("x0", "x1", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(node, digest):
            return pa.RecordBatch.from_arrays(
                [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["x0", "x1", "ends_sha256"]
            )

        node, digest = None, hashlib.sha256()
        for batch in batches:
            for a, b, c in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if node == (a, b):
                    digest.update(f",{c}".encode())
                    continue
                if node is not None:
                    yield row(node, digest)
                node, digest = (a, b), hashlib.sha256(str(c).encode())
        if node is not None:
            yield row(node, digest)

    return single.unionByName(ordered.select("x0", "x1", "c").mapInArrow(run, "x0 bigint, x1 bigint, ends_sha256 string"))


def _totals(stretches: DataFrame) -> DataFrame:
    """(c, saved, leaves) over a stretch and all that hangs below it, from (c, above, saved, leaves) of stretches alone.

    After round r every stretch has the sums of those less than 2**r below it and points 2**r above itself.
    """
    current = stretches
    while True:
        moved = current.filter(F.col("above").isNotNull()).groupBy(F.col("above").alias("c")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        jump = current.select(F.col("c").alias("above"), F.col("above").alias("next"))
        current = materialise(
            current.join(moved, "c", "left").join(jump, "above", "left")
            .select("c", F.col("next").alias("above"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"))
        )
        if current.filter(F.col("above").isNotNull()).isEmpty():
            return current.select("c", "saved", "leaves")


def trie_of(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations given as (c, pos, h0, h1, bytes); those without turns as rows with null ``pos``."""
    convs = turns.groupBy("c").agg(F.count("pos").alias("len"))
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("low")).filter("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    blocks = materialise(_blocks(turns.filter(F.col("pos").isNotNull())))
    top = root.select(
        zero.alias("x0"), zero.alias("x1"), F.lit(None).cast("bigint").alias("up0"), F.lit(None).cast("bigint").alias("up1"),
        zero.alias("depth"), "n_convs", "low", zero.alias("bytes"),
    )
    nodes = materialise(_nodes(blocks).unionByName(top))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    # stretches: the nodes whose smallest conversation is c
    own = nodes.groupBy(F.col("low").alias("c")).agg(
        F.min_by(F.struct("up0", "up1"), "depth").alias("up"), F.min("depth").alias("first"), F.max("depth").alias("last"), F.sum(saved).alias("saved")
    )
    hung = own.select("c", "first", "last", "saved", F.col("up.up0").alias("x0"), F.col("up.up1").alias("x1"))
    hung = materialise(hung.join(nodes.select("x0", "x1", F.col("low").alias("above")), ["x0", "x1"], "left").drop("x0", "x1"))
    places = hung.filter(F.col("above").isNotNull())
    busy = places.select(F.col("above").alias("c"), (F.col("first") - 1).alias("last")).distinct().withColumn("busy", F.lit(True))
    ended = hung.join(busy, ["c", "last"], "left").withColumn("leaves", F.when(F.col("busy"), 0).otherwise(1).cast("bigint"))
    totals = materialise(_totals(materialise(ended.select("c", "above", "saved", "leaves"))))
    attached = (
        places.select("c", "above", "first").join(totals, "c").groupBy(F.col("above").alias("low"), (F.col("first") - 1).alias("depth"))
        .agg(F.count(F.lit(1)).alias("hung"), F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"))
    )
    rows = nodes.join(attached, ["low", "depth"], "left").na.fill(0, ["hung", "hung_saved", "hung_leaves"])
    values = {"saved_above": saved + F.col("hung_saved"), "leaves_above": F.col("hung_leaves")}
    summed = _before(rows, ["low"], F.floor(F.col("depth") / CHUNK), [F.col("depth")], values, F.sum)
    facts = hung.select(F.col("c").alias("low"), "above", "first", "last").join(totals.withColumnRenamed("c", "low"), "low")
    # ends: the node behind a conversation's last turn
    size = F.col("size")
    final = [F.col(f"before{i}").bitwiseXOR(F.xxhash64(F.col("b"), f"d{i}")).alias(f"x{i}") for i in range(2)]
    lasting = blocks.select("c", (F.col("b") * BLOCK + size).alias("len"), *final).join(convs, ["c", "len"]).select("c", "x0", "x1")
    ends = lasting.unionByName(convs.filter("len = 0").select("c", zero.alias("x0"), zero.alias("x1")))
    digests = _end_digests(materialise(ends))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    parent = F.when(F.col("depth") == F.col("first"), F.col("above")).otherwise(F.col("low"))
    return summed.join(facts, "low").join(digests, ["x0", "x1"], "left").select(
        F.col("low").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs",
        (F.col("hung") + (F.col("depth") < F.col("last")).cast("bigint")).alias("n_children"),
        (F.col("leaves") - F.col("leaves_above")).alias("n_leaves"), (F.col("saved") - F.col("saved_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def prefix_trie(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = False
) -> DataFrame:
    """One row per distinct prefix of the conversations, from the empty one: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``saved_tokens`` adds up, over the node and all below, the bytes of the last text for each member but one.
    ``ends_sha256`` hashes the numbers of the members that have no further turn. Turns go by number, null first; equal
    numbers and repeated rows go by a hash of role and text and are turns of their own. Null roles and texts are empty;
    rows without a conversation are left out. With ``rebuild`` conversations first take over turns (``rebuilt``). An
    empty table gives no rows, not even a root. Prefixes are known by 128-bit hashes. Other columns are not read.
    """
    own = materialise(numbered_turns(turns, conversation, turn, role, text))
    return trie_of(materialise(rebuilt(own)) if rebuild else own)
