"""Similarity join of documents on word shingles, by rare-first prefixes.

A document is its set of hashed word shingles. Copies of one set are one class, known by the set's
signature. The sets' shingles are ordered by how often they occur (a bounded sketch of counts over all documents), ties
by hash; two sets that reach the threshold share a shingle among the first few, the prefix. Classes meet on
prefix shingles, pass length, positional and suffix filters, and are verified once per pair on their whole
sets. The suffix filter bounds how much two sets differ from below: where they meet by 256 parity bits, each
telling whether a set holds an odd number of its shingles, before verification by counts in 16 parts.

A large group of near copies is not unfolded into all its pairs: in each prefix bucket all classes meet the
bucket's leader first, and only classes that the verified links have not yet brought together meet each
other. So every component is exact, and every pair between different components has been excluded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, components, flagged, materialise, maybe_among

#: Counters of the frequency sketch, added up in parts: its size, and that of what is broadcast, never depends on the data.
SKETCH, SLICES = 1 << 22, 64
#: Bits of the broadcast bitmap of shingles that several classes share.
SHARED_BITS = 1 << 24
#: Classes of shingles whose counts the suffix filter compares.
PARTS = 16
#: Words of 64 parity bits of a set.
PARITY = 4
ODD = [f"p{i}" for i in range(PARITY)]
#: Bits of a class number that come from the signature; the size of the set stands above them, larger ones as SIZE_TOP.
CLASS_BITS, SIZE_TOP = 44, (1 << 19) - 1
#: Bytes of text unfolded at once; a longer text is unfolded alone.
SLICE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
    up, down = (np.full(n, b, dtype=np.uint64) for b in (base, inverse))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _slice_powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers for ordinary slices, kept; those for longer texts are not."""
    return _powers(SLICE_BYTES)


def shingle_hashes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after the other, and where each text's begin.

    Words are runs of bytes that are no ASCII white space, A-Z in lower case. A text of fewer than ``n`` words
    is one shingle; a text without words, and a null, has none.
    """
    texts = texts.fill_null("").cast(pa.string())  # 32-bit offsets
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][(offsets[:-1] < len(raw))]
    begins[edges] = inside[edges]  # a text's first word begins at its border
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    borders = offsets[1:][offsets[1:] > 0] - 1
    ends[borders] = inside[borders]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _slice_powers() if len(raw) <= SLICE_BYTES else _powers(len(raw))
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw + np.uint64(1)) * up[: len(raw)])])
    words = (total[last + 1] - total[first]) * down[first]
    words = mixed(words + (last - first).astype(np.uint64) * _MULT)
    text = np.searchsorted(offsets, first, side="right") - 1
    count = np.bincount(text, minlength=len(texts))
    start = np.concatenate([[0], np.cumsum(count)])
    # one shingle from each word that has n - 1 more behind it; short texts take what they have
    value = np.zeros(len(words), dtype=np.uint64)
    place = np.arange(len(words)) - start[text]
    left = count[text] - place
    for k in range(n):
        here = left > k
        part = np.zeros(len(words), dtype=np.uint64)
        part[: len(words) - k][here[: len(words) - k]] = words[k:][here[: len(words) - k]]
        value = np.where(here, mixed(value * _MULT + part + np.uint64(k + 1)), value)
    keep = (left >= n) | ((place == 0) & (count[text] < n))
    value, text = value[keep], text[keep]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[fresh], text[fresh]
    return value, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])


def signatures(value: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128 bits per set: two sums of scrambled hashes, so the order of a set does not matter."""
    out = []
    for seed in (np.uint64(0x1234567), np.uint64(0x89ABCDE)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(value ^ mixed(np.array([seed]))))])
        out.append(mixed(total[starts[1:]] - total[starts[:-1]] + (starts[1:] - starts[:-1]).astype(np.uint64)))
    both = np.stack(out, axis=1).astype(">u8").tobytes()
    return [both[i : i + 16] for i in range(0, len(both), 16)]


def parities(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per set a row of PARITY words: each bit is set if the set holds an odd number of the bit's shingles.

    Bits in which two sets differ are no more than the shingles that only one of them holds.
    """
    bits, rows = 64 * PARITY, len(starts) - 1
    owner = np.repeat(np.arange(rows), starts[1:] - starts[:-1])
    place = owner * bits + (mixed(value) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(place, minlength=rows * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, bits), axis=1).view(np.int64)


def _bucket(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)


def _sets(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Rows of two kinds: documents (k, sig, n, parity), and each task's counts (slice, counts) for the sketch."""
    odd = ", ".join(f"{p} bigint" for p in ODD)
    kind = docs.schema[key].dataType.simpleString()
    names = ["k", "sig", "n", *ODD, "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, own = np.zeros(SKETCH, dtype=np.uint32), None
        for batch in by_size(batches, 1, SLICE_BYTES):
            own = batch.schema[0].type
            value, starts = shingle_hashes(batch.column(1), n)
            np.add.at(counts, _bucket(value), np.uint32(1))
            words, rows = parities(value, starts), batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(signatures(value, starts), pa.binary()), pa.array(starts[1:] - starts[:-1], pa.int64()),
                 *[pa.array(words[:, i]) for i in range(PARITY)], pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names,
            )
        for i, part in enumerate(counts.reshape(SLICES, -1)):
            if own is not None and part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, own), pa.nulls(1, pa.binary()), *[pa.nulls(1, pa.int64())] * (1 + PARITY), pa.array([i], pa.int32()),
                     pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=names,
                )

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(
        run, f"k {kind}, sig binary, n bigint, {odd}, slice int, counts binary"
    )


def _sketch(found: DataFrame) -> np.ndarray:
    """Counts of all tasks added up, first in groups of tasks, then per slice; the driver gets the sketch alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                total = totals.setdefault(i, np.zeros(SKETCH // SLICES, dtype=np.uint64))
                total += np.frombuffer(zlib.decompress(part.as_buffer()), dtype=np.uint32)
        for i, total in totals.items():
            full = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(full.tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    parts = found.filter(F.col("slice").isNotNull()).select("slice", "counts")
    group = F.pmod(F.xxhash64("counts"), F.lit(16))
    parts = parts.repartition("slice", group).mapInArrow(run, "slice int, counts binary")
    counts = np.zeros((SLICES, SKETCH // SLICES), dtype=np.uint32)
    for row in parts.repartition("slice").mapInArrow(run, "slice int, counts binary").toLocalIterator():
        counts[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.uint32)
    return counts.ravel()


def _prefixes(docs: DataFrame, text: str, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(token, class, pos): the prefix of every set, rarest shingles first. Sets a task has given out are left out.

    A class number holds the size of the set and the first bits of its signature: enough to meet by in a bucket.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, given = shared.value, set()
        for batch in by_size(batches, 0, SLICE_BYTES):
            value, starts = shingle_hashes(batch.column(0), n)
            sigs = signatures(value, starts)
            size = starts[1:] - starts[:-1]
            new = np.zeros(len(sigs), dtype=bool)
            for i, sig in enumerate(sigs):
                if size[i] and sig not in given:
                    given.add(sig)
                    new[i] = True
            head = np.frombuffer(b"".join(sigs), dtype=">u8")[::2].astype(np.uint64) >> np.uint64(64 - CLASS_BITS)
            classes = np.minimum(size, SIZE_TOP) << CLASS_BITS | head.astype(np.int64)
            owner = np.repeat(np.arange(len(sigs)), size)
            keep = new[owner]
            value, owner = value[keep], owner[keep]
            order = np.lexsort((value, often[_bucket(value)], owner))
            value, owner = value[order], owner[order]
            first = np.concatenate([[0], np.cumsum(np.where(new, size, 0))])
            pos = np.arange(len(value)) - first[owner]
            length = size - (percent * size + 99) // 100 + 1
            own = pos < length[owner]
            value, owner, pos = value[own], owner[own], pos[own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(classes[owner]), pa.array(pos, pa.int32())], names=["token", "class", "pos"],
            )

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "token bigint, class bigint, pos int")


def _in_reach(percent: int, na: Column, nb: Column, best: Column) -> Column:
    """Length and positional filter: ``best`` is the most two sets of these sizes can still share."""
    # overlap * (100 + percent) >= percent * (na + nb) is the threshold on intersection over union
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * best >= percent * (na + nb))


def _reachable(percent: int, x: str, y: str, xpos: Column, ypos: Column) -> Column:
    """``_in_reach`` by the sizes in two class numbers; sizes at the top are not known and pass."""
    nx, ny = (F.shiftright(c, CLASS_BITS) for c in (x, y))
    return (F.greatest(nx, ny) >= SIZE_TOP) | _in_reach(percent, nx, ny, F.least(nx - xpos, ny - ypos))


def _may_link(met: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """(a, b): signatures of the met classes (x, y, xpos, ypos) that length, positional and (by parity) suffix filter leave."""
    fields = ["sig", "n", *ODD]
    one, two = (facts.select(F.col("class").alias(c), F.struct(*fields).alias(f"f{c}")) for c in "xy")
    na, nb = F.col("fx.n"), F.col("fy.n")
    apart = sum((F.bit_count(F.col(f"fx.{p}").bitwiseXOR(F.col(f"fy.{p}"))) for p in ODD), F.lit(0))
    best = F.least(na - F.col("xpos"), nb - F.col("ypos"))
    left = met.join(one, "x").join(two, "y").filter(
        (F.col("fx.sig") != F.col("fy.sig")) & _in_reach(percent, na, nb, best) & ((100 + percent) * (na + nb - apart) >= 2 * percent * (na + nb))
    )
    return left.select(F.least("fx.sig", "fy.sig").alias("a"), F.greatest("fx.sig", "fy.sig").alias("b")).distinct()


def _class_sets(docs: DataFrame, key: str, text: str, n: int, wanted: DataFrame) -> DataFrame:
    """(sig, hashes, parts) of the wanted classes (k, sig), from one document each."""
    place = wanted.withColumn("h", F.xxhash64("k"))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64("k"))
    near = maybe_among(rows, "h", place.select("h"))
    texts = near.join(place.select(F.col("k").alias("wk"), "h", "sig"), "h").filter(F.col("k").eqNullSafe(F.col("wk"))).select("sig", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1, SLICE_BYTES):
            value, starts = shingle_hashes(batch.column(1), n)
            right = [a == b for a, b in zip(signatures(value, starts), batch.column(0).to_pylist())]  # keys may repeat
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(value.view(np.int64)))
            owner = np.repeat(np.arange(len(right)), starts[1:] - starts[:-1])
            parts = np.zeros((len(right), PARTS), dtype=np.int32)
            np.add.at(parts, (owner, (value % np.uint64(PARTS)).astype(np.int64)), 1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(right) + 1) * PARTS, pa.int32()), pa.array(parts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, flat], names=["sig", "hashes", "parts"]).filter(pa.array(right, pa.bool_()))

    return texts.mapInArrow(run, "sig binary, hashes array<bigint>, parts array<int>")


def _verified(docs: DataFrame, key: str, text: str, n: int, pairs: DataFrame, standing: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the suffix filter and reach the threshold on their whole sets.

    Only the texts of classes in a pair are read again, from the one document that stands for each (k, sig).
    """
    classes = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(standing, "sig").select("k", "sig")
    sets = materialise(_class_sets(docs, key, text, n, classes))
    small = sets.select("sig", "parts", F.size("hashes").alias("n"))
    left, right = (small.select(*[F.col(c).alias(f"{x}_{c}") for c in small.columns]) for x in "ab")
    # suffix filter: what two sets differ by in each part adds up to no more than they may differ by
    apart = F.aggregate(F.zip_with("a_parts", "b_parts", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    both = F.col("a_n") + F.col("b_n")
    near = (
        pairs.join(left, F.col("a") == F.col("a_sig")).join(right, F.col("b") == F.col("b_sig"))
        .filter((100 + percent) * (both - apart) >= 2 * percent * both).select("a", "b")
    )
    whole = sets.select("sig", "hashes")
    one, two = (whole.select(F.col("sig").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    shared = F.size(F.array_intersect("ha", "hb"))
    return (
        near.join(one, "a").join(two, "b")
        .filter((100 + percent) * shared >= percent * (F.size("ha") + F.size("hb"))).select("a", "b")
    )


def similar_classes(docs: DataFrame, key: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents (k, sig, n) and class components (node, root) under links of at least ``percent`` per cent."""
    found = materialise(_sets(docs, key, text, n))
    rows = found.filter(F.col("sig").isNotNull())
    standing = materialise(
        rows.filter("n > 0").groupBy("sig").agg(F.min("k").alias("k"), F.first("n").alias("n"), *[F.first(p).alias(p) for p in ODD])
    )
    head = F.shiftrightunsigned(F.conv(F.substring(F.hex("sig"), 1, 16), 16, -10).cast("bigint"), 64 - CLASS_BITS)
    number = F.shiftleft(F.least(F.col("n"), F.lit(SIZE_TOP)).cast("bigint"), CLASS_BITS).bitwiseOR(head).alias("class")
    facts = materialise(standing.select(number, "sig", "n", *ODD))
    rows, standing = rows.select("k", "sig", "n"), standing.select("sig", "k")
    # postings carry what they meet by; the least class of a shingle that several share leads its bucket
    postings = materialise(_prefixes(docs, text, n, percent, _sketch(found)))
    leads = materialise(
        postings.groupBy("token").agg(F.min("class").alias("lead"), F.max("class").alias("top")).filter("lead <> top").select("token", "lead")
    )
    near = maybe_among(postings, "token", leads.select("token"), SHARED_BITS).repartition("token").dropDuplicates(["token", "class"])
    meeting = materialise(near.join(leads, "token"))
    zero = F.lit(0)
    led = meeting.filter((F.col("class") != F.col("lead")) & _reachable(percent, "class", "lead", F.col("pos"), zero))
    led = led.groupBy(F.col("class").alias("x"), F.col("lead").alias("y")).agg(F.min("pos").alias("xpos"), F.lit(0).alias("ypos"))
    tried = materialise(_may_link(led, facts, percent))
    linked = materialise(_verified(docs, key, text, n, tried, standing, percent))
    # classes the leader did not bring together meet the others of their bucket, under all filters
    named = materialise(_named(meeting, components(linked), facts))
    rest = named.filter(~F.col("led"))
    one, two = (
        df.select("token", *[F.col(c).alias(f"{x}_{c}") for c in named.columns if c != "token"]) for x, df in (("x", rest), ("y", named))
    )
    na, nb = F.col("x_n"), F.col("y_n")
    apart = sum((F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}"))) for p in ODD), F.lit(0))
    met = one.join(two, "token").filter(
        (F.col("x_c") != F.col("y_c")) & (F.col("y_led") | (F.col("x_class") < F.col("y_class")))
        & _in_reach(percent, na, nb, F.least(na - F.col("x_pos"), nb - F.col("y_pos"))) & ((100 + percent) * (na + nb - apart) >= 2 * percent * (na + nb))
    )
    met = met.groupBy(F.col("x_class").alias("x"), F.col("y_class").alias("y")).agg(F.min("x_pos").alias("xpos"), F.min("y_pos").alias("ypos"))
    again = materialise(_may_link(met, facts, percent).join(tried, ["a", "b"], "left_anti"))
    more = materialise(_verified(docs, key, text, n, again, standing, percent))
    return rows, components(linked.unionByName(more))


def _named(meeting: DataFrame, joined: DataFrame, facts: DataFrame) -> DataFrame:
    """(token, class, pos, c, led, n, parity) of the buckets with several components: c names one, led tells whether it is the leader's."""
    label = materialise(joined.join(facts, joined["node"] == facts["sig"]).select("class", F.xxhash64("root").alias("root")))
    named = meeting.join(label, "class", "left").withColumn("c", F.coalesce("root", "class")).drop("root")
    heads = label.select(F.col("class").alias("lead"), F.col("root").alias("lead_root"))
    named = named.join(heads, "lead", "left").select("token", "class", "pos", "c", (F.col("c") == F.coalesce("lead_root", "lead")).alias("led"))
    named = materialise(named)
    open_ones = named.filter(~F.col("led")).select("token").distinct()
    return named.join(open_ones, "token", "left_semi").join(facts.select("class", "n", *ODD), "class")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Per row: ``key``, ``n_shingles``, ``component_id``.

    Two documents link when 100 * intersection >= percent * union of their sets of ``n``-word shingles.
    ``component_id`` is the smallest key reachable by links, the row itself included; null keys count as larger
    than any key. A text of fewer than ``n`` words is one shingle; a null text and one without words has none and
    is linked with nothing. Repeated rows and equal texts are one class and always together. Other columns are not read.
    """
    rows, linked = similar_classes(docs, key, text, n, percent)
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min("k").alias("low"))
    roots = linked.join(classes, linked["node"] == classes["sig"]).groupBy("root").agg(F.min("low").alias("least"))
    label = linked.join(roots, "root").select(F.col("node").alias("sig"), "least")
    # classes with one document need no label of their own
    several = rows.filter("n > 0").groupBy("sig").agg(F.min("k").alias("low"), F.count(F.lit(1)).alias("many"))
    names = several.join(label, "sig", "left").filter("many > 1 OR least IS NOT NULL").select("sig", F.coalesce("least", "low").alias("c"))
    alone = F.when(F.col("n") > 0, F.col("sig"))
    return (
        rows.withColumn("sig", alone).join(names, "sig", "left")
        .select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("c", "k").alias("component_id"))
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of near duplicates: the smallest key.

    Null keys come last; equal keys go by a hash of key and text, and of rows that repeat both one stays. Texts
    without words are in no group and all stay.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    k, t = f"c{names.index(key)}", f"c{names.index(text)}"
    own = own.withColumn("at", F.xxhash64(k, t))
    slim = own.select(F.struct(F.col(k).isNull().alias("none"), F.col(k).alias("key"), "at").alias("k"), F.col(t).alias("t"))
    found = materialise(near_duplicates(slim, "k", "t", n, percent).filter("n_shingles > 0"))
    gone = found.filter(F.col("k") != F.col("component_id")).select("k.at").distinct()
    many = found.groupBy("k").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("k.at")
    marked = flagged(own, "at", gone.unionByName(many), "meets")
    plain = [f"c{i}" for i in range(len(names))]
    kept = marked.filter("meets").join(gone, "at", "left_anti")
    # flagged rows that repeat: of those with words one stays
    wordy = F.col(t).rlike(r"[^\x20\x09-\x0D]")
    once = kept.filter(wordy).dropDuplicates(["at"]).select(*plain)
    rest = kept.filter(~F.coalesce(wordy, F.lit(False))).select(*plain)
    return marked.filter(~F.col("meets")).select(*plain).unionByName(once).unionByName(rest).toDF(*names)
