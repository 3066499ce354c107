"""Exact duplicates by Patricia tries: the node where a text ends stores the row that stays.

Tasks first collapse the copies they read in a trie of their own, so a text that fills a third of all
rows leaves each task once. What is left is partitioned by length and content hash, sorted, and inserted
into tries of full byte strings. A (length, hash) key is one subtree; sorted input completes it, so it is
spilled to the output before the next begins, and a task holds one subtree at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of texts a task's first trie holds; beyond, its largest subtree is spilled to the shuffle.
TRIE_BYTES = 32 << 20

OWNER = "struct<length:bigint,hash:bigint>"


class Trie:
    """Compressed radix trie over byte strings. A node is [edge bytes, children by first byte, value or None]."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def insert(self, word: bytes, owner, count: int) -> None:
        """Add ``count`` rows of a text; the terminal node keeps the largest owner (None is least)."""
        node, at = self.root, 0
        while True:
            rest = len(word) - at
            if not rest:
                break
            child = node[1].get(word[at])
            if child is None:
                child = [word[at:], {}, None]
                node[1][word[at]] = child
                self.bytes += rest
                node, at = child, len(word)
                continue
            edge = child[0]
            same = len(edge) if word.startswith(edge, at) else common_prefix(edge, word, at)
            if same < len(edge):  # split the edge
                lower = [edge[same:], child[1], child[2]]
                child[0], child[1], child[2] = edge[:same], {edge[same]: lower}, None
            node, at = child, at + same
        old = node[2]
        if old is None:
            node[2] = (owner, count)
        else:
            best = owner if old[0] is None or (owner is not None and owner > old[0]) else old[0]
            node[2] = (best, old[1] + count)

    def items(self, node=None, prefix: bytes = b"") -> Iterator[tuple[bytes, object, int]]:
        """Texts with owner and count, below a node."""
        stack = [(node or self.root, prefix)]
        while stack:
            here, before = stack.pop()
            word = before + here[0]
            if here[2] is not None:
                yield word, *here[2]
            stack += [(child, word) for child in here[1].values()]

    def spill(self) -> Iterator[tuple[bytes, object, int]]:
        """Give out and forget the subtree below the root that holds most bytes."""
        sizes = {first: sum(len(n[0]) for n in walk(child)) for first, child in self.root[1].items()}
        first = max(sizes, key=sizes.get)
        child = self.root[1].pop(first)
        self.bytes -= sizes[first]
        yield from self.items(child)


def walk(node: list) -> Iterator[list]:
    stack = [node]
    while stack:
        here = stack.pop()
        yield here
        stack += here[1].values()


def common_prefix(edge: bytes, word: bytes, at: int) -> int:
    """Bytes that ``edge`` shares with ``word`` from ``at`` on; bisected, so compared in C."""
    low, high = 0, min(len(edge), len(word) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if edge[low:mid] == word[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null counts as empty."""
    return (text or "").encode().lower()  # bytes.lower() changes A-Z only


def content_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _local(key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), []

        def pack(rows):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([len(w) for w, _, _ in rows], pa.int64()),
                    pa.array([content_hash(w) for w, _, _ in rows], pa.int64()),
                    pa.array([w for w, _, _ in rows], pa.binary()),
                    pa.array([o for _, o, _ in rows], key_type),
                    pa.array([c for _, _, c in rows], pa.int64()),
                ],
                names=["length", "hash", "word", "owner", "n"],
            )

        def leave(items):
            size = 0
            for item in items:
                out.append(item)
                size += len(item[0])
                if size > 4 << 20 or len(out) >= 2000:
                    yield pack(out)
                    out.clear()
                    size = 0

        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                trie.insert(normalised(text), owner, 1)
                while trie.bytes > TRIE_BYTES and trie.root[1]:
                    yield from leave(trie.spill())
        yield from leave(trie.items())
        if out:
            yield pack(out)

    return run


def _merge(key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, key = Trie(), None

        def pack(rows):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(w).hexdigest() for w, _, _ in rows], pa.string()),
                    pa.array([o for _, o, _ in rows], key_type),
                    pa.array([c for _, _, c in rows], pa.int64()),
                ],
                names=["sha", "owner", "n"],
            )

        for batch in batches:
            out = []
            for length, hashed, word, owner, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (length, hashed) != key:
                    out += [x for x in trie.items() if x[2] > 1]
                    trie, key = Trie(), (length, hashed)
                trie.insert(word, owner, n)
            if out:
                yield pack(out)
        last = [x for x in trie.items() if x[2] > 1]
        if last:
            yield pack(last)

    return run


def owners(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(sha, owner, n) of every text that several rows share."""
    kind = docs.schema[key].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    first = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(
        _local(arrow), f"length bigint, hash bigint, word binary, owner {kind}, n bigint"
    )
    return (
        first.repartition("length", "hash").sortWithinPartitions("length", "hash")
        .mapInArrow(_merge(arrow), f"sha string, owner {kind}, n bigint")
    )


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_sha256) of every row: SHA-256 of the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas = [hashlib.sha256(normalised(t)).hexdigest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string())], names=["k", "sha"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, sha string")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the largest key stays; a null key stays only if its group has no other. Rows that repeat key and text all
    carry ``kept`` of that key. Other columns are not read. The key may be a long, int or string.
    """
    rows, groups = fingerprints(docs, key, text), owners(docs, key, text)
    joined = rows.join(groups, "sha", "left")
    keep = F.when(F.col("n").isNull(), F.col("k")).otherwise(F.col("owner"))
    return joined.select(
        F.col("k").alias(key), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        keep.eqNullSafe(F.col("k")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
