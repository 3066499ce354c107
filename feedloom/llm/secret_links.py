"""Secrets in texts: base patterns, and weak candidates linked to the parts that complete them.

A credential often has several parts: an access identifier, a secret, an endpoint. Base spans (``assign``,
``access``, ``hex``) are reported as they are. Weak candidates, which alone would be noise, are reported only
where a complementary part lies in the same scope, found by an interval join in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# Patterns of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Kinds in order; a span list sorts by start, then by this order.
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
BASE = 3
#: What each kind stands for in a credential.
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "ident", "ident": "ident", "endpoint": "endpoint"}
# weak kinds
IDENT = re.compile(
    r"""(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""",
    re.ASCII | re.IGNORECASE,
)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(
    r"""(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{3,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]{4,})""",
    re.ASCII | re.IGNORECASE,
)
#: Code points between two parts of one credential, at most.
SCOPE = 200

SPAN = "struct<kind:int,start:int,end:int>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, in code points; leftmost, not overlapping per kind."""
    spans = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return spans


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates that overlap no base span; a URL may have one inside, such as a signature."""
    spans = [(3, m.start(1), m.end(1)) for m in IDENT.finditer(text)]
    spans += [(4, m.start(), m.end()) for m in OPAQUE.finditer(text)]
    spans += [(5, *(m.span(1) if m[1] else m.span())) for m in ENDPOINT.finditer(text)]
    if not base:
        return spans

    def own(s: tuple[int, int, int]) -> bool:
        return not any(b[1] < s[2] and s[1] < b[2] and not (s[0] == 5 and s[1] < b[1] and b[2] <= s[2]) for b in base)

    return [s for s in spans if own(s)]


def extract(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, content, base, weak): spans of every whole text. ``content`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        names = ("kind", "start", "end")
        for batch in batches:
            base, weak = [], []
            for text in batch.column(2).to_pylist():
                own = base_spans(text) if text else []
                base.append(own)
                weak.append(weak_spans(text, own) if text else [])
            rows = [pa.array([[dict(zip(names, s)) for s in spans] for spans in x], kind) for x in (base, weak)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *rows], names=["k", "content", "base", "weak"])

    return docs.select(
        F.col(key).alias("k"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content"), F.col(text).alias("t")
    ).mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, content string, base array<{SPAN}>, weak array<{SPAN}>")


def _role(kind: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])]), F.col(kind))


def link(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(content, linked): weak spans with a part of another role within ``scope`` code points.

    Interval join in bins: a weak span looks into the bins its scope reaches, a part lies in the bin where it
    starts and, if it is long, in every bin it covers; a bin holds a bounded number of spans. A weak span
    counts if a base part of another role is near, or two further weak parts so that all three roles meet.
    """
    one = spans.dropDuplicates(["content"])
    weak = one.select("content", F.explode("weak").alias("w"))
    parts = one.filter(F.size("weak") > 0).select("content", F.explode(F.concat("base", "weak")).alias("p"))
    bins = F.explode(F.sequence(((F.col("w.start") - scope) / scope).cast("int") - 1, ((F.col("w.end") + scope) / scope).cast("int")))
    left = weak.withColumn("bin", bins)
    right = parts.withColumn("bin", F.explode(F.sequence((F.col("p.start") / scope).cast("int"), (F.col("p.end") / scope).cast("int"))))
    near = (
        left.join(right, ["content", "bin"])
        .filter((F.col("p.start") - F.col("w.end") <= scope) & (F.col("w.start") - F.col("p.end") <= scope))
        .withColumn("role", _role("p.kind"))
        .filter(F.col("role") != _role("w.kind"))
        .groupBy("content", "w")
        .agg(
            F.max(F.col("p.kind") < BASE).alias("strong"),
            F.max((F.col("role") == "secret").cast("int")).alias("s"),
            F.max((F.col("role") == "ident").cast("int")).alias("i"),
            F.max((F.col("role") == "endpoint").cast("int")).alias("e"),
        )
        .filter(F.col("strong") | (F.col("s") + F.col("i") + F.col("e") == 2))
    )
    return near.groupBy("content").agg(F.collect_list("w").alias("linked"))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: ``key``, ``base`` and ``linked`` spans (arrays of kind, start, end; kind numbers as in KINDS).

    A null text counts as empty and has no spans; repeated rows and null keys stay, each with the spans of
    its text; other columns are not read. Texts are scanned once and whole; only spans are shuffled. A text
    without weak candidates takes no part in the join. Spans of one text come back in its row.
    """
    spans = materialise(extract(docs, key, text))
    linked = link(spans, scope)
    none = F.array().cast(f"array<{SPAN}>")
    return (
        spans.withColumn("content", F.when(F.size("weak") > 0, F.col("content")))
        .join(linked, "content", "left")
        .select(F.col("k").alias(key), "base", F.coalesce("linked", none).alias("linked"))
    )


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(order, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    def counted(kind: int) -> Column:
        # one parameter: a second one would be the place in the array
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [counted(i).alias(f"n_{KINDS[i]}") for i in range(BASE)]
    return found.select(
        key, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("bigint").alias("n_linked"),
    )
