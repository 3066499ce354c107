"""Column expressions shared by all operators. Everything here stays inside code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V


def epoch_ms(column: Column | str) -> Column:
    """Epoch milliseconds of a timestamp; a timestamp without zone is read as UTC."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_millis(column.cast("timestamp"))


def as_of(df: DataFrame, cutoff, ts: str = "ts_ms") -> DataFrame:
    """Rows known at the cutoff. Feature cutoffs are inclusive."""
    return df.filter(F.col(ts) <= cutoff)


def time_range(df: DataFrame, start_ms: int, end_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Half-open window ``[start, end)`` of at most 366 days."""
    if start_ms >= end_ms:
        raise ValueError("range start must precede its end")
    if end_ms - start_ms > V.MAX_RANGE_DAYS * V.DAY_MS:
        raise ValueError("range is longer than 366 days")
    return df.filter((F.col(ts) >= start_ms) & (F.col(ts) < end_ms))


def last_day(now_ms: int) -> tuple[int, int]:
    """The window used when a caller names none."""
    return now_ms - V.DAY_MS, now_ms


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient with 0.0 for an empty denominator."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / F.when(denominator != 0, denominator.cast("double"))
    )


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < F.lit(float("inf")))


def clamp(column: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), column))


def score_key(column: Column | str) -> Column:
    """The value rankings compare."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, V.SCORE_DIGITS)


def rank_share(rank0: Column, size: Column) -> Column:
    """``1 - rank / max(1, n - 1)`` for a rank counted from 0."""
    return F.lit(1.0) - rank0.cast("double") / F.greatest(F.lit(1), size - 1).cast("double")


def hash_uniform(*parts) -> Column:
    """Reproducible number in [0, 1) from a key; 52 bits of a SHA-256 digest."""
    key = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def sample_key(seed: int, purpose: str, ident: Column) -> Column:
    """Digest that orders ids for bounded deterministic samples."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), ident.cast("string")), 256)


def dwell_affinity(dwell_ms: Column) -> Column:
    return (
        F.when(dwell_ms < V.DWELL_MIN_MS, 0.0)
        .when(dwell_ms < V.DWELL_SHORT_MS, 0.25)
        .when(dwell_ms < V.DWELL_LONG_MS, 0.75)
        .otherwise(1.5)
    )


def feedback_weight(event_type: Column, dwell_ms: Column) -> Column:
    """Weight of one event; null where the event carries no feedback."""
    graded = F.when(dwell_ms.between(V.DWELL_MIN_MS, V.DWELL_MAX_MS), dwell_affinity(dwell_ms))
    expr = F.when(event_type == "dwell", graded)
    for name, (weight, _) in V.FEEDBACK.items():
        expr = expr.when(event_type == name, F.lit(weight))
    return expr


def feedback_disposition(event_type: Column, dwell_ms: Column) -> Column:
    expr = F.when(
        (event_type == "dwell") & dwell_ms.between(V.DWELL_MIN_MS, V.DWELL_MAX_MS), F.lit("positive")
    )
    for name, (_, kind) in V.FEEDBACK.items():
        expr = expr.when(event_type == name, F.lit(kind))
    return expr


def calibrate(source: Column, raw: Column) -> Column:
    """Bounded transform per source; 0.0 for a missing or non-finite score."""
    log_score = F.log1p(F.greatest(F.lit(0.0), raw))
    mapped = (
        F.when(source == "svd", 0.5 + 0.5 * F.tanh(raw))
        .when(source.isin("dssm", "content", "visual"), clamp(0.5 + 0.5 * raw))
        .when(source.isin("item_cf", "popular"), log_score / (1.0 + log_score))
        .otherwise(clamp(raw))
    )
    return F.when(finite(raw), mapped).otherwise(F.lit(0.0))


def bucket_of(value: Column, bounds: Iterable[int]) -> Column:
    """Number of boundaries not above the value."""
    total = F.lit(0)
    for bound in bounds:
        total = total + F.when(value >= bound, 1).otherwise(0)
    return total


def title_tokens(title: Column) -> Column:
    """Distinct lower-case word tokens; single ASCII characters carry no meaning."""
    found = F.regexp_extract_all(title, F.lit("([A-Za-z0-9]+|[\\u4e00-\\u9fff])"), F.lit(1))
    kept = F.filter(found, lambda t: (F.length(t) > 1) | (F.octet_length(t) > F.length(t)))
    return F.array_sort(F.array_distinct(F.transform(kept, F.lower)))


def collapse_spaces(text: Column) -> Column:
    """Lower-cased text in which runs of two or more white spaces became one blank."""
    return F.regexp_replace(F.lower(text), "(?U)\\s\\s+", " ")


def explode_ngrams(df: DataFrame, text: str, low: int, high: int, name: str = "term") -> DataFrame:
    """One row per character n-gram; ``text`` is replaced by the n-gram.

    The text is cleaned once per row; positions and widths then unfold as plain rows.
    """
    clean = df.withColumn("__text", collapse_spaces(F.col(text))).drop(text)
    placed = clean.filter(F.length("__text") >= low).withColumn(
        "__at", F.explode(F.sequence(F.lit(1), F.length("__text") - (low - 1)))
    )
    sized = placed.withColumn("__width", F.explode(F.array(*[F.lit(w) for w in range(low, high + 1)])))
    fits = sized.filter(F.col("__at") + F.col("__width") - 1 <= F.length("__text"))
    return fits.withColumn(name, F.substring("__text", F.col("__at"), F.col("__width"))).drop("__text", "__at", "__width")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, even when the body is itself a lambda."""
    return F.transform(F.array(value), body)[0]


def jaccard(left: Column, right: Column) -> Column:
    """Set overlap; 0.0 when either side is empty."""
    union = F.size(F.array_union(left, right))
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(empty, 0.0).otherwise(F.size(F.array_intersect(left, right)) / union)


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
