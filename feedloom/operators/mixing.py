"""Quota mixing, soft source caps, diversity and boost placement for all users at once.

Each user's list is bounded by the retrieval limits (850 rows) before it is packed into arrays, so
the greedy choices run as small per-list helpers inside Arrow batches: no group is ever unbounded.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from itertools import chain, cycle, islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.exprs import jaccard, rank_share, score_key, title_tokens
from ..functions.grouping import top_n
from .merge import TEXT_ID, usable_candidate

PATTERNS = {
    "warm_safe": (("model", 7), ("content_profile", 3)),
    "cold": (("content_profile", 7), ("popular", 2), ("explore", 1)),
    "plain": (("model", 7), ("content_profile", 2), ("popular", 1)),
    "content_cf": (("model", 7), ("content_profile", 2), ("item_cf", 1)),
    "cf_only": (("model", 8), ("item_cf", 1), ("popular", 1)),
}


def rank_sources(candidates: DataFrame, keep: int | None = None) -> DataFrame:
    """Usable candidates with rank_in_source, source_size and normalized_score per (user, source).

    ``keep`` bounds the rows per (user, source) before the shuffle; the sizes still count all of them.
    """
    usable = candidates.filter(usable_candidate())
    order = [score_key("raw_score").desc(), F.expr(TEXT_ID)]
    if keep is None:
        window = Window.partitionBy("user_id", "source").orderBy(*order)
        ranked = usable.withColumn("rank_in_source", F.row_number().over(window) - 1)
    else:
        ranked = top_n(usable, ["user_id", "source"], order, keep, "rank_in_source")
    sizes = usable.groupBy("user_id", "source").agg(F.count(F.lit(1)).alias("source_size"))
    return ranked.join(sizes, ["user_id", "source"]).withColumn(
        "normalized_score", rank_share(F.col("rank_in_source"), F.col("source_size"))
    )


def mix_safe_warm(candidates: DataFrame, limit: int) -> DataFrame:
    """Safe policy for warm users: 7 model rows, then 3 cold content rows, over and over.

    The two sources hold different items, so the slot order is a sort key:
    10 * floor(r / 7) + r % 7 for model and 10 * floor(r / 3) + 7 + r % 3 for content.
    """
    kept = rank_sources(candidates.filter(F.col("source").isin("model", "content_profile"))).filter(
        (F.col("source") == "model") | F.col("is_cold")
    )
    # ranks restart behind the cold filter
    again = Window.partitionBy("user_id", "source").orderBy("rank_in_source")
    ranked = kept.withColumn("r", F.row_number().over(again) - 1)
    slot = F.when(F.col("source") == "model", F.floor(F.col("r") / 7) * 10 + F.col("r") % 7).otherwise(
        F.floor(F.col("r") / 3) * 10 + 7 + F.col("r") % 3
    )
    order = Window.partitionBy("user_id").orderBy("slot")
    return (
        ranked.withColumn("slot", slot)
        .withColumn("rank", F.row_number().over(order) - 1)
        .filter(F.col("rank") < limit)
        .select("user_id", "item_id", "source", "rank", "rank_in_source", "normalized_score")
    )


def pattern_name(policy: str) -> Column:
    """Quota pattern of a user from warm_user, history_count, cf_support and content_confidence."""
    cold = ~F.col("warm_user")
    if policy == V.SAFE_POLICY:
        return F.when(cold, "cold").otherwise("warm_safe")
    if policy != V.DYNAMIC_POLICY:
        raise ValueError(f"unknown mix policy {policy}")
    supported = F.col("cf_support") >= 2
    return (
        F.when(cold, "cold")
        .when(F.col("history_count") <= 2, "plain")
        .when(supported & (F.col("content_confidence") >= 0.05), "content_cf")
        .when(supported, "cf_only")
        .otherwise("plain")
    )


def fill_slots(pattern: str, rows: dict[str, list[tuple[int, int, float]]], limit: int) -> list[tuple[int, str, int, str]]:
    """(item, used source, its rank there, requested source) per slot, from (item, rank, normalised score) rows.

    Every source is a queue; a slot asks the pattern's source first and then, if that has run dry, the
    others by the score at their head. Items that have a slot are passed over.
    """
    queues = {name: deque(rows.get(name, ())) for name in V.MIX_SOURCES}
    slots: dict[int, tuple[int, str, int, str]] = {}

    def preferred(first: str) -> Iterator[str]:
        yield first
        # sorted is stable: equal scores keep the order of the sources
        yield from sorted((name for name, queue in queues.items() if queue), key=lambda name: -queues[name][0][2])

    def offers(first: str) -> Iterator[tuple[int, str, int, str]]:
        for name in preferred(first):
            while queues[name]:
                item, rank, _ = queues[name].popleft()
                yield item, name, rank, first

    plan = chain.from_iterable(repeat(name, times) for name, times in PATTERNS[pattern])
    for wanted in islice(cycle(plan), limit):
        offer = next((o for o in offers(wanted) if o[0] not in slots), None)
        if offer is None:
            break
        slots[offer[0]] = offer
    return list(slots.values())


def mix_policy(candidates: DataFrame, context: DataFrame, policy: str, limit: int) -> DataFrame:
    """Mixed list per user: item_id, source, rank, rank_in_source, requested source.

    ``context``: user_id, warm_user, history_count, cf_support, content_confidence.
    """
    styles = context.withColumn("pattern", pattern_name(policy)).select("user_id", "warm_user", "pattern")
    known = candidates.join(styles, "user_id")
    if policy == V.SAFE_POLICY:
        # cold rows keep the ranks they have among all content rows, so this source is ranked whole
        rows = rank_sources(known).filter(
            F.when(
                F.col("warm_user"),
                (F.col("source") == "model") | ((F.col("source") == "content_profile") & F.col("is_cold")),
            ).otherwise(F.col("source").isin("content_profile", "popular", "explore"))
        )
        again = Window.partitionBy("user_id", "source").orderBy("rank_in_source")
        rows = rows.withColumn("__slot", F.row_number().over(again)).filter(F.col("__slot") <= 2 * limit)
    else:
        # at most limit rows are used and at most limit skipped per source
        rows = rank_sources(known, 2 * limit)

    ordered = F.array_sort(F.collect_list(F.struct("source", "rank_in_source", "item_id", "normalized_score")))
    packed = rows.groupBy("user_id", "pattern").agg(ordered.alias("rows"))

    @F.pandas_udf("array<struct<item_id:long,source:string,rank_in_source:int,requested:string>>")
    def choose(pattern: pd.Series, source: pd.Series, item: pd.Series, rank: pd.Series, score: pd.Series) -> pd.Series:
        def one(name, *columns):
            lists: dict[str, list] = {}
            for source, *row in zip(*columns):
                lists.setdefault(source, []).append(tuple(row))
            return [dict(zip(("item_id", "source", "rank_in_source", "requested"), slot)) for slot in fill_slots(name, lists, limit)]

        return pd.Series([one(*columns) for columns in zip(pattern, source, item, rank, score)])

    chosen = choose("pattern", "rows.source", "rows.item_id", "rows.rank_in_source", "rows.normalized_score")
    mixed = packed.select("user_id", "pattern", F.posexplode(chosen).alias("rank", "e"))
    return mixed.select("user_id", "pattern", "rank", "e.*")


def capped_order(sources: list[str], limit: int, caps: dict[str, int]) -> list[int]:
    """Indexes of a ranked list under soft caps, in windows of ten.

    Of the rows still there, those whose number within their source is below the source's cap come first;
    only what a window then still lacks comes from the others. Both keep the order of the list.
    """
    order: list[int] = []
    queues: dict[str, list[int]] = {}
    for i, name in enumerate(sources):
        queues.setdefault(name, []).append(i)
    taken = dict.fromkeys(queues, 0)
    while len(order) < min(limit, len(sources)):
        size = min(10, limit - len(order))
        # a window holds at most size rows of a source, so only the heads of the queues are looked at
        bounds = {name: taken[name] + min(caps.get(name, size), size) for name in queues}
        window = sorted(i for name, rows in queues.items() for i in rows[taken[name] : bounds[name]])[:size]
        lack = size - len(window)
        if lack:
            window += sorted(i for name, rows in queues.items() for i in rows[bounds[name] : bounds[name] + lack])[:lack]
        for i in window:
            taken[sources[i]] += 1
        order += window
    return order


def _reorder(ranked: DataFrame, names: list[str], order: Column) -> DataFrame:
    """Rows of packed lists in the order of an index array; ``rank`` is replaced."""
    picked = ranked.select("user_id", "rows", F.posexplode(order).alias("rank", "__i"))
    return picked.select("user_id", "rank", *[F.col("rows")[F.col("__i")][n].alias(n) for n in names])


def _packed(ranked: DataFrame) -> tuple[DataFrame, list[str]]:
    names = [c for c in ranked.columns if c not in ("user_id", "rank")]
    rows = F.array_sort(F.collect_list(F.struct("rank", *names)))
    return ranked.groupBy("user_id").agg(rows.alias("rows")), names


def apply_source_caps(ranked: DataFrame, limit: int, caps: dict[str, int] | None = None) -> DataFrame:
    """Ranked lists (user_id, rank, source, ...) under soft caps per window of ten."""
    bounds = {**V.SOURCE_CAPS_AT_10, **(caps or {})}
    packed, names = _packed(ranked)

    @F.pandas_udf("array<int>")
    def order(sources: pd.Series) -> pd.Series:
        return pd.Series([capped_order(list(s), limit, bounds) for s in sources])

    return _reorder(packed, names, order(F.transform("rows", lambda r: r["source"])))


def mmr_order(tokens: list[list[str]]) -> list[int]:
    """Greedy order by .45 * relevance - .55 * largest title overlap with the rows already chosen.

    Relevance falls with the position. Tokens in more than half of the list say nothing; with fewer
    than 60 % of usable titles the list stays as it is. Equal values keep the earlier row.
    """
    size = len(tokens)
    seen = Counter(t for row in tokens for t in set(row))
    kept = [{t for t in row if seen[t] / size <= 0.5} for row in tokens]
    if size == 0 or sum(bool(row) for row in kept) / size < 0.6:
        return list(range(size))
    codes = {t: i for i, t in enumerate(sorted(set().union(*kept)))}
    matrix = np.zeros((size, len(codes)))
    for i, row in enumerate(kept):
        matrix[i, [codes[t] for t in row]] = 1.0
    shared = matrix @ matrix.T
    counts = matrix.sum(axis=1)
    union = counts[:, None] + counts[None, :] - shared
    overlap = np.where(shared > 0, shared / np.maximum(union, 1.0), 0.0)
    relevance = 0.45 * (1.0 - np.arange(size) / max(1, size - 1))
    closest, open_rows, order = np.zeros(size), np.ones(size, dtype=bool), []
    for _ in range(size):
        value = np.where(open_rows, relevance - 0.55 * closest, -np.inf)
        best = int(np.argmax(value))
        order.append(best)
        open_rows[best] = False
        closest = np.maximum(closest, overlap[best])
    return order


def mmr_rerank(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """Diversity order of every user's list by the titles of its items."""
    titled = ranked.join(items.select("item_id", title_tokens(F.col("title")).alias("tokens")), "item_id", "left")
    packed, names = _packed(titled.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))))

    @F.pandas_udf("array<int>")
    def order(tokens: pd.Series) -> pd.Series:
        return pd.Series([mmr_order([list(row) for row in rows]) for rows in tokens])

    return _reorder(packed, [n for n in names if n != "tokens"], order(F.transform("rows", lambda r: r["tokens"])))


def diversity_metrics(ranked: DataFrame, items: DataFrame, first: int = 50) -> DataFrame:
    """Per user over the first 50 rows: duplicates, distinct tokens, mean overlap of neighbours, list diversity.

    Pairs are formed inside one list of at most 50 rows.
    """
    head = ranked.filter(F.col("rank") < first).join(
        items.select("item_id", title_tokens(F.col("title")).alias("tokens")), "item_id", "left"
    ).withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    packed = head.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "tokens"))), lambda e: e["tokens"]).alias("t"),
        F.count(F.lit(1)).alias("evaluated_items"),
        (F.count(F.lit(1)) - F.count_distinct("item_id")).alias("duplicate_items"),
    )

    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.size(values) == 0, 0.0).otherwise(total / F.greatest(F.lit(1), F.size(values)))

    following = F.transform(
        F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.when(i < F.size("t") - 1, jaccard(F.get(F.col("t"), i), F.get(F.col("t"), i + 1)))
    )
    pairs = F.flatten(
        F.transform("t", lambda left, i: F.transform("t", lambda right, j: F.when(i < j, jaccard(left, right))))
    )
    return packed.select(
        "user_id", "evaluated_items", "duplicate_items",
        F.size(F.array_distinct(F.flatten("t"))).cast("bigint").alias("unique_title_tokens"),
        F.array_compact(following).alias("f"), F.array_compact(pairs).alias("p"),
    ).select(
        "user_id", "evaluated_items", "duplicate_items", "unique_title_tokens",
        mean(F.col("f")).alias("adjacent_title_similarity"), (1.0 - mean(F.col("p"))).alias("intra_list_diversity"),
    )


def active_boosts(campaigns: DataFrame, users: DataFrame, feed_type: str, now: int) -> DataFrame:
    """Campaigns per user: running, for all users or for listed ones, for every feed or for this one.

    Listed users join on their id. Campaigns for everybody come down to the strongest of each item before they
    meet the users; these are few by contract.
    """
    running = campaigns.filter(
        F.col("active") & (F.col("starts_ms") <= now) & (F.col("ends_ms") > now)
        & ((F.size("feed_types") == 0) | F.array_contains("feed_types", feed_type))
    )
    facts = ["campaign_id", "item_id", "position", "priority", "created_ms"]
    listed = running.filter(F.col("audience") == "users").select(F.explode("user_ids").alias("user_id"), *facts)
    direct = listed.distinct().join(users.select("user_id"), "user_id")
    # one campaign per (user, item): highest priority, then the oldest
    strongest = F.max(F.struct("priority", -F.col("created_ms"), -F.col("campaign_id"), "position", "campaign_id", "created_ms")).alias("b")
    per_item = running.filter(F.col("audience") == "all").groupBy("item_id").agg(strongest)
    shared = per_item.select("b.campaign_id", "item_id", "b.position", "b.priority", "b.created_ms").agg(F.collect_list(F.struct(*facts)).alias("all"))
    own = direct.groupBy("user_id").agg(F.collect_list(F.struct(*facts)).alias("own"))
    # they meet inside the user's row, so users times campaigns are never held or shuffled
    rows = users.select("user_id").join(own, "user_id", "left").withColumn("all", shared.scalar())

    def strength(c: Column) -> Column:
        return F.struct(c["priority"], -c["created_ms"], -c["campaign_id"], c["position"])

    def unbeaten(among: str, by: str) -> Column:
        return F.filter(among, lambda x: ~F.exists(by, lambda y: (y["item_id"] == x["item_id"]) & (strength(y) > strength(x))))

    # the shared ones are the strongest of their items already
    mine = F.filter(unbeaten("own", "own"), lambda x: ~F.exists("all", lambda y: (y["item_id"] == x["item_id"]) & (strength(y) > strength(x))))
    kept = F.when(F.col("own").isNull(), F.col("all")).otherwise(F.concat(unbeaten("all", "own"), mine))
    return rows.select("user_id", F.inline(kept)).select("user_id", "item_id", "priority", "position", "campaign_id")


def place_boosts(ranked: DataFrame, boosts: DataFrame, limit: int) -> DataFrame:
    """Lists with the user's boosts at their positions: item_id, rank, forced, and the row's source.

    The boosts are folded into the array of the other rows from the weakest on (priority, then item id as
    text), so the strongest ends exactly at its wanted position.
    """
    lists = ranked.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").cast("bigint").alias("rank"), F.col("item_id").cast("bigint").alias("item_id"), "source"))).alias("rows")
    )
    strength = F.struct(
        F.col("priority").cast("bigint").alias("priority"), F.col("item_id").cast("string").alias("text"),
        F.col("item_id").cast("bigint").alias("item_id"), F.col("position").cast("bigint").alias("position"),
    )
    wanted = boosts.groupBy("user_id").agg(F.collect_list(strength).alias("b"))
    weakest_first = F.array_sort(
        F.coalesce("b", F.array().cast("array<struct<priority:bigint,text:string,item_id:bigint,position:bigint>>")),
        lambda x, y: F.when(x["priority"] != y["priority"], F.signum(x["priority"] - y["priority"]).cast("int"))
        .when(x["text"] == y["text"], 0).when(x["text"] > y["text"], -1).otherwise(1),
    )
    joined = lists.join(wanted, "user_id", "full_outer").withColumn("b", weakest_first)
    plain = F.transform(
        F.filter(F.coalesce("rows", F.array().cast("array<struct<rank:bigint,item_id:bigint,source:string>>")), lambda r: ~F.array_contains("b.item_id", r["item_id"])),
        lambda r: F.struct(r["item_id"].cast("bigint").alias("item_id"), F.lit(False).alias("forced"), r["source"].alias("source")),
    )

    def put(row: Column, boost: Column) -> Column:
        at = F.least(boost["position"], F.size(row), F.lit(max(0, limit - 1))).cast("int")
        own = F.struct(boost["item_id"].cast("bigint").alias("item_id"), F.lit(True).alias("forced"), F.lit("forced").alias("source"))
        return F.concat(F.slice(row, F.lit(1), at), F.array(own), F.slice(row, at + 1, F.size(row)))

    kind = "array<struct<item_id:bigint,forced:boolean,source:string>>"
    placed = joined.select("user_id", F.aggregate("b", plain.cast(kind), lambda row, boost: put(row, boost).cast(kind)).alias("o"))
    rows = placed.select("user_id", F.posexplode(F.slice("o", 1, limit)).alias("rank", "e"))
    return rows.select("user_id", "rank", "e.item_id", "e.forced", "e.source")


def source_overlap(candidates: DataFrame) -> DataFrame:
    """Mean Jaccard overlap per pair of sources over users; 0.0 where both are empty for a user.

    A user's items are first reduced to one row with a bit per source; a user is one row of counts, and
    pairs are formed among seven names only.
    """
    names = sorted(V.SOURCES)
    bit = F.coalesce(*[F.when(F.col("source") == n, F.lit(1 << i)) for i, n in enumerate(names)], F.lit(0))
    held = candidates.groupBy("user_id", "item_id").agg(F.bit_or(bit).alias("bits"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]

    def having(bits: int) -> Column:
        return F.count_if(F.col("bits").bitwiseAND(F.lit(bits)) == bits)

    counted = held.groupBy("user_id").agg(
        *[having(1 << i).alias(f"n{i}") for i in range(len(names))], *[having(1 << i | 1 << j).alias(f"b{i}_{j}") for i, j in pairs]
    )

    def share(i: int, j: int) -> Column:
        both, either = F.col(f"b{i}_{j}"), F.col(f"n{i}") + F.col(f"n{j}") - F.col(f"b{i}_{j}")
        return F.avg(F.when(either == 0, 0.0).otherwise(both / either)).alias(f"s{i}_{j}")

    means = counted.agg(F.count(F.lit(1)).alias("users"), *[share(i, j) for i, j in pairs]).filter("users > 0")
    rows = [F.struct(F.lit(names[i]).alias("left"), F.lit(names[j]).alias("right"), "users", F.col(f"s{i}_{j}").alias("jaccard")) for i, j in pairs]
    return means.select(F.inline(F.array(*rows)))


def source_diagnostics(candidates: DataFrame, positives: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(per source, per pair of sources) over the first k eligible candidates of every user and source.

    Hit rate: share of the users with candidates for whom the source alone has a positive item among its first k.
    Overlap: mean Jaccard of the two lists.
    """
    users = candidates.agg(F.count_distinct("user_id")).scalar()
    order = [score_key("raw_score").desc(), F.expr(TEXT_ID)]
    head = top_n(candidates.filter("eligible").select("user_id", "item_id", "source", "raw_score"), ["user_id", "source"], order, k)
    hits = head.join(positives.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi")
    rates = head.select("source").distinct().join(
        hits.select("user_id", "source").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("__hit")), "source", "left"
    )
    share = (F.coalesce("__hit", F.lit(0)) / users).alias("hitrate_at_k")
    return rates.select("source", F.coalesce("__hit", F.lit(0)).alias("users_hit"), share), source_overlap(head)


def policy_diagnostics(mixed: DataFrame, positives: DataFrame, k: int = 10) -> DataFrame:
    """Per source over the first k rows of all lists: mean rows per user, hits, slots taken for another source
    (``relaxations``); and in every row ``fallback_queries``, the users with any such slot, and ``duplicate_results``."""
    head = mixed.filter(F.col("rank") < k)
    borrowed = F.col("requested") != F.col("source")
    users = mixed.agg(F.count_distinct("user_id")).scalar()
    fallen = head.filter(borrowed).agg(F.count_distinct("user_id")).scalar()
    doubled = mixed.groupBy("user_id", "item_id").agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0))).scalar()
    hits = positives.select("user_id", "item_id").distinct().withColumn("__hit", F.lit(1))
    return head.join(hits, ["user_id", "item_id"], "left").groupBy("source").agg(
        (F.count(F.lit(1)) / users).alias("mean_quota"),
        F.count("__hit").alias("hits"),
        F.count_if(borrowed).alias("relaxations"),
    ).withColumn("fallback_queries", fallen).withColumn("duplicate_results", doubled)
