import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom import values as V
from feedloom.operators import evaluation, feeds, fusion, merge, mixing, popularity, training


def test_caps_limit_each_window_and_refill_only_when_short():
    sources = ["svd"] * 14 + ["dssm"] * 10
    order = mixing.capped_order(sources, 20, V.SOURCE_CAPS_AT_10)
    assert [sources[i] for i in order[:10]].count("svd") == 7 and len(set(order)) == 20
    assert mixing.capped_order(["svd"] * 12, 12, V.SOURCE_CAPS_AT_10) == list(range(12))


@pytest.mark.parametrize("seed", range(20))
def test_caps_keep_every_row_once(seed):
    rng = random.Random(seed)
    sources = [rng.choice(V.SOURCES) for _ in range(rng.randint(0, 60))]
    order = mixing.capped_order(sources, 100, V.SOURCE_CAPS_AT_10)
    assert sorted(order) == list(range(len(sources)))


def _plain_mmr(tokens):
    size = len(tokens)
    common = {t for row in tokens for t in row if sum(t in r for r in tokens) / size > 0.5}
    kept = [set(row) - common for row in tokens]
    if sum(bool(r) for r in kept) / size < 0.6:
        return list(range(size))

    def overlap(a, b):
        return len(a & b) / len(a | b) if a and b else 0.0

    left, done = list(range(size)), []
    while left:
        best = max(left, key=lambda i: (0.45 * (1 - i / max(1, size - 1)) - 0.55 * max([overlap(kept[i], kept[d]) for d in done], default=0.0), -i))
        left.remove(best)
        done.append(best)
    return done


@pytest.mark.parametrize("seed", range(20))
def test_mmr_equals_the_plain_greedy_rule(seed):
    rng = random.Random(seed)
    tokens = [rng.sample("abcdefghij", rng.randint(0, 4)) for _ in range(rng.randint(1, 25))]
    assert mixing.mmr_order(tokens) == _plain_mmr(tokens)


def scored(lists):
    return {name: [(item, r, 1 - r / max(1, len(rows) - 1)) for r, item in enumerate(rows)] for name, rows in lists.items()}


def test_slots_follow_the_pattern_and_borrow():
    items = {"model": list(range(100, 110)), "content_profile": [1, 2, 100], "popular": [3]}
    rows = mixing.fill_slots("warm_safe", scored(items), 15)
    assert [r[1] for r in rows[:10]] == ["model"] * 7 + ["content_profile"] * 2 + [rows[9][1]]
    assert len({r[0] for r in rows}) == len(rows) == 13
    assert any(r[1] != r[3] for r in rows)


def test_safe_warm_closed_form_equals_slot_filling(spark):
    rng = random.Random(4)
    rows = []
    for user in range(12):
        for i in range(rng.randint(0, 25)):
            rows.append((user, i, "model", rng.random(), 1.0, 1, False, True))
        for i in range(rng.randint(0, 12)):
            rows.append((user, 1000 + i, "content_profile", rng.random(), 1.0, 1, True, True))
    schema = "user_id long, item_id long, source string, raw_score double, confidence double, support int, is_cold boolean, eligible boolean"
    df = spark.createDataFrame(rows, schema)
    context = df.select("user_id").distinct().select(
        "user_id", F.lit(True).alias("warm_user"), F.lit(9).alias("history_count"), F.lit(0).alias("cf_support"), F.lit(0.0).alias("content_confidence")
    )
    closed = {(r["user_id"], r["rank"]): (r["item_id"], r["rank_in_source"]) for r in mixing.mix_safe_warm(df, 30).collect()}
    greedy = {(r["user_id"], r["rank"]): (r["item_id"], r["rank_in_source"]) for r in mixing.mix_policy(df, context, V.SAFE_POLICY, 30).collect()}
    assert closed == greedy


def test_boosts_take_their_positions(spark):
    rows = [(u, r, i, "svd") for u, items in {1: [1, 2, 3], 2: [1, 2], 4: [5]}.items() for r, i in enumerate(items)]
    ranked = spark.createDataFrame(rows, "user_id long, rank int, item_id long, source string")
    wanted = [(1, 9, 0, 5), (1, 2, 1, 1), (2, 7, 40, 0), (3, 7, 3, 0)]
    boosts = spark.createDataFrame(wanted, "user_id long, item_id long, position int, priority int")

    def placed(limit):
        got = {}
        for r in mixing.place_boosts(ranked, boosts, limit).orderBy("user_id", "rank").collect():
            got.setdefault(r["user_id"], []).append((r["item_id"], r["forced"]))
        return got

    got = placed(10)
    assert got[1] == [(9, True), (1, False), (2, True), (3, False)] and got[3] == [(7, True)] and got[4] == [(5, False)]
    assert placed(3)[2] == [(1, False), (2, False), (7, True)]


def test_merge_primary_source_and_evidence(spark):
    rows = [
        (1, 10, "svd", 0.9, True, 1.0, 1, False), (1, 11, "svd", 0.5, True, 1.0, 1, False),
        (1, 10, "content", 0.2, True, 1.0, 1, False), (1, 12, "item_cf", 0.0, True, 1.0, 3, False),
        (1, 13, "popular", float("nan"), True, 1.0, 1, False), (1, 14, "explore", 1.0, False, 1.0, 1, False),
    ]
    schema = "user_id long, item_id long, source string, raw_score double, eligible boolean, confidence double, support int, is_cold boolean"
    got = {r["item_id"]: r for r in merge.source_evidence(merge.merge_sources(spark.createDataFrame(rows, schema))).collect()}
    assert set(got) == {10, 11}
    assert got[10]["primary_source"] == "svd" and set(got[10]["evidence"]) == {"svd", "content"}
    assert got[10]["scores"][merge.at("svd")] == 1.0 and got[11]["scores"][merge.at("svd")] == 0.0
    assert got[10]["scores"][merge.at("content")] == 1.0 and got[11]["mask"][merge.at("content")] == 0.0


def test_metrics_by_hand(spark):
    rows = [(1, 1, 1, 0.9), (1, 2, 0, 0.8), (1, 3, 1, 0.1), (1, 4, 0, 0.5), (1, 5, 0, 0.4)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, label int, score double")
    row = evaluation.ranking_metrics(df, k=2).first()
    assert row["recall"] == 0.5 and row["hitrate"] == 1.0
    assert abs(row["ndcg"] - 1 / (1 + 1 / np.log2(3))) < 1e-12
    empty = evaluation.ranking_metrics(df.limit(0)).first()
    assert (empty["recall"], empty["ndcg"], empty["hitrate"]) == (0.0, 0.0, 0.0)


def test_negatives_are_exact_distinct_and_allowed(spark):
    rng = random.Random(2)
    catalog = [7 * i + 3 for i in range(130)]
    known = [(u, i) for u in range(6) for i in rng.sample(catalog, [0, 5, 20, 29, 30, 31][u])]
    universe = spark.createDataFrame([(i,) for i in catalog], "item_id long")
    excluded = spark.createDataFrame(known, "user_id long, item_id long")
    users = spark.createDataFrame([(u, sum(k == u for k, _ in known)) for u in range(6)], "user_id long, h long")
    got = {}
    for r in evaluation.sample_negatives(users, excluded, universe, 100, 42, "test").collect():
        got.setdefault(r["user_id"], []).append(r["item_id"])
    # user 5 has only 99 other items
    assert set(got) == {0, 1, 2, 3, 4}
    for user, items in got.items():
        assert len(items) == len(set(items)) == 100 and not set(items) & {i for u, i in known if u == user}


def test_weighted_negatives_are_complete(spark):
    rng = random.Random(3)
    train = [(u, i) for u in range(8) for i in rng.sample(range(40), [2, 5, 10, 20, 34, 35, 36, 36][u])]
    df = spark.createDataFrame(train, "user_id long, item_id long")
    got = {}
    for r in training.weighted_negatives(df, df, df, rounds=2).collect():
        got.setdefault((r["user_id"], r["item_id"]), []).append(r["negative_id"])
    held = {u: {i for v, i in train if v == u} for u in range(8)}
    catalog = {i for _, i in train}
    for user, item in train:
        free = catalog - held[user]
        negatives = got.get((user, item), [])
        assert len(negatives) == len(set(negatives)) == min(4, len(free)) and set(negatives) <= free


def test_catalog_walk_equals_brute_force(spark):
    positives = spark.createDataFrame([(1, 5), (1, 6), (2, 1)], "user_id long, item_id long")
    top = spark.createDataFrame([(1, 5, 0), (1, 9, 1), (2, 3, 0)], "user_id long, item_id long, rank int")
    row = evaluation.catalog_metrics(top, positives).first()
    assert row["queries"] == 2 and abs(row["recall"] - 0.25) < 1e-12 and row["hitrate"] == 0.5


def test_labels_leave_unviewed_rows_unlabelled(spark):
    manifests = spark.createDataFrame([("s", i) for i in (1, 2, 3)], "snapshot_id string, item_id long")
    snapshots = spark.createDataFrame([("s", 7, "personalized", 0)], "snapshot_id string, user_id long, feed_type string, created_ms long")
    users = spark.createDataFrame([(7, 70)], "user_id long, dataset_user_id long")
    shown = spark.createDataFrame([("s", "r", 7, 1, 3), ("s", "r", 7, 2, 1)], "snapshot_id string, request_id string, user_id long, item_id long, position int")
    events = spark.createDataFrame(
        [("r", 7, 1, 3, "impression", None), ("r", 7, 1, 3, "click", None), ("r", 7, 2, 1, "impression", None)],
        "request_id string, user_id long, item_id long, position int, event_type string, dwell_ms long",
    )
    out = training.exposure_labels(manifests, snapshots, users, shown, events, 48 * V.HOUR_MS)
    got = {r["item_id"]: (r["label"], r["sample_weight"]) for r in out.collect()}
    assert got == {1: (0.8, 2.0), 2: (0.0, 2.0**0.5), 3: (None, None)}
    audit = training.label_audit(out).first()
    assert (audit["positive_rows"], audit["negative_rows"], audit["unlabeled_rows"], audit["status"]) == (1, 1, 1, "usable")
    assert training.exposure_labels(manifests, snapshots, users, shown, events, 3).count() == 0


def test_fallback_reasons(spark):
    rows = "user_id long, item_id long, source string, rank int"
    users = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 4)], "user_id long, dataset_user_id long")
    unified = spark.createDataFrame([(1, i, "svd", i) for i in range(3)], rows)
    svd = spark.createDataFrame([(2, i, "svd", i) for i in range(3)], rows)
    popular = spark.createDataFrame([(u, 50 + i, "popular", i) for u in (1, 2, 3, 4) for i in range(3)], rows)
    explore = spark.createDataFrame([(u, 90 + i, "explore", i) for u in (1, 2, 3, 4) for i in range(5)], rows)
    seen = spark.createDataFrame([(1, 0)], "user_id long, item_id long")
    out = feeds.fallback_plan(users, unified, svd, popular, explore, seen, 3).orderBy("user_id", "rank").collect()
    reasons = {r["user_id"]: r["fallback_reason"] for r in out}
    assert reasons == {
        1: "candidate_shortfall", 2: "unified_model_unavailable_svd_fallback", 3: "cold_start", 4: "personalized_model_unavailable"
    }
    assert [r["item_id"] for r in out if r["user_id"] == 1] == [1, 2, 90]


def test_fusion_grid_names():
    assert [n for n, _ in fusion.fusion_policies()] == ["text_only", "visual_only", "static_0.16", "static_0.17", "static_0.175", "static_0.18", "static_0.19"]


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "label int, score double")
    assert abs(evaluation.auc(df).first()["auc"] - (0.5 + 1 + 0 + 1) / 4) < 1e-12


def test_mixing_heads_equal_whole_lists(spark):
    rng = random.Random(11)
    rows = []
    for user in range(6):
        for source in V.MIX_SOURCES:
            for item in rng.sample(range(60), rng.randint(0, 45)):
                rows.append((user, item, source, rng.random(), 1.0, 1, False, True))
    schema = "user_id long, item_id long, source string, raw_score double, confidence double, support int, is_cold boolean, eligible boolean"
    df = spark.createDataFrame(rows, schema)
    context = df.select("user_id").distinct().select(
        "user_id", (F.col("user_id") % 2 == 0).alias("warm_user"), F.lit(9).alias("history_count"), F.lit(3).alias("cf_support"), F.lit(0.5).alias("content_confidence")
    )
    got = {}
    for r in mixing.mix_policy(df, context, V.DYNAMIC_POLICY, 8).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append((r["item_id"], r["source"]))
    for user in range(6):
        lists = {s: [i for _, _, i in sorted((-round(x[3], 9), str(x[1]), x[1]) for x in rows if x[0] == user and x[2] == s)] for s in V.MIX_SOURCES}
        want = mixing.fill_slots("content_cf" if user % 2 == 0 else "cold", scored(lists), 8)
        assert got[user] == [(r[0], r[1]) for r in want]


def _feed_inputs(spark):
    lists = "user_id long, item_id long, source string, rank int"
    users = spark.createDataFrame([(1, 10, False), (2, 20, True), (3, None, False), (4, 40, True)], "user_id long, dataset_user_id long, model_failed boolean")
    unified = spark.createDataFrame([(1, 1, "content", 0), (1, 2, "svd", 1), (2, 1, "content", 0), (4, 1, "content", 0)], lists)
    svd = spark.createDataFrame([(2, 3, "svd", 0)], lists)
    popular = spark.createDataFrame([(u, i, "popular", i) for u in (1, 2, 3, 4) for i in (4, 5)], lists)
    explore = spark.createDataFrame([(u, i, "explore", i) for u in (1, 2, 3, 4) for i in (5, 6, 7, 8)], lists)
    seen = spark.createDataFrame([(1, 4), (1, 6)], "user_id long, item_id long")
    return users, unified, svd, popular, explore, seen


def test_three_feeds_with_their_reasons(spark):
    rows = feeds.feed_lists(*_feed_inputs(spark), 3).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault((r["user_id"], r["feed_type"]), []).append(r["item_id"])
    reasons = {r["user_id"]: r["fallback_reason"] for r in rows if r["feed_type"] == "personalized"}
    assert got[1, "personalized"] == [1, 2, 5] and got[1, "popular"] == [5, 7, 8] and got[1, "explore"] == [5, 7, 8]
    assert got[2, "personalized"] == [3, 5, 6] and got[4, "personalized"] == [4, 5, 6] and got[3, "popular"] == [4, 5, 6]
    assert reasons == {
        1: "candidate_shortfall", 2: "unified_model_unavailable_svd_fallback", 3: "cold_start", 4: "deep_model_failed_popular_fallback",
    }
    assert {r["fallback_reason"] for r in rows if r["feed_type"] != "personalized"} == {None}


def test_offline_rows_leave_before_the_cut(spark):
    items = spark.createDataFrame([(i, "offline" if i in (3, 5) else "online") for i in range(1, 10)], "item_id long, status string")
    rows = feeds.feed_lists(*_feed_inputs(spark), 3, items).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault((r["user_id"], r["feed_type"]), []).append(r["item_id"])
    assert got[1, "personalized"] == [1, 2, 7] and got[1, "popular"] == [7, 8] and got[1, "explore"] == [7, 8]
    assert got[2, "personalized"] == [6, 7, 8] and got[3, "popular"] == [4, 6, 7] and got[3, "explore"] == [6, 7, 8]


def test_pools_are_as_deep_as_a_user_needs(spark):
    needs = spark.createDataFrame([(1, 3), (2, 9), (3, 40)], "user_id long, n long")
    features = spark.createDataFrame([(i, float(i % 7), float(i)) for i in range(1, 31)], "item_id long, decay double, cumulative double")
    order = [i for i in sorted(range(1, 31), key=lambda i: (-round(i % 7 + 1e-6 * i, 9), str(i)))]
    got = {}
    for r in popularity.popular_walk(needs, features).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["item_id"])
    assert got == {1: order[:3], 2: order[:9], 3: order}
    counts = spark.createDataFrame([(i, i // 4) for i in range(1, 31)], "item_id long, exposure_count long")
    rows = popularity.explore_walk(needs, counts, 7).collect()
    pool = sorted(range(1, 31), key=lambda i: (i // 4, str(i)))
    for user, n in ((1, 3), (2, 9), (3, 40)):
        own = [r["item_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["user_id"] == user]
        assert len(own) == min(n, 30) == len(set(own)) and set(own) <= set(pool[: 2 * n])
    # the same draws as the recall that is equally deep for all
    same = popularity.explore_recall(needs.filter("user_id = 2"), counts, 7, 9).collect()
    assert [r["item_id"] for r in sorted(same, key=lambda r: r["rank"])] == [r["item_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["user_id"] == 2]


def test_snapshots_of_all_feeds(spark):
    users, *sources = _feed_inputs(spark)
    lists = feeds.feed_lists(users, *sources, 3)
    heads = feeds.snapshot_heads(users, lists, 1000, 7, "m1", 30)
    again = feeds.snapshot_heads(users.repartition(3), lists, 1000, 7, "m1", 30)
    assert heads.count() == 12 and sorted(map(str, heads.collect())) == sorted(map(str, again.collect()))
    assert {r["expires_ms"] for r in heads.collect()} == {1000 + 30 * 60_000} and len({r["seed"] for r in heads.collect()}) == 12
    items = spark.createDataFrame([(i, f"title {i}", "offline" if i == 5 else "online") for i in range(1, 10)], "item_id long, title string, status string")
    boosts = spark.createDataFrame([(1, "popular", 9, 0, 1), (1, "popular", 5, 0, 5)], "user_id long, feed_type string, item_id long, position int, priority int")
    rows = feeds.build_feeds(lists, heads, items, boosts, 3).join(heads, "snapshot_id").orderBy("position").collect()
    got = {}
    for r in rows:
        got.setdefault((r["user_id"], r["feed_type"]), []).append((r["item_id"], r["forced"]))
    assert got[1, "popular"] == [(9, True), (7, False), (8, False)]  # the offline boost and the offline row are gone
    assert all(i != 5 for own in got.values() for i, _ in own) and all(len(own) == len({i for i, _ in own}) for own in got.values())
    alive, counts = feeds.expire_snapshots(heads, 1000 + 30 * 60_000)
    assert alive.count() == 0 and tuple(counts.first()) == (12, 0)


def test_hybrid_scores_match_the_rule(spark):
    import random

    from feedloom.operators import evaluation as E

    rng, rows = random.Random(4), []
    for user in range(12):
        for item in rng.sample(range(100), rng.choice([1, 3, 15, 25])):
            model = None if user % 3 and rng.random() < 0.3 else round(rng.random(), 2)
            rows.append((user, item, 0, model, rng.choice([0.0, 0.3, 0.6]), rng.choice([0.0, 1.0, 2.0])))
    got = {(r["user_id"], r["item_id"]): r["score"] for r in E.hybrid_scores(
        spark.createDataFrame(rows, "user_id long, item_id long, label int, model double, content double, popular double")).collect()}
    for user in range(12):
        own = [r for r in rows if r[0] == user]
        n, value = len(own), {r[1]: -1e12 if r[3] is None else r[3] for r in own}
        cold = [r for r in own if r[3] is None and r[4] > 0]
        if not cold:
            assert all(got[user, r[1]] == value[r[1]] for r in own)
            continue

        def share(key):
            order = sorted(own, key=lambda r: (-key(r), r[1]))
            return {r[1]: 1.0 if n <= 1 else 1 - i / (n - 1) for i, r in enumerate(order)}

        m, c, p = share(lambda r: value[r[1]]), share(lambda r: r[4]), share(lambda r: r[5])
        blend = {r[1]: round(0.55 * m[r[1]] + 0.35 * c[r[1]] + 0.10 * p[r[1]], 9) for r in own}
        warm = sorted((r for r in own if r[3] is not None), key=lambda r: (-r[3], r[1]))[:7]
        first = [r[1] for r in warm] + [r[1] for r in sorted(cold, key=lambda r: (-r[4], r[1]))[:3]]
        order = first + sorted((r[1] for r in own if r[1] not in first), key=lambda i: (-blend[i], i))
        assert [got[user, i] for i in order] == [float(n - k) for k in range(n)]


def test_policy_and_source_diagnostics(spark):
    mixed = spark.createDataFrame(
        [(1, 0, 10, "model", "model"), (1, 1, 11, "popular", "model"), (2, 0, 12, "model", "model"), (2, 1, 12, "explore", "explore")],
        "user_id long, rank int, item_id long, source string, requested string",
    )
    liked = spark.createDataFrame([(1, 11), (2, 12)], "user_id long, item_id long")
    got = {r["source"]: tuple(r)[1:] for r in mixing.policy_diagnostics(mixed, liked).collect()}
    assert got == {"model": (1.0, 1, 0, 1, 1), "popular": (0.5, 1, 1, 1, 1), "explore": (0.5, 1, 0, 1, 1)}
    rows = [(1, i, s, 1.0 / (1 + i), True) for s in ("svd", "popular") for i in range(20) if s == "svd" or i % 2] + [(2, 1, "svd", 1.0, False)]
    cands = spark.createDataFrame(rows, "user_id long, item_id long, source string, raw_score double, eligible boolean")
    rates, overlap = mixing.source_diagnostics(cands, spark.createDataFrame([(1, 15)], "user_id long, item_id long"))
    assert {r["source"]: (r["users_hit"], r["hitrate_at_k"]) for r in rates.collect()} == {"svd": (0, 0.0), "popular": (1, 0.5)}
    pair = [r for r in overlap.collect() if {r["left"], r["right"]} == {"popular", "svd"}][0]
    assert pair["jaccard"] == 5 / 15
