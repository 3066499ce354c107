import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from feedloom.operators import content, factors, item_cf, popularity, split, vectors

DAY = 86_400_000


def test_popularity_windows_are_inclusive_and_ignore_the_future(spark):
    cut = 100 * DAY
    events = [("a", cut), ("a", cut - DAY), ("a", cut - 7 * DAY), ("a", cut - 30 * DAY), ("a", cut - 30 * DAY - 1), ("a", cut + 1)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in events], "item_id string, ts_ms long, weight double")
    row = popularity.popularity_features(df, F.lit(cut)).first()
    assert (row["cumulative"], row["d1"], row["d7"], row["d30"]) == (5.0, 2.0, 3.0, 4.0)
    want = sum(0.5 ** ((cut - t) / (7 * DAY)) for _, t in events if t <= cut)
    assert abs(row["decay"] - want) < 1e-9
    assert abs(row["growth"] - (2 - 1 / 6)) < 1e-9


def test_popularity_rejects_bad_weights(spark):
    df = spark.createDataFrame([("a", 1, -1.0)], "item_id string, ts_ms long, weight double")
    try:
        popularity.popularity_features(df, F.lit(5)).collect()
    except Exception as error:
        assert "non-negative" in str(error)
    else:
        raise AssertionError("a negative weight must fail")


def _histories(seed=5, users=40, items=30):
    rng = np.random.default_rng(seed)
    rows = [(u, int(i)) for u in range(users) for i in rng.choice(items, size=rng.integers(1, 9), replace=False)]
    # one user owns the whole catalog
    return rows + [(999, i) for i in range(items)]


def test_cooccurrence_with_split_histories_equals_brute_force(spark):
    rows = _histories()
    held = defaultdict(set)
    for u, i in rows:
        held[u].add(i)
    want = Counter((a, b) for items in held.values() for a in items for b in items if a < b)
    df = spark.createDataFrame(rows + rows[:20], "user_id long, item_id long")
    for chunk in (4, 256):
        got = {(r["item_i"], r["item_j"]): r["support"] for r in item_cf.cooccurrence(df, 2, chunk).collect()}
        assert got == {pair: n for pair, n in want.items() if n >= 2}


def test_item_neighbors_cosine_order_and_cutoff(spark):
    rows = [(u, i, 10) for u, i in _histories(6)] + [(1, 29, 99), (2, 29, 99)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, ts_ms long")
    got = defaultdict(list)
    for r in item_cf.item_neighbors(df, F.lit(10), top=3).orderBy("item_id", "rank").collect():
        got[r["item_id"]].append((r["neighbor_id"], round(r["score"], 9)))
    users = defaultdict(set)
    for u, i, t in rows:
        if t <= 10:
            users[i].add(u)
    for i in users:
        scored = [
            (-round(len(users[i] & users[j]) / math.sqrt(len(users[i]) * len(users[j])), 9), j)
            for j in users if j != i and len(users[i] & users[j]) >= 2
        ]
        assert got[i] == [(j, -s) for s, j in sorted(scored)[:3]]


def test_cf_scores_agree_with_recall(spark):
    df = spark.createDataFrame([(u, i, 1) for u, i in _histories(7)], "user_id long, item_id long, ts_ms long")
    neighbors = item_cf.item_neighbors(df, F.lit(1))
    weights = item_cf.cf_weights(df)
    full = {(r["user_id"], r["item_id"]): (round(r["raw_score"], 9), r["support"]) for r in item_cf.cf_recall(weights, neighbors, 1000).collect()}
    asked = df.select("user_id").distinct().crossJoin(df.select("item_id").distinct())
    for r in item_cf.cf_scores(asked, weights, neighbors).collect():
        assert full.get((r["user_id"], r["item_id"]), (0.0, 0)) == (round(r["score"], 9), r["support"])


def test_tiled_top_items_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    users, items = rng.normal(size=(23, 5)), rng.normal(size=(31, 5))
    items[7] = items[3]  # equal scores go to the smaller id
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users)], "user_id long, weights array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id long, weights array<double>")
    got = defaultdict(list)
    out = vectors.top_items_per_user(left, right, 6, user_block=7, item_block=9)
    for r in out.orderBy("user_id", "rank").collect():
        got[r["user_id"]].append(r["item_id"])
    scores = np.round(users @ items.T, 9)
    for u in range(23):
        assert got[u] == sorted(range(31), key=lambda i: (-scores[u, i], i))[:6]


def test_sparse_tiles_drop_scores_at_the_floor(spark):
    left = spark.createDataFrame([(1, [0, 2], [0.6, 0.8])], "user_id long, terms array<int>, weights array<double>")
    right = spark.createDataFrame([(1, [0], [1.0]), (2, [1], [1.0]), (3, [2, 3], [0.5, 0.5])], "item_id long, terms array<int>, weights array<double>")
    out = vectors.top_items_per_user(left, right, 5, width=4, floor=0.0).orderBy("rank").collect()
    assert [(r["item_id"], round(r["raw_score"], 6)) for r in out] == [(1, 0.6), (3, 0.4)]


def test_tfidf_vocabulary_ignores_later_items(spark):
    items = spark.createDataFrame([(1, "red fox"), (2, "red box"), (3, "blue zz zz")], "item_id long, title string")
    seen = spark.createDataFrame([(1,), (2,)], "item_id long")
    terms = content.title_terms(items)
    vocab = {r["term"]: r for r in content.vocabulary(terms, items, seen).collect()}
    assert "zz" not in vocab and "red " in vocab and vocab["red"]["df"] == 2
    assert abs(vocab["red"]["idf"] - (math.log(3 / 3) + 1)) < 1e-12
    packed = content.item_vectors(terms, content.vocabulary(terms, items, seen)).collect()
    for row in packed:
        assert abs(sum(w * w for w in row["weights"]) - 1) < 1e-9


def test_ngrams_count_code_points_and_collapse_spaces(spark):
    items = spark.createDataFrame([(1, "A  猫😀")], "item_id long, title string")
    got = {r["term"] for r in content.title_terms(items).collect()}
    assert got == {"a ", " 猫", "猫😀", "a 猫", " 猫😀", "a 猫😀"}


def test_truncated_svd_matches_numpy(spark):
    rng = np.random.default_rng(9)
    dense = (rng.random((30, 20)) < 0.3) * 1.0
    rows = [(i, j, 1.0) for i in range(30) for j in range(20) if dense[i, j]]
    df = spark.createDataFrame(rows, "user_id long, item_id long, weight double")
    users, items = factors.svd_factors(df, 5)
    u = {r["user_id"]: np.array(r["weights"]) for r in users.collect()}
    v = {r["item_id"]: np.array(r["weights"]) for r in items.collect()}
    exact_u, s, exact_v = np.linalg.svd(dense)
    want = exact_u[:, :5] * s[:5] @ exact_v[:5]
    got = np.array([[u[i] @ v[j] if i in u and j in v else 0.0 for j in range(20)] for i in range(30)])
    # the leading components are exact to working precision, the last ones nearly so
    assert np.abs(got - want).max() < 0.05
    assert abs(np.linalg.norm(dense - got) - np.linalg.norm(dense - want)) < 1e-3


def test_products_are_the_same_in_every_shape(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for height, width in ((40, 25), (25, 40)):
        dense = (rng.random((height, width)) < 0.4) * rng.random((height, width))
        rows = [(i * 3, j * 5, float(dense[i, j])) for i in range(height) for j in range(width) if dense[i, j]]
        df = spark.createDataFrame(rows, "user_id long, item_id long, weight double").repartition(3)
        pairs = df.select("user_id", "item_id")
        found = []
        for narrow in (1 << 16, 1):
            monkeypatch.setattr(factors, "NARROW", narrow)
            users, items = factors.svd_factors(df, 4)
            u = {r["user_id"]: np.array(r["weights"]) for r in users.collect()}
            v = {r["item_id"]: np.array(r["weights"]) for r in items.collect()}
            got = np.array([[u[i * 3] @ v[j * 5] for j in range(width)] for i in range(height)])
            mse = np.mean([(1 - round(float(u[i] @ v[j]), 9)) ** 2 for i, j, _ in rows])
            assert abs(factors.observed_error(pairs, users, items).first()["mse"] - mse) < 1e-9
            found.append(got)
        assert np.abs(found[0] - found[1]).max() < 1e-9
        u, s, v = np.linalg.svd(dense)
        assert abs(np.linalg.norm(dense - found[0]) - np.linalg.norm(dense - u[:, :4] * s[:4] @ v[:4])) < 1e-3


def test_products_make_no_row_per_entry(spark):
    rows = [(i, (i * 7 + k * k * 31) % 400, 1.0) for i in range(400) for k in range(3)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, weight double")
    before = _rows_read(spark)
    factors.svd_factors(df, 4)[0].collect()
    # a few passes over the entries to pack them; the products read packed rows
    assert _rows_read(spark) - before < 8 * len(rows)


def _rows_read(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


def test_svd_recall_adds_the_feedback_cosine(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0])], "user_id long, weights array<double>")
    items = spark.createDataFrame([(1, [0.5, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], "item_id long, weights array<double>")
    state = spark.createDataFrame([(1, 2, 3.0, 0)], "user_id long, item_id long, affinity double, not_interested int")
    got = {r["item_id"]: r["raw_score"] for r in factors.svd_recall(users, items, state, 3).collect()}
    assert abs(got[2] - 0.35) < 1e-9 and abs(got[1] - 0.5) < 1e-9 and abs(got[3] - (1 + 0.35 / math.sqrt(2))) < 1e-9


def test_cutoffs_and_split_keep_ties_together(spark):
    rows = [(t % 5 + 1, t + 1, t // 3 + 1) for t in range(30)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, ts_ms long")
    cut = split.time_cutoffs(df).first()
    ordered = sorted(t for _, _, t in rows)
    assert (cut["train_cutoff"], cut["validation_cutoff"]) == (ordered[23], ordered[26])
    parts = split.time_split(df, cut["train_cutoff"], cut["validation_cutoff"])
    by_time = defaultdict(set)
    for r in parts.collect():
        by_time[r["ts_ms"]].add(r["split"])
    assert all(len(v) == 1 for v in by_time.values())
    assert {r["split"]: r["leak_free"] for r in split.split_summary(parts).collect()} == dict.fromkeys(split.SPLITS, True)


def test_cutoffs_refuse_one_timestamp(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 2, 5)], "user_id long, item_id long, ts_ms long")
    try:
        split.time_cutoffs(df).collect()
    except Exception as error:
        assert "strict chronological" in str(error)
    else:
        raise AssertionError("equal timestamps cannot be split")


def test_recall_plans_hold_no_product_of_all_rows(spark):
    df = spark.createDataFrame([(u, i, 1) for u, i in _histories()], "user_id long, item_id long, ts_ms long")
    neighbors = item_cf.item_neighbors(df, F.lit(1))
    plan = item_cf.cf_recall(item_cf.cf_weights(df), neighbors, 10)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan


def test_skipped_pairs_make_room_for_the_next_best(spark):
    rng = np.random.default_rng(9)
    left, right = rng.normal(size=(7, 4)), rng.normal(size=(30, 4))
    users = spark.createDataFrame([(u, [float(x) for x in left[u]]) for u in range(7)], "user_id long, weights array<double>")
    items = spark.createDataFrame([(i, [float(x) for x in right[i]]) for i in range(30)], "item_id long, weights array<double>")
    out = {(u, int(i)) for u in range(5) for i in np.argsort(-(right @ left[u]))[: 2 * u]} | {(0, 999)}
    skip = spark.createDataFrame(sorted(out), "user_id long, item_id long")
    for block in (None, 8):
        got = {}
        for r in vectors.top_items_per_user(users, items, 5, item_block=block, skip=skip).orderBy("user_id", "rank").collect():
            got.setdefault(r["user_id"], []).append(r["item_id"])
        for u in range(7):
            assert got[u] == [i for i in np.argsort(-(right @ left[u])) if (u, i) not in out][:5]


def test_items_stream_past_the_users_and_winners_never_travel(spark):
    """Many batches of items, ties across batches, values that single precision cannot tell apart, and a vector too large for it."""
    rng = np.random.default_rng(12)
    left, right = rng.normal(size=(25, 8)), rng.normal(size=(90, 8))
    right[45:] = right[:45] * (1.0 + 1e-8 * rng.integers(-1, 2, size=(45, 1)))
    left[3] *= 1e200
    users = spark.createDataFrame([(u, [float(x) for x in left[u]]) for u in range(25)], "user_id long, weights array<double>")
    items = spark.createDataFrame([(i, [float(x) for x in right[i]]) for i in rng.permutation(90).tolist()], "item_id long, weights array<double>")
    best = vectors.top_items_per_user(users, items, 9, item_block=11)
    got = {}
    for r in best.orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["item_id"])
    for u in range(25):
        scores = np.round(right @ left[u], 9)
        assert got[u] == sorted(range(90), key=lambda i: (-scores[i], i))[:9] or u == 3 and len(got[u]) == 9
    plan = best.groupBy("user_id").count()._jdf.queryExecution().executedPlan().toString()
    # one exchange deals users and items, the other one is the count's
    assert plan.count("Exchange") == 2 and "Window" not in plan
