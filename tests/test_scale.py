"""Plans and operators that must not grow with the tables in one place."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from feedloom import values as V
from feedloom.operators import behaviour, evaluation, fusion, merge, mixing
from feedloom.plans.catalog import load
from feedloom.sources.tables import Tables


@pytest.mark.parametrize("name", ["content_profile", "content_profile_feedback", "user_item_state", "cf_weights"])
def test_no_side_is_broadcast_before_it_is_measured(spark, name):
    df = load()[name].build(Tables(spark, entry.SMOKE_DIR))
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
    # the vocabulary, at most max_features rows, is broadcast by a hint
    assert all("[term#" in line for line in joins)


def test_terms_are_counted_in_the_row(spark):
    from feedloom.operators import content

    items = spark.createDataFrame([(1, "abab  x"), (1, "ab"), (2, "a"), (3, ""), (4, None)], "item_id long, title string")
    terms = content.title_terms(items)
    got = {(r["item_id"], r["term"]): r["tf"] for r in terms.collect()}
    assert got[1, "ab"] == 3 and got[1, "aba"] == 1 and got[1, "b x"] == 1 and {k[0] for k in got} == {1}
    plan = terms.groupBy("item_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_profiles_sum_over_batches(spark):
    """A user whose rows span many Arrow batches, users without weight, and a pair of equal vectors."""
    import math

    from feedloom.operators import content

    vectors = spark.createDataFrame([(i, [i % 3, 5 + i % 7, 70_000 + i], [0.5, 0.25, 1.0]) for i in range(50)], "item_id long, terms array<int>, weights array<double>")
    pairs = [(1, i, 1.0) for i in range(50)] + [(2, 3, 2.0), (3, 4, 0.0), (4, 999, 1.0)]
    weights = spark.createDataFrame(pairs, "user_id long, item_id long, w double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {r["user_id"]: dict(zip(r["terms"], r["weights"])) for r in content.content_profiles(weights, vectors).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {}
    for user, item, w in pairs:
        if item < 50:
            own = want.setdefault(user, {})
            for term, x in zip([item % 3, 5 + item % 7, 70_000 + item], [0.5, 0.25, 1.0]):
                own[term] = own.get(term, 0.0) + w * x
    for user in (1, 2):
        norm = math.sqrt(sum(x * x for x in want[user].values()))
        assert got[user] == pytest.approx({k: x / norm for k, x in want[user].items()})
    assert set(got) == {1, 2}


@pytest.mark.parametrize("floor", [None, 0.0])
def test_best_over_pieces_equals_best_at_once(floor):
    import numpy as np

    from feedloom.operators import vectors

    rng = np.random.default_rng(4)
    scores = np.round(rng.normal(size=(40, 200)), 1) + rng.choice([0.0, 4e-10, -4e-10], size=(40, 200))
    scores[3], scores[4, 5:] = -1.0, np.nan
    ids = np.sort(rng.choice(10_000, 200, replace=False))
    want = vectors.best_rows(scores, ids, 7, floor)
    for step in (1, 9, 64, 200):
        got = vectors._best_of(((i, scores[:, i : i + step]) for i in range(0, 200, step)), ids, 7, floor)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
        assert np.array_equal(got[2], scores[want])


def test_one_block_of_items_needs_no_second_shuffle(spark):
    from feedloom.operators import vectors

    users = spark.createDataFrame([(u, [float(u), 1.0]) for u in range(9)], "user_id long, weights array<double>")
    items = spark.createDataFrame([(i, [1.0, float(i % 4)]) for i in range(30)], "item_id long, weights array<double>")
    one = vectors.top_items_per_user(users, items, 5)
    assert "Window" not in one._jdf.queryExecution().executedPlan().toString()
    many = vectors.top_items_per_user(users, items, 5, item_block=4)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_boosts_meet_in_the_row(spark):
    """Users and campaigns are not held as (user, item) rows in any sort or shuffle."""
    df = load()["active_boosts"].build(Tables(spark, entry.SMOKE_DIR))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan and ", item_id#" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning(user_id" in x)


def _shuffles(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]


def test_no_term_and_no_edge_travels_as_a_row(spark):
    from feedloom.operators import item_cf
    from feedloom.plans import evaluation

    t = Tables(spark, entry.SMOKE_DIR)
    asked = t.interactions.select("user_id", "item_id").distinct().withColumn("label", F.lit(1))
    content_ = _shuffles(evaluation.content_scores(t, asked))
    neighbors = spark.createDataFrame([(1, 2, 0.5)], "item_id long, neighbor_id long, score double")
    cf = _shuffles(item_cf.cf_scores(asked, item_cf.cf_weights(t.interactions), neighbors))
    assert content_ and cf
    assert not any("user_id" in line and "term_id" in line for line in content_)
    assert not any("user_id" in line and "h#" in line.replace("hash", "") for line in cf)


def test_pair_scores_over_batches(spark):
    """Users that span Arrow batches, without a profile, with terms the profile lacks, and items without a vector."""
    from feedloom.operators import content, item_cf

    vectors = {i: {i % 3: 0.5, 5 + i % 7: 0.25, 70_000 + i: 1.0} for i in range(40)}
    profiles = {1: {0: 0.5, 70_003: 2.0}, 2: {1: 1.0, 6: 3.0, 70_039: 1.0}, 3: {5: 1.0}}
    pairs = [(u, i, i % 2) for u in (1, 2, 4) for i in range(45)]

    def packed(key, of):
        return spark.createDataFrame([(k, sorted(v), [v[x] for x in sorted(v)]) for k, v in of.items()], f"{key} long, terms array<int>, weights array<double>")

    edges = {h: {(h * 7 + k) % 45: 1.0 / (k + 1) for k in range(9)} for h in range(40)}
    history = [(u, h, 1.0 + h % 3) for u in (1, 2, 3) for h in range(u, 45, 2)]
    asked = spark.createDataFrame(pairs, "user_id long, item_id long, label int")
    near = spark.createDataFrame([(h, n, s) for h, of in edges.items() for n, s in of.items()], "item_id long, neighbor_id long, score double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        dots = {(r["user_id"], r["item_id"], r["label"]): r["score"] for r in content.pair_dots(asked, packed("user_id", profiles), packed("item_id", vectors)).collect()}
        sums = {(r["user_id"], r["item_id"]): (r["score"], r["support"]) for r in item_cf.cf_scores(asked, spark.createDataFrame(history, "user_id long, item_id long, w double"), near).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert set(dots) == set(pairs) and set(sums) == {p[:2] for p in pairs}
    for u, i, label in pairs:
        assert dots[u, i, label] == pytest.approx(sum(w * profiles.get(u, {}).get(x, 0.0) for x, w in vectors.get(i, {}).items()))
        hits = [w * edges[h][i] for v, h, w in history if v == u and i in edges.get(h, {})]
        assert sums[u, i] == (pytest.approx(sum(hits)), len(hits))


def _shuffled_records(spark):
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_few_positives_need_all_draws(spark):
    from feedloom.operators import training

    train = spark.createDataFrame([(u, (u * 37 + k * 101) % 3000) for u in range(300) for k in range(10)], "user_id long, item_id long")
    before = _shuffled_records(spark)
    rows = training.weighted_negatives(train, train, train, rounds=20)
    assert rows.groupBy("user_id", "item_id").count().filter("count <> 4").isEmpty()
    # 80 draws of a positive would be 240,000 rows in every shuffle
    assert _shuffled_records(spark) - before < 150_000


def test_only_ids_travel_to_the_pool(spark):
    from feedloom.operators import popularity

    users = spark.createDataFrame([(u,) for u in range(500)], "user_id long")
    counts = spark.createDataFrame([(i, i % 11) for i in range(200)], "item_id long, exposure_count long")
    before = _shuffled_records(spark)
    rows = popularity.explore_recall(users, counts, 7, 20).groupBy("user_id").count().collect()
    assert len(rows) == 500 and {r["count"] for r in rows} == {20}
    # 10,000 rows of the lists moved before
    assert _shuffled_records(spark) - before < 4_000


def test_pairs_of_sources_are_columns(spark):
    from itertools import combinations

    from feedloom import values as V
    from feedloom.operators import mixing

    rows = [(u, i, V.SOURCES[(u * i + k) % 7]) for u in range(5) for i in range(6) for k in range(u % 3 + 1)] + [(9, 1, V.SOURCES[0])]
    df = spark.createDataFrame(rows + rows[:7], "user_id long, item_id long, source string")
    out = mixing.source_overlap(df)
    assert not any("left" in line for line in _shuffles(out))
    got = {(r["left"], r["right"]): (r["users"], r["jaccard"]) for r in out.collect()}
    users = {u for u, _, _ in rows}
    of = {(u, s): {i for v, i, x in rows if (v, x) == (u, s)} for u in users for s in V.SOURCES}
    for a, b in combinations(sorted(V.SOURCES), 2):
        shares = [len(of[u, a] & of[u, b]) / len(of[u, a] | of[u, b]) if of[u, a] | of[u, b] else 0.0 for u in users]
        assert got[a, b] == (len(users), pytest.approx(sum(shares) / len(shares)))
    assert mixing.source_overlap(df.limit(0)).isEmpty()


def test_exposures_of_a_stream_are_not_grouped_per_batch(spark):
    from feedloom.streaming import events as S

    exposures = spark.createDataFrame([(1, 2, 3, 0), (1, 2, 3, 0), (4, 5, 6, None)], "request_id long, user_id long, item_id long, position int")
    rows = spark.createDataFrame([("a", 1, 2, 3, 0), ("b", 1, 2, 3, 1), ("c", 4, 5, 6, None)], "event_id string, request_id long, user_id long, item_id long, position int")
    out = S.stream_validate(rows, exposures)
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r["event_id"] for r in out.collect()] == ["a"]


def _plain_caps(sources, limit, caps):
    left, order = list(range(len(sources))), []
    while left and len(order) < limit:
        seen, fits = Counter(), []
        for i in left:
            seen[sources[i]] += 1
            if seen[sources[i]] <= caps.get(sources[i], len(sources)):
                fits.append(i)
        window = (fits + [i for i in left if i not in fits])[: min(10, limit - len(order))]
        order += window
        left = [i for i in left if i not in window]
    return order


def test_caps_look_at_heads_only():
    """The order of the plain rule, at a cost that does not pass over the whole list for every ten rows."""
    rng = random.Random(3)
    for size in (0, 1, 9, 40, 150):
        for limit in (0, 7, 500):
            sources = [rng.choice((*V.SOURCES[: rng.randint(1, 7)], "other")) for _ in range(size)]
            caps = {**V.SOURCE_CAPS_AT_10, "explore": 0}
            assert mixing.capped_order(sources, limit, caps) == _plain_caps(sources, limit, caps)
    long = [rng.choice(V.SOURCES) for _ in range(500)]
    began = time.process_time()
    for _ in range(100):
        mixing.capped_order(long, 500, V.SOURCE_CAPS_AT_10)
    # 0.1 s; passing over the list for every window took 5 s
    assert time.process_time() - began < 1.5


def test_only_positives_become_rows_per_policy_and_scope(spark):
    rng = random.Random(5)
    rows = [(u, i, int(rng.random() < 0.2), rng.randint(0, 9) / 10, rng.random(), rng.random() < 0.5) for u in range(40) for i in range(rng.randint(3, 40))]
    names = ["user_id", "item_id", "label", "text_score", "visual_score", "is_cold"]
    found = fusion.fusion_metrics(spark.createDataFrame(rows, names))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")

    ranked = spark.createDataFrame(rows, names)
    for score in ("text", "visual"):
        ranked = merge.rank_normalize(ranked, f"{score}_score", f"{score}_rank")
    for policy, weight in fusion.fusion_policies():
        for scope in fusion.SCOPES:
            kept = (F.col("label") == 0) | F.lit(scope == "sampled_all_items") | (F.col("is_cold") == (scope == "cold"))
            scored = ranked.filter(kept).withColumn("score", (1.0 - weight) * F.col("text_rank") + weight * F.col("visual_rank"))
            if policy in ("text_only", "static_0.17"):
                want = evaluation.ranking_metrics(scored).first()
                got = found.filter((F.col("policy") == policy) & (F.col("scope") == scope)).first()
                assert [got[c] for c in want.asDict()] == pytest.approx(list(want)), (policy, scope)


def test_context_events_do_not_meet_the_budget(spark):
    rng = random.Random(9)
    kinds = ["impression", "click", "like", "share", "dwell", "not_interested"]
    rows = [(f"e{i}", rng.choice(kinds[: rng.choice((5, 6))]), rng.randint(1, 12), rng.randint(1, 9), rng.randint(1, 40000), i * 3600000) for i in range(900)]
    events = behaviour.classify_feedback(spark.createDataFrame(rows, ["event_id", "event_type", "user_id", "item_id", "dwell_ms", "received_ms"]))
    slim = behaviour.budget_events(events)
    assert slim.filter("disposition = 'context'").isEmpty() and slim.count() < 900
    kept = behaviour.positive_feedback(slim)
    names = ["user_id", "item_id", "received_ms", "disposition"]
    whole = behaviour.capped_feedback(events).filter(F.col("disposition") == "positive").select(*names)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, whole.collect())) != []


def test_every_scorer_is_evaluated_on_the_same_queries(spark):
    rows = {r["scorer"]: r for r in load()["evaluate_sources"].build(Tables(spark, entry.SMOKE_DIR)).collect()}
    policies = {V.SAFE_POLICY, V.DYNAMIC_POLICY}
    assert set(rows) == {"popular", "random", "item_cf", "content", "svd", "svd_content_fallback", "hybrid_all_sources"} | policies
    assert len({(r["queries"], r["positives"]) for r in rows.values()}) == 1
    assert rows["hybrid_all_sources"]["ndcg"] in {rows[p]["ndcg"] for p in policies}


def test_a_title_travels_in_few_bytes(spark):
    """Codes of a title's few factors stand for its weights; other vectors keep their weights."""
    import numpy as np

    from feedloom.operators import content

    rng = np.random.default_rng(4)
    idf = 1.0 + np.log(rng.uniform(1, 500, 8192))
    for size in (1, 67, 900):
        ids = np.sort(rng.choice(8192, size, replace=False))
        weights = (1.0 + np.log(rng.integers(1, 5, size))) * idf[ids]
        weights /= np.sqrt(weights @ weights)
        blob = content._blob(ids, weights, idf)
        back, same = content._unblob(blob, idf)
        assert (back == ids).all() and np.abs(same / weights - 1).max() < 1e-11
        assert len(blob) < 0.4 * len(content._blob(ids, weights, None)) or size == 1
    other = rng.uniform(size=900)
    back, same = content._unblob(content._blob(ids, other, idf), idf)
    assert (back == ids).all() and (same == other).all()
    items = spark.createDataFrame([(i, f"red box number {i} box") for i in range(40)], "item_id long, title string")
    terms = content.title_terms(items)
    vocab = content.vocabulary(terms, items, items)
    vectors = content.item_vectors(terms, vocab)
    weights = spark.createDataFrame([(u, (u * 7 + k) % 40, 1.0 + k) for u in range(9) for k in range(5)], "user_id long, item_id long, w double")
    pairs = weights.select("user_id", ((F.col("item_id") + 3) % 40).alias("item_id"))
    plain, packed = (content.pair_dots(pairs, content.content_profiles(weights, vectors, v), vectors, v) for v in (None, vocab))
    a, b = ({(r["user_id"], r["item_id"]): r["score"] for r in x.collect()} for x in (plain, packed))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12 and max(a.values()) > 0
