from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedloom.operators import behaviour as B
from feedloom.operators import operations as O
from feedloom.session import shared_dir
from feedloom.sources import files, sinks
from feedloom.streaming import events as S

SCHEMA = (
    "event_id string, event_type string, request_id long, user_id long, item_id long, position int, dwell_ms long, received_ms long"
)


def _events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [
    ("i1", "impression", 1, 1, 5, 0, None, 1000), ("c1", "click", 1, 1, 5, 0, None, 2000),
    ("d1", "dwell", 1, 1, 5, 0, 1000, 3000), ("d2", "dwell", 1, 1, 5, 0, 40000, 4000),
    ("i2", "impression", 2, 1, 5, 1, None, 90_000_000), ("n1", "not_interested", 1, 2, 5, 0, None, 5000),
    ("l1", "like", 1, 2, 5, 0, None, 6000),
]


def test_state_in_closed_form(spark):
    got = {r["user_id"]: r for r in B.user_item_state(_events(spark, ROWS)).collect()}
    one = got[1]
    assert (one["exposure_count"], one["dwell_ms_total"], one["dwell_event_count"], one["revisit_count"]) == (2, 40000, 1, 1)
    assert one["affinity"] == 1.0 + 1.5 + 1.5 and one["last_event_ms"] == 90_000_000
    assert got[2]["affinity"] == -4.0 and got[2]["not_interested"] == 1


def test_profile_summary_holds_both_item_lists(spark):
    liked = [(f"c{i}", "click", 1, 1, i, 0, None, 1000 + i) for i in range(25)]
    more = [("l7", "like", 1, 1, 7, 0, None, 5000), ("n40", "not_interested", 1, 1, 40, 0, None, 6000), ("i1", "impression", 2, 2, 5, 0, None, 9)]
    got = {r["user_id"]: r for r in B.profile_summary(B.user_item_state(_events(spark, liked + more))).collect()}
    one = got[1]
    assert (one["clicks"], one["likes"], one["not_interested"], one["updated_ms"]) == (25, 1, 1, 6000)
    # strongest first, then latest; twenty at most
    assert [tuple(x) for x in one["positive_items"]] == [(7, 4.0)] + [(i, 1.0) for i in range(24, 4, -1) if i != 7]
    assert [tuple(x) for x in one["negative_items"]] == [(40, -4.0)]
    assert got[2]["positive_items"] == [] and got[2]["negative_items"] == [] and got[2]["impressions"] == 1


def test_visits_count_earlier_requests(spark):
    got = {r["event_id"]: r["visit_index"] for r in B.visits(_events(spark, ROWS)).collect()}
    assert got == {"i1": 1, "i2": 2}
    assert [r["event_id"] for r in B.revisit_events(_events(spark, ROWS)).collect()] == ["revisit:2:5:1"]


def test_feedback_cap_and_conflict(spark):
    rows = [
        ("a", "share", 1, 1, 9, 0, None, 1), ("b", "like", 1, 1, 9, 0, None, 2), ("c", "click", 1, 1, 9, 0, None, 200_000_000),
        ("d", "like", 1, 2, 9, 0, None, 1), ("e", "not_interested", 1, 2, 9, 0, None, 2),
    ]
    got = {r["event_id"]: (r["weight"], r["disposition"]) for r in B.capped_feedback(B.classify_feedback(_events(spark, rows))).collect()}
    assert got["a"] == (4.0, "positive") and got["b"] == (2.0, "positive") and got["c"] == (0.0, "ignored_positive_cap")
    assert got["d"] == (0.0, "ignored_negative_conflict") and got["e"] == (-2.0, "negative")


@pytest.mark.parametrize("n", [3, 4, 5, 10, 23])
def test_feedback_borders_match_the_rule(spark, n):
    import math

    times = [10 * i for i in range(n)]
    df = spark.createDataFrame([("positive", t) for t in times] * 2, "disposition string, received_ms long")
    row = B.feedback_cutoffs(df).first()
    first = min(math.ceil(n * 0.8) - 1, n - 3)
    second = min(max(first + 1, math.ceil(n * 0.9) - 1), n - 2)
    assert (row["train_cutoff"], row["validation_cutoff"]) == (times[first], times[second])


def test_validation_reasons(spark):
    rows = [
        ("a", "favorite", 1, 1, 1, 0, None, 0), ("b", "dwell", 1, 1, 1, 0, None, 0), ("c", "dwell", 1, 1, 1, 0, 10, 0),
        ("d", "click", 1, 1, 1, 0, 900, 0), ("e", "jump", 1, 1, 1, 0, None, 0), ("f", "click", 1, 1, 1, 10_000, None, 0),
        ("", "click", 1, 1, 1, 0, None, 0),
    ]
    got = {r["event_id"]: (r["event_type"], r["reject_reason"]) for r in B.validate_events(_events(spark, rows)).collect()}
    assert got["a"] == ("like", None) and got["b"][1] == "dwell_missing" and got["c"][1] == "dwell_range"
    assert got["d"][1] == "dwell_unexpected" and got["e"][1] == "event_type" and got["f"][1] == "position" and got[""][1] == "event_id"


def _arrivals(spark, folder, slices, schema=SCHEMA):
    """(stream, arrivals): each slice of rows comes in as files of its own."""
    spark.createDataFrame([], schema).write.parquet(folder)
    frames = [spark.createDataFrame(rows, schema) for rows in slices]
    return S.read_stream(spark, frames[0].schema, folder), [lambda df=df: df.write.mode("append").parquet(folder) for df in frames]


# repeats, a longer dwell, a request shown twice, an id used for two events, a row that comes late
DELIVERED = [
    ROWS[:3],
    [("c1", "click", 1, 1, 5, 0, None, 2000), ROWS[3], ("i1b", "impression", 1, 1, 5, 0, None, 3500)],
    [*ROWS[4:], ("l1", "share", 1, 2, 5, 0, None, 90_000_500)],
    [("d3", "dwell", 1, 1, 5, 0, 2000, 90_100_000), ("i2b", "impression", 2, 1, 5, 1, None, 90_100_001), ("x1", "click", 3, 3, 5, 0, None, 4000)],
]


def test_streams_equal_batch_over_repeats(spark, tmp_path):
    everything = _events(spark, [r for part in DELIVERED for r in part])

    def drained(name, build, keys):
        stream, arrivals = _arrivals(spark, str(tmp_path / name), DELIVERED)
        return S.latest_update(S.drain(build(stream), "update", arrivals=arrivals), keys)

    def same(got, want):
        columns = sorted(want.columns)
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))

    same(drained("dedup", S.stream_dedup, [*B.EVENT_KEY, "event_type"]), B.deduplicate(everything))
    state = drained("state", S.stream_state, ["user_id", "item_id"])
    same(B.finish_state(state), B.user_item_state(everything))
    visits = drained("visits", S.stream_revisits, ["event_id"])
    assert [(r["event_id"], r["visit_index"], r["received_ms"]) for r in visits.collect()] == [("revisit:2:5:1", 2, 90_000_000)]
    conflicts = drained("conflicts", S.stream_conflicts, ["event_id"])
    assert [(r["event_id"], r["deliveries"]) for r in conflicts.collect()] == [("l1", 2)]


@pytest.mark.parametrize("every", [2, 8])
def test_folded_streams_equal_batch_and_keep_no_operator_state(spark, tmp_path, monkeypatch, every):
    monkeypatch.setattr(S, "MERGE_EVERY", every)
    everything = _events(spark, [r for part in DELIVERED for r in part])

    def folded(name, fold):
        stream, arrivals = _arrivals(spark, str(tmp_path / name), DELIVERED)
        return S.drain_fold(stream, fold, arrivals)

    def same(got, want):
        columns = sorted(want.columns)
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))

    shared = Path(shared_dir(spark))
    known = set(shared.glob("feedloom-*/checkpoint/state"))
    same(folded("dedup", S.CURRENT), B.deduplicate(everything))
    same(B.finish_state(folded("pairs", S.PAIRS)), B.user_item_state(everything))
    same(folded("ids", S.CONFLICTS), B.id_conflicts(everything))
    assert set(shared.glob("feedloom-*/checkpoint/state")) == known
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "empty"))
    assert S.drain_fold(S.read_stream(spark, everything.schema, str(tmp_path / "empty")), S.CONFLICTS).count() == 0


def test_late_rows_are_those_behind_the_watermark(spark, tmp_path):
    stream, arrivals = _arrivals(spark, str(tmp_path / "late"), DELIVERED)
    late = S.drain_late(stream, 1000, arrivals=arrivals)
    assert sorted(r["event_id"] for r in late.collect()) == ["x1"]


def test_alerts_open_refresh_and_resolve_on_the_stream(spark, tmp_path):
    schema = "kind string, user_id long, latency_ms double, received_ms long"
    clicks = [[("click", 1, None, 60_000 * i + k) for k in range(n)] for i, n in enumerate((1, 3, 4, 0, 5))]
    clicks[3] = [("request", 1, 5.0, 185_000)]
    stream, arrivals = _arrivals(spark, str(tmp_path / "facts"), clicks, schema)
    rules = spark.createDataFrame(
        [("r1", "clicks", ">=", 3.0, True), ("r2", "requests", ">", 0.0, True), ("r3", "clicks", ">=", 0.0, False)],
        "rule_id string, metric string, operator string, threshold double, enabled boolean",
    )
    items = spark.createDataFrame([(1, "online")], "item_id long, status string")

    def evaluate(rows, now):
        asked = rows.withColumn("created_ms", F.col("received_ms"))
        events = rows.withColumn("event_type", F.col("kind")).filter("kind = 'click'")
        return O.alert_metrics(asked.filter("kind = 'request'"), asked.filter("kind = 'exposure'"), events, items, now, 1)

    none = spark.createDataFrame(
        [("old", "gone", "open", 1.0, 5, None, 5)],
        "event_id string, rule_id string, status string, observed double, triggered_ms bigint, resolved_ms bigint, evaluated_ms bigint",
    )
    got = {r["event_id"]: r for r in S.drain_alerts(stream, rules, evaluate, none, arrivals=arrivals).collect()}
    assert "old" not in got  # its rule is gone
    first, second = got["alert:r1:60003"], got["alert:r1:240005"]
    assert (first["status"], first["resolved_ms"], first["observed"]) == ("resolved", 185_001, 0.0)
    assert (second["status"], second["observed"]) == ("open", 5.0)
    assert {r["rule_id"]: r["status"] for r in got.values() if r["rule_id"] != "r1"} == {"r2": "open"} and len(got) == 3


def test_readers_report_bad_rows(spark, tmp_path):
    path = tmp_path / "interactions.csv"
    path.write_text("﻿user,item,timestamp\n1,2,3\n1,2,3\n0,2,3\n1,x,3\n1,2,\n", encoding="utf-8")
    rows, rejects = files.read_interactions(spark, str(path))
    assert rows.count() == 2 and sorted(r["reason"] for r in rejects.collect()) == ["item", "timestamp", "user"]
    bad = tmp_path / "bad.csv"
    bad.write_text("item,user,timestamp\n1,2,3\n")
    with pytest.raises(ValueError):
        files.read_interactions(spark, str(bad))


def test_titles_and_stats(spark, tmp_path):
    titles = tmp_path / "titles.csv"
    titles.write_text('item,title\n1," a ""q"", b "\n2,  \n3,x\n3,y\n')
    rows, rejects = files.read_titles(spark, str(titles))
    assert [(r["item_id"], r["title"]) for r in rows.collect()] == [(1, 'a "q", b')]
    assert sorted(r["reason"] for r in rejects.collect()) == ["duplicate_item", "duplicate_item", "title"]
    stats = tmp_path / "stats.tsv"
    stats.write_text("1\t2\t3\n\n2\t-1\t3\n3\t4\n")
    rows, rejects = files.read_item_stats(spark, str(stats))
    assert [(r["item_id"], r["likes"], r["views"]) for r in rows.collect()] == [(1, 2, 3)] and rejects.count() == 2


def test_feedback_file_refuses_repeats(spark, tmp_path):
    path = tmp_path / "feedback.csv"
    path.write_text(",".join(files.FEEDBACK_COLUMNS) + "\ne,1,2,3,click,1.0,positive,t\ne,1,2,3,click,1.0,positive,t\n")
    with pytest.raises(Exception, match="repeated event ids"):
        files.read_feedback(spark, str(path)).collect()
    assert files.read_feedback(spark, None).count() == 0


def test_publication_is_atomic(spark, tmp_path):
    root = str(tmp_path / "published")
    good = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "item_id long, weights array<double>")
    sinks.publish_table(good, root, "v1", ["item_id"], "weights")
    with pytest.raises(FileExistsError):
        sinks.publish_table(good, root, "v1", ["item_id"], "weights")
    bad = spark.createDataFrame([(1, [1.0, float("nan")]), (1, [0.0])], "item_id long, weights array<double>")
    with pytest.raises(ValueError):
        sinks.publish_table(bad, root, "v2", ["item_id"], "weights")
    assert sinks.read_pointer(spark, root)["version"] == "v1" and sinks.read_published(spark, root).count() == 2


def test_alert_life_cycle(spark):
    rules = spark.createDataFrame([("r", "ctr", ">", 0.5, True)], "rule_id string, metric string, operator string, threshold double, enabled boolean")
    none = spark.createDataFrame([], "event_id string, rule_id string, status string, observed double, triggered_ms long, resolved_ms long, evaluated_ms long")

    def step(events, value, now):
        metrics = spark.createDataFrame([("ctr", value)], "metric string, value double")
        return O.evaluate_alerts(rules, metrics, events, now)

    first = step(none, 0.9, 1)
    assert [r["transition"] for r in first.collect()] == ["triggered"]
    second = step(first.drop("transition"), 0.8, 2)
    assert [(r["transition"], r["observed"]) for r in second.collect()] == [("refreshed", 0.8)]
    third = step(second.drop("transition"), 0.1, 3)
    assert [(r["transition"], r["status"], r["resolved_ms"]) for r in third.collect()] == [("resolved", "resolved", 3)]


def test_status_batches_are_idempotent(spark):
    items = spark.createDataFrame([(1, "online", 1), (2, "online", 1)], "item_id long, status string, status_version long")
    rows = [
        (1, 9, "k", 1, "offline", 10), (1, 9, "k", 2, "offline", 10), (2, 9, "k", 1, "offline", 20), (2, 9, "k", 2, "offline", 20),
        (3, 9, "k", 1, "online", 30), (4, 9, "z", 77, "online", 40), (5, 9, "y", 1, "offline", 50),
    ]
    df = spark.createDataFrame(rows, "batch_id long, admin_id long, key string, item_id long, status string, at_ms long")
    outcomes = {r["batch_id"]: r["outcome"] for r in O.check_batches(df, items).collect()}
    assert outcomes == {1: "applied", 2: "replay", 3: "conflict", 4: "missing_items", 5: "applied"}
    updated, audit = O.apply_status_batches(items, df)
    assert {r["item_id"]: (r["status"], r["status_version"]) for r in updated.collect()} == {1: ("offline", 2), 2: ("offline", 2)}
    assert sorted(r["action"] for r in audit.collect()) == ["item_offline", "item_offline", "item_status_noop"]


def test_publication_keeps_pointers_and_checks_contents(spark, tmp_path):
    root, table = str(tmp_path / "published"), spark.createDataFrame([(1, "a"), (2, "b")], "item_id bigint, title string")
    sinks.publish_table(table, root, "v1", ["item_id"])
    sinks.publish_table(table.filter("item_id = 2"), root, "v2", ["item_id"])
    assert sinks.read_pointer(spark, root)["version"] == "v2" and sinks.read_published(spark, root).count() == 1
    assert sorted(p.name for p in (tmp_path / "published" / "pointers").glob("*.json")) == ["00000001.json", "00000002.json"]
    table.write.mode("append").parquet(f"{root}/v2")  # somebody adds rows to a published version
    with pytest.raises(ValueError, match="checksum"):
        sinks.read_published(spark, root)
    assert sinks.read_published(spark, root, verify=False).count() == 3


def test_rule_changes(spark):
    columns = "rule_id string, name string, metric string, operator string, threshold double, severity string, enabled boolean"
    rules = spark.createDataFrame([("old", "Old", "ctr", ">", 1.0, "info", True)], columns)
    log = spark.createDataFrame(
        [
            ("new", "create", "New", "clicks", ">=", 2.0, None, None, 1), ("new", "update", None, None, None, 3.0, "critical", False, 2),
            ("nameless", "create", None, "clicks", ">", 1.0, None, None, 3), ("odd", "create", "Odd", "bogus", ">", 1.0, None, None, 4),
            ("loud", "create", "Loud", "clicks", ">", 1.0, "loud", None, 5), ("old", "update", None, "clicks", None, 9.0, None, None, 6),
            ("old", "update", None, None, "~", 9.0, None, None, 7), ("nobody", "update", "x", None, None, None, None, None, 8),
            ("plain", "create", "Plain", "likes", "<", 1.0, None, None, 9), ("gone", "create", "Gone", "likes", "<", 1.0, None, None, 10), ("gone", "delete", None, None, None, None, None, None, 11),
        ],
        "rule_id string, op string, name string, metric string, operator string, threshold double, severity string, enabled boolean, at_ms bigint",
    )
    got = {r["rule_id"]: tuple(r)[1:] for r in O.maintain_rules(rules, log).select(*[c.split(" ")[0] for c in columns.split(", ")]).collect()}
    assert got == {
        "old": ("Old", "ctr", ">", 1.0, "info", True), "new": ("New", "clicks", ">=", 3.0, "critical", False),
        "plain": ("Plain", "likes", "<", 1.0, "warn", True),
    }
    events = spark.createDataFrame([("a", "old"), ("b", "gone")], "event_id string, rule_id string")
    assert [r["event_id"] for r in O.cascade_delete(events, spark.createDataFrame([("old",)], "rule_id string")).collect()] == ["a"]


def test_every_file_of_a_folder_has_its_header_checked(spark, tmp_path):
    folder = tmp_path / "split"
    folder.mkdir()
    (folder / "a.csv").write_text("user_id,item_id,timestamp_ms\n1,2,3\n")
    assert [tuple(r) for r in files.read_split(spark, str(folder)).collect()] == [(1, 2, 3)]
    (folder / "b.csv").write_text("item_id,user_id,timestamp_ms\n1,2,3\n")
    with pytest.raises(Exception):
        files.read_split(spark, str(folder)).collect()


def test_unknown_model_versions_fail(spark):
    models = spark.createDataFrame([("a", "{}", '{"r":1.0}'), ("b", "{}", '{"r":2.0}')], "version string, protocol_json string, metrics_json string")
    with pytest.raises(ValueError):
        O.compare_models(models, ["a", "c"])
    assert {r["delta"] for r in O.compare_models(models, ["a", "b"]).collect()} == {None}
