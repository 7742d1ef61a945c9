import json
import random
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spark_explore.operators import audit
from spark_explore.operators.item_sets import item_set_state
from spark_explore.operators.mapping import build_index_map
from spark_explore.operators.filters import AnyOf, passing
from spark_explore.plans import search
from spark_explore.streaming.audit_stream import append_new, stream_audit
from spark_explore.streaming.item_set_stream import fold_batch, read_item_sets
from conftest import rows

EVENTS = "event_id long, ts timestamp, session string, action string, element_id string, data string, route string"


def test_zero_seconds_are_left_out(spark):
    df = spark.createDataFrame([("s", 0), ("t", 3)], "session string, spent long")
    got = audit.audit_entries(df, "total", ["spent"], F.lit(5), F.col("spent"))
    assert rows(got, "session", "action", "timestamp", "completion_time") == [
        ("s", "Get Total Items", 5, None), ("t", "Get Total Items", 5, 3)]
    assert audit.audit_session(df).where("timestamp > 1700000000").count() == 2


def test_search_entries(spark):
    asked = spark.createDataFrame(
        [(1, "s", 2, "a", 5, "cats", 7, [3], "{}"), (2, "s", 2, "a", 5, "dogs", 0, [], None)],
        "req_id long, session string, model_id int, collection string, n int, text string, n_seen int, "
        "excluded array<long>, filters string")
    found = spark.createDataFrame([(1, 2, 8), (1, 1, 9)], "req_id long, rank int, media_id long")
    entries = audit.audit_search(asked, found, "text", F.lit(1)).collect()
    data = {json.loads(r["data"])["query"]: json.loads(r["data"]) for r in entries}
    assert data["cats"] == {"session": "s", "model_id": 2, "collection": "a", "suggestions": [9, 8],
                            "n_requested": 5, "query": "cats", "n_seen": 7, "excluded": [3], "filters": "{}"}
    assert data["dogs"]["suggestions"] == []
    faceted = json.loads(audit.audit_search(asked, found, "faceted").first()["data"])
    assert "query" not in faceted and "n_seen" not in faceted


def test_other_entries(spark):
    df = spark.createDataFrame([("s", 1, "a", 10, "{}", 3, "E", "m", "d", "c")],
                               "session string, model_id int, collection string, media_id long, body string, "
                               "tagset_id int, error_type string, message string, details string, context string")
    assert json.loads(audit.audit_catalogue(df, "facet_values").first()["data"]) == {
        "model_id": 0, "collection": "a", "tagset_id": 3}
    assert json.loads(audit.audit_items(df, "item").first()["data"])["name"] == "10"
    assert audit.audit_models(df, "model_add").first()["action"] == "Log Add Model"
    assert json.loads(audit.audit_errors(df).first()["data"])["message"] == "m"
    totals = spark.createDataFrame([("a", 4)], "collection string, total_items long")
    assert json.loads(audit.audit_total_items(df, totals).first()["data"])["total_items"] == 4


def test_write_audit_appends(spark, tmp_path):
    df = spark.createDataFrame([("s",)], "session string")
    for t in (10, 90_000):
        audit.write_audit(audit.audit_session(df, F.lit(t)), str(tmp_path / "log"))
    assert rows(spark.read.parquet(str(tmp_path / "log")), "timestamp") == [(10,), (90_000,)]


def test_stream_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    events = spark.createDataFrame(
        [(i, datetime(2024, 1, 1, 0, i), f"u{i % 2}", "click", None if i == 3 else f"k{i}", str(i), "/x") for i in range(20)],
        EVENTS)
    events.where("event_id < 12").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(EVENTS).parquet(source)
        stream_audit(stream, out, state).awaitTermination()
        return rows(spark.read.parquet(out), "timestamp", "session", "action", "data")

    run()
    # The rest arrives, together with a part that was delivered before.
    events.where("event_id >= 6").coalesce(1).write.mode("append").parquet(source)
    batch = rows(audit.client_events(events), "timestamp", "session", "action", "data")
    assert run() == batch
    assert run() == batch


def test_late_new_events_stay_and_replays_add_nothing(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))

    def deliver(*days):
        rows_ = [(d * 100 + i, datetime(2024, 1, d, 1, i), "u", "click", None, "1", "/x") for d in days for i in range(10)]
        spark.createDataFrame(rows_, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream_audit(spark.readStream.schema(EVENTS).parquet(source), out, state).awaitTermination()
        return spark.read.parquet(out).count()

    assert deliver(10) == 10
    assert deliver(1) == 20  # nine days late, but new
    assert deliver(10, 1, 5) == 30


def test_multi_text_takes_any_id_and_all_limits(spark, small):
    index = search.SearchIndex(small.embeddings, build_index_map(small), small.medias)
    encoder = lambda t: F.array(F.when(t == "up", 1.0).otherwise(-1.0), F.lit(0.0))
    pairs = "req_id long, collection string, media_id long"
    big = 2**62 + 5
    asked = spark.createDataFrame([(i, "a", 2, ["up", "down"], "k") for i in (7, big, 7 + 2**44)],
                                  "req_id long, collection string, n int, texts array<string>, filter_id string")
    seen = spark.createDataFrame([(7, "a", 17)], pairs)
    excluded = spark.createDataFrame([(big, "a", 16)], pairs)  # with its group: 10, 12, 14, 16
    got = rows(search.multi_text_search(asked.drop("filter_id"), index, encoder, seen=seen, excluded=excluded), "req_id", "media_id")
    assert got == sorted([(7, 16), (7, 15), (big, 17), (big, 15), (7 + 2**44, 17), (7 + 2**44, 16)])
    passed = passing(small, {"k": AnyOf((201,))})
    got = rows(search.multi_text_search(asked, index, encoder, passed=passed), "req_id", "media_id")
    some = sorted({m for _, m in got})
    assert len(got) == 6 and set(some) <= {m for m, in rows(passed.where("collection = 'a'"), "media_id")}
    pos = spark.createDataFrame([(7, "a", 17)], pairs)
    neg = spark.createDataFrame([(7, "a", 10)], pairs)
    got = search.multi_text_search(asked.drop("filter_id").where("req_id = 7"), index, encoder, positives=pos, negatives=neg)
    assert got.count() == 2 and got.agg(F.max("score")).first()[0] > 7


def test_item_sets_start_over_after_a_clear(spark):
    t = [datetime(2024, 1, 1, h) for h in range(6)]
    events = spark.createDataFrame(
        [("s", 1, "seen", t[0], False, 1), ("s", 1, "seen", t[1], True, None), ("s", 1, "seen", t[2], False, 2),
         ("s", 1, "seen", t[3], False, 2), ("s", 1, "excluded", t[0], False, 1), ("s", 2, "seen", t[5], True, None)],
        "session string, model_id int, name string, ts timestamp, is_clear boolean, item_id long")
    assert rows(item_set_state(events)) == [("s", 1, "excluded", 1), ("s", 1, "seen", 2)]


def test_multi_text_fuses_by_best_score(spark, small):
    index = search.SearchIndex(small.embeddings, build_index_map(small), small.medias)
    encoder = lambda t: F.array(F.when(t == "up", 1.0).otherwise(-1.0), F.lit(0.0))
    asked = spark.createDataFrame([(4, "a", 3, ["up", "down"])], "req_id long, collection string, n int, texts array<string>")
    got = search.multi_text_search(asked, index, encoder)
    assert rows(got, "req_id", "rank", "media_id", "score") == [(4, 1, 17, 7.0), (4, 2, 16, 6.0), (4, 3, 15, 5.0)]
    extra = spark.createDataFrame([(4, [0.0, 50.0])], "req_id long, query_vec array<double>")
    got = search.multi_text_search(asked, index, encoder, extra)
    assert rows(got, "rank", "media_id", "score") == [(1, 10, 50.0), (2, 11, 50.0), (3, 12, 50.0)]


def test_answer_checks_the_strategy(spark, small):
    index = search.SearchIndex(small.embeddings, build_index_map(small), small.medias)
    schema = "req_id long, collection string, text string, n int, filter_id string, kind string"
    pairs = spark.createDataFrame([], "req_id long, collection string, media_id long")
    passed = passing(small, {"x": AnyOf((200,))})
    bad = spark.createDataFrame([(1, "a", "t", 2, None, "magic")], schema)
    with pytest.raises(ValueError):
        search.answer(bad, index, pairs, pairs, passed)
    good = spark.createDataFrame([(1, "a", None, 2, "x", "faceted")], schema)
    more = spark.createDataFrame(
        [(2, "b", "t", 2, None, "text"), (3, "a", None, 2, None, "faceted"), (4, "a", None, 2, None, "text"),
         (5, "a", "t", -1, None, "rf")], schema)
    valid, rejected = search.split_requests(good.unionByName(bad.withColumn("req_id", F.lit(9))).unionByName(more),
                                            small.collections)
    assert rows(valid, "req_id") == [(1,)]
    assert rows(rejected, "req_id", "message") == [
        (2, "Unknown collection"), (3, "Faceted search without filters"), (4, "Text search without text"),
        (5, "Bad number of results"), (9, "Unknown search strategy")]
    got = search.timed(search.answer(good, index, pairs, pairs, passed, started=F.lit(9)), 2)
    assert rows(got, "req_id", "rank", "media_id", "strategy", "request_timestamp", "completion_time") == [
        (1, 1, 10, "faceted", 9, 2), (1, 2, 13, "faceted", 9, 2)]


def test_rejected_requests_are_logged_and_the_rest_is_answered(spark, small, tmp_path):
    index = search.SearchIndex(small.embeddings, build_index_map(small), small.medias)
    schema = "req_id long, collection string, text string, n int, filter_id string, kind string, session string"
    pairs = spark.createDataFrame([], "req_id long, collection string, media_id long")
    passed = passing(small, {"x": AnyOf((200,))})
    asked = spark.createDataFrame([(1, "a", None, 2, "x", "faceted", "s1"), (2, "b", "t", 2, None, "text", "s2"),
                                   (3, "a", None, 2, None, "magic", "s3")], schema)
    answers, log = search.answer_checked(asked, small.collections, index, pairs, pairs, passed, F.lit(5), started=F.lit(9))
    done = search.write_timed(answers, str(tmp_path / "out"))
    assert rows(done, "req_id", "rank", "media_id") == [(1, 1, 10), (1, 2, 13)]
    assert all(0 <= t < 300 for t, in rows(done, "completion_time"))
    entries = [(r[0], json.loads(r[1])) for r in rows(log, "session", "data")]
    assert [(s, d["message"], d["details"]) for s, d in entries] == [
        ("s2", "Unknown collection", "request 2"), ("s3", "Unknown search strategy", "request 3")]


def test_events_without_id_or_time_are_neither_lost_nor_doubled(spark, tmp_path):
    rows_ = [(1, datetime(2024, 1, 1), "u", "click", None, "1", "/x"), (None, datetime(2024, 1, 1), "u", "click", None, "1", "/x"),
             (None, datetime(2024, 1, 1), "u", "click", None, "1", "/x"), (None, None, "u", "view", None, None, None),
             (2, None, "u", "view", "e", None, None), (2, None, "u", "view", "e", None, None)]
    batch = spark.createDataFrame(rows_, EVENTS)
    out = str(tmp_path / "out")
    for _ in range(3):
        append_new(batch, out, "event_id")
        assert spark.read.parquet(out).count() == 5
    append_new(batch.where("event_id = 1 or action = 'view'").unionByName(spark.createDataFrame(
        [(None, None, "u", "new", None, None, None)], EVENTS)), out, "event_id")
    assert spark.read.parquet(out).count() == 6


SETS = "session string, model_id int, name string, ts timestamp, is_clear boolean, item_id long"


def test_item_sets_of_a_stream_equal_the_batch_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    events = [(rng.choice(["s", "t", None]), 1, rng.choice(["seen", "excluded"]), datetime(2024, 1, 1, 0, rng.randrange(40)),
               rng.random() < 0.1, rng.randrange(6)) for _ in range(300)]
    events += [("s", 1, "seen", None, False, 3), ("s", 1, "seen", datetime(2024, 1, 2), None, 3), ("t", 1, "seen", datetime(2024, 1, 2), False, None)]
    want = {}
    for s, m, n, ts, clear, item in events:
        if ts and clear is False and item is not None:
            gone = [e[3] for e in events if e[:3] == (s, m, n) and e[4] and e[3]]
            if not gone or ts > max(gone):
                want[s, m, n, item] = True
    frame = spark.createDataFrame(events, SETS)
    for every, parts in ((2, 5), (16, 3)):
        folder = str(tmp_path / f"sets{every}")
        for number in rng.sample(range(parts), parts):
            fold_batch(frame.where(F.pmod(F.xxhash64("ts", "item_id"), F.lit(parts)) == number), number, folder, every)
        for number in range(parts):  # once more, in order, as after a failure
            fold_batch(frame.where(F.pmod(F.xxhash64("ts", "item_id"), F.lit(parts)) == number), number, folder, every)
        got = {tuple(r) for r in read_item_sets(spark, folder).collect()}
        assert got == set(want)
    with pytest.raises(FileNotFoundError):
        read_item_sets(spark, str(tmp_path / "none"))
