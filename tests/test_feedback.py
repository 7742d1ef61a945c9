import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_explore.operators import feedback
from spark_explore.operators.mapping import build_index_map, numbered_items, with_numbers
from spark_explore.plans.search import SearchIndex, rf_search
from conftest import rows

REQ = "req_id long, collection string, text string, n int"
PAIR = "req_id long, collection string, media_id long"


def test_separator_separates_and_large_sets_train_alike(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [("c", i, (rng.normal(size=5) + (2 if i % 2 else -2)).tolist()) for i in range(80)]
    emb = spark.createDataFrame(vectors, "collection string, index_id long, embedding array<double>")
    samples = spark.createDataFrame(
        [(r, "c", i, 1.0 if i % 2 else -1.0) for r, m in ((1, 80), (2, 20), (3, 7)) for i in range(m)]
        + [(4, "c", 0, -1.0)],
        "req_id long, collection string, index_id long, label double",
    )
    small = {r.req_id: np.array(r.weights) for r in feedback.train_hyperplanes(samples, emb).collect()}
    assert sorted(small) == [1, 2, 3]  # no positive sample: no separator
    x = np.hstack([[v for _, _, v in vectors], np.ones((80, 1))])
    assert ((x @ small[1] > 0) == (np.arange(80) % 2 == 1)).all()
    monkeypatch.setattr(feedback, "SAMPLES_PER_TASK", 10)
    monkeypatch.setattr(feedback, "ROUNDS", 4)
    mixed = {r.req_id: np.array(r.weights) for r in feedback.train_hyperplanes(samples, emb).collect()}
    monkeypatch.setattr(feedback, "SAMPLES_PER_TASK", 1000)
    plain = {r.req_id: np.array(r.weights) for r in feedback.train_hyperplanes(samples, emb).collect()}
    # Executors receive the module by value, so the patched rounds hold for both paths.
    for req in plain:
        assert np.allclose(mixed[req], plain[req], atol=1e-9)


def test_samples(spark, small):
    mapped = build_index_map(small)
    requests = spark.createDataFrame(
        [(1, "a", None, 3), (2, "a", None, 3), (3, "a", "text", 3)], REQ)
    pos = spark.createDataFrame([(1, "a", 10), (1, "a", 12)], PAIR)
    neg = spark.createDataFrame([(1, "a", 11), (2, "a", 17)], PAIR)
    pseudo = spark.createDataFrame([(1, "a", 10)], PAIR)
    got = feedback.feedback_samples(requests, mapped, pos, neg, pseudo).cache()
    assert rows(got.where("req_id = 1"), "index_id", "label") == [(0, 1.0), (0, 1.0), (1, -1.0), (2, 1.0)]
    two = rows(got.where("req_id = 2"), "index_id", "label")
    assert len([r for r in two if r[1] > 0]) == 5 and [r for r in two if r[1] < 0] == [(7, -1.0)]
    assert len({r[0] for r in two if r[1] > 0}) == 5
    # A text without results leaves no positives: random ones are not drawn for it.
    assert rows(got.where("req_id = 3 and label > 0")) == []
    again = feedback.feedback_samples(requests, mapped, pos, neg, pseudo)
    assert rows(again) == rows(got)


def test_search_keeps_positives_and_drops_requests_without_any(spark, small):
    index = SearchIndex(small.embeddings, build_index_map(small), small.medias)
    requests = spark.createDataFrame([(1, "a", None, 2), (2, "a", "???", 2)], REQ)
    pos = spark.createDataFrame([(1, "a", 17), (1, "a", 16)], PAIR)
    neg = spark.createDataFrame([(1, "a", 10), (1, "a", 11)], PAIR)
    got = rf_search(requests, index, pos, neg)
    assert rows(got, "req_id", "rank", "media_id") == [(1, 1, 17), (1, 2, 16)]
    seen = spark.createDataFrame([(1, "a", 17)], PAIR)
    got = rf_search(requests, index, pos, neg, seen=seen)
    assert rows(got, "req_id", "rank", "media_id") == [(1, 1, 16), (1, 2, 15)]


def test_random_samples_over_gaps_and_small_collections(spark):
    mapped = [("gaps", 1000 + i, 10 * i) for i in range(100)] + [("five", i, 7 * i) for i in range(5)] + [("two", i, 3 + i) for i in range(2)]
    mapped = spark.createDataFrame(mapped, "collection string, media_id long, index_id long").repartition(3)
    asked = spark.createDataFrame([(r, c) for c in ("gaps", "five", "two", "none") for r in range(20)], "req_id long, collection string")
    got = {}
    for req, c, index_id in rows(feedback.random_samples(asked, mapped, "s", 1.0), "req_id", "collection", "index_id"):
        got.setdefault((c, req), set()).add(index_id)
    known = {c: {r[1] for r in rows(mapped, "collection", "index_id") if r[0] == c} for c in ("gaps", "five", "two")}
    for c, many in (("gaps", 5), ("five", 5), ("two", 2)):
        assert all(len(got[c, r]) == many and got[c, r] <= known[c] for r in range(20))
    assert len({frozenset(got["gaps", r]) for r in range(20)}) > 10
    assert not any(c == "none" for c, _ in got)
    numbers = rows(numbered_items(mapped).where("collection = 'gaps'"), "number", "index_id")
    assert numbers == [(i, 10 * i) for i in range(100)]


def test_draws_read_stored_numbers(spark, small, monkeypatch):
    mapped = build_index_map(small)
    users = spark.createDataFrame([(i, c) for i in range(20) for c in "ab"], "req_id long, collection string")
    plain = rows(feedback.random_samples(users, mapped, "7", 1.0))
    numbered = with_numbers(mapped).cache()
    assert rows(numbered.drop("number"), "collection", "media_id", "index_id") == rows(mapped, "collection", "media_id", "index_id")
    monkeypatch.setattr(feedback, "with_numbers", None)  # neither sorted nor written again
    assert rows(feedback.random_samples(users, numbered, "7", 1.0)) == plain
    assert rows(feedback.random_samples(users.where("false"), mapped, "7", 1.0)) == []
