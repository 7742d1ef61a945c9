import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_explore.llm import permutation_index, voronoi_join
from spark_explore.llm.sampling import hash_sample
from spark_explore.llm.vector_rows import pivots

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def table(spark, seed, n=400, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] * rng.choice([0.5, 1, 2]) + rng.normal(size=dim) * rng.choice([0.01, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(n + i, rows[20][1]) for i in range(60)]  # a vector that many rows share
    odd = [(1000, None), (1020, [0.0] * dim), (1040, [None] + [1.0] * (dim - 1)), (1060, [math.inf] * dim), (1080, [math.nan] * dim),
           (1100, [1.0]), (1120, []), (None, rows[0][1])]
    return rows, odd, spark.createDataFrame([(i, v, "x", "y") for i, v in rows + odd], SCHEMA).repartition(4)


def brute(rows, every, k, score):
    out = []
    for q, v in rows:
        if q % every == 0:
            found = sorted(((-score(v, w), i) for i, w in rows if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def integer(v, w):
    return sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w))


@pytest.mark.parametrize("seed,query_block", [(0, 2048), (1, 4)])
def test_voronoi_join_is_exact(spark, seed, query_block, monkeypatch):
    monkeypatch.setattr(voronoi_join, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(voronoi_join, "DATA_BLOCK", 100)
    rows, odd, df = table(spark, seed)
    zero = [(i, v) for i, v in odd if i == 1020]
    got = sorted(tuple(r) for r in voronoi_join.join(df, df.where("vec_id % 20 = 0"), k=5).collect())
    assert got == brute(rows + zero, 20, 5, integer)


def test_voronoi_join_repeated_ids_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in voronoi_join.join(df, df.where("vec_id = 1"), k=5).collect())
    assert [g[2] for g in got] == [0, 0, 2]
    empty = spark.createDataFrame([], SCHEMA)
    assert voronoi_join.join(empty, empty).count() == 0
    assert voronoi_join.join(df, empty).count() == 0


def test_permutation_index_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "DATA_BLOCK", 150)
    rows, _, df = table(spark, 3)
    got = permutation_index.search(df, df.where("vec_id % 20 = 0"), k=10, part=0.4, least=20).collect()
    vectors = {i: np.array(v) for i, v in rows}
    for r in got:
        assert r["score"] == pytest.approx(float(vectors[r["query_id"]] @ vectors[r["vec_id"]]), rel=1e-12)
    want = {(q, i) for q, _, i, _ in brute(rows, 20, 10, lambda v, w: float(np.dot(v, w)))}
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(got) == len(want) and len(want & found) >= 0.9 * len(want)
    for q in {r["query_id"] for r in got}:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)


def test_permutation_index_all_candidates_is_exact(spark):
    rows, _, df = table(spark, 4, n=120)
    got = sorted(tuple(r)[:3] for r in permutation_index.search(df, df.where("vec_id % 20 = 0"), k=7, part=1.0).collect())
    want = [w[:3] for w in brute(rows, 20, 7, lambda v, w: float((np.array(v) * np.array(w)).sum()))]
    assert got == want
    empty = spark.createDataFrame([], SCHEMA)
    assert permutation_index.search(empty, empty).count() == 0


def test_permutation_index_copies_take_no_place(spark):
    # A third of the rows share one vector; those asked for are the nearest to it, with the production part and floor.
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(8000, 48))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[rng.permutation(np.arange(1, 8000))[:2700]] = vectors[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    distinct = [0, *np.nonzero((vectors != vectors[0]).any(1))[0]]
    asked = [int(distinct[i]) for i in np.argsort(-(vectors[distinct] @ vectors[0]))[1:41]]
    score = vectors[asked] @ vectors.T
    score[np.arange(40), asked] = -np.inf
    want = {(q, int(i)) for q, s in zip(asked, score) for i in np.lexsort((np.arange(8000), -np.round(s, 12)))[:20]}
    got = permutation_index.search(df, df.where(f"vec_id IN ({','.join(map(str, asked))})")).collect()
    assert len(got) == len(want) and len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.95 * len(want)


def late_ids(spark, many):
    """Ids whose hashes are the largest of the first 200 ids'."""
    return [r[0] for r in spark.range(200).orderBy(F.desc(F.pmod(F.xxhash64("id"), F.lit(1 << 40)))).limit(many).collect()]


def test_few_distinct_ids_are_searched(spark):
    rng = np.random.default_rng(2)
    ids = late_ids(spark, 2)
    rows = [(ids[i % 2], rng.normal(size=4).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert hash_sample(df, 300, "vec_id").count() == 300
    assert pivots(df.withColumnRenamed("embedding", "v"), 256).shape == (256, 4)
    asked = df.limit(1)
    assert permutation_index.search(df, asked, k=5).count() == voronoi_join.join(df, asked, k=5).count() == 5


def test_a_malformed_vector_does_not_set_the_length(spark):
    rng = np.random.default_rng(3)
    early = spark.range(100).orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).first()[0]
    rows = [(i, [1.0] if i == early else rng.normal(size=4).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where(F.col("vec_id") == (early + 1) % 100)
    assert permutation_index.search(df, asked, k=5).count() == voronoi_join.join(df, asked, k=5).count() == 5


def test_permutation_index_recall_of_a_full_block(spark):
    # A quarter of the block is far above the floor, so this is the index and not brute force.
    rng = np.random.default_rng(6)
    n = permutation_index.DATA_BLOCK
    assert permutation_index.CANDIDATES * n > 4 * permutation_index.LEAST_CANDIDATES
    vectors = rng.normal(size=(n, 64)) + 2 * rng.normal(size=(40, 64))[rng.integers(40, size=n)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    got = permutation_index.search(df, df.where("vec_id % 160 = 0")).collect()
    asked = np.arange(0, n, 160)
    score = vectors[asked] @ vectors.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = {(int(q), int(i)) for q, s in zip(asked, score) for i in np.argsort(-s)[:20]}
    assert len(got) == len(want) and len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.97 * len(want)


def test_footrule_from_inverted_files():
    rng = np.random.default_rng(0)
    vectors, points = rng.normal(size=(30, 5)), rng.normal(size=(100, 5))
    order = permutation_index.permutations(vectors, points)
    files = permutation_index.InvertedFiles(order, len(points))
    m = order.shape[1]
    place = np.full((30, 100), m)
    np.put_along_axis(place, order, np.arange(m)[None], 1)
    distance = np.abs(place - place[7]).sum(1)
    assert (distance == m * (m + 1) - 2 * files.saved(order[7])).all()
