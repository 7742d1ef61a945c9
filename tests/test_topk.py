import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spark_explore.operators import ivf, topk
from spark_explore.operators.ivf import assign_cells, build_ivf, ivf_topk, probe_cells, read_ivf, write_ivf
from spark_explore.operators.mapping import build_index_map
from spark_explore.operators.skip import expand_excluded, id_pairs, skip_items
from spark_explore.plans.search import SearchIndex, vector_search
from conftest import rows

ASKED = "req_id long, collection string, query_vec array<double>, n int, filter_id string"


@pytest.fixture(scope="module")
def world(spark):
    """Random vectors with many exact copies, so that ties decide results."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 6)).astype(np.float32).astype(float)
    items = [("c" if i % 3 else "d", i, base[i % 40].tolist()) for i in range(400)]
    reqs = [(r, "c" if r % 2 else "d", rng.normal(size=6).tolist(), 1 + r % 7, None if r % 3 else f"f{r % 2}")
            for r in range(30)]
    skips = [(r, c, i) for r, c, *_ in reqs for i in range(r, 400, 5 + r)]
    passed = [(c, i, [f for f in ("f0", "f1") if (i + ord(f[1])) % 4 == 0]) for c, i, _ in items if i % 2]
    frames = (
        spark.createDataFrame(items, "collection string, index_id long, embedding array<double>").repartition(7),
        spark.createDataFrame(reqs, ASKED),
        spark.createDataFrame(skips, "req_id long, collection string, index_id long"),
        spark.createDataFrame(passed, "collection string, index_id long, filter_ids array<string>"),
    )
    hidden, allowed = set(skips), {(c, i): f for c, i, f in passed}
    expected = []
    for r, c, q, n, f in reqs:
        scored = [
            (-(round(float(np.dot(q, v)), 12) + 0.0), i) for cc, i, v in items
            if cc == c and (r, c, i) not in hidden and (f is None or f in allowed.get((c, i), []))
        ]
        expected += [(r, i, k + 1) for k, (_, i) in enumerate(sorted(scored)[:n])]
    return frames, sorted(expected)


def test_shared_scan_equals_brute_force(world):
    (items, reqs, skips, passed), expected = world
    got = topk.top_items(items, reqs, ["collection"], topk.Skips(skips), passed)
    assert rows(got, "req_id", "index_id", "rank") == expected


@pytest.mark.parametrize("probes,skips_at_once,mask_bytes,scans", [(4, 2_000_000, 64 << 20, 16), (8192, 60, 0, 16), (0, 0, 0, 2)])
def test_slices_and_ranges_equal_brute_force(world, monkeypatch, probes, skips_at_once, mask_bytes, scans):
    monkeypatch.setattr(topk, "SHARED_PROBES", probes)
    monkeypatch.setattr(topk, "SHARED_SKIPS", skips_at_once)
    monkeypatch.setattr(topk, "MASK_BYTES", mask_bytes)
    monkeypatch.setattr(topk, "SCANS", scans)
    (items, reqs, skips, passed), expected = world
    if not skips_at_once:
        reqs, expected = reqs.where("req_id < 3"), [e for e in expected if e[0] < 3]
        monkeypatch.setattr(topk, "SHARED_SKIPS", 100)
    got = topk.top_items(items, reqs, ["collection"], topk.Skips(skips), passed)
    assert rows(got, "req_id", "index_id", "rank") == expected


def test_small_score_blocks_change_nothing(world, monkeypatch):
    monkeypatch.setattr(topk, "SCORES_AT_ONCE", 40)
    (items, reqs, skips, passed), expected = world
    own = reqs.where("collection = 'c'").toArrow()
    masks = topk._masks(topk._bits(passed.where("collection = 'c'"), ["f0", "f1"]))
    ids = np.unique(own["req_id"].to_numpy())
    hidden = topk.Hidden(ids, skips.where("collection = 'c'").toArrow(), None)
    best = topk.Best(topk.Probes(own, {f: m for (_, f), m in masks.items()}, ids, hidden))
    for batch in items.where("collection = 'c'").select("index_id", "embedding").toArrow().to_batches():
        best.add(batch)
    found = best.found().to_pydict()
    got = sorted(zip(found["req_id"], found["index_id"]))
    assert got == [(r, i) for r, i, _ in expected if r % 2]


def test_runs_points_and_groups_hide_the_same(spark):
    rng = np.random.default_rng(2)
    ids = np.array([3, 5, 9])
    pairs = [(r, i) for r in (3, 9) for a in rng.integers(0, 900, 6) for i in range(a, a + int(rng.choice([1, 3, 40])))]
    pairs += pairs[:5]
    groups = [(5, 7), (9, 7), (9, 2), (9, 2)]
    hidden = topk.Hidden(
        ids, pa.table({"req_id": [p[0] for p in pairs], "index_id": [p[1] for p in pairs]}),
        pa.table({"req_id": [g[0] for g in groups], "group_id": [g[1] for g in groups]}))
    assert len(hidden.runs[0]) and len(hidden.points[0])
    items = rng.permutation(1000)
    own = rng.integers(0, 10, 1000)
    got = {(int(items[i]), int(ids[w])) for rows_, who in hidden.pairs(items, own) for i, w in zip(rows_, who)}
    assert got == {(i, r) for r, i in pairs if i < 1000} | {(int(i), r) for i, g in zip(items, own) for r, h in groups if g == h}


@pytest.mark.parametrize("bound", [0, 100])
def test_limits_do_not_shuffle_vectors(spark, world, tmp_path, monkeypatch, bound):
    (items, reqs, skips, passed), _ = world
    items.withColumn("group_id", F.col("index_id") % 5).write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    if not bound:
        monkeypatch.setattr(topk, "MASK_BYTES", 0)
        monkeypatch.setattr(topk, "SHARED_SKIPS", 200)
    groups = spark.createDataFrame([(r, c, r % 5) for r in range(30) for c in "cd"], "req_id long, collection string, group_id long")
    got = topk.top_items(stored, reqs, ["collection"], topk.Skips(skips, groups), passed)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    for at, line in enumerate(plan):
        if "Scan parquet" in line and "embedding" in line:
            depth = re.search(r"[A-Za-z*]", line).start()
            for above in reversed(plan[:at]):
                own = re.search(r"[A-Za-z*]", above).start()
                if own < depth:
                    depth = own
                    if "MapInArrow" in above:
                        break
                    assert "Exchange" not in above and "SortMergeJoin" not in above, above
            else:
                raise AssertionError("no scoring above a scan of vectors")
    allowed = {(r["req_id"], r["index_id"]) for r in got.collect()}
    assert allowed and not any(i % 5 == r % 5 for r, i in allowed)
    with pytest.raises(ValueError):
        topk.top_items(items, reqs, ["collection"], topk.Skips(skips, groups), passed)


def test_more_groups_than_are_shared(spark, world, monkeypatch):
    (items, reqs, skips, passed), _ = world
    grouped = items.withColumn("group_id", F.col("index_id") % 5)
    groups = spark.createDataFrame([(r, c, r % 5) for r in range(30) for c in "cd"], "req_id long, collection string, group_id long")
    want = rows(topk.top_items(grouped, reqs, ["collection"], topk.Skips(skips, groups), passed))
    monkeypatch.setattr(topk, "SHARED_SKIPS", 50)  # members of hidden groups, one by one, in ranges
    monkeypatch.setattr(topk, "SCANS", 400)
    assert rows(topk.top_items(grouped, reqs, ["collection"], topk.Skips(skips, groups), passed)) == want


def test_order_of_ties_and_short_candidates(spark):
    items = spark.createDataFrame([("c", i, [1.0]) for i in (5, 3, 9)], "collection string, index_id long, embedding array<float>")
    reqs = spark.createDataFrame([(1, "c", [2.0], 10, None), (2, "none", [1.0], 3, None), (3, "c", None, 3, None)], ASKED)
    got = topk.top_items(items, reqs, ["collection"])
    assert rows(got, "req_id", "rank", "index_id", "score") == [(1, 1, 3, 2.0), (1, 2, 5, 2.0), (1, 3, 9, 2.0)]


def test_filter_without_passing_items_is_an_error(spark, world):
    (items, reqs, _, _), _ = world
    with pytest.raises(ValueError):
        topk.top_items(items, reqs, ["collection"])


def test_no_requests(world):
    (items, reqs, skips, passed), _ = world
    assert topk.top_items(items, reqs.where("false"), ["collection"]).count() == 0


def test_result_does_not_depend_on_partitioning(world):
    (items, reqs, skips, passed), expected = world
    got = topk.top_items(items.coalesce(1), reqs, ["collection"], topk.Skips(skips), passed)
    assert rows(got, "req_id", "index_id", "rank") == expected


def test_plan_scores_without_shuffling_or_pairing_items(world):
    (items, reqs, _, passed), _ = world
    got = topk.top_items(items, reqs, ["collection"], passed=passed)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan
    # Filters are bitmaps in the tasks: the one join left numbers the collections.
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan


def test_seen_and_excluded_groups(spark, small):
    index = SearchIndex(small.embeddings, build_index_map(small), small.medias)
    reqs = spark.createDataFrame(
        [(1, "a", [1.0, 0.0], 3, [17, 16], [10]), (2, "b", [1.0, 0.0], 3, [], []), (3, "a", [1.0, 0.0], 9, [], [3, 11])],
        "req_id long, collection string, query_vec array<double>, n int, seen array<long>, excluded array<long>",
    )
    seen, excluded = id_pairs(reqs, "seen"), id_pairs(reqs, "excluded")
    got = vector_search(reqs, index, seen=seen, excluded=excluded)
    # Request 1: 10's group holds the even items, 17 was seen. Request 3: group 2 is gone.
    assert rows(got, "req_id", "rank", "media_id") == [
        (1, 1, 15), (1, 2, 13), (1, 3, 11), (2, 1, 17), (2, 2, 16), (2, 3, 15),
        (3, 1, 16), (3, 2, 14), (3, 3, 12), (3, 4, 10),
    ]
    # An id without a group stands only for itself.
    assert rows(expand_excluded(excluded, small.medias), "req_id", "media_id") == [
        (1, 10), (1, 12), (1, 14), (1, 16), (3, 3), (3, 11), (3, 13), (3, 15), (3, 17)]
    assert skip_items(index.index_map, small.medias) is None


@pytest.fixture(scope="module")
def cells(world):
    return [df.cache() for df in build_ivf(world[0][0], cells=6)]


def test_ivf_over_all_cells_is_exact(world, cells, tmp_path):
    (items, reqs, skips, passed), expected = world
    centroids, assigned = cells
    skips = topk.Skips(skips)
    got = ivf_topk(reqs, centroids, assigned, 6, skips, passed)
    assert rows(got, "req_id", "index_id", "rank") == expected
    one = ivf_topk(reqs, centroids, assigned, 1, skips, passed)
    some = ivf_topk(reqs, centroids, assigned, 3, skips, passed)
    right = [len(set(rows(x, "req_id", "index_id")) & {e[:2] for e in expected}) for x in (one, some)]
    assert right[0] <= right[1] <= len(expected)
    spark = items.sparkSession
    write_ivf(centroids, assigned, str(tmp_path / "ivf"))
    centroids, assigned = read_ivf(spark, str(tmp_path / "ivf"))
    assert rows(ivf_topk(reqs, centroids, assigned, 6, skips, passed), "req_id", "index_id", "rank") == expected


def test_ivf_in_slices(world, cells, monkeypatch):
    (items, reqs, skips, passed), expected = world
    centroids, assigned = cells
    monkeypatch.setattr(topk, "SHARED_PROBES", 6)
    monkeypatch.setattr(topk, "SCANS", 3)
    got = ivf_topk(reqs, centroids, assigned, 6, topk.Skips(skips), passed)
    assert rows(got, "req_id", "index_id", "rank") == expected


def test_adaptive_probing_fills_up_and_ends(spark, world, cells):
    (items, reqs, skips, passed), expected = world
    centroids, assigned = cells
    got = ivf_topk(reqs, centroids, assigned, 1, topk.Skips(skips), passed, adaptive=True)
    want = {}
    for r, _, _ in expected:
        want[r] = want.get(r, 0) + 1
    have = {r["req_id"]: r["count"] for r in got.groupBy("req_id").count().collect()}
    assert have == want
    assert got.groupBy("req_id", "index_id").count().where("count > 1").count() == 0
    # More wanted than there is: every item of the collection comes back, and the search ends.
    greedy = reqs.select("req_id", "collection", "query_vec", F.lit(1000).alias("n"),
                         F.lit(None).cast("string").alias("filter_id"))
    assert ivf_topk(greedy, centroids, assigned, 1, adaptive=True).count() == 15 * 400


def test_adaptive_rounds_visit_no_cell_twice(world, cells, monkeypatch):
    """Every round reads only new cells, and all rounds together find what one search of the visited cells finds."""
    (items, reqs, skips, passed), _ = world
    centroids, assigned = cells
    skips, asked, masks = topk.Skips(skips), [], []

    def noted(table, probes, part, *rest):
        if "cell" in part:
            asked.append(rows(probes, "req_id", "cell"))
            masks.append(rest[1])
        return topk.top_items(table, probes, part, *rest)

    monkeypatch.setattr(ivf, "top_items", noted)
    got = rows(ivf_topk(reqs, centroids, assigned, 1, skips, passed, adaptive=True), "req_id", "index_id", "rank")
    every = [pair for round_ in asked for pair in round_]
    assert len(asked) > 1 and len(every) == len(set(every)) and len({id(m) for m in masks}) == 1
    probed = {r: sum(1 for q, _ in every if q == r) for r, _ in every}
    for nprobe in set(probed.values()):
        once = rows(ivf_topk(reqs, centroids, assigned, nprobe, skips, passed), "req_id", "index_id", "rank")
        assert [x for x in got if probed[x[0]] == nprobe] == [x for x in once if probed[x[0]] == nprobe]


def test_cells_tie_to_the_lower_number(spark):
    items = spark.createDataFrame([("c", 1, [1.0, 0.0])], "collection string, index_id long, embedding array<float>")
    centroids = spark.createDataFrame([(4, [1.0, 0.0]), (2, [1.0, 5.0]), (3, [0.0, 1.0])], "cell long, centroid array<double>")
    assert rows(assign_cells(items, centroids), "cell") == [(2,)]
    reqs = spark.createDataFrame([(7, "c", [1.0, 0.0], 1, None)], ASKED)
    assert rows(probe_cells(reqs, centroids, 2), "cell", "rank") == [(2, 1), (4, 2)]


def test_close_scores_are_told_apart(spark):
    items = spark.createDataFrame([("c", i, [1.0 + 1e-8 * i, 0.0]) for i in range(50)], "collection string, index_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, "c", [1.0, 0.0], 3, None), (2, "c", [1.0, 0.0], 0, None), (3, "c", [1.0, 0.0], None, None)],
                                  "req_id long, collection string, query_vec array<double>, n int, filter_id string")
    assert rows(topk.top_items(items, asked, ["collection"]), "req_id", "rank", "index_id") == [(1, 1, 49), (1, 2, 48), (1, 3, 47)]


@pytest.mark.parametrize("mask_bytes", [0, 64 << 20])
def test_filters_as_bitmaps_or_joins(spark, monkeypatch, mask_bytes):
    monkeypatch.setattr(topk, "MASK_BYTES", mask_bytes)
    ids = [0, 1, 5, 32_767, 32_768, 32_769, 70_000, 10**9]
    items = spark.createDataFrame([(c, i, [float(k), 1.0]) for c in "cd" for k, i in enumerate(ids)],
                                  "collection string, index_id long, embedding array<double>")
    passed = spark.createDataFrame(
        [("c", i, ["odd"] if k % 2 else ["even", "all"]) for k, i in enumerate(ids)] + [("d", 5, ["odd"])],
        "collection string, index_id long, filter_ids array<string>")
    asked = [(1, "c", "odd"), (2, "c", "even"), (3, "d", "odd"), (4, "d", "even"), (5, "c", None), (6, "c", "none")]
    for some in (asked, asked[:4]):
        requests = spark.createDataFrame([(r, c, [1.0, 0.0], 3, f) for r, c, f in some],
                                         "req_id long, collection string, query_vec array<double>, n int, filter_id string")
        found = topk.top_items(items, requests, ["collection"], passed=passed)
        got = rows(found, "req_id", "rank", "index_id")
        want = {1: [10**9, 32_769, 32_767], 2: [70_000, 32_768, 5], 3: [5], 5: [10**9, 70_000, 32_769]}
        assert got == sorted((r, k + 1, i) for r, c, f in some for k, i in enumerate(want.get(r, [])))
        plan = found._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("MapInArrow"):]
        assert "Join" not in below.replace("BroadcastHashJoin", "")


def test_probing_does_not_assign_cells_again(spark):
    """The registered index searches read cells that were written; each task has one Python worker, for the scores."""
    from __spark_entry__ import queries

    for name in ("ivf_topk", "ivf_kmeans"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan
