import random

import pytest
from pyspark.sql import functions as F

from spark_explore.operators import filters
from spark_explore.operators.filters import AllOf, AnyOf, Between, Group
from conftest import rows


def passes(tree, tags, values):
    """Plain evaluation of a tree for one media's tag ids."""
    if isinstance(tree, Group):
        parts = [passes(c, tags, values) for c in tree.children]
        result = all(parts) if tree.operator == "AND" else any(parts)
    elif isinstance(tree, AnyOf):
        result = bool(tags & set(tree.tag_ids))
    elif isinstance(tree, AllOf):
        result = set(tree.tag_ids) <= tags
    else:
        result = any(
            facet == tree.tagset_id and kind == tree.tagtype
            and (tree.lower is None or value >= tree.lower) and (tree.upper is None or value <= tree.upper)
            for facet, kind, value in (values[t] for t in tags)
        )
    return result != tree.negated


def random_tree(rng, depth=0):
    kind = rng.random()
    negated = rng.random() < 0.4
    if depth < 3 and kind < 0.45:
        children = tuple(random_tree(rng, depth + 1) for _ in range(rng.randint(0, 3)))
        return Group(rng.choice(["AND", "OR"]), children, negated)
    tags = tuple(rng.choice([100, 101, 104, 200, 201, 202, 303, 503, 900, 999]) for _ in range(rng.randint(0, 3)))
    if kind < 0.65:
        return AnyOf(tags, negated)
    if kind < 0.8:
        return AllOf(tags, negated)
    lower, upper = rng.choice([None, 0, 2, 3]), rng.choice([None, 1, 3, 6])
    facet, tagtype = rng.choice([(1, "numerical_int"), (3, "numerical_double"), (3, "numerical_int")])
    return Between(facet, tagtype, lower, upper, negated)


@pytest.fixture(scope="module")
def plain(small):
    medias = {(r.collection, r.media_id): r.group_id for r in small.medias.collect()}
    values = {}
    for r in small.tag_values.collect():
        value = next((v for v in (r.value_str, r.value_long, r.value_double, r.value_ts) if v is not None), None)
        values[r.collection, r.tag_id] = (r.tagset_id, r.tagtype, value)
    tags = {}
    for r in small.taggings.collect():
        tags.setdefault((r.collection, r.media_id), set()).add(r.tag_id)
    return medias, values, tags


def expected(plain, trees):
    medias, values, tags = plain
    result = set()
    for name, tree in trees.items():
        own = {
            m for m, mine in tags.items()
            if passes(tree, mine, {t: v for (c, t), v in values.items() if c == m[0]})
        }
        groups = {m for m in own if m in medias and medias[m] is None}
        children = {m for m, g in medias.items() if (m[0], g) in groups}
        result |= {(name, *m) for m in (own - groups) | children}
    return sorted(result)


def evaluated(small, trees):
    passed = filters.passing(small, trees)
    return rows(passed.select(F.explode("filter_ids").alias("f"), "collection", "media_id"))


def test_random_trees_match_plain_evaluation(small, plain):
    rng = random.Random(11)
    trees = {f"t{i}": random_tree(rng) for i in range(60)}
    assert evaluated(small, trees) == expected(plain, trees)


def test_trees_that_need_a_tag_are_pruned_at_the_scan(small, plain):
    trees = {"x": Group("AND", (AnyOf((201,)), AnyOf((200,), negated=True)))}
    assert evaluated(small, trees) == expected(plain, trees)
    plan = filters.passing_own(small, trees)._jdf.queryExecution().optimizedPlan().toString()
    assert "tag_id#" in plan and " IN (200,201)" in plan
    # A tree that passes without any tag must see every tagging.
    everything = filters.passing_own(small, {"x": AnyOf((200,), negated=True)})
    plan = everything._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.split("Aggregate", 1)[1]


def test_de_morgan(small):
    a, b = AnyOf((200, 202)), Between(1, "numerical_int", 2, 5)
    trees = {
        "left": Group("AND", (a, b), negated=True),
        "right": Group("OR", (AnyOf(a.tag_ids, True), Between(1, "numerical_int", 2, 5, True))),
    }
    found = evaluated(small, trees)
    assert [r[1:] for r in found if r[0] == "left"] == [r[1:] for r in found if r[0] == "right"]


def test_untagged_media_never_pass_and_childless_groups_vanish(small):
    ids = [r[2] for r in evaluated(small, {"all": Group("AND")}) if r[1] == "a"]
    assert 2 not in ids and 3 not in ids and sorted(ids) == list(range(10, 18))


def test_not_on_a_group_tag_lets_children_of_the_other_group_stay_out(small):
    # Group 1 carries the tag: its children come in through the group. Group 2 has no tag at all.
    found = evaluated(small, {"g": AnyOf((900,))})
    assert [r[2] for r in found if r[1] == "b"] == [10, 12, 14, 16]


def test_string_and_timestamp_bounds(small):
    found = evaluated(small, {"d": Between(4, "timestamp", "2024-01-02", "2024-01-03 00:00:00")})
    assert found == [("d", "a", 11), ("d", "a", 12)]
    found = evaluated(small, {"s": Between(2, "categorical", "kind_1", "kind_1")})
    assert [r[2] for r in found if r[1] == "a"] == [10, 11, 13, 14, 17]


def test_repeated_ids_in_all(small):
    once = evaluated(small, {"x": AllOf((200, 201))})
    assert once == evaluated(small, {"x": AllOf((200, 201, 201))}) and len(once) == 4


def test_more_ids_than_one_mask_holds(spark, small):
    ids = tuple(range(1000, 1130))
    taggings = spark.createDataFrame(
        [("a", 10, t) for t in ids] + [("a", 11, t) for t in ids[1:]], "collection string, media_id long, tag_id long")
    tables = filters.Tables(**{**vars(small), "taggings": taggings})
    assert rows(filters.passing_own(tables, {"x": AllOf(ids)}), "media_id") == [(10,)]


def test_json_round_trip():
    names = {1: "categorical", 2: "numerical_int"}
    tree = Group("OR", (
        Group("AND", (AnyOf((1, 2)), AllOf((3,), True)), True), Between(4, "numerical_int", 5, 9),
    ))
    text = filters.tree_to_json(tree, {v: k for k, v in names.items()})
    assert filters.tree_from_json(text, names) == tree
    for bad in ('{"root": {"kind": "twig"}}', '{"root": {"kind": "group", "operator": "XOR", "children": []}}',
                '{"root": {"kind": "leaf", "filter": {"id": 1, "tagtype_id": 1, "constraint": {"value_ids": [], "operator": "MAX"}}}}'):
        with pytest.raises(ValueError):
            filters.tree_from_json(bad, names)
    with pytest.raises(ValueError):
        filters._in_range(("range", 1, "colour", 1, 2))


def test_faceted_search_ranks_by_id(spark, small):
    passed = filters.passing(small, {"x": AnyOf((200, 201)), "none": AnyOf(())})
    reqs = spark.createDataFrame([(1, "a", "x", 2), (2, "b", "x", 3), (3, "a", "none", 5)],
                                 "req_id long, collection string, filter_id string, n int")
    got = filters.faceted_search(reqs, passed)
    assert rows(got, "req_id", "rank", "media_id") == [(1, 1, 10), (1, 2, 11), (2, 1, 10), (2, 2, 11), (2, 3, 13)]


def test_applied_filters_or_inside_and_across(spark, small):
    asked = spark.createDataFrame(
        [(1, "a", "kind", [200, 201]), (1, "a", "twin", [500]), (2, "b", "kind", [202]), (2, "b", "kind", [200])],
        "req_id long, collection string, name string, tag_ids array<long>")
    got = filters.applied_filters(asked, small.taggings)
    # In b the kinds 0 and 2 belong to all tagged items but 11 and 14; item 15 has no kind.
    assert rows(got, "req_id", "media_id") == [(1, 10), (2, 10), (2, 12), (2, 13), (2, 16)]


def test_items_of_many_taggings_are_put_together_in_pieces(spark, small, monkeypatch):
    """The number of tasks follows from the taggings, not from the shuffle's settings; only hits leave the join with the values."""
    trees = {
        "both": Group("OR", (AnyOf((201,)), Between(1, "numerical_int", 2, 4))),
        "not": Group("AND", (AllOf((200, 203), negated=True), Between(3, "numerical_double", 1.0, None, negated=True))),
        "range": Between(1, "numerical_int", 6, None),
    }

    def found():
        return {(r["collection"], r["media_id"], f) for r in filters.passing_own(small, trees).collect() for f in r["filter_ids"]}

    want = found()
    assert {f for *_, f in want} == set(trees)
    monkeypatch.setattr(filters, "TAGGINGS_PER_TASK", 3)
    assert found() == want
    pieces = -(-small.taggings.count() // 3)
    own = filters.passing_own(small, trees)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert f"{pieces}), REPARTITION_BY_NUM" in plan and "LeftOuter" not in plan
