import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from spark_explore.operators import filters, programs
from spark_explore.operators.filters import AllOf, AnyOf, Between, Group
from test_filters import evaluated, random_tree

TYPE_IDS = {"categorical": 1, "numerical_int": 2, "numerical_double": 3, "timestamp": 4}
ASKED = "collection string, filter_id string, tree string"


def asked(spark, trees, collections="ab"):
    return spark.createDataFrame(
        [(c, name, filters.tree_to_json(tree, TYPE_IDS)) for c in collections for name, tree in trees.items()], ASKED)


def answers(spark, small, trees):
    return rows(programs.passing_filters(small, asked(spark, trees)), "filter_id", "collection", "media_id")


def test_postfix_of_a_tree():
    tree = Group("AND", (AllOf((5, 4, 5)), AnyOf((), True), Between(1, "2", 0, None)), True)
    code, atoms = programs.postfix(tree)
    assert code == [0, 1, programs.AND, programs.FALSE, programs.NOT, programs.AND, 2, programs.AND, programs.NOT]
    assert atoms[0][0] == (4,) and atoms[2] == (None, 1, "2", 0, None, None, None)


@pytest.mark.parametrize("trees_a_slice,cells", [(16_384, 1 << 25), (7, 40)])
def test_random_trees_equal_the_compiled_plan(spark, small, monkeypatch, trees_a_slice, cells):
    monkeypatch.setattr(programs, "SLICE_TREES", trees_a_slice)
    monkeypatch.setattr(programs, "CELLS", cells)
    rng = random.Random(5)
    trees = {f"t{i}": random_tree(rng) for i in range(30)}
    assert answers(spark, small, trees) == evaluated(small, trees)


def test_bounds_of_every_type(spark, small):
    trees = {
        "day": Between(4, "timestamp", "2024-01-02", "2024-01-03 00:00:00"), "word": Between(2, "categorical", "kind_1", "kind_1"),
        "float_on_int": Between(1, "numerical_int", 1.5, 3.0), "int_on_float": Between(3, "numerical_double", 1, 2),
        "text_on_int": Between(1, "numerical_int", "2", None), "open": Between(3, "numerical_double"),
        "all": AllOf((200, 201)), "none": Group("OR"), "every": Group("AND"), "group": AnyOf((900,)),
    }
    assert answers(spark, small, trees) == evaluated(small, trees)
    assert answers(spark, small, {"no_number": Between(1, "numerical_int", "many", None)}) == []


def test_missing_values_and_not_a_number(spark, small):
    tagged = spark.createDataFrame([("a", 10, 1), ("a", 11, 2), ("a", 12, 3), ("a", 13, None), ("a", None, 1), ("a", 14, 4)], small.taggings.schema)
    values = spark.createDataFrame(
        [("a", t, 3, "numerical_double", None, None, v, None) for t, v in ((1, float("nan")), (2, None), (3, 0.5))], small.tag_values.schema)
    tables = filters.Tables(**{**vars(small), "taggings": tagged, "tag_values": values})
    trees = {"low": Between(3, "numerical_double", 0.0, None), "high": Between(3, "numerical_double", None, 1.0),
             "not": Between(3, "numerical_double", None, 1.0, negated=True)}
    got = rows(programs.passing_filters(tables, asked(spark, trees, "a")), "filter_id", "media_id")
    assert got == [("high", 12), ("low", 10), ("low", 12)] + [("not", m) for m in (10, 11, 13, 14)]


def test_bad_trees_are_reported_and_others_answered(spark, small):
    good = filters.tree_to_json(AnyOf((201,)), TYPE_IDS)
    unknown = json.dumps({"root": {"kind": "leaf", "filter": {"id": 1, "tagtype_id": 9, "constraint": {}}}})
    asked = spark.createDataFrame(
        [("a", "1", good), ("a", "2", "{"), ("a", "3", None), ("a", "4", unknown), ("a", "5", '{"root": []}'), ("a", "6", good),
         ("a", "7", '{"root": {"kind": "leaf", "filter": {"id": 1, "tagtype_id": 1, "constraint": {"operator": "OR", "value_ids": ["x"]}}}}'),
         ("elsewhere", "8", good)], ASKED)
    passed, names = programs.passing_programs(small, asked)
    got = {r["filter_id"]: r for r in names.collect()}
    assert [k for k in sorted(got) if got[k]["error"] is None] == ["1", "6", "8"]
    assert got["1"]["tree_id"] == got["6"]["tree_id"] != got["8"]["tree_id"]
    assert rows(passed, "collection", "media_id") == [("a", m) for m in (10, 11, 13, 14, 17)]


def test_no_filters_and_no_taggings(spark, small):
    none = spark.createDataFrame([], ASKED)
    assert programs.passing_filters(small, none).count() == 0
    empty = filters.Tables(**{**vars(small), "taggings": small.taggings.limit(0)})
    assert programs.passing_filters(empty, asked(spark, {"x": Group("AND")})).count() == 0


def test_ten_thousand_trees_have_the_plan_of_one(spark, small):
    def tree(i):
        return Group("AND", (Between(1, "numerical_int", i % 8, i), AnyOf((100 + i, 200, 201), i % 2 == 1)))

    one, _ = programs.passing_programs(small, asked(spark, {"one": tree(0)}, "a"))
    many, names = programs.passing_programs(small, asked(spark, {f"t{i}": tree(i) for i in range(10_000)}, "a"))
    size = [len(p._jdf.queryExecution().optimizedPlan().toString().splitlines()) for p in (one, many)]
    assert size[0] == size[1] and names.where("error IS NULL").count() == 10_000
    got = {r["media_id"]: r["n"] for r in many.select("media_id", F.size("tree_ids").alias("n")).collect()}
    sample = {f"t{i}": tree(i) for i in range(0, 10_000, 250)}
    assert sum(got.values()) > 10_000 and answers(spark, small, sample) == evaluated(small, sample)
