"""Facet filters: a tree of tag and range conditions, evaluated for all items at once.

Every tree of a request batch is answered by one aggregation of the taggings.
An item passes on its own tags only; an item without any tag never passes.
"""

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_explore.sizing import cut_lineage, small_side
from spark_explore.sources.collections import VALUE_COLUMNS, Tables

MASK_BITS = 60

# Taggings whose items are put together in one task; fewer are left to the shuffle's own partitions.
TAGGINGS_PER_TASK = 250_000


@dataclass(frozen=True)
class AnyOf:
    """Has at least one of the tags."""

    tag_ids: tuple[int, ...]
    negated: bool = False


@dataclass(frozen=True)
class AllOf:
    """Has every one of the tags (a repeated id counts once)."""

    tag_ids: tuple[int, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between:
    """Has a value of the facet within inclusive bounds; ``None`` leaves a side open."""

    tagset_id: int
    tagtype: str
    lower: int | float | str | None = None
    upper: int | float | str | None = None
    negated: bool = False


@dataclass(frozen=True)
class Group:
    """AND / OR of children. No children: AND is true, OR is false."""

    operator: str
    children: tuple = ()
    negated: bool = False


Tree = AnyOf | AllOf | Between | Group


def tree_from_json(text: str, tagtypes: dict[int, str]) -> Tree:
    """Read the request form of a filter (``tagtypes`` maps type id to name)."""
    return _read_node(json.loads(text)["root"], tagtypes)


def _read_node(node: dict, tagtypes: dict[int, str]) -> Tree:
    negated = bool(node.get("not_", False))
    if node["kind"] == "group":
        if node["operator"] not in ("AND", "OR"):
            raise ValueError(f"unknown group operator {node['operator']!r}")
        children = tuple(_read_node(c, tagtypes) for c in node["children"])
        return Group(node["operator"], children, negated)
    if node["kind"] != "leaf":
        raise ValueError(f"unknown node kind {node['kind']!r}")
    facet, rule = node["filter"], node["filter"]["constraint"]
    if "value_ids" in rule:
        kinds = {"OR": AnyOf, "AND": AllOf}
        if rule["operator"] not in kinds:
            raise ValueError(f"unknown value operator {rule['operator']!r}")
        return kinds[rule["operator"]](tuple(rule["value_ids"]), negated)
    return Between(facet["id"], tagtypes[facet["tagtype_id"]], rule.get("lower_bound"),
                   rule.get("upper_bound"), negated)


def tree_to_json(tree: Tree, tagtype_ids: dict[str, int]) -> str:
    return json.dumps({"root": _write_node(tree, tagtype_ids)})


def _write_node(node: Tree, ids: dict[str, int]) -> dict:
    if isinstance(node, Group):
        children = [_write_node(c, ids) for c in node.children]
        return {"kind": "group", "operator": node.operator, "children": children, "not_": node.negated}
    if isinstance(node, Between):
        rule = {"lower_bound": node.lower, "upper_bound": node.upper}
        facet = {"id": node.tagset_id, "tagtype_id": ids[node.tagtype], "constraint": rule}
    else:
        rule = {"value_ids": list(node.tag_ids), "operator": "OR" if isinstance(node, AnyOf) else "AND"}
        facet = {"id": None, "tagtype_id": None, "constraint": rule}
    return {"kind": "leaf", "filter": facet, "not_": node.negated}


def _leaves(node: Tree) -> list[Tree]:
    if isinstance(node, Group):
        return [leaf for child in node.children for leaf in _leaves(child)]
    return [node]


def _base(leaf: Tree) -> tuple:
    """Identity of a leaf without its negation, so equal conditions share columns."""
    if isinstance(leaf, Between):
        return ("range", leaf.tagset_id, leaf.tagtype, leaf.lower, leaf.upper)
    return ("any" if isinstance(leaf, AnyOf) else "all", *sorted(set(leaf.tag_ids)))


def _true_without_tags(node: Tree) -> bool:
    """Value of the tree for an item that has none of the tags it names."""
    if isinstance(node, Group):
        parts = [_true_without_tags(c) for c in node.children]
        value = all(parts) if node.operator == "AND" else any(parts)
    else:
        value = isinstance(node, AllOf) and not node.tag_ids
    return value != node.negated


def _in_range(base: tuple) -> Column:
    _, tagset_id, tagtype, lower, upper = base
    if tagtype not in VALUE_COLUMNS:
        raise ValueError(f"unknown tag type {tagtype!r}")
    column = VALUE_COLUMNS[tagtype]
    value = F.col(column)
    kind = {"value_long": "double", "value_double": "double", "value_ts": "timestamp"}.get(column, "string")

    def bound(x):
        # An integral bound stays a long: a double would blur large integers.
        exact = column == "value_long" and isinstance(x, int)
        return F.lit(x).cast("long" if exact else kind)

    hit = (F.col("tagset_id") == tagset_id) & (F.col("tagtype") == tagtype)
    if lower is not None:
        hit = hit & (value >= bound(lower))
    if upper is not None:
        hit = hit & (value <= bound(upper))
    return hit


class _Compiled:
    """Aggregates and predicates of a set of trees."""

    def __init__(self, trees: dict[str, Tree]):
        self.trees = trees
        bases = dict.fromkeys(_base(leaf) for tree in trees.values() for leaf in _leaves(tree))
        self.number = {base: i for i, base in enumerate(bases)}
        self.ranges = [b for b in bases if b[0] == "range"]
        self.tag_ids = sorted({t for b in bases if b[0] != "range" for t in b[1:]})

    def aggregates(self) -> list[Column]:
        columns = []
        for base, i in self.number.items():
            if base[0] == "range":
                columns.append(F.bool_or(F.coalesce(F.col(f"hit{i}"), F.lit(False))).alias(f"leaf{i}"))
            elif base[0] == "any":
                if len(base) > 1:
                    columns.append(F.bool_or(F.col("tag_id").isin(*base[1:])).alias(f"leaf{i}"))
            else:
                # One bit per wanted tag: distinct counting that still combines map-side.
                for m, ids in enumerate(_masks(base)):
                    bit = F.lit(0).cast("long")
                    for b, tag in enumerate(ids):
                        bit = F.when(F.col("tag_id") == tag, F.lit(1 << b).cast("long")).otherwise(bit)
                    columns.append(F.bit_or(bit).alias(f"leaf{i}_{m}"))
        return columns

    def predicate(self, node: Tree) -> Column:
        if isinstance(node, Group):
            value = F.lit(node.operator == "AND")
            for child in node.children:
                part = self.predicate(child)
                value = value & part if node.operator == "AND" else value | part
        else:
            base = _base(node)
            i = self.number[base]
            if base[0] == "range":
                value = F.col(f"leaf{i}")
            elif base[0] == "any":
                value = F.col(f"leaf{i}") if len(base) > 1 else F.lit(False)
            else:
                value = F.lit(True)
                for m, ids in enumerate(_masks(base)):
                    value = value & (F.col(f"leaf{i}_{m}") == F.lit((1 << len(ids)) - 1).cast("long"))
        return ~value if node.negated else value


def _masks(base: tuple) -> list[tuple]:
    ids = base[1:]
    return [ids[i:i + MASK_BITS] for i in range(0, len(ids), MASK_BITS)]


def passing_own(tables: Tables, trees: dict[str, Tree]) -> DataFrame:
    """``(collection, media_id, filter_ids)``: the trees each tagged media passes itself."""
    plan = _Compiled(trees)
    taggings = tables.taggings.select("collection", "media_id", "tag_id")
    rows = taggings
    if not any(_true_without_tags(tree) for tree in trees.values()):
        rows = rows.where(F.col("tag_id").isin(*plan.tag_ids) if plan.tag_ids else F.lit(False))
    if plan.ranges:
        # Range conditions are decided per tag value, before the values meet the taggings.
        hits = {f"hit{plan.number[b]}": _in_range(b) for b in plan.ranges}
        any_hit = F.lit(False)
        for hit in hits.values():
            any_hit = any_hit | hit
        values = tables.tag_values.where(any_hit).select(
            "collection", "tag_id", *[hit.alias(name) for name, hit in hits.items()]
        )
        # Only hits come out of the join. A row that is among the others as well does no harm: the flags are ORs.
        # A tag may hold a third of the taggings: broadcast, or AQE's skew split.
        found = taggings.join(small_side(values), ["collection", "tag_id"])
        rows = rows.withColumns({name: F.lit(None).cast("boolean") for name in hits}).unionByName(found)
    pieces = -(-taggings.count() // TAGGINGS_PER_TASK)
    if pieces > 1:
        # The taggings of an item lie far apart, so flags per task would be about as many as the rows and fill its memory.
        rows = rows.repartition(pieces, "collection", "media_id")
    aggregates = plan.aggregates() or [F.lit(True).alias("tagged")]
    flags = rows.groupBy("collection", "media_id").agg(*aggregates)
    passed = F.filter(
        F.array(*[F.when(plan.predicate(t), F.lit(name)) for name, t in trees.items()]),
        lambda x: x.isNotNull(),
    )
    return flags.select("collection", "media_id", passed.alias("filter_ids")).where(
        F.size("filter_ids") > 0
    )


def passing(tables: Tables, trees: dict[str, Tree]) -> DataFrame:
    """Items passing each tree after group expansion, one row per item.

    A passing group stands for all its children and leaves the result itself;
    a group here is any media without a ``group_id``.
    """
    return expand_groups(tables, passing_own(tables, trees), "filter_ids")


def expand_groups(tables: Tables, own: DataFrame, ids: str) -> DataFrame:
    """Passing groups replaced by their children; ``own`` is ``(collection, media_id)`` with a list ``ids``."""
    # Written once: the aggregation of all taggings is used, and counted, more than once below.
    known = tables.medias.select("collection", "media_id", F.col("group_id").isNull().alias("is_group"))
    own = cut_lineage(own.join(known, ["collection", "media_id"], "left"))
    is_group = F.coalesce("is_group", F.lit(False))
    items = own.where(~is_group).drop("is_group")
    passed_groups = own.where(is_group).drop("is_group").withColumnRenamed("media_id", "group_id")
    children = (
        tables.medias.where(F.col("group_id").isNotNull())
        .select("collection", "media_id", "group_id")
        .join(small_side(passed_groups), ["collection", "group_id"])
        .select("collection", "media_id", ids)
    )
    # At most two rows meet per item: its own and its group's.
    return items.unionByName(children).groupBy("collection", "media_id").agg(
        F.array_distinct(F.flatten(F.collect_list(ids))).alias(ids)
    )


def passing_tree(tables: Tables, tree: Tree) -> DataFrame:
    """``(collection, media_id)`` passing one tree after group expansion."""
    return passing(tables, {"f": tree}).select("collection", "media_id")


def faceted_search(requests: DataFrame, passed: DataFrame) -> DataFrame:
    """First ``n`` passing items per request, by ascending id.

    ``requests``: ``(req_id, collection, filter_id, n)``. Items are ranked once
    per filter, not once per request; the literal bound prunes before the shuffle.
    """
    largest = requests.agg(F.max("n")).first()[0] or 0
    by_filter = passed.select("collection", "media_id", F.explode("filter_ids").alias("filter_id"))
    order = Window.partitionBy("collection", "filter_id").orderBy("media_id")
    first = by_filter.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= largest)
    return (
        requests.select("req_id", "collection", "filter_id", "n")
        .join(first, ["collection", "filter_id"])
        .where(F.col("rank") <= F.col("n"))
        .select("req_id", "collection", "rank", "media_id")
    )


def applied_filters(filters: DataFrame, taggings: DataFrame) -> DataFrame:
    """Named facets as data: ``filters`` is ``(req_id, collection, name, tag_ids)``.

    An item passes a request when, for every name, it has one of the name's tags
    (OR inside a name, AND across names). Names of one request become bits, so
    one tagging row per item and tag is reduced map-side whatever the tag's size.
    """
    order = Window.partitionBy("req_id", "collection").orderBy("name")
    named = filters.groupBy("req_id", "collection", "name").agg(
        F.array_distinct(F.flatten(F.collect_list("tag_ids"))).alias("tag_ids")
    )
    numbered = named.withColumn("position", F.row_number().over(order) - 1)
    wanted = numbered.groupBy("req_id", "collection").agg(F.count("*").alias("names"))
    tags = numbered.select(
        "req_id", "collection", "position", F.explode("tag_ids").alias("tag_id")
    )
    matches = (
        taggings.select("collection", "media_id", "tag_id")
        .join(small_side(tags), ["collection", "tag_id"])
        .groupBy("req_id", "collection", "media_id", "position").agg(F.lit(1).alias("hit"))
    )
    return (
        matches.groupBy("req_id", "collection", "media_id").agg(F.count("*").alias("hits"))
        .join(small_side(wanted), ["req_id", "collection"])
        .where(F.col("hits") == F.col("names"))
        .select("req_id", "collection", "media_id")
    )
