"""Filters as data: a table of JSON trees, compiled to postfix programs and evaluated in tasks.

The plan does not depend on the number of trees. Every distinct tree of a collection becomes a program over *atoms*:
"has one of these tags" or "has a value of this facet within these bounds" (ALL is an AND of one-tag atoms). Tasks mark
the atoms that their taggings fulfil, one row per item and batch; the rows of an item meet by item and are joined by OR
one after the other; then all programs run over the atoms of a block of items at once.

Programs are shared with the tasks in slices of ``SLICE_TREES`` trees and ``SLICE_BYTES`` of their text (on average);
every slice is a pass of its own.

Trees that cannot be read have an ``error`` and pass no item. As in ``filters``: items without any tag never pass, and a
passing group stands for its children.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.operators.filters import AllOf, AnyOf, Between, expand_groups, tree_from_json
from spark_explore.sizing import cut_lineage, small_side
from spark_explore.sources.collections import VALUE_COLUMNS, Tables

SLICE_TREES, SLICE_BYTES = 16_384, 16 << 20
CELLS = 1 << 25  # of a matrix of items and atoms, or items and programs
NOT, AND, OR, TRUE, FALSE = -1, -2, -3, -4, -5
NO_TAG = -2**63  # of a tagging without a tag: the item counts as tagged

LEAF = ("tags array<long>, tagset_id int, tagtype_id int, lower_long long, lower_text string, "
        "upper_long long, upper_text string")
COMPILED = f"collection string, tree string, program array<int>, leaves array<struct<{LEAF}>>, error string"


class _Same(dict):
    """Type ids stand for themselves until the types of the collection are joined."""

    def __missing__(self, key):
        return key


def _bound(x) -> tuple[int | None, str | None]:
    if isinstance(x, int) and not isinstance(x, bool):
        return (x, None) if -2**63 <= x < 2**63 else (None, str(x))
    return None, None if x is None else str(x)


def postfix(tree) -> tuple[list[int], list[tuple]]:
    """A tree as postfix code over the numbers of its own atoms, and the atoms; works off a stack, so depth is no limit."""
    code, atoms, todo = [], {}, [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, int):
            code.append(node)
            continue
        if isinstance(node, Between):
            keys, none, joined = [(None, node.tagset_id, node.tagtype, *_bound(node.lower), *_bound(node.upper))], FALSE, OR
        elif isinstance(node, AnyOf):
            tags = tuple(sorted(set(node.tag_ids)))
            keys, none, joined = [(tags, *[None] * 6)] if tags else [], FALSE, OR
        elif isinstance(node, AllOf):
            keys, none, joined = [((t,), *[None] * 6) for t in sorted(set(node.tag_ids))], TRUE, AND
        else:
            keys, none, joined = None, TRUE if node.operator == "AND" else FALSE, AND if node.operator == "AND" else OR
        parts = list(node.children) if keys is None else [atoms.setdefault(k, len(atoms)) for k in keys]
        steps = [none] if not parts else [parts[0]] + [x for part in parts[1:] for x in (part, joined)]
        todo.extend(reversed(steps + [NOT] * node.negated))
    return code, list(atoms)


def compile_trees(trees: DataFrame) -> DataFrame:
    """``collection, tree`` with ``program``, ``leaves`` and ``error``, read in the tasks."""
    def read(batches):
        for batch in batches:
            rows = []
            for collection, text in zip(*(batch.column(c).to_pylist() for c in ("collection", "tree"))):
                row = {"collection": collection, "tree": text, "program": None, "leaves": None, "error": None}
                try:
                    code, atoms = postfix(tree_from_json(text or "", _Same()))
                    names = [f.split()[0] for f in LEAF.split(", ")]
                    leaves = [dict(zip(names, a)) for a in atoms]
                    pa.array(leaves, leaf)
                    row |= {"program": code, "leaves": leaves}
                except (ValueError, KeyError, TypeError, AttributeError, RecursionError, OverflowError, pa.ArrowException) as error:
                    row["error"] = f"{type(error).__name__}: {error}"[:200]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    leaf = pa.struct([("tags", pa.list_(pa.int64())), ("tagset_id", pa.int32()), ("tagtype_id", pa.int32()),
                      ("lower_long", pa.int64()), ("lower_text", pa.string()), ("upper_long", pa.int64()), ("upper_text", pa.string())])
    schema = pa.schema([("collection", pa.string()), ("tree", pa.string()), ("program", pa.list_(pa.int32())),
                        ("leaves", pa.list_(leaf)), ("error", pa.string())])
    return trees.select("collection", "tree").mapInArrow(read, COMPILED)


def _typed(x, side: str):
    """A bound in the form of every type; what cannot be cast is null, and then no value is within it."""
    long, text = x[f"{side}_long"], x[f"{side}_text"]
    return F.struct(
        (long.isNotNull() | text.isNotNull()).alias("given"), long.alias("long"),
        F.coalesce(long.cast("double"), text.try_cast("double")).alias("double"),
        F.coalesce(text, long.cast("string")).alias("text"),
        F.coalesce(long * 1_000_000, F.unix_micros(text.try_cast("timestamp"))).alias("micros"))


def compiled_filters(filters: DataFrame, tables: Tables) -> DataFrame:
    """Every distinct tree of ``(collection, filter_id, tree)`` once: collection, tree, tree_id, program, leaves, error."""
    types = tables.tag_types.groupBy("collection").agg(
        F.map_from_entries(F.collect_set(F.struct("tagtype_id", "tagtype"))).alias("types"))
    trees = filters.select("collection", F.coalesce("tree", F.lit("")).alias("tree")).distinct()
    read = compile_trees(trees).join(types, "collection", "left")
    leaves = F.transform("leaves", lambda x: F.struct(
        x["tags"].alias("tags"), x["tagset_id"].alias("tagset_id"), F.try_element_at("types", x["tagtype_id"]).alias("tagtype"),
        _typed(x, "lower").alias("lower"), _typed(x, "upper").alias("upper")))
    unknown = F.exists("leaves", lambda x: x["tags"].isNull() & ~F.coalesce(x["tagtype"].isin(*VALUE_COLUMNS), F.lit(False)))
    read = read.withColumn("leaves", leaves).withColumn(
        "error", F.coalesce("error", F.when(unknown, F.lit("ValueError: unknown tag type")))).drop("types")
    return cut_lineage(read.withColumn("tree_id", F.monotonically_increasing_id()))


@dataclass
class _Programs:
    """The programs of a slice for one collection, as tasks use them."""

    atoms: int
    tags: np.ndarray  # sorted, with the atoms that they fulfil
    tag_atoms: np.ndarray
    ranges: dict  # (tagset_id, tagtype): [(atom, lower, upper)]
    tree_ids: np.ndarray
    codes: list

    def run(self, has: np.ndarray) -> np.ndarray:
        """programs x items, from atoms x items."""
        out = np.zeros((len(self.codes), has.shape[1]), bool)
        for i, code in enumerate(self.codes):
            stack = []
            for step in code:
                if step >= 0:
                    stack.append(has[step])
                elif step == NOT:
                    stack[-1] = ~stack[-1]
                elif step in (TRUE, FALSE):
                    stack.append(np.full(has.shape[1], step == TRUE))
                else:
                    last = stack.pop()
                    stack[-1] = stack[-1] & last if step == AND else stack[-1] | last
            out[i] = stack[-1]
        return out


def _shared(rows: list[dict]) -> dict[str, _Programs]:
    out = {}
    for collection in {r["collection"] for r in rows}:
        atoms, codes, ids = {}, [], []
        for row in rows:
            if row["collection"] != collection:
                continue
            own = [atoms.setdefault(
                ("tags", *x["tags"]) if x["tags"] is not None
                else ("range", x["tagset_id"], x["tagtype"], *x["lower"].values(), *x["upper"].values()), len(atoms)) for x in row["leaves"]]
            codes.append([own[s] if s >= 0 else s for s in row["program"]])
            ids.append(row["tree_id"])
        pairs = sorted((t, i) for key, i in atoms.items() if key[0] == "tags" for t in key[1:])
        ranges = {}
        for key, i in atoms.items():
            if key[0] == "range":
                ranges.setdefault(key[1:3], []).append((i, key[3:8], key[8:13]))
        tags, tag_atoms = (np.array([p[j] for p in pairs], np.int64) for j in (0, 1))
        out[collection] = _Programs(len(atoms), tags, tag_atoms, ranges, np.array(ids, np.int64), codes)
    return out


def _within(tagtype: str, values: np.ndarray, ranges: list) -> np.ndarray:
    """ranges x values: which values lie within which bounds."""
    out = np.ones((len(ranges), len(values)), bool)
    for i, (_, *sides) in enumerate(ranges):
        for up, (given, long, double, text, micros) in enumerate(sides):
            if not given:
                continue
            own = values
            if tagtype == "categorical":
                limit = text
            elif tagtype == "timestamp":
                limit = micros
            elif tagtype == "numerical_int" and long is not None:
                limit = long
            else:
                limit, own = double, values.astype(np.float64)
            if limit is None:
                out[i] = False
            elif isinstance(limit, float):  # not-a-number is the largest value
                out[i] &= (own <= limit) | np.isnan(limit) if up else ((own >= limit) | np.isnan(own))
            else:
                out[i] &= own <= limit if up else own >= limit
    return out


def _hits(own: _Programs, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch and the atoms they fulfil."""
    tag = batch.column("tag_id").to_numpy()
    low, high = (np.searchsorted(own.tags, tag, side) for side in ("left", "right"))
    many = high - low
    rows = [np.repeat(np.arange(len(tag)), many)]
    ahead = np.cumsum(many) - many
    atoms = [own.tag_atoms[np.arange(many.sum()) - np.repeat(ahead, many) + np.repeat(low, many)]]
    for (tagset, tagtype), ranges in own.ranges.items():
        column = batch.column(VALUE_COLUMNS[tagtype])
        mine = (batch.column("tagset_id").to_numpy(zero_copy_only=False) == tagset) & column.is_valid().to_numpy(zero_copy_only=False)
        mine &= batch.column("tagtype").to_numpy(zero_copy_only=False) == tagtype
        places = np.nonzero(mine)[0]
        if not len(places):
            continue
        values = column.take(pa.array(places)).to_numpy(zero_copy_only=False)
        numbers = np.array([r[0] for r in ranges], np.int64)
        step = max(1, CELLS // len(values))
        for i in range(0, len(ranges), step):
            which, value = np.nonzero(_within(tagtype, values, ranges[i:i + step]))
            rows.append(places[value])
            atoms.append(numbers[i + which])
    return np.concatenate(rows), np.concatenate(atoms)


def _marked(rows: DataFrame, shared) -> DataFrame:
    """A row per item and batch: the atoms that its taggings fulfil, as numbers or, where shorter, as bits."""
    def mark(batches):
        for batch in batches:
            names = batch.column("collection").to_numpy(zero_copy_only=False)
            for name in set(names.tolist()) & set(shared.value):
                own = shared.value[name]
                part = batch.filter(pa.array(names == name))
                media, at = np.unique(part.column("media_id").to_numpy(), return_inverse=True)
                row, atom = _hits(own, part)
                pairs = np.unique(at[row] * np.int64(max(1, own.atoms)) + atom)
                place, atom = pairs // max(1, own.atoms), (pairs % max(1, own.atoms)).astype(np.uint32)
                bounds = np.searchsorted(place, np.arange(len(media) + 1))
                for start in range(0, len(media), 4096):
                    parts = [atom[bounds[i]:bounds[i + 1]] for i in range(start, min(start + 4096, len(media)))]
                    dense = [4 * len(p) > own.atoms // 8 + 1 for p in parts]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(parts), pa.string()), pa.array(media[start:start + 4096]), pa.array(dense, pa.bool_()),
                        pa.array([_bits(p, own.atoms) if d else p.tobytes() for p, d in zip(parts, dense)], pa.binary()),
                    ], ["collection", "media_id", "dense", "atoms"])

    return rows.mapInArrow(mark, "collection string, media_id long, dense boolean, atoms binary")


def _bits(atoms: np.ndarray, size: int) -> bytes:
    has = np.zeros(size, bool)
    has[atoms] = True
    return np.packbits(has).tobytes()


def _evaluated(marked: DataFrame, shared) -> DataFrame:
    """``collection, media_id, tree_ids``: marks of an item are joined as they come, and programs run by blocks of items."""
    def run(name, media, has):
        own = shared.value[name]
        item, which = np.nonzero(own.run(np.ascontiguousarray(has[:len(media)].T)).T)
        bounds = np.searchsorted(item, np.arange(len(media) + 1)).astype(np.int32)
        out = pa.RecordBatch.from_arrays([
            pa.array([name] * len(media), pa.string()), pa.array(media, pa.int64()),
            pa.ListArray.from_arrays(pa.array(bounds), pa.array(own.tree_ids[which]))], ["collection", "media_id", "tree_ids"])
        return out.filter(pa.array(np.diff(bounds) > 0))

    def meet(batches):
        name, media, has = None, [], None
        for batch in batches:
            for c, m, dense, atoms in zip(*(batch.column(x).to_pylist() for x in ("collection", "media_id", "dense", "atoms"))):
                if name != c or (media[-1] != m and len(media) == len(has)):
                    if media:
                        yield run(name, media, has)
                    own = shared.value[c]
                    block = max(1, min(4096, CELLS // max(1, own.atoms, len(own.codes))))
                    name, media, has = c, [], np.zeros((block, own.atoms), bool)
                if not media or media[-1] != m:
                    media.append(m)
                row = has[len(media) - 1]
                if dense:
                    row |= np.unpackbits(np.frombuffer(atoms, np.uint8), count=len(row)).view(bool)
                else:
                    row[np.frombuffer(atoms, np.uint32)] = True
        if media:
            yield run(name, media, has)

    by = marked.repartition("collection", "media_id").sortWithinPartitions("collection", "media_id")
    return by.mapInArrow(meet, "collection string, media_id long, tree_ids array<long>")


def passing_programs(tables: Tables, filters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items passing each tree of ``filters`` (``collection, filter_id, tree``), after group expansion.

    Returns ``(collection, media_id, tree_ids)``, a row per item, and ``(collection, filter_id, tree_id, error)``:
    filters with the same tree share a ``tree_id`` and so one result.
    """
    compiled = compiled_filters(filters, tables)
    names = filters.select("collection", "filter_id", F.coalesce("tree", F.lit("")).alias("tree")).join(
        compiled.select("collection", "tree", "tree_id", "error"), ["collection", "tree"]).drop("tree")
    good = compiled.where("error IS NULL")
    trees, size = good.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("tree")), F.lit(0))).first()
    slices = max(1, math.ceil(trees / SLICE_TREES), math.ceil(size / SLICE_BYTES))

    wanted = good.select("collection", F.explode("leaves").alias("x")).where("x.tags IS NULL").select(
        "collection", "x.tagset_id", "x.tagtype").distinct()
    values = tables.tag_values.join(small_side(wanted), ["collection", "tagset_id", "tagtype"], "left_semi").select(
        "collection", "tag_id", "tagset_id", "tagtype", "value_str", "value_long", "value_double",
        F.unix_micros("value_ts").alias("value_ts"))
    rows = tables.taggings.where("collection IS NOT NULL AND media_id IS NOT NULL").select("collection", "media_id", "tag_id").join(
        small_side(values), ["collection", "tag_id"], "left").withColumn("tag_id", F.coalesce("tag_id", F.lit(NO_TAG)))
    own = None
    for i in range(slices):
        part = good.where(F.pmod(F.xxhash64("tree"), F.lit(slices)) == i).select("collection", "tree_id", "program", "leaves")
        shared = tables.taggings.sparkSession.sparkContext.broadcast(_shared(part.toArrow().to_pylist()))
        found = _evaluated(_marked(rows, shared), shared)
        own = found if own is None else own.unionByName(found)
    return expand_groups(tables, own, "tree_ids"), names


def passing_filters(tables: Tables, filters: DataFrame) -> DataFrame:
    """``(collection, filter_id, media_id)``: the items that pass each filter, a row for each."""
    passed, names = passing_programs(tables, filters)
    trees = passed.select("collection", "media_id", F.explode("tree_ids").alias("tree_id"))
    return trees.join(names.drop("error"), ["collection", "tree_id"]).select("collection", "filter_id", "media_id")
