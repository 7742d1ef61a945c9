"""Item id <-> vector position, and checks of a collection's integrity."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_explore.sizing import cut_lineage, small_side
from spark_explore.sources.collections import INDEX_FACET, Tables


def build_index_map(tables: Tables) -> DataFrame:
    """``(collection, media_id, index_id)`` from the tags of the index facet."""
    facet = tables.tagsets.where(F.col("name") == INDEX_FACET).select("collection", "tagset_id")
    positions = (
        tables.tag_values.where(F.col("tagtype") == "numerical_int")
        .join(small_side(facet), ["collection", "tagset_id"], "left_semi")
        .select("collection", "tag_id", F.col("value_long").alias("index_id"))
    )
    return (
        tables.taggings.join(positions, ["collection", "tag_id"])
        .join(tables.medias.select("collection", "media_id"), ["collection", "media_id"])
        .select("collection", "media_id", "index_id")
    )


def numbered_items(index_map: DataFrame) -> DataFrame:
    """``(collection, number, index_id)``: the mapped items of a collection counted from 0 by position.

    Positions are sorted over ranges of partitions; a partition counts its own
    and adds what the ones before it hold, so gaps between positions don't matter.
    """
    keys = ["collection", "index_id"]
    ordered = cut_lineage(
        index_map.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    ).withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    held = ordered.groupBy("collection", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("many"))
    before = Window.partitionBy("collection").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("many").over(before), F.lit(0)))
    return ordered.withColumn("part", part).join(
        small_side(held.select("collection", "part", "first", "before")), ["collection", "part"]
    ).select("collection", (F.col("before") + F.col("at") - F.col("first")).alias("number"), "index_id")


def with_numbers(index_map: DataFrame) -> DataFrame:
    """The mapping with ``number``, the rank of its position: made once, when a collection is loaded or written, for draws at random."""
    return index_map.join(numbered_items(index_map), ["collection", "index_id"])


def to_media_ids(found: DataFrame, index_map: DataFrame) -> DataFrame:
    """Replace ``index_id`` by ``media_id``; -1 (no hit) is dropped, ranks stay."""
    hits = found.where(F.col("index_id") != -1)
    return hits.join(index_map.select("collection", "media_id", "index_id"), ["collection", "index_id"]).drop("index_id")


def to_index_ids(pairs: DataFrame, index_map: DataFrame, strict: bool = False) -> DataFrame:
    """Replace ``media_id`` by ``index_id``; ``strict`` raises on an unmapped id."""
    if strict:
        unmapped = pairs.join(index_map, ["collection", "media_id"], "left_anti").limit(1).count()
        if unmapped:
            raise ValueError("media ids without a vector position")
    mapped = pairs.join(index_map.select("collection", "media_id", "index_id"), ["collection", "media_id"]).where(F.col("index_id") != -1)
    return mapped.drop("media_id")


def total_items(index_map: DataFrame) -> DataFrame:
    """Items per collection. The inner grouping lets a hot collection combine map-side."""
    return (
        index_map.groupBy("collection", "index_id").agg(F.lit(1).alias("one"))
        .groupBy("collection").agg(F.count("*").alias("total_items"))
    )


def group_medias(medias: DataFrame) -> DataFrame:
    return medias.where(F.col("group_id").isNull())


def _orphans(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    # Counted per key first: a tag on a third of all items is one row in the join.
    keys = left.groupBy(*on).agg(F.count("*").alias("uses"))
    missing = keys.join(right.select(*on), on, "left_anti")
    return missing.groupBy("collection").agg(F.sum("uses").alias(name))


def validate_collection(tables: Tables, index_map: DataFrame) -> DataFrame:
    """One row per collection with what makes it ready or not.

    Ready: vectors are mapped one to one on the dense positions 0..N-1, and no
    row points at a missing one.
    """
    ids = index_map.groupBy("collection", "index_id").agg(F.count("*").alias("uses"))
    by_index = ids.groupBy("collection").agg(
        F.sum("uses").alias("mapped"),
        F.sum(F.col("uses") - 1).alias("duplicate_index_ids"),
        (F.max("index_id") + 1 - F.count("*")).alias("gaps"),
        F.min("index_id").alias("first_index_id"),
    )
    by_media = (
        index_map.groupBy("collection", "media_id").agg((F.count("*") - 1).alias("extra"))
        .groupBy("collection").agg(F.sum("extra").alias("duplicate_media_ids"))
    )
    groups = group_medias(tables.medias).select("collection", F.col("media_id").alias("group_id"))
    members = tables.medias.where(F.col("group_id").isNotNull())
    checks = [
        _orphans(tables.taggings, tables.medias, ["collection", "media_id"], "taggings_without_media"),
        _orphans(tables.taggings, tables.tag_values, ["collection", "tag_id"], "taggings_without_value"),
        _orphans(members, groups, ["collection", "group_id"], "items_without_group"),
    ]
    if tables.embeddings is not None:
        checks.append(
            _orphans(index_map, tables.embeddings, ["collection", "index_id"], "mapped_without_vector")
        )
    report = tables.collections.select("collection")
    for part in [by_index, by_media, *checks]:
        report = report.join(part, "collection", "left")
    counts = [c for c in report.columns if c not in ("collection", "first_index_id")]
    report = report.fillna(0, subset=counts)
    faults = sum(F.col(c) for c in counts if c != "mapped")
    ready = (F.col("mapped") > 0) & (F.col("first_index_id") == 0) & (faults == 0)
    return report.withColumn("ready", F.coalesce(ready, F.lit(False))).drop("first_index_id")
