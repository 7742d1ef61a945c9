"""Item lookups for whole tables of ids."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.functions.display import display_text, display_values
from spark_explore.operators.catalogue import value_text
from spark_explore.sizing import small_side
from spark_explore.sources.collections import Tables


def items(tables: Tables, ids: DataFrame) -> DataFrame:
    """Media rows of ``(collection, media_id)``; unknown ids have no row."""
    return tables.medias.join(small_side(ids.select("collection", "media_id").distinct()),
                              ["collection", "media_id"], "left_semi")


def item_base_info(tables: Tables, ids: DataFrame) -> DataFrame:
    """Base card of each item, with URLs built from the collection's base addresses."""
    bases = tables.collections.select("collection", "thumbnail_media_url", "original_media_url")

    def url(base, uri):
        return F.concat(F.col(base), F.lit("/"), F.coalesce(F.col(uri), F.lit("None")))

    return items(tables, ids).join(small_side(bases), "collection").select(
        "collection",
        F.col("media_id").alias("id"),
        F.col("media_id").alias("name"),
        F.col("media_id").alias("media_id"),
        F.col("source_type").alias("media_type"),
        url("thumbnail_media_url", "thumbnail_uri").alias("thumb_path"),
        url("original_media_url", "source").alias("src_path"),
        "group_id",
    )


def item_values(tables: Tables, ids: DataFrame, tagset_ids: list[int] | None = None) -> DataFrame:
    """Long form: one row per item and distinct tag, of the chosen facets or all."""
    return _tag_rows(tables, ids, tagset_ids).distinct()


def _tag_rows(tables: Tables, ids: DataFrame, tagset_ids: list[int] | None) -> DataFrame:
    """The taggings of the items with their values; only those of the chosen facets leave the joins."""
    facets, values = tables.tagsets, tables.tag_values
    if tagset_ids is not None:
        facets = facets.where(F.col("tagset_id").isin(*tagset_ids))
        values = values.where(F.col("tagset_id").isin(*tagset_ids))
    names = facets.select("collection", "tagset_id", F.col("name").alias("facet"))
    texts = values.select("collection", "tag_id", "tagset_id", value_text().alias("value"))
    wanted = small_side(ids.select("collection", "media_id").distinct())
    tags = tables.taggings.select("collection", "media_id", "tag_id").join(
        wanted, ["collection", "media_id"], "left_semi"
    )
    return (
        tags.join(small_side(texts), ["collection", "tag_id"])
        .join(small_side(names), ["collection", "tagset_id"])
        .select("collection", "media_id", "tagset_id", "facet", "tag_id", "value")
    )


def _value_lists(values: DataFrame, by: list[str]) -> DataFrame:
    """Values per facet in tag order, repeated taggings once. One item's tags bound each list."""
    ordered = F.array_sort(F.collect_set(F.struct("tag_id", "value")))
    return values.groupBy("collection", "media_id", *by).agg(
        F.transform(ordered, lambda v: v["value"]).alias("values")
    )


def item_metadata(tables: Tables, ids: DataFrame, tagset_ids: list[int] | None = None) -> DataFrame:
    """``(collection, media_id, tagset_id, facet, values)``, grouped by facet id."""
    return _value_lists(_tag_rows(tables, ids, tagset_ids), ["tagset_id", "facet"])


def item_details(tables: Tables, ids: DataFrame, tagset_ids: list[int]) -> DataFrame:
    """Metadata of the named facets; naming none gives none, not all."""
    return item_metadata(tables, ids, list(tagset_ids))


def metadata_map(metadata: DataFrame) -> DataFrame:
    """One row per item with ``metadata map<facet, values>``; the last facet id wins a shared name."""
    entry = F.struct("tagset_id", "facet", "values")
    facets = F.array_sort(F.collect_list(entry))
    last = F.aggregate(
        facets,
        F.expr("cast(map() as map<string, array<string>>)"),
        lambda acc, e: F.map_concat(
            F.map_filter(acc, lambda k, _: k != e["facet"]), F.create_map(e["facet"], e["values"])
        ),
    )
    return metadata.groupBy("collection", "media_id").agg(last.alias("metadata"))


def related_items(tables: Tables, ids: DataFrame) -> DataFrame:
    """``(collection, media_id, related_id)``: children of the media as a group."""
    asked = small_side(ids.select("collection", F.col("media_id").alias("group_id")).distinct())
    children = tables.medias.where(F.col("group_id").isNotNull())
    return children.select("collection", "group_id", F.col("media_id").alias("related_id")).join(
        asked, ["collection", "group_id"]
    ).select("collection", F.col("group_id").alias("media_id"), "related_id")


def siblings(tables: Tables, ids: DataFrame) -> DataFrame:
    """``(collection, media_id, group_id)`` per asked item that has a group.

    The group stands for the siblings: ``related_items`` lists them on demand.
    """
    return items(tables, ids).where(F.col("group_id").isNotNull()).select(
        "collection", "media_id", "group_id"
    )


def related_metadata(tables: Tables, ids: DataFrame, tagset_ids: list[int]) -> DataFrame:
    """Facet values of each related item, grouped by facet name.

    Without facets the plain related ids are returned; otherwise children that
    have none of the facets are absent.
    """
    related = related_items(tables, ids)
    if not tagset_ids:
        return related
    children = related.select("collection", F.col("related_id").alias("media_id"))
    values = _value_lists(_tag_rows(tables, children, tagset_ids), ["facet"])
    return related.join(
        values.withColumnRenamed("media_id", "related_id"), ["collection", "related_id"]
    ).select("collection", "media_id", "related_id", "facet", "values")


def is_excluded(tables: Tables, asked: DataFrame) -> DataFrame:
    """``asked``: ``(req_id, collection, media_id, excluded_ids)``; adds ``excluded``.

    An item is excluded when one of the excluded ids is its group.
    """
    groups = tables.medias.where(F.col("group_id").isNotNull()).select(
        "collection", "media_id", "group_id"
    )
    return asked.join(groups, ["collection", "media_id"], "left").select(
        "req_id", "collection", "media_id",
        F.coalesce(F.array_contains("excluded_ids", F.col("group_id")), F.lit(False)).alias("excluded"),
    )


def display_metadata(metadata: DataFrame) -> DataFrame:
    """Facet names and values in display form."""
    return metadata.withColumn("facet", display_text(F.col("facet"))).withColumn(
        "values", display_values(F.col("values"))
    )


def item_info(tables: Tables, ids: DataFrame, tagset_ids: list[int] | None = None) -> DataFrame:
    """Item card with its metadata; items without tags keep an empty map."""
    details = metadata_map(item_metadata(tables, ids, tagset_ids))
    empty = F.expr("cast(map() as map<string, array<string>>)")
    return items(tables, ids).join(details, ["collection", "media_id"], "left").select(
        "collection",
        F.col("media_id").alias("item_id"),
        "thumbnail_uri",
        F.col("source").alias("media_uri"),
        F.col("group_id").alias("group"),
        F.coalesce("metadata", empty).alias("metadata"),
    )
