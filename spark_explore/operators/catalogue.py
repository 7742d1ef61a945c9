"""Facet catalogue: tag types, facets and their values."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.sizing import small_side
from spark_explore.sources.collections import VALUE_COLUMNS, Tables


def value_text(timestamp_format: str = "yyyy-MM-dd HH:mm:ss.SSSSSS"):
    """Canonical text of a typed tag value, whichever column holds it."""
    return F.coalesce(
        F.col("value_str"),
        F.col("value_long").cast("string"),
        F.col("value_double").cast("string"),
        F.date_format("value_ts", timestamp_format),
    )


def tag_types(tables: Tables) -> DataFrame:
    return tables.tag_types.select("collection", "tagtype_id", "tagtype")


def facets(tables: Tables) -> DataFrame:
    """Facet definitions with the name of their tag type."""
    types = small_side(tag_types(tables))
    return tables.tagsets.join(types, ["collection", "tagtype_id"]).select(
        "collection", "tagset_id", "name", "tagtype_id", "tagtype"
    )


def facet_values(tables: Tables, tagset_id: int | None = None, tagtype: str | None = None) -> DataFrame:
    """Values of one facet, or of all facets when no id is given.

    Facet id and tag type must both match; an unknown type raises.
    """
    if tagtype is not None and tagtype not in VALUE_COLUMNS:
        raise ValueError(f"unknown tag type {tagtype!r}")
    values = tables.tag_values
    if tagset_id is not None:
        values = values.where(F.col("tagset_id") == tagset_id)
    if tagtype is not None:
        values = values.where(F.col("tagtype") == tagtype)
    known = small_side(facets(tables).select("collection", "tagset_id", "tagtype"))
    return values.join(known, ["collection", "tagset_id", "tagtype"]).select(
        "collection", "tagset_id", "tag_id", value_text().alias("value")
    )
