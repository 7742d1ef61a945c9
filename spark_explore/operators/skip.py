"""Which items a request must not see: seen items and excluded groups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.operators.mapping import to_index_ids
from spark_explore.operators.topk import Skips
from spark_explore.sizing import cut_lineage, small_side


def id_pairs(requests: DataFrame, ids: str) -> DataFrame:
    """``(req_id, collection, media_id)`` from an id-list column of the requests."""
    pairs = requests.select("req_id", "collection", F.explode(ids).alias("media_id"))
    return pairs.distinct()


def expand_excluded(excluded: DataFrame, medias: DataFrame) -> DataFrame:
    """Excluded ids and all their siblings, as ``(req_id, collection, media_id)``.

    The expanded form, for reports; searches keep the groups unexpanded.
    """
    groups = _excluded_groups(excluded, medias)
    siblings = medias.select("collection", "media_id", "group_id").join(
        small_side(groups), ["collection", "group_id"]
    )
    return excluded.select("req_id", "collection", "media_id").unionByName(
        siblings.select("req_id", "collection", "media_id")
    ).distinct()


def _excluded_groups(excluded: DataFrame, medias: DataFrame) -> DataFrame:
    """Groups of the excluded ids; an id without a group stands only for itself."""
    grouped = medias.where(F.col("group_id").isNotNull())
    return (
        small_side(excluded)
        .join(grouped.select("collection", "media_id", "group_id"), ["collection", "media_id"])
        .select("req_id", "collection", "group_id").distinct()
    )


def skip_items(
    index_map: DataFrame,
    medias: DataFrame,
    seen: DataFrame | None = None,
    excluded: DataFrame | None = None,
) -> Skips | None:
    """Seen and excluded ``(req_id, collection, media_id)`` pairs as a search's skips."""
    single = [df.select("req_id", "collection", "media_id") for df in (seen, excluded) if df is not None]
    if not single:
        return None
    pairs = single[0] if len(single) == 1 else single[0].unionByName(single[1])
    items = cut_lineage(to_index_ids(small_side(pairs), index_map).select("req_id", "collection", "index_id"))
    return Skips(items, None if excluded is None else cut_lineage(_excluded_groups(excluded, medias)))


def with_groups(embeddings: DataFrame, index_map: DataFrame, medias: DataFrame) -> DataFrame:
    """Vectors with the ``group_id`` of their item beside them; where a collection is written, it is stored like this.

    A position that several items share (``validate_collection`` reports it) gets the lowest of their groups.
    """
    groups = medias.where(F.col("group_id").isNotNull()).join(index_map, ["collection", "media_id"]).groupBy(
        "collection", "index_id").agg(F.min("group_id").alias("group_id"))
    return embeddings.drop("group_id").join(groups, ["collection", "index_id"], "left")
