"""Tables of media collections: schemas, reading, writing.

Every table carries ``collection``, so many collections are answered together.
"""

from dataclasses import dataclass, replace
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "collections": "collection string, enabled boolean, index_type string, "
    "thumbnail_media_url string, original_media_url string",
    "medias": "collection string, media_id long, source string, source_type int, "
    "thumbnail_uri string, group_id long",
    "tag_types": "collection string, tagtype_id int, tagtype string",
    "tagsets": "collection string, tagset_id int, name string, tagtype_id int",
    "tag_values": "collection string, tag_id long, tagset_id int, tagtype string, "
    "value_str string, value_long long, value_double double, value_ts timestamp",
    "taggings": "collection string, media_id long, tag_id long",
    "embeddings": "collection string, index_id long, embedding array<float>, group_id long",
}

# Typed value column of each tag type (fixed values).
VALUE_COLUMNS = {
    "categorical": "value_str",
    "numerical_int": "value_long",
    "numerical_double": "value_double",
    "timestamp": "value_ts",
}

# Name of the facet whose value is the position of an item's vector (fixed value).
INDEX_FACET = "Vector Index ID"


@dataclass(frozen=True)
class Tables:
    """The DataFrames of one or many collections."""

    collections: DataFrame
    medias: DataFrame
    tag_types: DataFrame
    tagsets: DataFrame
    tag_values: DataFrame
    taggings: DataFrame
    embeddings: DataFrame | None = None

    def where(self, collection: str) -> "Tables":
        """One collection only; on written tables this prunes partitions."""
        keep = F.col("collection") == collection
        kept = {n: df.where(keep) for n, df in vars(self).items() if df is not None}
        return replace(self, **kept)


def read_collection(spark: SparkSession, folder: str) -> Tables:
    """Open the tables under ``folder``; a missing table fails here, not later."""
    tables = {}
    for name, schema in SCHEMAS.items():
        path = str(PurePosixPath(folder) / name) if "://" not in folder else f"{folder}/{name}"
        # The declared schema spares the footer scan of schema inference.
        reader = spark.read.schema(schema)
        try:
            tables[name] = reader.parquet(path)
        except AnalysisException as error:
            if name != "embeddings" or "PATH_NOT_FOUND" not in str(error):
                raise
            tables[name] = None
    return Tables(**tables)


def write_collection(tables: Tables, folder: str, mode: str = "errorifexists") -> None:
    """Write the tables as Parquet, one folder per collection.

    Large tables are clustered by their join key: rows of one item or tag lie
    in few row groups, and a hot collection still spreads over many files.
    Vectors get the ``group_id`` of their item, so excluded groups are known where they are scored.
    """
    # The operators import the layout of this module.
    from spark_explore.operators.mapping import build_index_map
    from spark_explore.operators.skip import with_groups

    cluster = {"medias": "media_id", "tag_values": "tag_id", "taggings": "media_id",
               "embeddings": "index_id"}
    for name in SCHEMAS:
        df = getattr(tables, name)
        if df is None:
            continue
        if name == "embeddings" and "group_id" not in df.columns:
            df = with_groups(df, build_index_map(tables), tables.medias)
        fields = StructType.fromDDL(SCHEMAS[name])
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in fields])
        if name in cluster:
            keys = ["collection", cluster[name]]
            df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        df.write.mode(mode).partitionBy("collection").parquet(f"{folder}/{name}")


def enabled_collections(tables: Tables) -> DataFrame:
    """Registry rows that are switched on, with an index type this library serves.

    ``exact`` needs no index, ``ivf`` needs one; other types are rejected.
    """
    return tables.collections.where("enabled").withColumn(
        "needs_index",
        F.when(F.col("index_type") == "exact", False)
        .when(F.col("index_type") == "ivf", True)
        .otherwise(F.raise_error(F.concat(F.lit("unknown index type "), "index_type"))),
    )


def list_collections(tables: Tables) -> DataFrame:
    return tables.collections.where("enabled").select("collection")


def read_embeddings(spark: SparkSession, path: str, collection: str, index_id: str,
                    vector: str) -> DataFrame:
    """Vectors of any Parquet table as ``(collection, index_id, embedding)``."""
    return spark.read.parquet(path).select(
        F.lit(collection).alias("collection"),
        F.col(index_id).cast("long").alias("index_id"),
        F.col(vector).cast("array<float>").alias("embedding"),
    )
