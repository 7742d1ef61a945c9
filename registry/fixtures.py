"""Media collections derived from the given tables (FIXTURES.md).

``media``      one item per embedding, grouped by label; facets from documents,
               labels and events
``orders``     one item per order, grouped by customer; facets only
``documents``  one item per document, grouped by source; vectors from the text
"""

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_explore.functions.encode import embed_text
from spark_explore.functions.vectors import mean_vector
from spark_explore.operators.filters import AllOf, AnyOf, Between, Group
from spark_explore.operators.mapping import build_index_map, with_numbers
from spark_explore.plans.search import SearchIndex
from spark_explore.sizing import checkpoint_dir, cut_lineage, local_table
from spark_explore.sources.collections import SCHEMAS as LAYOUT
from spark_explore.sources.collections import VALUE_COLUMNS, Tables

B = 1_000_000_000
DIM = 64
LANGS = ["de", "en", "es", "fr"]
EVENTS = ["click", "error", "purchase", "signup", "view"]
STATUSES = ["F", "O", "P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
TAGTYPES = {1: "categorical", 2: "numerical_int", 3: "numerical_double", 4: "timestamp"}

VALUES = ["tag_id", "tagset_id", "tagtype", "value_str", "value_long", "value_double", "value_ts"]


# Columns of the given tables; declared, so that opening one costs no job.
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Event times are written without a zone; they are read as UTC everywhere.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def number_in(values: list[str], column: str):
    return F.expr(_number_in(values, column))


def _number_in(values: list[str], column: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"array_position(array({listed}), {column})"


KINDS = {"value_str": "string", "value_long": "bigint", "value_double": "double", "value_ts": "timestamp"}


def _tag(df: DataFrame, media_id: str, tagset_id: int, tag: str, tagtype: str, value: str) -> DataFrame:
    """Taggings of one facet with their typed value, from SQL expressions."""
    typed = [
        f"cast({value if c == VALUE_COLUMNS[tagtype] else 'null'} as {k}) as {c}" for c, k in KINDS.items()
    ]
    return df.selectExpr(
        f"cast({media_id} as bigint) as media_id",
        f"{tagset_id * B}L + cast({tag} as bigint) as tag_id",
        f"{tagset_id} as tagset_id", f"'{tagtype}' as tagtype", *typed,
    )


def _media(df: DataFrame, media_id: str, source: str, source_type: int, thumb: str, group: str) -> DataFrame:
    return df.selectExpr(
        f"cast({media_id} as bigint) as media_id", f"{source} as source", f"{source_type} as source_type",
        f"cast({thumb} as string) as thumbnail_uri", f"cast({group} as bigint) as group_id",
    )


def _tables(spark, name, medias, tagged, facets, embeddings=None) -> Tables:
    own = F.lit(name).alias("collection")
    every = tagged[0]
    for part in tagged[1:]:
        every = every.unionByName(part)
    return Tables(
        collections=local_table(
            spark,
            [{"collection": name, "enabled": True, "index_type": "exact",
              "thumbnail_media_url": "http://thumbs", "original_media_url": "http://media"}],
            LAYOUT["collections"],
        ),
        medias=medias.select(own, "media_id", "source", "source_type", "thumbnail_uri", "group_id"),
        tag_types=local_table(
            spark, [{"collection": name, "tagtype_id": i, "tagtype": t} for i, t in TAGTYPES.items()],
            LAYOUT["tag_types"],
        ),
        tagsets=local_table(
            spark,
            [{"collection": name, "tagset_id": i, "name": facet, "tagtype_id": t} for i, facet, t in facets],
            LAYOUT["tagsets"],
        ),
        tag_values=every.select(own, *VALUES).distinct(),
        taggings=every.select(own, "media_id", "tag_id"),
        embeddings=embeddings,
    )


MEDIA_FACETS = [
    (1, "Vector Index ID", 2), (2, "lang", 1), (3, "source", 1), (4, "n_chars", 2), (5, "quality", 1),
    (6, "toxic", 1), (7, "activity", 1), (8, "first_seen", 4), (9, "component0", 3), (10, "split", 1),
]


def media_tables(spark: SparkSession, sf_dir: str) -> Tables:
    emb = read(spark, sf_dir, "embeddings")
    ids = emb.select("vec_id")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    docs = docs.join(ids, F.col("doc_id") == F.col("vec_id"), "left_semi")
    rated = read(spark, sf_dir, "labels").join(ids, F.col("doc_id") == F.col("vec_id"), "left_semi")
    events = read(spark, sf_dir, "events")
    active = events.join(ids, F.col("user_id") == F.col("vec_id"), "left_semi")
    first = events.join(ids, F.col("event_id") == F.col("vec_id"), "left_semi")
    labels = emb.select("label").distinct()
    solo = spark.range(11, 13)
    medias = (
        _media(emb, "1000 + vec_id", "concat('img/', vec_id, '.jpg')", 1, "concat('thumb/', vec_id, '.jpg')",
               "1 + label")
        .unionByName(_media(labels, "1 + label", "concat('vid/', label, '.mp4')", 2, "null", "null"))
        .unionByName(_media(solo, "id", "concat('solo/', id, '.jpg')", 1, "null", "null"))
    )
    tagged = [
        _tag(emb, "1000 + vec_id", 1, "vec_id", "numerical_int", "vec_id"),
        _tag(docs, "1000 + doc_id", 2, _number_in(LANGS, "lang"), "categorical", "lang"),
        _tag(solo.where("id = 12"), "id", 2, "2", "categorical", "'en'"),
        _tag(docs, "1000 + doc_id", 3, "substring(source, 4)", "categorical", "source"),
        _tag(docs, "1000 + doc_id", 4, "n_chars", "numerical_int", "n_chars"),
        _tag(rated, "1000 + doc_id", 5, "quality", "categorical", "quality"),
        _tag(rated, "1000 + doc_id", 6, "toxic", "categorical", "toxic"),
        _tag(active.select("user_id", "event_type").distinct(), "1000 + user_id", 7,
             _number_in(EVENTS, "event_type"), "categorical", "event_type"),
        _tag(first, "1000 + event_id", 8, "event_id", "timestamp", "ts"),
        _tag(emb, "1000 + vec_id", 9, "vec_id", "numerical_double", "round(cast(embedding[0] as double), 3)"),
        _tag(labels, "1 + label", 10, "label % 2", "categorical", "if(label % 2 = 0, 'even', 'odd')"),
    ]
    vectors = emb.select(F.lit("media").alias("collection"), F.col("vec_id").alias("index_id"), "embedding",
                         F.expr("cast(1 + label as long)").alias("group_id"))
    return _tables(spark, "media", medias, tagged, MEDIA_FACETS, vectors)


# The filter trees of FIXTURES.md.
TREES = {
    "lang_any": AnyOf((2 * B + 1, 2 * B + 3)),
    "lang_en": AnyOf((2 * B + 2,)),
    "not_en": AnyOf((2 * B + 2,), negated=True),
    "click_and_view": AllOf((7 * B + 1, 7 * B + 5)),
    "chars": Between(4, "numerical_int", 500, 2000),
    "even": AnyOf((10 * B,)),
    "nested": Group("OR", (
        Group("AND", (AnyOf((2 * B + 2,)), Between(4, "numerical_int", 500, 2000, negated=True))),
        AnyOf((10 * B + 1,)),
    )),
    "everything": Group("AND"),
}

ORDER_FACETS = [(2, "status", 1), (3, "priority", 1), (4, "totalprice", 3), (5, "orderdate", 4), (6, "tier", 2)]


def orders_tables(spark: SparkSession, sf_dir: str) -> Tables:
    orders = read(spark, sf_dir, "orders")
    customers = orders.select("o_custkey").distinct()
    item, group = f"{B} + o_orderkey", "1 + o_custkey"
    medias = _media(orders, item, "concat('order/', o_orderkey)", 1, "null", group).unionByName(
        _media(customers, group, "concat('customer/', o_custkey)", 2, "null", "null")
    )
    tagged = [
        _tag(orders, item, 2, _number_in(STATUSES, "o_orderstatus"), "categorical", "o_orderstatus"),
        _tag(orders, item, 3, _number_in(PRIORITIES, "o_orderpriority"), "categorical", "o_orderpriority"),
        _tag(orders, item, 4, "o_orderkey", "numerical_double", "o_totalprice"),
        _tag(orders, item, 5, "o_orderkey", "timestamp", "o_orderdate"),
        _tag(customers, group, 6, "o_custkey % 3", "numerical_int", "o_custkey % 3"),
    ]
    return _tables(spark, "orders", medias, tagged, ORDER_FACETS)


ORDER_TREES = {
    "costly_open": Group("AND", (AnyOf((2 * B + 2,)), Between(4, "numerical_double", 200000.0, None))),
    "urgent_1997": Group("AND", (
        AnyOf((3 * B + 1, 3 * B + 2)), Between(5, "timestamp", "1997-01-01", "1997-12-31 23:59:59"),
    )),
    "tier_one": Between(6, "numerical_int", 1, 1),
    "not_low_or_tier_two": Group("OR", (AnyOf((3 * B + 5,), negated=True), AnyOf((6 * B + 2,)))),
}

DOCUMENT_FACETS = [(1, "Vector Index ID", 2), (2, "lang", 1), (4, "n_chars", 2)]


def documents_tables(spark: SparkSession, sf_dir: str) -> Tables:
    docs = read(spark, sf_dir, "documents")
    item, group = "1000 + doc_id", "1 + cast(substring(source, 4) as bigint)"
    medias = _media(docs, item, "concat('doc/', doc_id)", 1, "null", group).unionByName(
        _media(docs.select("source").distinct(), group, "source", 2, "null", "null")
    )
    tagged = [
        _tag(docs, item, 1, "doc_id", "numerical_int", "doc_id"),
        _tag(docs, item, 2, _number_in(LANGS, "lang"), "categorical", "lang"),
        _tag(docs, item, 4, "n_chars", "numerical_int", "n_chars"),
    ]
    vectors = embed_text(docs, "text", "embedding").select(
        F.lit("documents").alias("collection"), F.col("doc_id").alias("index_id"), "embedding", F.lit(None).cast("long").alias("group_id")
    )
    return _tables(spark, "documents", medias, tagged, DOCUMENT_FACETS, vectors)


DOCUMENT_TREES = {
    "spanish": AnyOf((2 * B + 3,)),
    "long_german": Group("AND", (AnyOf((2 * B + 1,)), Between(4, "numerical_int", 2000, None))),
}


def search_index(tables: Tables, **ivf) -> SearchIndex:
    """What a search needs; the mapping is made once, as when a collection is loaded."""
    return SearchIndex(tables.embeddings, cut_lineage(with_numbers(build_index_map(tables))), tables.medias, **ivf)


def documents_index(spark: SparkSession, sf_dir: str, tables: Tables | None = None) -> SearchIndex:
    """The index of the documents. Their vectors are written once, as when a collection is loaded: a search reads them several times, and none reads the texts."""
    index = search_index(tables or documents_tables(spark, sf_dir))
    folder = f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    index.embeddings.write.parquet(folder)
    return replace(index, embeddings=spark.read.schema(index.embeddings.schema).parquet(folder))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per group and language: the mean vector of its items.

    The number of searches is the number of such pairs; the items they are made
    of are all items with a document.
    """
    members = topic_items(spark, sf_dir)
    return members.groupBy("req_id", "label", "lang").agg(
        mean_vector("embedding", DIM).alias("query_vec")
    ).withColumn("collection", F.lit("media")).withColumn("n", F.lit(10))


def topic_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    emb = read(spark, sf_dir, "embeddings")
    req_id = F.col("label").cast("long") * 4 + number_in(LANGS, "lang")
    return emb.join(docs, F.col("vec_id") == F.col("doc_id")).select(
        req_id.alias("req_id"), "label", "lang", "vec_id",
        (F.lit(1000) + F.col("vec_id")).alias("media_id"), "embedding",
    ).withColumn("collection", F.lit("media"))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index cells for checkable IVF searches: the mean vector of each label."""
    emb = read(spark, sf_dir, "embeddings")
    return emb.groupBy(F.col("label").cast("long").alias("cell")).agg(
        mean_vector("embedding", DIM).alias("centroid")
    )
