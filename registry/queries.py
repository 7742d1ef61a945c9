"""The registered queries. Each runs over the whole given tables."""

import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import fixtures as fx
from registry.fixtures import B
from spark_explore.functions.encode import embed_text
from spark_explore.functions.vectors import dot, l2_norm, l2_normalize
from spark_explore.operators import audit, catalogue, feedback, filters, items, ivf, mapping, programs, skip
from spark_explore.operators.filters import AllOf, AnyOf, Between, Group
from spark_explore.operators.item_sets import item_set_state as fold_item_sets
from spark_explore.plans import search
from spark_explore.sizing import checkpoint_dir
from spark_explore.sources import collections as sources
from spark_explore.streaming.audit_stream import stream_audit as start_audit_stream
from spark_explore.streaming.item_set_stream import read_item_sets, stream_item_sets

SCORE = "round(score, 6) + 0.0D AS score"
RESULT = ["req_id", "rank", "media_id", SCORE]


# Sources and mapping ---------------------------------------------------------

def total_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [mapping.build_index_map(t(spark, sf_dir)) for t in (fx.media_tables, fx.documents_tables)]
    return mapping.total_items(both[0].unionByName(both[1]))


def list_collections(spark, sf_dir):
    # The registry lists a collection per document source; those with toxic texts are switched off.
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "source")
    toxic = fx.read(spark, sf_dir, "labels").where("toxic = 1")
    state = docs.join(toxic, "doc_id", "left").groupBy("source").agg(F.count("toxic").alias("toxic"))
    registry = state.select(
        F.col("source").alias("collection"), (F.col("toxic") == 0).alias("enabled"),
        F.lit("exact").alias("index_type"), F.lit("t").alias("thumbnail_media_url"),
        F.lit("m").alias("original_media_url"),
    )
    t = fx.media_tables(spark, sf_dir)
    return sources.list_collections(sources.replace(t, collections=registry))


def index_map(spark, sf_dir):
    return mapping.build_index_map(fx.media_tables(spark, sf_dir))


def key_mapping(spark, sf_dir):
    """Rated media ids to positions and back."""
    t = fx.media_tables(spark, sf_dir)
    mapped = mapping.build_index_map(t)
    rated = fx.read(spark, sf_dir, "labels").select(
        F.lit("media").alias("collection"), (F.col("doc_id") + 1000).alias("media_id"), "quality"
    )
    positions = mapping.to_index_ids(rated, mapped).withColumn("position", F.col("index_id"))
    return mapping.to_media_ids(positions, mapped).select("media_id", "position", "quality")


def group_medias(spark, sf_dir):
    return mapping.group_medias(fx.media_tables(spark, sf_dir).medias).select("media_id", "source")


def validate_collection(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    return mapping.validate_collection(t, mapping.build_index_map(t))


# Facet catalogue ---------------------------------------------------------------

def tag_types(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    used = t.tag_values.groupBy("collection", "tagtype").agg(F.count("*").alias("tag_values"))
    return catalogue.tag_types(t).join(used, ["collection", "tagtype"]).select(
        "tagtype_id", "tagtype", "tag_values"
    )


def facets(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    sizes = t.tag_values.groupBy("collection", "tagset_id").agg(F.count("*").alias("tag_values"))
    return catalogue.facets(t).join(sizes, ["collection", "tagset_id"]).drop("collection")


def facet_values(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    return catalogue.facet_values(t).select("tagset_id", "tag_id", "value")


# Filters -------------------------------------------------------------------------

def _tree(tree):
    def run(spark, sf_dir):
        t = fx.media_tables(spark, sf_dir)
        return filters.passing_tree(t, tree).select("media_id")
    return run


OPEN_RANGES = {
    "from_1000": Between(4, "numerical_int", 1000, None),
    "until_0": Between(9, "numerical_double", None, 0.0),
    "any_time": Between(8, "timestamp"),
    "january_10": Between(8, "timestamp", "2024-01-01", "2024-01-10"),
}

IDENTITIES = {
    "any_none": AnyOf(()),
    "not_any_none": AnyOf((), negated=True),
    "all_none": AllOf(()),
    "not_all_none": AllOf((), negated=True),
    "and_none": Group("AND"),
    "or_none": Group("OR"),
    "not_or_none": Group("OR", negated=True),
    "not_and_none": Group("AND", negated=True),
}


def _trees(trees):
    def run(spark, sf_dir):
        passed = filters.passing(fx.media_tables(spark, sf_dir), trees)
        return passed.select(F.explode("filter_ids").alias("filter_id"), "media_id")
    return run


def filter_programs(spark, sf_dir):
    """A tree, as JSON, for each language and length of the documents: alike in both and without a click."""
    t = fx.media_tables(spark, sf_dir)
    docs = fx.read(spark, sf_dir, "documents").where("n_chars IS NOT NULL")
    band = docs.select("lang", fx.number_in(fx.LANGS, "lang").alias("no"), F.floor(F.col("n_chars") / 8).alias("band")).where("no > 0").distinct()
    leaf = '{"kind": "leaf", "not_": %s, "filter": {"id": %s, "tagtype_id": %s, "constraint": {%s}}}'
    leaves = [
        leaf % ("false", "null", "null", '"value_ids": [%1$d], "operator": "OR"'),
        leaf % ("false", "4", "2", '"lower_bound": %2$d, "upper_bound": %3$d'),
        leaf % ("true", "null", "null", f'"value_ids": [{7 * B + 1}], "operator": "OR"'),
    ]
    form = '{"root": {"kind": "group", "operator": "AND", "children": [' + ", ".join(leaves) + "]}}"
    asked = band.select(
        F.lit("media").alias("collection"), F.concat_ws("/", "lang", "band").alias("filter_id"),
        F.format_string(form, F.lit(2 * B) + F.col("no"), F.col("band") * 8 - 40, F.col("band") * 8 + 47).alias("tree"))
    return programs.passing_filters(t, asked).select("filter_id", "media_id")


def applied_filters(spark, sf_dir):
    """Each topic asks for its language (named facet) and for either quality mark."""
    t = fx.media_tables(spark, sf_dir)
    asked = fx.topics(spark, sf_dir).select("req_id", "collection", "lang", "label")
    lang = asked.select(
        "req_id", "collection", F.lit("lang").alias("name"),
        F.array(F.lit(2 * B) + fx.number_in(fx.LANGS, "lang")).alias("tag_ids"),
    )
    activity = asked.select(
        "req_id", "collection", F.lit("activity").alias("name"),
        F.array(F.lit(7 * B) + F.col("label") % 5 + 1, F.lit(7 * B + 1)).alias("tag_ids"),
    )
    return filters.applied_filters(lang.unionByName(activity), t.taggings).select("req_id", "media_id")


def faceted_search(spark, sf_dir):
    """Per customer tier one search for each tree over all orders, first 100 items."""
    t = fx.orders_tables(spark, sf_dir)
    passed = filters.passing(t, fx.ORDER_TREES)
    tiers = t.tag_values.where("tagset_id = 6").select(F.col("value_long").alias("tier"), "collection")
    names = list(fx.ORDER_TREES)
    asked = tiers.select("collection", "tier", F.posexplode(F.array(*map(F.lit, names))).alias("i", "filter_id"))
    requests = asked.select(
        (F.col("tier") * 10 + F.col("i")).alias("req_id"), "collection", "filter_id",
        (100 * (F.col("tier") + 1)).alias("n"),
    )
    return filters.faceted_search(requests, passed).select("req_id", "rank", "media_id")


# Vectors ---------------------------------------------------------------------------

def l2_normalized(spark, sf_dir):
    counts = F.array(F.col("o_totalprice"), F.col("o_custkey").cast("double"))
    orders = fx.read(spark, sf_dir, "orders")
    unit = orders.select("o_orderkey", l2_normalize(counts).alias("v"))
    return unit.select(
        "o_orderkey", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"),
        F.round(l2_norm(F.col("v")), 6).alias("norm"),
    )


def self_dot(spark, sf_dir):
    emb = fx.read(spark, sf_dir, "embeddings")
    vec = F.col("embedding")
    return emb.select("vec_id", (F.round(dot(vec, F.reverse(vec)), 6) + 0.0).alias("score"))


def topk_single(spark, sf_dir):
    """One search: the items most like the whole collection's mean."""
    index = fx.search_index(fx.media_tables(spark, sf_dir))
    mean = index.embeddings.groupBy("collection").agg(
        fx.mean_vector("embedding", fx.DIM).alias("query_vec")
    )
    one = mean.withColumn("req_id", F.lit(0)).withColumn("n", F.lit(20))
    return search.vector_search(one, index).selectExpr(*RESULT)


def topk_batch(spark, sf_dir):
    index = fx.search_index(fx.media_tables(spark, sf_dir))
    return search.vector_search(fx.topics(spark, sf_dir), index).selectExpr(*RESULT)


def _rated_items(spark, sf_dir):
    rated = fx.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), "quality", "toxic")
    return fx.topic_items(spark, sf_dir).drop("embedding").join(rated, "vec_id")


def topk_skip_seen(spark, sf_dir):
    """The items of a topic that were rated count as seen."""
    index = fx.search_index(fx.media_tables(spark, sf_dir))
    seen = _rated_items(spark, sf_dir)
    return search.vector_search(fx.topics(spark, sf_dir), index, seen=seen).selectExpr(*RESULT)


def _first_of_topic(spark, sf_dir):
    return fx.topic_items(spark, sf_dir).groupBy("req_id", "collection").agg(
        F.min("media_id").alias("media_id")
    )


def topk_excluded_groups(spark, sf_dir):
    """The first item of each topic is excluded, and its group with it."""
    index = fx.search_index(fx.media_tables(spark, sf_dir))
    excluded = _first_of_topic(spark, sf_dir)
    return search.vector_search(fx.topics(spark, sf_dir), index, excluded=excluded).selectExpr(*RESULT)


def expand_excluded(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    excluded = _first_of_topic(spark, sf_dir)
    return skip.expand_excluded(excluded, t.medias).select("req_id", "media_id")


def _with_filters(requests):
    names = F.array(*[F.lit(name) for name in fx.TREES])
    return requests.withColumn("filter_id", F.element_at(names, F.col("label") % len(fx.TREES) + 1))


def topk_filtered(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    passed = filters.passing(t, fx.TREES)
    asked = _with_filters(fx.topics(spark, sf_dir))
    return search.vector_search(asked, fx.search_index(t), passed=passed).selectExpr(*RESULT)


def topk_all_limits(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    asked = _with_filters(fx.topics(spark, sf_dir))
    return search.vector_search(
        asked, fx.search_index(t), seen=_rated_items(spark, sf_dir),
        excluded=_first_of_topic(spark, sf_dir), passed=filters.passing(t, fx.TREES),
    ).selectExpr(*RESULT)


# Text ------------------------------------------------------------------------------

def embedded_text(spark, sf_dir):
    docs = embed_text(fx.read(spark, sf_dir, "documents"), "text", "v")
    cells = docs.select("doc_id", F.posexplode("v").alias("dim", "weight"))
    return cells.where("weight > 0").select("doc_id", "dim", F.round("weight", 6).alias("weight"))


def _text_requests(spark, sf_dir):
    return fx.read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("req_id"), F.lit("documents").alias("collection"), "text", F.lit(10).alias("n")
    )


def text_search(spark, sf_dir):
    index = fx.documents_index(spark, sf_dir)
    return search.text_search(_text_requests(spark, sf_dir), index).selectExpr(*RESULT)


def multi_text_search(spark, sf_dir):
    """Benchmark texts three at a time."""
    index = fx.documents_index(spark, sf_dir)
    asked = _text_requests(spark, sf_dir).withColumn("req_id", F.floor(F.col("req_id") / 3))
    several = asked.groupBy("req_id", "collection", "n").agg(F.collect_list("text").alias("texts"))
    return search.multi_text_search(several, index).selectExpr(*RESULT)


# Relevance feedback ------------------------------------------------------------------

def _sessions(spark, sf_dir):
    """One feedback session per group; its rated items are the examples."""
    rated = _rated_items(spark, sf_dir).select(
        F.col("label").cast("long").alias("req_id"), "collection", "media_id", "quality"
    )
    emb = fx.read(spark, sf_dir, "embeddings")
    requests = emb.select(F.col("label").cast("long").alias("req_id")).distinct().select(
        "req_id", F.lit("media").alias("collection"), F.lit(None).cast("string").alias("text"),
        F.lit(10).alias("n"),
    )
    return requests, rated.where("quality = 1"), rated.where("quality = 0")


def rf_samples_random(spark, sf_dir):
    """Users without any feedback get random examples of both kinds."""
    mapped = mapping.build_index_map(fx.media_tables(spark, sf_dir))
    users = fx.read(spark, sf_dir, "events").select(F.col("user_id").alias("req_id")).distinct()
    users = users.withColumn("collection", F.lit("media"))
    drawn = feedback.random_samples(users, mapped, "42+", 1.0).unionByName(
        feedback.random_samples(users, mapped, "42-", -1.0)
    )
    return drawn.select("req_id", "index_id", "label")


def rf_samples(spark, sf_dir):
    mapped = mapping.build_index_map(fx.media_tables(spark, sf_dir))
    return feedback.feedback_samples(*_swap(_sessions(spark, sf_dir), mapped)).select(
        "req_id", "index_id", "label"
    )


def _swap(sessions, mapped):
    requests, pos, neg = sessions
    return requests, mapped, pos, neg


def rf_hyperplane(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    samples = feedback.feedback_samples(*_swap(_sessions(spark, sf_dir), mapping.build_index_map(t)))
    models = feedback.train_hyperplanes(samples, t.embeddings)
    return models.select("req_id", F.posexplode("weights").alias("dim", "weight")).select(
        "req_id", "dim", (F.round("weight", 6) + 0.0).alias("weight")
    )


def rf_search(spark, sf_dir):
    index = fx.search_index(fx.media_tables(spark, sf_dir))
    requests, pos, neg = _sessions(spark, sf_dir)
    return search.rf_search(requests, index, pos, neg).selectExpr(*RESULT)


def rf_pseudo(spark, sf_dir):
    """Benchmark texts as queries without examples: text results against random items."""
    index = fx.documents_index(spark, sf_dir)
    asked = _text_requests(spark, sf_dir)
    none = asked.where("false").select("req_id", "collection", F.col("req_id").alias("media_id"))
    return search.rf_search(asked, index, none, none).selectExpr(*RESULT)


# Approximate index ---------------------------------------------------------------------

def _ivf(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    centroids = fx.label_centroids(spark, sf_dir)
    return t, centroids, ivf.assign_cells(t.embeddings, centroids)


def _with_media(t, asked, found):
    owned = found.join(asked.select("req_id", "collection"), "req_id")
    return mapping.to_media_ids(owned, mapping.build_index_map(t)).selectExpr(*RESULT)


def ivf_cells(spark, sf_dir):
    return _ivf(spark, sf_dir)[2].select("index_id", "cell")


def _written_index(spark, centroids, assigned):
    """The index written and opened again: cells are assigned once, and a search reads those it probes."""
    folder = f"{checkpoint_dir(spark)}/ivf-{uuid.uuid4().hex}"
    ivf.write_ivf(centroids, assigned, folder)
    return ivf.read_ivf(spark, folder)


def ivf_topk(spark, sf_dir):
    t, centroids, assigned = _ivf(spark, sf_dir)
    centroids, assigned = _written_index(spark, centroids, assigned)
    asked = fx.topics(spark, sf_dir).withColumn("filter_id", F.lit(None).cast("string"))
    return _with_media(t, asked, ivf.ivf_topk(asked, centroids, assigned, nprobe=3))


def ivf_adaptive(spark, sf_dir):
    """The best cell is often excluded as a group, so one probe is rarely enough."""
    t, centroids, assigned = _ivf(spark, sf_dir)
    centroids, assigned = _written_index(spark, centroids, assigned)
    asked = fx.topics(spark, sf_dir).withColumn("filter_id", F.lit(None).cast("string"))
    skips = skip.skip_items(mapping.build_index_map(t), t.medias, excluded=_first_of_topic(spark, sf_dir))
    return _with_media(t, asked, ivf.ivf_topk(asked, centroids, assigned, nprobe=1, skips=skips, adaptive=True))


def ivf_kmeans(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    centroids, assigned = _written_index(spark, *ivf.build_ivf(t.embeddings, cells=16))
    index = fx.search_index(sources.replace(t, embeddings=assigned), centroids=centroids, nprobe=4)
    return search.vector_search(fx.topics(spark, sf_dir), index).selectExpr(*RESULT)


# Items -----------------------------------------------------------------------------------

def _all_ids(t):
    return t.medias.select("collection", "media_id")


def item_lookup(spark, sf_dir):
    """Rated documents as ids; those without an item have no row."""
    t = fx.media_tables(spark, sf_dir)
    asked = fx.read(spark, sf_dir, "labels").select(
        F.lit("media").alias("collection"), (F.col("doc_id") + 1000).alias("media_id")
    )
    return items.items(t, asked).drop("collection")


def item_base_info(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    return items.item_base_info(t, _all_ids(t)).drop("collection")


def _joined(values):
    return F.array_join(values, "|").alias("values")


def item_metadata(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    return items.item_metadata(t, _all_ids(t)).select(
        "media_id", "tagset_id", "facet", _joined(F.col("values"))
    )


def item_details(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    return items.item_details(t, _all_ids(t), [2, 3, 7]).select(
        "media_id", "tagset_id", _joined(F.col("values"))
    )


def related_items(spark, sf_dir):
    t = fx.orders_tables(spark, sf_dir)
    return items.related_items(t, _all_ids(t)).select("media_id", "related_id")


def related_metadata(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    return items.related_metadata(t, _all_ids(t), [2, 7]).select(
        "media_id", "related_id", "facet", _joined(F.col("values"))
    )


def is_excluded(spark, sf_dir):
    """Every order asks whether its customer or the next one is excluded, by turns."""
    t = fx.orders_tables(spark, sf_dir)
    asked = fx.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("req_id"), F.lit("orders").alias("collection"),
        (F.col("o_orderkey") + B).alias("media_id"),
        F.array(F.lit(11).cast("long"), F.col("o_custkey") + 1 + F.col("o_orderkey") % 2).alias("excluded_ids"),
    )
    return items.is_excluded(t, asked).select("req_id", "media_id", "excluded")


def display_metadata(spark, sf_dir):
    t = fx.orders_tables(spark, sf_dir)
    shown = items.display_metadata(items.item_details(t, _all_ids(t), [2, 3]))
    return shown.select("media_id", "facet", _joined(F.col("values")))


def item_info(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    info = items.item_info(t, _all_ids(t), [2, 4, 7])
    return info.select(
        "item_id", "thumbnail_uri", "media_uri", "group",
        F.size("metadata").alias("facets"),
        F.array_join(F.col("metadata")["activity"], "|").alias("activity"),
        F.array_join(F.col("metadata")["n_chars"], "|").alias("n_chars"),
    )


# Audit and events ----------------------------------------------------------------------------

def audit_search(spark, sf_dir):
    asked = fx.topics(spark, sf_dir)
    found = topk_batch(spark, sf_dir)
    logged = asked.select(
        "req_id", "collection", "n", F.concat(F.lit("s"), F.col("label").cast("string")).alias("session"),
        F.lit(1).alias("model_id"), F.col("lang").alias("text"), F.lit(0).alias("n_seen"),
    )
    return audit.audit_search(logged, found, "text", F.lit(1_700_000_000), F.lit(0))


def _events(spark, sf_dir, stream=None):
    """The events table, or the deliveries that arrive in the folder ``stream``."""
    raw = fx.read(spark, sf_dir, "events")
    if stream:
        raw = spark.readStream.schema(fx.SCHEMAS["events"]).parquet(stream)
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("element_id"),
        F.col("value").cast("string").alias("data"),
        F.concat(F.lit("/"), F.col("event_type")).alias("route"),
    )


def client_events_audit(spark, sf_dir):
    return audit.client_events(_events(spark, sf_dir))


def audit_items(spark, sf_dir):
    t = fx.media_tables(spark, sf_dir)
    asked = t.medias.withColumn("session", F.lit("s")).withColumn("model_id", F.lit(1)).withColumn(
        "media_type", F.col("source_type")
    )
    return audit.audit_items(asked, "item", F.lit(1_700_000_000))


def stream_audit(spark, sf_dir):
    import uuid

    # Deliveries out of time order, and all events once more: each event is in the log once, also those whose id is missing.
    folder = f"{checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    stored = fx.read(spark, sf_dir, "events")
    part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for delivery in (part == 0, part != 2, F.lit(True)):
        stored.where(delivery).write.mode("append").parquet(f"{folder}/in")
        events = _events(spark, sf_dir, stream=f"{folder}/in").withColumn(
            "event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_id")))
        start_audit_stream(events, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("day", "event_key")


def _written(spark, sf_dir):
    """The media collection, written and opened again."""
    import uuid

    folder = f"{checkpoint_dir(spark)}/collections-{uuid.uuid4().hex}"
    sources.write_collection(fx.media_tables(spark, sf_dir), folder)
    return sources.read_collection(spark, folder)


def collection_round_trip(spark, sf_dir):
    """Rows and checksums of a collection that was written and read again."""
    t = _written(spark, sf_dir)
    parts = [
        t.medias.select(F.lit("medias").alias("part"), F.col("media_id").alias("key")),
        t.taggings.select(F.lit("taggings").alias("part"), (F.col("media_id") + F.col("tag_id")).alias("key")),
        t.tag_values.select(F.lit("tag_values").alias("part"), F.col("tag_id").alias("key")),
        t.embeddings.select(F.lit("embeddings").alias("part"), F.col("index_id").alias("key")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("key").alias("key_sum"))


def read_embeddings(spark, sf_dir):
    vectors = sources.read_embeddings(spark, f"{sf_dir}/embeddings.parquet", "media", "vec_id", "embedding")
    vec = F.col("embedding").cast("array<double>")
    return vectors.select("collection", "index_id", F.size("embedding").alias("dim"),
                          (F.round(dot(vec, vec), 6) + 0.0).alias("square"))


def enabled_collections(spark, sf_dir):
    """Sources as collections: IVF where there are many documents, off where a text is toxic."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "source")
    toxic = fx.read(spark, sf_dir, "labels").where("toxic = 1")
    state = docs.join(toxic, "doc_id", "left").groupBy("source").agg(
        F.count("toxic").alias("toxic"), F.count("*").alias("n"))
    registry = state.select(
        F.col("source").alias("collection"), (F.col("toxic") < 5).alias("enabled"),
        F.when(F.col("n") >= 20, "ivf").otherwise("exact").alias("index_type"),
        F.lit("t").alias("thumbnail_media_url"), F.lit("m").alias("original_media_url"),
    )
    t = sources.replace(fx.media_tables(spark, sf_dir), collections=registry)
    return sources.enabled_collections(t).select("collection", "index_type", "needs_index")


def audit_table(spark, sf_dir):
    """Entries appended to the audit table in two writes and read back."""
    import uuid

    folder = f"{checkpoint_dir(spark)}/audit-table-{uuid.uuid4().hex}"
    events = _events(spark, sf_dir)
    for part in (0, 1):
        audit.write_audit(audit.client_events(events.where(F.col("event_id") % 2 == part)), folder)
    return spark.read.parquet(folder).drop("day")


def _users(spark, sf_dir):
    return fx.read(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session"), "user_id").distinct()


def audit_sessions(spark, sf_dir):
    """Session starts, and the total that each session was told."""
    at = F.lit(1_700_000_000)
    users = _users(spark, sf_dir).withColumn("collection", F.lit("media"))
    totals = mapping.total_items(mapping.build_index_map(fx.media_tables(spark, sf_dir)))
    return audit.audit_session(users, at).unionByName(audit.audit_total_items(users, totals, at))


def audit_catalogue(spark, sf_dir):
    """Each user reads the facets, and the values of one facet."""
    at = F.lit(1_700_000_000)
    users = _users(spark, sf_dir).withColumn("collection", F.lit("media")).withColumn(
        "tagset_id", (F.col("user_id") % 10 + 1).cast("int"))
    return audit.audit_catalogue(users, "facets", at).unionByName(audit.audit_catalogue(users, "facet_values", at))


def audit_models(spark, sf_dir):
    """Each user adds a model; every second one removes it."""
    at = F.lit(1_700_000_000)
    users = _users(spark, sf_dir).select(
        "session", "user_id", F.col("user_id").alias("model_id"), F.lit("media").alias("collection"),
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("body"))
    removed = users.where("user_id % 2 = 0")
    return audit.audit_models(users, "model_add", at).unionByName(audit.audit_models(removed, "model_remove", at))


def audit_rejected(spark, sf_dir):
    """Orders as search requests; what is wrong with them is logged."""
    kinds = F.array(*[F.lit(k) for k in ("text", "rf", "faceted", "graph", "text")])
    orders = fx.read(spark, sf_dir, "orders")
    asked = orders.select(
        F.col("o_orderkey").alias("req_id"), F.lit("media").alias("collection"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("session"),
        F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("kind"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).alias("text"),
        F.lit(None).cast("string").alias("filter_id"),
        F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(10).alias("n"),
        F.col("o_orderstatus").alias("details"), F.lit("search").alias("context"),
    )
    known = fx.media_tables(spark, sf_dir).collections
    _, rejected = search.split_requests(asked, known)
    return audit.audit_errors(rejected, F.lit(1_700_000_000))


def _set_events(events):
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session"), F.lit(1).alias("model_id"),
        F.lit("seen").alias("name"), "ts", (F.col("event_type") == "signup").alias("is_clear"),
        F.col("event_id").alias("item_id"),
    )


def item_set_state(spark, sf_dir):
    """Events add to a user's seen set; a signup clears it."""
    return fold_item_sets(_set_events(fx.read(spark, sf_dir, "events"))).select("session", "item_id")


def item_set_stream(spark, sf_dir):
    """The same sets from a stream: deliveries out of time order, and all events once more."""
    import uuid

    folder = f"{checkpoint_dir(spark)}/sets-{uuid.uuid4().hex}"
    stored = fx.read(spark, sf_dir, "events")
    part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for delivery in (part == 0, part == 2, part == 1, F.lit(True)):
        stored.where(delivery).write.mode("append").parquet(f"{folder}/in")
        events = _set_events(spark.readStream.schema(fx.SCHEMAS["events"]).parquet(f"{folder}/in"))
        stream_item_sets(events, f"{folder}/out", f"{folder}/state", every=2).awaitTermination()
    return read_item_sets(spark, f"{folder}/out").select("session", "item_id")


# Envelope --------------------------------------------------------------------------------------

def _answers(spark, sf_dir):
    t = fx.documents_tables(spark, sf_dir)
    null = F.lit(None).cast("string")
    texts = _text_requests(spark, sf_dir).select(
        "req_id", "collection", "text", "n", null.alias("filter_id"), F.lit("text").alias("kind")
    )
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "lang")
    rated = docs.join(fx.read(spark, sf_dir, "labels"), "doc_id").select(
        (fx.number_in(fx.LANGS, "lang") + B).alias("req_id"), F.lit("documents").alias("collection"),
        (F.col("doc_id") + 1000).alias("media_id"), "quality",
    )
    sessions = rated.select("req_id").distinct().select(
        "req_id", F.lit("documents").alias("collection"), null.alias("text"), F.lit(10).alias("n"),
        F.lit("spanish").alias("filter_id"), F.lit("rf").alias("kind"),
    )
    faceted = sessions.select(
        (F.col("req_id") + B).alias("req_id"), "collection", "text", F.lit(50).alias("n"),
        F.lit("long_german").alias("filter_id"), F.lit("faceted").alias("kind"),
    )
    requests = texts.unionByName(sessions).unionByName(faceted)
    return search.answer(
        requests, fx.documents_index(spark, sf_dir, t), rated.where("quality = 1"), rated.where("quality = 0"),
        filters.passing(t, fx.DOCUMENT_TREES), started=F.lit(1_700_000_000),
    )


def answer_mixed(spark, sf_dir):
    """Text, feedback and faceted requests in one batch over the documents."""
    return search.timed(_answers(spark, sf_dir), 0).selectExpr(
        "req_id", "rank", "media_id", SCORE, "strategy", "request_timestamp", "completion_time"
    )


def answer_timed(spark, sf_dir):
    """The batch of ``answer_mixed`` with its measured time, which is held against the clock around it."""
    started = time.monotonic()
    done = search.write_timed(_answers(spark, sf_dir), f"{checkpoint_dir(spark)}/answers-{uuid.uuid4().hex}")
    most = math.ceil(1000 * (time.monotonic() - started))
    within = F.col("elapsed_ms").between(1, most) & (F.col("completion_time") <= F.col("elapsed_ms") / 1000)
    return done.groupBy("strategy").agg(F.count("*").alias("results"), F.bool_and(within).alias("measured"))


QUERIES = {
    "total_items": total_items,
    "list_collections": list_collections,
    "index_map": index_map,
    "key_mapping": key_mapping,
    "group_medias": group_medias,
    "validate_collection": validate_collection,
    "tag_types": tag_types,
    "facets": facets,
    "facet_values": facet_values,
    "filter_any": _tree(fx.TREES["lang_any"]),
    "filter_all": _tree(fx.TREES["click_and_view"]),
    "filter_range": _tree(fx.TREES["chars"]),
    "filter_range_open": _trees(OPEN_RANGES),
    "filter_not": _tree(fx.TREES["not_en"]),
    "filter_nested": _tree(fx.TREES["nested"]),
    "filter_empty_identities": _trees(IDENTITIES),
    "filter_group_expansion": _tree(fx.TREES["even"]),
    "filter_batch": _trees(fx.TREES),
    "filter_programs": filter_programs,
    "applied_filters": applied_filters,
    "faceted_search": faceted_search,
    "dot_product": self_dot,
    "l2_normalize": l2_normalized,
    "topk_single": topk_single,
    "topk_batch": topk_batch,
    "topk_skip_seen": topk_skip_seen,
    "topk_excluded_groups": topk_excluded_groups,
    "expand_excluded": expand_excluded,
    "topk_filtered": topk_filtered,
    "topk_all_limits": topk_all_limits,
    "embed_text": embedded_text,
    "text_search": text_search,
    "multi_text_search": multi_text_search,
    "rf_samples_random": rf_samples_random,
    "rf_samples": rf_samples,
    "rf_hyperplane": rf_hyperplane,
    "rf_search": rf_search,
    "rf_pseudo": rf_pseudo,
    "ivf_cells": ivf_cells,
    "ivf_topk": ivf_topk,
    "ivf_adaptive": ivf_adaptive,
    "ivf_kmeans": ivf_kmeans,
    "item_lookup": item_lookup,
    "item_base_info": item_base_info,
    "item_metadata": item_metadata,
    "item_details": item_details,
    "related_items": related_items,
    "related_metadata": related_metadata,
    "is_excluded": is_excluded,
    "display_metadata": display_metadata,
    "item_info": item_info,
    "audit_search": audit_search,
    "audit_items": audit_items,
    "client_events_audit": client_events_audit,
    "stream_audit": stream_audit,
    "collection_round_trip": collection_round_trip,
    "read_embeddings": read_embeddings,
    "enabled_collections": enabled_collections,
    "audit_table": audit_table,
    "audit_sessions": audit_sessions,
    "audit_catalogue": audit_catalogue,
    "audit_models": audit_models,
    "audit_rejected": audit_rejected,
    "item_set_state": item_set_state,
    "item_set_stream": item_set_stream,
    "answer_mixed": answer_mixed,
    "answer_timed": answer_timed,
}
