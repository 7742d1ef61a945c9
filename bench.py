"""Headline searches on prepared collections; prints one JSON line.

Collections are written once, as a user would load them; the queries then run
on the written tables. Each query runs once cold and twice warm; the warm best
counts. ``cold`` and ``prepare_sec`` are reported beside it.
"""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from registry import fixtures as fx
from spark_explore.functions.encode import embed_text
from spark_explore.functions.vectors import mean_vector
from spark_explore.operators import audit, filters, items, ivf, mapping
from spark_explore.plans import search
from spark_explore.sources.collections import read_collection, replace, write_collection

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("spark_explore bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark, folder):
    """Write the three collections, their mappings and the IVF index."""
    loaded = {}
    # The given texts are one file; as files of a cluster table they are read by all cores.
    fx.read(spark, SF_DIR, "documents").repartition(int(CPUS) * 2).write.parquet(f"{folder}/documents.parquet")
    for name in ("embeddings", "labels", "events", "orders", "benchmark"):
        fx.read(spark, SF_DIR, name).write.parquet(f"{folder}/{name}.parquet")
    for name, make in (("media", fx.media_tables), ("orders", fx.orders_tables), ("documents", fx.documents_tables)):
        write_collection(make(spark, folder), f"{folder}/{name}", mode="ignore")
        tables = read_collection(spark, f"{folder}/{name}")
        if tables.embeddings is not None:
            mapping.with_numbers(mapping.build_index_map(tables)).write.parquet(f"{folder}/{name}/index_map")
            index = search.SearchIndex(
                tables.embeddings, spark.read.parquet(f"{folder}/{name}/index_map"), tables.medias
            )
        else:
            index = None
        loaded[name] = (tables, index)
    centroids, assigned = ivf.build_ivf(loaded["media"][1].embeddings, cells=32)
    ivf.write_ivf(centroids, assigned, f"{folder}/ivf")
    return loaded


def main():
    spark = session()
    folder = tempfile.mkdtemp(prefix="bench-")
    started = time.time()
    loaded = prepare(spark, folder)
    prepare_sec = time.time() - started
    media, media_index = loaded["media"]
    documents_index = loaded["documents"][1]
    orders = loaded["orders"][0]
    centroids, assigned = ivf.read_ivf(spark, f"{folder}/ivf")
    ivf_index = replace(media_index, embeddings=assigned, centroids=centroids, nprobe=8)

    # One search and one feedback session per group and document source.
    docs = fx.read(spark, SF_DIR, "documents").select("doc_id", "source")
    emb = fx.read(spark, SF_DIR, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"))
    emb = emb.withColumn("req_id", F.col("label").cast("long") * 100 + F.substring("source", 4, 9).cast("long"))
    requests = emb.groupBy("req_id").agg(mean_vector("embedding", fx.DIM).alias("query_vec")).select(
        "req_id", F.lit("media").alias("collection"), "query_vec", F.lit(10).alias("n")
    )
    rated = emb.join(fx.read(spark, SF_DIR, "labels"), "doc_id").select(
        "req_id", F.lit("media").alias("collection"), (F.col("vec_id") + 1000).alias("media_id"), "quality"
    )
    sessions = requests.drop("query_vec").withColumn("text", F.lit(None).cast("string"))
    texts = fx.read(spark, SF_DIR, "benchmark").select(
        F.col("item_id").alias("req_id"), F.lit("documents").alias("collection"), "text", F.lit(10).alias("n")
    )
    trees = list(fx.ORDER_TREES)
    facet_requests = spark.range(len(trees)).select(
        F.col("id").alias("req_id"), F.lit("orders").alias("collection"),
        F.element_at(F.array(*map(F.lit, trees)), F.col("id").cast("int") + 1).alias("filter_id"), F.lit(100).alias("n"),
    )
    queries = {
        "topk_batch": lambda: search.vector_search(requests, media_index),
        "topk_limits": lambda: search.vector_search(
            requests.withColumn("filter_id", F.lit("nested")), media_index, seen=rated,
            passed=filters.passing(media, fx.TREES)),
        "ivf_topk": lambda: search.vector_search(requests, ivf_index),
        "text_search": lambda: search.text_search(texts, documents_index),
        "rf_search": lambda: search.rf_search(
            sessions, media_index, rated.where("quality = 1"), rated.where("quality = 0")),
        "faceted_search": lambda: filters.faceted_search(facet_requests, filters.passing(orders, fx.ORDER_TREES)),
        "embed_text": lambda: embed_text(fx.read(spark, folder, "documents"), "text").select("doc_id", "query_vec"),
        "item_metadata": lambda: items.item_metadata(orders, orders.medias, [2, 3, 4]),
        "client_events": lambda: audit.client_events(fx.read(spark, SF_DIR, "events").select(
            F.concat(F.lit("u"), "user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_type").alias("action"), F.get_json_object("props", "$.k").alias("element_id"),
            F.col("value").cast("string").alias("data"), F.lit("/").alias("route"))),
    }
    warm, cold = {}, {}
    for name, query in queries.items():
        times = []
        for _ in range(3):
            started = time.time()
            query().write.format("noop").mode("overwrite").save()
            times.append(round(time.time() - started, 3))
        cold[name], warm[name] = times[0], min(times[1:])
        print(name, times, file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of warm query times", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "prepare_sec": round(prepare_sec, 1),
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(CPUS), "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
