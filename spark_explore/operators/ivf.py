"""Approximate search: vectors grouped in cells, a request probes its best cells."""

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.operators import topk
from spark_explore.operators.topk import DECIMALS, Skips, top_items
from spark_explore.sizing import cut_lineage, local_table

PROBES = 64
MAX_CENTROIDS = 200_000


def train_centroids(embeddings: DataFrame, cells: int, seed: int = 42) -> DataFrame:
    """``(cell, centroid)`` by distributed k-means over all vectors."""
    vectors = embeddings.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(vectors)
    centers = [{"cell": i, "centroid": c.tolist()} for i, c in enumerate(model.clusterCenters())]
    return local_table(embeddings.sparkSession, centers, "cell long, centroid array<double>")


def assign_cells(embeddings: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add ``cell``: the centroid with the best dot product, ties to the lower cell."""
    if centroids.count() > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} cells")
    table = centroids.toArrow().combine_chunks().sort_by("cell")
    cells = table["cell"].to_numpy()
    matrix = np.stack(table["centroid"].to_numpy(zero_copy_only=False)).astype(np.float64)
    shared = embeddings.sparkSession.sparkContext.broadcast((cells, matrix))

    @F.arrow_udf("long")
    def best_cell(vectors: pa.Array) -> pa.Array:
        numbers, centers = shared.value
        rows = vectors.flatten().to_numpy(zero_copy_only=False)
        rows = rows.reshape(len(vectors), -1).astype(np.float64)
        step = max(1, 4_000_000 // len(numbers))
        best = [
            numbers[np.argmax(np.round(rows[i:i + step] @ centers.T, DECIMALS), axis=1)]
            for i in range(0, len(rows), step)
        ]
        return pa.array(np.concatenate(best) if best else [], pa.int64())

    return embeddings.where(F.col("embedding").isNotNull()).withColumn("cell", best_cell("embedding"))


def build_ivf(embeddings: DataFrame, cells: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train the cells and assign every vector: ``(centroids, assigned)``."""
    centroids = train_centroids(embeddings, cells, seed)
    return centroids, assign_cells(embeddings, centroids)


def write_ivf(centroids: DataFrame, assigned: DataFrame, folder: str) -> None:
    """Write the index; vectors lie in folders of neighbouring cells, clustered by cell.

    Probes name the folders they need, however many cells a batch asks for. The
    second range key splits a cell that holds a large share of the vectors.
    """
    centroids.write.parquet(f"{folder}/centroids")
    (
        assigned.withColumn("embedding", F.col("embedding").cast("array<float>"))
        .withColumn("cell_bucket", F.floor(F.col("cell") / topk.CELLS_PER_BUCKET))
        .repartitionByRange("collection", "cell", "index_id")
        .sortWithinPartitions("collection", "cell", "index_id")
        .write.partitionBy("collection", "cell_bucket").parquet(f"{folder}/vectors")
    )


def read_ivf(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    schema = "collection string, cell_bucket long, index_id long, embedding array<float>, cell long"
    if "group_id" in spark.read.parquet(f"{folder}/vectors").columns:
        schema += ", group_id long"
    return (
        spark.read.schema("cell long, centroid array<double>").parquet(f"{folder}/centroids"),
        spark.read.schema(schema).parquet(f"{folder}/vectors"),
    )


def probe_cells(requests: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """``(req_id, cell, rank)``: the cells a request looks at, best first."""
    book = centroids.select(
        F.lit("book").alias("collection"), F.col("cell").alias("index_id"), F.col("centroid").alias("embedding")
    )
    asked = requests.select(
        F.lit("book").alias("collection"), "req_id", "query_vec", F.lit(nprobe).alias("n"),
        F.lit(None).cast("string").alias("filter_id"),
    )
    found = top_items(book, asked, ["collection"])
    return found.select("req_id", F.col("index_id").alias("cell"), "rank")


def ivf_topk(
    requests: DataFrame,
    centroids: DataFrame,
    assigned: DataFrame,
    nprobe: int = PROBES,
    skips: Skips | None = None,
    passed: DataFrame | None = None,
    adaptive: bool = False,
) -> DataFrame:
    """Best items of each request among the cells it probes.

    ``adaptive``: requests with fewer than ``n`` items go on until they have
    looked in twice as many cells, again and again, until satisfied or all cells
    are searched. A round holds only the requests still short and reads only
    cells that they have not visited; what they have found so far is kept.
    Filter bitmaps are made once for all rounds.
    """
    short = cut_lineage(requests.select("req_id", "collection", "query_vec", "n", "filter_id"))
    cells = centroids.count()
    # A request counts once per probed cell here, and a task meets few cells, so more
    # probes may be shared than in an exact search, as far as their vectors allow.
    dim = short.where(F.col("query_vec").isNotNull()).select(F.size("query_vec")).first()
    room = min(8 * topk.SHARED_PROBES, topk.SHARED_BYTES // (8 * max(1, dim[0] if dim else 1)))
    if not adaptive:
        return top_items(assigned, short.join(probe_cells(short, centroids, nprobe).drop("rank"), "req_id"), ["collection", "cell"], skips, passed, room)
    if passed is not None:
        passed = topk.Masks.of(passed, short.select("filter_id"))
    deepest = short.agg(F.max("n")).first()[0] or 0
    answers, kept, visited = [], None, 0
    while True:
        fresh = probe_cells(short, centroids, nprobe).where(F.col("rank") > visited).drop("rank")
        found = top_items(assigned, short.join(fresh, "req_id"), ["collection", "cell"], skips, passed, room)
        if kept is not None:
            found = topk.best_of(kept.unionByName(found), short, deepest)
        found = cut_lineage(found)
        got = found.groupBy("req_id").agg(F.count("*").alias("got"))
        lacking = F.coalesce("got", F.lit(0)) < F.col("n")
        if nprobe >= cells:
            answers.append(found)
            break
        missing = cut_lineage(short.join(got, "req_id", "left").where(lacking).drop("got"))
        answers.append(found.join(missing.select("req_id"), "req_id", "left_anti"))
        if missing.isEmpty():
            break
        kept = found.join(missing.select("req_id"), "req_id", "left_semi")
        short, visited, nprobe = missing, nprobe, nprobe * 2
    result = answers[0]
    for answer in answers[1:]:
        result = result.unionByName(answer)
    return result
