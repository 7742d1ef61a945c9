"""Relevance feedback: one linear separator per request, then a search along it."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.functions.vectors import dot
from spark_explore.operators.mapping import to_index_ids, with_numbers
from spark_explore.sizing import cut_lineage, small_side

RANDOM_SAMPLES = 5
DRAWS = 64

# Fixed values of the trainer: rounds and regularisation of the hinge loss.
ROUNDS = 20
LAMBDA = 0.01

# Larger sample sets are trained by aggregation instead of inside one task.
SAMPLES_PER_TASK = 20_000

WEIGHTS = "req_id long, weights array<double>"


def random_samples(requests: DataFrame, index_map: DataFrame, seed: str, label: float) -> DataFrame:
    """Five distinct random items for each request, reproducible from ``seed``; all, where a collection has fewer.

    Items are drawn by hashed number among the mapped items and only then looked
    up: no request meets the whole collection. A mapping that carries ``number``
    (``mapping.with_numbers``) is neither sorted nor written for it, and nothing
    is read where no request asks. Up to ``DRAWS`` items, all are
    put into hashed order instead, so five are always found.
    """
    asked = cut_lineage(requests.select("req_id", "collection"))
    if asked.isEmpty():
        nothing = index_map.where("false").select("collection", "index_id")
        return asked.join(nothing, "collection").select("req_id", "collection", "index_id").withColumn("label", F.lit(label))
    if "number" not in index_map.columns:
        index_map = with_numbers(index_map)
    totals = small_side(index_map.groupBy("collection").agg((F.max("number") + 1).alias("total_items")))

    def hashed(i):
        digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("req_id").cast("string"), i.cast("string")))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    drawn = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.lit(DRAWS)), lambda i: hashed(i) % F.col("total_items")))
    every = F.transform(
        F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("total_items") - 1),
                                 lambda i: F.struct(hashed(i).alias("h"), i.alias("i")))), lambda s: s["i"])
    chosen = F.when(F.col("total_items") > DRAWS, drawn).otherwise(every)
    picked = asked.join(totals, "collection").select(
        "req_id", "collection", F.explode(F.slice(chosen, 1, RANDOM_SAMPLES)).alias("number"))
    return index_map.select("collection", "number", "index_id").join(small_side(picked), ["collection", "number"]).select(
        "req_id", "collection", "index_id").distinct().withColumn("label", F.lit(label))


def feedback_samples(
    requests: DataFrame,
    index_map: DataFrame,
    positives: DataFrame,
    negatives: DataFrame,
    pseudo: DataFrame | None = None,
    seed: str = "42",
) -> DataFrame:
    """``(req_id, collection, index_id, label)`` with label +1 or -1.

    requests   ``(req_id, collection, text)``; ``text`` null: no query given
    positives, negatives, pseudo  ``(req_id, collection, media_id)``

    Pseudo-relevant items join the positives and may repeat them, which weights
    them. A request with neither positives nor text gets random positives, one
    without negatives random negatives. A request whose positives stay empty
    has no separator and returns nothing.
    """
    pos = positives.select("req_id", "collection", "media_id")
    if pseudo is not None:
        pos = pos.unionByName(pseudo.select("req_id", "collection", "media_id"))
    no_pos = requests.where(F.col("text").isNull()).join(pos, "req_id", "left_anti")
    no_neg = requests.join(negatives, "req_id", "left_anti")
    neg = negatives.select("req_id", "collection", "media_id")
    return (
        to_index_ids(small_side(pos), index_map).withColumn("label", F.lit(1.0))
        .unionByName(random_samples(no_pos, index_map, seed + "+", 1.0))
        .unionByName(to_index_ids(small_side(neg), index_map).withColumn("label", F.lit(-1.0)))
        .unionByName(random_samples(no_neg, index_map, seed + "-", -1.0))
    )


def with_vectors(samples: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Samples with their vectors; a small sample set leaves the vectors unshuffled."""
    return embeddings.select("collection", "index_id", "embedding").join(
        small_side(samples), ["collection", "index_id"]
    )


def _train_one(samples: pd.DataFrame) -> pd.DataFrame:
    y = samples["label"].to_numpy()
    x = np.stack(samples["embedding"].to_numpy()).astype(np.float64)
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for k in range(1, ROUNDS + 1):
        wrong = y * (x @ w) < 1
        w = (1 - 1 / k) * w + (y[wrong] @ x[wrong]) / (LAMBDA * k * len(y))
    return pd.DataFrame({"req_id": [samples["req_id"].iloc[0]], "weights": [w]})


def _train_large(samples: DataFrame) -> DataFrame:
    """The same rounds as DataFrame steps, for requests with any number of samples.

    Each round sums the violating samples per request with map-side partials, so
    a request holding most of the samples is spread over all tasks.
    """
    x = F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(1.0)))
    rows = cut_lineage(samples.select("req_id", "label", x.alias("x")))
    width = rows.select(F.size("x")).first()[0]
    sizes = rows.groupBy("req_id").agg(F.count("*").alias("m"))
    model = cut_lineage(sizes.withColumn("weights", F.array_repeat(F.lit(0.0), width)))
    for k in range(1, ROUNDS + 1):
        wrong = rows.join(small_side(model), "req_id").where(
            F.col("label") * dot(F.col("x"), F.col("weights")) < 1
        )
        pulls = wrong.groupBy("req_id").agg(
            F.array(*[F.sum(F.col("label") * F.col("x")[j]) for j in range(width)]).alias("pull")
        )
        step = F.lit(1.0) / (F.lit(LAMBDA * k) * F.col("m"))
        moved = F.zip_with(
            "weights",
            F.coalesce("pull", F.array_repeat(F.lit(0.0), width)),
            lambda w, g: w * (1 - 1 / k) + g * F.col("step"),
        )
        model = cut_lineage(
            model.join(pulls, "req_id", "left").withColumn("step", step)
            .select("req_id", "m", moved.alias("weights"))
        )
    return model.select("req_id", "weights")


def train_hyperplanes(samples: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``(req_id, weights)``: full-batch hinge-loss separators, bias last.

    ``samples``: ``(req_id, collection, index_id, label)``. Requests without a
    positive sample are dropped.
    """
    samples = cut_lineage(samples)
    sizes = samples.groupBy("req_id").agg(F.count("*").alias("m"), F.max("label").alias("best"))
    sizes = cut_lineage(sizes.where(F.col("best") > 0).drop("best"))
    largest = sizes.agg(F.max("m")).first()[0] or 0
    ids = small_side(sizes)
    within = F.col("m") <= SAMPLES_PER_TASK
    models = (
        with_vectors(samples.join(ids.where(within), "req_id"), embeddings)
        .select("req_id", "label", "embedding")
        .groupBy("req_id").applyInPandas(_train_one, WEIGHTS)
    )
    if largest <= SAMPLES_PER_TASK:
        return cut_lineage(models)
    rest = with_vectors(samples.join(ids.where(~within), "req_id"), embeddings)
    return cut_lineage(models.unionByName(_train_large(rest)))


def hyperplane_requests(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Requests with the separator's direction as their query vector (bias dropped)."""
    direction = F.slice("weights", 1, F.size("weights") - 1)
    return requests.drop("query_vec").join(
        models.select("req_id", direction.alias("query_vec")), "req_id"
    )
