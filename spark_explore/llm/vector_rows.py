"""Vectors as rows: which take part, pivots, blocks and the best of each query."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_explore.llm.sampling import hash_sample

LEVEL = 64  # partial rankings of one query


def valid_vectors(df: DataFrame, vec_id: str, vector: str, zero: bool) -> DataFrame:
    """vec_id and the vector as doubles, where nothing is null or not finite (nor, unless ``zero``, everything zero)."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    if not zero:
        good = good & F.exists(v, lambda x: x != 0)
    return df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where(
        good & F.col("vec_id").isNotNull())


def pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """Up to ``count`` distinct vectors of a sample of ``4 * count`` rows (those of the smallest hashes of id and vector).

    They have the length that most of all rows have (of equally frequent ones the smallest).
    """
    length = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return np.empty((0, 0))
    rows = hash_sample(vectors.where(F.size("v") == length["n"]), 4 * count, "vec_id", "v").select("v").collect()
    return np.array(list(dict.fromkeys(tuple(r[0]) for r in rows))[:count], np.float64)


def matrix(column) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller vec_id; ranked in parts first."""
    order = [F.desc("score"), "vec_id"]
    part = found.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(LEVEL)))
    for keys in (("query_id", "part"), ("query_id",)):
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return part.select("query_id", "rank", "vec_id", "score")
