"""Exact similarity of candidate pairs on their full sets of 64-bit hashes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 24  # of the bitmap that keeps rows without candidates out of the set building
SALTS = 64  # blocks of the pairs of one ``a``


def spot(column: str):
    """The place of an id in the bitmap."""
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def key_spots(keys: np.ndarray) -> np.ndarray:
    """The places of keys that are hashes already (``direct``)."""
    return keys & (FILTER_BITS - 1)


def bitmap(ids: DataFrame, direct: bool = False) -> np.ndarray:
    """Marks the places of all ``id``; of fixed size, so very many ids fill it and it lets more through."""
    at = (F.col("id").bitwiseAND(F.lit(FILTER_BITS - 1)) if direct else spot("id")) + 1  # the SQL functions count from 1
    parts = ids.select(at.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for part, own in parts:
        bits[(part - 1) * 4096:part * 4096] = np.frombuffer(own, np.uint8)
    return bits


def in_bitmap(bits: bytes, spots: np.ndarray) -> pa.Array:
    held = np.frombuffer(bits, np.uint8)
    return pa.array(((held[spots // 8] >> (spots % 8).astype(np.uint8)) & 1).astype(bool))


def set_bytes(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Adjacent sets as an Arrow array of binaries."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [
        None, pa.py_buffer(bounds.astype(np.int64) * 8), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def confirmed_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets (``id``, ``shingles``: sorted uint64) have 100 * intersection >= percent * union.

    A set travels once per pair as ``b`` and once per block of pairs as ``a``.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    members = salted.join(sets, F.col("b") == F.col("id")).select("a", "salt", "b", "shingles")
    firsts = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("id")).select(
        "a", "salt", F.lit(None).cast("long").alias("b"), "shingles")

    def compare(batches):
        own, one = None, None
        for batch in batches:
            left, right = [], []
            column = batch.column("shingles")
            for i, (a, salt, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")))):
                values = np.frombuffer(column[i].as_buffer(), np.uint64)
                if b is None:
                    own, one = (a, salt), values.copy()
                elif own == (a, salt):
                    at = np.minimum(np.searchsorted(one, values), len(one) - 1)
                    both = int((one[at] == values).sum())
                    if 100 * both >= percent * (len(one) + len(values) - both):
                        left.append(a), right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    runs = members.unionByName(firsts).repartition("a", "salt").sortWithinPartitions(
        "a", "salt", F.col("b").asc_nulls_first())
    return runs.mapInArrow(compare, "a long, b long")
