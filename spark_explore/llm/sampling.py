"""Bounded samples of rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BITS = 40  # of the hash that orders rows


def hash_sample(rows: DataFrame, count: int, *by: str) -> DataFrame:
    """The ``count`` rows of smallest hash of the columns ``by`` (all rows, if fewer).

    Rows are thinned out first, below the smallest power of two that leaves enough of them (about twice as many as needed, if the
    hashes differ), so that what the tasks send to the driver doesn't grow with their number.
    """
    key = F.pmod(F.xxhash64(*by), F.lit(1 << BITS))
    below = rows.agg(*(F.count_if(key < F.lit(1 << b)).alias(f"below_{b}") for b in range(BITS + 1))).first()
    bits = next((b for b in range(BITS) if below[b] >= count), BITS)
    return rows.where(key < F.lit(1 << bits)).orderBy(key, *by).limit(count)
