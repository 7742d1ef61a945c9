"""Size checks before a broadcast, and lineage cuts that survive lost executors."""

import tempfile
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

# Bounds of a broadcast side: rows, and bytes of its values.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def checkpoint_dir(spark) -> str:
    """The shared folder of the session; a temporary one only in local mode, where none is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-explore-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    cut = df.checkpoint(eager=True)
    cut._is_cut = True
    return cut


@contextmanager
def shuffles_removed(spark):
    """Within it, a query's shuffle files go when the query ends, not when the driver's garbage collector finds them.

    For steps that write what they go on with: the same DataFrame must not run twice.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _value_bytes(field):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(field.dataType, ArrayType):
        each = 32 if isinstance(field.dataType.elementType, StringType) else 8
        return F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) * each + 16
    return F.lit(16)


def size_of(df: DataFrame) -> tuple[int, int]:
    """Rows and about the bytes of a materialised side, summed per task first."""
    width = sum((_value_bytes(f) for f in df.schema.fields), F.lit(0)).cast("long")
    return df.select(width.alias("bytes")).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, written once, with a broadcast hint if its rows and bytes allow one.

    Without the hint the join shuffles and AQE splits its skewed partitions.
    """
    if not getattr(df, "_is_cut", False):
        df = cut_lineage(df)
    rows, size = size_of(df)
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def local_table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A few driver-made rows as a local relation (no job, no Python rows)."""
    table = pa.Table.from_pylist(rows) if rows else None
    return spark.createDataFrame(table if rows else [], schema)
