"""Item sets (seen, excluded) kept from a stream of add and clear events.

The state is a table beside the stream: one folder of reduced events per micro-batch, and from time to time a snapshot that
folds all before it. An add keeps its latest time and a set its latest clear, whatever order they come in, so late events and
events delivered again fold to the same state. A micro-batch that runs twice, after a failure, writes its own folder anew.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spark_explore.operators.item_sets import KEY

FIELDS = [*KEY, "ts", "is_clear", "item_id"]
SNAPSHOT_EVERY = 16


def reduced(events: DataFrame) -> DataFrame:
    """The last clear of each set and the last add of each item after it; map-side combined, so a busy set fills no task.

    Events without a time or without a kind are dropped, as they have no place in the order.
    """
    events = events.select(*FIELDS).where("ts IS NOT NULL AND is_clear IS NOT NULL")
    item = F.when(~F.col("is_clear"), F.col("item_id"))
    last = events.withColumn("item_id", item).where("is_clear OR item_id IS NOT NULL").groupBy(*KEY, "is_clear", "item_id").agg(
        F.max("ts").alias("ts"))
    cleared = last.where("is_clear").select(*(F.col(c).alias(f"of_{c}") for c in KEY), F.col("ts").alias("cleared_at"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in KEY]
    kept = last.where("NOT is_clear").join(cleared, same, "left").where("cleared_at IS NULL OR ts > cleared_at")
    return kept.select(*FIELDS).unionByName(last.where("is_clear").select(*FIELDS))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None


def _events(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest whole snapshot and the batches after it, up to number ``before``."""
    marks = _read(spark, f"{folder}/marks")
    if marks is not None and before is not None:
        marks = marks.where(F.col("upto") < before)
    upto = None if marks is None else marks.agg(F.max("upto")).first()[0]
    parts = [] if upto is None else [spark.read.parquet(f"{folder}/snapshots/upto={upto}")]
    log = _read(spark, f"{folder}/log")
    if log is not None:
        after = F.col("batch") > (-1 if upto is None else upto)
        parts.append(log.where(after if before is None else after & (F.col("batch") <= before)))
    if not parts:
        return None
    events = parts[0].select(*FIELDS)
    return events.unionByName(parts[1].select(*FIELDS)) if len(parts) > 1 else events


def fold_batch(batch: DataFrame, number: int, folder: str, every: int = SNAPSHOT_EVERY) -> None:
    """Write the events of a micro-batch, and each ``every`` batches a snapshot; it is marked only once it is whole."""
    spark = batch.sparkSession
    reduced(batch).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
    if number % every == every - 1:
        reduced(_events(spark, folder, number)).write.mode("overwrite").parquet(f"{folder}/snapshots/upto={number}")
        spark.range(1).select(F.lit(number).alias("upto")).write.mode("append").parquet(f"{folder}/marks")


def stream_item_sets(events: DataFrame, folder: str, checkpoint: str, every: int = SNAPSHOT_EVERY, **trigger) -> StreamingQuery:
    """Keep the sets of ``events`` (session, model_id, name, ts, is_clear, item_id) in ``folder``."""
    return (
        events.writeStream.foreachBatch(lambda batch, number: fold_batch(batch, number, folder, every))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_item_sets(spark: SparkSession, folder: str) -> DataFrame:
    """``(session, model_id, name, item_id)`` as of the last micro-batch; a folder without one is an error."""
    events = _events(spark, folder)
    if events is None:
        raise FileNotFoundError(f"no item sets in {folder}")
    return reduced(events).where("NOT is_clear").select(*KEY, "item_id").distinct()
