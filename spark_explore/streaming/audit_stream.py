"""Client events as a stream into the audit table."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spark_explore.operators.audit import client_events
from spark_explore.sizing import cut_lineage


def with_event_key(batch: DataFrame, key: str) -> DataFrame:
    """The events with ``event_key``. One without a key is known by its content and by which of the equal events of its batch it is:
    equal events of one batch are all kept, and those of a later batch count as delivered again."""
    own = F.col(f"`{key}`")
    known = batch.where(own.isNotNull()).withColumn("event_key", own.cast("string"))
    copies = batch.where(own.isNull()).groupBy(*(f"`{c}`" for c in batch.columns)).agg(F.count("*").alias("__copies"))
    content = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in batch.columns))), 256)
    loose = copies.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "__copies")).alias("__no")).withColumn(
        "event_key", F.concat_ws("-", F.lit("content"), content, "__no"))
    return known.unionByName(loose.drop("__copies", "__no"))


def append_new(batch: DataFrame, folder: str, key: str) -> None:
    """Append the entries of a micro-batch that the audit table does not hold yet.

    An event is known by its key within its day, however late it arrives: only
    the days of the batch are read again; events without a time have a day of
    their own. A batch that runs twice, after a failure, adds nothing the second time.
    """
    spark = batch.sparkSession
    entries = client_events(with_event_key(batch, key), "event_key").withColumn(
        "day", F.to_date(F.timestamp_seconds("timestamp"))
    ).dropDuplicates(["day", "event_key"])
    entries = cut_lineage(entries)
    days = [r.day for r in entries.select("day").distinct().collect()]
    try:
        known = spark.read.parquet(folder).where(
            F.col("day").isin(*[d for d in days if d]) | (F.col("day").isNull() & F.lit(None in days))
        ).select(F.col("day").alias("known_day"), F.col("event_key").alias("known_key"))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        known = None  # nothing is written yet
    if known is not None:
        entries = entries.join(
            known, F.col("day").eqNullSafe(F.col("known_day")) & (F.col("event_key") == F.col("known_key")), "left_anti")
    entries.write.mode("append").partitionBy("day").parquet(folder)


def stream_audit(
    events: DataFrame, folder: str, checkpoint: str, key: str = "event_id", **trigger,
) -> StreamingQuery:
    """Start the append to ``folder``; ``checkpoint`` makes it restart where it stopped.

    An event that is delivered again is written once; a new event is written
    whenever it comes, also long after later ones.
    """
    return (
        events.writeStream.foreachBatch(lambda batch, _: append_new(batch, folder, key))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
