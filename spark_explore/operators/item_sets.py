"""State of named item sets (seen, excluded) from their add and clear events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.sizing import small_side

KEY = ["session", "model_id", "name"]


def item_set_state(events: DataFrame) -> DataFrame:
    """``(session, model_id, name, item_id)`` added after the set's last clear.

    ``events``: ``(session, model_id, name, ts, is_clear, item_id)``. The last
    clear is a map-side combined maximum, so one busy set never sorts in a task.
    """
    cleared = events.where("is_clear").groupBy(*KEY).agg(F.max("ts").alias("cleared_at"))
    added = events.where(~F.col("is_clear"))
    return (
        added.join(small_side(cleared), KEY, "left")
        .where(F.col("cleared_at").isNull() | (F.col("ts") > F.col("cleared_at")))
        .select(*KEY, "item_id").distinct()
    )
