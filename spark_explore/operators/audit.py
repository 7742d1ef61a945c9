"""Audit entries: what was asked, by whom, and what came back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_explore.sizing import small_side

ENTRY = "timestamp long, session string, action string, data string, completion_time long"

# Action names of the entries (fixed values).
ACTIONS = {
    "session": "Initialize Session",
    "total": "Get Total Items",
    "text": "Text Search",
    "rf": "RF Search",
    "faceted": "Faceted Search",
    "item": "Get Info For Item",
    "details": "Get Detailed Info For Item",
    "related": "Get Related Info For Item",
    "excluded": "Check if item is in excluded group",
    "facets": "Get filter definitions for collection",
    "facet_values": "Get filter values for collection",
    "model_add": "Log Add Model",
    "model_remove": "Log Remove Model",
    "error": "Error",
}


def audit_entries(
    df: DataFrame,
    action: Column | str,
    data: list,
    timestamp: Column | None = None,
    completion_time: Column | None = None,
    more: list | None = None,
) -> DataFrame:
    """Audit rows of ``df``: ``data`` columns as JSON, time now unless given.

    A completion time of zero is left out, like a missing one. ``more`` columns
    follow those of the log.
    """
    action = F.lit(ACTIONS.get(action, action)) if isinstance(action, str) else action
    zero = F.lit(0).cast("long")
    spent = F.lit(None).cast("long") if completion_time is None else completion_time.cast("long")
    return df.select(
        (F.unix_timestamp() if timestamp is None else timestamp).cast("long").alias("timestamp"),
        F.col("session").cast("string").alias("session"),
        action.alias("action"),
        F.to_json(F.struct(*data)).alias("data"),
        F.nullif(spent, zero).alias("completion_time"),
        *(more or []),
    )


def audit_session(sessions: DataFrame, timestamp: Column | None = None) -> DataFrame:
    return audit_entries(sessions, "session", ["session"], timestamp)


def audit_total_items(requests: DataFrame, totals: DataFrame, timestamp: Column | None = None) -> DataFrame:
    counted = requests.join(small_side(totals), "collection")
    return audit_entries(counted, "total", ["collection", "total_items"], timestamp)


def audit_catalogue(requests: DataFrame, kind: str, timestamp: Column | None = None) -> DataFrame:
    """Catalogue reads (``facets`` or ``facet_values``) belong to model 0."""
    extra = ["tagset_id"] if kind == "facet_values" else []
    return audit_entries(requests, kind, [F.lit(0).alias("model_id"), "collection", *extra], timestamp)


def audit_items(requests: DataFrame, kind: str, timestamp: Column | None = None) -> DataFrame:
    """Item reads; ``media_type`` and ``excluded`` are logged where present."""
    extra = [c for c in ("media_type", "excluded") if c in requests.columns]
    data = ["model_id", "collection", F.col("media_id").alias("item_id"),
            F.col("media_id").cast("string").alias("name"), *extra]
    return audit_entries(requests, kind, data, timestamp)


def audit_models(requests: DataFrame, kind: str, timestamp: Column | None = None) -> DataFrame:
    """Model additions and removals with the body they carried."""
    return audit_entries(requests, kind, ["model_id", "collection", "body"], timestamp)


def audit_errors(rejected: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Rejected rows: ``(session, error_type, message, details, context)``."""
    return audit_entries(rejected, "error", ["error_type", "message", "details", "context"], timestamp)


def audit_search(
    requests: DataFrame, results: DataFrame, kind: str,
    timestamp: Column | None = None, completion_time: Column | None = None,
) -> DataFrame:
    """One entry per search with the suggested items in rank order.

    ``n`` bounds each request's suggestion list.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "media_id")))
    lists = results.groupBy("req_id").agg(
        F.transform(ranked, lambda r: r["media_id"]).alias("suggestions")
    )
    none = F.array().cast("array<long>")
    joined = requests.join(lists, "req_id", "left").withColumn(
        "suggestions", F.coalesce("suggestions", none)
    )
    data = ["session", "model_id", "collection", "suggestions", F.col("n").alias("n_requested")]
    if kind != "faceted":
        fields = {"text": "query", "n_seen": "n_seen", "excluded": "excluded", "pos": "pos", "neg": "neg"}
        data += [F.col(c).alias(name) for c, name in fields.items() if c in joined.columns]
    if "filters" in joined.columns:
        data.append("filters")
    return audit_entries(joined, kind, data, timestamp, completion_time)


def client_events(events: DataFrame, key: str | None = None) -> DataFrame:
    """One entry per client event.

    ``events``: ``(session, ts timestamp, action, element_id, data, route)``. The
    event's own time is kept. With ``key``, entries carry that column of the
    events as the string ``event_key``.
    """
    body = [F.col("element_id"), F.col("route"), F.col("data").alias("body")]
    action = F.concat(F.lit("Client Event: "), F.col("action"))
    more = [] if key is None else [F.col(key).cast("string").alias("event_key")]
    return audit_entries(events, action, body, F.unix_timestamp(F.col("ts")), more=more)


def write_audit(entries: DataFrame, folder: str) -> None:
    """Append entries, one folder per day."""
    day = F.to_date(F.timestamp_seconds("timestamp"))
    entries.withColumn("day", day).write.mode("append").partitionBy("day").parquet(folder)
