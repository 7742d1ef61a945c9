"""Searches end to end: requests in, ranked media ids out."""

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_explore.functions.encode import embed_text
from spark_explore.operators.audit import audit_errors
from spark_explore.operators.feedback import (
    feedback_samples, hyperplane_requests, train_hyperplanes,
)
from spark_explore.operators.filters import faceted_search
from spark_explore.operators.ivf import PROBES, ivf_topk
from spark_explore.operators.mapping import to_index_ids, to_media_ids
from spark_explore.operators.skip import skip_items, with_groups
from spark_explore.operators.topk import top_items
from spark_explore.sizing import BROADCAST_ROWS, cut_lineage, small_side

PSEUDO_RELEVANT = 10
STRATEGIES = ("text", "rf", "faceted")


@dataclass(frozen=True)
class SearchIndex:
    """What searches run on. With ``centroids``, vectors carry ``cell`` and IVF is used.

    Vectors that carry ``group_id`` (as written collections do) need no join where groups are excluded.
    """

    embeddings: DataFrame
    index_map: DataFrame
    medias: DataFrame
    centroids: DataFrame | None = None
    nprobe: int = PROBES


def vector_search(
    requests: DataFrame,
    index: SearchIndex,
    seen: DataFrame | None = None,
    excluded: DataFrame | None = None,
    passed: DataFrame | None = None,
) -> DataFrame:
    """``(req_id, collection, rank, media_id, score)`` for requests with ``query_vec``.

    ``seen`` and ``excluded`` are ``(req_id, collection, media_id)`` pairs; an
    excluded item takes its whole group along. ``passed`` holds the items that
    pass each filter (``filters.passing``).
    """
    if "filter_id" not in requests.columns:
        requests = requests.withColumn("filter_id", F.lit(None).cast("string"))
    # Written once: an encoder or a trainer behind the query vectors must not run per use.
    requests = cut_lineage(requests.select("req_id", "collection", "query_vec", "n", "filter_id"))
    skips = skip_items(index.index_map, index.medias, seen, excluded)
    if passed is not None:
        passed = to_index_ids(passed, index.index_map)
    vectors = index.embeddings
    if excluded is not None and "group_id" not in vectors.columns:
        vectors = with_groups(vectors, index.index_map, index.medias)
    if index.centroids is None:
        found = top_items(vectors, requests, ["collection"], skips, passed)
    else:
        found = ivf_topk(requests, index.centroids, vectors, index.nprobe, skips, passed,
                         adaptive=True)
    owners = requests.select("req_id", "collection")
    # The answer has at most the sum of all n rows: below the bound the mapping stays unshuffled.
    if (requests.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_ROWS:
        found = F.broadcast(found.join(small_side(owners), "req_id"))
    else:
        found = found.join(owners, "req_id")
    return to_media_ids(found, index.index_map).select(
        "req_id", "collection", "rank", "media_id", "score"
    )


def text_search(requests: DataFrame, index: SearchIndex, encoder=None, **limits) -> DataFrame:
    """Search by text: ``requests`` is ``(req_id, collection, text, n[, filter_id])``."""
    asked = embed_text(requests, "text", encoder=encoder).where(F.col("query_vec").isNotNull())
    return vector_search(asked, index, **limits)


def multi_text_search(
    requests: DataFrame,
    index: SearchIndex,
    encoder=None,
    separators: DataFrame | None = None,
    positives: DataFrame | None = None,
    negatives: DataFrame | None = None,
    seed: str = "42",
    **limits,
) -> DataFrame:
    """Search by several texts at once (``texts`` array); an item counts its best score.

    The best ``n`` of the fused list are among the best ``n`` of each text, so
    each text is searched on its own and only the winners meet. ``separators``
    (``req_id, query_vec``) joins in as one more query vector per request, and
    so does the separator of a request's feedback examples (``positives``,
    ``negatives``). ``limits`` are those of ``vector_search``; with ``passed``,
    requests carry ``filter_id``.
    """
    base = ["req_id", "collection", "n"] + (["filter_id"] if "filter_id" in requests.columns else [])
    texts = requests.select(*base, F.explode("texts").alias("text"))
    parts = embed_text(texts, "text", encoder=encoder).select(*base, "query_vec")
    if positives is not None and negatives is not None:
        asked = requests.select(*base, F.lit(None).cast("string").alias("text"))
        asked = asked.join(positives.select("req_id").union(negatives.select("req_id")), "req_id", "left_semi")
        models = train_hyperplanes(
            feedback_samples(asked, index.index_map, positives, negatives, None, seed), index.embeddings)
        parts = parts.unionByName(hyperplane_requests(asked, models).select(*base, "query_vec"))
    if separators is not None:
        parts = parts.unionByName(requests.select(*base).join(separators, "req_id").select(*base, "query_vec"))
    # One search per part, under a number of its own; whose part it is stays in a table beside.
    parts = cut_lineage(parts.where(F.col("query_vec").isNotNull())).withColumn(
        "part_id", F.monotonically_increasing_id())
    owners = small_side(parts.select("part_id", "req_id"))

    def of_parts(pairs):
        return pairs.join(owners, "req_id").select(
            F.col("part_id").alias("req_id"), "collection", "media_id")

    for name in ("seen", "excluded"):
        if limits.get(name) is not None:
            limits[name] = of_parts(limits[name])
    found = vector_search(parts.drop("req_id").withColumnRenamed("part_id", "req_id"), index, **limits)
    fused = found.withColumnRenamed("req_id", "part_id").join(owners, "part_id").groupBy(
        "req_id", "collection", "media_id").agg(F.max("score").alias("score"))
    fused = to_index_ids(fused.withColumn("id", F.col("media_id")), index.index_map)
    order = Window.partitionBy("req_id").orderBy(F.desc("score"), "index_id")
    return (
        fused.join(requests.select("req_id", "n"), "req_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.col("n"))
        .select("req_id", "collection", "rank", F.col("id").alias("media_id"), "score")
    )


def rf_search(
    requests: DataFrame,
    index: SearchIndex,
    positives: DataFrame,
    negatives: DataFrame,
    encoder=None,
    seed: str = "42",
    **limits,
) -> DataFrame:
    """Relevance feedback: ``requests`` is ``(req_id, collection, text, n[, filter_id])``.

    A request with a text adds its ten best text results, under the same limits,
    to its positives. The separator's direction then ranks the collection.
    """
    pseudo = None
    with_text = requests.where(F.col("text").isNotNull())
    if not with_text.isEmpty():
        asked = with_text.withColumn("n", F.lit(PSEUDO_RELEVANT))
        pseudo = cut_lineage(text_search(asked, index, encoder, **limits))
    samples = feedback_samples(requests, index.index_map, positives, negatives, pseudo, seed)
    models = train_hyperplanes(samples, index.embeddings)
    return vector_search(hyperplane_requests(requests, models), index, **limits)


def split_requests(requests: DataFrame, collections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and rejected ones with ``error_type`` and ``message`` for the audit log.

    ``collections`` is the registry; a collection that is switched off has no answers.
    """
    enabled = collections.where("enabled").select("collection", F.lit(True).alias("known"))
    kind = F.col("kind")
    fault = (
        F.when(kind.isNull() | ~kind.isin(*STRATEGIES), F.lit("Unknown search strategy"))
        .when(F.col("known").isNull(), F.lit("Unknown collection"))
        .when((kind == "text") & F.col("text").isNull(), F.lit("Text search without text"))
        .when((kind == "faceted") & F.col("filter_id").isNull(), F.lit("Faceted search without filters"))
        .when(F.col("n").isNull() | (F.col("n") < 0), F.lit("Bad number of results"))
    )
    checked = requests.join(small_side(enabled), "collection", "left").withColumn("message", fault).drop("known")
    rejected = checked.where(F.col("message").isNotNull()).withColumn("error_type", F.lit("SearchError"))
    return checked.where(F.col("message").isNull()).drop("message"), rejected


def answer(
    requests: DataFrame,
    index: SearchIndex,
    positives: DataFrame,
    negatives: DataFrame,
    passed: DataFrame,
    encoder=None,
    started: Column | None = None,
    **limits,
) -> DataFrame:
    """Answer a mixed batch; ``kind`` names the strategy of each request.

    Adds ``strategy``, the batch's start and its duration in whole seconds. The
    duration is filled in by ``timed``, once the results are written.
    """
    unknown = requests.where(~F.col("kind").isin(*STRATEGIES) | F.col("kind").isNull())
    bad = unknown.select("kind").first()
    if bad is not None:
        raise ValueError(f"unknown strategy {bad['kind']!r}")
    started = F.unix_timestamp() if started is None else started

    def of(kind):
        return requests.where(F.col("kind") == kind).drop("kind")

    ranked = {
        "text": text_search(of("text"), index, encoder, passed=passed, **limits),
        "rf": rf_search(of("rf"), index, positives, negatives, encoder, passed=passed, **limits),
        "faceted": faceted_search(of("faceted"), passed).withColumn("score", F.lit(None).cast("double")),
    }
    columns = ["req_id", "collection", "rank", "media_id", "score"]
    result = None
    for kind, found in ranked.items():
        part = found.select(*columns, F.lit(kind).alias("strategy"))
        result = part if result is None else result.unionByName(part)
    return result.withColumn("request_timestamp", started.cast("long"))


def timed(results: DataFrame, seconds: float) -> DataFrame:
    """Results with the batch's ``completion_time`` in whole seconds."""
    return results.withColumn("completion_time", F.lit(int(seconds)).cast("long"))


def write_timed(results: DataFrame, folder: str) -> DataFrame:
    """Write a batch's results to ``folder`` and return them with the time that the work took.

    ``elapsed_ms`` has it in milliseconds (rounded up), ``completion_time`` in whole seconds.
    """
    started = time.monotonic()
    results.write.parquet(folder)
    spent = time.monotonic() - started
    written = timed(results.sparkSession.read.schema(results.schema).parquet(folder), spent)
    return written.withColumn("elapsed_ms", F.lit(math.ceil(1000 * spent)).cast("long"))


def answer_checked(
    requests: DataFrame, collections: DataFrame, index: SearchIndex, positives: DataFrame, negatives: DataFrame,
    passed: DataFrame, at: Column | None = None, **options,
) -> tuple[DataFrame, DataFrame]:
    """Answers of the valid requests, and audit entries of the rejected ones.

    ``requests`` also carries ``session``. One bad request does not stop the batch.
    """
    valid, rejected = split_requests(requests, collections)
    rejected = rejected.withColumns({
        "details": F.concat(F.lit("request "), F.col("req_id").cast("string")), "context": F.lit("search")})
    answers = answer(cut_lineage(valid), index, positives, negatives, passed, **options)
    return answers, audit_errors(rejected, at)
