"""Benchmark decontamination: a broadcast hash set of the items' word windows meets every window of the documents.

Only DataFrame functions. Items and documents become lower-cased words; the windows of the items are hashed into a set.

1. Every window of every document is looked up in the set, which is shared with all tasks in blocks of ``SET_ROWS`` hashes, so
   the documents' windows are never shuffled, however large the benchmark is.
2. The windows found (once for each different text) are verified word by word against the items' windows.
3. Overlapping windows of a text merge into spans. Windows with the same items share one entry of items, so a passage
   that many items hold is listed once for a text and not once for each of its windows.

Edge cases: a null text has no words; an item with fewer words than a window, but not none, is one window; an item without an
id counts as the id "" and items that repeat an id are one; repeated rows and ids give a row each; copies of a text are
verified once; empty tables give no rows (documents) or no hits (items); extra columns are kept by ``decontaminate`` and ignored otherwise.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_explore.sizing import cut_lineage, small_side

WIDTH = 10  # words of a window
SET_ROWS = 2_000_000  # hashes in one broadcast block: 32 MB of entries

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Bytes between words, in lower-cased and in original text.
LOW_GAP = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
GAP = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"


def words(text):
    """The lower-cased words of a text; letters beyond ASCII stay as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, f"[{LOW_GAP}]+"), "")


def text_key(text):
    """128 bits that stand for a text."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("other"), text).alias("k2")


def _window(i, n: int):
    """The ``n`` words from word i."""
    return [F.get("words", i + j) for j in range(n)]


def _by_width(widths: list[int], value):
    """The ``value`` of the row's own width."""
    *others, last = widths
    return reduce(lambda rest, w: F.when(F.col("n") == w, value(w)).otherwise(rest), others, value(last))


def _windows(rows: DataFrame, widths: list[int]) -> DataFrame:
    """``rows`` (with ``words``) once per window: start (word number from 0), n and the hash h of its words.

    A window is two numbers beside the words of its row until something asks for its text: all steps compile into one loop over each text.
    """
    n = F.col("n")
    if len(widths) == 1:
        found = rows.withColumn("n", F.lit(widths[0]))
    else:
        found = rows.withColumn("n", F.explode(F.array(*map(F.lit, widths))))
    places = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>"))
    found = found.withColumn("start", F.explode(places))
    return found.withColumn("h", _by_width(widths, lambda w: F.xxhash64(*_window(F.col("start"), w))))


def _text(widths: list[int]):
    return _by_width(widths, lambda w: F.concat_ws(" ", *_window(F.col("start"), w))).alias("window")


def item_windows(items: DataFrame, width: int = WIDTH, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, n (words), window (words joined by a space) and its hash h; distinct rows."""
    rows = cut_lineage(items.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item_id"),
        words(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("words")))
    whole = _windows(rows, [width]).select("item_id", "n", _text([width]), "h")
    # The hash of an array is that of its elements one after another.
    short = rows.where((F.size("words") > 0) & (F.size("words") < width)).select(
        "item_id", F.size("words").alias("n"), F.array_join("words", " ").alias("window"), F.xxhash64("words").alias("h"))
    return whole.unionByName(short).distinct()


def occurrences(docs: DataFrame, posts: DataFrame, text: str = "text", set_rows: int = SET_ROWS) -> DataFrame:
    """Verified windows in each different text: k1, k2, start, n and the key x1, x2, items of the set of items that hold the window."""
    windows = cut_lineage(posts.groupBy("h", "window", "n").agg(
        F.count("*").alias("items"), F.bit_xor(F.xxhash64("item_id")).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit("other"), "item_id")).alias("x2")))
    widths = sorted(r[0] for r in windows.select("n").distinct().collect())
    text_ = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(*text_key(text_), words(text_).alias("words"))
    # One hash set a block: every block reads the documents, none of their windows is shuffled.
    blocks = -(-windows.select("h").distinct().count() // set_rows)
    # The number of the block is a written column: a condition on the hash itself would be worked out for every window too.
    hashes = cut_lineage(windows.select("h", F.pmod("h", F.lit(max(blocks, 1))).alias("block")).distinct())
    own = [F.broadcast(hashes.where(F.col("block") == b).select("h")) for b in range(blocks)]
    found = [_windows(rows, widths).join(block, "h", "left_semi").select("k1", "k2", "start", "n", "h", _text(widths)) for block in own]
    if not found:
        found = [docs.sparkSession.createDataFrame([], "k1 long, k2 long, start int, n int, h long, window string")]
    # Written before they are aggregated: with that in the same loop, its code gets too long to be compiled to machine code.
    found = cut_lineage(reduce(DataFrame.unionByName, found)).distinct()
    return found.join(small_side(windows), ["h", "window", "n"]).select("k1", "k2", "start", "n", "items", "x1", "x2")


def spans(hits: DataFrame) -> DataFrame:
    """k1, k2, n_hit (words inside any window) and spans: the merged ranges of words [s, e), in order."""
    along = Window.partitionBy("k1", "k2").orderBy("start", "n")
    ends = hits.select("k1", "k2", "start", "n").distinct().withColumn("end", F.col("start") + F.col("n"))
    ends = ends.withColumn("before", F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("span", F.count_if(F.col("before").isNull() | (F.col("start") > F.col("before"))).over(
        along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = ends.groupBy("k1", "k2", "span").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    return merged.groupBy("k1", "k2").agg(
        F.sum(F.col("e") - F.col("s")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def items_found(hits: DataFrame, posts: DataFrame) -> DataFrame:
    """k1, k2, n_items and items_sha256 of the items with a window in the text."""
    key = ["items", "x1", "x2"]
    holders = posts.groupBy("window").agg(
        F.count("*").alias("items"), F.bit_xor(F.xxhash64("item_id")).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit("other"), "item_id")).alias("x2"),
    ).groupBy(*key).agg(F.min("window").alias("window"))
    holders = cut_lineage(holders.join(posts, "window").select(*key, "item_id"))
    pairs = hits.select("k1", "k2", *key).distinct().join(small_side(holders), key).select("k1", "k2", "item_id").distinct()
    return pairs.groupBy("k1", "k2").agg(
        F.count("*").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    posts = cut_lineage(item_windows(items, width))
    hits = cut_lineage(occurrences(docs, posts, text))
    found = spans(hits).drop("spans").join(items_found(hits, posts), ["k1", "k2"])
    text_ = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), *text_key(text_), F.size(words(text_)).cast("long").alias("n_words"))
    return rows.join(small_side(found), ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", width: int = WIDTH, text: str = "text") -> DataFrame:
    """The documents without the words of benchmark windows (``remove="spans"``: the words and the gaps after them go) or without
    the documents that hold one (``remove="documents"``). All columns stay; clean documents stay as they are."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be spans or documents, not {remove!r}")
    hits = cut_lineage(occurrences(docs, cut_lineage(item_windows(items, width)), text))
    text_ = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *text_key(F.coalesce(text_, F.lit(""))))
    if remove == "documents":
        kept = rows.join(small_side(hits.select("k1", "k2").distinct()), ["k1", "k2"], "left_anti")
        return kept.select("row.*")
    found = rows.join(small_side(spans(hits)), ["k1", "k2"], "left")
    old = F.col(f"row.`{text}`").cast("string")
    pieces = F.regexp_extract_all(old, F.lit(f"[^{GAP}]+[{GAP}]*"), F.lit(0))
    found = found.withColumn("pieces", F.when(F.col("spans").isNotNull(), pieces))
    count = F.size("spans")

    def kept_words(i):
        first = F.when(i == 0, 0).otherwise(F.get(F.col("spans"), i - 1)["e"])
        end = F.when(i == count, F.size("pieces")).otherwise(F.get(F.col("spans"), i)["s"])
        return F.array_join(F.slice("pieces", first + 1, end - first), "")

    new = F.concat(F.regexp_extract(old, f"^[{GAP}]*", 0), F.array_join(F.transform(F.sequence(F.lit(0), count), kept_words), ""))
    new = F.when(F.col("spans").isNull(), old).otherwise(new)
    return found.withColumn("new", new).select(*(F.col("new").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))
