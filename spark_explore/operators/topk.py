"""The best-scoring items of each request.

Items are scored block-wise with NumPy inside Spark tasks. A task keeps only
the running best ``n`` per request, so the pairs of requests and items are
never rows, and the vectors are read where they lie, without a shuffle.
A batch that is too large to be shared with all tasks is cut into slices of
requests, and bitmaps or skip lists that are too large into ranges of item
positions; each slice and range is a scan of its own. Skipped and filtered
items are masked before the selection, so ``n`` results come back whenever
enough candidates exist.

Scores are rounded and equal scores fall to the lower id, which makes the
answer independent of partitioning and summation order.
"""

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_explore.sizing import checkpoint_dir, cut_lineage, local_table, small_side

# Scores keep this many decimals: noise of the summation order goes, real differences stay.
DECIMALS = 12

# What one scan shares with every task: probes, bytes of their vectors, and results they ask for.
SHARED_PROBES = 8192
SHARED_BYTES = 64 << 20
SHARED_RESULTS = 4_000_000

# Bitmaps of passing items in one scan; one holds 32768 positions.
MASK_BYTES = 64 << 20
MASK_BITS = 32_768

# Hidden positions (and excluded groups) of requests in one scan.
SHARED_SKIPS = 2_000_000

# Neighbouring hidden positions that become a run.
RUN = 16

# Scans in one plan; more of them write their results first.
SCANS = 16

# Index cells that lie in one folder, and pieces of the final ranking of one request.
CELLS_PER_BUCKET = 64
RANK_PIECES = 64

# Scores held at once by one task.
SCORES_AT_ONCE = 4_000_000

FOUND = "req_id long, index_id long, score double, n int"


class Hidden:
    """What the requests of one collection must not see; requests are numbered in the order of ``ids``.

    Single positions and groups are sorted arrays with their requests beside; longer runs of positions are kept by their ends.
    """

    def __init__(self, ids: np.ndarray, items: pa.Table, groups: pa.Table | None):
        position, who = self._sorted(ids, items, "index_id")
        start = np.ones(len(position), bool)
        start[1:] = (position[1:] != position[:-1] + 1) | (who[1:] != who[:-1])
        first = np.nonzero(start)[0]
        length = np.diff(np.append(first, len(position)))
        long = length >= RUN
        self.runs = position[first[long]], position[first[long]] + length[long], who[first[long]]
        single = ~np.repeat(long, length)
        order = np.argsort(position[single], kind="stable")
        self.points = position[single][order], who[single][order]
        self.groups = None
        if groups is not None:
            group, who = self._sorted(ids, groups, "group_id")
            order = np.argsort(group, kind="stable")
            self.groups = group[order], who[order]

    @staticmethod
    def _sorted(ids, table, column):
        who = np.searchsorted(ids, table["req_id"].to_numpy())
        values = table[column].to_numpy()
        order = np.lexsort((values, who))
        values, who = values[order], who[order]
        again = np.zeros(len(values), bool)
        again[1:] = (values[1:] == values[:-1]) & (who[1:] == who[:-1])
        return values[~again], who[~again]

    @staticmethod
    def _equal(sides, values):
        low, high = (np.searchsorted(sides[0], values, side=side) for side in ("left", "right"))
        many = high - low
        rows = np.repeat(np.arange(len(values)), many)
        return rows, sides[1][np.arange(len(rows)) + np.repeat(low - (np.cumsum(many) - many), many)]

    def pairs(self, items: np.ndarray, groups: np.ndarray | None):
        """Rows of a batch and numbers of the requests they are hidden from."""
        yield self._equal(self.points, items)
        if len(self.runs[0]):
            order = np.argsort(items, kind="stable")
            low, high = (np.searchsorted(items[order], end) for end in self.runs[:2])
            many = high - low
            at = np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)
            yield order[at], np.repeat(self.runs[2], many)
        if self.groups is not None and groups is not None:
            yield self._equal(self.groups, groups)


class Probes:
    """Requests that look at the same part of the items, as arrays sorted by id."""

    def __init__(self, table: pa.Table, masks: dict | None = None, ids: np.ndarray | None = None, hidden: Hidden | None = None):
        self.masks, self.hidden = masks, hidden
        table = table.combine_chunks().sort_by("req_id")
        self.ids = table["req_id"].to_numpy()
        self.n = table["n"].to_numpy()
        flat = pc.list_flatten(table["query_vec"]).to_numpy()
        self.vectors = flat.reshape(len(self.ids), -1).astype(np.float64)
        wanted = table["filter_id"].to_pylist()
        self.by_filter = {
            f: np.array([i for i, g in enumerate(wanted) if g == f]) for f in set(wanted) - {None}
        }
        if hidden is not None:
            # Columns of this part's requests among all of the scan; -1: not in this part.
            self.column = np.full(len(ids), -1)
            self.column[np.searchsorted(ids, self.ids)] = np.arange(len(self.ids))


def _passes(mask: tuple | None, items: np.ndarray) -> np.ndarray:
    """Which positions a bitmap holds; ``mask``: sorted block numbers and the blocks' bits."""
    if mask is None or not len(mask[0]):
        return np.zeros(len(items), bool)
    blocks, bits = mask
    at = np.minimum(np.searchsorted(blocks, items // MASK_BITS), len(blocks) - 1)
    spot = items % MASK_BITS
    return (blocks[at] == items // MASK_BITS) & ((bits[at, spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool)


class Best:
    """Running best ``n`` items of each of the probes."""

    def __init__(self, probes: Probes):
        self.probes = probes
        self.floor = np.full(len(probes.ids), -np.inf)
        self.row = np.empty(0, np.int64)
        self.item = np.empty(0, np.int64)
        self.score = np.empty(0)

    def add(self, batch: pa.RecordBatch) -> None:
        probes = self.probes
        if probes.masks is not None and sum(map(len, probes.by_filter.values())) == len(probes.ids):
            # With a filter on every request, other items need not be scored at all.
            items = batch.column("index_id").to_numpy()
            wanted = np.any([_passes(probes.masks.get(f), items) for f in probes.by_filter], axis=0)
            batch = batch.filter(pa.array(wanted))
        step = max(1, SCORES_AT_ONCE // len(self.probes.ids))
        for start in range(0, batch.num_rows, step):
            self._add(batch.slice(start, step))

    def _scores(self, batch: pa.RecordBatch) -> np.ndarray:
        probes = self.probes
        vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
        vectors = vectors.reshape(batch.num_rows, -1).astype(np.float64)
        scores = np.round(vectors @ probes.vectors.T, DECIMALS) + 0.0
        scores[np.isnan(scores)] = -np.inf
        items = batch.column("index_id").to_numpy()
        if probes.hidden is not None:
            groups = None
            if "group_id" in batch.schema.names:
                # An item without a group is in none.
                groups = pc.fill_null(batch.column("group_id"), np.iinfo(np.int64).min).to_numpy()
            for rows, who in probes.hidden.pairs(items, groups):
                at = probes.column[who]
                scores[rows[at >= 0], at[at >= 0]] = -np.inf
        for name, columns in probes.by_filter.items():
            scores[np.ix_(~_passes((probes.masks or {}).get(name), items), columns)] = -np.inf
        return scores

    def _add(self, batch: pa.RecordBatch) -> None:
        n, items = self.probes.n, batch.column("index_id").to_numpy()
        scores = self._scores(batch)
        deepest = int(n.max())
        if len(items) > deepest > 0:
            cut = len(items) - deepest
            self.floor = np.maximum(self.floor, np.partition(scores, cut, axis=0)[cut])
        # Ties at the floor stay in until the ids decide.
        at, row = np.nonzero((scores >= self.floor) & (scores > -np.inf))
        row = np.concatenate([self.row, row])
        item = np.concatenate([self.item, items[at]])
        score = np.concatenate([self.score, scores[at, row[len(self.row):]]])
        order = np.lexsort((item, -score, row))
        row, item, score = row[order], item[order], score[order]
        starts = np.searchsorted(row, np.arange(len(n)))
        rank = np.arange(len(row)) - starts[row]
        keep = rank < n[row]
        self.row, self.item, self.score = row[keep], item[keep], score[keep]
        last = np.nonzero(rank == n[row] - 1)[0]
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last])

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.probes.ids[self.row]), pa.array(self.item), pa.array(self.score),
             pa.array(self.probes.n[self.row].astype(np.int32))],
            names=["req_id", "index_id", "score", "n"],
        )


def _scan(batches, parts: dict[int, tuple], hidden: dict):
    best: dict[int, Best] = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        part_no = batch.column("part_no").to_numpy()
        for no in np.unique(part_no):
            rows = batch if (part_no == no).all() else batch.filter(pa.array(part_no == no))
            if no not in best:
                table, masks, ids, collection = parts[no]
                best[no] = Best(Probes(table, masks, ids, hidden.get(collection)))
            best[no].add(rows)
    for part in best.values():
        yield part.found()


@dataclass(frozen=True)
class Skips:
    """Items hidden from requests.

    items    ``(req_id, collection, index_id)`` pairs
    groups   ``(req_id, collection, group_id)``: whole groups, never expanded; the
             searched items then carry ``group_id`` beside their vector
    """

    items: DataFrame
    groups: DataFrame | None = None


@dataclass(frozen=True)
class Masks:
    """Bitmaps of the items that pass each filter, made once for several searches."""

    bits: DataFrame

    @classmethod
    def of(cls, passed: DataFrame, filter_ids: DataFrame) -> "Masks":
        """Of the filters in ``filter_ids`` (one column), which may repeat."""
        named = small_side(filter_ids.toDF("filter_id").where("filter_id IS NOT NULL").distinct())
        return cls(_bitmaps(_exploded(passed).join(named, "filter_id", "left_semi")))


def top_items(
    items: DataFrame,
    probes: DataFrame,
    part: list[str],
    skips: Skips | None = None,
    passed: DataFrame | Masks | None = None,
    room: int | None = None,
) -> DataFrame:
    """``(req_id, index_id, score, rank)`` with the best ``n`` items of each request.

    items   part columns, ``collection, index_id, embedding`` (and ``group_id``, where groups are skipped)
    probes  part columns, ``req_id, query_vec, n, filter_id``; a request sees the
            items of its parts (its collection, or the index cells it probes)
    passed  ``(collection, index_id, filter_ids)``: items passing each filter (or their ``Masks``)
    room    probes that may be shared with all tasks, if not ``SHARED_PROBES``

    A request whose ``n`` is null or below 1 gets nothing.
    """
    room = max(1, SHARED_PROBES if room is None else room)
    probes = probes.where(F.col("query_vec").isNotNull() & (F.col("n") > 0)).select(
        *part, F.col("req_id").cast("long"), F.col("query_vec").cast("array<double>"),
        F.col("n").cast("int"), F.col("filter_id").cast("string"),
    )
    grouped = skips is not None and skips.groups is not None
    if grouped and "group_id" not in items.columns:
        raise ValueError("groups are skipped but the items carry no group_id")
    extra = [c for c in ("cell_bucket",) if c in items.columns] + ["group_id"] * grouped
    items = items.where(F.col("embedding").isNotNull()).select(
        *dict.fromkeys([*part, "collection"]), "index_id", "embedding", *extra
    )
    # One job fetches a batch that fits, or shows that it does not.
    fetched = probes.limit(room + 1).toArrow()
    schema = probes.select(*part).schema
    if fetched.num_rows <= room and _fits(fetched):
        deepest = pc.max(fetched["n"]).as_py() or 0
        scans = _scans(items, fetched, schema, part, skips, passed)
        if len(scans) <= SCANS:
            return _best(reduce(DataFrame.unionByName, scans), deepest).drop("n")
        slices = [scans]
    else:
        if isinstance(passed, DataFrame):
            passed = Masks.of(passed, probes.select("filter_id"))  # all slices use them
        deepest, slices = _slices(items, probes, schema, part, skips, passed, room)
    folder = f"{checkpoint_dir(items.sparkSession)}/found-{uuid.uuid4().hex}"
    for scans in slices:
        for at in range(0, len(scans), SCANS):
            found = reduce(DataFrame.unionByName, scans[at:at + SCANS])
            _best(found, deepest).drop("rank").write.mode("append").parquet(folder)
    return _best(items.sparkSession.read.schema(FOUND).parquet(folder), deepest).drop("n")


def _slices(items, probes, schema, part, skips, passed, room):
    """The scans of a large batch, slice by slice; neighbouring parts share a slice, so a slice reads few index cells."""
    probes = cut_lineage(probes)
    rows, size, wanted, deepest = probes.agg(
        F.count("*"), F.sum(F.size("query_vec") * 8 + 64), F.sum(F.col("n").cast("long")), F.max("n")).first()
    count = max(-(-rows // room), -(-size // max(1, SHARED_BYTES)), -(-wanted // max(1, SHARED_RESULTS)))
    count = min(rows, count + -(-count // 4))  # ranges are of about equal sizes only
    placed = cut_lineage(probes.repartitionByRange(count, *part, "req_id").withColumn("slice", F.spark_partition_id()))
    numbers = sorted(r[0] for r in placed.select("slice").distinct().collect())
    return deepest, (
        _scans(items, placed.where(F.col("slice") == no).drop("slice").toArrow(), schema, part, skips, passed) for no in numbers)


def best_of(found: DataFrame, requests: DataFrame, deepest: int) -> DataFrame:
    """The best ``n`` of each request among results of several searches."""
    wanted = requests.select(F.col("req_id").cast("long"), F.col("n").cast("int"))
    return _best(found.select("req_id", "index_id", "score").join(wanted, "req_id"), deepest).drop("n")


def _best(found: DataFrame, deepest: int) -> DataFrame:
    """The best ``n`` of each request and their ``rank``. Ranked in pieces first, so the results of all tasks for one request do not meet in one task."""
    found = found.withColumn("piece", F.pmod(F.xxhash64("index_id"), F.lit(RANK_PIECES)))
    for keys in (["req_id", "piece"], ["req_id"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "index_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(
            (F.col("rank") <= deepest) & (F.col("rank") <= F.col("n")))
    return found.select("req_id", "index_id", "score", "rank", "n")


def _exploded(passed: DataFrame) -> DataFrame:
    return passed.select("collection", "index_id", F.explode("filter_ids").alias("filter_id"))


def _bits(passed: DataFrame, names: list[str]) -> DataFrame:
    return _bitmaps(_exploded(passed).where(F.col("filter_id").isin(*names)))


def _bitmaps(rows: DataFrame) -> DataFrame:
    """Passing items as bitmaps by collection, filter and block of positions, by map-side combined aggregation."""
    place = F.col("index_id") + 1  # the SQL functions count from 1
    return cut_lineage(
        rows.groupBy("collection", "filter_id", (F.bitmap_bucket_number(place) - 1).alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    )


def _masks(bits: DataFrame) -> dict:
    found: dict = {}
    for row in bits.toArrow().sort_by("block").to_pylist():
        blocks, rows = found.setdefault((row["collection"], row["filter_id"]), ([], []))
        blocks.append(row["block"])
        rows.append(np.frombuffer(row["bits"], np.uint8))
    return {key: (np.array(blocks), np.stack(rows)) for key, (blocks, rows) in found.items()}


def _cuts(df: DataFrame, column: str, pieces: int) -> list[int]:
    """Values of ``column`` that cut ``df`` into about ``pieces`` parts of equal size."""
    if pieces <= 1:
        return []
    shares = [k / pieces for k in range(1, pieces)]
    return df.agg(F.percentile_approx(column, shares, 10_000).alias("cuts")).first()["cuts"] or []


def _scans(items, table, key_schema, part, skips, passed) -> list[DataFrame]:
    """The scans that answer a bounded batch: one, or one for each range of positions that its masks and skip lists are cut into."""
    spark = items.sparkSession
    names = table["filter_id"].unique().drop_null().to_pylist()
    bits, hidden, groups, edges = None, None, None, set()
    if names:
        if passed is None:
            raise ValueError("requests name filters but no passing items were given")
        bits = passed.bits.where(F.col("filter_id").isin(*names)) if isinstance(passed, Masks) else _bits(passed, names)
        pieces = -(-bits.count() * (MASK_BITS // 8) // max(MASK_BYTES, MASK_BITS // 8))
        edges |= {c * MASK_BITS for c in _cuts(bits, "block", pieces)}
    if skips is not None and table.num_rows:
        asked = F.broadcast(local_table(spark, [{"req_id": r} for r in table["req_id"].unique().to_pylist()], "req_id long"))
        hidden = skips.items.select("req_id", "collection", "index_id")
        if skips.groups is not None:
            groups = skips.groups.select("req_id", "collection", "group_id").join(asked, "req_id", "left_semi").limit(SHARED_SKIPS + 1).toArrow()
            if groups.num_rows > SHARED_SKIPS:
                # Too many groups to be shared: their members are hidden one by one; no vectors are read for that.
                members = items.where(F.col("group_id").isNotNull()).select("collection", "index_id", "group_id")
                hidden = hidden.unionByName(members.join(skips.groups, ["collection", "group_id"]).select("req_id", "collection", "index_id"))
                groups = None
        hidden = hidden.join(asked, "req_id", "left_semi")
        few = hidden.limit(SHARED_SKIPS + 1).toArrow()
        if few.num_rows > SHARED_SKIPS:
            hidden = cut_lineage(hidden)
            edges |= set(_cuts(hidden, "index_id", -(-hidden.count() // max(1, SHARED_SKIPS))))
    edges = sorted(edges)
    scans = []
    for low, high in zip([None, *edges], [*edges, None]):
        def within(df, column="index_id", step=1, low=low, high=high):
            for test in ([F.col(column) >= low // step] if low is not None else []) + ([F.col(column) < -(-high // step)] if high is not None else []):
                df = df.where(test)
            return df

        masks = _masks(within(bits, "block", MASK_BITS)) if bits is not None else None
        skipped = None
        if hidden is not None:
            skipped = (few if not edges else within(hidden).toArrow(), groups)
        scans.append(_shared_scan(within(items), table, key_schema, part, skipped, masks))
    return scans


def _fits(probes: pa.Table) -> bool:
    """Whether a fetched batch is small enough in bytes and in results to be shared."""
    return (
        probes.nbytes <= SHARED_BYTES and (pc.sum(probes["n"]).as_py() or 0) <= SHARED_RESULTS
    )


def _shared_scan(items, table, key_schema, part, skipped, masks) -> DataFrame:
    """Bounded batch: every task holds all requests and scans its own items."""
    spark = items.sparkSession
    keys = table.select(part).group_by(part).aggregate([]).to_pylist()
    ids = np.unique(table["req_id"].to_numpy())
    hidden = {}
    if skipped is not None:
        for collection in {key["collection"] for key in keys}:
            hidden[collection] = Hidden(ids, *(
                t if t is None else t.filter(pc.equal(t["collection"], collection)) for t in skipped))
    parts = {}
    for no, key in enumerate(keys):
        mask = reduce(pc.and_, [pc.equal(table[c], key[c]) for c in part])
        own = None if masks is None else {f: m for (c, f), m in masks.items() if c == key["collection"]}
        parts[no] = (table.filter(mask), own, ids, key["collection"])
        key["part_no"] = no
    for column in part:
        # Literal values reach the scan and prune partitions and row groups.
        values = {key[column] for key in keys}
        items = items.where(F.col(column).isin(*values) if values else F.lit(False))
        if column == "cell" and "cell_bucket" in items.columns:
            items = items.where(F.col("cell_bucket").isin(*{v // CELLS_PER_BUCKET for v in values}))
    if len(keys) <= 1:
        items = items.withColumn("part_no", F.lit(0))
    else:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_schema)
        items = items.join(F.broadcast(local_table(spark, keys, f"{fields}, part_no int")), part)
    everywhere = spark.sparkContext.broadcast((parts, hidden))
    columns = ["part_no", "index_id", "embedding"] + ["group_id"] * ("group_id" in items.columns)
    return items.select(*columns).mapInArrow(lambda batches: _scan(batches, *everywhere.value), FOUND)
