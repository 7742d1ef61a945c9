"""Exact k highest integer inner products by a Voronoi kNN join.

Vectors are scaled and rounded down to integers. Pivots (a bounded sample of rows) divide space into cells, and a
query belongs to the cell of its nearest pivot. A cell's summary is its pivot ``a``, its radius ``r`` (largest distance of a query to
``a``) and its number of queries. For a row x and any query q of the cell

    a.x - r |x|  <=  q.x  <=  a.x + r |x|.

The lower bounds' (k+1)-th highest over all rows (a query doesn't answer itself) is a bound that each query's k-th score
reaches; it is gathered from the k+1 highest of every task. A row is sent to a group of cells only if its upper bound
reaches the bound of one of them. Groups hold at most ``QUERY_BLOCK`` queries; a cell with more is dealt over several. Rows of a group are
dealt over blocks, each solved by itself, and the blocks' best are ranked.

Sums are exact: products of integers below 2^53 are added as doubles.

Edge cases: vectors null, with null or non-finite components or of another length than most, and rows
without an id, take no part; repeated ids count as separate rows, and none answers a query of its own id; equal scores go
to the smaller id; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.llm.vector_rows import matrix, pivots, ranked, valid_vectors
from spark_explore.sizing import cut_lineage

PIVOTS = 64
DATA_BLOCK, QUERY_BLOCK = 16_384, 2048
ROUNDING = 1e-9  # bounds are doubles; relative room for their rounding


def _nearest(v: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of every vector and its distance to the pivot."""
    square = (v * v).sum(1)[:, None] - 2 * v @ points.T + (points * points).sum(1)
    cell = square.argmin(1)
    return cell, np.sqrt(((v - points[cell]) ** 2).sum(1))


def _groups(points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of every cell; cells that follow each other nearest-first share groups."""
    left, order = list(range(1, len(points))), [0]
    while left:
        near = min(left, key=lambda j: float(((points[j] - points[order[-1]]) ** 2).sum()))
        left.remove(near)
        order.append(near)
    first, many = np.zeros(len(points), np.int64), np.ones(len(points), np.int64)
    group, room = 0, QUERY_BLOCK
    for cell in order:
        if counts[cell] > room:
            group, room = group + (room < QUERY_BLOCK), QUERY_BLOCK
        first[cell] = group
        if counts[cell] > QUERY_BLOCK:
            many[cell] = -(-counts[cell] // (QUERY_BLOCK // 2))
            group += many[cell]
        else:
            room -= counts[cell]
    return first, many


def join(data: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256,
         vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query over all rows but those of its id."""
    def integers(df):
        return valid_vectors(df, vec_id, vector, zero=True).select(
            "vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("v"))

    rows = cut_lineage(integers(data))
    points = pivots(rows, PIVOTS)
    if not len(points):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    rows = rows.where(F.size("v") == points.shape[1])
    cells = len(points)

    def place(batches):
        for batch in batches:
            cell, far = _nearest(matrix(batch.column("v")), points)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(cell), pa.array(far)], ["vec_id", "v", "cell", "far"])

    asked = cut_lineage(integers(queries).where(F.size("v") == points.shape[1]).mapInArrow(
        place, "vec_id long, v array<double>, cell long, far double"))
    counts, radius = np.zeros(cells, np.int64), np.zeros(cells)
    for cell, many, far in asked.groupBy("cell").agg(F.count("*"), F.max("far")).collect():
        counts[cell], radius[cell] = many, far * (1 + ROUNDING)
    used = np.nonzero(counts)[0]
    first, many = _groups(points, counts)

    def bounds(v):
        """Lower and upper bound of every row for every cell with queries."""
        middle = v @ points[used].T
        length = np.sqrt((v * v).sum(1))[:, None]
        reach = radius[used] * length + ROUNDING * (1 + length * np.sqrt((points[used] ** 2).sum(1)))
        return middle - reach, middle + reach

    def lowest(batches):
        best = np.full((k + 1, len(used)), -np.inf)
        for batch in batches:
            if batch.num_rows:
                best = np.sort(np.vstack([best, bounds(matrix(batch.column("v")))[0]]), axis=0)[-(k + 1):]
        cell = np.tile(used, k + 1)
        some = np.isfinite(best.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cell[some]), pa.array(best.ravel()[some])], ["cell", "low"])

    # An id's repetitions are no answers either; the bound leaves room for the most frequent id.
    repeats = (rows.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1) - 1
    reached = np.full(cells, -np.inf)
    if repeats == 0:
        lows = rows.select("v").mapInArrow(lowest, "cell long, low double").groupBy("cell").agg(
            F.sort_array(F.collect_list("low"), asc=False).alias("lows"))
        for cell, low in lows.select("cell", F.slice("lows", 1, k + 1)).collect():
            if len(low) == k + 1:
                reached[cell] = low[-1]
    blocks = max(1, -(-rows.count() // DATA_BLOCK))

    def send(batches):
        for batch in batches:
            if not batch.num_rows or not len(used):
                continue
            needed = bounds(matrix(batch.column("v")))[1] >= reached[used]
            row, group = [], []
            for g in range(int((first + many).max())):
                mine = (first[used] <= g) & (g < first[used] + many[used])
                at = np.nonzero(needed[:, mine].any(1))[0]
                row.append(at), group.append(np.full(len(at), g))
            taken = batch.take(pa.array(np.concatenate(row)))
            yield pa.RecordBatch.from_arrays(
                [taken.column("vec_id"), taken.column("v"), pa.array(np.concatenate(group).astype(np.int32))], ["vec_id", "v", "group"])

    def solve(table: pa.Table) -> pa.Table:
        ids, side, cell = (table.column(c).to_numpy() for c in ("vec_id", "side", "cell"))
        v = matrix(table.column("v"))
        held = np.nonzero(side == 1)[0]
        held = held[np.argsort(ids[held], kind="stable")]
        out = ([], [], [])
        if len(held):
            upper = bounds(v[held])[1]
            for c in np.unique(cell[side == 0]):
                some = held[upper[:, np.searchsorted(used, c)] >= reached[c]]
                asked = np.nonzero((side == 0) & (cell == c))[0]
                for at in range(0, len(asked), 256):
                    q = asked[at:at + 256]
                    score = v[q] @ v[some].T
                    score[ids[q][:, None] == ids[some]] = -np.inf
                    for i, own in enumerate(score):
                        if len(own) > k:
                            cut = np.partition(own, len(own) - k)[len(own) - k]
                            best = np.nonzero(own >= cut)[0]
                        else:
                            best = np.arange(len(own))
                        best = best[own[best] > -np.inf]
                        best = best[np.argsort(-own[best], kind="stable")[:k]]  # rows are in order of id
                        out[0].append(np.full(len(best), ids[q[i]])), out[1].append(ids[some[best]])
                        out[2].append(own[best].astype(np.int64))
        return pa.table({c: np.concatenate(x) if x else np.empty(0, np.int64)
                         for c, x in zip(("query_id", "vec_id", "score"), out)})

    base = F.array(*[F.lit(int(x)) for x in first])
    deal = F.array(*[F.lit(int(x)) for x in many])
    at = F.col("cell").cast("int") + 1
    h = F.xxhash64("vec_id", F.lit(1))
    columns = ["vec_id", "v", "group", "block", "side", "cell"]
    one = rows.mapInArrow(send, "vec_id long, v array<double>, group int").withColumns({
        "block": F.pmod(h, F.lit(blocks)).cast("int"), "side": F.lit(1), "cell": F.lit(-1).cast("long")})
    two = asked.withColumns({
        "group": (F.element_at(base, at) + F.pmod(h, F.element_at(deal, at))).cast("int"),
        "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "side": F.lit(0)})
    found = one.select(*columns).unionByName(two.select(*columns)).groupBy("group", "block").applyInArrow(
        solve, "query_id long, vec_id long, score long")
    return ranked(found, k)
