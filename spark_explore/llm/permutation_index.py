"""Approximate nearest neighbours with a permutation index.

A vector is represented by its ``PREFIX`` nearest pivots in order. A block of rows keeps an inverted file for each
pivot: the rows that have it among their nearest, and how near. A query reads the files of its own pivots and adds up
what the shared pivots save of Spearman's footrule distance (a pivot beyond the prefix counts as at place
``PREFIX``). The vectors nearest by footrule, a fixed part of the block, are ranked by the exact inner product.

Rows of a block that have the same vector are one entry of its files, with the list of their ids. The part that is
ranked exactly is counted in distinct vectors, and ids are filled in after it, so copies take no place from others. Copies
are dealt over the blocks by their ids like all rows.

For inner products of vectors of unequal length the representation has one more component that makes all vectors
equally long (the query's is 0), so nearest by angle is largest by product.

The pivots are up to ``PIVOTS`` distinct vectors of a sample of 4 * ``PIVOTS`` rows; every row is indexed.

Edge cases: vectors null, zero, with null or non-finite components or of another length than most, and rows
without an id, take no part; repeated ids count as separate rows, and none answers a query of its own id; equal scores go
to the smaller id; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.llm.vector_rows import matrix, pivots, ranked, valid_vectors
from spark_explore.sizing import cut_lineage

PIVOTS, PREFIX = 256, 64
DATA_BLOCK, QUERY_BLOCK = 16_384, 4096
CANDIDATES = 0.25  # part of a block's distinct vectors that is ranked exactly
LEAST_CANDIDATES = 1000  # a block of up to so many distinct vectors is ranked as a whole


def permutations(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The nearest pivots of every vector, nearest first (ties: the earlier pivot)."""
    near = vectors @ points.T
    return np.argsort(-near, axis=1, kind="stable")[:, :PREFIX]


class InvertedFiles:
    """The posts of a block: per pivot the vectors that have it, and their weight ``PREFIX - place``."""

    def __init__(self, order: np.ndarray, count: int):
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        width = order.shape[1]
        self.width, self.rows = width, len(order)
        self.begin = np.searchsorted(flat[by_pivot], np.arange(count + 1))
        self.row = (by_pivot // width).astype(np.int32)
        self.weight = (width - by_pivot % width).astype(np.int32)

    def saved(self, query: np.ndarray) -> np.ndarray:
        """What the shared pivots save of the largest footrule distance, halved, for all rows."""
        out = np.zeros(self.rows, np.int32)
        for place, pivot in enumerate(query):
            own = slice(self.begin[pivot], self.begin[pivot + 1])
            out[self.row[own]] += np.minimum(self.weight[own], self.width - place)
        return out


class Copies:
    """The distinct vectors of a block (rows in order of id), numbered by their first rows, and the rows that have each."""

    def __init__(self, v: np.ndarray):
        whole = np.ascontiguousarray(v + 0.0)  # -0.0 is 0.0
        _, first, group = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        place = np.argsort(np.argsort(first, kind="stable"), kind="stable")
        self.first = np.sort(first)
        self.rows = np.argsort(place[group], kind="stable")
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(place[group]))])

    def best(self, vectors: np.ndarray, score: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows with the k highest scores (ties: the smaller id) among those of ``vectors`` whose id is not ``own``, and the scores."""
        rows, scores, many, last = [], [], 0, None
        for at in np.argsort(-score, kind="stable"):
            if many >= k and score[at] < last:
                break
            held = self.rows[self.begin[vectors[at]]:self.begin[vectors[at] + 1]]
            held = held[ids[held] != own][:k]
            if len(held):
                rows.append(held), scores.append(np.full(len(held), score[at]))
                many, last = many + len(held), score[at]
        if not rows:
            return np.empty(0, np.int64), np.empty(0)
        found, value = np.concatenate(rows), np.concatenate(scores)
        order = np.lexsort((ids[found], -value))[:k]
        return found[order], value[order]


def _search(points: np.ndarray, longest: float, k: int, part: float, least: int):
    def lengthened(v, fill):
        extra = np.sqrt(np.maximum(longest**2 - (v * v).sum(1), 0)) if fill else np.zeros(len(v))
        return np.column_stack([v, extra])

    def run(table: pa.Table) -> pa.Table:
        ids, side = table.column("vec_id").to_numpy(), table.column("side").to_numpy()
        v = matrix(table.column("v"))
        asked, held = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        held = held[np.argsort(ids[held], kind="stable")]
        out = ([], [], [])
        if len(asked) and len(held):
            pivot = lengthened(points, True)
            own, copies = ids[held], Copies(v[held])
            rows = v[held][copies.first]
            files = InvertedFiles(permutations(lengthened(rows, True), pivot), len(points))
            many = min(len(rows), max(least, int(part * len(rows))))
            for q, order in zip(asked, permutations(lengthened(v[asked], False), pivot)):
                # Equal distances: the vectors of smaller ids, which come first.
                key = files.saved(order).astype(np.int64) * len(rows) - np.arange(len(rows))
                near = np.argpartition(-key, many - 1)[:many] if many < len(rows) else np.arange(len(rows))
                best, score = copies.best(near, (rows[near] * v[q]).sum(1), own, ids[q], k)
                out[0].append(np.full(len(best), ids[q])), out[1].append(own[best]), out[2].append(score)
        join = [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table({"query_id": join[0], "vec_id": join[1], "score": join[2]})

    return run


def search(data: DataFrame, queries: DataFrame, k: int = 20, part: float = CANDIDATES, least: int = LEAST_CANDIDATES,
           vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, its own id excepted."""
    rows = cut_lineage(valid_vectors(data, vec_id, vector, zero=False))
    points = pivots(rows, PIVOTS)
    if not len(points):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    rows = rows.where(F.size("v") == points.shape[1])
    asked = valid_vectors(queries, vec_id, vector, zero=False).where(F.size("v") == points.shape[1])
    n, longest = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    data_blocks = max(1, -(-n // DATA_BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    h = F.xxhash64("vec_id", F.lit(1))
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    one = rows.select("vec_id", "v", F.lit(1).alias("side"), F.pmod(h, F.lit(data_blocks)).cast("int").alias("d"), every(query_blocks).alias("q"))
    two = asked.select("vec_id", "v", F.lit(0).alias("side"), every(data_blocks).alias("d"), F.pmod(h, F.lit(query_blocks)).cast("int").alias("q"))
    found = one.unionByName(two).groupBy("d", "q").applyInArrow(
        _search(points, float(np.sqrt(longest)), k, part, least), "query_id long, vec_id long, score double")
    return ranked(found, k)
