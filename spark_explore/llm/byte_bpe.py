"""Byte-level BPE: texts to token ids and back.

Texts are cut into pieces by ``pretokens``. The distinct pieces of a chunk
that are not in the cache yet are merged together: pieces of one length form
a matrix, and every round merges the pair of lowest rank (the leftmost of
equal ones) in each row. Where each piece began is kept, so ids decode to the
exact bytes of the text and to the offsets of the tokens.

Edge cases: a null text counts as empty and has no ids; extra columns are
ignored; repeated rows give repeated results; null ids stay null; a very long text
is a chunk of its own and read whole; an empty table gives no rows.
"""

import base64
import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.llm.chunks import IntMap, PieceCache, binary_slices, spread, text_bytes, text_chunks
from spark_explore.llm.pretokens import Splitter

LONG = 48  # bytes; longer pieces are merged one by one with a heap
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Merger:
    """Merges byte strings by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.pairs = IntMap(np.array(keys, np.uint64), np.array(values))

    def rank_of(self, a, b):
        found = self.pairs.get(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
        return np.where(found < 0, NONE, found)

    def merge_one(self, piece: bytes) -> list[int]:
        """One piece of any length in n log n steps."""
        n, get = len(piece), self.ranks.get
        end = list(range(1, n + 1)) + [n]
        before = list(range(-1, n))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue  # one of the two has changed since
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [get(piece[i:end[i]]) for i in range(n) if alive[i]]

    def _merge_rows(self, ids: np.ndarray, put) -> None:
        """Merges pieces of one length; ``put(rows, ids)`` takes the finished ones."""
        rows = np.arange(len(ids))
        rank = self.rank_of(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ids.shape[1] == 1:
                put(rows, ids)
                return
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                put(rows[done], ids[done])
                go = ~done
                rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
                if not len(rows):
                    return
            line, width = np.arange(len(rows)), ids.shape[1]
            ids = np.where(np.arange(width - 1) <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[line, at] = best
            if width == 2:
                put(rows, ids)
                return
            rank = np.where(np.arange(width - 2) < at[:, None], rank[:, :-1], rank[:, 1:])
            left = np.nonzero(at > 0)[0]
            rank[left, at[left] - 1] = self.rank_of(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.nonzero(at < width - 2)[0]
            rank[right, at[right]] = self.rank_of(ids[right, at[right]], ids[right, at[right] + 1])

    def merge_all(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every piece, one piece after another, and how many each has."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2], np.uint8) if pieces.buffers()[2] else np.empty(0, np.uint8)
        size = np.diff(offsets)
        counts = np.zeros(len(pieces), np.int64)
        owners, values, places = [], [], []

        def keep(owner, ids):
            counts[owner] = ids.shape[1]
            owners.append(np.repeat(owner, ids.shape[1]))
            places.append(np.tile(np.arange(ids.shape[1]), len(owner)))
            values.append(ids.ravel())

        for length in np.unique(size):
            same = np.nonzero(size == length)[0]
            if 0 < length <= LONG:
                ids = self.byte_id[data[offsets[same][:, None] + np.arange(length)]]
                self._merge_rows(ids, lambda rows, ids, same=same: keep(same[rows], ids))
            elif length:
                for i in same:
                    keep(np.array([i]), np.array([self.merge_one(data[offsets[i]:offsets[i + 1]].tobytes())]))
        flat = np.empty(int(counts.sum()), np.int64)
        if len(flat):
            starts = np.cumsum(counts) - counts
            flat[starts[np.concatenate(owners)] + np.concatenate(places)] = np.concatenate(values)
        return flat, counts


@dataclass
class Encoded:
    ids: np.ndarray
    texts: np.ndarray  # where each text's ids begin, with the end


class Encoder:
    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.cache = PieceCache(Merger(ranks).merge_all)
        self.splitter = Splitter()
        by_id: list = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.tokens = pa.array(by_id, pa.large_binary())
        self.token_bytes = np.array([len(t or b"") for t in by_id])
        self.numbers = pa.array([b"%d " % i for i in range(len(by_id))], pa.large_binary())

    def encode(self, column) -> Encoded:
        data, texts = text_bytes(column)
        offsets, first = self.splitter.pieces(data, texts)
        starts, lengths, flat = self.cache.look_up(binary_slices(data, offsets))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return Encoded(flat[spread(starts, lengths)], ends[first])

    def decode(self, encoded: Encoded) -> tuple[memoryview, np.ndarray]:
        """The bytes of all texts, and where each text begins, with the end."""
        return self._joined(self.tokens, encoded)

    def decimals(self, encoded: Encoded) -> tuple[memoryview, np.ndarray]:
        """The decimal ids of all texts, a blank after each."""
        return self._joined(self.numbers, encoded)

    @staticmethod
    def _joined(strings: pa.Array, encoded: Encoded) -> tuple[memoryview, np.ndarray]:
        taken = strings.take(pa.array(encoded.ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[:len(taken) + 1]
        data = memoryview(taken.buffers()[2]) if taken.buffers()[2] else memoryview(b"")
        return data, offsets[encoded.texts]


def _columns(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def encode(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every text, and the byte offset at which each token begins."""
    def run(batches):
        encoder = Encoder(ranks_path)
        for batch in text_chunks(batches, "text"):
            found = encoder.encode(batch.column("text"))
            size = encoder.token_bytes[found.ids]
            begin = np.cumsum(size) - size
            per_text = np.diff(found.texts)
            origin = np.append(begin, 0)[found.texts[:-1]]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.LargeListArray.from_arrays(found.texts, found.ids.astype(np.int32)).cast(pa.list_(pa.int32())),
                pa.LargeListArray.from_arrays(found.texts, begin - np.repeat(origin, per_text)).cast(pa.list_(pa.int64())),
            ], ["doc_id", "ids", "starts"])

    return _columns(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>")


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """The text of every list of ids (null: empty); ids must come from the same ranks."""
    def run(batches):
        encoder = Encoder(ranks_path)
        for batch in batches:
            ids = pc.fill_null(batch.column("ids"), [])
            texts = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))])
            data, at = encoder.decode(Encoded(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), texts))
            out = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of tokens, SHA-256 of the decimal ids, and SHA-256 of the bytes decoded from the ids."""
    def run(batches):
        encoder = Encoder(ranks_path)
        for batch in text_chunks(batches, "text"):
            found = encoder.encode(batch.column("text"))
            hashes = []
            for (data, at), last in ((encoder.decimals(found), 1), (encoder.decode(found), 0)):
                hashes.append([hashlib.sha256(data[a:max(a, b - last)]).hexdigest() for a, b in zip(at[:-1], at[1:])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(found.texts)), pa.array(hashes[0]), pa.array(hashes[1])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _columns(docs, doc_id, text).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
