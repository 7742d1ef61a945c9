"""Arrow chunks of bounded size, ragged arrays and hash tables for the vectorised operators."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 6 << 20


def text_chunks(batches, column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_bytes`` of text, or one row if that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column) -> tuple[bytes, np.ndarray]:
    """The texts one after another, and the byte offsets of their ends and the first start; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data else b""
    return data, offsets - offsets[0]


def binary_slices(data: bytes, offsets: np.ndarray) -> pa.Array:
    """Adjacent slices of ``data`` as an Arrow array, without copying."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1``, one range after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i + 1]]`` for every i."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]


class PieceCache:
    """Integers computed once per distinct byte string.

    ``compute`` takes an Arrow array of new strings and returns their integers,
    one string after another, and how many each has. The cache starts anew
    when it holds more than ``limit`` strings.
    """

    def __init__(self, compute: Callable, limit: int = 1_000_000):
        self.compute, self.limit = compute, limit
        self._clear()

    def _clear(self):
        self.pieces = pa.array([], pa.large_binary())
        self.flat, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64)

    def look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length in ``flat`` for every piece; and ``flat``."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        if len(self.pieces) > self.limit:
            self._clear()
        at = pc.index_in(distinct, value_set=self.pieces)
        new = distinct.filter(pc.is_null(at))
        if len(new):
            flat, lengths = self.compute(new)
            at = at.to_numpy(zero_copy_only=False)
            missing = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
            at = np.where(missing, 0, at).astype(np.int64)
            at[missing] = len(self.pieces) + np.arange(len(new))
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.lengths = np.concatenate([self.lengths, lengths])
        else:
            at = at.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        return starts[at], self.lengths[at], self.flat


class IntMap:
    """Hash table from 64-bit keys to non-negative integers; unknown keys give -1."""

    FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, values = np.asarray(keys, np.uint64), np.asarray(values, np.int32)
        self.levels = []
        while len(keys):
            bits = max(4, int(np.ceil(np.log2(3 * len(keys)))))
            factor = np.uint64(self.FACTORS[len(self.levels) % 4] + 2 * (len(self.levels) // 4))
            slot = (keys * factor) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            held = np.zeros(1 << bits, np.uint64)
            value = np.full(1 << bits, -1, np.int32)
            held[slot[first]], value[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            more = np.zeros(1 << bits, bool)
            more[slot[rest]] = True
            self.levels.append((factor, np.uint64(64 - bits), held, value, more))
            keys, values = keys[rest], values[rest]

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, -1, np.int32)
        open_at = None
        for factor, shift, held, value, more in self.levels:
            asked = keys if open_at is None else keys[open_at]
            slot = (asked * factor) >> shift
            found = np.where(held[slot] == asked, value[slot], np.int32(-1))
            missed = (found < 0) & more[slot]
            if open_at is None:
                out, open_at = found, np.nonzero(missed)
            else:
                out[open_at] = found
                open_at = tuple(x[missed] for x in open_at)
            if not len(open_at[0]):
                break
        return out
