"""Word shingles of texts as sets of 64-bit hashes, for whole Arrow chunks at once."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spark_explore.llm.chunks import spread, text_bytes

SET_BYTES = 1 << 20  # of texts whose sets are made side by side

M1, M2, M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a permutation of the 64-bit numbers."""
    x = x + M3
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _mix_one(x: int) -> int:
    """``mix`` of one number."""
    x = (x + int(M3)) % 2**64
    x = (x ^ (x >> 30)) * int(M1) % 2**64
    x = (x ^ (x >> 27)) * int(M2) % 2**64
    return x ^ (x >> 31)


def byte_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of every string of a large_binary array."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] else np.empty(0, np.uint8)
    size = np.diff(offsets)
    out = np.zeros(len(strings), np.uint64)
    todo = np.arange(len(strings))
    at = 0
    while len(todo := todo[size[todo] > at]):
        out[todo] = mix(out[todo] ^ (data[offsets[todo] + at].astype(np.uint64) + np.uint64(1)))
        at += 1
        if len(todo) < 64:  # a few long strings are left
            for i in todo:
                h = int(out[i])
                for byte in data[offsets[i] + at:offsets[i + 1]].tolist():
                    h = _mix_one(h ^ (byte + 1))
                out[i] = h
            break
    return mix(out ^ size.astype(np.uint64))


def words(column, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space, A-Z lower-cased, and where each text's begin, with the end."""
    data, offsets = text_bytes(column)
    data = data.lower() if lower else data
    texts = pa.Array.from_buffers(
        pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.copy()), pa.py_buffer(data)])
    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    flat = split.flatten()
    coded = flat.cast(pa.large_binary()).dictionary_encode()
    hashes = byte_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.uint64)
    blank = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if blank.any():
        before = np.concatenate([[0], np.cumsum(blank)])
        hashes, bounds = hashes[~blank], bounds - before[bounds]
    return hashes, bounds


_INSIDE = bytes(i != 0x20 and not 0x09 <= i <= 0x0D for i in range(256))
_BLOCK = 1 << 16  # bytes hashed side by side
_LONG = 64  # bytes of a word from which it is hashed byte by byte
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_BLOCK + _LONG, M1)]))
_INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_BLOCK + _LONG, np.uint64(pow(int(M1), -1, 2**64)))]))


def hashed_words(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space, as written, and where each text's begin, with the end.

    A word's hash is a polynomial over its bytes, taken from running sums over the text, so words are neither copied nor looked up.
    """
    data, offsets = text_bytes(column)
    byte = np.frombuffer(data, np.uint8)
    inside = np.frombuffer(data.translate(_INSIDE), bool)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(byte))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    size = ends - starts
    out = np.empty(len(starts), np.uint64)
    blocks = np.searchsorted(starts, np.arange(0, len(byte) + _BLOCK, _BLOCK))
    for block, (i, j) in enumerate(zip(blocks[:-1], blocks[1:])):
        at = block * _BLOCK
        part = byte[at:at + _BLOCK + _LONG].astype(np.uint64)
        part += np.uint64(1)
        part *= _POWERS[:len(part)]
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=run[1:])
        first = starts[i:j] - at
        last = np.minimum(ends[i:j] - at, len(part))
        out[i:j] = (run[last] - run[first]) * _INVERSE[first]
    out = mix(mix(out) ^ size.astype(np.uint64))
    if len(long := np.flatnonzero(size > _LONG)):
        out[long] = byte_hashes(pa.array([data[starts[i]:ends[i]] for i in long], pa.large_binary()))
    return out, np.searchsorted(starts, offsets)


def word_sets(column, often=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the words of every text, sorted or first by ``often(hashes)`` (up to 2^20), and where each text's begin, with the end.

    Text, order and place of a word are sorted as one number, a fraction of a sort by several keys; only texts with words which that
    leaves undecided are sorted by their whole hashes.
    """
    hashes, bounds = hashed_words(column)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    often = np.zeros(len(hashes), np.int64) if often is None else np.minimum(often(hashes), (1 << 20) - 1)
    places = len(hashes).bit_length()
    left = 44 - places - len(bounds).bit_length()  # bits of the hash
    if left < 1:
        order = np.lexsort((hashes, often, owner))
    else:
        value = (owner << 20 | often).astype(np.uint64) << np.uint64(left) | hashes >> np.uint64(64 - left)
        both = np.sort(value << np.uint64(places) | np.arange(len(hashes), dtype=np.uint64))
        order = (both & np.uint64((1 << places) - 1)).astype(np.int64)
        both >>= np.uint64(places)
        tie = (both[1:] == both[:-1]) & (hashes[order[1:]] != hashes[order[:-1]])
        if tie.any():
            some = np.zeros(len(bounds) - 1, bool)
            some[owner[order[1:][tie]]] = True
            at = np.flatnonzero(some[owner])  # texts lie at the same places before and after
            order[at] = at[np.lexsort((hashes[at], often[at], owner[at]))]
    hashes = hashes[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[first], np.searchsorted(owner[first], np.arange(len(bounds)))


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every text."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[first], np.searchsorted(owner[first], np.arange(len(bounds)))


def shingle_sets(column, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every text; a text of fewer words has its whole sequence as one."""
    hashes, bounds = words(column)
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    starts = spread(bounds[:-1], count)
    ends = np.repeat(bounds[1:], count)
    rolled = np.zeros(len(starts), np.uint64)
    for k in range(width):
        at = starts + k
        inside = at < ends
        word = np.where(inside, hashes[np.minimum(at, max(len(hashes) - 1, 0))], np.uint64(k + 1)) if len(hashes) else np.empty(0, np.uint64)
        rolled = mix(rolled ^ word) * M1
    return distinct(mix(rolled), np.concatenate([[0], np.cumsum(count)]))
