"""Text to vector. The encoder is a function Column -> Column of an array of numbers.

``hashed_encoder`` is the built-in one: a hashed bag of words, counted batch by
batch in an ``arrow_udf``. A neural encoder is plugged in as a function of the same shape.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_explore.functions.vectors import l2_normalize

# Fixed values of the hashed encoder: a token is a run of a-z and 0-9.
DIM = 64
TOKEN_BYTES = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))

# Bytes of text whose tokens are held at once; a longer text is read alone.
CHUNK_BYTES = 4 << 20


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def _counts(texts: pa.Array) -> np.ndarray:
    """How many tokens of each text fall into each bucket, md5's leading 32 bits modulo 64."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    inside = TOKEN_BYTES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    first[starts] = inside[starts]
    first = np.nonzero(first)[0]
    if not len(first):
        return np.zeros((len(texts), DIM), np.int64)
    # The bytes of all tokens, one after another, and where each begins among them.
    kept = data[inside]
    ends = np.append((np.cumsum(inside, dtype=np.int64) - 1)[first], len(kept))
    tokens = pa.Array.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(kept)]).dictionary_encode()
    bucket = np.array([hashlib.md5(token).digest()[3] % DIM for token in tokens.dictionary.to_pylist()])
    owner = np.searchsorted(offsets, first, side="right") - 1
    place = owner * DIM + bucket[tokens.indices.to_numpy()]
    return np.bincount(place, minlength=len(texts) * DIM).reshape(-1, DIM)


def hashed_encoder(text: Column) -> Column:
    """Counts of a text's tokens by hashed bucket; all zero where there is no token."""

    @F.arrow_udf("array<long>")
    def counts(texts: pa.Array) -> pa.Array:
        rows = np.concatenate([np.empty((0, DIM), np.int64), *map(_counts, _slices(texts))])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * DIM, pa.int32()), pa.array(rows.ravel()))

    # Spark's own lower case decides which characters become letters of a token.
    return counts(F.lower(text))


def embed_text(
    df: DataFrame,
    text: str,
    vector: str = "query_vec",
    encoder: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add the unit vector of each text; null when the text has no token. No shuffle."""
    return df.withColumn(vector, l2_normalize((encoder or hashed_encoder)(F.col(text))))
