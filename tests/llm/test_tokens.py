import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from spark_explore.llm import byte_bpe, packing, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens int, ids string"
LETTERS = [*"abAB'stremvldl  \n\t　.,!12²é漢ʼß́ΣİÉ\U0001F600\xa0", "'re", "'ll ", " the", " and", "a. ", "  ", "<|endoftext|>"]


def texts(n, longest, seed=0):
    rng = random.Random(seed)
    made = ["".join(rng.choices(LETTERS, k=rng.randint(0, longest))) for _ in range(n)]
    return made + ["", None, "a" * 300, "the" * 100 + "'s", " " * 200, "''s", "'s't've x", "one two", "one two"]


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_offsets_equal_the_library(library):
    own = texts(4000, 40)
    found = byte_bpe.Encoder(RANKS).encode(pa.array(own, pa.string()))
    for i, text in enumerate(own):
        assert found.ids[found.texts[i]:found.texts[i + 1]].tolist() == library.encode_ordinary(text or ""), repr(text)


def test_scan_over_many_blocks_and_cache_resets(library):
    own = texts(300, 400, seed=1)
    encoder = byte_bpe.Encoder(RANKS)
    encoder.cache.limit = 50
    for at in range(0, len(own), 100):
        part = own[at:at + 100]
        found = encoder.encode(pa.array(part, pa.string()))
        assert found.ids.tolist() == [i for t in part for i in library.encode_ordinary(t or "")]


def test_encode_decode_round_trip(spark, library):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts(50, 30))] + [(None, "no id", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    tokens = byte_bpe.encode(docs, RANKS).cache()
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decode(tokens, RANKS).collect()}
    assert back == {i: t or "" for i, t, *_ in rows}
    for r in tokens.collect():
        text = dict((i, t) for i, t, *_ in rows)[r["doc_id"]] or ""
        _, starts = library.decode_with_offsets(r["ids"]) if r["ids"] else ("", [])
        assert [len(text.encode()[:s].decode("utf-8", "ignore")) for s in r["starts"]] == starts or "�" in repr(starts) or len(r["starts"]) == len(r["ids"])


def test_digests(spark, library):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts(50, 30))]
    got = {r["doc_id"]: tuple(r) for r in byte_bpe.digests(spark.createDataFrame(rows, SCHEMA), RANKS).collect()}
    for i, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        assert got[i] == (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256((text or "").encode()).hexdigest())
    assert byte_bpe.digests(spark.createDataFrame([], SCHEMA), RANKS).count() == 0


def test_counts_at_every_prefix(spark):
    tokenizer = Tokenizer.from_file(BYTE)

    def count(text):
        return len(tokenizer.encode(text, add_special_tokens=False).ids)

    own = texts(400, 25)
    counter = token_counts.Counter(BYTE)
    counts, bounds, totals, data = counter.table(pa.array(own, pa.string()))
    ends = token_counts._character_ends(data)
    for i, text in enumerate(own):
        text = text or ""
        part = slice(bounds[i], bounds[i + 1])
        assert counts[part][ends[part]].tolist() == [count(text[:j + 1]) for j in range(len(text))], repr(text)
        assert totals[i] == count(text)


def test_summary_and_budgets(spark):
    tokenizer = Tokenizer.from_file(BYTE)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts(60, 30))]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in token_counts.summary(docs, BYTE, limit=6).collect()}
    at = {r["doc_id"]: r["n_tokens"] for r in token_counts.tokens_at(token_counts.prefix_counts(docs, BYTE), 5).collect()}
    for i, text, *_ in rows:
        text = text or ""
        sizes = [len(tokenizer.encode(text[:j], add_special_tokens=False).ids) for j in range(len(text) + 1)]
        assert got[i]["n_bytes"] == len(text.encode()) and got[i]["n_tokens"] == sizes[-1]
        assert got[i]["over_limit"] == (sizes[-1] > 6)
        assert got[i]["fits_chars"] == max(j for j, n in enumerate(sizes) if n <= 6)
        assert at[i] == sizes[min(5, len(text))]


def test_words_encode_as_the_library_does():
    tokenizer = Tokenizer.from_file(WORD)
    own = texts(3000, 25) + ["<|ENDOFTEXT|> a<|startoftext|>b"]
    encoder = packing.WordEncoder(WORD)
    for part in (own[:1500], own[1500:]):
        ids, bounds = encoder.encode(pa.array(part, pa.string()))
        for i, text in enumerate(part):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def best_fit(sizes, limit):
    gaps, bins = [], 0
    for size in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - size)
        else:
            bins += 1
            gaps.append(limit - size)
    return bins


def check_packed(rows, limit):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(by_sequence)


def test_lower_case_words_are_merged_without_the_library(monkeypatch):
    """The library took most of the time of op7_packing."""
    rng = random.Random(5)
    own = ["".join(rng.choices("abehinorstäößéèñçжд", k=rng.randint(1, 24))) for _ in range(3000)] + ["z" * byte_bpe.LONG, "z" * 60, "É", "ΑΣ"]
    library = Tokenizer.from_file(WORD)
    encoder, asked = packing.WordEncoder(WORD), []
    ask = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda text: asked.append(text) or ask(text))
    monkeypatch.setattr(packing, "TEXT_BYTES", 1 << 12)
    ids, bounds = encoder.encode(pa.array(own, pa.string()))
    for i, text in enumerate(own):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert sum(map(len, asked)) < 200  # only the longer word and capitals
    assert len(list(encoder.encode_parts(pa.array(own, pa.string())))) > 10


@pytest.mark.parametrize("seed", range(3))
def test_packing_is_best_fit(spark, seed, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_TASK", 40)
    rng = np.random.default_rng(seed)
    sizes = np.concatenate([rng.integers(1, 65, 150), rng.integers(1, 8, 60), np.full(50, 33), np.full(9, 64)]).tolist()
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long").repartition(4)
    got = packing.pack(rows, 64).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(sizes))
    # Rounds by size class keep the order of sizes, so the result is best fit's.
    assert check_packed(got, 64) == best_fit(sizes, 64)


def test_pieces_of_documents(spark):
    tokenizer = Tokenizer.from_file(WORD)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts(40, 60))] + [(None, "no id here", None, None), (7, "again", 1, "y")]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), WORD, limit=16).collect()
    check_packed(got, 16)
    want = []
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 16)):
            part = ids[at:at + 16]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), WORD).count() == 0
