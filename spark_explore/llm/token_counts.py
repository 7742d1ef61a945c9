"""Exact token counts at every prefix of a text, for byte-level BPE vocabularies.

Within one piece of text the encoding of a prefix ends with exactly one token
``t`` that (a) ends there and (b) stays apart from the last token of the
prefix before it: the pair of the two encodes to itself. So
``count[i] = count[i - len(t)] + 1``, and one sweep over the end positions
fills the table of all prefixes. Distinct pieces of one length are swept side
by side. Over the pieces of a text the counts add up, which answers how many
tokens any prefix has and which prefix fits a budget, without encoding again.

A prefix that ends within white space is one piece of white space at its end
(not the part of a word that the whole text makes of it), and one that cuts
a two-letter contraction is an apostrophe and a letter.

Special tokens inside a text count as one each, as the tokenizers library
takes them by default.

Edge cases: a null text counts as empty (0 tokens); extra columns are ignored;
repeated rows give repeated results; null ids stay null; a very long text is a
chunk of its own and counted whole; an empty table gives no rows.
"""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.llm.chunks import IntMap, PieceCache, binary_slices, spread, text_bytes, text_chunks
from spark_explore.llm.pretokens import Splitter

LONG = 64  # bytes; longer pieces are swept one by one
BASE = np.uint64(0x100000001B3)


def byte_names() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and specials of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names = byte_names()
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        special = {t["content"] for t in spec["added_tokens"]}
        raw = {bytes(names[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # Tokens are renumbered: bytes first, then by the order of their merges, so numbers are ranks.
        self.tokens = [bytes([b]) for b in range(256)]
        rank = {t: i for i, t in enumerate(self.tokens)}
        left, right, pairs = list(range(256)), list(range(256)), []
        for a, b in merges:
            a, b = (bytes(names[c] for c in x) for x in (a, b))
            if a + b not in rank:
                rank[a + b] = len(self.tokens)
                self.tokens.append(a + b)
                left.append(rank[a])
                right.append(rank[b])
            pairs.append((rank[a] << 32 | rank[b], rank[a + b]))
        assert len(rank) == len(raw) and raw.keys() == rank.keys(), "the merges don't give the vocabulary"
        self.rank = rank
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.pairs = IntMap(np.array([k for k, _ in pairs], np.uint64), np.array([v for _, v in pairs]))
        self.longest = max(map(len, self.tokens))
        keys = []
        for token in self.tokens:
            h = 0
            for byte in token:
                h = (h * int(BASE) + byte + 1) % 2**64
            keys.append(h)
        assert len(set(keys)) == len(keys)
        self.by_hash = IntMap(np.array(keys, np.uint64), np.arange(len(keys)))
        self.apart = {}

    def stay_apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the two tokens, one after the other, encode to themselves.

        Looks at the pairs that meet at the border while both are built up: going back from the whole
        tokens, the one merged last is undone. A pair that would have merged across the border
        earlier than the merges undone since shows that they don't stay apart.
        """
        out = np.ones(len(first), bool)
        row = np.arange(len(first))
        a, b = first.copy(), second.copy()
        limit = np.full(len(first), 2**31)
        while len(row):
            crossing = self.pairs.get(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
            merged = (crossing >= 0) & (crossing < limit)
            out[row[merged]] = False
            go = ~merged & ((a >= 256) | (b >= 256))
            row, a, b = row[go], a[go], b[go]
            # The later of the two merges is undone; at equal rank the left one came first.
            from_left = a > b
            limit = np.where(from_left, a, b + 1)
            a, b = np.where(from_left, self.right[a], a), np.where(from_left, b, self.left[b])
        return out

    def sweep_rows(self, data: np.ndarray) -> np.ndarray:
        """Counts at every prefix of pieces of one length, given as rows of bytes."""
        n, length = data.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for i in range(length):
            prefix[i + 1] = prefix[i] * BASE + (data[:, i] + np.uint64(1))
        power = [np.uint64(1)]
        for _ in range(length):
            power.append(np.uint64(int(power[-1]) * int(BASE) % 2**64))
        last = np.full((length + 1, n), -1, np.int64)
        count = np.zeros((length + 1, n), np.int64)
        for i in range(1, length + 1):
            todo = np.arange(n)
            for size in range(1, min(i, self.longest) + 1):  # one size fits; short tokens are the usual ones
                start = i - size
                token = self.by_hash.get(prefix[i, todo] - prefix[start, todo] * power[size]).astype(np.int64)
                known = np.nonzero(token >= 0)[0]
                if not len(known):
                    continue
                rows, token = todo[known], token[known]
                if start:
                    good = self.stay_apart(last[start, rows], token)
                    known, rows, token = known[good], rows[good], token[good]
                last[i, rows] = token
                count[i, rows] = count[start, rows] + 1
                todo = np.delete(todo, known)
                if not len(todo):
                    break
        return count[1:].T

    def sweep_one(self, piece: bytes) -> np.ndarray:
        """The same for one piece of any length."""
        n = len(piece)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for start in range(max(0, i - self.longest), i):
                token = self.rank.get(piece[start:i])
                if token is None:
                    continue
                if start:
                    pair = last[start] << 32 | token
                    if pair not in self.apart:
                        self.apart[pair] = bool(self.stay_apart(np.array([last[start]]), np.array([token]))[0])
                    if not self.apart[pair]:
                        continue
                last[i], count[i] = token, count[start] + 1
                break
        return np.array(count[1:], np.int64)

    def sweep_all(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts at every byte prefix of every piece."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2], np.uint8) if pieces.buffers()[2] else np.empty(0, np.uint8)
        size = np.diff(offsets)
        starts = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.int64)
        for length in np.unique(size):
            same = np.nonzero(size == length)[0]
            if 0 < length <= LONG:
                rows = data[offsets[same][:, None] + np.arange(length)]
                flat[starts[same][:, None] + np.arange(length)] = self.sweep_rows(rows)
            elif length:
                for i in same:
                    flat[starts[i]:starts[i] + length] = self.sweep_one(data[offsets[i]:offsets[i + 1]].tobytes())
        return flat, size


class Counter:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.cache = PieceCache(self.vocabulary.sweep_all)
        self.splitter = Splitter()

    def _sections(self, data: bytes, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts cut at special tokens: offsets, and which sections are special."""
        cuts = []
        for special in self.vocabulary.specials:
            at = data.find(special)
            while at >= 0:
                text = np.searchsorted(texts, at, side="right") - 1
                if at + len(special) <= texts[text + 1]:
                    cuts.append((at, at + len(special)))
                at = data.find(special, at + len(special))
        if not cuts:
            return texts, np.zeros(len(texts) - 1, bool)
        offsets = np.unique(np.concatenate([texts, np.array(cuts).ravel()]))
        special = np.zeros(len(offsets) - 1, bool)
        special[np.searchsorted(offsets, [a for a, _ in cuts])] = True
        return offsets, special

    def table(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Tokens of every byte prefix of every text, counted from the text's begin; the texts' offsets; the tokens
        of whole texts; and the bytes. Only the ends of characters have a meaning."""
        data, texts = text_bytes(column)
        sections, special = self._sections(data, texts)
        offsets, first = self.splitter.pieces(data, sections)
        n = len(offsets) - 1
        slices = binary_slices(data, offsets)
        starts, lengths, flat = self.cache.look_up(slices)
        own = np.zeros(n, bool)
        for i in np.nonzero(special)[0]:
            own[first[i]:first[i + 1]] = True
        totals = flat[starts + lengths - 1] if n else np.empty(0, np.int64)
        totals = np.where(own, 0, totals)
        if special.any():
            totals[first[:-1][special]] = 1
        before = np.cumsum(totals) - totals
        counts = np.repeat(before, lengths) + flat[spread(starts, lengths)]
        if special.any():
            for i in np.nonzero(special)[0]:  # the special token is whole at its last byte only
                a, b = sections[i], sections[i + 1]
                text = sections[i - 1] if i and not special[i - 1] and not np.isin(a, texts) else a
                origin = before[first[i - 1]] if text < a else before[first[i]]
                counts[a:b] = origin + self._plain(data[text:b - 1] + b"_")[a - text:]
                counts[b - 1] = before[first[i]] + 1
        self._mend(data, offsets, before, counts, own, sections)
        at = np.searchsorted(offsets, texts)
        whole = np.append(before, totals.sum())
        owner = np.repeat(whole[at[:-1]], np.diff(texts))
        return counts - owner, texts, whole[at[1:]] - whole[at[:-1]], data

    def _plain(self, data: bytes) -> np.ndarray:
        """Counts at the prefixes of a few bytes that are no special token."""
        offsets, _ = self.splitter.pieces(data, np.array([0, len(data)]))
        starts, lengths, flat = self.cache.look_up(binary_slices(data, offsets))
        totals = flat[starts + lengths - 1]
        return np.repeat(np.cumsum(totals) - totals, lengths) + flat[spread(starts, lengths)]

    def _mend(self, data, offsets, before, counts, own, sections) -> None:
        """Prefixes that the pieces of the whole text don't show: those that end within white space or contractions."""
        raw = np.frombuffer(data, np.uint8)
        n = len(offsets) - 1
        if not n:
            return
        size = np.diff(offsets)
        head = raw[offsets[:-1]]
        # A run of white space of several pieces: its last piece is taken into a word, or stands alone.
        ascii_white, wide_white = np.zeros(256, bool), np.zeros(256, bool)
        ascii_white[[9, 10, 11, 12, 13, 32]] = wide_white[[0xC2, 0xE1, 0xE2, 0xE3]] = True
        tail = raw[offsets[1:] - 1]
        begins = ascii_white[head] | wide_white[head]
        second = raw[np.minimum(offsets[:-1] + 1, len(raw) - 1)]
        ends = ascii_white[tail] | ((tail >= 0x80) & (wide_white[head] | (ascii_white[head] & wide_white[second])))
        follows = np.zeros(n, bool)
        follows[1:] = begins[1:] & begins[:-1] & ends[:-1] & ~own[1:] & ~own[:-1]
        follows[1:][follows[1:]] = ~np.isin(offsets[1:-1][follows[1:]], sections)
        for i in np.nonzero(follows)[0]:
            run = data[offsets[i - 1]:offsets[i]].decode("utf-8")
            rest = data[offsets[i]:offsets[i + 1]].decode("utf-8")
            white = self.splitter.table
            if any(white[ord(c)] != 3 for c in run) or white[ord(rest[0])] != 3:
                continue
            joined = (run + rest[0]).encode()
            starts, lengths, flat = self.cache.look_up(pa.array([joined], pa.large_binary()))
            end = offsets[i - 1] + len(joined)
            counts[offsets[i - 1]:end] = before[i - 1] + flat[starts[0]:starts[0] + lengths[0]]
        cut = np.nonzero((head == ord("'")) & (size == 3) & ~own)[0]
        for i in cut:
            piece = data[offsets[i]:offsets[i + 1]]
            if piece in (b"'re", b"'ve", b"'ll"):
                counts[offsets[i] + 1] = before[i] + 2


def _columns(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def _character_ends(data: bytes) -> np.ndarray:
    """Marks the last byte of every character."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.ones(len(raw), bool)
    ends[:-1] = (raw[1:] & 0xC0) != 0x80
    return ends


def prefix_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``counts[i]``: the tokens of the first ``i + 1`` code points of the text."""
    def run(batches):
        counter = Counter(path)
        for batch in text_chunks(batches, "text"):
            counts, texts, _, data = counter.table(batch.column("text"))
            ends = _character_ends(data)
            offsets = np.concatenate([[0], np.cumsum(ends)])[texts]
            lists = pa.LargeListArray.from_arrays(offsets, counts[ends].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists.cast(pa.list_(pa.int32()))], ["doc_id", "counts"])

    return _columns(docs, doc_id, text).mapInArrow(run, "doc_id long, counts array<int>")


def tokens_at(counts: DataFrame, n_chars) -> DataFrame:
    """Tokens of the prefix of ``n_chars`` code points (a column or number; beyond the end: of the whole text)."""
    n = F.least(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.size("counts"))
    return counts.select("doc_id", F.when(n <= 0, 0).otherwise(F.get("counts", n - 1)).alias("n_tokens"))


def summary(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text its bytes, tokens, whether it has more than ``limit`` tokens, and ``fits_chars``: the code points of
    its longest prefix of at most ``limit`` tokens."""
    def run(batches):
        counter = Counter(path)
        for batch in text_chunks(batches, "text"):
            counts, texts, totals, data = counter.table(batch.column("text"))
            ends = _character_ends(data)
            fits = ends & (counts <= limit)
            number = np.cumsum(ends)
            # The last fitting prefix of every text; numbers count the characters of all texts before.
            best = np.maximum.accumulate(np.where(fits, number, 0)) if len(number) else number
            upto = np.concatenate([[0], number])[texts]
            last = np.concatenate([[0], best])[texts[1:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(texts)), pa.array(totals), pa.array(totals > limit),
                 pa.array(np.maximum(last, upto[:-1]) - upto[:-1])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"])

    return _columns(docs, doc_id, text).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")
