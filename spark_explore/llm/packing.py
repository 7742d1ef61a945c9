"""Best-fit packing of tokenized documents into sequences of bounded length.

Bulk-synchronous best fit, largest sizes first. A round takes the documents
of one class of sizes. Documents and the gaps of the open sequences are sorted
by size over ranges of Spark partitions, so each has a position. A sweep over
the sizes, from the largest document down, gives every run of documents the
run of smallest gaps that holds it and opens sequences where none does; it
works on counts by size, of which there are at most ``limit``. Documents that
want the same gap are told apart by rank: the i-th of a run gets the i-th gap.
Every task places its documents by their positions, the gaps shrink, and the
next round begins.

Edge cases: a null or empty text is one document that holds the end token
only; repeated rows are packed each by itself; null ids are kept; an empty
table gives no rows; a very long text is encoded whole and cut into pieces;
extra columns are ignored.
"""

import json
import os
import zlib
from bisect import bisect_left, insort
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.llm.byte_bpe import LONG, Merger
from spark_explore.llm.chunks import IntMap, PieceCache, binary_slices, spread, text_bytes, text_chunks
from spark_explore.sizing import cut_lineage

ROWS_PER_TASK = 500_000
# Lower ends of the size classes, as parts of the limit; one round each.
CLASSES = (1 / 2, 1 / 4, 1 / 8, 0)
TEXT_BYTES = 1 << 20  # of texts whose ids are put together side by side


class UnitMerger(Merger):
    """Merges the bytes of units of the vocabulary, which end with tokens of their own, by its list of merges."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], end: str):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.end_id = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.uint64)
        merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.in_order = bool((np.diff(merged) > 0).all())  # an id is also the rank of its merge
        self.pairs = IntMap(keys, merged)

    def first_ids(self, data: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
        ids = self.byte_id[data[begin[:, None] + np.arange(length)]]
        ids[:, -1] = self.end_id[data[begin + length - 1]]
        return ids


class WordEncoder:
    """Ids of the distinct words, each encoded once.

    The vocabulary drops white space and case, and no token reaches across white space, so a text's ids are those of
    its words in lower case; nor does one join a letter and a full stop or comma, so those are split off at the end of
    words. New words of lower-case letters are merged side by side; others are encoded in bulk, kept apart by a special
    token, which the library takes out first.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        specials = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark, self.mark_text = next(iter(specials.items()))
        self.specials = list(specials.values())
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.units = UnitMerger(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.bases = PieceCache(self._encode_bases)
        self.cache = PieceCache(self._encode_words)
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.ending = np.zeros(256, np.int64)
        for mark in ".,":
            self.ending[ord(mark)] = self._ids("a" + mark)[-1]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        size = np.diff(offsets)
        some = np.nonzero(size > 1)[0]
        before, last = data[offsets[some + 1] - 2], data[offsets[some + 1] - 1]
        suffix = np.zeros(len(words), np.int64)
        suffix[some] = np.where((before >= ord("a")) & (before <= ord("z")), self.ending[last], 0)
        cut = size - (suffix > 0)
        ends = np.concatenate([[0], np.cumsum(cut)])
        starts, lengths, flat = self.bases.look_up(binary_slices(data[spread(offsets[:-1], cut)].tobytes(), ends))
        whole = lengths + (suffix > 0)
        begin = np.cumsum(whole) - whole
        out = np.empty(int(whole.sum()), np.int64)
        out[spread(begin, lengths)] = flat[spread(starts, lengths)]
        out[(begin + lengths)[suffix > 0]] = suffix[suffix > 0]
        return out, whole

    def _units(self, words: pa.Array, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, dict[int, str]]:
        """Which words are units of lower-case letters, and the texts of the others."""
        running = np.concatenate([[0], np.cumsum((data < ord("a")) | (data > ord("z")))])
        unit = running[offsets[1:]] == running[offsets[:-1]]
        texts = {}
        for i in np.nonzero(~unit)[0].tolist():
            text = words[i].as_py().decode("utf-8")
            # Letters only, also after normalisation, which changes nothing.
            unit[i] = not text.isascii() and text.isalpha() and text == text.lower() and is_normalized("NFC", text)
            texts[i] = text
        size = np.diff(offsets)
        long = np.nonzero(unit & ((size > LONG) | (not self.units.in_order)))[0]
        unit[long] = False
        texts |= {i: words[i].as_py().decode("utf-8") for i in long.tolist()}
        return unit & (size > 0), {i: text for i, text in texts.items() if not unit[i]}

    def _encode_bases(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[:offsets[-1]]
        unit, texts = self._units(words, offsets, data)
        rest = np.array(list(texts), np.int64)
        # A word of letters only, also after normalisation, is one unit of the vocabulary and ends with its only end token.
        plain = np.array([w.isalpha() and (w.isascii() or w.lower().isalpha() and is_normalized("NFC", w)) for w in texts.values()], bool)
        odd = np.array([any(s in w for s in self.specials) for w in texts.values()], bool)
        groups = []
        for some, mark in ((plain, " "), (~plain & ~odd, self.mark_text)):
            at = rest[some]
            for start in range(0, len(at), 20_000):
                own = at[start:start + 20_000]
                ids = np.array(self._ids(mark.join([texts[i] for i in own])), np.int64)
                if mark == " ":
                    ends = np.nonzero(self.is_end[ids])[0] + 1
                    groups.append((own, ids, np.diff(ends, prepend=0)))
                else:
                    marks = np.nonzero(ids == self.mark)[0]
                    counts = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
                    groups.append((own, ids[ids != self.mark], counts))
        for i in rest[odd].tolist():
            ids = np.array(self._ids(texts[i]), np.int64)
            groups.append((np.array([i]), ids, np.array([len(ids)])))
        size = np.where(unit, np.diff(offsets), 0)
        for length in np.unique(size[size > 0]).tolist():
            same = np.nonzero(size == length)[0]
            self.units._merge_rows(
                self.units.first_ids(data, offsets[same], length),
                lambda rows, ids, same=same: groups.append((same[rows], ids.ravel(), np.full(len(rows), ids.shape[1]))))
        lengths = np.zeros(len(words), np.int64)
        for own, _, counts in groups:
            lengths[own] = counts
        begin = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.int64)
        for own, ids, counts in groups:
            flat[spread(begin[own], counts)] = ids
        return flat, lengths

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), and where each text's begin, with the end."""
        parts = [(ids, np.diff(bounds)) for ids, bounds in self.encode_parts(column)]
        ids, sizes = (np.concatenate([np.empty(0, np.int64), *own]) for own in zip(*parts)) if parts else (np.empty(0, np.int64),) * 2
        return ids, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def encode_parts(self, column):
        """``encode`` for about ``TEXT_BYTES`` of the texts after another; their words are looked up together."""
        data, offsets = text_bytes(column)
        if b"<|" not in data:  # special tokens are known by their case
            data = data.lower()
        words = pc.ascii_split_whitespace(pa.Array.from_buffers(
            pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.copy()), pa.py_buffer(data)]))
        del data
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        starts, lengths, flat = self.cache.look_up(words.flatten().cast(pa.large_binary()))
        del words
        cuts = np.searchsorted(offsets, np.arange(TEXT_BYTES, offsets[-1], TEXT_BYTES))
        cuts = np.unique(np.concatenate([[0], cuts, [len(offsets) - 1]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = slice(bounds[a], bounds[b])
            ends = np.concatenate([[0], np.cumsum(lengths[own])])
            yield flat[spread(starts[own], lengths[own])], ends[bounds[a:b + 1] - bounds[a]]


def tokenized_pieces(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 1,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as ids with an end token, cut where longer than ``limit``: doc_id, piece, start, length, ids_crc32."""
    def run(batches):
        encoder = WordEncoder(path)
        for batch in text_chunks(batches, "text"):
            done = 0
            for ids, bounds in encoder.encode_parts(batch.column("text")):
                ids = ids.astype("<u4")
                row, piece, start, length, crc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    own = np.append(ids[a:b], np.uint32(end_id))
                    for k, at in enumerate(range(0, len(own), limit)):
                        part = own[at:at + limit]
                        row.append(done + i), piece.append(k), start.append(at)
                        length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                done += len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(docs: dict[int, int], gaps: dict[int, int], limit: int) -> tuple[np.ndarray, int]:
    """Places runs of documents, largest first, into the smallest gaps that hold them.

    ``docs`` and ``gaps`` count by size; positions count from 0 in order of falling size. Returns rows (first document
    position, is new, first target, offset in the round): document i of a run goes to target i. Also how many
    sequences were opened.
    """
    runs, at = {}, 0
    for size in sorted(gaps, reverse=True):
        runs[size] = [(False, at, gaps[size], 0)]
        at += gaps[size]
    order = sorted(runs)
    rows, opened, position = [], 0, 0

    def put(size, run):
        if size not in runs:
            runs[size] = []
            insort(order, size)
        runs[size].append(run)

    for size in sorted(docs, reverse=True):
        left = docs[size]
        while left:
            k = bisect_left(order, size)
            if k == len(order):
                fresh = -(-left // (limit // size))
                put(limit, (True, opened, fresh, 0))
                opened += fresh
                continue
            gap = order[k]
            new, first, count, used = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], order[k]
            taken = min(count, left)
            rows.append((position, new, first, used))
            if taken < count:
                put(gap, (new, first + taken, count - taken, used))
            if gap > size:
                put(gap - size, (new, first, taken, used + size))
            position += taken
            left -= taken
    return np.array(rows, np.int64).reshape(-1, 4), opened


def _counts(df: DataFrame) -> dict[int, int]:
    return {r[0]: r[1] for r in df.groupBy("size").count().collect()}


def _sorted(df: DataFrame, rows: int, *ties: str) -> tuple[DataFrame, dict[int, int]]:
    """``df`` sorted by falling size over ranges, with ``at`` for the place in its partition, and where partitions begin."""
    order = [F.desc("size"), *ties]
    parts = -(-rows // ROWS_PER_TASK)
    df = cut_lineage(df.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order))
    df = df.withColumn("at", F.monotonically_increasing_id())
    sizes = {r[0]: r[1] for r in df.groupBy(F.shiftright("at", 33).alias("part")).count().collect()}
    begins, total = {}, 0
    for part in sorted(sizes):
        begins[part] = total
        total += sizes[part]
    return df, begins


def _positions(at: np.ndarray, begins: dict[int, int]) -> np.ndarray:
    part = at >> 33
    first = np.zeros(len(at), np.int64)
    for p in np.unique(part):
        first[part == p] = begins[int(p)]
    return first + (at & ((1 << 33) - 1))


def pack(pieces: DataFrame, limit: int = 4096) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs a column ``length`` from 1 to ``limit``."""
    columns = pieces.columns
    pieces = cut_lineage(pieces).withColumn("row", F.monotonically_increasing_id())
    open_docs = pieces.select("row", F.col("length").cast("long").alias("size")).where(F.col("length") < limit)
    sizes = _counts(open_docs)
    gaps, placements = None, []
    upper = limit
    for number, part in enumerate(CLASSES):
        lower = int(limit * part)
        mine = {s: n for s, n in sizes.items() if lower < s <= upper} if lower else {s: n for s, n in sizes.items() if s <= upper}
        own = open_docs.where((F.col("size") > lower) & (F.col("size") <= upper))
        upper = lower
        if not mine:
            continue
        free = _counts(gaps) if gaps is not None else {}
        plan, _ = sweep(mine, free, limit)
        docs, doc_begins = _sorted(own, sum(mine.values()), "row")

        def place(batches, plan=plan, begins=doc_begins, number=number):
            for batch in batches:
                position = _positions(batch.column("at").to_numpy(), begins)
                run = np.searchsorted(plan[:, 0], position, side="right") - 1
                target = plan[run, 2] + position - plan[run, 0]
                new = plan[run, 1] == 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("size"), pa.array(plan[run, 3]),
                     pa.array(target, mask=new), pa.array(np.where(new, number << 48 | target, 0), mask=~new)],
                    ["row", "size", "inside", "gap_at", "bin"])

        placed = docs.select("row", "size", "at").mapInArrow(
            place, "row long, size long, inside long, gap_at long, bin long")
        if gaps is None:
            done = placed.select("row", "size", "bin", F.col("inside").alias("offset"), F.lit(True).alias("new"))
        else:
            ranked, gap_begins = _sorted(gaps, sum(free.values()), "bin")

            def number_gaps(batches, begins=gap_begins):
                for batch in batches:
                    position = _positions(batch.column("at").to_numpy(), begins)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(position), batch.column("bin"), batch.column("size")], ["gap_at", "old_bin", "gap"])

            ranked = ranked.select("at", "bin", "size").mapInArrow(number_gaps, "gap_at long, old_bin long, gap long")
            done = placed.where("gap_at IS NOT NULL").join(ranked, "gap_at").select(
                "row", "size", F.col("old_bin").alias("bin"), (limit - F.col("gap") + F.col("inside")).alias("offset"),
                F.lit(False).alias("new"),
            ).unionByName(placed.where("gap_at IS NULL").select(
                "row", "size", "bin", F.col("inside").alias("offset"), F.lit(True).alias("new")))
        done = cut_lineage(done)
        placements.append(done.select("row", F.col("bin").alias("sequence_id"), "offset"))
        used = done.groupBy("bin").agg((F.when(F.bool_or("new"), limit).otherwise(0) - F.sum("size")).alias("size"))
        if gaps is not None:
            used = used.unionByName(gaps).groupBy("bin").agg(F.sum("size").alias("size"))
        gaps = used.where("size > 0")
    whole = pieces.where(F.col("length") == limit).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for done in placements:
        whole = whole.unionByName(done)
    return pieces.join(whole, "row").select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 1,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(tokenized_pieces(docs, path, limit, end_id, doc_id, text), limit)
