"""Near-duplicate documents by b-bit MinHash, with links confirmed on the full sets.

1. A text becomes the set of its word shingles. Equal sets form one class, represented by its smallest id;
   only classes go on, so a large group of copies is one row.
2. Each class has ``HASHES`` minima. Their low ``BITS`` bits are packed into the signature; ``BANDS`` groups of
   full minima are the bucket keys of the candidates.
3. In each bucket every class is compared with the bucket's first class. The similarity is estimated from the
   bits that agree, corrected for chance agreement; pairs well below the threshold go. The rest are
   confirmed on the full sets.
4. Links found so far join classes into components. In large buckets that still hold several components each class
   tries its likeliest partner among some drawn ones, which joins most of a group of variants.
5. Buckets that hold several components then are compared again: the classes outside the component of most classes
   with all others, block against block and on full sets, so no link between components is lost and a hot bucket is
   many tasks. A block gives only the links that join its components, not every similar pair.

At the threshold a pair shares no band with a probability of at most (1 - s^4)^32: 5e-11 at 0.85, 5e-8 at 0.8;
its estimate falls below the bound of step 3 with a probability of 3e-7.

Edge cases: texts without words have no shingles and no links; a null text is empty; very long texts are read alone and whole; rows that
repeat an id are one vertex, with the links of all their texts; rows without an id take no part and are kept; an empty table gives no rows; extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.llm.chunks import spread, text_chunks
from spark_explore.llm.components import components
from spark_explore.llm.set_checks import bitmap, confirmed_sets, in_bitmap, set_bytes, spot
from spark_explore.llm.shingles import M1, SET_BYTES, mix, shingle_sets
from spark_explore.sizing import cut_lineage

HASHES, BANDS, ROWS, BITS = 256, 32, 4, 4
SLACK = 0.12  # five deviations of the estimate at the threshold
BLOCK = 512  # classes of a bucket that meet in one task
BLOCK_SHINGLES = 1 << 20  # and their shingles


def minima(sets: np.ndarray, bounds: np.ndarray, count: int = HASHES) -> np.ndarray:
    """The smallest value of every hash function over each (not empty) set."""
    factors = mix(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)
    shifts = mix(np.arange(count + 1, 2 * count + 1, dtype=np.uint64))
    out = np.empty((len(bounds) - 1, count), np.uint32)
    for k in range(count):
        values = ((sets * factors[k] + shifts[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(values, bounds[:-1])
    return out


def pack_bits(minimum: np.ndarray) -> np.ndarray:
    """Low bits of the minima, ``64 / BITS`` to a word."""
    low = (minimum & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(minimum), -1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def similarity(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Similarity estimated from packed signatures (last axis: words), corrected for minima that agree by chance."""
    differ = one ^ other
    for shift in range(1, BITS):
        differ = differ | ((one ^ other) >> np.uint64(shift))
    unit = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    same = 1 - np.bitwise_count(differ & unit).sum(axis=-1, dtype=np.int64) / (differ.shape[-1] * 64 // BITS)
    chance = 2.0 ** -BITS
    return (same - chance) / (1 - chance)


def set_keys(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit keys of (not empty) sets, as two rows."""
    return np.stack([np.add.reduceat(values, bounds[:-1]) for values in (mix(sets), mix(sets ^ M1))])


def features(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n (shingles), the 128-bit key of the set, signature and band keys (null for an empty set)."""
    def run(batches):
        for batch in text_chunks(batches, "text", SET_BYTES):
            sets, bounds = shingle_sets(batch.column("text"), width)
            n = np.diff(bounds)
            some = np.nonzero(n)[0]
            key = np.zeros((2, len(n)), np.uint64)
            signature = np.empty((0, HASHES * BITS // 64), np.uint64)
            keys = np.empty((0, BANDS), np.uint64)
            if len(some):
                inner = np.append(bounds[:-1][some], len(sets))
                key[:, some] = set_keys(sets, inner)
                low = minima(sets, inner)
                signature = pack_bits(low)
                keys = np.zeros((len(some), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = mix(keys ^ low[:, r:BANDS * ROWS:ROWS]) * M1
                keys = mix(keys ^ np.arange(BANDS, dtype=np.uint64))
            back = np.full(len(n), -1)
            back[some] = np.arange(len(some))
            rows = pa.array(back, mask=back < 0)
            wide = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(signature.shape[1] * 8), len(some), [None, pa.py_buffer(np.ascontiguousarray(signature))]
            ).cast(pa.binary())
            bands = pa.ListArray.from_arrays(
                pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)),
                 wide.take(rows), bands.take(rows)], ["doc_id", "n", "k1", "k2", "signature", "bands"])

    return docs.mapInArrow(
        run, "doc_id long, n long, k1 long, k2 long, signature binary, bands array<long>")


def _keyed(ids: DataFrame, docs: DataFrame, classes: DataFrame, width: int, schema: str, make) -> DataFrame:
    """``id`` and what ``make`` gives for the shingle sets of the classes in ``ids``; texts are not shuffled.

    Sets are known by their keys, since a document id may come with several texts.
    """
    needed = cut_lineage(ids.distinct().join(classes.select(F.col("cls").alias("id"), "rep", "k1", "k2"), "id"))
    sc = docs.sparkSession.sparkContext
    in_docs = sc.broadcast(bitmap(needed.select(F.col("rep").alias("id"))).tobytes())

    def run(batches):
        for batch in batches:
            for part in text_chunks([batch.filter(in_bitmap(in_docs.value, batch.column("spot").to_numpy()))], "text", SET_BYTES):
                sets, bounds = shingle_sets(part.column("text"), width)
                some = np.nonzero(np.diff(bounds))[0]
                if len(some):
                    bounds = np.append(bounds[:-1][some], len(sets))
                    key = set_keys(sets, bounds)
                    yield pa.RecordBatch.from_arrays([*(pa.array(k.view(np.int64)) for k in key), make(sets, bounds)], ["k1", "k2", "made"])

    found = docs.select("text", spot("doc_id").alias("spot")).mapInArrow(run, f"k1 long, k2 long, made {schema}")
    return cut_lineage(found.join(needed.select("id", "k1", "k2"), ["k1", "k2"]).groupBy("id").agg(F.first("made").alias("made")))


def candidate_sets(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``id`` and its sorted shingles, for the classes that occur in ``pairs``."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    return _keyed(ids, docs, classes, width, "binary", set_bytes).withColumnRenamed("made", "shingles")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets of shingles have 100 * intersection >= percent * union."""
    return confirmed_sets(pairs, candidate_sets(pairs, docs, classes, width), percent)


def _first_pairs(buckets: DataFrame, classes: DataFrame, lowest: float, percent: int) -> DataFrame:
    """Pairs of each class with the first class of its buckets that look similar enough."""
    pairs = buckets.where("cls <> first").select(F.col("first").alias("a"), F.col("cls").alias("b")).distinct()
    light = classes.select("cls", "n", "signature")
    pairs = pairs.join(light.toDF("a", "n_a", "s_a"), "a").join(light.toDF("b", "n_b", "s_b"), "b").where(
        100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def look(batches):
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                              for c in ("s_a", "s_b"))
                yield batch.select(["a", "b"]).filter(pa.array(similarity(one, other) >= lowest))

    return pairs.select("a", "b", "s_a", "s_b").mapInArrow(look, "a long, b long")


def _groups(batches, key: list[str]):
    """The adjacent rows with equal ``key``, as one batch each."""
    held = None
    for batch in batches:
        held = batch if held is None or not held.num_rows else pa.concat_batches([held, batch])
        if not held.num_rows:
            continue
        own = [held.column(c).to_numpy() for c in key]
        starts = np.concatenate([[0], np.nonzero(np.any([g[1:] != g[:-1] for g in own], axis=0))[0] + 1])
        for a, b in zip(starts[:-1], starts[1:]):
            yield held.slice(a, b - a)
        held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint64).reshape(batch.num_rows, -1)


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The classes of the buckets that hold several components: own component, that of most classes (home), and
    how many classes and shingles all of them and those outside of home (strays) have."""
    named = cut_lineage(buckets.join(labels.withColumnRenamed("id", "cls"), "cls", "left").select(
        "band", "cls", "n", F.coalesce("component", "cls").alias("own")))
    parts = named.groupBy("band", "own").agg(F.count("*").alias("many"), F.sum("n").alias("n"))
    most = F.max(F.struct("many", "n", "own"))
    mixed = parts.groupBy("band").agg(most.alias("most"), F.sum("many").alias("all"), F.sum("n").alias("all_n")).select(
        "band", F.col("most.own").alias("home"), "all", "all_n",
        (F.col("all") - F.col("most.many")).alias("strays"), (F.col("all_n") - F.col("most.n")).alias("strays_n"))
    return cut_lineage(named.join(mixed.where("strays > 0"), "band"))


def _near_pairs(mixed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """For each class of a large mixed bucket the likeliest class of another component, among ``BLOCK`` drawn ones.

    Every class is dealt to one block, so rows and pairs grow with the size of a bucket.
    """
    lowest = percent / 100 - SLACK
    key = ["band", "part"]
    parts = mixed.where(F.col("all") > BLOCK).withColumn(
        "part", F.pmod(F.xxhash64("cls"), F.ceil(F.col("all") / BLOCK))).select(*key, "cls", "own", "n")

    def look(batches):
        for batch in _groups(batches, key):
            cls, own, n = (batch.column(c).to_numpy() for c in ("cls", "own", "n"))
            signature = _signatures(batch)
            other = np.full(len(cls), -1)
            for x in range(len(cls)):
                near = np.nonzero((own != own[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])))[0]
                if len(near):
                    like = similarity(signature[near], signature[x])
                    if like.max() >= lowest:
                        other[x] = near[like.argmax()]
            x = np.nonzero(other >= 0)[0]
            a, b = cls[x], cls[other[x]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rows = parts.join(classes.select("cls", "signature"), "cls").repartition(*key).sortWithinPartitions(*key, "cls")
    return rows.select(*key, "cls", "own", "n", "signature").mapInArrow(look, "a long, b long").distinct()


def _cross_links(mixed: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links within buckets between different components, as many as it takes to join these; exact.

    The strays of a bucket meet all its classes, block against block. A first pass keeps the rows that look similar to
    another one; these meet again with their full sets, and a block gives only links between what it has not joined yet.
    """
    lowest = percent / 100 - SLACK
    light = classes.select("cls", "signature", F.transform("bands", lambda b: b.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("bands"))

    def blocks(of: str):
        by_size = F.greatest(F.ceil(F.col(of) / BLOCK), F.ceil(F.col(f"{of}_n") / BLOCK_SHINGLES))
        return F.least(by_size, F.col(of))

    named = mixed.withColumns({
        "home": F.col("own") == F.col("home"), "blocks_i": blocks("strays"), "blocks_j": blocks("all"), "h": F.xxhash64("cls")})
    key = ["band", "i", "j"]
    rows = [*key, "side", "cls", "own", "home", "n"]
    strays = named.where("NOT home").withColumn("i", F.pmod("h", "blocks_i")).withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_j") - 1))).withColumn("side", F.lit(0))
    members = named.withColumn("j", F.pmod("h", "blocks_j")).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_i") - 1))).withColumn("side", F.lit(1))

    def candidates(batch):
        """For each stray that looks similar to members of other components: its row, and theirs."""
        side, cls, own, n = (batch.column(c).to_numpy() for c in ("side", "cls", "own", "n"))
        home = batch.column("home").to_numpy(zero_copy_only=False)
        signature = _signatures(batch)
        keys = batch.column("bands").flatten().to_numpy().reshape(len(cls), -1)
        here = batch.column("band")[0].as_py() & 0x7FFFFFFF
        m = np.nonzero(side == 1)[0]
        for x in np.nonzero(side == 0)[0]:
            # Two strays are looked at once.
            near = m[(own[m] != own[x]) & (home[m] | (cls[m] > cls[x]))
                     & (100 * np.minimum(n[m], n[x]) >= percent * np.maximum(n[m], n[x]))]
            if len(near):
                near = near[similarity(signature[near], signature[x]) >= lowest]
            if len(near):
                # A pair that shares several buckets is looked at in the first.
                near = near[keys[x][(keys[near] == keys[x]).argmax(1)] == here]
            if len(near):
                yield x, near

    def look(batches):
        for batch in _groups(batches, key):
            wanted = np.zeros(batch.num_rows, bool)
            for x, near in candidates(batch):
                wanted[x] = True
                wanted[near] = True
            yield batch.filter(pa.array(wanted))

    def join(batches):
        for batch in _groups(batches, key):
            cls = batch.column("cls").to_numpy()
            label = batch.column("own").to_numpy().copy()
            column = batch.column("shingles")
            sets = [np.frombuffer(column[i].as_buffer(), np.uint64) for i in range(len(cls))]
            size = np.array([len(one) for one in sets])
            begin = np.cumsum(size) - size
            values, codes = np.unique(np.concatenate(sets), return_inverse=True)
            marked = np.zeros(len(values), bool)
            left, right = [], []
            for x, near in candidates(batch):
                near = near[label[near] != label[x]]
                if not len(near):
                    continue
                own = codes[begin[x]:begin[x] + size[x]]
                marked[own] = True
                ahead = np.cumsum(size[near]) - size[near]
                both = np.add.reduceat(marked[codes[spread(begin[near], size[near])]], ahead, dtype=np.int64)
                marked[own] = False
                near = near[100 * both >= percent * (size[near] + size[x] - both)]
                for y in near:
                    if label[y] != label[x]:
                        left.append(cls[x]), right.append(cls[y])
                        label[label == label[y]] = label[x]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    runs = strays.select(*rows).unionByName(members.select(*rows)).join(light, "cls").select(*rows, "signature", "bands")
    runs = runs.repartition(*key).sortWithinPartitions(*key, "side", "cls")
    similar = cut_lineage(runs.mapInArrow(look, runs.schema))
    sets = _keyed(similar.select(F.col("cls").alias("id")), docs, classes, width, "binary", set_bytes).toDF("cls", "shingles")
    whole = similar.join(sets, "cls").repartition(*key).sortWithinPartitions(*key, "side", "cls")
    return whole.mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept (it is the smallest) of every row."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    lowest = percent / 100 - SLACK
    found = cut_lineage(features(docs, width))
    some = found.where("n > 0 AND doc_id IS NOT NULL")
    # A document that comes with several texts is in several classes.
    classes = cut_lineage(some.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature"),
        F.first("bands").alias("bands")).withColumn("cls", F.monotonically_increasing_id()))
    posted = classes.select("cls", "n", F.explode("bands").alias("band"))
    shared = cut_lineage(posted.groupBy("band").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).where(
        "first < last").select("band", "first"))
    buckets = cut_lineage(posted.join(shared, "band").select("band", "cls", "first", "n"))
    links = cut_lineage(confirmed(cut_lineage(_first_pairs(buckets, classes, lowest, percent)), docs, classes, width, percent))
    links = _with_shared_ids(links, some, classes)
    labels = components(links)
    mixed = _mixed(buckets, labels)
    likely = cut_lineage(_near_pairs(mixed, classes, percent))
    if not likely.isEmpty():
        links = links.unionByName(cut_lineage(confirmed(likely, docs, classes, width, percent)))
        labels = components(links)
        mixed = _mixed(buckets, labels)
    more = cut_lineage(_cross_links(mixed, classes, docs, width, percent))
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    named = classes.join(labels.withColumnRenamed("id", "cls"), "cls", "left").select(
        "k1", "k2", "rep", F.coalesce("component", "cls").alias("component"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = cut_lineage(named.join(smallest, "component").select("k1", "k2", "component_id"))
    alone = F.col("n") == 0
    return found.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _with_shared_ids(links: DataFrame, some: DataFrame, classes: DataFrame) -> DataFrame:
    """``links`` and those between the classes of documents whose id comes with several texts."""
    several = cut_lineage(some.groupBy("doc_id").agg(
        F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high")).where("low <> high").select("doc_id"))
    if several.isEmpty():
        return links
    held = some.join(several, "doc_id").select("doc_id", "k1", "k2").distinct().join(classes.select("k1", "k2", "cls"), ["k1", "k2"])
    first = held.groupBy("doc_id").agg(F.min("cls").alias("a"))
    return links.unionByName(cut_lineage(held.join(first, "doc_id").where("a < cls").select("a", F.col("cls").alias("b"))))
