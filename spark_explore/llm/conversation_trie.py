"""The prefix trie of conversations, as balanced parentheses per shard.

1. Turns are ranked within their conversation and summed up to keys of their prefixes on range-sorted partitions; what a conversation
   carries from one partition to the next is a number per partition, so a conversation of any length is many tasks.
2. A prefix is a node. Its owner is its smallest member. The nodes that one conversation owns are a chain below a node of an earlier owner,
   so ``[owner, last depth, owner, last depth, .., own depth]`` sorts nodes in preorder, and has two numbers for each branch on the way.
3. A shard is a run of nodes in preorder. Its balanced parentheses have the excess in blocks under a tree of minima; ``findclose``
   gives the end of each subtree, the rank of ``()`` pairs its leaves, and cumulative arrays its savings.
4. Nodes still open at the end of a shard are its spine. A shard tells, for each depth at which it closes earlier nodes, what lies before
   that place; a spine node adds whole shards up to the one that closes it and that shard's entry.

The SHA-256 of a node's ends reads its members in order as a stream, since the digest is sequential; it never holds the list.

Edge cases: turns are ordered by turn (null first), then role and text; null roles and texts are empty; rows without a conv_id take no part; rows that
repeat are turns of their own; an empty table gives no rows; very long texts are only counted and hashed; extra columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.sizing import cut_lineage

SHARD = 1 << 19  # nodes of a shard
BLOCK = 64  # parentheses under one minimum
LEVELS = 1 << 16  # depths of one entry before it is dealt out
SHARED = 20  # conversations that begin alike


def running(rows: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """``rows`` (conv_id, order, sums and further long columns) with ``rank`` from 1 and ``sums`` added up, modulo 2^64, along each conversation."""
    keep = [c for c in rows.columns if c not in order]
    names = [*keep, "rank", "part"]
    sort = ["conv_id", *(F.col(c).asc_nulls_first() for c in order), "tie"]
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort).select(*keep)
    schema = ", ".join(f"{c} long" for c in names)

    def local(batches):
        part, last, carry = TaskContext.get().partitionId(), None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id").to_numpy()
            starts = np.concatenate([[0], np.nonzero(conv[1:] != conv[:-1])[0] + 1])
            owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            held = {}
            for c in [*sums, "rank"]:
                values = np.ones(n, np.uint64) if c == "rank" else batch.column(c).to_numpy().view(np.uint64)
                total = np.cumsum(values, dtype=np.uint64)
                before = total[starts] - values[starts]
                if conv[0] == last:
                    before[0] -= carry[c]
                held[c] = total - before[owner]
            last, carry = conv[-1], {c: v[-1] for c, v in held.items()}
            yield pa.RecordBatch.from_arrays(
                [pa.array(held[c].view(np.int64)) if c in held else batch.column(c) if c != "part" else pa.array(np.full(n, part))
                 for c in names], names)

    found = cut_lineage(placed.mapInArrow(local, schema))
    ends = found.groupBy("part").agg(
        F.min("conv_id").alias("first"), F.max("conv_id").alias("last"),
        F.max_by(F.struct(*sums, "rank"), F.struct("conv_id", "rank")).alias("end")).orderBy("part").collect()
    carried, last, total = {}, None, None
    for r in ends:
        end = {c: r["end"][c] % 2**64 for c in [*sums, "rank"]}
        if r["first"] == last:
            carried[r["part"]] = (last, total)
            if r["last"] == last:
                end = {c: (v + total[c]) % 2**64 for c, v in end.items()}
        last, total = r["last"], end
    shared = rows.sparkSession.sparkContext.broadcast(carried)

    def carry_over(batches):
        for batch in batches:
            if batch.num_rows:
                conv, more = shared.value.get(batch.column("part")[0].as_py(), (None, {}))
                here = batch.column("conv_id").to_numpy() == conv
                columns = []
                for c in names[:-1]:
                    values = batch.column(c)
                    if c in more and here.any():
                        values = values.to_numpy().view(np.uint64).copy()
                        values[here] += np.uint64(more[c])
                        values = pa.array(values.view(np.int64))
                    columns.append(values)
                yield pa.RecordBatch.from_arrays(columns, names[:-1])

    return found.mapInArrow(carry_over, ", ".join(f"{c} long" for c in names[:-1]))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), the 128-bit key g1, g2 of role and text, and the words of the text, for every turn as it stands."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text")).where(
        "conv_id IS NOT NULL").select(
        "conv_id", F.xxhash64("role", "text").alias("g1"), F.xxhash64(F.lit("other"), "role", "text").alias("g2"),
        F.size(F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")).cast("long").alias("words"), "turn", "role", "text")
    return cut_lineage(running(rows, ["turn", "role", "text"], []).withColumnRenamed("rank", "depth"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (as of ``turns_of``) and the lengths (conv_id, length) of conversations that begin with the first turns of one of ``SHARED``:
    the first h = crc32(conv_id) % 4 turns of conversation conv_id - conv_id % 20, then the own turns after the first h."""
    own = turns_of(conversations)
    counted = own.groupBy("conv_id").agg(F.max("depth").alias("length")).withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, "donor": F.col("conv_id") - F.col("conv_id") % SHARED})
    counted = cut_lineage(counted)
    donors = counted.where("conv_id = donor").select("donor", F.col("length").alias("lent"))
    convs = cut_lineage(counted.join(donors, "donor", "left").withColumn("m", F.least("h", F.coalesce("lent", F.lit(0).cast("long")))))
    columns = ["conv_id", "depth", "g1", "g2", "words"]
    later = own.join(convs.select("conv_id", "h", "m"), "conv_id").where("depth > h").withColumn("depth", F.col("depth") - F.col("h") + F.col("m"))
    heads = own.where("depth <= 3").withColumnRenamed("conv_id", "donor").join(convs.select("donor", "conv_id", "m"), "donor").where("depth <= m")
    lengths = convs.select("conv_id", (F.col("m") + F.greatest(F.col("length") - F.col("h"), F.lit(0).cast("long"))).alias("length"))
    return later.select(*columns).unionByName(heads.select(*columns)), lengths


class Parens:
    """Balanced parentheses of nodes in preorder, given by their depths; nodes opened earlier close with one parenthesis per new minimum."""

    def __init__(self, depth: np.ndarray):
        low = np.minimum.accumulate(depth)
        level = depth - low - np.concatenate([[0], np.cumsum(low[1:] < low[:-1])])
        self.opens = 2 * np.arange(len(depth)) - (level - level[0])
        self.bits = np.zeros(int(self.opens[-1]) + 1, np.int8)
        self.bits[self.opens] = 1
        self.excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        self.rank = np.cumsum(self.bits, dtype=np.int64)
        count = -(-len(self.bits) // BLOCK)
        padded = np.full(count * BLOCK, np.iinfo(np.int64).max)
        padded[:len(self.bits)] = self.excess
        self.blocks = padded.reshape(count, BLOCK)
        self.width = 1 << int(count).bit_length()
        self.tree = np.full(2 * self.width, np.iinfo(np.int64).max)
        self.tree[self.width:self.width + count] = self.blocks.min(1)
        for at in range(self.width.bit_length() - 2, -1, -1):
            nodes = np.arange(1 << at, 2 << at)
            self.tree[nodes] = np.minimum(self.tree[2 * nodes], self.tree[2 * nodes + 1])

    def _inside(self, block, after, target):
        """The first place in each block after ``after`` where the excess is at most the target; -1: none."""
        out = np.full(len(block), -1)
        for s in range(0, len(block), 1 << 15):
            part = slice(s, s + (1 << 15))
            good = (self.blocks[block[part]] <= target[part, None]) & (np.arange(BLOCK) > after[part, None])
            out[part] = np.where(good.any(1), block[part] * BLOCK + good.argmax(1), -1)
        return out

    def findclose(self) -> np.ndarray:
        """The place that closes each node, -1 for nodes that stay open."""
        target = self.excess[self.opens] - 1
        block = self.opens // BLOCK
        found = self._inside(block, self.opens % BLOCK, target)
        left = np.nonzero(found < 0)[0]
        node, test, hit = self.width + block[left] + 1, np.ones(len(left), bool), np.zeros(len(left), bool)
        active = np.arange(len(left))
        while len(active):
            at = node[active]
            good = test[active] & (self.tree[at] <= target[left[active]])
            hit[active[good]] = True
            active, at = active[~good], at[~good]
            odd = (at & 1) == 1
            node[active] = np.where(odd, at >> 1, at + 1)
            test[active] = ~odd
            active = active[node[active] > 1]
        left, node = left[hit], node[hit]
        while len(node) and node[0] < self.width or (node < self.width).any():
            inner = node < self.width
            child = 2 * node[inner]
            node[inner] = child + (self.tree[child] > target[left[inner]])
        found[left] = self._inside(node - self.width, np.full(len(left), -1), target[left])
        return found


NODE = ["owner", "depth", "parent", "n_convs", "n_children", "saving", "k1", "k2"]
SHARD_OUT = [*NODE, "shard", "kind", "leaves", "saved", "low"]  # kind 0: closed node, 1: open node, 2: entry, 3: summary


def encode(rows: dict, shard: int) -> pa.RecordBatch:
    """A shard's nodes with what they know of their subtrees, its entries for earlier nodes (depths low to depth) and its summary."""
    depth, n = rows["depth"], len(rows["depth"])
    parens = Parens(depth)
    close = parens.findclose()
    after = np.append(parens.bits[1:], 0)[parens.opens] == 0
    after[-1] = rows["n_children"][-1] == 0  # its first child would be in the next shard
    leaves = np.concatenate([[0], np.cumsum(after, dtype=np.int64)])
    saved = np.concatenate([[0], np.cumsum(rows["saving"])])
    end = np.where(close >= 0, parens.rank[close], n)
    first = np.arange(n)
    low = np.minimum.accumulate(depth)
    drop = np.nonzero(low[1:] < low[:-1])[0] + 1
    blank = np.zeros(len(drop) + 1, np.int64)
    more = {"depth": np.append(low[drop - 1] - 1, depth[0]), "shard": blank + shard, "kind": np.append(blank[1:] + 2, 3),
            "leaves": np.append(leaves[drop], leaves[n]), "saved": np.append(saved[drop], saved[n]), "low": np.append(low[drop], low[-1])}
    own = {**rows, "shard": np.full(n, shard), "kind": (close < 0).astype(np.int64), "leaves": leaves[end] - leaves[first],
           "saved": saved[end] - saved[first], "low": np.zeros(n, np.int64)}
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([own[c], more.get(c, blank)])) for c in SHARD_OUT], SHARD_OUT)


def _shards(size: int):
    def run(batches):
        number, held, many = TaskContext.get().partitionId() << 32, [], 0

        def whole():
            return encode({c: np.concatenate([b.column(c).to_numpy() for b in held]) for c in NODE}, number)

        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, size - many)
                batch = batch.slice(piece.num_rows)
                held.append(piece)
                many += piece.num_rows
                if many == size:
                    yield whole()
                    number, held, many = number + 1, [], 0
        if many:
            yield whole()

    return run


def _close_spines(found: DataFrame) -> DataFrame:
    """The open nodes with their whole subtrees. Summaries (one a shard) go to the driver; nodes and entries stay in the cluster."""
    rows = sorted(tuple(r) for r in found.where("kind = 3").select("shard", "low", "leaves", "saved").collect())
    shards, lows, leaves, saved = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4
    book = found.sparkSession.sparkContext.broadcast((shards, lows, np.append(0, np.cumsum(leaves)), np.append(0, np.cumsum(saved))))

    def reach(batches):
        shards, lows, leaves, saved = book.value
        for batch in batches:
            own, depth = (batch.column(c).to_numpy() for c in ("shard", "depth"))
            closing, sums = np.full(len(own), -1), [batch.column(c).to_numpy().copy() for c in ("leaves", "saved")]
            for s in np.unique(own):
                here = np.nonzero(own == s)[0]
                at = int(np.searchsorted(shards, s))
                # The first later shard that gets down to a depth is where the running minimum first does.
                down = np.minimum.accumulate(lows[at + 1:])
                to = at + 1 + np.searchsorted(-down, -depth[here])
                closing[here] = np.where(to < len(shards), shards[np.minimum(to, len(shards) - 1)], -1)
                for total, own_sum in zip((leaves, saved), sums):
                    own_sum[here] += total[to] - total[at + 1]
            columns = {**{c: batch.column(c) for c in NODE}, "closing": pa.array(closing), "leaves": pa.array(sums[0]), "saved": pa.array(sums[1])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    names = [*NODE, "closing", "leaves", "saved"]
    spine = found.where("kind = 1").mapInArrow(reach, ", ".join(f"{c} long" for c in names))
    entries = found.where("kind = 2").select(
        F.col("shard").alias("closing"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"), F.col("depth").alias("high"),
        F.explode(F.sequence("low", "depth", F.lit(LEVELS).cast("long"))).alias("low"))
    # A deep fall is dealt out in pieces before it becomes a row per depth.
    entries = entries.repartition("closing", "low").select("closing", "more_leaves", "more_saved", F.explode(
        F.sequence("low", F.least("high", F.col("low") + LEVELS - 1))).alias("depth"))
    nothing = F.lit(0).cast("long")
    return spine.join(entries, ["closing", "depth"], "left").select(
        *NODE, (F.col("leaves") + F.coalesce("more_leaves", nothing)).alias("leaves"),
        (F.col("saved") + F.coalesce("more_saved", nothing)).alias("saved"))


def _ends(keyed: DataFrame, lengths: DataFrame) -> DataFrame:
    """depth, k1, k2 and the digest of the members that end at a node, in order."""
    last = keyed.groupBy("conv_id").agg(F.max_by(F.struct("depth", "k1", "k2"), "depth").alias("x"))
    nothing = F.lit(0).cast("long")
    rows = lengths.select("conv_id").join(last, "conv_id", "left").select(
        "conv_id", *(F.coalesce(f"x.{c}", nothing).alias(c) for c in ("depth", "k1", "k2")))

    def digest(batches):
        now, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("conv_id").cast(pa.string()).to_pylist()
            key = np.stack([batch.column(c).to_numpy() for c in ("depth", "k1", "k2")], 1)
            starts = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1, [len(key)]])
            done = []
            for a, b in zip(starts[:-1], starts[1:]):
                if now is None or tuple(key[a]) != now:
                    if now is not None:
                        done.append((*map(int, now), state.hexdigest()))
                    now, state = tuple(key[a]), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(names[a:b]).encode())
            yield _digests(done)
        if now is not None:
            yield _digests([(*map(int, now), state.hexdigest())])

    order = ["depth", "k1", "k2"]
    return rows.repartition(*order).sortWithinPartitions(*order, "conv_id").select(*order, "conv_id").mapInArrow(
        digest, "depth long, k1 long, k2 long, ends_sha256 string")


def _digests(rows):
    kinds = [pa.int64()] * 3 + [pa.string()]
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["depth", "k1", "k2", "ends_sha256"])


def nodes(turns: DataFrame, lengths: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per distinct prefix of the conversations in ``lengths`` (conv_id, length), from the root: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. ``turns`` are as of ``turns_of``."""
    spark = turns.sparkSession
    lengths = cut_lineage(lengths)
    first, members = lengths.agg(F.min("conv_id"), F.count("*")).first()
    root = spark.range(1 if members else 0)
    own_key = [F.xxhash64(g, "depth").alias(k) for g, k in (("g1", "k1"), ("g2", "k2"))]
    keyed = cut_lineage(running(
        turns.select("conv_id", F.col("depth").alias("order"), "depth", *own_key, "words"), ["order"], ["k1", "k2"]).drop("rank"))
    prefix = ["depth", "k1", "k2"]
    distinct = cut_lineage(keyed.groupBy(*prefix).agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.first("words").alias("words")))

    # The owners met on the way down to an owner's first node, and the last depth of each.
    owners = distinct.select(F.col("owner").alias("conv_id")).distinct()
    way = keyed.join(owners, "conv_id", "left_semi").join(distinct.select(*prefix, "owner"), prefix)
    way = way.where("owner < conv_id").groupBy("conv_id", "owner").agg(F.max("depth").alias("last")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("owner", "last"))).alias("way"))
    nothing, top = F.lit(0).cast("long"), F.lit(first).cast("long")
    start = F.array(F.struct(top.alias("owner"), nothing.alias("last")))
    chains = owners.join(way, "conv_id", "left").withColumn("way", F.coalesce("way", F.array().cast("array<struct<owner:bigint,last:bigint>>")))
    chains = cut_lineage(chains.withColumn("way", F.when(
        (F.col("conv_id") == top) | (F.get(F.col("way"), F.lit(0))["owner"] == top), F.col("way")).otherwise(F.concat(start, "way"))).select(
        F.col("conv_id").alias("owner"), "way", F.coalesce(F.try_element_at(F.col("way"), F.lit(-1))["owner"], top).alias("above"),
        F.coalesce(F.try_element_at(F.col("way"), F.lit(-1))["last"], nothing).alias("at")))
    branches = chains.where(F.col("owner") != top).groupBy(F.col("above").alias("owner"), F.col("at").alias("depth")).agg(F.count("*").alias("branches"))

    listed = distinct.join(chains, "owner").join(lengths.withColumnRenamed("conv_id", "owner"), "owner")
    listed = listed.select(
        "owner", "depth", F.when(F.col("depth") == F.col("at") + 1, F.col("above")).otherwise(F.col("owner")).alias("parent"), "n_convs",
        (F.col("depth") < F.col("length")).cast("long").alias("next"), ((F.col("n_convs") - 1) * F.col("words")).alias("saving"), "k1", "k2", "way")
    longest = lengths.where(F.col("conv_id") == top).select(F.min("length").alias("length"))
    # Zero-turn root, owned by the first conversation; its own chain goes on if it has turns.
    own_turns = longest.first()["length"] if members else None
    listed = listed.unionByName(root.select(
        top.alias("owner"), nothing.alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(members).cast("long").alias("n_convs"),
        F.lit(int(bool(own_turns))).cast("long").alias("next"), nothing.alias("saving"), nothing.alias("k1"), nothing.alias("k2"),
        F.array().cast("array<struct<owner:bigint,last:bigint>>").alias("way")))
    flat = F.concat(F.flatten(F.transform("way", lambda s: F.array(s["owner"], s["last"]))), F.array("owner", "depth"))
    rows = listed.join(branches, ["owner", "depth"], "left").select(
        "owner", "depth", F.coalesce("parent", F.lit(-1).cast("long")).alias("parent"), "n_convs",
        (F.col("next") + F.coalesce("branches", nothing)).alias("n_children"), "saving", "k1", "k2", flat.alias("place"))
    found = cut_lineage(rows.repartitionByRange("place").sortWithinPartitions("place").select(*NODE).mapInArrow(
        _shards(shard), ", ".join(f"{c} long" for c in SHARD_OUT)))
    whole = found.where("kind = 0").select(*NODE, "leaves", "saved").unionByName(_close_spines(found))
    return whole.join(_ends(keyed, lengths), prefix, "left").select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
