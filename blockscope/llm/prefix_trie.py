"""Trie of conversation prefixes, its node table addressed by minimal perfect hashing.

A node is a distinct sequence of first turns (role and text); a conversation is a member of all nodes on its path. Nodes
are named by their depth and a digest of two 64-bit lanes: the exclusive or, over the path, of hashes of each turn's place
and its SHA-256. Prefix digests are therefore running aggregates, over pieces of SEGMENT turns and then over the pieces,
so that no task holds a whole conversation.

Pieces of paths are dealt to shards of about SHARD_ROWS rows by conversation and piece. A shard enumerates its distinct
digests, gives each a slot by a minimal perfect hash (each lookup is verified against the digest stored in the slot),
scatters counts into flat numpy arrays and accumulates them through the array of parent slots, deepest nodes first. Members
of a node are the sum of its shards' counts. Its owner is the smallest member. A conversation owns the lower part of its
path, so that what its nodes add to subtrees (saved tokens, one for a childless node) belongs to ancestors on its own path
alone: a second pass scatters these at their owners and accumulates them in the same way, and shards' sums add up. What
later pieces of a path add enters at the end of each earlier piece. The digests of members that end at a node stream
through sorted chunks of ids, with one hash state at a time.

Nodes of one name must agree on their parent and words, or the job fails: digests that collide are never merged silently.
Turns go by `turn`, null first, then by the SHA-256 of role and text; repeated rows are turns each. Null roles and texts are
empty ones. Rows without a conv_id belong to no conversation and are left out. An empty table has no nodes. Other columns
are not read, whatever their names. Very long texts are hashed and counted where they are read, and not carried further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockscope.llm.common import WORD_GAP, materialize
from blockscope.sources.particles import with_positions

#: Turns of a piece of a path, rows of a shard (about), and ids of a chunk, as a power of two.
SEGMENT, SHARD_ROWS, CHUNK_BITS = 4096, 2048, 12
NAME = ["depth", "a", "b"]
PARENT = ["pa", "pb"]


class SlotTable:
    """Slots 0 to n - 1 for n distinct keys (rows of 64-bit columns), by a minimal perfect hash of bit levels: at each level,
    keys that meet no other take the bit they fall on, and the rest goes on to the next; a slot is the rank of a bit."""

    ROOM, MOST = 1.5, 64

    def __init__(self, *columns: np.ndarray):
        left, self.levels, base = np.arange(len(columns[0])), [], 0
        slots = np.zeros(len(left), np.int64)
        while len(left):
            if len(self.levels) == self.MOST:
                raise ValueError("keys are not distinct")
            size = int(len(left) * self.ROOM) + 1
            at = self._place([c[left] for c in columns], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = base + np.cumsum(alone) - 1
            self.levels.append((size, alone, rank))
            here = alone[at]
            slots[left[here]] = rank[at[here]]
            base += int(alone.sum())
            left = left[~here]
        #: Where each key went, and the keys by slot.
        self.slots = slots
        self.keys = [np.empty_like(c) for c in columns]
        for stored, c in zip(self.keys, columns):
            stored[slots] = c

    @staticmethod
    def _place(columns: list[np.ndarray], level: int, size: int) -> np.ndarray:
        h = np.full(len(columns[0]), level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
        return (h % np.uint64(size)).astype(np.int64)

    def find(self, *columns: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the table."""
        out, left = np.full(len(columns[0]), -1, np.int64), np.arange(len(columns[0]))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self._place([c[left] for c in columns], level, size)
            here = alone[at]
            out[left[here]] = rank[at[here]]
            left = left[~here]
        same = out >= 0
        for stored, c in zip(self.keys, columns):
            same[same] = stored[out[same]] == c[same]
        return np.where(same, out, -1)


class Shard:
    """The nodes of a shard's rows: slots, parent slots, and sums over subtrees."""

    def __init__(self, rows: dict[str, np.ndarray], segment: int):
        names = [rows[c] for c in NAME]
        order = np.lexsort(names)
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in names])
        first = order[new]
        self.table = SlotTable(*(c[first] for c in names))
        self.row = np.empty(len(first), np.int64)  # a row of each slot's node
        self.row[self.table.slots] = first
        self.of_row = self.table.find(*names)
        if any((rows[c] != rows[c][self.row][self.of_row]).any() for c in (*PARENT, "words") if c in rows):
            raise ValueError("prefix digests collide")
        depth, pa, pb = (rows[c][self.row] for c in ("depth", *PARENT))
        self.parent = self.table.find(depth - 1, pa, pb)
        self.parent[(depth == 0) | (depth > 1) & ((depth - 1) % segment == 0)] = -1  # pieces of a path are linked by what enters at their ends
        by_depth = np.argsort(-depth, kind="stable")
        self.levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)

    def accumulate(self, values: np.ndarray, combine: np.ufunc) -> np.ndarray:
        """Fold each slot's value into its parent's, deepest first."""
        for level in self.levels:
            level = level[self.parent[level] >= 0]
            combine.at(values, self.parent[level], values[level])
        return values


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _local_counts(table: pa.Table, segment: int) -> pa.Table:
    """Members of each node among the shard's paths, and the smallest of them."""
    rows = _columns(table)
    shard = Shard(rows, segment)
    order = np.lexsort((rows["depth"], rows["piece"], rows["conv"]))  # the deepest row of each piece stands for it
    last = np.ones(len(order), bool)
    last[:-1] = (rows["conv"][order[1:]] != rows["conv"][order[:-1]]) | (rows["piece"][order[1:]] != rows["piece"][order[:-1]])
    ends = order[last]
    members, smallest = np.zeros(len(shard.row), np.int64), np.full(len(shard.row), np.iinfo(np.int64).max)
    np.add.at(members, shard.of_row[ends], 1)
    np.minimum.at(smallest, shard.of_row[ends], rows["conv"][ends])
    shard.accumulate(members, np.add)
    shard.accumulate(smallest, np.minimum)
    return pa.table({c: rows[c][shard.row] for c in (*NAME, *PARENT, "words")} | {"members": members, "owner": smallest})


def _local_sums(table: pa.Table, segment: int) -> pa.Table:
    """Sums over the subtrees of each node, of what the shard's paths own."""
    rows = _columns(table)
    shard = Shard(rows, segment)
    sums = {}
    for c in ("saved", "leaves"):
        sums[c] = np.zeros(len(shard.row), np.int64)
        np.add.at(sums[c], shard.of_row, rows[c])
        shard.accumulate(sums[c], np.add)
    any_ = (sums["saved"] != 0) | (sums["leaves"] != 0)
    return pa.table({c: rows[c][shard.row][any_] for c in NAME} | {c: v[any_] for c, v in sums.items()})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks of ids, which come sorted; one hash state at a time."""
    name, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for *key, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if key == name:
                state.update(b"," + ids.encode())
                continue
            if name is not None:
                done.append((*name, state.hexdigest()))
            name, state = key, hashlib.sha256(ids.encode())
        yield _ended(done)
    if name is not None:
        yield _ended([(*name, state.hexdigest())])


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()])], names=[*NAME, "ends_sha256"])


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, at, token, words) of each turn: its place from 0, the SHA-256 of role and text, and the text's words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    token = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(WORD_GAP.replace("[", "[^", 1))).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", token.alias("token"), words.alias("words"))
    return with_positions(materialize(rows, "turns"), ["turn", "token"], ["conv"]).withColumnRenamed("pos", "at").drop("turn")


def rebuilt(turns: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """(conv, at, token, words, length) and (conv, length): each conversation takes its first h turns from the one whose id is
    the multiple of `every` below its own, and its own turns from the h-th on; h is the id's CRC-32 modulo 4."""
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    asked = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    donor = F.col("conv") - F.col("conv") % every
    plan = lengths.select("conv", "n", F.when(donor == F.col("conv"), 0).otherwise(asked).cast("long").alias("skip"), donor.alias("donor"))
    held = lengths.select(F.col("conv").alias("donor"), F.col("n").alias("there"))
    plan = plan.join(held, "donor", "left").withColumn("given", F.least("skip", F.coalesce("there", F.lit(0).cast("long"))))
    plan = materialize(plan.select("conv", "donor", "skip", "given", (F.col("given") + F.greatest(F.col("n") - F.col("skip"), F.lit(0).cast("long"))).alias("length")), "plan")
    own = turns.join(plan, "conv").where("at >= skip").select("conv", (F.col("at") - F.col("skip") + F.col("given")).alias("at"), "token", "words", "length")
    heads = turns.where((F.col("conv") % every == 0) & (F.col("at") < 3)).select(F.col("conv").alias("donor"), "at", "token", "words")
    given = plan.where("given > 0").join(heads, "donor").where("at < given").select("conv", "at", "token", "words", "length")
    return own.unionByName(given), plan.select("conv", "length")


def paths_of(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, piece, depth, a, b, pa, pb, words, ends) of each node on each conversation's path, the root at depth 0 included;
    `ends` marks the conversation's last node."""
    piece = F.floor(F.col("at") / SEGMENT).cast("long")
    turns = turns.withColumns({"piece": piece, "x": F.xxhash64("at", "token"), "y": F.xxhash64(F.lit(1), "token", "at")}).drop("token")
    before = Window.partitionBy("conv").orderBy("piece")
    pieces = turns.groupBy("conv", "piece").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    carried = pieces.select("conv", "piece", *((F.bit_xor(c).over(before.rowsBetween(Window.unboundedPreceding, -1))).alias(f"c{c}") for c in "xy")).where("piece > 0")
    within = Window.partitionBy("conv", "piece").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = turns.withColumns({c: F.bit_xor(v).over(within) for c, v in (("a", "x"), ("b", "y"))}).join(carried, ["conv", "piece"], "left")
    run = run.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(v, F.lit(0).cast("long"))) for c, v in (("a", "cx"), ("b", "cy"))})
    below = run.select("conv", "piece", (F.col("at") + 1).alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "words", (F.col("at") + 1 == F.col("length")).alias("ends"))
    zero = F.lit(0).cast("long")
    root = lengths.select("conv", zero.alias("piece"), *(zero.alias(c) for c in (*NAME, *PARENT, "words")), (F.col("length") == 0).alias("ends"))
    return below.unionByName(root)


def _sharded(rows: DataFrame, shards: int, work: Callable[[pa.Table, int], pa.Table], columns: list[str], schema: str) -> DataFrame:
    segment = SEGMENT
    shard = F.pmod(F.xxhash64("conv", "piece"), F.lit(shards)).cast("int").alias("shard")
    return rows.select(shard, *columns).groupBy("shard").applyInArrow(lambda table: work(table.select(columns), segment), schema)


def prefix_trie(conversations: DataFrame, every: int = 20) -> DataFrame:
    """The node table: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    turns, lengths = rebuilt(materialize(turns_of(conversations), "ordered-turns"), every)
    paths = materialize(paths_of(turns, lengths), "paths")
    shards = max(1, paths.count() // SHARD_ROWS)

    kinds = ", ".join(f"{c} long" for c in (*NAME, *PARENT, "words", "members", "owner"))
    counted = _sharded(paths, shards, _local_counts, ["conv", "piece", *NAME, *PARENT, "words"], kinds)
    nodes = counted.groupBy(*NAME).agg(F.sum("members").alias("n_convs"), F.min("owner").alias("owner"), *(f(c).alias(f"{c}_{n}") for c in (*PARENT, "words") for f, n in ((F.min, "low"), (F.max, "high"))))
    agree = (F.col("pa_low") == F.col("pa_high")) & (F.col("pb_low") == F.col("pb_high")) & (F.col("words_low") == F.col("words_high"))
    words = F.when(agree, F.col("words_low")).otherwise(F.raise_error(F.lit("prefix digests collide")))
    nodes = materialize(nodes.select(*NAME, F.col("pa_low").alias("pa"), F.col("pb_low").alias("pb"), "owner", "n_convs", ((F.col("n_convs") - 1) * words).alias("saved")), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    owned = nodes.select(F.col("owner").alias("conv"), "depth", "saved", (F.col("n_children") == 0).cast("long").alias("leaves"))
    added = paths.join(owned, ["conv", "depth"], "left").fillna(0, ["saved", "leaves"]).select("conv", "piece", *NAME, *PARENT, "saved", "leaves")
    added = materialize(added, "owned")
    later = Window.partitionBy("conv").orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1)
    pieces = added.groupBy("conv", "piece").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    after = pieces.select("conv", "piece", *(F.sum(c).over(later).alias(c) for c in ("saved", "leaves"))).where("saved is not null")
    piece_ends = added.where((F.col("depth") > 0) & (F.col("depth") % SEGMENT == 0)).drop("saved", "leaves").join(after, ["conv", "piece"])
    columns = [*NAME, *PARENT, "saved", "leaves"]
    sums = _sharded(added.unionByName(piece_ends), shards, _local_sums, columns, ", ".join(f"{c} long" for c in (*NAME, "saved", "leaves")))

    ends = paths.where("ends").groupBy(*NAME, F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))
    ends = ends.repartition(*NAME).sortWithinPartitions(*NAME, "chunk").select(*NAME, "ids").mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")

    none = lambda kind: F.lit(None).cast(kind)
    parts = sums.withColumn("ends_sha256", none("string")).unionByName(ends.withColumns({"saved": none("long"), "leaves": none("long")}))
    parts = parts.groupBy(*NAME).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.max("ends_sha256").alias("ends_sha256"))
    whole = materialize(nodes.drop("saved").join(parts, NAME, "left"), "trie")

    # all nodes of depth 1 have the root for a parent: its owner is one number, not a join on one key
    root = whole.where("depth = 0").select("owner").first()
    low = whole.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root and root["owner"]).cast("long")))
    parents = whole.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("parent_conv_id"))
    high = whole.where("depth > 1").join(parents.where("depth > 1"), ["depth", *PARENT])
    return low.unionByName(high).select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
