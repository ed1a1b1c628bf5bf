"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

1. Each text becomes its set of word shingles (64-bit hashes), MinHash samples in bands, and an odd sketch: the samples
   folded into a bitmap by parity. Texts with equal sets are one node, which their common digest tells apart, not an id.
2. Nodes that agree in a band meet in its bucket. The population count of two sketches' XOR estimates their similarity;
   only a forest of the pairs that could reach the threshold leaves a bucket, not the pairs. Its components are
   candidate clusters.
3. The full sets of each cluster meet, and links are confirmed on exact intersections; again a forest of the links
   leaves. Its components are the result.

Buckets and clusters of more than BLOCK nodes, and clusters of more than BLOCK_SHINGLES shingles, are cut into blocks, and
each pair of blocks is a group of its own, so no task holds an unbounded group and no pair is left out. A pair at the threshold escapes all bands, or the sketch bound,
with a probability of about MISS each.

A null or empty text, or one without words, has an empty set and is linked with nothing; with fewer words than a
shingle the whole sequence is one shingle. Ids may be of any type that has an order, null, or repeated: rows are linked by
their texts, so that rows of one id with different texts each belong to the component of their own text, and rows without an
id link what their texts link. A component is named by the smallest id in it, null if it has none; rows that repeat id and
text repeat the result. An empty table gives no rows. A very long text is a block of its own in the last step, where its set
(eight bytes a shingle) has to fit a task. Columns other than the id and the text are not read; `drop_near_duplicates` keeps
them, and goes by rows: it numbers them, so that rows of one id or of none are documents of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockscope.llm.common import materialize, text_slices
from blockscope.llm.graph import connected_components

MISS = 1e-6
BLOCK = 512
#: Shingles of a block's full sets, in the mean; a longer text is a block of its own.
BLOCK_SHINGLES = 2_000_000
SKETCH_BITS = 256
#: Keys of oversized groups that may be broadcast; with more of them the join is left to Spark.
MAX_HOT = 100_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, min(width, len(h)), np.uint64)
        for k in range(min(width, len(h))):
            out = _mixed(out * _MIX[0] + h[k : k + n])
    return np.unique(out)


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows of a band): a pair at the threshold agrees in no band with a probability of MISS at most."""
    rows = 5 if threshold >= 0.85 else 4
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows)), rows


def sketch_bound(threshold: float, samples: int) -> int:
    """The most bits by which odd sketches of a pair at the threshold differ: mean plus five and a half deviations."""
    n, q = SKETCH_BITS, 1 - threshold
    p = np.array([math.comb(samples, k) * q**k * (1 - q) ** (samples - k) for k in range(samples + 1)])
    x = 2 * np.arange(samples + 1)  # samples that differ toggle two bits each
    odd, odd2 = (1 - (1 - 2 / n) ** x) / 2, (1 - 2 * (1 - 2 / n) ** x + (1 - 4 / n) ** x) / 4
    mean, square = (p * n * odd).sum(), (p * (n * odd + n * (n - 1) * odd2)).sum()
    return math.ceil(mean + 5.5 * math.sqrt(square - mean * mean))


class Signer:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20_250_101)
        self.bands, self.rows = bands, rows
        self.scale = rng.integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, bands * rows, np.uint32)
        self.salt = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def sign(self, hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(a 64-bit key for each band, odd sketch) of a set that is not empty."""
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        least = None
        for k in range(0, len(h), 512):
            part = (h[k : k + 512, None] * self.scale + self.shift).min(axis=0)
            least = part if least is None else np.minimum(least, part)
        with np.errstate(over="ignore"):
            marked = _mixed(least.astype(np.uint64) + self.salt)
            keys = np.full(self.bands, 1, np.uint64) + np.arange(self.bands, dtype=np.uint64)
            for column in marked.reshape(self.bands, self.rows).T:
                keys = _mixed(keys * _MIX[0] + column)
        odd = np.bincount((marked & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
        return keys.view(np.int64), np.packbits(odd.astype(np.uint8)).tobytes()


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _text_key(text: Column) -> Column:
    return F.xxhash64(text, F.octet_length(text))


def _signatures(width: int, threshold: float) -> Callable:
    """Of rows (id, text, key)."""
    bands, rows = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            for begin, texts in text_slices(batch, "text"):
                n, digest, keys, sketches = [], [], [], []
                for text in texts:
                    found = shingles(text, width)
                    n.append(len(found))
                    digest.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    key, sketch = signer.sign(found) if len(found) else (None, None)
                    keys.append(key)
                    sketches.append(sketch)
                hashes = batch.column(batch.schema.get_field_index("key")).slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, len(texts)), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), hashes],
                    names=["id", "n_shingles", "digest", "bands", "sketch", "key"],
                )

    return run


def _in_blocks(members: DataFrame, key: str, node: str, weight: Column | None = None) -> DataFrame:
    """The rows with a group for each pair of blocks of their key: columns `left`, `right` (blocks) and `mine`. A block has
    some BLOCK rows and, given their weight in shingles, some BLOCK_SHINGLES."""
    sizes = [F.ceil(F.count(F.lit(1)) / BLOCK), *([] if weight is None else [F.ceil(F.sum(weight) / BLOCK_SHINGLES)]), F.lit(1)]
    hot = materialize(members.groupBy(key).agg(F.least(F.count(F.lit(1)), F.greatest(*sizes)).cast("int").alias("blocks")).where("blocks > 1"), "hot-groups")
    n = hot.count()
    one = {"left": F.lit(0), "right": F.lit(0), "mine": F.lit(0)}
    if not n:
        return members.withColumns(one)
    joined = members.join(F.broadcast(hot) if n <= MAX_HOT else hot, key, "left")
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64(node), blocks).cast("int")
    return (
        joined.withColumns({"blocks": blocks, "mine": mine})
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"left": F.least("mine", "other"), "right": F.greatest("mine", "other")})
        .drop("blocks", "other")
    )


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Runs of rows that are equal in the first `keys` columns, as lists of the other columns. Rows come sorted by them."""
    now, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:keys] != now:
                if len(rows) > 1:
                    yield list(zip(*rows))
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if len(rows) > 1:
        yield list(zip(*rows))


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sketch_forest(bound: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for nodes, sketches, mine in _groups(batches, 3):
            if len(nodes) == 2:
                if mine[0] == mine[1] and (int.from_bytes(sketches[0]) ^ int.from_bytes(sketches[1])).bit_count() <= bound:
                    out.append(nodes)
            else:
                bits = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(nodes), -1)
                side, forest = np.array(mine), Forest(len(nodes))
                across = len(set(mine)) > 1  # pairs within a block are another group's
                for k in range(len(nodes) - 1):
                    near = np.bitwise_count(bits[k + 1 :] ^ bits[k]).sum(axis=1) <= bound
                    if across:
                        near &= side[k + 1 :] != side[k]
                    out += [(nodes[k], nodes[j]) for j in (np.flatnonzero(near) + k + 1).tolist() if forest.join(k, j)]
            if len(out) >= 50_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _link_forest(percent: int, bound: int) -> Callable:
    """Confirmed links between nodes of one group: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for nodes, sketches, mine, sets in _groups(batches, 3):
            known: dict[int, int] = {}
            keep = [k for k, n in enumerate(nodes) if known.setdefault(n, k) == k]  # a row that is repeated
            nodes, mine = [nodes[k] for k in keep], np.array([mine[k] for k in keep])
            hashes = [np.frombuffer(sets[k], np.uint64) for k in keep]
            bits = np.frombuffer(b"".join(sketches[k] for k in keep), np.uint64).reshape(len(keep), -1)
            sizes = np.array([len(h) for h in hashes])
            # bitmaps over the shingles that two members or more have
            flat = np.concatenate(hashes)
            distinct, place, times = np.unique(flat, return_inverse=True, return_counts=True)
            column = np.cumsum(times > 1) - 1
            wide = (int((times > 1).sum()) + 63) // 64 * 64
            maps, ends = np.zeros((len(nodes), wide // 64), np.uint64), np.concatenate(([0], np.cumsum(sizes)))
            for k in range(len(nodes) if wide else 0):
                has = np.zeros(wide, bool)
                mine_at = place[ends[k] : ends[k + 1]]
                has[column[mine_at[times[mine_at] > 1]]] = True
                maps[k] = np.packbits(has).view(np.uint64)
            del flat, distinct, place
            near = [np.bitwise_count(bits ^ bits[k]).sum(axis=1) <= bound for k in range(len(nodes))]
            across = len(set(mine.tolist())) > 1
            forest, group = Forest(len(nodes)), np.arange(len(nodes))
            for k in sorted(range(len(nodes)), key=lambda k: -int(near[k].sum())):  # likely centres first: the more is joined, the less is left to compare
                ask = near[k] & (group != group[k])
                if across:
                    ask &= mine != mine[k]
                ask &= (100 * np.minimum(sizes, sizes[k]) >= percent * np.maximum(sizes, sizes[k]))
                others = np.flatnonzero(ask)
                if not len(others):
                    continue
                common = np.bitwise_count(maps[others] & maps[k]).sum(axis=1, dtype=np.int64)
                linked = others[100 * common >= percent * (sizes[others] + sizes[k] - common)]
                for j in linked.tolist():
                    if forest.join(k, j):
                        out.append((nodes[k], nodes[j]))
                if len(linked):
                    group = np.array([forest.root(j) for j in range(len(nodes))])
            if len(out) >= 50_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _with_sets(width: int) -> Callable:
    """The full sets of candidate nodes. Rows that repeat id and text follow one another, as the join sorted them: one counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            nodes = batch.column(batch.schema.get_field_index("node")).to_pylist()
            new = pa.array([n != m for n, m in zip(nodes, [last, *nodes])], pa.bool_())
            last, batch = nodes[-1] if nodes else last, batch.filter(new)
            digests = batch.column(batch.schema.get_field_index("digest"))
            for begin, texts in text_slices(batch, "text"):
                part = batch.slice(begin, len(texts))
                found = [shingles(t, width).tobytes() for t in texts]
                same = pa.array([xxhash.xxh3_128_digest(f) == d for f, d in zip(found, digests.slice(begin, len(texts)).to_pylist())])  # else texts whose hashes agree
                columns = [part.column(part.schema.get_field_index(c)) for c in ("cluster", "node", "sketch")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=["cluster", "node", "sketch", "hashes"]).filter(same)

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: links are at 100 * intersection >= percent * union of the sets."""
    spark = docs.sparkSession
    threshold = percent / 100
    bands, rows = banding(threshold)
    bound = sketch_bound(threshold, bands * rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _text_key(F.col(text_col)).alias("key"))
    signed = materialize(keyed.mapInArrow(_signatures(width, threshold), f"id {kind}, n_shingles long, digest binary, bands array<long>, sketch binary, `key` long"), "signatures")

    # a node's text is found again by an id and a hash of a row that has it
    some = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("some")
    nodes = signed.where("digest is not null").groupBy("digest").agg(some, F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "some.id", "some.key", "bands", "sketch"), "nodes")
    members = nodes.select(F.explode("bands").alias("bucket"), "node", "sketch")
    group = ["bucket", "left", "right"]
    met = _in_blocks(members, "bucket", "node").select(*group, "node", "sketch", "mine").repartition(parts, *group).sortWithinPartitions(*group)
    clusters = connected_components(met.mapInArrow(_sketch_forest(bound), "a long, b long"))

    clustered = materialize(clusters.withColumnRenamed("component", "cluster").join(nodes.select("node", "digest", "id", "key", "sketch"), "node"), "clusters")
    same = F.col("l.key").eqNullSafe(F.col("r.key")) & F.col("l.id").eqNullSafe(F.col("r.id"))
    texts = keyed.alias("l").join(clustered.alias("r").hint("merge"), same).select("r.cluster", "r.node", "r.digest", "r.sketch", "l.text")  # one plan at every size
    full = materialize(texts.mapInArrow(_with_sets(width), "cluster long, node long, sketch binary, hashes binary"), "sets")
    group = ["cluster", "left", "right"]
    met = _in_blocks(full, "cluster", "node", F.octet_length("hashes") / 8).select(*group, "node", "sketch", "mine", "hashes").repartition(parts, *group).sortWithinPartitions(*group)
    components = materialize(connected_components(met.mapInArrow(_link_forest(percent, bound), "a long, b long")), "components")

    least = components.join(nodes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least"))
    linked = components.join(least, "component").select("node", "least", F.lit(True).alias("linked"))
    named = nodes.select("digest", "node", "id").join(linked, "node", "left").select("digest", F.when(F.col("linked"), F.col("least")).otherwise(F.col("id")).alias("component"))
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component"))
    return signed.select("id", "n_shingles", "digest").join(named, "digest", "left").select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id (any one of equal ids; none is the largest), with the columns it came with."""
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    later = materialize(near_duplicates(rows, width, percent, "__row", text_col).where(~F.col("kept")).select("__row", F.col("component_id").alias("__component")), "linked")
    linked = later.unionByName(later.select(F.col("__component").alias("__row"), "__component").distinct())
    linked = materialize(linked.join(rows.select("__row", F.col(id_col).alias("__id")).hint("merge"), "__row"), "linked-ids")
    first = linked.groupBy("__component").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__row")).alias("first")).select("first.__row")
    gone = linked.select("__row").join(first.hint("merge"), "__row", "left_anti")
    return rows.join(gone.hint("merge"), "__row", "left_anti").select(*docs.columns)
