"""Index building: extrema of blocks and slices, envelopes, the packed tree, Bloom filters.

All levels are ordinary aggregates with partial sums in the scan's tasks; a dump stored in offset order sends about one
row for each block and task through the shuffle. Axes are unpivoted after aggregation, not before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockscope.functions import bloom
from blockscope.functions.predicates import highest, lowest
from blockscope.sources.particles import AXES, GROUP, Layout, block_catalogue, if_few, matched, runs_of, with_blocks, with_positions
from blockscope.sources.shared import stored

#: Blocks of a node for which distinct ids are counted, as a power for each level.
FAN = 16
#: First hash function of each record's filters, so that their false positives are independent.
SEEDS = {"position": 0, "momentum": bloom.MOST}
ENVELOPE = ["minx", "maxx", "miny", "maxy", "minz", "maxz"]


def _extrema(blocked: DataFrame, keys: list[str], records: list[str]) -> DataFrame:
    start = "block_start" if "block_start" in blocked.columns and "slice_id" not in keys else "pos"
    made = [F.min(start).alias("start"), (F.max("pos") + 1).alias("end")]
    for record in records:
        for axis, column in AXES[record].items():
            made += [lowest(F.col(column)).alias(f"{record}_{axis}_min"), highest(F.col(column)).alias(f"{record}_{axis}_max")]
    return blocked.groupBy(*keys).agg(*made)


def by_axis(wide: DataFrame, keep: list[str], records: list[str]) -> DataFrame:
    """A row for each record and axis of columns <record>_<axis>_min and _max."""
    cases = F.array(*(F.struct(F.lit(r).alias("record"), F.lit(a).alias("axis"), F.col(f"{r}_{a}_min").alias("min"), F.col(f"{r}_{a}_max").alias("max")) for r in records for a in AXES[r]))
    return wide.select(*keep, F.inline(cases))


def _blocked(particles: DataFrame, layout: Layout) -> DataFrame:
    """Rows that carry their block need nothing else: its start is its least offset."""
    return particles if layout is None and "block_id" in particles.columns else with_blocks(particles, layout)


def _by_slice(particles: DataFrame, layout: Layout, slice_rows: int, records: list[str]) -> DataFrame:
    return _extrema(with_blocks(particles, layout, slice_rows), [*GROUP, "block_id", "block_start", "slice_id"], records)


def minmax_blocks(particles: DataFrame, layout: Layout, records: list[str] | None = None) -> DataFrame:
    """(iteration, species, start, end, record, axis, min, max): a row for each block and axis. NaN is ignored."""
    records = records or list(AXES)
    return by_axis(_extrema(_blocked(particles, layout), [*GROUP, "block_id"], records), [*GROUP, "start", "end"], records)


def minmax_slices(particles: DataFrame, layout: Layout, slice_rows: int, records: list[str] | None = None) -> DataFrame:
    """As for blocks, for each slice, with its block's start."""
    records = records or list(AXES)
    return by_axis(_by_slice(particles, layout, slice_rows, records), [*GROUP, "block_start", "start", "end"], records)


def wide_blocks(particles: DataFrame, layout: Layout) -> DataFrame:
    """(iteration, species, start, end, <record>_<axis>_min and _max): a row for each block, with which extrema by axis and
    envelopes are made."""
    return _extrema(_blocked(particles, layout), [*GROUP, "block_id"], list(AXES)).drop("block_id")


def wide_slices(particles: DataFrame, layout: Layout, slice_rows: int) -> DataFrame:
    """The same for each slice, with its block's start and its number there."""
    return _by_slice(particles, layout, slice_rows, list(AXES)).drop("block_id")


def rollup_slices(slices: DataFrame) -> DataFrame:
    """Block rows from slice rows."""
    return slices.groupBy(*GROUP, "block_start", "record", "axis").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("min").alias("min"), F.max("max").alias("max")).drop("block_start")


def by_record(wide: DataFrame, keep: list[str], records: list[str]) -> DataFrame:
    """A row for each record, with its envelope."""
    cases = F.array(*(F.struct(F.lit(r).alias("record"), *(F.col(f"{r}_{a}_{m}").alias(f"{m}{a}") for a in "xyz" for m in ("min", "max"))) for r in records))
    return wide.select(*keep, F.inline(cases))


def leaf_envelopes(particles: DataFrame, layout: Layout, records: list[str] | None = None) -> DataFrame:
    """(iteration, species, start, end, record, minx ... maxz) of each block."""
    records = records or list(AXES)
    return by_record(_extrema(_blocked(particles, layout), [*GROUP, "block_id"], records), [*GROUP, "start", "end"], records)


def slice_envelopes(particles: DataFrame, layout: Layout, slice_rows: int, records: list[str] | None = None) -> DataFrame:
    records = records or list(AXES)
    return by_record(_by_slice(particles, layout, slice_rows, records), [*GROUP, "block_start", "start", "end"], records)


def hull(nodes: DataFrame, by: list[str]) -> DataFrame:
    """The envelope of envelopes, offsets included."""
    sides = [F.min(c) if c.startswith("min") else F.max(c) for c in ENVELOPE]
    return nodes.groupBy(*by).agg(*(s.alias(c) for s, c in zip(sides, ENVELOPE)), F.min("start").alias("start"), F.max("end").alias("end"))


def pack_tree(leaves: DataFrame, capacity: int = 10) -> DataFrame:
    """Leaves and their ancestors: (iteration, species, record, level, node, parent, envelope, start, end).

    Sort-tile-recursive packing: the leaves of a tree are cut into slabs along x and those along y, at approximate
    quantiles of their centres, and sorted along z within; runs of `capacity` nodes in that order share a parent. A node's
    number at level L is its rank over capacity^L. The tree only speeds pruning up; results never depend on it.
    """
    key = [*GROUP, "record"]
    leaves = stored(leaves, "leaves")  # they are read several times
    sizes = leaves.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    slabs = F.ceil(F.pow(F.col("n") / capacity, F.lit(1 / 3))).cast("int")
    widest, trees = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    most = max(2, math.ceil((widest / capacity) ** (1 / 3)))
    marks = [k / most for k in range(1, most)]
    out = matched(leaves, if_few(sizes.select(*key, slabs.alias("slabs")), trees), key)
    for axis, tile, by, tiles in (("x", "tile_x", key, trees), ("y", "tile_y", [*key, "tile_x"], trees * most)):
        out = out.withColumn("centre", (F.col(f"min{axis}") + F.col(f"max{axis}")) / 2)
        cuts = out.groupBy(*by).agg(F.percentile_approx("centre", marks, max(1000, 20 * most)).alias("cuts"))
        out = matched(out, if_few(cuts, tiles * most), by)  # by the cuts' number, not that of the rows that hold them
        out = out.withColumn(tile, F.floor(F.size(F.filter("cuts", lambda c: c < F.col("centre"))) * F.col("slabs") / most).cast("int")).drop("cuts")
    out = out.withColumn("centre", (F.col("minz") + F.col("maxz")) / 2).drop("slabs")
    ranked = with_positions(out, ["tile_x", "tile_y", "centre", "start"], key).drop("tile_x", "tile_y", "centre")
    made = stored(ranked.withColumns({"level": F.lit(0), "node": F.col("pos"), "parent": F.floor(F.col("pos") / capacity).cast("long")}).drop("pos"), "tree-level")
    names = [*key, "level", "node", "parent", *ENVELOPE, "start", "end"]
    nodes, level = made.select(*names), 0
    while widest > 1:
        level, widest = level + 1, -(-widest // capacity)
        up = hull(made, [*key, "parent"]).withColumnRenamed("parent", "node")
        made = stored(up.withColumns({"level": F.lit(level), "parent": F.floor(F.col("node") / capacity).cast("long")}), "tree-level")
        nodes = nodes.unionByName(made.select(*names))
    return stored(nodes, "tree")


def block_filters(particles: DataFrame, block_rows: int, bits_per_key: float = 10) -> DataFrame:
    """(iteration, species, block_id, segment, bitmap): a Bloom filter over the ids of each block."""
    ids = with_blocks(particles, block_rows).select(*GROUP, "block_id", "id")
    return bloom.build(ids, [*GROUP, "block_id"], segments=bloom.segments_for(block_rows, bits_per_key), k=bloom.hash_count(bits_per_key), bits=bloom.bits_for(block_rows, bits_per_key))


def _levels(particles: DataFrame, block_rows: int) -> int:
    """Levels of a tree of runs of blocks, up to a single run for the largest species."""
    last = particles.agg(F.max("pos")).first()[0]
    levels, blocks = 1, 1 if last is None else last // block_rows + 1
    while blocks > 1:
        levels, blocks = levels + 1, -(-blocks // FAN)
    return levels


def ids_per_node(particles: DataFrame, block_rows: int) -> DataFrame:
    """(iteration, species, level, node, ids): how many distinct ids blocks (level 0) and runs of FAN^level blocks hold. Null
    ids don't count. Each level starts from the distinct ids of the one below."""
    held = with_blocks(particles, block_rows).select(*GROUP, F.col("block_id").alias("node"), "id").where("id is not null")
    out = None
    for level in range(_levels(particles, block_rows)):
        if level:
            held = held.withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
        held = stored(held.distinct(), "node-ids")
        made = held.groupBy(*GROUP, "node").agg(F.count(F.lit(1)).alias("ids")).select(*GROUP, F.lit(level).alias("level"), "node", "ids")
        out = made if out is None else out.unionByName(made)
    return out


def sketch_ids_per_node(particles: DataFrame, tree: DataFrame, layout: Layout, record: str = "position", lg_k: int = 12) -> DataFrame:
    """(iteration, species, level, node, sketch, ids): about how many distinct ids each node of a packed tree holds. One pass over
    the rows makes the leaves' sketches, and each node's is the union of its children's; the error is about 1.04 / 2^(lg_k / 2)."""
    nodes = tree.where(F.col("record") == record)
    leaves = nodes.where("level = 0").select(*GROUP, F.col("start").alias("block_start"), "node", "parent")
    rows = with_blocks(particles, layout).where("id is not null").groupBy(*GROUP, "block_start").agg(F.hll_sketch_agg("id", F.lit(lg_k)).alias("sketch"))
    made = stored(matched(leaves, rows, [*GROUP, "block_start"]).drop("block_start"), "sketches")
    out, top = made.withColumn("level", F.lit(0)), nodes.agg(F.max("level")).first()[0] or 0
    for level in range(1, top + 1):
        up = made.groupBy(*GROUP, F.col("parent").alias("node")).agg(F.hll_union_agg("sketch").alias("sketch"))
        parents = nodes.where(F.col("level") == level).select(*GROUP, "node", "parent")
        made = stored(matched(up, parents, [*GROUP, "node"]), "sketches")
        out = out.unionByName(made.withColumn("level", F.lit(level)))
    return out.select(*GROUP, "level", "node", "sketch", F.hll_sketch_estimate("sketch").alias("ids"))


def filter_shape(particles: DataFrame, layout: Layout, bits_per_key: float, capacity: int = 10, record: str = "position") -> bloom.FilterShape:
    """Filter sizes for a layout. Blocks that differ in length are taken at their mean: longer ones have more false positives."""
    rows = layout
    if not isinstance(layout, int):
        blocks = layout if layout is not None else block_catalogue(particles)
        rows = math.ceil(blocks.agg(F.avg("count")).first()[0] or 1)
    return bloom.FilterShape(rows, capacity, float(bits_per_key), SEEDS[record])


#: Ids of a task that are turned into bitmaps at a time.
AT_ONCE = 500_000


def node_filters(particles: DataFrame, tree: DataFrame, layout: Layout, shape: bloom.FilterShape, record: str = "position") -> DataFrame:
    """(iteration, species, record, level, node, segment, bitmap): Bloom filters over the ids of the packed tree's nodes, the
    root's left out unless it is a leaf. Null ids don't count.

    Ids are hashed once and sorted once, by their leaf's number (counted on from tree to tree, which gives ranges of equal size
    without a sample of the rows), in which the nodes of every level are runs; a task turns its runs into bitmaps of all levels. Only bitmaps at the ends of what a task has at a time are merged with others."""
    nodes = tree.where(F.col("record") == record)
    leaves = nodes.where("level = 0").select(*GROUP, F.col("start").alias("block_start"), F.col("node").alias("leaf"))
    seen = nodes.agg(F.max("level").alias("top"), F.count_if(F.col("level") == 0).alias("leaves"), F.count_if((F.col("level") == 0) & (F.col("node") == 0)).alias("trees")).first()
    levels, parts = max(1, seen["top"] or 0), int(particles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = leaves.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n"))
    before = stored(sizes.select(*GROUP, (F.sum("_n").over(Window.orderBy(*GROUP)) - F.col("_n")).alias("_before")), "leaves-before")  # a row for each tree
    leaves = matched(leaves, if_few(before, seen["trees"]), GROUP).select(*GROUP, "block_start", "leaf", (F.col("_before") + F.col("leaf")).alias("_rank"))
    ids = with_blocks(particles, layout).where("id is not null").select(*GROUP, "block_start", "id")
    ids = matched(ids, if_few(leaves, seen["leaves"]), [*GROUP, "block_start"]).select(*GROUP, "leaf", "_rank", *(c.alias(n) for n, c in shape.hashed(F.col("id")).items()))
    run = F.floor(F.col("_rank") * parts / max(1, seen["leaves"])).cast("int")
    ids = ids.repartitionById(parts, run).sortWithinPartitions("_rank").drop("_rank")
    made_of = pa.schema([("level", pa.int32()), ("node", pa.int64()), ("segment", pa.int32()), ("bitmap", pa.binary()), ("whole", pa.bool_())])

    def made(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        for begin, end in runs_of(table, GROUP):
            part = table.slice(begin, end - begin)
            leaf, g, h = (part.column(c).to_numpy() for c in ("leaf", "_g", "_h"))
            for level in range(levels):
                node, segment, bitmaps = shape.bitmaps(level, leaf // shape.capacity**level, g, h)
                whole = (node != node[0]) & (node != node[-1])
                for k in range(0, len(node), 10_000):
                    some = slice(k, k + 10_000)
                    columns = [pa.array(v, f.type) for v, f in zip((np.full(len(node[some]), level), node[some], segment[some], bitmaps[some], whole[some]), made_of)]
                    group = [pa.repeat(part.column(c)[0], len(node[some])) for c in GROUP]
                    yield pa.RecordBatch.from_arrays([*group, *columns], names=[*GROUP, *made_of.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= AT_ONCE:
                yield from made(held)
                held, n = [], 0
        if n:
            yield from made(held)

    kinds = ", ".join(f"{c} {ids.schema[c].dataType.simpleString()}" for c in GROUP)
    bitmaps = stored(ids.mapInArrow(run, f"{kinds}, level int, node long, segment int, bitmap binary, whole boolean"), "bitmaps")
    key = [*GROUP, "level", "node", "segment"]
    cut = bitmaps.where("not whole").groupBy(*key).agg(F.substring(F.bitmap_or_agg("bitmap"), F.lit(1), F.max(F.octet_length("bitmap"))).alias("bitmap"))
    out = bitmaps.where("whole").select(*key, "bitmap").unionByName(cut)
    return out.select(*GROUP, F.lit(record).alias("record"), "level", "node", "segment", "bitmap")
