"""Index queries: candidate row windows for ranges, boxes and ids, and exact rows read through them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockscope.functions.bloom import FilterShape, words_of
from blockscope.functions.predicates import EVERYTHING, Bounds, meets_box, overlaps, within
from blockscope.operators.build import hull
from blockscope.sources.particles import AXES, GROUP, SEGMENT, Layout, group_key, if_few, in_buckets_of, in_windows, matched, with_blocks
from blockscope.sources.shared import stored_and_counted

#: Segments of an index hit list that are broadcast; beyond, the join is left to Spark.
MAX_BROADCAST = 500_000
#: Bytes of the uppermost filters that are broadcast.
MAX_TOP_BYTES = 8 << 20


def range_blocks(blocks: DataFrame, record: str, axis: str, bounds: Bounds = EVERYTHING) -> DataFrame:
    """Blocks whose extrema on one axis meet the closed interval."""
    return _range_hits(blocks, record, axis, bounds).select(*GROUP, "start", "end")


def _range_hits(nodes: DataFrame, record: str, axis: str, bounds: Bounds) -> DataFrame:
    return nodes.where((F.col("record") == record) & (F.col("axis") == axis) & overlaps(F.col("min"), F.col("max"), bounds))


def _box_hits(nodes: DataFrame, record: str, box: dict[str, Bounds]) -> DataFrame:
    return nodes.where((F.col("record") == record) & meets_box(box))


def _with_slices(blocks: DataFrame, slices: DataFrame) -> DataFrame:
    """Hit blocks with their hit slices. Tables that are bucketed by the block's key are joined on it, without an exchange."""
    hits = slices.withColumns({"slice_start": F.col("start"), "slice_end": F.col("end"), "start": F.col("block_start")})
    if "_key" in blocks.columns and "_key" in slices.columns:
        joined = blocks.select("_key", *GROUP, "start", "end").join(hits.select("_key", "slice_start", "slice_end"), "_key", "left")
    else:
        joined = matched(blocks.select(*GROUP, "start", "end"), hits.select(*GROUP, "start", "slice_start", "slice_end"), [*GROUP, "start"], "left")
    return joined.select(*GROUP, "start", "end", "slice_start", "slice_end")


def range_slices(blocks: DataFrame, slices: DataFrame, record: str, axis: str, bounds: Bounds = EVERYTHING) -> DataFrame:
    """Those blocks with their slices that meet the interval: (iteration, species, start, end, slice_start, slice_end).

    A block none of whose slices meets it stays, with null slices."""
    return _with_slices(_range_hits(blocks, record, axis, bounds), _range_hits(slices, record, axis, bounds))


def nested(flat: DataFrame) -> DataFrame:
    """One row for each block: its slices as q, a map from slice start to (start, end)."""
    slice_ = F.struct(F.col("slice_start").alias("start"), F.col("slice_end").alias("end"))
    entries = F.collect_list(F.when(F.col("slice_start").isNotNull(), F.struct(F.col("slice_start").cast("string").alias("key"), slice_.alias("value"))))
    return flat.groupBy(*GROUP, "start", "end").agg(F.map_from_entries(entries).alias("q"))


def blocks_on_all_axes(blocks: DataFrame, select: dict[tuple[str, str], Bounds]) -> DataFrame:
    """Blocks that every (record, axis) condition hits: one pass over the index, one aggregate."""
    conditions = [(F.col("record") == r) & (F.col("axis") == a) & overlaps(F.col("min"), F.col("max"), b) for (r, a), b in select.items()]
    hit = blocks.where(reduce(lambda x, y: x | y, conditions))
    return hit.groupBy(*GROUP, "start", "end").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(select)).drop("n")


def box_blocks(envelopes: DataFrame, record: str, box: dict[str, Bounds]) -> DataFrame:
    """Blocks whose envelope meets the box (closed on all sides)."""
    return _box_hits(envelopes, record, box).select(*GROUP, "start", "end")


def box_slices(envelopes: DataFrame, slices: DataFrame, record: str, box: dict[str, Bounds]) -> DataFrame:
    return _with_slices(_box_hits(envelopes, record, box), _box_hits(slices, record, box))


def tree_box(tree: DataFrame, record: str, box: dict[str, Bounds]) -> DataFrame:
    """The same blocks by descending a packed tree: level by level, only children of nodes that meet the box."""
    tree = tree.where((F.col("record") == record) & meets_box(box))
    top = tree.agg(F.max("level")).first()[0] or 0
    key = [*GROUP, "record"]
    found = tree.where(F.col("level") == top)
    for level in range(top - 1, -1, -1):
        parents = found.select(*key, F.col("node").alias("parent"))
        found = matched(tree.where(F.col("level") == level), parents, [*key, "parent"], "left_semi")
    return found.select(*GROUP, "start", "end")


def dataset_bounds(envelopes: DataFrame) -> DataFrame:
    """The root envelope of each iteration, species and record."""
    return hull(envelopes, [*GROUP, "record"])


def get_particle(particles: DataFrame, index: DataFrame, select: dict[tuple[str, str], Bounds], columns: list[str], layout: Layout, iteration: int | None = None, species: str | None = None, slices: DataFrame | None = None, slice_rows: int | None = None) -> DataFrame:
    """Exact rows within all closed intervals, read through the blocks (or, where `slices` is given, the slices) that the index
    leaves. The result equals a full scan with the same conditions, whatever lengths the blocks have.

    `index` has block extrema by axis, `slices` slice extrema; a slice that meets all conditions lies in a block that does.
    Folders of the dump without a hit aren't read; within the others, rows meet the hits by segments of offsets.
    """
    chosen = [c for c in ((F.col("iteration") == iteration) if iteration is not None else None, (F.col("species") == species) if species is not None else None) if c is not None]
    narrowed = lambda df: reduce(lambda d, c: d.where(c), chosen, df)
    length = (slice_rows if slices is not None else None) or (layout if isinstance(layout, int) else SEGMENT)
    segments = F.floor((F.col("end") - 1) / length) - F.floor(F.col("start") / length) + 1
    hits, n = stored_and_counted(blocks_on_all_axes(narrowed(index if slices is None else slices), select), "hits", segments)
    rows = in_windows(in_buckets_of(narrowed(particles), hits), hits, length, few=n <= MAX_BROADCAST)
    for (record, axis), bounds in select.items():
        rows = rows.where(within(F.col(AXES[record][axis]), bounds))
    return rows.select(*columns)


def filter_key(capacity: int = 10) -> Column:
    """What filters are bucketed by: their parent and segment, since an id is asked of all children of a node."""
    return group_key("level", F.floor(F.col("node") / capacity).cast("long"), "segment")


def trace_candidates(tree: DataFrame, filters: DataFrame, ids: DataFrame, shape: FilterShape, record: str = "position", id_col: str = "id") -> DataFrame:
    """(iteration, species, start, end, id): blocks whose Bloom filters may have the id. Distinct ids count once.

    The packed tree is descended: an id is asked of the nodes below the root, then of the children of those that may have it.
    A probe is a join on parent and segment, so that an id goes through the shuffle once for all children. Filters that are
    bucketed by these are read where they are. What is asked is broadcast only if it was counted as few: its stored form is
    far smaller than its rows."""
    filters, nodes = filters.where(F.col("record") == record), tree.where(F.col("record") == record)
    top = filters.agg(F.max("level")).first()[0] or 0
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # ids are short, but each is asked of many nodes
    found, n = ids.select(F.col(id_col).cast("long").alias("id")).where("id is not null").repartition(parts, "id").distinct(), None
    for level in range(top, -1, -1):
        asked = found.withColumns(shape.hashed(F.col("id"))).withColumn("segment", shape.segment(level))
        held, words = filters.where(F.col("level") == level), words_of(F.col("bitmap"))
        if level == top:
            size = held.agg(F.sum(F.octet_length("bitmap"))).first()[0] or 0
            held = held.select(*GROUP, "node", "segment", words.alias("words"))
            met = asked.join(F.broadcast(held), "segment") if size <= MAX_TOP_BYTES else asked.hint("merge").join(held, "segment")
        elif "_key" in filters.columns:
            met = if_few(asked.withColumns({"level": F.lit(level), "_key": group_key("level", "node", "segment")}).drop("node", *GROUP), n).join(held.select("_key", *GROUP, "node", words.alias("words")), "_key")
        else:
            below = held.select(*GROUP, F.floor(F.col("node") / shape.capacity).cast("long").alias("parent"), "node", "segment", words.alias("words"))
            met = matched(if_few(asked.withColumnRenamed("node", "parent"), n), below, [*GROUP, "parent", "segment"])
        found, n = stored_and_counted(met.where(shape.may_hold(F.col("words"), level)).select(*GROUP, "node", "id"), "descent")
    leaves = nodes.where("level = 0").select(*GROUP, "node", "start", "end")
    return matched(if_few(found, n), leaves, [*GROUP, "node"]).select(*GROUP, "start", "end", "id")


def trace(particles: DataFrame, ids: DataFrame, layout: Layout = None, candidates: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(iteration, species, start, end, id): each block that has the id, verified on the rows, so that false positives of
    filters never show. Of a dump, only folders that have a candidate block are read, and blocks' ends come from the
    candidates; without candidates all rows are read, and blocks come from the layout. Ids, blocks and candidates are counted,
    and broadcast only if they are few."""
    wanted, asked = stored_and_counted(ids.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct(), "wanted")
    wanted = if_few(wanted, asked)
    if candidates is None:
        blocked = with_blocks(particles, layout).select(*GROUP, "block_id", "pos", "id")
        ends, n = stored_and_counted(blocked.groupBy(*GROUP, "block_id").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")), "ends")
        hits = blocked.join(wanted, "id", "left_semi").select(*GROUP, "block_id", "id").distinct()
        return matched(hits, if_few(ends, n), [*GROUP, "block_id"]).select(*GROUP, "start", "end", "id")
    candidates, n = stored_and_counted(candidates.join(wanted, "id", "left_semi").select(*GROUP, "start", "end", "id").distinct(), "candidates")
    rows = in_buckets_of(particles, candidates.select(*GROUP, "start", "end").distinct()).select(*GROUP, "pos", "id")
    inside = (F.col("l.pos") >= F.col("r.start")) & (F.col("l.pos") < F.col("r.end"))
    return matched(rows, if_few(candidates, n), [*GROUP, "id"], "inner", inside).select(*GROUP, "start", "end", "id").distinct()


def intersect_traces(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hits of two records (candidates or verified ones) on the same block and id; blocks left without an id go."""
    on = [*GROUP, "start", "end", "id"]
    return matched(a.select(*on), b.select(*on), on, "left_semi")


def trace_result(hits: DataFrame) -> DataFrame:
    """One row for each block, its ids as an ordered array."""
    return hits.groupBy(*GROUP, "start", "end").agg(F.array_sort(F.collect_set("id")).alias("id_data"))
