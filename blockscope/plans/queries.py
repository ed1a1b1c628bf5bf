"""Registered queries of the particle operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.functions import bloom
from blockscope.functions.predicates import cut_block, from_row_major, row_major
from blockscope.operators import build, query, relayout
from blockscope.sources.footers import folder_minmax
from blockscope.sources.index_store import MinMaxQuery, RTreeQuery, index_directory, write_block_catalogue, write_index
from blockscope.sources.particles import AXES, GROUP, SCHEMA, block_catalogue, bucket_for, dump, if_few, lineitem_particles, matched, parse_attributes, placed_particles, read_attributes, read_dump, variable_path, with_blocks, with_listed_blocks, write_attributes, write_dump, zip_axes
from blockscope.sources.shared import new_path, stored, stored_and_counted
from blockscope.streaming.incremental import MaintainedIndex

BLOCK, SLICE, BITS = 100, 25, 10
RANGE = (1400.0, 1500.0)
#: The iteration and species that lookups in stored indexes ask for.
STORED = (1996, "N")
BOX = {"x": (49.0, 50.0), "y": (950.0, 3000.0), "z": (0.01, 0.02)}
POSITION = {("position", a): b for a, b in BOX.items()}
PHASE = {("position", "x"): (40.0, 50.0), ("position", "z"): (0.01, 0.02), ("momentum", "x"): (0.0, 0.03), ("momentum", "y"): (1.0, 5000.0)}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Particles, blocks and slices of `lineitem` in SQL.
PARTICLES = """
WITH p AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS iteration, l_returnflag AS species, l_orderkey AS id, l_quantity AS x, l_extendedprice AS y, l_discount + 0.0 AS z,
    l_tax + 0.0 AS ux, CAST(l_partkey AS DOUBLE) AS uy, CAST(l_suppkey AS DOUBLE) AS uz,
    CAST(row_number() OVER (PARTITION BY year(l_shipdate), l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS BIGINT) AS pos
  FROM lineitem
), b AS (SELECT *, pos // 100 AS block_id, (pos % 100) // 25 AS slice_id FROM p),
long AS (
  SELECT iteration, species, pos, block_id, slice_id, 'position' AS record, unnest(['x', 'y', 'z']) AS axis, unnest([x, y, z]) AS v FROM b
  UNION ALL SELECT iteration, species, pos, block_id, slice_id, 'momentum', unnest(['x', 'y', 'z']), unnest([ux, uy, uz]) FROM b
),
l1 AS (SELECT iteration, species, min(pos) AS "start", max(pos) + 1 AS "end", record, axis, min(v) AS "min", max(v) AS "max" FROM long GROUP BY iteration, species, block_id, record, axis),
l2 AS (
  SELECT iteration, species, block_id * 100 AS block_start, min(pos) AS "start", max(pos) + 1 AS "end", record, axis, min(v) AS "min", max(v) AS "max"
  FROM long GROUP BY iteration, species, block_id, slice_id, record, axis
),
e1 AS (
  SELECT iteration, species, min(pos) AS "start", max(pos) + 1 AS "end", 'position' AS record, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, min(z) AS minz, max(z) AS maxz
  FROM b GROUP BY iteration, species, block_id
  UNION ALL SELECT iteration, species, min(pos), max(pos) + 1, 'momentum', min(ux), max(ux), min(uy), max(uy), min(uz), max(uz) FROM b GROUP BY iteration, species, block_id
),
e2 AS (
  SELECT iteration, species, block_id * 100 AS block_start, min(pos) AS "start", max(pos) + 1 AS "end", min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, min(z) AS minz, max(z) AS maxz
  FROM b GROUP BY iteration, species, block_id, slice_id
)
"""
IN_BOX = "minx <= 50 AND maxx >= 49 AND miny <= 3000 AND maxy >= 950 AND minz <= 0.02 AND maxz >= 0.01"


def registered(sql: str | None = None, with_particles: bool = True):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (PARTICLES if with_particles else "") + sql
        return f

    return add


@registered("SELECT * FROM l1")
def minmax_build_l1(spark, sf_dir):
    return build.minmax_blocks(dump(spark, sf_dir), BLOCK)


@registered("SELECT * FROM l2")
def minmax_build_l2(spark, sf_dir):
    return build.minmax_slices(dump(spark, sf_dir), BLOCK, SLICE)


@registered("SELECT * FROM l1")
def minmax_rollup(spark, sf_dir):
    return build.rollup_slices(build.minmax_slices(dump(spark, sf_dir), BLOCK, SLICE))


@registered("""SELECT iteration, species, "start", "end" FROM l1 WHERE record = 'position' AND axis = 'y' AND "min" <= 1500 AND "max" >= 1400""")
def minmax_range_l1(spark, sf_dir):
    return query.range_blocks(build.minmax_blocks(dump(spark, sf_dir), BLOCK, ["position"]), "position", "y", RANGE)


@registered("""
SELECT h.iteration, h.species, h."start", h."end", s."start" AS slice_start, s."end" AS slice_end
FROM (SELECT * FROM l1 WHERE record = 'position' AND axis = 'y' AND "min" <= 1500 AND "max" >= 1400) h
LEFT JOIN (SELECT * FROM l2 WHERE record = 'position' AND axis = 'y' AND "min" <= 1500 AND "max" >= 1400) s
ON s.iteration = h.iteration AND s.species = h.species AND s.block_start = h."start" """)
def minmax_range_l2(spark, sf_dir):
    particles = dump(spark, sf_dir)
    return query.range_slices(build.minmax_blocks(particles, BLOCK, ["position"]), build.minmax_slices(particles, BLOCK, SLICE, ["position"]), "position", "y", RANGE)


@registered("""SELECT iteration, species, "start", "end" FROM l1 WHERE record = 'momentum' AND axis = 'y' AND "max" >= 1500""")
def minmax_range_open_bounds(spark, sf_dir):
    return query.range_blocks(build.minmax_blocks(dump(spark, sf_dir), BLOCK, ["momentum"]), "momentum", "y", (1500.0, math.inf))


@registered(f"""SELECT iteration, species, "start", "end" FROM e1 WHERE record = 'position' AND {IN_BOX}""")
def minmax_intersect_axes(spark, sf_dir):
    return query.blocks_on_all_axes(build.minmax_blocks(dump(spark, sf_dir), BLOCK, ["position"]), POSITION)


@registered("SELECT * FROM e1")
def rtree_build_leaves(spark, sf_dir):
    return build.leaf_envelopes(dump(spark, sf_dir), BLOCK)


@registered(f"""SELECT iteration, species, "start", "end" FROM e1 WHERE record = 'position' AND {IN_BOX}""")
def rtree_box(spark, sf_dir):
    return query.box_blocks(build.leaf_envelopes(dump(spark, sf_dir), BLOCK, ["position"]), "position", BOX)


@registered(f"""SELECT iteration, species, "start", "end" FROM e1 WHERE record = 'position' AND {IN_BOX}""")
def rtree_box_descent(spark, sf_dir):
    return query.tree_box(build.pack_tree(build.leaf_envelopes(dump(spark, sf_dir), BLOCK, ["position"])), "position", BOX)


@registered(f"""
SELECT h.iteration, h.species, h."start", h."end", s."start" AS slice_start, s."end" AS slice_end
FROM (SELECT * FROM e1 WHERE record = 'position' AND {IN_BOX}) h LEFT JOIN (SELECT * FROM e2 WHERE {IN_BOX}) s
ON s.iteration = h.iteration AND s.species = h.species AND s.block_start = h."start" """)
def rtree_box_l2(spark, sf_dir):
    particles = dump(spark, sf_dir)
    return query.box_slices(build.leaf_envelopes(particles, BLOCK, ["position"]), build.slice_envelopes(particles, BLOCK, SLICE, ["position"]), "position", BOX)


@registered("SELECT * FROM e1 WHERE record = 'position'")
def rtree_metadata(spark, sf_dir):
    return build.leaf_envelopes(dump(spark, sf_dir), BLOCK, ["position"])


@registered("""
SELECT iteration, species, record, min(minx) AS minx, max(maxx) AS maxx, min(miny) AS miny, max(maxy) AS maxy, min(minz) AS minz, max(maxz) AS maxz, min("start") AS "start", max("end") AS "end"
FROM e1 GROUP BY iteration, species, record""")
def rtree_root(spark, sf_dir):
    return query.dataset_bounds(build.leaf_envelopes(dump(spark, sf_dir), BLOCK))


COLUMNS = [*GROUP, "pos", "id", "x", "y", "z"]


@registered("SELECT iteration, species, pos, id, x, y, z FROM p WHERE x BETWEEN 49 AND 50 AND y BETWEEN 950 AND 3000 AND z BETWEEN 0.01 AND 0.02")
def get_particle_position(spark, sf_dir):
    particles = dump(spark, sf_dir)
    return query.get_particle(particles, build.minmax_blocks(particles, BLOCK, ["position"]), POSITION, COLUMNS, BLOCK)


@registered("SELECT iteration, species, pos, id, ux, uy, uz FROM p WHERE x BETWEEN 40 AND 50 AND z BETWEEN 0.01 AND 0.02 AND ux BETWEEN 0 AND 0.03 AND uy BETWEEN 1 AND 5000")
def get_particle_phase_space(spark, sf_dir):
    particles = dump(spark, sf_dir)
    return query.get_particle(particles, build.minmax_blocks(particles, BLOCK), PHASE, [*GROUP, "pos", "id", "ux", "uy", "uz"], BLOCK)


@registered("SELECT iteration, species, pos, id, x, y, z FROM p WHERE x BETWEEN 49 AND 50 AND y BETWEEN 950 AND 3000 AND z BETWEEN 0.01 AND 0.02")
def get_particle_secondary(spark, sf_dir):
    particles = dump(spark, sf_dir)
    blocks, slices = build.minmax_blocks(particles, BLOCK, ["position"]), build.minmax_slices(particles, BLOCK, SLICE, ["position"])
    return query.get_particle(particles, blocks, POSITION, COLUMNS, BLOCK, slices=slices, slice_rows=SLICE)


def _urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to trace: the urgent orders."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("id"))


TRACED = """SELECT DISTINCT b.iteration, b.species, s."start", s."end", b.id FROM b
JOIN (SELECT iteration, species, block_id, min(pos) AS "start", max(pos) + 1 AS "end" FROM b GROUP BY ALL) s USING (iteration, species, block_id)
WHERE b.id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"""


def _candidates(particles: DataFrame, ids: DataFrame, layout, record: str = "position") -> DataFrame:
    """Candidate blocks of the ids, from filters in the nodes of a packed tree."""
    shape = build.filter_shape(particles, layout, BITS, record=record)
    if isinstance(layout, DataFrame):  # rows meet a block table once
        blocked = with_blocks(particles, layout).select(*GROUP, "pos", "id", "block_id", "block_start", *AXES[record].values())
        particles, layout = stored(blocked, "blocked"), None
    tree = build.pack_tree(build.leaf_envelopes(particles, layout, [record]))
    filters = stored(build.node_filters(particles, tree, layout, shape, record), "filters", "level")
    return query.trace_candidates(tree, filters, ids, shape, record)


@registered(TRACED)
def trace_verified(spark, sf_dir):
    particles, ids = dump(spark, sf_dir), _urgent(spark, sf_dir)
    return query.trace(particles, ids, candidates=_candidates(particles, ids, BLOCK))


@registered(TRACED)
def trace_intersected_verified(spark, sf_dir):
    particles, ids = dump(spark, sf_dir), _urgent(spark, sf_dir)
    return query.trace(particles, ids, candidates=query.intersect_traces(*(_candidates(particles, ids, BLOCK, r) for r in AXES)))


@registered()
def bloom_candidates(spark, sf_dir):
    return _candidates(dump(spark, sf_dir), _urgent(spark, sf_dir), BLOCK)


@registered(f"""
SELECT h.iteration, h.species, h.hits, CAST(0 AS BIGINT) AS missed, true AS few_false FROM (SELECT iteration, species, count(*) AS hits FROM ({TRACED}) GROUP BY ALL) h""")
def bloom_accuracy(spark, sf_dir):
    """Candidates of the filters against the blocks that have the ids: none is missed, and few are false."""
    particles, ids = dump(spark, sf_dir), _urgent(spark, sf_dir)
    hits = query.trace(particles, ids, BLOCK)
    found, n = stored_and_counted(_candidates(particles, ids, BLOCK).withColumn("found", F.lit(1)), "found")
    both = matched(hits.withColumn("hit", F.lit(1)), if_few(found, n), [*GROUP, "start", "end", "id"], "left")
    asked, blocks = ids.distinct().count(), matched(particles.groupBy(*GROUP).agg(F.ceil(F.max("pos") / BLOCK).alias("blocks")), found.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("candidates")), GROUP)
    per = both.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("hits"), F.sum(F.col("found").isNull().cast("long")).alias("missed"))
    few = (F.col("candidates") - F.col("hits")) < 0.02 * asked * F.col("blocks")  # about 1 % at ten bits for an id
    return matched(per, blocks, GROUP).select(*GROUP, "hits", "missed", few.alias("few_false"))


@registered()
def bloom_merge(spark, sf_dir):
    merged = bloom.merge(build.block_filters(dump(spark, sf_dir), BLOCK, BITS), GROUP)
    return merged.select(*GROUP, "segment", F.bitmap_count("bitmap").alias("bits"))


@registered()
def str_tree_levels(spark, sf_dir):
    return build.pack_tree(build.leaf_envelopes(dump(spark, sf_dir), BLOCK))


@registered("""SELECT iteration, species, block_id, min(pos) AS "start", count(*) AS "count" FROM b GROUP BY iteration, species, block_id""")
def block_catalogue_rows(spark, sf_dir):
    return block_catalogue(with_blocks(dump(spark, sf_dir), BLOCK))


@registered("SELECT iteration, species, count(DISTINCT block_id) AS blocks, count(*) AS particles FROM b GROUP BY iteration, species")
def block_particle_counts(spark, sf_dir):
    return block_catalogue(with_blocks(dump(spark, sf_dir), BLOCK)).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("blocks"), F.sum("count").alias("particles"))


@registered("SELECT iteration, species, pos, id FROM p WHERE pos < 11")
def first_ids(spark, sf_dir):
    return dump(spark, sf_dir).where("pos < 11").select(*GROUP, "pos", "id")


@registered("""SELECT iteration, species, block_id // 4 AS block_id, min(pos) AS "start", count(*) AS "count", min(x) AS minx, max(x) AS maxx FROM b GROUP BY iteration, species, block_id // 4""")
def relayout_extend(spark, sf_dir):
    merged = relayout.extend(dump(spark, sf_dir), BLOCK, 4)
    return merged.groupBy(*GROUP, "block_id").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("count"), F.min("x").alias("minx"), F.max("x").alias("maxx"))


def _cell_sql(axis: str) -> str:
    return f"CASE WHEN hi_{axis} > lo_{axis} THEN CAST(floor(({axis} - lo_{axis}) / ((hi_{axis} - lo_{axis}) * CAST(1.1 AS DOUBLE) / 3)) AS BIGINT) ELSE 0 END"


@registered(f"""
, ext AS (SELECT iteration, species, block_id, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z FROM b GROUP BY ALL),
cells AS (SELECT iteration, species, block_id, ({_cell_sql("x")} * 3 + {_cell_sql("y")}) * 3 + {_cell_sql("z")} AS cell FROM b JOIN ext USING (iteration, species, block_id)),
counts AS (SELECT iteration, species, block_id, cell, count(*) AS n FROM cells GROUP BY ALL)
SELECT iteration, species, block_id, cell, CAST(sum(n) OVER (PARTITION BY iteration, species ORDER BY block_id, cell) - n AS BIGINT) AS "start", n AS "count" FROM counts""")
def relayout_shrink(spark, sf_dir):
    return relayout.shrink(dump(spark, sf_dir), BLOCK, 3)


#: Rows of the shrunk dump: new offsets and block numbers.
SHRUNK = f"""
, ext AS (SELECT iteration, species, block_id, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z FROM b GROUP BY ALL),
cells AS (SELECT b.*, ({_cell_sql("x")} * 3 + {_cell_sql("y")}) * 3 + {_cell_sql("z")} AS cell FROM b JOIN ext USING (iteration, species, block_id)),
shrunk AS (SELECT iteration, species, CAST(row_number() OVER (g ORDER BY block_id, cell, pos) - 1 AS BIGINT) AS pos, CAST(dense_rank() OVER (g ORDER BY block_id, cell) - 1 AS BIGINT) AS block_id, id, x, y, z
  FROM cells WINDOW g AS (PARTITION BY iteration, species))
"""


@registered(SHRUNK + "SELECT iteration, species, pos, block_id, id, x, y, z FROM shrunk")
def relayout_shrink_rows(spark, sf_dir):
    return relayout.shrink_rows(dump(spark, sf_dir), BLOCK, 3).select(*GROUP, "pos", "block_id", "id", "x", "y", "z")


def _shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump with its blocks split in space: blocks of many lengths."""
    relayout.write_relayout(relayout.shrink_rows(dump(spark, sf_dir), BLOCK, 3), path := new_path(spark, "shrunk"), ranged=True)
    return spark.read.schema(f"{SCHEMA}, block_id long").parquet(path)


@registered(SHRUNK + "SELECT iteration, species, pos, id, x, y, z FROM shrunk WHERE x BETWEEN 49 AND 50 AND y BETWEEN 950 AND 3000 AND z BETWEEN 0.01 AND 0.02")
def shrink_reindexed(spark, sf_dir):
    """Shrink, write the rows anew, index their blocks, which differ in length, and read through that index."""
    rows = _shrunk(spark, sf_dir)
    return query.get_particle(rows, build.minmax_blocks(rows, None, ["position"]), POSITION, COLUMNS, None)


@registered("""SELECT iteration, species, block_id, min(pos) AS "start", max(pos) + 1 AS "end", min(x) AS minx, max(x) AS maxx FROM (SELECT iteration, species, pos, x, CASE WHEN pos < 130 THEN 0 ELSE 1 + (pos - 130) // 70 END AS block_id FROM p) GROUP BY iteration, species, block_id""")
def listed_blocks(spark, sf_dir):
    """Extrema of blocks from a block list of its own: a first block of 130 rows, then runs of 70."""
    particles = dump(spark, sf_dir)
    block = F.when(F.col("pos") < 130, 0).otherwise(1 + F.floor((F.col("pos") - 130) / 70)).cast("long")
    blocks = block_catalogue(particles.withColumn("block_id", block))
    rows = with_listed_blocks(particles, blocks)
    return rows.groupBy(*GROUP, "block_id").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.min("x").alias("minx"), F.max("x").alias("maxx"))


@registered(f"""
SELECT iteration, species, level, block_id // CAST(pow({build.FAN}, level) AS BIGINT) AS node, count(DISTINCT id) AS ids
FROM b, (SELECT CAST(l AS INTEGER) AS level FROM range(0, 12) t(l) WHERE l = 0 OR (SELECT max(block_id) + 1 FROM b) > pow({build.FAN}, l - 1)) GROUP BY ALL""")
def ids_per_node(spark, sf_dir):
    return build.ids_per_node(dump(spark, sf_dir), BLOCK)


@registered(f"""
SELECT h.iteration, h.species, h."start", h."end", count(s."start") AS slices, CAST(coalesce(sum(s."end" - s."start"), 0) AS BIGINT) AS slice_rows
FROM (SELECT * FROM l1 WHERE record = 'position' AND axis = 'y' AND "min" <= {RANGE[1]} AND "max" >= {RANGE[0]} AND iteration = {STORED[0]} AND species = '{STORED[1]}') h
LEFT JOIN (SELECT * FROM l2 WHERE record = 'position' AND axis = 'y' AND "min" <= {RANGE[1]} AND "max" >= {RANGE[0]}) s
ON s.iteration = h.iteration AND s.species = h.species AND s.block_start = h."start" GROUP BY ALL""")
def stored_minmax_slices(spark, sf_dir):
    write_index(dump(spark, sf_dir), path := new_path(spark, "index"), "minmax", BLOCK, SLICE, records=["position"])
    return _slices(MinMaxQuery(spark, path, secondary=True).query_minmax(*STORED, "position", "y", *RANGE))


@registered(f"""
SELECT h.iteration, h.species, h."start", h."end", count(s."start") AS slices, CAST(coalesce(sum(s."end" - s."start"), 0) AS BIGINT) AS slice_rows
FROM (SELECT * FROM e1 WHERE record = 'position' AND {IN_BOX} AND iteration = {STORED[0]} AND species = '{STORED[1]}') h LEFT JOIN (SELECT * FROM e2 WHERE {IN_BOX}) s
ON s.iteration = h.iteration AND s.species = h.species AND s.block_start = h."start" GROUP BY ALL""")
def stored_rtree_slices(spark, sf_dir):
    write_index(dump(spark, sf_dir), path := new_path(spark, "index"), "rtree", BLOCK, SLICE, records=["position"])
    return _slices(RTreeQuery(spark, path, secondary=True).query_xyz(*STORED, "position", *(e for a in "xyz" for e in BOX[a])))


def _slices(found: DataFrame) -> DataFrame:
    """How many slices a nested result has, and how many rows they hold."""
    held = F.map_values("q")
    rows = F.aggregate(held, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(*GROUP, "start", "end", F.size(held).cast("long").alias("slices"), rows.alias("slice_rows"))


@registered("""SELECT layout, iteration, species, count(*) AS particles, min(pos) AS first_pos, max(pos) AS last_pos, min(x) AS minx, max(y) AS maxy FROM p, (SELECT unnest(['group', 'file', 'variable']) AS layout) GROUP BY ALL""")
def dump_layouts(spark, sf_dir):
    """The dump written in each of the three layouts and read back."""
    particles, root, out = dump(spark, sf_dir), new_path(spark, "layouts"), None
    write_dump(particles, f"{root}/group")
    particles.write.parquet(f"{root}/variable")
    for (iteration,) in particles.select("iteration").distinct().collect():  # a folder for each
        particles.where(F.col("iteration") == iteration).drop("iteration").write.parquet(f"{root}/file/dump_{iteration:06d}.parquet")
    for layout in ("group", "file", "variable"):
        made = read_dump(spark, f"{root}/{layout}", layout).groupBy(F.lit(layout).alias("layout"), *GROUP).agg(
            F.count(F.lit(1)).alias("particles"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("x").alias("minx"), F.max("y").alias("maxy")
        )
        out = made if out is None else out.unionByName(made)
    return out


@registered(
    """
WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), c AS (SELECT vec_id AS i, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)
SELECT CAST(least(i // 30, greatest(n // 30, 1) - 1) AS BIGINT) AS block_i, CAST(least(j // 10, 64 // 10 - 1) AS BIGINT) AS block_j, min(i) AS first_i, CAST(min(j) AS INTEGER) AS first_j, count(*) AS "count", CAST(min(v) AS DOUBLE) AS "min", CAST(max(v) AS DOUBLE) AS "max"
FROM c, n GROUP BY 1, 2""",
    with_particles=False,
)
def rechunk_nd(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = vectors.agg(F.max("vec_id")).first()[0] + 1
    cells = vectors.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return relayout.rechunk(cells, ["i", "j"], [n, 64], [30, 10]).groupBy("block_i", "block_j").agg(
        F.min("i").alias("first_i"), F.min("j").alias("first_j"), F.count(F.lit(1)).alias("count"), F.min("v").cast("double").alias("min"), F.max("v").cast("double").alias("max")
    )


@registered("SELECT iteration, species, record, axis, count(*) AS nodes FROM l1 GROUP BY ALL")
def index_directory_rows(spark, sf_dir):
    return index_directory(build.minmax_blocks(dump(spark, sf_dir), BLOCK))


@registered(
    """WITH e AS (SELECT event_id // 100 AS block_id, min(ts) AS first_ts, max(ts) AS last_ts, min(value) AS "min", max(value) AS "max", count(*) AS n FROM events GROUP BY 1),
hit AS (SELECT block_id FROM e WHERE first_ts <= (SELECT min(ts) + INTERVAL 2 DAY FROM events) AND last_ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND "min" <= 50 AND "max" >= 10)
SELECT event_id, user_id, event_type, value FROM events
WHERE event_id // 100 IN (SELECT block_id FROM hit) AND ts BETWEEN (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND (SELECT min(ts) + INTERVAL 2 DAY FROM events) AND value BETWEEN 10 AND 50""",
    with_particles=False,
)
def events_time_range(spark, sf_dir):
    """Events as particles: a time and value box, blocks first, then exact rows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("block_id", F.floor(F.col("event_id") / 100).cast("long"))
    begin = events.agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("a"), (F.min("ts") + F.expr("INTERVAL 2 DAY")).alias("b")).first()
    blocks = events.groupBy("block_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min("value").alias("v0"), F.max("value").alias("v1"))
    hit = blocks.where((F.col("t0") <= begin["b"]) & (F.col("t1") >= begin["a"]) & (F.col("v0") <= 50) & (F.col("v1") >= 10)).select("block_id")
    rows = events.join(hit, "block_id", "left_semi")
    return rows.where(F.col("ts").between(begin["a"], begin["b"]) & F.col("value").between(10, 50)).select("event_id", "user_id", "event_type", "value")


#: A block table of the shrunk dump, in SQL, and slices of SLICE rows within its blocks.
LISTED = SHRUNK.rstrip() + f"""
, lb AS (SELECT iteration, species, block_id, min(pos) AS "start", max(pos) + 1 AS "end", min(y) AS lo, max(y) AS hi FROM shrunk GROUP BY ALL),
ls AS (SELECT s.iteration, s.species, s.block_id, min(pos) AS slice_start, max(pos) + 1 AS slice_end, min(y) AS lo, max(y) AS hi
  FROM shrunk s JOIN lb USING (iteration, species, block_id) GROUP BY s.iteration, s.species, s.block_id, (pos - lb."start") // {SLICE // 5})
"""


@registered(LISTED + f"""
SELECT b.iteration, b.species, b."start", b."end", s.slice_start, s.slice_end FROM lb b
LEFT JOIN (SELECT * FROM ls WHERE lo <= {RANGE[1]} AND hi >= {RANGE[0]}) s USING (iteration, species, block_id) WHERE b.lo <= {RANGE[1]} AND b.hi >= {RANGE[0]}""")
def listed_slices(spark, sf_dir):
    """Blocks of many lengths, given by a block table, and their slices."""
    rows = _shrunk(spark, sf_dir)
    table = stored(block_catalogue(rows), "block-table")
    rows = rows.drop("block_id")
    return query.range_slices(build.minmax_blocks(rows, table, ["position"]), build.minmax_slices(rows, table, SLICE // 5, ["position"]), "position", "y", RANGE)


@registered(LISTED + """
SELECT DISTINCT s.iteration, s.species, b."start", b."end", s.id FROM shrunk s JOIN lb b USING (iteration, species, block_id)
WHERE s.id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def listed_trace(spark, sf_dir):
    """Ids traced through filters of blocks of many lengths."""
    rows, ids = _shrunk(spark, sf_dir), _urgent(spark, sf_dir)
    table = stored(block_catalogue(rows), "block-table")
    return query.trace(rows, ids, candidates=_candidates(rows.drop("block_id"), ids, table))


@registered(LISTED + f"""
, hit AS (SELECT iteration, species, "start", "end" FROM lb WHERE lo <= {RANGE[1]} AND hi >= {RANGE[0]})
SELECT 'box' AS kind, iteration, species, "start", "end", CAST(NULL AS BIGINT) AS ids FROM hit WHERE iteration = {STORED[0]} AND species = '{STORED[1]}'
UNION ALL
SELECT 'trace', s.iteration, s.species, b."start", b."end", count(DISTINCT s.id) FROM shrunk s JOIN lb b USING (iteration, species, block_id)
WHERE s.iteration = {STORED[0]} AND s.species = '{STORED[1]}' AND s.id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY ALL""")
def listed_stored_index(spark, sf_dir):
    """A stored tree with filters over blocks of many lengths, asked for a box and for ids."""
    rows, ids = _shrunk(spark, sf_dir), _urgent(spark, sf_dir)
    write_index(rows, path := new_path(spark, "index"), "rtree", None, bits_per_key=BITS, records=["position"])
    index = RTreeQuery(spark, path)
    box = index.query_xyz(*STORED, "position", miny=RANGE[0], maxy=RANGE[1]).select(F.lit("box").alias("kind"), *GROUP, "start", "end", F.lit(None).cast("long").alias("ids"))
    hits = index.trace(rows, *STORED, ids).select(F.lit("trace").alias("kind"), *GROUP, "start", "end", F.size("id_data").cast("long").alias("ids"))
    return box.unionByName(hits)


@registered(LISTED + """
, numbered AS (SELECT *, row_number() OVER (PARTITION BY iteration, species ORDER BY "start") - 1 AS k FROM lb)
SELECT iteration, species, CAST(k // 5 AS BIGINT) AS block_id, min("start") AS "start", CAST(sum("end" - "start") AS BIGINT) AS "count", min(lo) AS miny, max(hi) AS maxy FROM numbered GROUP BY iteration, species, k // 5""")
def listed_extend(spark, sf_dir):
    """Runs of five blocks of many lengths merged."""
    merged = relayout.extend(_shrunk(spark, sf_dir), None, 5)
    return merged.groupBy(*GROUP, "block_id").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("count"), F.min("y").alias("miny"), F.max("y").alias("maxy"))


@registered("SELECT iteration, species, pos, id, x, y, z FROM p WHERE x BETWEEN 10 AND 12 AND y BETWEEN 9000 AND 11000")
def get_particle_scattered(spark, sf_dir):
    """Hits scattered over the whole of a dump in small folders, of which only those with a hit are read."""
    particles = dump(spark, sf_dir, 10 * BLOCK)
    select = {("position", "x"): (10.0, 12.0), ("position", "y"): (9000.0, 11000.0)}
    slices = build.minmax_slices(particles, BLOCK, 5, ["position"])
    return query.get_particle(particles, build.minmax_blocks(particles, BLOCK, ["position"]), select, COLUMNS, BLOCK, slices=slices, slice_rows=5)


def _null_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump with species A and iteration 1996 unknown: offsets run through the groups that this makes."""
    rows = lineitem_particles(spark, sf_dir).withColumns({"species": F.expr("nullif(species, 'A')"), "iteration": F.expr("nullif(iteration, 1996)")})
    write_dump(placed_particles(rows), path := new_path(spark, "null-groups"), bucket_for(rows.count(), 1000), ranged=True)
    return read_dump(spark, path)


#: The same particles in SQL.
NULL_PARTICLES = PARTICLES.replace("CAST(year(l_shipdate) AS INTEGER) AS iteration, l_returnflag AS species", "nullif(CAST(year(l_shipdate) AS INTEGER), 1996) AS iteration, nullif(l_returnflag, 'A') AS species").replace(
    "PARTITION BY year(l_shipdate), l_returnflag ORDER", "PARTITION BY nullif(CAST(year(l_shipdate) AS INTEGER), 1996), nullif(l_returnflag, 'A') ORDER"
)
_SAME = "s.iteration IS NOT DISTINCT FROM h.iteration AND s.species IS NOT DISTINCT FROM h.species"


@registered(NULL_PARTICLES + "SELECT iteration, species, pos, id, x, y, z FROM p WHERE x BETWEEN 49 AND 50 AND y BETWEEN 950 AND 3000 AND z BETWEEN 0.01 AND 0.02", False)
def null_groups_get_particle(spark, sf_dir):
    particles = _null_groups(spark, sf_dir)
    return query.get_particle(particles, build.minmax_blocks(particles, BLOCK, ["position"]), POSITION, COLUMNS, BLOCK)


@registered(NULL_PARTICLES + """
SELECT h.iteration, h.species, h."start", h."end", s."start" AS slice_start, s."end" AS slice_end
FROM (SELECT * FROM l1 WHERE record = 'position' AND axis = 'y' AND "min" <= 1500 AND "max" >= 1400) h
LEFT JOIN (SELECT * FROM l2 WHERE record = 'position' AND axis = 'y' AND "min" <= 1500 AND "max" >= 1400) s ON """ + _SAME + """ AND s.block_start = h."start" """, False)
def null_groups_slices(spark, sf_dir):
    particles = stored(_null_groups(spark, sf_dir), "null-groups")
    return query.range_slices(build.minmax_blocks(particles, BLOCK, ["position"]), build.minmax_slices(particles, BLOCK, SLICE, ["position"]), "position", "y", RANGE)


@registered(NULL_PARTICLES + f"""SELECT iteration, species, "start", "end" FROM e1 WHERE record = 'position' AND {IN_BOX}""", False)
def null_groups_tree(spark, sf_dir):
    return query.tree_box(build.pack_tree(build.leaf_envelopes(_null_groups(spark, sf_dir), BLOCK, ["position"])), "position", BOX)


@registered(NULL_PARTICLES + """SELECT DISTINCT h.iteration, h.species, s."start", s."end", h.id FROM b h
JOIN (SELECT iteration, species, block_id, min(pos) AS "start", max(pos) + 1 AS "end" FROM b GROUP BY ALL) s ON """ + _SAME + """ AND s.block_id = h.block_id
WHERE h.id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""", False)
def null_groups_trace(spark, sf_dir):
    particles, ids = _null_groups(spark, sf_dir), _urgent(spark, sf_dir)
    return query.trace(particles, ids, candidates=_candidates(particles, ids, BLOCK))


@registered(NULL_PARTICLES + SHRUNK.replace("JOIN ext USING (iteration, species, block_id)", "JOIN ext ON ext.iteration IS NOT DISTINCT FROM b.iteration AND ext.species IS NOT DISTINCT FROM b.species AND ext.block_id = b.block_id").replace(
    "SELECT b.*,", "SELECT b.iteration, b.species, b.block_id, b.pos, b.id, b.x, b.y, b.z,") + "SELECT iteration, species, pos, block_id, id, x, y, z FROM shrunk", False)
def null_groups_shrink(spark, sf_dir):
    return relayout.shrink_rows(_null_groups(spark, sf_dir), BLOCK, 3).select(*GROUP, "pos", "block_id", "id", "x", "y", "z")


@registered("""
WITH c AS (SELECT vec_id AS i, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)
SELECT i, CAST(j AS BIGINT) AS j, v AS "value" FROM c WHERE i >= 25 AND i < 95 AND j >= 8 AND j < 41""", with_particles=False)
def rechunked_box(spark, sf_dir):
    """Vectors rewritten as dense chunks, of which a box over chunk borders is read back."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = vectors.agg(F.max("vec_id")).first()[0] + 1
    cells = vectors.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return relayout.read_box(stored(relayout.dense_chunks(cells, ["i", "j"], [n, 64], [30, 10], "v"), "chunks"), ["i", "j"], [(25, 95), (8, 41)])


@registered("SELECT iteration, species, count(DISTINCT id) AS ids, true AS near FROM p GROUP BY ALL")
def sketched_ids(spark, sf_dir):
    """Distinct ids of each tree's root from mergeable sketches, against the exact number."""
    particles = dump(spark, sf_dir)
    tree = build.pack_tree(build.leaf_envelopes(particles, BLOCK, ["position"]))
    found = build.sketch_ids_per_node(particles, tree, BLOCK)
    roots = matched(found, found.groupBy(*GROUP).agg(F.max("level").alias("top")), GROUP).where("level = top").withColumnRenamed("ids", "about")
    exact = particles.groupBy(*GROUP).agg(F.countDistinct("id").alias("ids"))
    return matched(exact, roots.select(*GROUP, "about"), GROUP).select(*GROUP, "ids", (F.abs(F.col("about") - F.col("ids")) <= 0.06 * F.col("ids") + 2).alias("near"))


@registered("""
SELECT iteration, species, min(pos) AS "start", max(pos) + 1 AS "end", record, axis, min(v) AS "min", max(v) AS "max" FROM long GROUP BY iteration, species, pos // 1000, record, axis""")
def footer_minmax(spark, sf_dir):
    """Extrema of a dump's folders, which are its blocks, from Parquet footers."""
    write_dump(dump(spark, sf_dir), path := new_path(spark, "folders"), 10 * BLOCK, ranged=True)  # a dump's files are ranges of offsets
    return folder_minmax(spark, path)


@registered("""
WITH a AS (
  SELECT 'part_' || CAST(p_partkey AS VARCHAR) || '_name' AS name, 'string' AS type, CAST(1 AS BIGINT) AS elements, '"' || p_name || '"' AS value FROM part
  UNION ALL SELECT 'part_' || CAST(p_partkey AS VARCHAR) || '_size', 'uint32', 1, CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT 'part_' || CAST(p_partkey AS VARCHAR) || '_pair', 'double', 2, '{ ' || CAST(-p_size AS VARCHAR) || ', ' || CAST(p_size AS VARCHAR) || 'e1 }' FROM part
)
SELECT name, type, elements, CASE WHEN type = 'string' THEN trim(value, '"') END AS text,
  CASE WHEN type = 'uint32' THEN CAST(value AS DOUBLE) WHEN type = 'double' THEN CAST(trim(split_part(trim(value, '{} '), ',', 1)) AS DOUBLE) END AS first_number,
  CASE WHEN type = 'double' THEN CAST(trim(split_part(trim(value, '{} '), ',', 2)) AS DOUBLE) END AS second_number FROM a""", with_particles=False)
def copied_attributes(spark, sf_dir):
    """Attributes of three types made from `part`, written, copied to another dump, read back and parsed."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size").cast("string")
    values = [("name", "string", 1, F.concat(F.lit('"'), "p_name", F.lit('"'))), ("size", "uint32", 1, size), ("pair", "double", 2, F.concat(F.lit("{ "), (-F.col("p_size")).cast("string"), F.lit(", "), size, F.lit("e1 }")))]
    rows = F.array(*(F.struct(F.concat(F.lit("part_"), F.col("p_partkey").cast("string"), F.lit(f"_{n}")).alias("name"), F.lit(t).alias("type"), F.lit(k).cast("long").alias("elements"), v.alias("value")) for n, t, k, v in values))
    write_attributes(part.select(F.inline(rows)), first := new_path(spark, "attributes"))
    write_attributes(read_attributes(spark, first), second := new_path(spark, "attributes"))
    parsed = parse_attributes(read_attributes(spark, second))
    return parsed.select("name", "type", "elements", "text", F.get("numbers", F.lit(0)).alias("first_number"), F.get("numbers", F.lit(1)).alias("second_number"))


@registered("""
, leaves AS (SELECT iteration, species, record, count(*) AS n, min("start") AS "start", max("end") AS "end", min(minx) AS minx, max(maxz) AS maxz FROM e1 GROUP BY ALL)
SELECT iteration, species, record, CAST(l AS INTEGER) AS level, CAST(ceil(n / pow(10, l)) AS BIGINT) AS nodes, "start", "end", minx, maxz, true AS enclosed
FROM leaves, range(0, 12) t(l) WHERE l = 0 OR n > pow(10, l - 1)""")
def tree_levels(spark, sf_dir):
    """Levels of the packed tree: how many nodes each has, what they span, and whether each node encloses its children."""
    tree = build.pack_tree(build.leaf_envelopes(dump(spark, sf_dir), BLOCK))
    key = [*GROUP, "record"]
    parents = tree.select(*key, F.col("level").alias("above"), F.col("node").alias("parent"), *(F.col(c).alias(f"_{c}") for c in (*build.ENVELOPE, "start", "end")))
    inside = [F.col(c) >= F.col(f"_{c}") if c.startswith(("min", "start")) else F.col(c) <= F.col(f"_{c}") for c in (*build.ENVELOPE, "start", "end")]
    held = matched(tree.withColumn("above", F.col("level") + 1), parents, [*key, "above", "parent"], "left")
    inside_all = F.coalesce(F.expr("true") & inside[0] & inside[1] & inside[2] & inside[3] & inside[4] & inside[5] & inside[6] & inside[7], F.lit(True))  # a root has no parent
    return held.withColumn("inside", inside_all).groupBy(*key, "level").agg(
        F.count(F.lit(1)).alias("nodes"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("minx").alias("minx"), F.max("maxz").alias("maxz"), F.bool_and("inside").alias("enclosed")
    )


@registered("SELECT iteration, species, count(DISTINCT id) AS ids, CAST(0 AS BIGINT) AS missed FROM p GROUP BY ALL")
def merged_filters(spark, sf_dir):
    """Filters of blocks united to one for each dump: none of its ids is missed."""
    particles = dump(spark, sf_dir)
    merged = bloom.merge(build.block_filters(particles, BLOCK, BITS), GROUP)
    ids = particles.select(*GROUP, "id").distinct().withColumn("segment", bloom.segment_of(F.col("id"), bloom.segments_for(BLOCK, BITS)))
    probes = bloom.probes(F.col("id"), bloom.hash_count(BITS), bloom.bits_for(BLOCK, BITS))
    asked = matched(ids, merged, [*GROUP, "segment"], "left").withColumn("found", F.coalesce(bloom.may_contain(F.col("bitmap"), probes), F.lit(False)))
    return asked.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("ids"), F.sum((~F.col("found")).cast("long")).alias("missed"))


@registered("SELECT iteration, species, pos, x, y, uz FROM p")
def zipped_axes(spark, sf_dir):
    """Columns stored apart, as one table again."""
    particles, columns = dump(spark, sf_dir), {}
    for axis in ("x", "y", "uz"):
        columns[axis] = stored(particles.select(*GROUP, "pos", F.col(axis).alias("value")), f"axis-{axis}")
    return zip_axes(**columns)


@registered("""
SELECT DISTINCT '/data/' || CAST(iteration AS VARCHAR) || '/particles/' || species || '/' || record || '/' || axis AS path, iteration, species, record, axis FROM l1 WHERE iteration <> 1997""")
def variable_paths(spark, sf_dir):
    """The parts of variables' paths, made from the index's keys, and an exact choice among them."""
    keys = build.minmax_blocks(dump(spark, sf_dir), BLOCK).select(*GROUP, "record", "axis").distinct()
    paths = keys.select(F.concat_ws("/", F.lit("/data"), F.col("iteration").cast("string"), F.lit("particles"), "species", "record", "axis").alias("path"))
    return paths.select("path", *(c.alias(n) for n, c in variable_path(F.col("path")).items())).where("iteration <> 1997")


@registered("""
SELECT iteration, species, "start", CAST(k AS INTEGER) AS part, minx + k * ((maxx - minx) * CAST(1.1 AS DOUBLE) / 3) AS low, minx + (k + 1) * ((maxx - minx) * CAST(1.1 AS DOUBLE) / 3) AS high
FROM e1, range(0, 3) t(k) WHERE record = 'position'""")
def cut_blocks(spark, sf_dir):
    """Each block's extent along x in three parts."""
    leaves = build.leaf_envelopes(dump(spark, sf_dir), BLOCK, ["position"])
    return leaves.select(*GROUP, "start", F.posexplode(cut_block(F.col("minx"), F.col("maxx"), 3)).alias("part", "cut")).select(*GROUP, "start", "part", "cut.low", "cut.high")


@registered("""
WITH c AS (SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)
SELECT i, CAST(j AS BIGINT) AS j, CAST(i * 64 + j AS BIGINT) AS "offset", i AS back_i, CAST(j AS BIGINT) AS back_j FROM c""", with_particles=False)
def row_major_cells(spark, sf_dir):
    """Offsets of the vectors' cells, and the indices that they come from."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shape = [vectors.agg(F.max("vec_id")).first()[0] + 1, 64]
    cells = vectors.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"))
    placed = cells.withColumn("offset", row_major([F.col("i"), F.col("j")], shape))
    return placed.select("i", "j", "offset", *(c.alias(f"back_{n}") for c, n in zip(from_row_major(F.col("offset"), shape), "ij")))


@registered("""SELECT iteration, species, min(pos) AS "start", count(*) AS "count" FROM b GROUP BY iteration, species, block_id""")
def catalogue_csv(spark, sf_dir):
    """The block list, written as CSV and read back."""
    write_block_catalogue(dump(spark, sf_dir), path := new_path(spark, "catalogue"), BLOCK)
    return spark.read.csv(path, header=True, schema="iteration int, species string, start long, count long")


@registered("""
SELECT 'minmax' AS kind, iteration, species, "start", "end", record, axis, "min", "max" FROM l1
UNION ALL SELECT 'slices', iteration, species, "start", "end", record, axis, "min", "max" FROM l2""")
def maintained_index(spark, sf_dir):
    """Extrema that batches of rows, one of them twice, and a compaction come to."""
    particles = dump(spark, sf_dir)
    index = MaintainedIndex(spark, new_path(spark, "maintained"), BLOCK, slice_rows=SLICE)
    for n, part in enumerate((0, 1, 1, 2)):
        index.add(particles.where(F.col("id") % 3 == part), n)
        if n == 1:
            index.compact()
    columns = [*GROUP, "start", "end", "record", "axis", "min", "max"]
    return index.table("minmax").select(F.lit("minmax").alias("kind"), *columns).unionByName(index.table("slices").select(F.lit("slices").alias("kind"), *columns))
