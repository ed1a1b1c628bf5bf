"""Particle tables: positions in a dump, blocks and slices, and the layouts that dumps come in.

A particle row is (iteration, species, pos, id, x, y, z, ux, uy, uz): pos is its offset in the dump of its iteration and
species. Blocks are runs of offsets, slices runs of `slice_rows` within a block; the last of each may be short.

Functions that take a `layout` find blocks in one of three ways: a number of rows for blocks of equal length, a block table
(iteration, species, block_id, start, count) for blocks of any lengths, or None for rows that carry their block_id.

A null iteration or species is a group like any other: groups are matched null-safely everywhere, so that no row of them is
lost. Empty tables give empty results.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockscope.sources.shared import is_stored, new_path, stored, stored_and_counted

GROUP = ["iteration", "species"]
AXES = {"position": {"x": "x", "y": "y", "z": "z"}, "momentum": {"x": "ux", "y": "uy", "z": "uz"}}


def with_positions(rows: DataFrame, order: list[str], group: list[str] = GROUP) -> DataFrame:
    """Add pos: the row's rank from 0 within its group, by `order` (which should tell rows apart).

    No task sees a whole group: rows are sorted over range partitions, and a row's rank is its place in its partition
    plus the sizes of the group's earlier partitions. Those sizes, a row for each partition and group that meet, are a
    table, which Spark broadcasts if it is small.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part"), *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")  # over one row for each partition
    offsets = stored(sizes.select("_part", *group, (before - F.col("_first")).alias("_shift")), "offsets")
    same = placed.withColumn("_part", part).alias("l").join(offsets.alias("r"), (F.col("l._part") == F.col("r._part")) & same_keys(group))
    return same.select(*(F.col(f"l.{c}") for c in rows.columns), (F.col("l._at") + F.col("r._shift")).alias("pos"))


def same_keys(columns: list[str]) -> Column:
    """The columns of the sides aliased l and r are equal, or both null."""
    return reduce(lambda out, c: out & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), columns, F.lit(True))


def group_key(*parts: str | Column) -> Column:
    """Iteration, species (nulls told apart from all values) and further numbers as one string: what bucketed tables are
    bucketed and joined by, since a single key that is never null needs no exchange."""
    named = [F.coalesce(F.col("iteration").cast("string"), F.lit("~")), F.coalesce(F.concat(F.lit("="), "species"), F.lit("~"))]
    return F.concat_ws("/", *named, *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))


#: Rows of a side of a join that may be broadcast.
FEW = 100_000


def if_few(side: DataFrame, rows: int) -> DataFrame:
    """A side of a join whose rows were counted: broadcast if they are few, and else neither side is. Spark goes by the size of
    the files, which for sorted keys and short bitmaps is a small part of what the rows take in the driver's memory."""
    return F.broadcast(side) if rows <= FEW else side.hint("merge")


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", *conditions: Column) -> DataFrame:
    """Join on columns that may be null, a null being equal to a null; further conditions name the sides l and r. The left
    side's columns, and the right side's that the left one lacks."""
    joined = left.alias("l").join(right.alias("r"), reduce(lambda x, y: x & y, conditions, same_keys(on)), how)
    extra = [] if how in ("left_semi", "left_anti") else [F.col(f"r.{c}") for c in right.columns if c not in left.columns]
    return joined.select(*(F.col(f"l.{c}") for c in left.columns), *extra)


def lineitem_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The particle view of `lineitem`, without offsets: years are iterations, return flags are species."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(
        F.year("l_shipdate").cast("int").alias("iteration"), F.col("l_returnflag").alias("species"), F.col("l_orderkey").alias("id"),
        F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_discount") + 0.0).alias("z"),
        (F.col("l_tax") + 0.0).alias("ux"), F.col("l_partkey").cast("double").alias("uy"), F.col("l_suppkey").cast("double").alias("uz"),
        *EXTRA,
    )


#: Columns that only tell rows apart, and the order of a dump.
EXTRA = ["l_linenumber", "l_partkey", "l_suppkey"]
ORDER = ["id", *EXTRA, "y", "x"]
#: Columns that are made anew from those of EXTRA once rows are placed, and so aren't sorted and stored along with them.
REMADE = {"uy": "l_partkey", "uz": "l_suppkey"}


def placed_particles(rows: DataFrame) -> DataFrame:
    """Rows of `lineitem_particles` with their offsets, and without EXTRA."""
    return with_positions(rows.drop(*REMADE), ORDER).withColumns({c: F.col(of).cast("double") for c, of in REMADE.items()}).drop(*EXTRA)


_dumps: dict[tuple[str, str, int], str] = {}


def dump(spark: SparkSession, sf_dir: str, bucket_rows: int | None = None) -> DataFrame:
    """The particles of `lineitem` as a stored dump, partitioned by iteration, species and bucket; made once in an application. Buckets
    are longer than asked for if there were over MOST_FOLDERS of them: a folder takes longer to write, list and scan than
    its thousand rows do."""
    key = (spark.sparkContext.applicationId, sf_dir, bucket_rows or BUCKET_ROWS)
    if key not in _dumps or not is_stored(spark, _dumps[key]):
        path, rows = new_path(spark, "particles"), lineitem_particles(spark, sf_dir)
        write_dump(placed_particles(rows), path, key[2] if bucket_rows is None else bucket_for(rows.count(), bucket_rows), ranged=True)
        _dumps[key] = path
    return read_dump(spark, _dumps[key])


SCHEMA = "iteration int, species string, pos long, id long, x double, y double, z double, ux double, uy double, uz double"
#: Offsets of a bucket: the rows of one are a folder, which is read or left out as a whole. At a few hundred bytes a row,
#: that is some hundred megabytes.
BUCKET_ROWS = 1 << 20
#: Folders beyond which buckets get longer, where their length isn't part of the result: the driver lists every folder.
MOST_FOLDERS = 1_000


def bucket_for(rows: int, least: int) -> int:
    """Offsets of a bucket for a dump of so many rows: `least`, or more if that made over MOST_FOLDERS whole buckets."""
    return max(least, -(-rows // MOST_FOLDERS))


#: Offsets of a bucket up to which tasks write its rows as a file of their own (`write_small_folders`).
SMALL = 1 << 14


def write_dump(particles: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS, ranged: bool = False) -> None:
    """Write rows by iteration, species and bucket of offsets, in offset order, so that folders and file statistics prune.

    The bucket's folder is named bucket_<rows>=<number>, so that a reader knows what it holds. Folder names can't tell an empty
    species from a null one: an empty one is an error. Rows that just got their offsets (`with_positions`) lie in ranges of them
    already (`ranged`) and aren't shuffled. Files are committed by the tasks, since there may be a folder for each block; in a local
    or mounted file system, small folders are written by `write_small_folders`."""
    parts = int(particles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.when(F.col("species") == "", F.raise_error(F.lit("a dump has no folder for an empty species"))).otherwise(F.col("species"))
    rows = particles.drop(*(c for c in particles.columns if re.fullmatch(r"bucket_\d+", c))).withColumns({"species": name, f"bucket_{bucket_rows}": F.floor(F.col("pos") / bucket_rows).cast("long")})
    rows = rows if ranged else rows.repartitionByRange(parts, *GROUP, "pos")
    rows = rows.sortWithinPartitions(*GROUP, "pos")
    folder = mounted(particles.sparkSession, path)
    if bucket_rows <= SMALL and folder and all(f.dataType.typeName() in PLAIN for f in rows.schema):
        return write_small_folders(rows, folder, [*GROUP, f"bucket_{bucket_rows}"])
    writer = rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy(*GROUP, f"bucket_{bucket_rows}").parquet(path)


#: Types of columns that `write_small_folders` writes, which Parquet's writers agree on.
PLAIN = ("integer", "long", "float", "double", "string", "boolean")
#: What a partition's folder name holds in place of null, and the letters that are escaped in it, as Spark writes them.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = frozenset(map(chr, (*range(1, 32), 127))) | frozenset("\"#%'*/:=?\\{[]^")


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path in the machine's own file system that a Hadoop path names, or None where it lies in another one."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(found).toUri().getPath() if files.getUri().getScheme() == "file" else None


def folder_name(column: str, value: object) -> str:
    """A partition's folder as Spark names it."""
    return f"{column}={NO_VALUE if value is None else ''.join(f'%{ord(c):02X}' if c in ESCAPED else c for c in str(value))}"


def write_small_folders(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write rows, sorted within their partitions, as `partitionBy` does, a file for each folder and task. Hadoop's local file system
    starts processes for each folder and file (and its checksum's) that it makes, which takes longer than a thousand rows do: here
    tasks write what Arrow hands them; their Python workers must be able to import this package, as for filters. A file's name is the task's, and it is put in place whole, so that a task that runs again
    replaces it."""
    if os.path.exists(path):
        raise FileExistsError(f"{path} already exists")
    os.makedirs(path)
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, held, at, files = TaskContext.get(), [], None, 0
        name = f"part-{context.partitionId():05d}-{token}.snappy.parquet"

        def flush() -> None:
            folder = os.path.join(path, *(folder_name(c, v) for c, v in zip(by, at)))
            os.makedirs(folder, exist_ok=True)
            made = os.path.join(folder, f".{context.taskAttemptId()}-{name}")
            pq.write_table(pa.Table.from_batches(held).drop_columns(by), made)
            os.replace(made, os.path.join(folder, name))

        for batch in batches:
            for begin, end in runs_of(table := pa.Table.from_batches([batch]), by):
                if at != (now := tuple(table.column(c)[begin].as_py() for c in by)):
                    if held:
                        flush()
                        files += 1
                    held, at = [], now
                held.append(batch.slice(begin, end - begin))
        if held:
            flush()
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    rows.mapInArrow(run, "files long").agg(F.sum("files")).collect()


def runs_of(table: pa.Table, by: list[str]) -> list[tuple[int, int]]:
    """Where columns stay the same in rows that are sorted by them."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for c in by:
        codes = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    begins = np.flatnonzero(change).tolist()
    return list(zip(begins, [*begins[1:], table.num_rows]))


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Within it, folders are listed by a few tasks for each core. Spark takes a task for each folder, up to 10,000 at a time, and
    starting one takes longer than listing a folder."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def read_dump(spark: SparkSession, path: str, layout: str = "group") -> DataFrame:
    """A dump in one of three layouts: `group` (a folder for each iteration), `file` (a file or folder for each, with the
    number at the end of its name) or `variable` (iteration is a stored column)."""
    if layout == "group":
        with few_listing_tasks(spark):
            return spark.read.schema(SCHEMA).parquet(path)
    if layout == "file":
        rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
        return rows.withColumn("iteration", F.regexp_extract(F.input_file_name(), r"_(\d+)(?:\.parquet|/)", 1).cast("int"))
    if layout == "variable":
        return spark.read.parquet(path)
    raise ValueError(f"unknown layout {layout!r}")


def buckets_of(particles: DataFrame) -> tuple[str, int] | None:
    """The name of a dump's bucket column and the offsets of a bucket, where it has one."""
    found = [(c, int(m[1])) for c in particles.columns if (m := re.fullmatch(r"bucket_(\d+)", c))]
    return found[0] if found else None


def in_buckets_of(particles: DataFrame, windows: DataFrame) -> DataFrame:
    """The rows in buckets that windows (iteration, species, start, end) meet: folders without a window aren't read, however
    many windows there are, because the join prunes partitions when it runs. The side that is broadcast has at most a row
    for each folder. Rows that have no buckets come back as they are."""
    bucket = buckets_of(particles)
    if bucket is None:
        return particles
    name, size = bucket
    met = F.explode(F.sequence(*(F.floor(c / size).cast("long") for c in (F.col("start"), F.col("end") - 1))))
    # the comparison is always true; partitions are pruned only by sides that have one
    folders = windows.where("end > start").select(*GROUP, met.alias("bucket")).where("bucket >= 0").distinct()
    same = F.col(f"l.{name}") == F.col("r.bucket")
    for c in GROUP:  # null-safe equality in a form that prunes partitions: no value stands for null, which a flag tells apart
        kind = particles.schema[c].dataType.simpleString()
        none = F.lit("" if kind == "string" else 0).cast(kind)
        same = same & (F.coalesce(f"l.{c}", none) == F.coalesce(f"r.{c}", none)) & (F.isnull(f"l.{c}") == F.isnull(f"r.{c}"))
    return particles.alias("l").join(F.broadcast(folders.alias("r")), same, "left_semi").select("l.*")


def variable_path(path: Column) -> dict[str, Column]:
    """The parts of a path /data/<iteration>/particles/<species>/<record>/<axis>, for exact selection."""
    part = lambda k: F.get(F.split(path, "/"), F.lit(k))
    return {"iteration": part(2).cast("int"), "species": part(4), "record": part(5), "axis": part(6)}


Layout = int | DataFrame | None


def with_blocks(particles: DataFrame, layout: Layout, slice_rows: int | None = None) -> DataFrame:
    """Add block_id and block_start (and slice_id within the block). Equal blocks need no shuffle; a block table is joined by
    segments of offsets, and rows outside all of its blocks go."""
    if layout is None:
        if "block_id" not in particles.columns:
            raise ValueError("without a layout, rows need a block_id")
        out = particles
        if "block_start" not in out.columns:
            out = matched(out, block_catalogue(particles).select(*GROUP, "block_id", F.col("start").alias("block_start")), [*GROUP, "block_id"])
    elif isinstance(layout, DataFrame):
        out = with_listed_blocks(particles, layout)
    else:
        block = F.floor(F.col("pos") / layout).cast("long")
        out = particles.withColumns({"block_id": block, "block_start": block * layout})
    return out if slice_rows is None else out.withColumn("slice_id", F.floor((F.col("pos") - F.col("block_start")) / slice_rows).cast("long"))


#: Offsets of one segment; windows of offsets meet rows by segment.
SEGMENT = 1_000


def _by_segment(windows: DataFrame, segment: int) -> DataFrame:
    first, last = (F.floor(c / segment).cast("long") for c in (F.col("start"), F.col("end") - 1))
    return windows.where("end > start").withColumn("_segment", F.explode(F.sequence(first, last)))


def in_windows(particles: DataFrame, windows: DataFrame, segment: int = SEGMENT, few: bool = False) -> DataFrame:
    """The rows whose offsets lie in one of the windows (iteration, species, start, end) of any lengths: a join on segments of
    offsets, which are best about as long as the windows. Windows that the caller has counted as few are broadcast."""
    held = particles.withColumn("_segment", F.floor(F.col("pos") / segment).cast("long"))
    asked = _by_segment(windows.select(*GROUP, "start", "end"), segment)
    inside = (F.col("l.pos") >= F.col("r.start")) & (F.col("l.pos") < F.col("r.end"))
    return matched(held, F.broadcast(asked) if few else asked, [*GROUP, "_segment"], "left_semi", inside).drop("_segment")


def with_listed_blocks(particles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add block_id and block_start from a block table (iteration, species, block_id, start, count) of blocks of any lengths
    that don't overlap. Rows outside all of them go. The blocks are stored and counted, since there may be a block for every few
    rows; segments are a few blocks long, since a row is compared with all blocks of its segment."""
    listed = blocks.select(*GROUP, "block_id", "start", (F.col("start") + F.col("count")).alias("end")).where("end > start")
    listed, n = stored_and_counted(listed, "listed")
    length = F.col("end") - F.col("start")
    segment = block_segment(*(v or 0 for v in listed.agg(F.avg(length), F.max(length)).first()))
    met = listed.agg(F.sum(F.floor((F.col("end") - 1) / segment) - F.floor(F.col("start") / segment) + 1)).first()[0] or 0 if n <= FEW else n
    held = particles.drop("block_id", "block_start").withColumn("_segment", F.floor(F.col("pos") / segment).cast("long"))
    listed = _by_segment(listed, segment).select(*GROUP, "_segment", "block_id", F.col("start").alias("block_start"), F.col("end").alias("_end"))
    inside = (F.col("l.pos") >= F.col("r.block_start")) & (F.col("l.pos") < F.col("r._end"))
    return matched(held, if_few(listed, met), [*GROUP, "_segment"], "inner", inside).drop("_segment", "_end")


def block_segment(mean: float, longest: int) -> int:
    """Offsets of a segment by which rows meet blocks: about four blocks of mean length, but the longest block has at most some 10,000
    segments, and a segment no more than SEGMENT offsets."""
    return min(SEGMENT, max(1, 4 * math.ceil(mean), math.ceil(longest / 10_000)))


def block_catalogue(blocked: DataFrame) -> DataFrame:
    """(iteration, species, block_id, start, count) of each block: one row each, whatever the records."""
    return blocked.groupBy(*GROUP, "block_id").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("count"))


def zip_axes(**columns: DataFrame) -> DataFrame:
    """Separately stored columns (iteration, species, pos, value) as one wide table: equal offsets belong together."""
    out = None
    for name, column in columns.items():
        column = column.select(*GROUP, "pos", F.col("value").alias(name))
        out = column if out is None else matched(out, column, [*GROUP, "pos"])
    return out


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, elements, value): attributes as text, with a typed view in `parse_attributes`."""
    return spark.read.schema("name string, type string, elements long, value string").parquet(path)


#: Attribute types that are written.
ATTRIBUTE_TYPES = ("uint32", "float", "double", "string", "uint64")


def write_attributes(attributes: DataFrame, path: str) -> None:
    """Copy attributes to another dump. Unknown types are an error, not a silent loss."""
    unknown = attributes.where(~F.col("type").isin(*ATTRIBUTE_TYPES)).select("type").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown attribute type {unknown[0][0]!r}")
    attributes.write.mode("overwrite").parquet(path)


def parse_attributes(attributes: DataFrame) -> DataFrame:
    """Add numbers (array<double>, signs kept) for numeric attributes and text (quotes stripped) for strings."""
    numeric = F.col("type") != "string"
    found = F.transform(F.regexp_extract_all("value", F.lit(r"(-?[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)"), F.lit(1)), lambda v: v.cast("double"))
    return attributes.withColumns({"numbers": F.when(numeric, found), "text": F.when(~numeric, F.trim(F.col("value"), F.lit('"')))})
