"""Stored indexes: written by key, listed, looked up; and the query classes over them.

Tables are bucketed: blocks and slices by iteration, species and block, filters by parent node and segment. A block's slices, and
the filters that ids are asked of, are then joined without an exchange of the stored side. The files are plain Parquet; a
session that opens an index registers them in its catalog under a name of the build.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from blockscope.functions.bloom import FilterShape
from blockscope.operators import build, query
from blockscope.sources.particles import AXES, GROUP, Layout, block_catalogue, group_key, with_blocks

KINDS = ("minmax", "rtree")
#: What each bucketed table is bucketed by.
KEYS = {"blocks": lambda capacity: group_key("start"), "slices": lambda capacity: group_key("block_start"), "filters": query.filter_key}


def write_bucketed(df: DataFrame, path: str, buckets: int) -> None:
    """Add rows (with `_key`) to a bucketed table at a path: a file for each bucket, sorted."""
    name = f"writing_{uuid.uuid4().hex}"
    df.repartition(buckets, "_key").write.format("parquet").bucketBy(buckets, "_key").sortBy("_key").option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # of the catalog; the files stay


def read_bucketed(spark: SparkSession, path: str, buckets: int, schema: StructType | None = None) -> DataFrame:
    """The table at a path, registered under a name that the path gives. A table without rows has no files that tell its schema."""
    build, table = path.rsplit("/", 2)[1:]
    name = f"{build}_{table}".replace("-", "_")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema or spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY (_key) SORTED BY (_key) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_index(particles: DataFrame, path: str, kind: str, layout: Layout, slice_rows: int | None = None, bits_per_key: float | None = None, capacity: int = 10, records: list[str] | None = None, buckets: int | None = None) -> None:
    """Build an index of a kind (with slices where slice_rows is given, with Bloom filters where bits_per_key is) and replace
    what is stored at the path: blocks/, slices/, tree/, filters/ and the parameters. The blocks are those of the layout. Each build writes to a folder of its own;
    `parameters`, written last, names it, so that readers see one whole index or the other. Only then the old one goes."""
    if kind not in KINDS:
        raise ValueError(f"unknown index kind {kind!r}; there are {KINDS}")
    if bits_per_key and kind != "rtree":
        raise ValueError("Bloom filters belong to the nodes of a tree")
    spark, root, path = particles.sparkSession, path, f"{path}/build-{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    save = lambda df, name: write_bucketed(df.withColumn("_key", KEYS[name](capacity)), f"{path}/{name}", buckets)
    leaf_rows = None
    if kind == "minmax":
        save(build.minmax_blocks(particles, layout, records), "blocks")
        if slice_rows:
            save(build.minmax_slices(particles, layout, slice_rows, records), "slices")
    else:
        save(build.leaf_envelopes(particles, layout, records), "blocks")
        build.pack_tree(spark.read.parquet(f"{path}/blocks").drop("_key"), capacity).write.partitionBy("record").parquet(f"{path}/tree")
        if slice_rows:
            save(build.slice_envelopes(particles, layout, slice_rows, records), "slices")
    if bits_per_key:
        tree = spark.read.parquet(f"{path}/tree")
        found = None
        for record in records or list(AXES):
            shape = build.filter_shape(particles, layout, bits_per_key, capacity, record)
            leaf_rows = shape.leaf_rows
            made = build.node_filters(particles, tree, layout, shape, record)
            found = made if found is None else found.unionByName(made)
        save(found, "filters")
    row = (kind, slice_rows, float(bits_per_key) if bits_per_key else None, leaf_rows, capacity, buckets, "parent", path.rsplit("/", 1)[1])
    names = "kind string, slice_rows long, bits_per_key double, leaf_rows long, capacity long, buckets long, filters_by string, build string"
    spark.createDataFrame([row], names).coalesce(1).write.mode("overwrite").parquet(f"{root}/parameters")
    _drop_other_builds(spark, root, row[-1])


def _drop_other_builds(spark: SparkSession, root: str, keep: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(folder):
        if found.getPath().getName().startswith("build-") and found.getPath().getName() != keep:
            files.delete(found.getPath(), True)


def write_block_catalogue(particles: DataFrame, path: str, layout: Layout) -> None:
    """The block list as CSV (iteration, start, count), one row for each block."""
    blocks = block_catalogue(with_blocks(particles, layout))
    blocks.select("iteration", "species", "start", "count").write.mode("overwrite").csv(path, header=True)


def index_directory(index: DataFrame) -> DataFrame:
    """The keys of an index and how many nodes each has."""
    keys = [c for c in (*GROUP, "record", "axis") if c in index.columns]
    return index.groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"))


class _Stored:
    kind = ""

    def __init__(self, spark: SparkSession, path: str, secondary: bool = False):
        self.spark, self.secondary = spark, secondary
        self.parameters = spark.read.parquet(f"{path}/parameters").first()
        self.path = f"{path}/{self.parameters['build']}"
        if self.parameters["kind"] != self.kind:
            raise ValueError(f"{path} holds a {self.parameters['kind']} index")
        if secondary and self.parameters["slice_rows"] is None:
            raise ValueError(f"{path} has no slices")

    def table(self, name: str, iteration: int | None = None, species: str | None = None) -> DataFrame:
        path = f"{self.path}/{name}"
        out = read_bucketed(self.spark, path, self.parameters["buckets"]) if name in KEYS else self.spark.read.parquet(path)
        out = out if iteration is None else out.where(F.col("iteration") == iteration)
        return out if species is None else out.where(F.col("species") == species)

    def directory(self) -> DataFrame:
        return index_directory(self.table("blocks"))


class MinMaxQuery(_Stored):
    """Range queries over a stored min-max index. Keys that are not there give no rows."""

    kind = "minmax"

    def query_minmax(self, iteration: int, species: str, record: str, axis: str, min: float = -math.inf, max: float = math.inf) -> DataFrame:
        """(iteration, species, start, end, q): q maps slice starts to slices; without a secondary index it is empty."""
        blocks = self.table("blocks", iteration, species)
        if self.secondary:
            return query.nested(query.range_slices(blocks, self.table("slices", iteration, species), record, axis, (min, max)))
        empty = F.lit(None).cast("long")
        return query.nested(query.range_blocks(blocks, record, axis, (min, max)).withColumns({"slice_start": empty, "slice_end": empty}))


class RTreeQuery(_Stored):
    """Box and id queries over a stored envelope index."""

    kind = "rtree"

    def query_xyz(self, iteration: int, species: str, record: str, minx: float = -math.inf, maxx: float = math.inf, miny: float = -math.inf, maxy: float = math.inf, minz: float = -math.inf, maxz: float = math.inf) -> DataFrame:
        box = {"x": (minx, maxx), "y": (miny, maxy), "z": (minz, maxz)}
        blocks = self.table("blocks", iteration, species)
        if self.secondary:
            return query.nested(query.box_slices(blocks, self.table("slices", iteration, species), record, box))
        empty = F.lit(None).cast("long")
        return query.nested(query.tree_box(self.table("tree", iteration, species), record, box).withColumns({"slice_start": empty, "slice_end": empty}))

    def metadata(self, iteration: int, species: str, record: str) -> DataFrame:
        """All leaf envelopes."""
        return self.table("blocks", iteration, species).where(F.col("record") == record)

    def metadata_root(self, iteration: int, species: str, record: str) -> DataFrame:
        return query.dataset_bounds(self.metadata(iteration, species, record))

    def trace(self, particles: DataFrame, iteration: int, species: str, ids: list[int] | DataFrame) -> DataFrame:
        """(iteration, species, start, end, id_data): the blocks that have the ids, verified on the rows."""
        return query.trace_result(self._hits(particles, iteration, species, ids))

    def trace_intersected(self, particles: DataFrame, iteration: int, species: str, ids: list[int] | DataFrame) -> DataFrame:
        """As trace, for ids that both the position and the momentum tree lead to."""
        return query.trace_result(self._hits(particles, iteration, species, ids, tuple(AXES)))

    def _hits(self, particles: DataFrame, iteration: int, species: str, ids: list[int] | DataFrame, records: tuple[str, ...] = ()) -> DataFrame:
        if self.parameters["bits_per_key"] is None:
            raise ValueError(f"{self.path} has no Bloom filters")
        if "filters_by" not in self.parameters:
            raise ValueError(f"{self.path} has filters bucketed by node: build the index anew")
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ids], "id long")
        particles = particles.where((F.col("iteration") == iteration) & (F.col("species") == species))
        tree, filters = self.table("tree", iteration, species), self.table("filters", iteration, species)
        held = [r[0] for r in filters.select("record").distinct().collect()]
        missing = set(records).difference(held)
        if missing and held:
            raise ValueError(f"{self.path} has no filters of {sorted(missing)}")
        p = self.parameters
        shapes = {r: FilterShape(p["leaf_rows"], p["capacity"], p["bits_per_key"], build.SEEDS[r]) for r in AXES}
        found = reduce(query.intersect_traces, (query.trace_candidates(tree, filters, ids, shapes[r], r) for r in records or held[:1] or ["position"]))
        return query.trace(particles, ids, candidates=found)
