"""Block metadata from Parquet footers: offsets, counts and extrema of a dump's folders without reading a row.

Spark's Parquet source answers minimum, maximum and count by partition columns from the row groups' statistics, if its second
version reads the files. The blocks are the folders that `write_dump` makes, each with the offsets of one bucket.

Spark's writer leaves out the statistics of a column with NaN, and Arrow's (of small folders) those of a column of NaN alone, and
else ignores NaN: without statistics Spark can't answer, and the rows are read. An empty dump has
no folders and no blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.functions.predicates import highest, lowest
from blockscope.operators.build import by_axis
from blockscope.sources.particles import AXES, GROUP, buckets_of, read_dump
from blockscope.sources.shared import stored

PUSHED = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def footer_reads(spark: SparkSession) -> Iterator[None]:
    """Within it, Parquet is read by the source that answers aggregates from footers."""
    before = {k: spark.conf.get(k) for k in PUSHED}
    for k, v in PUSHED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _extrema(rows: DataFrame, records: list[str], low, high) -> DataFrame:
    name, _ = buckets_of(rows)
    made = [F.min("pos").alias("start"), F.max("pos").alias("last"), F.count("pos").alias("count")]
    for record in records:
        for axis, column in AXES[record].items():
            made += [low(column).alias(f"{record}_{axis}_min"), high(column).alias(f"{record}_{axis}_max")]
    return rows.groupBy(*GROUP, name).agg(*made)


def pushed_blocks(spark: SparkSession, path: str, records: list[str] | None = None) -> DataFrame:
    """The plan over footers; it has to run within `footer_reads`."""
    return _extrema(read_dump(spark, path), records or list(AXES), F.min, F.max)


def bucket_column(spark: SparkSession, path: str) -> str | None:
    """The name of a dump's bucket column, found in one folder of each depth: all of them are listed once, when footers are read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    while at is not None:
        name = re.fullmatch(r"(bucket_\d+)=.*", at.getName())
        if name:
            return name[1]
        found = files.listStatusIterator(at)
        at = None
        while at is None and found.hasNext():
            entry = found.next()
            at = entry.getPath() if entry.isDirectory() and not entry.getPath().getName().startswith(("_", ".")) else None
    return None


def folder_blocks(spark: SparkSession, path: str, records: list[str] | None = None) -> DataFrame:
    """(iteration, species, block_id, start, end, count, <record>_<axis>_min, _max ...) of each folder of a dump."""
    records = records or list(AXES)
    if bucket_column(spark, path) is None:
        raise ValueError(f"{path} is not a dump with buckets of offsets")
    try:
        with footer_reads(spark):
            found = stored(pushed_blocks(spark, path, records), "footers")
    except (Py4JJavaError, PySparkException) as error:
        if "No min/max found" not in str(error):
            raise
        found = _extrema(read_dump(spark, path), records, lambda c: lowest(F.col(c)), lambda c: highest(F.col(c)))
    extrema = [c for c in found.columns if c.endswith(("_min", "_max"))]
    zero: Column = F.lit(0.0)  # a footer's zeros are signed so that they bound both
    bucket = next(c for c in found.columns if c.startswith("bucket_"))
    return found.select(*GROUP, F.col(bucket).cast("long").alias("block_id"), "start", (F.col("last") + 1).alias("end"), "count", *((F.col(c) + zero).alias(c) for c in extrema))


def folder_minmax(spark: SparkSession, path: str, records: list[str] | None = None) -> DataFrame:
    """As build.minmax_blocks, for the folders of a dump."""
    records = records or list(AXES)
    return by_axis(folder_blocks(spark, path, records), [*GROUP, "start", "end"], records)
