"""Benchmark logs to tables: lines to runs, runs to means and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A number as streams print it, with an exponent where it is small or large.
NUMBER = r"((?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
#: Formats of log file names and lines.
NAME = r"index_build_(\w+?)_threads_(\d+)_blocks_(\d+)_(\d+)"
IO_LINE = f"Read Batch finished in {NUMBER} ?s"
BUILD_LINE = f"IO and CPU Finished in {NUMBER} ?s"
ELAPSED_LINE = f"Elapsed time: {NUMBER} ?s"


def build_runs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each log file index_build_<type>_threads_<n>_blocks_<b>_<run>.log: its I/O, build, CPU and elapsed seconds."""
    lines = spark.read.text(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.log$", 1))

    def seconds(pattern: str):
        return F.regexp_extract("value", pattern, 1).try_cast("double")

    found = lines.groupBy("file").agg(
        F.sum(seconds(IO_LINE)).alias("io_s"),
        F.max(seconds(BUILD_LINE)).alias("build_s"),
        F.max(seconds(ELAPSED_LINE)).alias("elapsed_s"),
    )
    return found.select(
        "file", F.regexp_extract("file", NAME, 1).alias("index_type"), *(F.regexp_extract("file", NAME, k).try_cast("int").alias(c) for k, c in ((2, "threads"), (3, "blocks"), (4, "run"))),
        "io_s", "build_s", (F.col("build_s") - F.col("io_s")).alias("cpu_s"), "elapsed_s",
    )


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, value): the lines of logs, which `split` and then `at` put in order within a file. A split is where in
    the file the part begins that one task read, so that a log of any length is many rows and many tasks."""
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(blocks, count, seconds) of a read log, whose lines alternate between what was read and how long it took. A line's
    follower is the next one of its split, or the first line of the file's next split that has one."""
    lines = ordered_lines(spark, path)
    here = Window.partitionBy("file", "split").orderBy("at")
    firsts = lines.groupBy("file", "split").agg(F.min(F.struct("at", "value"))["value"].alias("first"))
    firsts = firsts.withColumn("following", F.lead("first").over(Window.partitionBy("file").orderBy("split")))  # a row for each split
    paired = lines.withColumn("after", F.lead("value").over(here)).join(firsts, ["file", "split"]).withColumn("after", F.coalesce("after", "following"))
    number = lambda c, p: F.regexp_extract(c, p, 1).try_cast("double")
    return paired.select(
        number("value", r"[Bb]lock(?:s|Num)?\D*(\d+)").cast("long").alias("blocks"), number("value", r"[Cc]ount\D*(\d+)").cast("long").alias("count"), number("after", rf"(?:^|\s){NUMBER} ?s").alias("seconds")
    ).where("count is not null and seconds is not null")


def means(runs: DataFrame, index_type: str | None = None) -> DataFrame:
    """Mean elapsed seconds by blocks and threads of complete rows."""
    rows = runs.dropna() if index_type is None else runs.dropna().where(F.col("index_type") == index_type)
    return rows.groupBy("blocks", "threads").agg(F.avg("elapsed_s").alias("elapsed_s"))


def pivoted(mean: DataFrame, threads: list[int]) -> DataFrame:
    """Blocks by threads."""
    return mean.groupBy("blocks").pivot("threads", threads).agg(F.first("elapsed_s"))


def write_summary(runs: DataFrame, path: str) -> None:
    runs.orderBy("index_type", "threads", "blocks", "run").write.mode("overwrite").csv(path, header=True)


SUMMARY = "file string, index_type string, threads int, blocks int, run int, io_s double, build_s double, cpu_s double, elapsed_s double"


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The runs that write_summary wrote; columns go by their names."""
    return spark.read.csv(path, header=True, schema=SUMMARY, enforceSchema=False)
