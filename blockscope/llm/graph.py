"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockscope.llm.common import delete_path, new_path


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b; not null): component is the smallest reachable node.

    Alternates large-star and small-star steps, each an aggregate and a join on one endpoint, until the edges are stars;
    the number of rounds grows with the logarithm of the longest path. Each round is a table in the shared folder, which
    the next one replaces; nothing but its size and checksum reaches the driver.
    """
    spark = edges.sparkSession
    schema = "hi long, lo long"

    def store(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = new_path(spark, "components")
        df.distinct().write.parquet(path)
        table = spark.read.schema(schema).parquet(path)
        mark = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        return table, path, tuple(mark)

    e, path, mark = store(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("hi"), F.least("a", "b").cast("long").alias("lo")))
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(least.select("hi", "m"))
        old, (e, path, new_mark) = path, store(small)
        delete_path(spark, old)
        if new_mark == mark:
            break
        mark = new_mark
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(e.select(F.col("lo"), F.col("lo")).distinct())
