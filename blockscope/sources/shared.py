"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; a temporary folder for local sessions without it. On a cluster it must be set,
    because a folder of the driver's own isn't the executors'."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Tables and folders that applications of this process have made.
_made: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def is_stored(spark: SparkSession, path: str) -> bool:
    return path in _made.get(spark.sparkContext.applicationId, [])


def drop_stored(spark: SparkSession) -> int:
    """Delete all that this application has stored, and say how many folders there were. Results that are still to be read go
    with it: call it after the last of them."""
    found = _made.pop(spark.sparkContext.applicationId, [])
    for path in found:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(found)


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write the rows as a table and read them back, which cuts the lineage."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_and_counted(df: DataFrame, name: str, amount: Column | None = None) -> tuple[DataFrame, int]:
    """As stored, with the number of rows (or another sum), which the job that writes them counts."""
    path, seen = new_path(df.sparkSession, name), Observation()
    df.observe(seen, (F.count(F.lit(1)) if amount is None else F.sum(amount)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"] or 0
