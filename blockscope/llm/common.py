"""Helpers shared by the text operators: table loading, shared-folder tables, batch slicing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from blockscope.sources.shared import new_path  # noqa: F401
from blockscope.sources.shared import stored as materialize  # noqa: F401

#: Fixed value: the word pattern of the shingle, line and quality operators (split on ASCII white space).
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table of an earlier round, on whatever file system the shared folder is."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of consecutive rows holding about `limit` bytes, so that Python objects stay few. Null gives b''."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    begin, size, texts = 0, 0, []
    for row in range(len(col)):
        text = col[row].as_py() or b""
        texts.append(text)
        size += len(text)
        if size >= limit:
            yield begin, texts
            begin, size, texts = row + 1, 0, []
    if texts:
        yield begin, texts
