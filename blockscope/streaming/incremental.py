"""Incremental index maintenance: an extension, which batch results define.

Extrema, envelopes and Bloom bitmaps merge, so each micro-batch is indexed by itself and stored under its number; a reader
merges what is stored. Merging takes each part any number of times, so that a batch that is repeated, or stored beside a
compacted table that holds it already, changes nothing. A batch's rows are aggregated once, by the finest kind, from which the
coarser ones are made. Extrema are stored with a row for each block or slice; axes are unpivoted only when a table is read.

path/<kind>/base=<n> holds what batches up to n came to, path/<kind>/batch=<n> a batch of its own. `compact` writes a new base
from the last one and the batches since, and only then deletes what it holds; a base counts once its _SUCCESS is there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockscope.functions import bloom
from blockscope.operators.build import block_filters, by_axis, by_record, wide_blocks, wide_slices
from blockscope.sources.particles import AXES, GROUP

def _side(c: str):
    return F.min if c == "start" or c.startswith("min") or c.endswith("_min") else F.max


def _merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """Rows of whole blocks or slices from rows of their parts."""
    return parts.groupBy(*GROUP, *by).agg(*(_side(c)(c).alias(c) for c in parts.columns if c not in (*GROUP, *by)))


def _number(rows: DataFrame, slice_rows: int) -> DataFrame:
    return rows.withColumn("slice", F.floor((F.col("start") - F.col("block_start")) / slice_rows))


@dataclass(frozen=True)
class Kind:
    """How a kind of index is kept: `index` makes a batch's part, of its rows or of its part of the kind named by `source`;
    `merge` makes one of many; `shape` turns what is merged into the index."""

    index: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    shape: Callable[[DataFrame], DataFrame] = lambda whole: whole
    source: str | None = None


def _kinds(block_rows: int, slice_rows: int | None, bits_per_key: float | None) -> dict[str, Kind]:
    """The kinds of index, each after its source."""
    records, out = list(AXES), {}
    block, slice_ = [*GROUP, "start", "end"], [*GROUP, "block_start", "start", "end"]
    if slice_rows:
        out["slices"] = Kind(lambda rows: wide_slices(rows, block_rows, slice_rows), lambda parts: _merge(parts, ["block_start", "slice_id"]), lambda whole: by_axis(whole, slice_, records))
        out["slice_envelopes"] = Kind(lambda slices: by_record(slices, slice_, records), lambda parts: _merge(_number(parts, slice_rows), ["block_start", "slice", "record"]).drop("slice"), source="slices")
        of_slices = lambda slices: _merge(slices.drop("slice_id").withColumn("start", F.col("block_start")).drop("block_start"), ["start"])
    blocks = (of_slices, "slices") if slice_rows else (lambda rows: wide_blocks(rows, block_rows), None)
    out["minmax"] = Kind(blocks[0], lambda parts: _merge(parts, ["start"]), lambda whole: by_axis(whole, block, records), blocks[1])
    out["envelopes"] = Kind(lambda wide: by_record(wide, block, records), lambda parts: _merge(parts, ["start", "record"]), source="minmax")
    if bits_per_key:
        out["filters"] = Kind(lambda rows: block_filters(rows.where("id is not null"), block_rows, bits_per_key), lambda parts: bloom.merge(parts, [*GROUP, "block_id"]))
    return out


class MaintainedIndex:
    """All kinds of indexes of a growing table of particles: extrema and envelopes of blocks and slices, and Bloom filters of
    blocks. Rows of a block may come in any number of batches."""

    def __init__(self, spark: SparkSession, path: str, block_rows: int, slice_rows: int | None = None, bits_per_key: float | None = None):
        self.spark, self.path = spark, path
        self.kinds = _kinds(block_rows, slice_rows, bits_per_key)

    def add(self, batch: DataFrame, n: int) -> None:
        """Index a batch; a batch that is repeated replaces its own folder."""
        again = sum(k.source is None for k in self.kinds.values()) > 1
        if again:
            batch.persist()
        parts = {}
        for name, kind in self.kinds.items():
            part, path = kind.index(parts[kind.source] if kind.source else batch), f"{self.path}/{name}/batch={n}"
            part.write.mode("overwrite").parquet(path)
            parts[name] = self.spark.read.schema(part.schema).parquet(path)
        if again:
            batch.unpersist()

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _fs(self, kind: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _stored(self, kind: str) -> tuple[list[int], list[int]]:
        """The numbers of the bases and of the batches that are whole."""
        folder, fs = self._fs(kind)
        found = {"base": [], "batch": []}
        if fs.exists(folder):
            for status in fs.listStatus(folder):
                name = re.fullmatch(r"(base|batch)=(\d+)", status.getPath().getName())
                if name and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    found[name[1]].append(int(name[2]))
        return sorted(found["base"]), sorted(found["batch"])

    def table(self, kind: str) -> DataFrame:
        """The index as a batch build over all rows so far gives it."""
        return self.kinds[kind].shape(self._whole(kind))

    def _whole(self, kind: str) -> DataFrame:
        bases, batches = self._stored(kind)
        since = bases[-1] if bases else -1
        paths = [f"{self.path}/{kind}/base={n}" for n in bases[-1:]] + [f"{self.path}/{kind}/batch={n}" for n in batches if n > since]
        if not paths:
            raise ValueError(f"nothing is stored under {self.path}/{kind}")
        parts = [self.spark.read.parquet(p) for p in paths]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return self.kinds[kind].merge(whole)

    def compact(self) -> None:
        """Merge the batches so far into a new base for each kind."""
        for kind in self.kinds:
            bases, batches = self._stored(kind)
            if not batches or bases and batches[-1] <= bases[-1]:
                continue
            self._whole(kind).write.mode("overwrite").parquet(f"{self.path}/{kind}/base={batches[-1]}")
            folder, fs = self._fs(kind)
            for name in [f"base={n}" for n in bases] + [f"batch={n}" for n in batches]:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)
