"""Re-layout of blocks: merge, split in space, re-chunk N-D variables. All columns of the rows are kept, and all rows, those of
a null iteration or species included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockscope.functions.predicates import cell, highest, lowest
from blockscope.sources.index_store import read_bucketed, write_bucketed
from blockscope.sources.particles import BUCKET_ROWS, FEW, GROUP, Layout, block_catalogue, group_key, matched, with_blocks, with_listed_blocks, with_positions, write_dump
from blockscope.sources.shared import new_path, stored, stored_and_counted


def merged_blocks(blocks: DataFrame, n: int) -> DataFrame:
    """The block table of n consecutive blocks each, whatever their lengths; the last of a group may be fewer."""
    numbered = with_positions(blocks.select(*GROUP, "start", "count"), ["start"])
    end = F.max(F.col("start") + F.col("count"))
    return numbered.groupBy(*GROUP, F.floor(F.col("pos") / n).cast("long").alias("block_id")).agg(F.min("start").alias("start"), (end - F.min("start")).alias("count"))


def extend(particles: DataFrame, layout: Layout, n: int) -> DataFrame:
    """Merge n consecutive blocks: rows keep their offsets and get block_id of the larger block. Blocks of equal length need
    no shuffle."""
    if isinstance(layout, int):
        return particles.withColumn("block_id", F.floor(F.col("pos") / (layout * n)).cast("long"))
    return with_listed_blocks(particles, merged_blocks(layout if layout is not None else block_catalogue(particles), n)).drop("block_start")


def _celled(blocked: DataFrame, n: int, block: list[str]) -> DataFrame:
    old, ends = Window.partitionBy(*block), {}
    for a in "xyz":
        ends |= {f"_low_{a}": lowest(F.col(a)).over(old), f"_high_{a}": highest(F.col(a)).over(old)}
    at = {a: cell(F.col(a), F.col(f"_low_{a}"), F.col(f"_high_{a}"), n) for a in "xyz"}
    number = (at["x"] * n + at["y"]) * n + at["z"]
    return blocked.withColumns(ends).withColumn("cell", F.coalesce(number, F.lit(0))).drop(*ends)


def shrink_cells(particles: DataFrame, layout: Layout, n: int) -> DataFrame:
    """The rows with block_id, block_start and their cell (i*n + j)*n + k among the n^3 cells of their block's envelope. A block's
    rows are brought together by one shuffle, which what is done block by block needs anyway."""
    return _celled(with_blocks(particles, layout), n, [*GROUP, "block_id"])


def shrink(particles: DataFrame, layout: Layout, n: int) -> DataFrame:
    """(iteration, species, block_id, cell, start, count): the new blocks in order, without empty ones.

    A block's offset is the old block's (the sum of whole blocks before it) plus the smaller cells' counts within it, so the
    running sum stays within one old block."""
    counts = shrink_cells(particles, layout, n).groupBy(*GROUP, "block_id", "block_start", "cell").agg(F.count(F.lit(1)).alias("count"))
    before = F.sum("count").over(Window.partitionBy(*GROUP, "block_id").orderBy("cell")) - F.col("count")
    return counts.withColumn("start", F.col("block_start") + before).select(*GROUP, "block_id", "cell", "start", "count")


def _first_numbers(blocks: DataFrame, amount: str) -> tuple[DataFrame, int]:
    """(_key, _number) of each run of blocks (_key, iteration, species, block_start, and an amount), with how many there are: the sum
    of the amounts of the runs before it in its iteration and species. As in `with_positions`, sums are taken within range partitions."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged, n = stored_and_counted(blocks.repartitionByRange(parts, *GROUP, "block_start").withColumn("_part", F.spark_partition_id()), "old-blocks")
    totals = ranged.groupBy("_part", *GROUP).agg(F.sum(amount).alias("_n"))
    before = stored(totals.withColumn("_before", F.sum("_n").over(Window.partitionBy(*GROUP).orderBy("_part")) - F.col("_n")).drop("_n"), "offsets")
    within = F.sum(amount).over(Window.partitionBy("_part", *GROUP).orderBy("block_start")) - F.col(amount)
    numbered = matched(ranged.withColumn("_within", within), before, ["_part", *GROUP])
    return numbered.select("_key", (F.col("_before") + F.col("_within")).alias("_number")), n


#: Offsets of a run of old blocks, which one task shrinks.
RUN = 1 << 16


def shrink_rows(particles: DataFrame, layout: Layout, n: int) -> DataFrame:
    """The rows as the smaller blocks hold them: pos is the new offset, block_id the new block's number from 0 in its
    iteration and species, and rows of one block keep their order. All other columns stay.

    Rows are shuffled once, by runs of old blocks, within which cells and ranks are taken. They are stored in buckets of these
    runs, so that the numbers of the new blocks before a run are joined without shuffling the rows again. A block's rows stay
    within its offsets, so that the result lies in ranges of offsets as a ranged dump does."""
    spark, path = particles.sparkSession, new_path(particles.sparkSession, "celled")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = with_blocks(particles, layout).withColumn("_key", group_key(F.floor(F.col("block_start") / RUN))).repartition(buckets, "_key")
    block = ["block_start", "block_id"]
    old, run = Window.partitionBy("_key", *block), Window.partitionBy("_key")
    placed = _celled(keyed, n, ["_key", *block]).withColumns({"_pos": F.col("block_start") + F.row_number().over(old.orderBy("cell", "pos")) - 1, "_nth": F.dense_rank().over(run.orderBy(*block, "cell")) - 1})
    names = [c for c in particles.columns if c not in ("pos", "block_id", "block_start")]
    placed = placed.select("_key", "block_start", *names, "_pos", "_nth")
    write_bucketed(placed, path, buckets)
    placed = read_bucketed(spark, path, buckets, placed.schema)
    blocks = placed.groupBy("_key").agg(*(F.first(c).alias(c) for c in GROUP), F.min("block_start").alias("block_start"), (F.max("_nth") + 1).cast("long").alias("_cells"))
    first, blocks_n = _first_numbers(stored(blocks, "runs"), "_cells")  # which are sampled, and so asked for twice
    first = first if blocks_n <= FEW else first.hint("shuffle_hash")
    joined = placed.join(first, "_key")
    return joined.select(*names, F.col("_pos").cast("long").alias("pos"), (F.col("_number") + F.col("_nth")).cast("long").alias("block_id"))


def write_relayout(particles: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS, ranged: bool = False) -> None:
    """Write rows as a dump: a block's rows lie together, since blocks are runs of offsets. Rows of `shrink_rows` are ranged."""
    write_dump(particles, path, bucket_rows, ranged)


def rechunk(cells: DataFrame, indices: list[str], shape: list[int], block_shape: list[int]) -> DataFrame:
    """The rows with their block along each dimension: a remainder belongs to the last block."""
    for index, n, b in zip(indices, shape, block_shape):
        cells = cells.withColumn(f"block_{index}", F.least(F.floor(F.col(index) / b), F.lit(max(n // b, 1) - 1)).cast("long"))
    return cells


def dense_chunks(cells: DataFrame, indices: list[str], shape: list[int], block_shape: list[int], value: str) -> DataFrame:
    """Chunks as data: (block_<index> ..., start, count, values) with the first index and the length along each dimension and
    the values in row-major order, the last index running fastest. Cells that are missing are null; a chunk is bounded by
    twice the block shape along each dimension."""
    chunked = rechunk(cells, indices, shape, block_shape)
    blocks = [f"block_{i}" for i in indices]
    start = [F.col(b) * size for b, size in zip(blocks, block_shape)]
    last = [max(n // size, 1) - 1 for n, size in zip(shape, block_shape)]
    count = [F.when(F.col(b) == end, F.lit(n) - s).otherwise(F.lit(size)) for b, end, n, s, size in zip(blocks, last, shape, start, block_shape)]
    offset = F.lit(0).cast("long")
    for i, s, c in zip(indices, start, count):
        offset = offset * c + (F.col(i) - s)
    held = chunked.select(*blocks, offset.alias("_at"), F.col(value).alias("_value")).groupBy(*blocks).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_value"))).alias("_cells"))
    size = F.lit(1).cast("long")
    for c in count:
        size = size * c
    values = F.transform(F.sequence(F.lit(0).cast("long"), size - 1), lambda k: F.try_element_at("_cells", k))
    return held.select(*blocks, F.array(*start).alias("start"), F.array(*(c.cast("long") for c in count)).alias("count"), values.alias("values"))


def read_box(chunks: DataFrame, indices: list[str], box: list[tuple[int, int]]) -> DataFrame:
    """(index ..., value) of the cells with low <= index < high along each dimension, from the chunks that meet the box."""
    met = F.lit(True)
    for k, (low, high) in enumerate(box):
        met = met & (F.col("start")[k] < high) & (F.col("start")[k] + F.col("count")[k] > low)
    rows = chunks.where(met).select("start", "count", F.posexplode("values").alias("_at", "value"))
    found, stride = {}, F.lit(1).cast("long")
    for k in range(len(indices) - 1, -1, -1):
        found[indices[k]] = (F.col("start")[k] + F.floor(F.col("_at") / stride) % F.col("count")[k]).cast("long")
        stride = stride * F.col("count")[k]
    out = rows.select(*(found[i].alias(i) for i in indices), "value")
    for i, (low, high) in zip(indices, box):
        out = out.where((F.col(i) >= low) & (F.col(i) < high))
    return out
