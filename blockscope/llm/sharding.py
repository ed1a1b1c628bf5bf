"""Sharding by the minimax contiguous partition of ordered groups.

Groups (equal texts) are atomic and stand in the order of their text's digest. The smallest capacity is searched for
which a greedy walk - each shard takes groups while they fit - needs no more than the wanted number of shards, and the
shards are cut there; so the largest shard is as small as any contiguous partition allows.

Sizes stay distributed. Rows are range-partitioned by (digest, id), so that one text with a large part of all rows
spreads over many tasks, and get running totals from per-partition totals. A step of the greedy walk is an aggregate
over the groups' running totals, and takes WAYS capacities at once, which cuts the search to a few rounds. Only totals
(one row for each partition, one for each step) reach the driver.

A null text counts as an empty one. Repeated rows each take a slot; ties in (digest, id) are equal rows. An empty table
gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockscope.llm.common import materialize

WAYS = 128


def _walk(groups: DataFrame, capacities: list[int], shards: int, total: int) -> list[list[int]]:
    """For each capacity (ascending), where the greedy walk ends its shards (the last position is the total if all fit)."""
    at, cuts = [0] * len(capacities), [[] for _ in capacities]
    for _ in range(shards):
        reach = [p + c for p, c in zip(at, capacities)]
        edges = sorted(set(reach))
        beyond = F.size(F.filter(F.lit(edges).cast("array<bigint>"), lambda edge: edge < F.col("upto")))  # edges that the group's end has passed
        ends = dict(groups.where((F.col("upto") > min(at)) & (F.col("upto") <= edges[-1])).groupBy(beyond.alias("edge")).agg(F.max("upto")).collect())  # a row for each edge at most
        at = [max([p, *(e for k, e in ends.items() if edges[k] <= r)]) for p, r in zip(at, reach)]
        for k, p in enumerate(at):
            cuts[k].append(p)
        if all(p == total for p in at):
            break
    return cuts


def smallest_capacity(groups: DataFrame, shards: int, total: int, largest: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity over groups (upto: running total, in order) and the cuts of its greedy walk."""
    low = max(-(-total // shards), largest)
    high = max(low, -(-total // shards) + largest)  # always feasible: every shard but the last is filled beyond the mean
    best: tuple[int, list[int]] | None = None
    while best is None or low < high:
        tries = sorted({low + (high - low) * k // WAYS for k in range(WAYS)} | ({high} if best is None else set()))
        found = [(c, cuts) for c, cuts in zip(tries, _walk(groups, tries, shards, total)) if cuts[-1] == total]
        if found:
            best = found[0]
            high = best[0]
        low = max([low, *(c + 1 for c in tries if c < high)])
    return best


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, group_digest) for each row, under the law `bytes`."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(parts, "digest", id_col).sortWithinPartitions("digest", id_col).withColumn("part", F.spark_partition_id()), "shard-rows")

    totals = sorted(placed.groupBy("part").agg(F.sum("size"), F.count(F.lit(1))).collect())  # a row for each partition
    before, n_bytes, n_rows = [], 0, 0
    for part, size, count in totals:
        before.append((part, n_bytes, n_rows))
        n_bytes, n_rows = n_bytes + size, n_rows + count
    offsets = F.broadcast(spark.createDataFrame(before, "part int, bytes_before long, rows_before long"))
    order = Window.partitionBy("part").orderBy("digest", id_col)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = materialize(
        placed.withColumns({"nth": F.row_number().over(order), "upto": F.sum("size").over(running)})
        .join(offsets, "part")
        .select(id_col, "size", "text_crc32", "digest", (F.col("rows_before") + F.col("nth") - 1).alias("row"), (F.col("bytes_before") + F.col("upto")).alias("upto")),
        "shard-numbered",
    )

    cuts, firsts = [], [0]
    if n_rows:
        groups = materialize(numbered.groupBy("digest").agg(F.max("upto").alias("upto"), F.sum("size").alias("size")).repartitionByRange("upto"), "shard-groups")
        cuts = smallest_capacity(groups, shards, n_bytes, groups.agg(F.max("size")).first()[0])[1][: shards - 1]
        firsts += list(numbered.agg(*(F.count_if(F.col("upto") <= c).alias(f"n{k}") for k, c in enumerate(cuts))).first())
    shard = sum((F.when(F.col("upto") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    first = F.element_at(F.array(*(F.lit(int(n)) for n in firsts)), F.col("shard") + 1)
    return numbered.withColumn("shard", shard.cast("int")).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.hex("digest").alias("group_digest")
    )
