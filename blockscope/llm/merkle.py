"""Merkle manifest of a dataset: built level by level, verified by a recursive query that climbs from each leaf.

A leaf is the digest of a row's columns. Each group (source) has a tree over its leaves in id order, where runs of FAN
consecutive nodes become one; the groups' top nodes, in group order, are the leaves of one more tree, whose top is the
root. A node is named by (tree, level, at): its tree is the group's number, or TOP for the tree of groups. The stored node
rows link each node to its parent and hold the digests of its run's other members, left and right of it. A recursive query
then takes all leaves up at once: each step joins the nodes reached so far with their rows, appends the siblings and folds
the digest. Every leaf climbs, so that the work is the number of rows times the height of the trees.

Rows are placed by a distributed ranking, so that no task holds a group; a run is FAN rows. Only the counts of nodes and the
root reach the driver. Digests travel as 32 bytes. Null ids and null groups are values that come first; repeated rows are
leaves of their own, and rows with the same group and id go by their digests; a null column differs from an empty one. An
empty table has no leaves, no root and no result rows. Columns that are not named are not read, whatever their names.
Very long texts are hashed where they are read and not carried further.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.llm.common import delete_path, materialize, new_path
from blockscope.sources.particles import with_positions

#: Members of a run, and the tree of the groups' top nodes.
FAN, TOP = 3, -1
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def row_digest(columns: list[str] | dict[str, Column]) -> Column:
    """SHA-256 (32 bytes) over the columns in order: `-` for null, else the UTF-8 byte count, a colon and the value."""
    values = [c.cast("string") for c in (columns.values() if isinstance(columns, dict) else map(F.col, columns))]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _digest_of(*digests: Column) -> Column:
    """SHA-256 over digests as lower-case hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*digests))), 256))


@dataclass
class Manifest:
    """Where the tree is stored: `leaves` (tree, at, id, leaf, claimed, before, after, and the parent's name), `nodes` (name,
    before, after, the parent's name), `tops` (tree, subroot), and the root in hex; None for an empty table."""

    spark: SparkSession
    path: str
    root: str | None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _runs(nodes: DataFrame) -> DataFrame:
    """Runs of the nodes (tree, at, n, digest, ...) of a level: (tree, run, n, digest, members), n being the level's size."""
    fields = [c for c in nodes.columns if c not in ("tree", "n")]
    runs = nodes.groupBy("tree", F.floor(F.col("at") / FAN).cast("long").alias("run")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(*fields))).alias("members"))
    joined = F.aggregate("members", F.lit(b""), lambda got, m: F.concat(got, m["digest"]))
    return runs.withColumn("digest", _digest_of(joined))


def _linked(runs: DataFrame, level: int) -> DataFrame:
    """A row for each member: its name, the digests left and right of it in its run, and its parent's name."""
    digests = lambda part: F.aggregate(part, F.lit(b""), lambda got, m: F.concat(got, m["digest"]))
    rows = runs.select("tree", "run", "n", "members", F.posexplode("members").alias("k", "member"))
    ends = (F.col("n") <= FAN) & (F.col("tree") != TOP)  # the run is the whole level: its parent is a leaf of the top tree
    return rows.select(
        "tree", F.lit(level).alias("level"), "member.*",
        digests(F.slice("members", 1, F.col("k"))).alias("before"), digests(F.slice("members", F.col("k") + 2, FAN)).alias("after"),
        F.when(ends, TOP).otherwise(F.col("tree")).cast("long").alias("up_tree"), F.when(ends, 0).otherwise(level + 1).alias("up_level"), F.when(ends, F.col("tree")).otherwise(F.col("run")).alias("up_at"),
    )


NAME, UP = ["tree", "level", "at"], ["up_tree", "up_level", "up_at"]


def build_manifest(docs: DataFrame, columns: list[str] | None = None, id_col: str = "doc_id", group_col: str = "source", claimed: Callable[[DataFrame], Column] | None = None) -> Manifest:
    """Build and store the trees over `docs`. `claimed` gives, from the rows, the digest that each row is later verified with,
    such as that of a copy which may have been changed; without it, a row's own digest."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "manifest")
    own = row_digest(columns or COLUMNS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), own.alias("digest"), (claimed(docs) if claimed else own).alias("claimed"))
    rows = materialize(rows, "leaf-digests")
    placed = with_positions(rows, ["id", "digest"], ["group"])
    groups = materialize(with_positions(placed.groupBy("group").agg(F.count(F.lit(1)).alias("n")), ["group"], []).withColumnRenamed("pos", "tree"), "groups")
    named = placed.alias("l").join(groups.alias("r"), F.col("l.group").eqNullSafe(F.col("r.group")))
    nodes = named.select(F.col("r.tree").alias("tree"), F.col("l.pos").alias("at"), "r.n", "l.digest", "l.id", "l.claimed")
    many, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()

    alone = nodes.where("n = 1").select("tree", F.lit(0).alias("level"), *(c for c in nodes.columns if c not in ("tree", "n")), F.lit(None).cast("binary").alias("before"), F.lit(None).cast("binary").alias("after"),
                                        F.lit(TOP).cast("long").alias("up_tree"), F.lit(0).alias("up_level"), F.col("tree").alias("up_at"))
    runs = materialize(_runs(nodes.where("n > 1")), "runs")
    _linked(runs, 0).unionByName(alone).write.parquet(f"{path}/leaves")
    leaves, schema = spark.read.parquet(f"{path}/leaves"), "tree long, digest binary"
    leaves.where("before is null").select("tree", "digest").write.parquet(f"{path}/tops")

    def climb(runs: DataFrame, level: int, most: int) -> None:
        """Store the levels above runs, and the top digests."""
        while most > 1:
            level, most = level + 1, -(-most // FAN)
            runs.where(F.col("n") <= FAN).select("tree", "digest").write.mode("append").parquet(f"{path}/tops")
            above = runs.where(F.col("n") > FAN).select("tree", F.col("run").alias("at"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), "digest")
            if most > 1:
                runs = materialize(_runs(above), "runs")
                _linked(runs, level).select(*NAME, "before", "after", *UP).write.mode("append").parquet(f"{path}/nodes")

    climb(runs, 0, most or 0)
    tops = spark.read.schema(schema).parquet(f"{path}/tops").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(many).cast("long").alias("n"), "digest")
    runs = materialize(_runs(tops.where("n > 1")), "runs")
    _linked(runs, 0).select(*NAME, "before", "after", *UP).write.mode("append").parquet(f"{path}/nodes")
    climb(runs, 0, many)
    tops = spark.read.schema(schema).parquet(f"{path}/tops")
    root = tops.where(F.col("tree") == TOP).first() if many > 1 else tops.first()
    return Manifest(spark, path, root["digest"].hex() if root else None)


CLIMB = """
WITH RECURSIVE climb(tree, at, id, leaf, step, up_tree, up_level, up_at, folded, siblings) AS (
  SELECT tree, at, id, digest, 0, up_tree, up_level, up_at,
    CASE WHEN before IS NULL THEN claimed ELSE unhex(sha2(lower(hex(concat(before, claimed, after))), 256)) END, concat(before, after)
  FROM {leaves}
  UNION ALL
  SELECT c.tree, c.at, CAST(NULL AS {id_type}), CAST(NULL AS BINARY), c.step + 1, n.up_tree, n.up_level, n.up_at,
    unhex(sha2(lower(hex(concat(n.before, c.folded, n.after))), 256)), concat(n.before, n.after)
  FROM climb c JOIN {nodes} n ON n.tree = c.up_tree AND n.level = c.up_level AND n.at = c.up_at
)
SELECT tree, at, max(id) AS id, max(leaf) AS leaf, max_by(folded, step) AS folded, array_sort(collect_list(struct(step, siblings))) AS path FROM climb GROUP BY tree, at
"""


def verify(manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row, digests in lower-case hex: the recursive
    query folds the claimed digest with the siblings on the way to the root; proof_sha256 is the digest of these siblings."""
    spark, name = manifest.spark, uuid.uuid4().hex
    leaves, nodes = manifest.table("leaves"), manifest.table("nodes")
    leaves.createOrReplaceTempView(f"leaves_{name}")
    nodes.createOrReplaceTempView(f"nodes_{name}")
    limit = "spark.sql.cteRecursionRowLimit"  # by default a recursive query of over a million rows is refused
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        found = spark.sql(CLIMB.format(leaves=f"leaves_{name}", nodes=f"nodes_{name}", id_type=leaves.schema["id"].dataType.simpleString()))
        siblings = F.array_join(F.transform("path", lambda p: F.lower(F.hex(p["siblings"]))), "")
        found = materialize(found.select("tree", "id", "leaf", "folded", F.unhex(F.sha2(siblings, 256)).alias("proof")), "climbed")
    finally:
        spark.conf.set(limit, before)
        spark.catalog.dropTempView(f"leaves_{name}")
        spark.catalog.dropTempView(f"nodes_{name}")
    hexed = lambda c: F.lower(F.hex(c))
    tops = manifest.table("tops").where(F.col("tree") != TOP).select("tree", F.col("digest").alias("subroot"))
    root = F.lit(manifest.root).cast("string")
    return found.join(tops, "tree").select("id", hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), root.alias("root"), hexed("proof").alias("proof_sha256"),
                                           hexed("folded").alias("folded_root"), (hexed("folded") == root).alias("verified"))


def drop_manifest(manifest: Manifest) -> None:
    delete_path(manifest.spark, manifest.path)


def without_newlines(docs: DataFrame) -> Column:
    """The claimed digests of a copy in which texts of rows with an even crc32 of the id have lost their line feeds."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return row_digest({c: changed if c == "text" else F.col(c) for c in COLUMNS})
