"""The Merkle manifest against a plain Python version, and awkward tables."""

import hashlib
import zlib

from pyspark.sql import functions as F

from blockscope.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return H(*(field(row[c]) for c in merkle.COLUMNS))


def tampered(row):
    if row["doc_id"] is None or row["text"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 2:
        return leaf(row)
    return leaf({**row, "text": row["text"].replace("\n", "")})


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def fold(tree, at, digest):
    """The siblings on the way up and the digest that results."""
    siblings = []
    for level in tree[:-1]:
        begin = at - at % 3
        run = level[begin : begin + 3]
        siblings += run[: at % 3] + run[at % 3 + 1 :]
        digest = H(*run[: at % 3], digest, *run[at % 3 + 1 :])
        at //= 3
    return siblings, digest


def brute_force(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    order = sorted(groups, key=first)
    trees = {}
    for source in order:
        groups[source].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"], leaf(r)))
        trees[source] = levels([leaf(r) for r in groups[source]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        for at, row in enumerate(groups[source]):
            below, digest = fold(trees[source], at, tampered(row))
            above, digest = fold(top, k, digest)
            out.append((row["doc_id"], leaf(row), trees[source][-1][0], top[-1][0], H(*below, *above), digest, digest == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", b"y") for r in rows], f"{SCHEMA}, tree string, digest binary")
    manifest = merkle.build_manifest(docs, claimed=merkle.without_newlines)
    got = merkle.verify(manifest).collect()
    want = brute_force([dict(zip(merkle.COLUMNS, r)) for r in rows])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    merkle.drop_manifest(manifest)


def test_against_brute_force(spark):
    rows = [(k, f"s{k % 4}" if k % 4 else "s1", "en", k, f"a\n{k}") for k in range(70)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (5, None, "", 0, ""), (7, "s2", None, 1, "\n"), (7, "s2", None, 1, "\n"), (99, "é", "de", 3, "long " * 50000), (98, "", "x", 1, "-")]
    check(spark, rows)


def test_small_tables(spark):
    check(spark, [(1, "a", "en", 1, "x\n")])
    check(spark, [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "y\n")])
    check(spark, [(k, None, None, None, "t") for k in range(3)])


def test_empty_table(spark):
    manifest = merkle.build_manifest(spark.createDataFrame([], SCHEMA))
    assert manifest.root is None
    assert merkle.verify(manifest).count() == 0


def test_unchanged_rows_verify_and_string_ids(spark):
    docs = spark.range(40).select(F.concat(F.lit("id"), "id").alias("key"), (F.col("id") % 2).cast("string").alias("part"), F.col("id").cast("string").alias("body"))
    found = merkle.verify(merkle.build_manifest(docs, ["key", "body"], "key", "part"))
    assert found.where("verified").count() == 40 and found.select("proof_sha256").distinct().count() == 40
    assert found.schema["id"].dataType.simpleString() == "string"
    limit = "spark.sql.cteRecursionRowLimit"
    assert spark.conf.get(limit) != "-1"  # set back
