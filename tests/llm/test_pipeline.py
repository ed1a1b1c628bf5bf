"""The pipeline's stages on given tables: what they keep, and what must be gone."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blockscope.llm.common import load, materialize

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = load(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs, docs := materialize(stage(spark, docs, SF), f"test-{name}")))
    return {name: (before, after) for name, before, after in out}


def test_columns_stay_until_the_last_stage(spark, stages):
    columns = load(spark, SF, "documents").columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "packing")


def test_quality_follows_the_verdicts(spark, stages):
    from blockscope.llm.queries import QUERIES

    before, after = stages["quality_rules"]
    kept = QUERIES["op4_quality_rules"](spark, SF).where("kept").select("doc_id")
    assert after.select("doc_id").exceptAll(kept).count() == 0 and kept.exceptAll(after.select("doc_id")).count() == 0


def test_line_dedup_only_cuts(spark, stages):
    from blockscope.llm.line_dedup import line_report

    before, after = stages["line_dedup"]
    report = line_report(before)
    assert after.count() == report.where("kept").count()
    assert after.join(report, "doc_id").where(F.md5("text") != F.col("text_md5")).count() == 0
    assert after.join(before.select("doc_id", F.col("text").alias("old")), "doc_id").join(report.where("n_removed = 0"), "doc_id").where("text <> old").count() == 0


def test_near_dedup_keeps_one_of_each_group(spark, stages):
    from test_text_operators import brute_components

    before, after = stages["near_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect())
    _, root = brute_components([t for _, t in rows], 5, 80)
    least = {}
    for (i, _), r in zip(rows, root):
        least.setdefault(r, i)
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(least.values())


def test_decontamination_leaves_no_window(spark, stages):
    from blockscope.llm.decontaminate import contamination

    before, after = stages["decontamination"]
    bench = load(spark, SF, "benchmark")
    assert contamination(after, bench).where("contaminated").count() == 0
    clean = contamination(before, bench).where("not contaminated").select("doc_id")
    assert clean.join(after, "doc_id", "left_anti").count() == 0
    assert clean.join(before, "doc_id").join(after.select("doc_id", F.col("text").alias("new")), "doc_id").where("text <> new").count() == 0


def test_packing_has_every_document(spark, stages):
    before, after = stages["packing"]
    assert after.select("doc_id").distinct().count() == before.count()
    assert after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).where("n <> d").count() == 0


def _tables(spark, folder, docs, labels, bench):
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long, kept string, cluster int, pos int"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"


def test_awkward_tables_go_through_the_chain(spark, tmp_path):
    import random

    rnd = random.Random(3)
    prose = lambda n, k: " ".join(f"word{rnd.randrange(3000)}x{k}" for _ in range(n))
    good, item, shared = [prose(120, k) for k in range(8)], prose(30, 99), prose(70, 98)
    rows = [
        (1, good[0]), (2, good[0]), (2, good[0]), (None, good[1]), (3, good[1] + " end"), (4, None), (5, ""), (6, " \n\t"), (7, "x " * 5000), (8, good[2] + " " + item), (8, good[3]),
        (9, good[4] + "\n" + shared), (10, good[5] + "\n" + shared), (11, prose(60_000, 97)), (None, None), (12, item),
    ]
    sf = _tables(spark, tmp_path / "a", [(i, t, None, "s", None, "clash", 1, 2) for i, t in rows], [(1, 1, 0), (7, 0, 0), (None, 1, None), (3, None, 0)], [(1, item), (None, "x"), (2, None)])
    docs, kept = load(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), f"awkward-{name}")
        kept[name] = docs.collect()
    texts = lambda name: sorted(((r["doc_id"], r["text"]) for r in kept[name]), key=str)
    assert sorted(texts("quality_rules"), key=str) == sorted([r for r in rows if r[1] and len(r[1].split()) >= 50 and not r[1].startswith("x ")], key=str)
    assert (10, good[5]) in texts("line_dedup") and (9, good[4] + "\n" + shared) in texts("line_dedup")
    assert [i for i, t in texts("near_dedup") if t == good[0]] == [1] and [i for i, t in texts("near_dedup") if t.startswith(good[1])] == [3]
    assert {(8, good[2] + " "), (8, good[3])} <= set(texts("decontamination"))
    packed = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert {r["doc_id"] for r in packed.collect()} == {1, 3, 8, 9, 10, 11}


def test_empty_tables_go_through_the_chain(spark, tmp_path):
    assert corpus_pipeline.run(spark, _tables(spark, tmp_path / "e", [], [], [])).count() == 0


def test_entry_registers_everything(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
