"""The n-gram model's storage: split frequent keys, large counts, missing files, rare hashes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockscope.llm import ngram

SF = "/root/testdata/sf0.001"


def _scores(docs, order):
    return {r["doc_id"]: r["score"] for r in ngram.held_out_scores(docs, order=order).collect()}


@pytest.mark.parametrize("order", [3, 4, 5])
def test_splitting_frequent_words_and_pairs_changes_nothing(spark, monkeypatch, order):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    docs = docs.unionByName(spark.range(9000, 9040).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('a', id, ' so b c '), 30)").alias("text"))).cache()
    whole = _scores(docs, order)
    monkeypatch.setattr(ngram, "SAMPLE", 1.0)
    monkeypatch.setattr(ngram, "EVEN", 0.002)
    layouts = ngram._frequent(docs, "text", list(range(order, 1, -2)), 4)
    assert all(len(x.middles.keys) > 20 for n, x in layouts.items() if n > 2) and (order % 2 == 0 or len(layouts[3].pairs.keys) > 5)
    assert all(len(x.middles.keys) <= 4 / 0.002 for x in layouts.values())
    split = _scores(docs, order)
    assert set(split) == set(whole) and all(split[i] == pytest.approx(whole[i]) for i in whole)


def test_a_missing_file_is_an_error(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = ngram.train(docs, folder=str(tmp_path / "m"), order=3)
    assert ngram.score(docs, model).count() == docs.count()
    for name in os.listdir(tmp_path / "m"):
        if name.startswith("w-"):
            os.rename(tmp_path / "m" / name, tmp_path / "m" / f"lost-{name}")
    ngram._tables.clear()
    with pytest.raises(Exception, match="w-"):
        spark.sparkContext.parallelize([0], 1).map(lambda _: ngram._tables.clear()).count()
        ngram.score(docs, model).count()


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_tables_hold_large_counts(tmp_path, monkeypatch, n):
    class Task:
        @staticmethod
        def get():
            return type("T", (), {"taskAttemptId": staticmethod(lambda: 1)})

    monkeypatch.setattr(ngram, "TaskContext", Task)
    rng = np.random.default_rng(n)
    key = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
    values = [rng.integers(0, 5, len(key)), np.where(rng.random(len(key)) < 0.3, rng.integers(1 << 33, 1 << 40, len(key)), 1)]
    for whole in (False, True):
        ngram._save(str(tmp_path), f"g-{whole}", key, *values, whole=whole)
        if n:
            found = ngram.TableFile(str(tmp_path / f"g-{whole}")).find(np.concatenate((key[::-1], rng.integers(0, 1 << 63, 50, np.uint64) * np.uint64(2) + np.uint64(1 << 20))))
            assert (found[: len(key)] == np.stack(values, axis=1)[::-1]).all() and not found[len(key) :].any()


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")
    got = ngram.held_out_scores(docs, order=3).collect()
    assert all(r["n_tokens"] == 1 and r["score"] <= 0 for r in got) and len(got) == 3
    assert ngram.held_out_scores(docs.where("false"), order=3).count() == 0


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").coalesce(1)
    whole = _scores(docs, 3)
    monkeypatch.setattr(ngram, "CHUNK", 1000)
    counts = ngram._count_grams(ngram.Layout(3, 4), "text")  # as tasks run it, with the smaller chunk
    import pyarrow as pa

    texts = [r["text"] for r in docs.where(~ngram.in_held_out(F.col("doc_id"))).collect()]
    rows = [row for batch in counts(iter([pa.RecordBatch.from_pydict({"text": texts})])) for row in zip(*(c.to_pylist() for c in batch.columns))]
    small = sum(int(ngram.unpack_grams(b, 3)[1][0].sum()) for _, _, b in rows)
    monkeypatch.setattr(ngram, "CHUNK", 1 << 20)
    rows = [row for batch in ngram._count_grams(ngram.Layout(3, 4), "text")(iter([pa.RecordBatch.from_pydict({"text": texts})])) for row in zip(*(c.to_pylist() for c in batch.columns))]
    merged = lambda blobs: dict(zip(*(x.tolist() for x in (lambda k, g, n: (k, n[0]))(*ngram._merged(blobs, 3)))))
    assert small == sum(int(ngram.unpack_grams(b, 3)[1][0].sum()) for _, _, b in rows) and len(whole)
    assert sum(merged([b for _, _, b in rows]).values()) == small
