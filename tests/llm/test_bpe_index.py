"""Encoding by the pair index against the library, word by word merging, and awkward tables."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockscope.llm import bpe_index
from blockscope.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def digests(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_random_texts():
    rnd = random.Random(4)
    letters = "aabbccxyz'\u017f\u00df\u0130i\u0300\u00c9\u4e2d\uac01 \n\t \u00a0\U0001f600<|startoftext|>12 3.,;'re 's\x00\x1c"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * 5000, "ab" * 777, "<|endoftext|>" * 3, "I'Re'llx", "", " \n "]
    encoder, decoder = bpe_index.PairIndexEncoder(PATH), bpe_index.Decoder(PATH)
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert array("I", ids).tolist() == want
        assert decoder.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


def test_small_batches_and_caches_change_nothing(monkeypatch):
    texts = [b"the cat sat", b"The CAT's sats", b"abcabcabc " * 50, b"x" * 300]
    whole = bpe_index.PairIndexEncoder(PATH).encode(texts)
    monkeypatch.setattr(bpe_index, "BATCH", 4)
    monkeypatch.setattr(bpe_index, "CACHE", 2)
    small = bpe_index.PairIndexEncoder(PATH)
    assert small.encode(texts) == whole and small.encode(texts[::-1]) == whole[::-1]
    assert not [c for c in small.chunks if len(c) > bpe_index.LONG]


def test_merges_out_of_order_are_an_error():
    vocab = {c: k for k, c in enumerate(["a", "b", "a</w>", "b</w>", "ab", "aab"])}
    spec = {"model": {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": vocab, "merges": ["a ab", "a b"]}}
    with pytest.raises(ValueError):
        bpe_index.PairIndex(spec, ["a", "b"])
    spec["model"]["merges"].reverse()
    assert array("I", bpe_index.PairIndex(spec, ["a", "b"]).encode(["aaba"])[0]).tolist() == [5, 2]


def test_query_against_the_library(spark):
    got = QUERIES["op11_bpe"](spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digests(docs[r["doc_id"]])


def test_awkward_tables(spark):
    rows = [(1, None, 7, b"x"), (None, "", 7, b"x"), (2, "A b", 7, None), (2, "A b", 7, None), (3, "word " * 20000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, token_ids binary")
    got = bpe_index.decode(bpe_index.encode(docs, PATH), PATH)
    assert got.columns == ["doc_id", "n_tokens", "token_ids", "decoded"]
    assert sorted(((r["doc_id"], r["n_tokens"], r["decoded"][:12]) for r in got.collect()), key=str) == sorted(
        [(1, 0, ""), (None, 0, ""), (2, 2, "a</w> b</w>"), (2, 2, "a</w> b</w>"), (3, 20000, "word</w> wor")], key=str
    )
    assert sorted(map(str, bpe_index.encode(docs, PATH, decoded=True).collect())) == sorted(map(str, got.collect()))
    assert bpe_index.decode(bpe_index.encode(docs.limit(0), PATH), PATH).count() == 0
    nulls = bpe_index.decode(spark.createDataFrame([(None,)], "token_ids binary"), PATH)
    assert nulls.first()["decoded"] is None
    with pytest.raises(ValueError):
        bpe_index.decode(docs.withColumn("decoded", F.lit("")), PATH)
