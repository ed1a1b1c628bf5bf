"""The prefix trie against a plain Python version, its hashing, and awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from blockscope.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_force(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            token = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns.setdefault(conv, []).append((turn is not None, turn or 0, token, (role, text)))
    paths = {}
    for conv, held in turns.items():
        own, donor = [t[3] for t in sorted(held)], [t[3] for t in sorted(turns.get(conv - conv % 20, []))]
        h = zlib.crc32(str(conv).encode()) % 4
        paths[conv] = tuple(donor[:h] + own[h:])
    members = {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len([w for w in n[-1][1].translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in convs if paths[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len([n for n in below if len(n) == len(node) + 1]), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], f"{SCHEMA}, depth int, a string")
    assert sorted(map(str, map(tuple, trie.prefix_trie(table).collect()))) == sorted(map(str, brute_force(rows)))


def conversations(n, seed, longest=6):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["hi", "how are you", " two\twords ", ""])) for c in range(n) for t in range(rnd.randint(1, longest))]


def test_against_brute_force_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_ROWS", 20)
    check(spark, conversations(90, 1))


def test_long_conversations_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_ROWS", 40)
    monkeypatch.setattr(trie, "SEGMENT", 3)
    long = [(c, t, "user", f"turn {t if t < 14 else t * c}") for c in (40, 41, 43, 60) for t in range(17)]
    check(spark, conversations(30, 2, 9) + long)


def test_awkward_rows(spark):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, None, "user", "b"), (5, 1, "user", "b"), (5, 1, "user", "b"), (5, 1, "assistant", "b")]
    rows += [(7, 0, "user", "x " * 30000), (27, 0, "", ""), (20, 3, None, "a"), (29, 0, "r", None), (-7, 1, "user", "b"), (-20, 1, "user", "c")]
    rows += [(c, 0, "user", "only") for c in range(100, 112)]  # some of them lose their single turn
    got = [r for r in rows if r[0] is None or r[0] >= 0]
    check(spark, got)
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0


def test_many_equal_conversations_end_in_sorted_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BITS", 4)
    check(spark, [(c, t, "user", f"t{t}") for c in range(0, 400, 3) for t in range(5)])


def test_slots_are_minimal_and_verified():
    rnd = np.random.default_rng(3)
    keys = [np.arange(5000), rnd.integers(-(2**62), 2**62, 5000), rnd.integers(-(2**62), 2**62, 5000)]
    table = trie.SlotTable(*keys)
    assert sorted(table.slots) == list(range(5000)) and (table.find(*keys) == table.slots).all()
    assert (table.find(keys[0] + 1, *keys[1:]) == -1).all()
    assert len(trie.SlotTable(*(k[:0] for k in keys)).find(*(k[:3] for k in keys))) == 3
    with pytest.raises(ValueError):
        trie.SlotTable(np.zeros(2, np.int64))


def test_digests_that_collide_are_an_error(spark, monkeypatch):
    def colliding(turns, lengths, real=trie.paths_of):
        return real(turns, lengths).selectExpr("conv", "piece", "depth", "case when depth = 2 then 1L else a end a", "case when depth = 2 then 1L else b end b", "pa", "pb", "words", "ends")

    monkeypatch.setattr(trie, "paths_of", colliding)
    with pytest.raises(Exception, match="collide"):
        trie.prefix_trie(spark.createDataFrame([(20, 0, "u", "a"), (20, 1, "u", "b"), (40, 0, "u", "c"), (40, 1, "u", "d")], SCHEMA)).collect()


def test_streamed_digests_cross_batches():
    batch = lambda *rows: pa.RecordBatch.from_pylist([{"depth": d, "a": 0, "b": 0, "ids": i} for d, i in rows])
    out = [tuple(r.values()) for b in trie._digests(iter([batch((1, "1,2"), (2, "5")), batch((2, "70"), (2, "99")), batch((3, "7"))])) for r in b.to_pylist()]
    assert [(d, h) for d, _, _, h in out] == [(d, hashlib.sha256(i).hexdigest()) for d, i in ((1, b"1,2"), (2, b"5,70,99"), (3, b"7"))]
