"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of digits, letters and characters above ASCII, after lower-casing A-Z. The automaton holds every run of
words of every item; a document's words are streamed through it, which gives at each word the longest run ending there
that some item has. A window is `window` consecutive item words, or the whole item where it is shorter. A document word
inside any occurrence of a window is hit.

The benchmark is cut into automata of at most MAX_WORDS words, each of which is broadcast; with a larger benchmark rows go
through the automata one after another and carry what was hit so far, so that a row is counted, judged and cut by all of
them together and no rows are joined. Results don't depend on how the benchmark is cut. Benchmark rows without an id or without words are ignored; items with one id count
once. A null or empty text has no words. Repeated rows are reported each. Extra columns are kept by `decontaminate`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockscope.llm.common import materialize, text_slices

#: Words in one automaton: at most twice as many states and three times as many transitions, about 60 MB.
MAX_WORDS = 100_000
#: Automata that rows go through between two tables in the shared folder: each has a worker of its own.
CHAIN = 4
#: Bits of the filter for each window, its probes, and the most bits (128 MB); with more windows, more rows are suspects.
BITS_PER_WINDOW, PROBES, MOST_BITS = 32, 8, 1 << 30
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normalised_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.link, self.longest, step = [-1], [0], [{}]
        self.shortest = min([window, *(len(w) for _, w in items)])
        ends = []
        for item, words in items:
            state = 0
            for word in words:
                state = self._extend(step, state, self.vocab.setdefault(word, len(self.vocab)))
            if len(words) < window:
                ends.append((state, item))
        self.size = len(self.vocab) + 1
        self.step = {state * self.size + word: to for state, moves in enumerate(step) for word, to in moves.items()}
        order = sorted(range(1, len(self.link)), key=self.longest.__getitem__)
        self.whole: list[list[str]] = [[] for _ in self.link]  # short items that a state's longest run is
        for state, item in ends:
            self.whole[state].append(item)
        self.above: list[list[tuple[int, str]]] = [[] for _ in self.link]  # short items that end every run of the state
        self.at = [0] * len(self.link)  # the state of the last `window` words
        for state in order:
            up = self.link[state]
            self.above[state] = self.above[up] + [(self.longest[up], item) for item in self.whole[up]]
            if self.longest[state] >= window:
                self.at[state] = state if self.longest[up] < window else self.at[up]
        self.owners: dict[int, set[str]] = {}
        for item, words in items:
            for _, state, length in self.walk(np.array([self.vocab[w] for w in words]), 0, len(words)):
                if length >= window:
                    self.owners.setdefault(self.at[state], set()).add(item)

    def _extend(self, step: list[dict], last: int, word: int) -> int:
        """The state of the run `last` + word, made if it isn't there."""
        link, longest = self.link, self.longest
        there = step[last].get(word)
        if there is not None and longest[there] == longest[last] + 1:
            return there
        if there is not None:
            return self._split(step, last, word, there)
        new = len(link)
        link.append(0)
        longest.append(longest[last] + 1)
        step.append({})
        state = last
        while state >= 0 and word not in step[state]:
            step[state][word] = new
            state = link[state]
        if state >= 0:
            target = step[state][word]
            link[new] = target if longest[target] == longest[state] + 1 else self._split(step, state, word, target)
        return new

    def _split(self, step: list[dict], state: int, word: int, target: int) -> int:
        """Give the runs of `target` that are no longer than `state` + word a state of their own."""
        link, longest = self.link, self.longest
        clone = len(link)
        link.append(link[target])
        longest.append(longest[state] + 1)
        step.append(dict(step[target]))
        link[target] = clone
        while state >= 0 and step[state].get(word) == target:
            step[state][word] = clone
            state = link[state]
        return clone

    def walk(self, ids: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(position, state, length of the longest run of any item ending there)."""
        step, link, longest, size = self.step, self.link, self.longest, self.size
        state = length = 0
        for k, word in enumerate(ids[begin:end].tolist(), begin):
            to = step.get(state * size + word)
            while to is None and state:
                state = link[state]
                length = longest[state]
                to = step.get(state * size + word)
            if to is None:
                length = 0
            else:
                state = to
                length += 1
            yield k, state, length

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str], int]:
        """(mask of the words that are hit or None, items with occurring windows, longest run found)."""
        if not self.vocab or len(words) < self.shortest:
            return None, set(), 0
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        gaps = np.concatenate(([-1], np.flatnonzero(ids < 0), [len(words)]))
        mask, items, most, window = None, set(), 0, self.window
        for g in np.flatnonzero(np.diff(gaps) > self.shortest).tolist():  # runs of known words that could hold a window
            for k, state, length in self.walk(ids, int(gaps[g]) + 1, int(gaps[g + 1])):
                most = max(most, length)
                found = [(n, item) for n, item in self.above[state]]
                if length == self.longest[state]:
                    found += [(length, item) for item in self.whole[state]]
                if length >= window or found:
                    if mask is None:
                        mask = np.zeros(len(words), bool)
                    if length >= window:
                        mask[k - window + 1 : k + 1] = True
                        items |= self.owners[self.at[state]]
                    for n, item in found:
                        mask[k - n + 1 : k + 1] = True
                        items.add(item)
        return mask, items, most


def window_hashes(words: list[bytes], length: int) -> np.ndarray:
    """A 64-bit hash of each run of `length` words."""
    n = len(words) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.full(n, length, np.uint64)
    for k in range(length):
        out = (out ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


class WindowFilter:
    """Which hashes of windows may occur in the benchmark, by the lengths that windows have."""

    def __init__(self, lengths: list[int], bits: int, held: np.ndarray):
        self.lengths, self.bits, self.held = lengths, bits, held

    def may_hit(self, text: bytes) -> bool:
        words = normalised_words(text)
        for length in self.lengths:
            left = window_hashes(words, length)
            for at in range(PROBES if len(left) else 0):
                bit = (left & np.uint64(0xFFFFFFFF)) + (left >> np.uint64(32) | np.uint64(1)) * np.uint64(at) & np.uint64(self.bits - 1)
                left = left[self.held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1]
                if not len(left):
                    break
            if len(left):
                return True
        return False


def window_filter(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> WindowFilter:
    """The filter, aggregated by Spark in pages of bits; the driver gets the pages, MOST_BITS / 8 bytes at most."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                for text in texts:
                    words = normalised_words(text)
                    if words:
                        length = min(window, len(words))
                        found = window_hashes(words, length).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), length), pa.int32()), pa.array(found)], names=["length", "hash"])

    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))
    found = materialize(items.mapInArrow(hashes, "length int, hash long"), "windows")
    lengths, n = found.agg(F.collect_set("length"), F.count(F.lit(1))).first()
    bits = min(MOST_BITS, max(1 << 15, 1 << (BITS_PER_WINDOW * n - 1).bit_length()))
    low, high = F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("hash", 32).bitwiseOR(F.lit(1))
    bit = F.explode(F.array(*((low + high * k).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES))))
    pages = found.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("held"))
    held = np.zeros(bits // 8, np.uint8)
    for row in pages.toLocalIterator():
        held[row["page"] * 4096 : (row["page"] + 1) * 4096] = np.frombuffer(row["held"], np.uint8)
    return WindowFilter(sorted(lengths), bits, held)


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text_col: str, text_col: str) -> DataFrame:
    """The rows with `__suspect`, stored: whether a window may occur in the text."""
    shared = docs.sparkSession.sparkContext.broadcast(window_filter(benchmark, window, item_col, item_text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [shared.value.may_hit(text) for _, texts in text_slices(batch, text_col) for text in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.bool_())], names=[*batch.schema.names, "__suspect"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return materialize(docs.mapInArrow(run, f"{schema}, __suspect boolean"), "marked")


def _automata(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[ItemAutomaton]:
    items, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        words = normalised_words(row[1].encode())
        if words and size and size + len(words) > MAX_WORDS:
            yield ItemAutomaton(items, window)
            items, size = [], 0
        if words:
            items.append((row[0], words))
            size += len(words)
    yield ItemAutomaton(items, window)


def _chained(docs: DataFrame, steps: list[tuple]) -> DataFrame:
    """Steps (function, schema) one after another."""
    for n, (run, schema) in enumerate(steps):
        docs = docs.mapInArrow(run, schema)
        if (n + 1) % CHAIN == 0 and n + 1 < len(steps):
            docs = materialize(docs, "hits")
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, longest_run) for each document row; longest_run is 0
    where no window occurs."""
    kind = docs.schema[id_col].dataType.simpleString()
    automata = [docs.sparkSession.sparkContext.broadcast(a) for a in _automata(benchmark, window, item_col, item_text_col)]

    def step(shared, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, texts in text_slices(batch, text_col):
                    part = batch.slice(begin, len(texts))
                    carried = repeat(([], [], 0)) if first else zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("__hits", "__items", "__longest")))
                    out = []
                    for text, (hits, names, longest) in zip(texts, carried):
                        words = normalised_words(text)
                        mask, items, most = shared.value.hits(words)
                        if mask is not None:
                            mask[hits] = True
                            hits, names = np.flatnonzero(mask).tolist(), sorted(items.union(names))
                        out.append((len(words), hits, names, max(most, longest)))
                    n, hits, names, longest = zip(*out)
                    columns = [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.int64())]
                    kept = [id_col] if last else [id_col, text_col]
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *columns], names=[*kept, "__words", "__hits", "__items", "__longest"])

        text = "" if last else f"`{text_col}` {docs.schema[text_col].dataType.simpleString()}, "
        return run, f"`{id_col}` {kind}, {text}__words long, __hits array<int>, __items array<string>, __longest long"

    rows = docs.select(id_col, text_col)
    clean = None
    if len(automata) > 1:
        marked = _marked(rows, benchmark, window, item_col, item_text_col, text_col)
        rows, clean = marked.where("__suspect").select(id_col, text_col), marked.where("not __suspect").select(id_col, text_col)
    found = _chained(rows, [step(a, k == 0, k == len(automata) - 1) for k, a in enumerate(automata)])
    if clean is not None:  # their words alone are counted
        none = step(docs.sparkSession.sparkContext.broadcast(ItemAutomaton([], window)), True, True)
        found = found.unionByName(clean.mapInArrow(*none))
    return found.select(
        id_col, F.col("__words").alias("n_words"), F.size("__hits").cast("long").alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"), (F.size("__hits") > 0).alias("contaminated"),
        F.when(F.size("__hits") > 0, F.col("__longest")).otherwise(0).cast("long").alias("longest_run"),
    )


def cut_words(text: bytes, mask: np.ndarray) -> bytes:
    """The text without the spans of words in the mask."""
    spans = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    out, at = [], 0
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(text[at : spans[first][0]])
        at = spans[last - 1][1]
    return b"".join([*out, text[at:]])


def cut_hits(text: bytes, automaton: ItemAutomaton) -> tuple[bytes, float]:
    """The text without hit spans, and the share of its words that was hit. Cutting repeats until no window is left."""
    share = None
    while True:
        mask, _, _ = automaton.hits(normalised_words(text))
        if mask is None:
            return text, share or 0.0
        share = float(mask.mean()) if share is None else share
        text = cut_words(text, mask)


def _replaced(batch: pa.RecordBatch, at: int, texts: dict[int, str]) -> pa.RecordBatch:
    """The batch with other texts in some rows, given in order."""
    if not texts:
        return batch
    marks = np.zeros(batch.num_rows, bool)
    marks[list(texts)] = True
    column = batch.column(at)
    column = pa.compute.replace_with_mask(column, pa.array(marks), pa.array(list(texts.values()), column.type))
    return pa.RecordBatch.from_arrays([column if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_share: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents with the spans that occur in items cut out of the text; those with more than max_share of their words hit
    go, as do those that keep no word. Untouched documents, null and empty texts among them, stay as they are, with all columns.

    With several automata a round marks the words that any of them hits and then cuts once; texts that were cut take another.
    """
    automata = [docs.sparkSession.sparkContext.broadcast(a) for a in _automata(benchmark, window, item_col, item_text_col)]
    if len(automata) > 1:
        marked = _marked(docs, benchmark, window, item_col, item_text_col, text_col)
        suspects = marked.where("__suspect").select(*docs.columns)
        return _decontaminate_in_rounds(suspects, automata, max_share, text_col).unionByName(marked.where("not __suspect").select(*docs.columns))
    (shared,) = automata

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            changed: dict[int, str] = {}
            for begin, texts in text_slices(batch, text_col):
                for k, text in enumerate(texts, begin):
                    cut, share = cut_hits(text, shared.value)
                    if share:
                        keep[k] = share <= max_share and bool(_WORD.search(cut))
                        changed[k] = cut.decode()
            yield _replaced(batch, batch.schema.get_field_index(text_col), changed).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _decontaminate_in_rounds(docs: DataFrame, automata: list, max_share: float, text_col: str) -> DataFrame:
    names = docs.columns
    todo = docs.withColumns({"__hits": F.array().cast("array<int>"), "__cut": F.lit(False)})
    schema = todo.schema

    def step(shared, judged: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, carried = batch.schema.get_field_index(text_col), batch.column(batch.schema.get_field_index("__hits")).to_pylist()
                keep, cut = np.ones(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
                changed: dict[int, str] = {}
                for begin, texts in text_slices(batch, text_col):
                    for k, text in enumerate(texts, begin):
                        words = normalised_words(text)
                        mask, _, _ = shared.value.hits(words)
                        if mask is None and not carried[k]:
                            continue
                        mask = np.zeros(len(words), bool) if mask is None else mask
                        mask[carried[k]] = True
                        if last:
                            rest = cut_words(text, mask)
                            keep[k], cut[k] = (judged or mask.mean() <= max_share) and bool(_WORD.search(rest)), True
                            changed[k], carried[k] = rest.decode(), []
                        else:
                            carried[k] = np.flatnonzero(mask).tolist()
                batch = _replaced(batch, at, changed)
                own = {"__hits": pa.array(carried, pa.list_(pa.int32())), "__cut": pa.array(cut)}
                yield pa.RecordBatch.from_arrays([own.get(n, c) for n, c in zip(batch.schema.names, batch.columns)], names=batch.schema.names).filter(pa.array(keep))

        return run, schema

    done = None
    while True:
        judged = done is not None
        made = materialize(_chained(todo, [step(a, judged, k == len(automata) - 1) for k, a in enumerate(automata)]), "decontaminated")
        clean = made.where("not __cut").select(*names)
        done = done.unionByName(clean) if judged else clean
        todo = made.where("__cut")
        if todo.isEmpty():
            return done
