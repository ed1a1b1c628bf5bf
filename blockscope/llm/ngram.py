"""Interpolated modified Kneser-Ney model of any order: counted in Spark, kept as sorted hash arrays, mapped by the workers.

Tasks cut texts into words, hash them to 64 bits and add up the n-grams of some two million tokens at a time. A shuffle
deals these to partitions by the words between the first and the last, so that four things are final in one place: the
n-gram's count, the sums of its first words as a context, the distinct predecessors of its last words, and the sums of
the middle words as a context. What is left for the next shuffle are partial sums for n-grams two words shorter: of a
model of order three, sums by word. A last shuffle adds up the words. The driver gets a few numbers from each task.

Frequent middle words are dealt by the last word too, and a frequent pair of middle and last words by the first. Which ones
are frequent is estimated from a share of the texts that grows with the corpus; that only places rows and changes no
result. Sums that are split in this way meet in the next shuffle: contexts as rows, frequent pairs (a number that is
bounded by that of partitions) on the driver.

An n-gram that begins a text has no predecessor; in the sums below the highest order its count stands for them. The
first words of a text are scored by the order that their context reaches.

Contexts that were seen once are not stored, since their n-gram tells as much. A table is a file for each partition: an index of slots by the upper bits of a hash, the next 32 bits of each entry in
order (all 64 for words), a byte for each entry that names one of the 255 most frequent values, and the other values. An
n-gram that isn't in the table is taken for one that is with a probability of some 4e-9. Scoring maps the files and looks
hashes up partition by partition; nothing is broadcast and no worker loads the model. The model lists its files; one
that isn't found is an error. The folder must be a path that workers can map. Files are written under a name of the task
attempt and then renamed, so repeated attempts leave the same files.

Words are split on ASCII white space after lower-casing A-Z; each text ends with one end token, which counts as a token
but not as a context. A null or empty text is the end token alone. Repeated rows count each. A null id counts as ''.
An empty table gives no rows; a model of no texts scores by the uniform distribution. Very long texts are counted in
pieces and scored whole. Columns other than the id and the text are not read. Words of 64-bit equal hash would be taken as
one (for 10^9 distinct words 0.03 such pairs are expected).
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockscope.llm.common import materialize, new_path, text_slices

#: Tokens whose n-grams are added up before they are sent: their words have numbers of WORD_BITS, three of which fit 64.
WORD_BITS = 21
CHUNK = (1 << WORD_BITS) - 8
#: Share of the texts that frequent words are looked for in, and how many shares of an even partition make a word frequent.
SAMPLE, EVEN = 0.01, 0.125
#: Files of one table that a worker keeps open.
OPEN = 150
PAD = np.uint64(0)  # before the beginning
BEGIN, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"\n<", b"\n>"))  # no word has a line feed
FIELDS = ("context", "once", "twice", "more", "before", "count")
#: Kinds of rows between stages; those above 0 are partial sums of contexts of so many words.
GRAMS, TOTALS, HEAVY, FILES = 0, -1, -2, -3
ROW = "kind int, bucket int, blob binary"


def bigram_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = left * np.uint64(0x9E3779B97F4A7C15) + right
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return key ^ (key >> np.uint64(29))


def gram_hash(grams: list[np.ndarray]) -> np.ndarray:
    key = grams[0]
    for word in grams[1:]:
        key = bigram_hash(key, word)
    return key


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Splits:
    """Frequent keys (with their middle words' hash and last word) and how many parts each is dealt to; other keys have one."""

    def __init__(self, rows: list[tuple[int, int, int, int]] = ()):
        columns = np.array(sorted(rows), np.uint64).reshape(-1, 4)
        self.keys, self.middle, self.last, self.parts = (np.ascontiguousarray(c) for c in columns.T)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The key's number, -1 for others."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self.find(keys)
        return np.where(at >= 0, self.parts[at], np.uint64(1)) if len(self.keys) else np.ones(len(keys), np.uint64)


@dataclass(frozen=True)
class Layout:
    """Where the n-grams of one stage and what is derived from them are."""

    n: int
    parts: int
    middles: Splits = field(default_factory=Splits)
    pairs: Splits = field(default_factory=Splits)  # of middle and last words, where the stage has three words

    def _even(self, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
        return bigram_hash(middle, bigram_hash(last, middle) % self.middles.of(middle))

    def grams(self, grams: list[np.ndarray]) -> np.ndarray:
        if self.n == 2:
            return bucket_of(gram_hash(grams), self.parts)
        middle = gram_hash(grams[1:-1])
        key = self._even(middle, grams[-1])
        pair = gram_hash(grams[1:])
        splits = self.pairs.of(pair)
        key = np.where(splits > 1, bigram_hash(pair, bigram_hash(grams[0], pair) % splits), key)
        return bucket_of(bigram_hash(key, key), self.parts)

    def shorter(self, grams: list[np.ndarray]) -> np.ndarray:
        """Of the last words but the first, unless they are frequent."""
        key = self._even(gram_hash(grams[:-1]), grams[-1])
        return bucket_of(bigram_hash(key, key), self.parts)

    def contexts(self, context: list[np.ndarray], middle: np.ndarray) -> np.ndarray:
        """Of a context with these middle words; contexts that are split are in files of their own, by their hash."""
        key = bigram_hash(middle, np.zeros(len(middle), np.uint64))
        return np.where(self.middles.of(middle) > 1, self.parts + bucket_of(gram_hash(context), self.parts), bucket_of(bigram_hash(key, key), self.parts))


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens, first position of each text) of some texts one after another."""
    words = [t.lower().split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(lengths + 1) - 1
    tokens = np.empty(int(lengths.sum()) + len(words), np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[ends] = END
    tokens[inner] = np.fromiter((digest(w) for ws in words for w in ws), np.uint64, int(lengths.sum()))
    return tokens, ends - lengths


def grams_of(tokens: np.ndarray, starts: np.ndarray, order: int, begin=BEGIN, pad=PAD) -> list[np.ndarray]:
    """For each token the order - 1 tokens before it, and itself."""
    grams = [tokens]
    for k in range(order - 1):
        before = np.empty_like(tokens)
        before[:1] = pad
        before[1:] = grams[0][:-1]
        before[starts] = pad if k else begin
        grams.insert(0, before)
    return grams


def _squeezed(column: np.ndarray) -> bytes:
    """An array's kind and its bytes, those of equal weight together."""
    kind = column.dtype if column.dtype == np.uint64 else np.min_scalar_type(int(column.max()) if len(column) else 0)
    return kind.str.encode().ljust(4) + np.ascontiguousarray(column.astype(kind).view(np.uint8).reshape(len(column), -1).T).tobytes()


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length, packed; whole numbers take as few bytes as their largest needs."""
    return zstandard.ZstdCompressor(level=3).compress(len(columns[0]).to_bytes(8, "little") + b"".join(map(_squeezed, columns)))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    while at < len(raw):
        kind = np.dtype(raw[at : at + 4].strip().decode())
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at + 4).reshape(kind.itemsize, n).T).view(kind).ravel())
        at += 4 + size
    return out


def _steps(column: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which wrap around; a sorted column's are small."""
    return np.diff(column, prepend=column.dtype.type(0))


def pack_grams(grams: list[np.ndarray], *numbers: np.ndarray, words: np.ndarray | None = None) -> bytes:
    """N-grams, in any order, as places in the list of their words, which is packed before them: the most frequent words
    first, then the others by their hash. Given `words`, the grams are places in it already. Single words come sorted."""
    if len(grams) == 1:
        return pack(_steps(grams[0]), *numbers)
    own, place, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    frequent = np.argsort(-times, kind="stable")[: min(255, int((times > 2).sum()))]
    order = np.concatenate((frequent, np.delete(np.arange(len(own)), frequent)))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    first, *middle, last = rank[place].reshape(len(grams), -1)
    if len(own) < 1 << WORD_BITS and len(middle) < 2:
        rows = np.argsort(((middle[0] if middle else 0) << WORD_BITS | first) << WORD_BITS | last)
    else:
        rows = np.lexsort((last, first, *middle))
    kind = np.min_scalar_type(max(1, len(own)))
    own = own[order] if words is None else words[own[order]]
    head = pack(_steps(own))
    return len(head).to_bytes(4, "little") + head + pack(*(_steps(c[rows].astype(kind)) for c in (first, *middle)), last[rows], *(c[rows] for c in numbers))


def unpack_grams(blob: bytes, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    if order > 1:
        at = 4 + int.from_bytes(blob[:4], "little")
        (words,), columns = unpack(blob[4:at]), unpack(blob[at:])
        words, kind = np.cumsum(words, dtype=np.uint64), np.min_scalar_type(max(1, len(words)))
        places = [np.cumsum(c.astype(kind), dtype=kind) for c in columns[: order - 1]]
        return [words[p] for p in (*places, columns[order - 1])], columns[order:]
    columns = unpack(blob)
    return [np.cumsum(columns[0], dtype=np.uint64)], columns[1:]


def grouped(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, the place of one row of each, and the columns' sums for each."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], order[first], [np.add.reduceat(c[order].astype(np.int64), first) if len(key) else np.zeros(0, np.int64) for c in columns]


def _merged(blobs: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(hashes in order, n-grams, sums of their numbers) of packed rows."""
    grams, numbers = zip(*(unpack_grams(b, order) for b in blobs))
    grams = [np.concatenate(c) for c in zip(*grams)]
    key, at, numbers = grouped(gram_hash(grams), *(np.concatenate(c) for c in zip(*numbers)))
    return key, [g[at] for g in grams], numbers


def _local(path: str) -> str:
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"the model folder must be a mounted path that workers can map, not {path}")
    return at.path


def _save(folder: str, name: str, key: np.ndarray, *columns: np.ndarray, whole: bool = False) -> None:
    """A table's file; keys come sorted. Sections begin at multiples of eight bytes, their sizes lead."""
    n, slot_bits = len(key), max(0, len(key).bit_length() - 4)
    slots = (key >> np.uint64(64 - slot_bits)).astype(np.int64) if slot_bits else np.zeros(n, np.int64)
    offsets = np.searchsorted(slots, np.arange((1 << slot_bits) + 1)).astype(np.uint32 if n < 1 << 32 else np.uint64)
    rest = key if whole else ((key << np.uint64(slot_bits)) >> np.uint64(32)).astype(np.uint32)
    values = np.stack([c.astype(np.int64) for c in columns], axis=1)
    mark = gram_hash([c.astype(np.uint64) for c in columns])
    _, at, place, times = np.unique(mark, return_index=True, return_inverse=True, return_counts=True)
    frequent = np.argsort(-times, kind="stable")[:255]
    code = np.full(len(times), 255, np.uint8)
    code[frequent] = np.arange(len(frequent))
    code = code[place]
    rare = np.flatnonzero(code == 255)
    sections = [offsets, rest, code, values[at[frequent]], rare.astype(offsets.dtype), values[rare].astype(np.min_scalar_type(int(values[rare].max()) if len(rare) else 0))]
    os.makedirs(folder, exist_ok=True)
    attempt = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}"
    with open(attempt, "wb") as f:
        f.write(np.array([n, slot_bits, len(columns), *(s.size for s in sections), *(s.itemsize for s in sections)], np.int64).tobytes())
        for s in sections:
            f.write(np.ascontiguousarray(s).tobytes())
            f.write(b"\0" * (-f.tell() % 8))
    os.replace(attempt, f"{folder}/{name}")


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, bucket, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], names=["kind", "bucket", "blob"])


def _dealt(kind: int, bucket: np.ndarray, grams: list[np.ndarray], *numbers: np.ndarray, words: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Rows (kind, bucket, packed n-grams and numbers)."""
    order = np.argsort(bucket.astype(np.min_scalar_type(int(bucket.max()))) if len(bucket) else bucket, kind="stable")
    there, edges = np.unique(bucket[order], return_index=True)
    for b, begin, end in zip(there.tolist(), edges.tolist(), [*edges[1:].tolist(), len(order)]):
        at = order[begin:end]
        yield kind, b, pack_grams([g[at] for g in grams], *(c[at] for c in numbers), words=words)


def chunk_grams(tokens: np.ndarray, starts: np.ndarray, begin: int, end: int, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(words, distinct n-grams that end in tokens[begin:end] as places among them, counts)."""
    low = max(0, begin - order + 1)
    words, place = np.unique(tokens[low:end], return_inverse=True)
    words = np.concatenate(([PAD, BEGIN], words))
    here = starts[np.searchsorted(starts, low) : np.searchsorted(starts, end)] - low
    grams = [g[begin - low :].astype(np.uint64) for g in grams_of(place + 2, here, order, begin=1, pad=0)]
    bits = np.uint64(WORD_BITS)
    middle = np.zeros(end - begin, np.uint64)
    for k, g in enumerate(grams[1:-1]):
        middle = np.unique(middle << bits | g, return_inverse=True)[1].astype(np.uint64) if k else g
    key = (middle << bits | grams[0]) << bits | grams[-1]
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    return words, [g[at].astype(np.int32) for g in grams], count


def _count_grams(layout: Layout, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, at = np.concatenate([t for t, _ in waiting]), np.cumsum([0, *(len(t) for t, _ in waiting)])
            starts = np.concatenate([s + a for (_, s), a in zip(waiting, at)])
            waiting.clear()
            for begin in range(0, len(tokens), CHUNK):
                words, grams, count = chunk_grams(tokens, starts, begin, min(begin + CHUNK, len(tokens)), layout.n)
                yield _rows(list(_dealt(GRAMS, layout.grams([words[g] for g in grams]), grams, count, words=words)))

        for batch in batches:
            for _, texts in text_slices(batch, text_col):
                waiting.append(hashed(texts))
                if sum(len(t) for t, _ in waiting) >= CHUNK - (CHUNK >> 3):
                    yield from flush()
        if waiting:
            yield from flush()

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], list[bytes]]:
    found: dict[tuple[int, int], list[bytes]] = {}
    for batch in batches:
        for kind, bucket, blob in zip(*(c.to_pylist() for c in batch.columns)):
            found.setdefault((kind, bucket), []).append(blob)
    return found


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _stats(counts: np.ndarray) -> list[np.ndarray]:
    return [counts, counts == 1, counts == 2, counts > 2]


class Saver:
    """Tables by name (g: n-grams, c: contexts, with their number of words; w: words), and what was saved."""

    def __init__(self, folder: str, highest: int):
        self.folder, self.names, self.made = folder, table_names(highest), []

    def __call__(self, name: str, bucket: int, key: np.ndarray, *columns: np.ndarray) -> None:
        if len(key):
            _save(self.folder, f"{name}-{bucket}", key, *columns, whole=name == "w")
            self.made.append((self.names.index(name), bucket))

    def rows(self, totals: np.ndarray) -> pa.RecordBatch:
        """What the driver needs from this task."""
        to = -1 - TaskContext.get().partitionId()
        return _rows([(TOTALS, to, pack(totals.ravel())), *([(FILES, to, pack(*(np.array(c, np.int64) for c in zip(*self.made))))] if self.made else [])])


def table_names(highest: int) -> list[str]:
    return ["w", *(f"g{k}" for k in range(2, highest + 1)), *(f"c{k}" for k in range(2, highest))]


def _save_contexts(save: Saver, words: int, bucket: int, key: np.ndarray, sums: list[np.ndarray]) -> None:
    """Those seen more than once: the others are known from their n-gram, which something follows wherever it doesn't end a text."""
    more = sums[0] > 1
    save(f"c{words}", bucket, key[more], *(s[more] for s in sums))


def _merge_grams(folder: str, highest: int, layout: Layout, after: Layout | None):
    """Merge the n-grams of a stage and those a word shorter, and send sums for those two words shorter (words, if `after` is
    None) and for split contexts. Bigrams alone are merged without a shorter kind."""
    n, parts = layout.n, layout.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, save = _gather(batches), Saver(folder, highest)
        totals = np.zeros((highest + 1, 4), np.int64)  # of each order: n-grams seen 1 to 4 times
        for kind, bucket in sorted(found):
            blobs = found.pop((kind, bucket))
            if kind < 0:
                yield _rows([(kind, bucket, b) for b in blobs])
                continue
            if kind > 0:
                key, _, sums = _merged(blobs, 1)
                _save_contexts(save, kind, parts + bucket, key, sums)
                continue
            key, grams, numbers = _merged(blobs, n)
            seen, count = numbers[0], numbers[-1]
            whole = grams[0] != PAD
            save(f"g{n}", bucket, key[whole], seen[whole])
            totals[n] += _of_counts(seen[whole])
            context = [g[whole] for g in grams[:-1]]
            contexts = [(context, gram_hash(context[1:] or context), seen[whole])]
            grams, value = grams[1:], np.where(whole, 1, seen)  # each distinct predecessor once
            if n > 2:
                key, at, (value, count) = grouped(gram_hash(grams), value, count)
                grams = [g[at] for g in grams]
                heavy = layout.pairs.find(key)
                light, whole = heavy < 0, grams[0] != PAD
                if not light.all():
                    yield _rows([(HEAVY, -1 - TaskContext.get().partitionId(), pack(heavy[~light], value[~light]))])
                own = light & whole
                save(f"g{n - 1}", bucket, key[own], value[own])
                totals[n - 1] += _of_counts(value[own])
                context = [g[own] for g in grams[:-1]]
                contexts.append((context, gram_hash(context), value[own]))
                grams, value = grams[1:], np.where(light, np.where(whole, 1, value), 0)
            for context, middle, counts in contexts:
                if len(context) > 1:
                    key, at, sums = grouped(gram_hash(context), *_stats(counts))
                    split = layout.middles.of(middle[at]) > 1
                    _save_contexts(save, len(context), bucket, key[~split], [s[~split] for s in sums])
                    yield _rows(list(_dealt(len(context), bucket_of(key[split], parts), [key[split]], *(s[split] for s in sums))))
            if after is None:
                (of,), _, counts = contexts[-1]
                zero, none = np.zeros(len(of), np.int64), np.zeros(len(value), np.int64)
                key, _, sums = grouped(np.concatenate((of, grams[0])), *(np.concatenate((s, none)) for s in _stats(counts)), np.concatenate((zero, value)), np.concatenate((zero, count)))
                yield _rows(list(_dealt(GRAMS, bucket_of(key, parts), [key], *sums)))
            else:
                _, at, sums = grouped(gram_hash(grams), value, count)
                grams = [g[at] for g in grams]
                yield _rows(list(_dealt(GRAMS, after.grams(grams), grams, *sums)))
        yield save.rows(totals)

    return run


def _merge_words(folder: str, highest: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, save = _gather(batches), Saver(folder, highest)
        totals = np.zeros((highest + 1, 4), np.int64)  # the first row: distinct predecessors in all, words after 3 and more, words, tokens; then as for n-grams
        for kind, bucket in sorted(found):
            blobs = found.pop((kind, bucket))
            if kind < 0:
                yield _rows([(kind, bucket, b) for b in blobs])
            elif kind > 0:
                key, _, sums = _merged(blobs, 1)
                _save_contexts(save, kind, parts + bucket, key, sums)
            else:
                key, _, made = _merged(blobs, 1)
                save("w", bucket, key, *made)
                before, count = made[4:]
                totals[1] += _of_counts(before)
                totals[0] += np.array([before.sum(), (before > 2).sum(), (count > 0).sum(), count.sum()])
        yield save.rows(totals)

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of items seen 1, 2, 3 and 4 times; plain steps where there are too few."""
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


@dataclass(frozen=True, eq=False)
class Model:
    """Where the tables are, and the totals that the formulas need."""

    folder: str
    order: int
    layouts: dict[int, Layout]  # by the length of n-grams
    files: dict[str, bytes]  # of each table, a bit for each file that there is
    heavy: np.ndarray  # distinct predecessors of the frequent pairs
    heavy_words: tuple[np.ndarray, np.ndarray]  # their first words, and what these pairs add to the words' sums as contexts
    discounts: tuple[tuple[float, float, float], ...]  # of each order from 1
    pairs: int  # distinct bigrams: the words' distinct predecessors in all
    word_left: float  # probability that the words' discounts leave for the uniform distribution
    words: int
    tokens: int


def _frequent(docs: DataFrame, text_col: str, stages: list[int], parts: int) -> dict[int, Layout]:
    """The layout of each stage. Keys that are split number 1 / EVEN times the partitions at most."""
    ask = [n for n in stages if n > 2]
    layouts = {n: Layout(n, parts) for n in stages}
    if not ask:
        return layouts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, text_col):
                tokens, starts = hashed(texts)
                for n in ask:
                    grams = grams_of(tokens, starts, n)
                    middle, pair = gram_hash(grams[1:-1]), gram_hash(grams[1:])
                    for level, keys in enumerate((np.zeros_like(tokens), middle, pair) if n == 3 else (np.zeros_like(tokens), middle)):
                        key, at, times = np.unique(keys, return_index=True, return_counts=True)
                        words = [c[at] if level == 2 else np.zeros_like(key) for c in (middle, tokens)]
                        made = [pa.array(np.full(len(key), x, np.int32)) for x in (n, level)] + [pa.array(c.view(np.int64)) for c in (key, *words)]
                        yield pa.RecordBatch.from_arrays([*made, pa.array(times.astype(np.int64))], names=names)

    names = ["n", "level", "key", "middle", "last", "times"]
    seen = docs.select(text_col).sample(SAMPLE, 20_250_101).mapInArrow(run, "n int, level int, key long, middle long, last long, times long")
    seen = materialize(seen.groupBy(*names[:-1]).agg(F.sum("times").alias("times")), "ngram-frequent")
    for n, total in [(r["n"], r["times"]) for r in seen.where("level = 0").collect()]:
        even = EVEN * total / parts
        found = seen.where((F.col("n") == n) & (F.col("level") > 0) & (F.col("times") > even)).collect()
        of = [[tuple(r[c] % (1 << 64) for c in names[2:5]) + (math.ceil(r["times"] / even),) for r in found if r["level"] == level] for level in (1, 2)]
        layouts[n] = Layout(n, parts, *map(Splits, of))
    return layouts


def train(docs: DataFrame, text_col: str = "text", folder: str | None = None, order: int = 2) -> Model:
    if order < 2:
        raise ValueError(f"the order must be 2 or more, not {order}")
    spark = docs.sparkSession
    folder = _local(folder or new_path(spark, "ngram"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stages = list(range(order, 1, -2))
    layouts = _frequent(docs, text_col, stages, parts)
    rows = docs.select(text_col).mapInArrow(_count_grams(layouts[order], text_col), ROW)
    for n in stages:
        rows = rows.repartition(parts, "bucket").mapInArrow(_merge_grams(folder, order, layouts[n], layouts.get(n - 2)), ROW)
    pairs = layouts[stages[-1]].pairs
    if len(pairs.keys):  # each is in the corpus, so it is one distinct predecessor of its last word
        key, _, (times,) = grouped(pairs.last, np.ones(len(pairs.last), np.int64))
        zero = np.zeros_like(times)
        more = [(kind, bucket, bytearray(blob)) for kind, bucket, blob in _dealt(GRAMS, bucket_of(key, parts), [key], zero, zero, zero, zero, times, zero)]
        rows = rows.unionByName(spark.createDataFrame(more, ROW))
    made = rows.repartition(parts, "bucket").mapInArrow(_merge_words(folder, order, parts), ROW).collect()  # some numbers for each task

    t = np.zeros((order + 1, 4), np.int64)
    heavy = np.zeros(len(pairs.keys), np.int64)
    names = table_names(order)
    files = np.zeros((len(names), 2 * parts), np.uint8)
    for kind, _, blob in made:
        numbers = [c.astype(np.int64) for c in unpack(blob)]
        if kind == TOTALS:
            t += numbers[0].reshape(t.shape)
        elif kind == HEAVY:
            np.add.at(heavy, *numbers)
        else:
            files[tuple(numbers)] = 1
    t[2] += _of_counts(heavy)
    words, _, sums = grouped(pairs.middle, *_stats(heavy))
    distinct, more, kinds, tokens = t[0].tolist()
    found = tuple(discounts(n) for n in t[1:].tolist())
    low = found[0]
    left = (low[0] * int(t[1][0]) + low[1] * int(t[1][1]) + low[2] * more) / distinct if distinct else 1.0
    bits = {name: np.packbits(f).tobytes() for name, f in zip(names, files)}
    return Model(folder, order, layouts, bits, heavy, (words, np.array(sums)), found, distinct, left, kinds, tokens)


class TableFile:
    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        head = raw[:120].view(np.int64).tolist()
        self.n, self.slot_bits, self.fields = head[:3]
        at, sections = 120, []
        for size, width in zip(head[3:9], head[9:]):
            sections.append(raw[at : at + size * width].view(f"<u{width}"))
            at += -(-size * width // 8) * 8
        self.offsets, self.rest, self.code, values, self.rare, others = sections
        self.values, self.others = values.reshape(-1, self.fields), others.reshape(-1, self.fields)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """A row of values for each key, zeros where it is not there."""
        bits = np.uint64(self.slot_bits)
        slot = (keys >> (np.uint64(64) - bits)).astype(np.int64) if self.slot_bits else np.zeros(len(keys), np.int64)
        want = keys if self.rest.itemsize == 8 else ((keys << bits) >> np.uint64(32)).astype(np.uint32)
        low, high = self.offsets[slot].astype(np.int64), self.offsets[slot + 1].astype(np.int64)
        end = high
        for _ in range(int((high - low).max()).bit_length()):
            middle = (low + high) >> 1
            less = (middle < high) & (self.rest[np.minimum(middle, self.n - 1)] < want)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        at = np.minimum(low, self.n - 1)
        hit = (low < end) & (self.rest[at] == want)
        code = self.code[at]
        out = self.values[np.minimum(code, len(self.values) - 1)].astype(np.int64)
        rare = np.flatnonzero(hit & (code == 255))
        if len(rare):
            out[rare] = self.others[np.searchsorted(self.rare, at[rare])]
        out[~hit] = 0
        return out


class Table:
    """The files of one table, mapped on first use; those opened longest ago are let go."""

    def __init__(self, path: str, files: bytes, fields: int):
        self.path, self.fields = path, fields
        self.files, self.open = np.unpackbits(np.frombuffer(files, np.uint8)), {}

    def _file(self, bucket: int) -> TableFile:
        if bucket not in self.open:
            if len(self.open) >= OPEN:
                self.open.pop(next(iter(self.open)))
            self.open[bucket] = TableFile(f"{self.path}-{bucket}")
        return self.open[bucket]

    def find(self, bucket: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """A column for each of the keys' values, zeros where they are not there."""
        out = np.zeros((len(keys), self.fields), np.int64)
        order = np.argsort(bucket.astype(np.min_scalar_type(len(self.files))), kind="stable")
        there, edges = np.unique(bucket[order], return_index=True)
        for b, begin, end in zip(there.tolist(), edges.tolist(), [*edges[1:].tolist(), len(order)]):
            if self.files[b]:
                out[order[begin:end]] = self._file(b).find(keys[order[begin:end]])
        return out.T


#: Tables of the model that this worker used last.
_tables: dict[str, dict[str, Table]] = {}


def _opened(model: Model) -> dict[str, Table]:
    if model.folder not in _tables:
        _tables.clear()
        fields = {"w": len(FIELDS), "g": 1, "c": 4}
        _tables[model.folder] = {name: Table(f"{model.folder}/{name}", files, fields[name[0]]) for name, files in model.files.items()}
    return _tables[model.folder]


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def token_scores(model: Model, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 probability by the model, log10 probability by add-one counts, count in training) of each token."""
    tables, order = _opened(model), model.order
    words, own = np.unique(tokens, return_inverse=True)
    words = np.concatenate(([BEGIN], words))
    before, own = grams_of(own + 1, starts, 2, begin=0, pad=0)
    *context, preceding, count = tables["w"].find(bucket_of(words, model.layouts[order].parts), words)
    if len(model.heavy):
        names, sums = model.heavy_words
        at = np.minimum(np.searchsorted(names, words), len(names) - 1)
        context = [c + np.where(names[at] == words, s[at], 0) for c, s in zip(context, sums)]
    low = np.maximum(preceding - _discount(preceding, model.discounts[0]), 0) / max(1, model.pairs) + model.word_left / (model.words + 1)
    base = np.log10((count + 1) / (model.tokens + (model.words + 1)))
    score, context, seen = low[own], [c[before] for c in context], None
    grams = grams_of(tokens, starts, order)
    for k in range(2, order + 1):
        gram, d = grams[-k:], model.discounts[k - 1]
        first = (order - k) % 2 == 0  # k is the length that its stage counts; else a word shorter
        layout = model.layouts[k if first else k + 1]
        if k > 2:
            middle = gram_hash(gram[1:-1] if first else gram[:-1])
            context = tables[f"c{k - 1}"].find(layout.contexts(gram[:-1], middle), gram_hash(gram[:-1]))
            once = np.concatenate(([0], seen[:-1])) > 0  # the context is the n-gram that ends before
            once[starts] = False
            once &= context[0] == 0
            context = context + np.array([[1], [1], [0], [0]]) * once
        key = gram_hash(gram)
        (seen,) = tables[f"g{k}"].find(layout.grams(gram) if first else layout.shorter(gram), key)
        if not first and len(layout.pairs.keys):
            at = layout.pairs.find(key)
            seen = np.where(at >= 0, model.heavy[at], seen)
        total, once, twice, more = context
        left = np.where(total > 0, (d[0] * once + d[1] * twice + d[2] * more) / np.maximum(total, 1), 1.0)
        score = np.maximum(seen - _discount(seen, d), 0) / np.maximum(total, 1) + left * score
    return np.log10(score), base[own], count[own]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) of each row, scores in log10."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col))
            for begin, texts in text_slices(batch, text_col):
                tokens, starts = hashed(texts)
                scores, base, count = token_scores(model, tokens, starts)
                n = np.diff(np.concatenate((starts, [len(scores)])))
                total = np.add.reduceat(scores, starts)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, len(texts)), pa.array(n), pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(total), pa.array(10.0 ** (-total / n))],
                    names=[id_col, "n_tokens", "n_known", "base_score", "score", "perplexity"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def in_held_out(id_column: Column, folds: int = 7, held_out: int = 2) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % folds == held_out


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity): a model of that order of the documents outside one fold, applied to all."""
    model = train(docs.where(~in_held_out(F.col(id_col))), text_col, order=order)
    return score(docs, model, id_col, text_col).select(
        id_col, in_held_out(F.col(id_col)).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity"
    )
