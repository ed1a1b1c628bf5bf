"""Byte-pair encoding by a pair occurrence index, and decoding.

The words that a batch of texts brings are encoded together. Their symbols lie in one array, in which an index maps each
pair that has a rank to all positions where it stands. Active ranks are taken in ascending order: every occurrence of the
pair is merged from left to right, and the pairs that a merge makes with its neighbours join the lists of their own ranks.
Entries of pairs that are no more are passed over when their turn comes. This gives what merging word by word gives,
because a pair that a merge makes always has a higher rank than that merge; files for which that doesn't hold are an error.

Texts are cut into white-space chunks and these into words by the library's own rules (`splitter.py`). Null and empty
texts have no tokens and decode to an empty text; an empty table gives no rows. Repeated rows are encoded each, ids of
rows may be null, and columns other than the id and the text are not read. Words longer than a batch are a batch of their
own: memory is bounded by BATCH symbols, the caches, and one text. Caches hold chunks and words of up to LONG bytes;
clearing them costs time, not results.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockscope.llm.common import text_slices
from blockscope.llm.splitter import WordSplitter

#: Entries of a worker's caches (words, and as many chunks), and the longest that are kept, in bytes.
CACHE, LONG = 300_000, 64
#: Symbols that are indexed together, and bytes of text that are taken together.
BATCH, SLICE = 1 << 18, 2 << 20
END = "</w>"


def _bytes(ids: Iterable[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def _ids(data: bytes) -> array:
    out = array("I", data)
    if sys.byteorder != "little":
        out.byteswap()
    return out


class PairIndex:
    """Ranks and ids of a tokenizer file, and the merging of many words at once."""

    def __init__(self, spec: dict, alphabet: list[str]):
        model = spec["model"]
        plain = model["type"] == "BPE" and model.get("end_of_word_suffix") == END
        if not plain or any(model.get(option) for option in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("the pair index needs a plain BPE model with word ends")
        vocab: dict[str, int] = model["vocab"]
        self.inner, self.final = (np.full(max(map(ord, alphabet)) + 1, -1, np.int64) for _ in range(2))
        for c in alphabet:
            self.inner[ord(c)], self.final[ord(c)] = vocab[c], vocab[c + END]
        self.rank: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []  # left, right, merged
        made: set[int] = set()
        there = {*self.inner.tolist(), *self.final.tolist()}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            token = vocab[left + right]
            if token in made or vocab[left] not in there or vocab[right] not in there:
                raise ValueError(f"merge {rank} makes a token again or takes one that only a later merge makes")
            made.add(token)
            there.add(token)
            self.rank[vocab[left] << 32 | vocab[right]] = rank
            self.merges.append((vocab[left], vocab[right], token))
        self.pairs, self.ranks = (np.array(v, np.int64) for v in zip(*sorted(self.rank.items())))

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word (not empty, in the byte-level alphabet)."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(w) for w in words])
        ids = self.inner[points]
        ids[ends - 1] = self.final[points[ends - 1]]
        at = self._occurrences(ids, ends)
        symbols: list[int] = ids.tolist()
        # links to the neighbours within a word; -1 is a word's border
        after, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        after[ends - 1] = before[ends[:-1]] = -1
        self._merge(symbols, after.tolist(), before.tolist(), at)
        left = np.array(symbols, np.int64)
        data, upto = left[left >= 0].astype("<u4").tobytes(), (4 * np.cumsum(left >= 0)[ends - 1]).tolist()
        return [data[x:y] for x, y in zip([0, *upto], upto)]

    def _occurrences(self, ids: np.ndarray, ends: np.ndarray) -> dict[int, list[int]]:
        """The index: rank of a pair to the positions of its left symbol, ascending."""
        pairs = ids[:-1] << 32 | ids[1:]
        near = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        ranks = np.where(self.pairs[near] == pairs, self.ranks[near], -1)
        ranks[ends[:-1] - 1] = -1  # over a word's border
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        found, starts = np.unique(ranks[order], return_index=True)
        order, stops = order.tolist(), [*starts[1:].tolist(), len(order)]
        return {r: order[x:y] for r, x, y in zip(found.tolist(), starts.tolist(), stops)}

    def _merge(self, symbols: list[int], after: list[int], before: list[int], at: dict[int, list[int]]) -> None:
        rank = self.rank
        active = list(at)
        heapify(active)
        while active:
            r = heappop(active)
            left, right, token = self.merges[r]
            places = at.pop(r)
            if left == right:  # only here does it matter which of two overlapping places comes first
                places.sort()
            for k in places:
                if symbols[k] != left:
                    continue
                gone = after[k]
                if gone < 0 or symbols[gone] != right:
                    continue
                symbols[k], symbols[gone] = token, -1
                after[k] = following = after[gone]
                if following >= 0:
                    before[following] = k
                    new = rank.get(token << 32 | symbols[following])
                    if new is not None:
                        if new in at:
                            at[new].append(k)
                        else:
                            at[new] = [k]
                            heappush(active, new)
                previous = before[k]
                if previous >= 0:
                    new = rank.get(symbols[previous] << 32 | token)
                    if new is not None:
                        if new in at:
                            at[new].append(previous)
                        else:
                            at[new] = [previous]
                            heappush(active, new)

class PairIndexEncoder:
    """Texts to ids with bounded caches by chunk and by word."""

    def __init__(self, path: str):
        self.splitter = WordSplitter(path)
        self.index = PairIndex(self.splitter.spec, list(self.splitter.alphabet.values()))
        self.words: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}

    def _split(self, chunk: bytes) -> list[str | int]:
        """Words in the byte-level alphabet, and ids of special tokens."""
        splitter = self.splitter
        words = splitter.simple_words(chunk)
        if words is not None:
            return [splitter.in_alphabet(w) for w in words]
        return [splitter.added[w] if special else w for w, special in splitter.pieces(chunk.decode())]

    def _encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        batch, size = [], 0
        for word in words:
            batch.append(word)
            size += len(word)
            if size >= BATCH:
                out.update(zip(batch, self.index.encode(batch)))
                batch, size = [], 0
        out.update(zip(batch, self.index.encode(batch)))
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text: 4 little-endian bytes each."""
        known, words = self.chunks, self.words
        cut = [text.split() for text in texts]
        if len(known) >= CACHE:
            known.clear()
        if len(words) >= CACHE:
            words.clear()
        new: set[bytes] = set()
        for chunks in cut:
            new.update(chunks)
        new.difference_update(known)
        split = {chunk: self._split(chunk) for chunk in new}
        fresh = {w for parts in split.values() for w in parts if type(w) is str}.difference(words)
        words.update(self._encode_words(fresh))
        for chunk, parts in split.items():
            known[chunk] = words[parts[0]] if len(parts) == 1 and type(parts[0]) is str else b"".join([words[w] if type(w) is str else _bytes([w]) for w in parts])
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        for chunk in new:
            if len(chunk) > LONG:
                del known[chunk]
        for word in fresh:
            if len(word) > LONG:
                del words[word]
        return out


class Decoder:
    """Ids to text as the library joins them: tokens with a space between; ids that are no token give nothing."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        if library.decoder is not None:
            raise ValueError("the tokenizer file has a decoder of its own")
        self.tokens = {k: t for t, k in library.get_vocab(with_added_tokens=True).items()}

    def decode(self, ids: bytes) -> str:
        return " ".join([t for t in map(self.tokens.get, _ids(ids)) if t is not None])


@lru_cache(maxsize=1)
def _encoder(path: str) -> PairIndexEncoder:
    """One for a worker process, whose next tasks find the caches filled."""
    return PairIndexEncoder(path)


@lru_cache(maxsize=1)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, n_tokens, token_ids) for each row; token_ids is binary, 4 little-endian bytes for each id. No shuffle. With
    `decoded`, also the text that the ids decode to, made in the same worker, as from `decode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            for begin, texts in text_slices(batch, text_col, SLICE):
                ids = encoder.encode(texts)
                part = batch.slice(begin, len(texts))
                columns = [part.column(part.schema.get_field_index(id_col)), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array(map(_decoder(tokenizer_path).decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "token_ids", "decoded"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, token_ids binary" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "token_ids") -> DataFrame:
    """The rows with the text that their ids (binary, as from `encode`) decode to, as `decoded`. Null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(tokenizer_path)
        for batch in batches:
            at, begin = batch.schema.get_field_index(ids_col), 0
            while begin < batch.num_rows:
                texts, size, end = [], 0, begin
                while end < batch.num_rows and size < SLICE:
                    ids = batch.column(at)[end].as_py()
                    texts.append(None if ids is None else decoder.decode(ids))
                    size, end = size + len(ids or b""), end + 1
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])
                begin = end

    if "decoded" in encoded.columns:
        raise ValueError("the rows have a column named decoded already")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded string")
