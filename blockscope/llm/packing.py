"""Vector bin packing of tokenized documents into training sequences.

Every document becomes its token ids plus one closing id. Whole multiples of the capacity form sequences of their own;
the remainders are packed: a bin is filled with the piece whose demand vector (tokens, one segment, loss-bearing
tokens) has the largest dot product with the room that the bin has left, as long as it fits in all three limits at
once. When nothing fits, a piece is cut to the room that is left, so that bins close full. Each task packs the rows it
tokenizes, from a pool of bounded size, without a shuffle; what is left at the end of a task is laid out in sequences
whose lengths are powers of two, which take no padding.

Null and empty texts are documents of the closing id alone. Repeated rows are packed each. Ties go to the piece that
came first. Columns other than the id, the text and the optional prompt length are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from blockscope.llm.common import text_slices
from blockscope.llm.splitter import WordSplitter

#: Words in a worker's cache; chunks may be twice as many. Those of more than LONG bytes, which seldom recur, are kept for
#: their text only, so that an entry takes about 0.2 KB.
CACHE, LONG = 600_000, 64
#: Pieces that wait in a task before bins are closed, and those that remain after.
POOL, KEEP = 2048, 512


class ChunkIds:
    """Token ids (4 little-endian bytes each) of texts, with a bounded cache by chunk and by word."""

    def __init__(self, path: str):
        self.splitter = WordSplitter(path)
        self.tokenize = self.splitter.library.model.tokenize
        self.words: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}

    def _ids(self, word: str) -> bytes:
        """Of a word in the byte-level alphabet."""
        return array("I", [t.id for t in self.tokenize(word)]).tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            ids = self._ids(self.splitter.in_alphabet(word))
            if len(word) <= LONG:
                self.words[word] = ids
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        words = self.splitter.simple_words(chunk)
        if words is not None:
            return b"".join([self._word(w) for w in words])
        added = self.splitter.added
        return b"".join([array("I", [added[w]]).tobytes() if special else self._ids(w) for w, special in self.splitter.pieces(chunk.decode())])

    def text(self, text: bytes) -> bytes:
        chunks, known = text.split(), self.chunks
        if len(known) >= 2 * CACHE:
            known.clear()
        new = set(chunks).difference(known)
        for chunk in new:
            known[chunk] = self._chunk(chunk)
        ids = b"".join(map(known.__getitem__, chunks))
        for chunk in new:
            if len(chunk) > LONG:
                del known[chunk]
        return ids


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkIds:
    """One for a worker process, whose next tasks find the cache filled."""
    return ChunkIds(path)


class Packer:
    """Pieces in, rows of (piece, sequence, offset) out. A piece: [document row, start, ids, first loss-bearing position]."""

    def __init__(self, capacity: int, max_segments: int, max_loss: int, first_sequence: int):
        self.limits = np.array([capacity, max_segments, max_loss], np.int64)
        self.capacity, self.next = capacity, first_sequence
        self.pool: list[list] = []
        self.due = POOL  # pieces in the pool at which bins are closed
        self.rows: list[tuple] = []

    @staticmethod
    def loss(piece: list) -> int:
        """Tokens of the piece at or after the document's first loss-bearing position."""
        n = len(piece[2]) // 4
        return min(n, max(0, piece[1] + n - piece[3]))

    def _emit(self, pieces: list[list]) -> None:
        offset = 0
        for piece in pieces:
            self.rows.append((*piece[0], piece[1], piece[2], self.next, offset))
            offset += len(piece[2]) // 4
        self.next += 1

    def add(self, key: tuple, ids: bytes, first_loss: int) -> None:
        size, start = 4 * self.capacity, 0
        while len(ids) - start >= size and self.loss([key, start // 4, ids[start : start + size], first_loss]) <= self.limits[2]:
            self._emit([[key, start // 4, ids[start : start + size], first_loss]])
            start += size
        while start < len(ids):
            self.pool.append([key, start // 4, ids[start : start + size], first_loss])
            start += size
        if len(self.pool) >= self.due:
            unfilled = self.pack(KEEP)
            self.pool += unfilled
            self.due = len(self.pool) + POOL - KEEP

    def pack(self, keep: int) -> list[list]:
        """Close full bins until at most `keep` pieces remain in the pool; an unfilled last bin is returned."""
        pool = self.pool
        demand = np.array([(len(p[2]) // 4, 1, self.loss(p)) for p in pool], np.int64).reshape(-1, 3)
        free = np.ones(len(pool), bool)
        scaled = demand / self.limits
        left, bin_, room = len(pool), [], self.limits.copy()
        while left > (keep if not bin_ else 0):
            fits = free & (demand <= room).all(axis=1)
            if fits.any():
                k = int(np.where(fits, scaled @ (room / self.limits), -1.0).argmax())
                bin_.append(pool[k])
                free[k] = False
                left -= 1
                room = room - demand[k]
            elif room[0] and room[1] and room[2]:
                k = int(np.where(free, demand[:, 0], -1).argmax())
                piece = pool[k]
                n = int(min(room[0], demand[k, 0] - 1, max(room[2], piece[3] - piece[1])))
                head = [piece[0], piece[1], piece[2][: 4 * n], piece[3]]
                pool[k] = piece = [piece[0], piece[1] + n, piece[2][4 * n :], piece[3]]
                bin_.append(head)
                room = room - np.array([n, 1, self.loss(head)])
                demand[k] = (len(piece[2]) // 4, 1, self.loss(piece))
                scaled[k] = demand[k] / self.limits
            else:
                room[:] = 0
            if not room[0] or not room[1] or not room[2]:
                self._emit(bin_)
                bin_, room = [], self.limits.copy()
        self.pool = [p for p, f in zip(pool, free) if f]
        return bin_

    def finish(self) -> None:
        """Lay the last, unfilled bin out in sequences of powers of two."""
        rest = self.pack(0)
        total = sum(len(p[2]) // 4 for p in rest)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            here = []
            while size:
                piece = rest.pop(0)
                n = min(size, len(piece[2]) // 4)
                here.append([piece[0], piece[1], piece[2][: 4 * n], piece[3]])
                if n < len(piece[2]) // 4:
                    rest.insert(0, [piece[0], piece[1] + n, piece[2][4 * n :], piece[3]])
                size -= n
            self._emit(here)


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", prompt_tokens_col: str | None = None,
    capacity: int = 2048, max_segments: int = 256, max_loss: int | None = None, end_id: int = 1, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset (and ids if asked for).

    prompt_tokens_col: how many leading tokens of the row bear no loss (an instruction's prompt); without it, or where it
    is null, all do but the first, which nothing predicts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = list(dict.fromkeys([id_col, text_col, *([prompt_tokens_col] if prompt_tokens_col else [])]))
    closing = np.array([end_id], "<u4").tobytes()
    loss_limit = capacity if max_loss is None else max_loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        packer = Packer(capacity, max_segments, loss_limit, (TaskContext.get().partitionId() + 1) << 33)

        def out(id_type: pa.DataType) -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            keys, tokens, first, starts, ids, sequences, offsets = (list(c) for c in zip(*rows)) if rows else [[]] * 7
            lengths = [len(x) // 4 for x in ids]
            made = [
                pa.array(keys, id_type), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(tokens, pa.int64()),
                pa.array([min(n, max(0, s + n - f)) for n, s, f in zip(lengths, starts, first)], pa.int64()), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()),
            ]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
            if with_ids:
                made.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(made, names=names)

        id_type = None
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(id_col))
            id_type = keys.type
            prompts = batch.column(batch.schema.get_field_index(prompt_tokens_col)).to_pylist() if prompt_tokens_col else None
            for begin, texts in text_slices(batch, text_col):
                for k, (key, text) in enumerate(zip(keys.slice(begin, len(texts)).to_pylist(), texts)):
                    ids = encoder.text(text) + closing
                    first = prompts[begin + k] if prompts and prompts[begin + k] is not None else 1
                    packer.add((key, len(ids) // 4, first), ids, first)
                yield out(id_type)
        if id_type is not None:
            packer.finish()
            yield out(id_type)

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(*columns).mapInArrow(run, schema)
