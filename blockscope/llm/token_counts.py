"""Token counts by prefix dynamic programming over byte-pair encodings.

For one word, a table row per prefix holds the last token of the prefix's encoding and its token count. The
encoding of a prefix ends with the only token `t` such that `t` ends there and the pair (last token before `t`, `t`)
re-encodes to itself; so each row follows from earlier rows, and no prefix is encoded again. Words are independent
(the tokenizer never merges across word borders), so the count at any prefix of a text is a running sum over its words
plus one entry of the table of the word that is cut. Where the cut itself may change how the last word is split or
normalised (in words of at most SHORT characters, inside a special token, between a letter and its combining marks), that
word alone is split again.

Null and empty texts have no tokens; an empty table gives no rows. Repeated rows are counted each. Columns of the input
other than the id and the text are not read. Counts of words and chunks of up to LONG bytes are kept per worker in caches
of bounded size; clearing them costs time, not results. The work is linear in the length of a text, spaces or not.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockscope.llm.common import text_slices
from blockscope.llm.splitter import WordSplitter

#: Words in a worker's cache, chunks being twice as many, and the longest that are kept, in bytes.
CACHE, LONG = 400_000, 64
#: No split rule that turns on a word's end looks at more characters: the longest are contractions like 're.
SHORT = 4
END = "</w>"


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes under a word-end BPE tokenizer file."""

    def __init__(self, path: str):
        self.splitter = WordSplitter(path)
        model = self.splitter.spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
            raise ValueError("the prefix tables need a BPE model with word ends")
        self.vocab: set[str] = set(model["vocab"])
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.stable: dict[tuple[str, str], bool] = {}
        self.words: dict[str, int] = {}
        self.chunks: dict[bytes, int] = {}

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair merging, used on pairs of tokens only."""
        rank = self.rank
        while len(symbols) > 1:
            best, at = min((rank.get(pair, 1 << 40), k) for k, pair in enumerate(zip(symbols, symbols[1:])))
            if best == 1 << 40:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    @staticmethod
    def _symbols(token: str) -> list[str]:
        body = token.removesuffix(END)
        out = list(body)
        if body is not token and len(body) != len(token):
            out[-1] += END
        return out

    def _fits(self, left: str, right: str) -> bool:
        """Whether the encoding of left + right is the two tokens themselves."""
        ok = self.stable.get((left, right))
        if ok is None:
            ok = self._merge([*self._symbols(left), *self._symbols(right)]) == [left, right]
            if len(self.stable) >= 4 * CACHE:
                self.stable.clear()
            self.stable[left, right] = ok
        return ok

    def table(self, word: str) -> tuple[list[str], list[int]]:
        """For each prefix of the word, not taken as a whole word: the last token of its encoding, and its token count."""
        return self._grown(word, [""], [0])

    def _grown(self, word: str, last: list[str], count: list[int]) -> tuple[list[str], list[int]]:
        """Add the rows that a table lacks. It may begin within a word, at least the longest token before the first new row."""
        vocab, longest, stable, fits = self.vocab, self.longest, self.stable, self._fits
        for end in range(len(last), len(word) + 1):
            for begin in range(max(0, end - longest), end):
                token = word[begin:end]
                if token in vocab and (not last[begin] or ((ok := stable.get((last[begin], token))) or (ok is None and fits(last[begin], token)))):
                    last.append(token)
                    count.append(count[begin] + 1)
                    break
            else:  # a symbol that the vocabulary lacks: the library emits nothing for it
                raise KeyError(word[end - 1])
        return last, count

    def _closed_with(self, word: str, end: int, last: list[str], count: list[int], tail: str) -> int:
        """The token count of word[:end] + tail as a whole word."""
        begin = max(0, end - self.longest)
        near = word[begin:end] + tail
        return self.closed(near, len(near), *self._grown(near[:-1], last[begin : end + 1], count[begin : end + 1]))

    def closed(self, word: str, end: int, last: list[str], count: list[int]) -> int:
        """The token count of word[:end] as a whole word: one more step, onto a token with a word end."""
        for begin in range(max(0, end - self.longest), end):
            token = word[begin:end] + END
            if token in self.vocab and (not last[begin] or self._fits(last[begin], token)):
                return count[begin] + 1
        raise KeyError(word)

    def _closed_count(self, word: str) -> int:
        last, count = self.table(word[:-1])
        return self.closed(word, len(word), last, count)

    def word_count(self, word: str) -> int:
        """Of a word in lower case: the last entry of its table."""
        n = self.words.get(word)
        if n is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            n = self._closed_count(self.splitter.in_alphabet(word))
            if len(word) <= LONG:
                self.words[word] = n
        return n

    def _count(self, chunk: bytes) -> int:
        words = self.splitter.simple_words(chunk)
        if words is not None:
            return sum([self.word_count(w) for w in words])
        return sum(1 if special else self._closed_count(word) for word, special in self.splitter.pieces(chunk.decode()))

    def total(self, text: bytes) -> int:
        chunks, known = text.split(), self.chunks
        if len(known) >= 2 * CACHE:
            known.clear()
        new = set(chunks).difference(known)
        for chunk in new:
            known[chunk] = self._count(chunk)
        total = sum(map(known.__getitem__, chunks))
        for chunk in new:
            if len(chunk) > LONG:
                del known[chunk]
        return total

    def cut(self, text: bytes, limit: int) -> int:
        """The most characters that a prefix of at most `limit` tokens can have. Only the chunk in which the running count passes
        the limit needs its prefixes' counts: after it, no prefix has fewer tokens."""
        base, seen = 0, text.decode()
        for match in re.finditer(r"([\x20\x09-\x0D]*)([^\x20\x09-\x0D]*)", seen):
            chunk = match[2]
            if not chunk:
                continue
            known = self.chunks.get(chunk.encode())
            n = base + (self._count(chunk.encode()) if known is None else known)
            if n > limit:
                counts = self._chunk_prefixes(chunk)
                fits = [k for k, more in enumerate(counts, 1) if base + more <= limit]
                return match.start(2) + (fits[-1] if fits else 0)
            base = n
        return len(seen)

    def prefixes(self, text: str) -> list[int]:
        """The token count of text[:i] for i from 0 to len(text)."""
        out, base = [0], 0
        for gap, chunk in re.findall(r"([\x20\x09-\x0D]*)([^\x20\x09-\x0D]*)", text):
            out += [base] * len(gap)
            if chunk:
                out += [base + n for n in self._chunk_prefixes(chunk)]
                base = out[-1]
        return out

    def _chunk_prefixes(self, chunk: str) -> list[int]:
        """For the prefixes of 1, 2, ... characters."""
        lowered = chunk.lower()
        if chunk.isascii() and chunk.isalpha():  # one word whose normal form has a symbol for each character
            last, count = self.table(lowered)
            return [self.closed(lowered, k, last, count) for k in range(1, len(chunk) + 1)]
        out, base = [], 0
        parts = self.splitter.special.split(chunk) if self.splitter.special else [chunk]
        for part, special in zip(parts[::2], [*parts[1::2], ""]):
            counts = self._plain_prefixes(part + special[:-1])  # a special token that is cut is plain text
            out += [base + n for n in counts[1:]]
            base += counts[len(part)]
            if special:
                base += 1
                out.append(base)
        return out

    def _plain_prefixes(self, text: str) -> list[int]:
        """For the prefixes of 0, 1, ... characters of a text in which no special token is whole."""
        normal, split = self.splitter.library.normalizer.normalize_str, self.splitter.library.pre_tokenizer.pre_tokenize_str
        clusters = _clusters(text)
        forms = [normal(c) for c in clusters]
        whole = "".join(forms)
        if whole != normal(text):  # not met so far: a normal form that reaches over clusters
            return [self._count(text[:k].encode()) if k else 0 for k in range(len(text) + 1)]
        counts, before, end, base = [0] * (len(whole) + 1), [(k, 0, 0) for k in range(len(whole) + 1)], 0, 0
        tables: dict[int, tuple[str, list[str], list[int]]] = {}  # of long words, by where they begin
        for word, (begin, stop) in [*split(whole), ("", (len(whole), len(whole)))]:
            for k in range(end + 1, begin + 1):  # between words
                counts[k], before[k] = base, (k, base, 0)
            if stop - begin == 1:
                counts[stop] = base + self._closed_count(word)
            elif stop - begin <= SHORT:
                for k in range(begin + 1, stop + 1):
                    counts[k] = base + sum(self._closed_count(w) for w, _ in split(whole[begin:k]))
            else:
                tables[begin] = word, *self.table(word)
            for k, size in enumerate(accumulate(len(c.encode()) for c in whole[begin:stop]), begin + 1):
                before[k] = (begin, base, size)
                if begin in tables:
                    counts[k] = base + self.closed(word, size, *tables[begin][1:])
            base, end = counts[stop], stop
        out, at = [0], 0
        for cluster, form in zip(clusters, forms):
            begin, base, size = before[at]
            long = begin in tables and at - begin >= SHORT
            if at - begin < SHORT:  # the word before may take part
                begin, base, _ = before[begin]
            for k in range(1, len(cluster)):  # cut off its combining marks
                tail = normal(cluster[:k])
                n = 0
                if long:  # as much of the tail as continues the word, by the word's last characters
                    ((_, (_, stop)), *words) = split(whole[at - 2 : at] + tail)
                    word, last, count = tables[begin]
                    n = self._closed_with(word, size, last, count, self.splitter.in_alphabet(tail[: stop - 2])) if stop > 2 else self.closed(word, size, last, count)
                else:
                    words = split(whole[begin:at] + tail)
                out.append(base + n + sum(self._closed_count(w) for w, _ in words))
            at += len(form)
            out.append(counts[at])
        return out


def _clusters(text: str) -> list[str]:
    """The text cut where normal forms don't reach over: before each character that is neither a mark nor a Hangul vowel or final."""
    starts = [k for k, c in enumerate(text) if not k or c < "\u0300" or not (unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff")]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


@lru_cache(maxsize=1)
def _counter(path: str) -> PrefixCounter:
    """One for a worker process, whose next tasks find the cache filled."""
    return PrefixCounter(path)


def _per_text(path: str, text_col: str, keep: list[str], fields: list[tuple[str, pa.DataType]], row: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for begin, texts in text_slices(batch, text_col):
                part = batch.slice(begin, len(texts))
                made = list(zip(*(row(counter, t) for t in texts)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in keep] + [pa.array(v, kind) for v, (_, kind) in zip(made, fields)],
                    names=[*keep, *(n for n, _ in fields)],
                )

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, chars_within) for each row: the last entry of each text's prefix counts, and the most
    characters that a prefix within the limit can have, by the counts at the prefixes of the word that is cut."""
    kind = docs.schema[id_col].dataType.simpleString()

    def row(counter: PrefixCounter, text: bytes) -> tuple[int, int, int]:
        n = counter.total(text)
        return len(text), n, counter.cut(text, limit) if n > limit else len(text) if text.isascii() else len(text.decode())

    run = _per_text(tokenizer_path, text_col, [id_col], [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("chars_within", pa.int64())], row)
    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, chars_within long")
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "chars_within")


def prefix_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prefix_tokens): element i (from 0) is the exact token count of the text's first i characters."""
    kind = docs.schema[id_col].dataType.simpleString()
    run = _per_text(tokenizer_path, text_col, [id_col], [("prefix_tokens", pa.list_(pa.int32()))], lambda c, t: (c.prefixes(t.decode()),))
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, prefix_tokens array<int>")


def tokens_at(prefix_tokens: Column, n_chars: Column) -> Column:
    """Token count of the first n_chars characters, read from the stored counts."""
    return F.get(prefix_tokens, F.least(n_chars.cast("int"), F.size(prefix_tokens) - 1))


def chars_within(prefix_tokens: Column, budget: int) -> Column:
    """The most characters that a prefix of at most `budget` tokens can have, read from the stored counts."""
    fits = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits)
