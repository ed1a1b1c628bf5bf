"""Splitting of white-space chunks into the words that a byte-pair tokenizer file merges within, with the library's own rules."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import regex


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordSplitter:
    """Chunks (runs without ASCII white space) of a text can be split one by one: the splitter never joins over white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spec = json.loads(self.library.to_str())
        added = [t for t in self.spec["added_tokens"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens with matching options are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        try:
            pattern = self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            steps = [n["type"] for n in self.spec["normalizer"]["normalizers"]]
        except (KeyError, TypeError, IndexError):
            pattern, steps = None, []
        #: Below U+0250 composition changes nothing and letter classes and cases are the same in all Unicode versions in use.
        self.plain = regex.compile(pattern) if pattern and steps == ["NFC", "Replace", "Lowercase"] else None
        self.alphabet = _byte_alphabet()

    def simple_words(self, chunk: bytes) -> list[str] | None:
        """The chunk's words in lower case, not yet in the byte-level alphabet; None where `pieces` has to take the chunk."""
        if self.plain is None:
            return None
        if chunk.isalpha():  # ASCII letters alone
            return [chunk.decode().lower()]
        if chunk[-1:] in b",.;:" and chunk[:-1].isalpha():
            return [chunk[:-1].decode().lower(), chunk[-1:].decode()]
        text = chunk.decode()
        if b"<|" in chunk or max(text) >= "\u0250":
            return None
        return self.plain.findall(text.lower())

    def in_alphabet(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.alphabet)

    def pieces(self, chunk: str) -> Iterator[tuple[str, bool]]:
        """(word in the byte-level alphabet, False) or (special token, True), in order, by the library's own steps."""
        library = self.library
        for k, part in enumerate(self.special.split(chunk) if self.special else [chunk]):
            if k % 2:
                yield part, True
            elif part:
                for word, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part)):
                    yield word, False
