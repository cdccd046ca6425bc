"""Whole texts to token ids, one library call per distinct word and worker.

The three public vocabularies never merge across the white space in front of a word, so the ids of a
text are the ids of its words in a row. A worker therefore keeps the ids of the words that it has met
and asks the library only for new ones. Texts whose white space is anything else than single spaces
and single line feeds between words go to the library whole. Every id comes from the library.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words that a worker keeps; at the bound the memory is emptied, which costs time and nothing else.
MEMORY_WORDS = 900_000

#: Letters whose case mapping, composition and class are the same in every Unicode version, then ASCII marks.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]*)([!-&(-/:-@\\[-`{-~]*)")


def plain_spacing(text: str) -> bool:
    """True if words stand apart by exactly one space or one line feed, with none at the ends."""
    return " ".join(text.split()) == text.replace("\n", " ")


def _byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in kept]
    return {b: b if b in kept else 256 + rest.index(b) for b in range(256)}


class _Memory(dict):
    """Ids, as little-endian 32-bit integers, by word; unknown words are encoded on demand."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.encode(word)
        return ids


def _packed(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordCodec:
    """encode(text) gives the ids as bytes; keys are ' '-separated words, '\\n' in front after a line feed."""

    def __init__(self):
        self.memory = _Memory(self._word)
        self.first = _Memory(self._first)

    def encode(self, text: str) -> bytes:
        if not text or not plain_spacing(text):
            return self.whole(text)
        if len(self.memory) > MEMORY_WORDS:
            self.memory.clear()
        if len(self.first) > MEMORY_WORDS // 8:
            self.first.clear()
        head, *rest = text.replace("\n", " \n").split(" ")
        return self.first[head] + b"".join(map(self.memory.__getitem__, rest))


class LibraryCodec(WordCodec):
    """A `tokenizers` file. byte_level: words carry the space in front of them; else white space is dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.byte_level = self.library.normalizer is None
        self.alphabet = _byte_alphabet()
        self.marks = _Memory(self.whole)

    def whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids) if text else b""

    def _letters(self, word: str, spaced: bool = True) -> bytes:
        """One run of letters, with the space before it where the vocabulary has it: a single pre-token."""
        if not self.byte_level:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return _packed([t.id for t in self.model.tokenize("Ġ" + word if spaced and self.byte_level else word)])

    def _word(self, word: str) -> bytes:
        """Letters and then marks are two pre-tokens at most; anything else is the library's to split."""
        if word.isascii() and word.isalpha():
            return self._letters(word)
        if word[:1] == "\n":
            return (self.marks["\n"] if self.byte_level else b"") + self._first(word[1:])
        if (m := _PLAIN.fullmatch(word)) and m[1]:
            return self.memory[m[1]] + self.marks[m[2]] if m[2] else self._letters(word)
        return self.whole(" " + word)

    def _first(self, word: str) -> bytes:
        if (m := _PLAIN.fullmatch(word)) and m[1]:
            return self._letters(m[1], False) + (self.marks[m[2]] if m[2] else b"")
        return self.whole(word)


@lru_cache(maxsize=4)
def library_codec(name_or_path: str) -> LibraryCodec:
    """The codec of a file, made once per worker; a bare name is looked up among the public tokenizers."""
    return LibraryCodec(tokenizer_path(name_or_path))


def tokenizer_path(name_or_path: str) -> str:
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)
