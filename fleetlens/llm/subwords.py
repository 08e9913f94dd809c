"""Subword ids of a public word vocabulary (``word_bpe_49k.json``), word by word.

No token of this vocabulary crosses ASCII white space, so a text's ids are the ids of its words one after the other, and a
word is encoded once for all its places in a batch. Words of plain Latin letters, digits and punctuation are split and
lower-cased here and their byte pairs merged by tiktoken over the same ranks (the end-of-word mark is the byte 0xFF, which
UTF-8 never has); any other word, and any that may hold a special token, goes to the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrowio import texts

END_MARK = "</w>"

PLAIN = re.compile("[!-~À-ÖØ-öø-ÿŒœ¡¿«»‘’“”–—…€]*")
"""Characters for which lower case, composition and classes agree between Python and the tokenizers library."""

# Fixed value: the vocabulary's own rule for cutting a word.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

CACHED_WORDS = 200_000
"""Encoded words that a task keeps between batches; it only saves work."""


WHOLE = " "
"""Put before a part that is a whole word for the tokenizers library; no other part holds a space."""


def parts(word: str) -> list[str]:
    """The parts of a word that are encoded on their own: lower-cased runs of one kind, or the word itself behind ``WHOLE``."""
    if PLAIN.fullmatch(word) and "<|" not in word:
        return PIECES.findall(word.lower())
    return [WHOLE + word]


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordVocabulary:
    """Encodes words with one vocabulary file; ids are kept as little-endian integers of ``width`` bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte = byte_of_character()
        ranks = {}
        for token, number in vocabulary.items():
            ends = token.endswith(END_MARK)
            raw = bytes(byte[c] for c in (token[: -len(END_MARK)] if ends else token))
            ranks[raw + b"\xff" if ends else raw] = number
        self.core = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}

    def ids(self, word: str) -> list[int]:
        """The ids of a word, which must hold no ASCII white space."""
        found: list[int] = []
        for part in parts(word):
            found += self.part_ids(part)
        return found

    def part_ids(self, part: str) -> list[int]:
        if part[0] == WHOLE:
            return self.library.encode(part[1:], add_special_tokens=False).ids
        return self.core.encode_single_piece(part.encode() + b"\xff")

    def pieces(self) -> list[tuple[int, str]]:
        """All ids with the piece that decoding writes for each."""
        return sorted((number, piece) for piece, number in self.library.get_vocab(with_added_tokens=True).items())

    def packed(self, words: list[str]) -> list[bytes]:
        """The ids of each word as bytes."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, out = self.known, []
        for word in words:
            value = known.get(word)
            if value is None:
                value = known[word] = np.array(self.ids(word), self.type).tobytes()
            out.append(value)
        return out

    def encode(self, column: pa.Array) -> pa.Array:
        """The ids of each text as bytes; null is the empty text."""
        words = pc.ascii_split_whitespace(texts(column))
        coded = words.flatten().dictionary_encode()
        table = pa.array(self.packed(coded.dictionary.to_pylist()), pa.binary())
        return pc.binary_join(pa.ListArray.from_arrays(words.offsets, table.take(coded.indices)), b"")


@lru_cache(maxsize=2)
def word_vocabulary(path: str) -> WordVocabulary:
    """One loaded vocabulary per Python worker."""
    return WordVocabulary(path)
