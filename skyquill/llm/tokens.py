"""Token ids of whole texts under the word-level BPE vocabulary, by a cache of words.

The tokenizer's normaliser and its splitting never look across white space, so the ids of a text are those of
its words in order. Each worker keeps the ids of the words it met of late and encodes only new ones, which Arrow's
dictionary encoding finds; the ids of texts are gathered from those of their words.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from skyquill.llm.textkit import IS_SEPARATOR, LOWER, let_go, word_borders

#: Words a worker remembers before it begins anew.
REMEMBERED = 200_000

_PUNCTUATION = ".,"
_ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

#: White space as the splitting patterns of byte-level vocabularies see it, in runs longer than their backtracking
#: should meet: they fail on very long ones.
WIDE_SPACE = re.compile(r"([\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,})")


def has_wide_space(text: str) -> bool:
    return len(text) >= 4096 and WIDE_SPACE.search(text) is not None


@cache
def vocabulary(name: str = "word_bpe_49k.json"):
    """The tokenizer of a public vocabulary file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@cache
def _letters() -> str:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(spare)) for b in range(256))


#: A byte that ends a word; no UTF-8 text holds it.
_WORD_END = b"\xff"


@cache
def _merges(name: str):
    """The merges of a word-level vocabulary as a byte-level one's: ids are in the order of merges, after single bytes and
    single bytes that end a word, so merging by least id is what the vocabulary's model does."""
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), encoding="utf-8") as file:  # installed with the library on every machine
        model = json.load(file)["model"]
    byte = {letter: b for b, letter in enumerate(_letters())}
    suffix = model["end_of_word_suffix"]
    ranks = {(bytes(byte[c] for c in word.removesuffix(suffix)) + (_WORD_END if word.endswith(suffix) and word != suffix else b"")): rank
             for word, rank in model["vocab"].items()}
    return tiktoken.Encoding(name, pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe


class WordEncoder:
    """Ids of words and texts as little-endian uint16; A-Z may be lower-cased by the caller, the vocabulary does so too."""

    def __init__(self, name: str = "word_bpe_49k.json", remembered: int = REMEMBERED) -> None:
        self.tokenizer = vocabulary(name)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary needs more than 16 bits an id")
        self.merge = _merges(name).encode_single_piece
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.parts: dict[bytes, list[int]] = {}  # of words with digits or marks
        #: ids of all known words on end, and where each word's begin
        self.ids, self.begins = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _new(self, word: bytes) -> list[int]:
        """What the vocabulary's splitting takes for one part goes straight to the merges, ASCII words in parts; any other
        word goes through the whole tokenizer."""
        if word.isascii():
            if word.isalpha():
                return self.merge(word + _WORD_END)
            if b"<|" not in word:
                return [i for part in _ASCII_PARTS.findall(word) for i in self._part(part)]
            return self._whole(word.decode())
        text = word.decode()
        stem = text.rstrip(_PUNCTUATION)
        low = stem.lower()
        # a letter that isn't one letter in lower case may join the punctuation
        if (low.isalpha() and len(low) == len(stem) and "Σ" not in stem and unicodedata.is_normalized("NFC", stem)
                and unicodedata.is_normalized("NFC", low)):
            return self.merge(low.encode() + _WORD_END) + (self._part(word[len(stem.encode()):]) if len(stem) < len(text) else [])
        return self._whole(text)

    def _part(self, part: bytes) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.parts[part] = self.merge(part + _WORD_END)
        return ids

    def _learn(self, words: list[bytes]) -> None:
        """Give numbers to new words and add their ids."""
        found = [self._new(word) for word in words]
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint16, int(lengths.sum()))])

    def rows(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of UTF-8 text on end, and their border in them (rows + 1 entries)."""
        low = LOWER[data]
        starts, ends, first = word_borders(low, borders)
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(len(borders), np.int64)
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        letters = low[~IS_SEPARATOR[low]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        if len(self.number) > self.remembered:
            self._forget()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([w for w in distinct if w not in self.number])
        distinct = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        which = distinct[coded.indices.to_numpy()]
        begins, counts = self.begins[which], self.begins[which + 1] - self.begins[which]
        upto = np.zeros(len(which) + 1, np.int64)
        np.cumsum(counts, out=upto[1:])
        places = np.repeat(begins - upto[:-1], counts) + np.arange(upto[-1])
        return self.ids[places], upto[first]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text."""
        borders = np.cumsum([0, *map(len, texts)])
        ids, first = self.rows(np.frombuffer(b"".join(texts), np.uint8), borders)
        return [ids[s:e].astype("<u2").tobytes() for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def forget() -> None:
    """Give back what encoding has left in a worker, which lives on for tasks of other kinds."""
    for held in (encoder, vocabulary, _merges):
        held.cache_clear()
    let_go()


@cache
def encoder(name: str = "word_bpe_49k.json") -> WordEncoder:
    """One encoder a worker process."""
    return WordEncoder(name)
