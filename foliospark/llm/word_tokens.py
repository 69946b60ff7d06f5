"""Encoding with a word-end BPE tokenizer."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from .byte_bpe import byte_alphabet, merges_of
from .word_store import LETTER, NUMBER, OTHER, SPACE, WordStore, code_points, contractions

#: Characters of text encoded together.
TOGETHER = 1 << 20
#: Texts with other characters are left to the library, whose lower-casing and composition may differ there.
LATIN = 0x250
_encoders: dict[str, WordEncoder] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _latin() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of Latin code points; kind 255 for those that only the library handles."""
    kind, lower = np.full(LATIN + 1, 255, np.uint8), np.zeros(LATIN + 1, np.uint32)
    for c in range(LATIN):
        low = chr(c).lower()
        if len(low) == 1 and unicodedata.is_normalized("NFC", chr(c)) and unicodedata.is_normalized("NFC", low) and (c >= 0x20 or c in (9, 10, 11, 12, 13)) and not 0x7F <= c < 0xA0:
            group = unicodedata.category(low)[0]
            kind[c] = SPACE if low.isspace() else LETTER if group == "L" else NUMBER if group == "N" else OTHER
            lower[c] = ord(low)
    return kind, lower


_KIND, _LOWER = _latin()


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers.

    The public pattern of this kind of tokenizer finds contractions, runs of letters, single numbers and runs
    of other characters; white space is dropped. Latin texts are lower-cased and split into such words on whole arrays, and
    distinct words are merged once; texts with other characters or special tokens go to the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = [c for c, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])]
        end = spec["model"]["end_of_word_suffix"]
        table, names = merges_of(spec, names + [c + end for c in names])
        self.store = WordStore(table, np.array([spec["model"]["vocab"][x] for x in names], np.uint32), end_mark=256)
        self.special = [t["content"] for t in spec["added_tokens"]]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= TOGETHER or i == len(texts) - 1:
                out += self._together(texts[start : i + 1])
                start, size = i + 1, 0
        return out

    def _together(self, texts: list[str]) -> list[bytes]:
        cp, bounds = code_points(texts)
        strange = np.concatenate(([0], np.cumsum(_KIND[np.minimum(cp, LATIN)] == 255)))[bounds]
        odd = [bool(s) or any(x in t for x in self.special) for s, t in zip(np.diff(strange), texts)]
        if any(odd):
            own = iter(self._together([t for t, o in zip(texts, odd) if not o]))
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if o else next(own) for t, o in zip(texts, odd)]
        low = _LOWER[cp]
        return self.store.texts(low, bounds, *self.split(low, _KIND[cp], bounds))

    @staticmethod
    def split(cp: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of lower-cased texts: where they begin and end."""
        n = len(cp)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        start = np.concatenate(([True], kind[1:] != kind[:-1])) | edge[:-1] | (kind == NUMBER)
        quote = np.flatnonzero((cp == 0x27) & start & np.concatenate((start[1:], [True])))
        if len(quote):
            long = contractions(cp, quote, bounds[np.searchsorted(bounds, quote, side="right")])
            quote, long = quote[long > 0], long[long > 0]
            start[quote + 1] = False
            rest = quote + 1 + long
            start[rest[rest < n]] = True
        at = np.flatnonzero(start)
        word = kind[at] != SPACE
        return at[word], np.append(at[1:], n)[word]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
