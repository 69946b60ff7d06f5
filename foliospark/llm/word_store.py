"""Token ids of words, found for whole batches of texts at a time."""

from __future__ import annotations

import numpy as np

from .bpe_tables import Merges
from .shingles import mix

#: Distinct words, and ids and letters of words, that a worker keeps (some 100 bytes a word); when full, it starts anew.
KEPT, KEPT_MORE = 1_000_000, 10_000_000
#: Words of more code points are encoded in each batch and not kept.
LONGEST = 64
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE, LETTER, NUMBER, OTHER = range(4)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and the bounds of the texts."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return cp, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] numbers, then begin[1], ..."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def utf8(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points, and how many each has."""
    n = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.repeat(np.arange(len(cp)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(n.sum()) - 1  # bytes after this one
    c, m = cp[at].astype(np.int64), n[at]
    lead = left == m - 1
    part = (c >> (6 * left)) & 0x3F | 0x80
    first = np.where(m == 1, c, (c >> (6 * left)) | np.array([0, 0, 0xC0, 0xE0, 0xF0])[m])
    return np.where(lead, first, part), n


def word_hashes(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word, of its code points and length; different words can share one."""
    n = len(cp) + 1
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(max(n, 1 << 20), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    total = np.zeros(n, np.uint64)
    np.cumsum(mix(cp.astype(np.uint64) + np.uint64(_BASE)) * _powers[0][: len(cp)], out=total[1:])
    return mix((total[end] - total[begin]) * _powers[1][begin] + (end - begin).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def differing(a: np.ndarray, a_begin: np.ndarray, b: np.ndarray, b_begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether words of equal sizes (none empty) in two arrays of code points differ."""
    if not len(size):
        return np.zeros(0, bool)
    return np.logical_or.reduceat(a[ranges(a_begin, size)] != b[ranges(b_begin, size)], np.cumsum(size) - size)


class WordStore:
    """Ids of distinct words, found by a hash and compared letter by letter: a word whose hash stands for another word is encoded by itself."""

    def __init__(self, table: Merges, id_of: np.ndarray, end_mark: int = 0):
        """``end_mark`` is added to the last byte of a word to give its symbol."""
        self.table, self.id_of, self.end_mark = table, id_of, end_mark
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.hash, self.slot = np.zeros(0, np.uint64), none  # of the words kept, by hash
        self.flat, self.begin, self.count = np.zeros(0, np.uint32), none, none  # ids by slot
        self.letters, self.at, self.size = np.zeros(0, np.uint32), none, none  # letters by slot

    def _encode(self, cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - begin
        raw, n = utf8(cp[ranges(begin, size)])
        bounds = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(size)))]
        raw[bounds[1:] - 1] += self.end_mark
        ages, count = self.table.encode(raw, np.diff(bounds))
        return self.id_of[ages], count

    def ids(self, cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each cp[begin:end] and not empty, one after another, and how many each has."""
        if len(self.hash) > KEPT or len(self.flat) + len(self.letters) > KEPT_MORE:
            self._clear()
        size = end - begin
        u, first, back = np.unique(word_hashes(cp, begin, end), return_index=True, return_inverse=True)
        own = first[back]
        alone = size != size[own]  # not the word that its hash stands for
        own[alone] = np.flatnonzero(alone)
        alone |= differing(cp, begin, cp, begin[own], size)
        at = np.searchsorted(self.hash, u)
        known = np.flatnonzero(self.hash[np.minimum(at, len(self.hash) - 1)] == u) if len(self.hash) else np.zeros(0, np.int64)
        slot = np.full(len(u), -1)
        slot[known] = self.slot[at[known]]
        good = self.size[slot[known]] == size[first[known]]
        like = known[good]
        good[good] = ~differing(cp, begin[first[like]], self.letters, self.at[slot[like]], size[first[like]])
        if not good.all():
            other = np.zeros(len(u), bool)
            other[known[~good]] = True
            alone |= other[back]
        new = np.flatnonzero(slot < 0)
        single = np.flatnonzero(alone)
        todo = np.concatenate([first[new], single])
        place = len(self.count) + np.arange(len(todo))
        slot[new] = place[: len(new)]
        word = slot[back]
        word[single] = place[len(new) :]
        if len(todo):
            ids, count = self._encode(cp, begin[todo], end[todo])
            short = size[todo] <= LONGEST
            short[len(new) :] = False
            letters = np.where(short, size[todo], 0)
            self.at = np.concatenate([self.at, len(self.letters) + np.cumsum(letters) - letters])
            self.size = np.concatenate([self.size, letters])
            self.letters = np.concatenate([self.letters, cp[ranges(begin[todo[short]], size[todo[short]])]])
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
            self.flat, self.count = np.concatenate([self.flat, ids]), np.concatenate([self.count, count])
            kept = new[short[: len(new)]]
            self.hash, self.slot = np.insert(self.hash, at[kept], u[kept]), np.insert(self.slot, at[kept], slot[kept])
        count = self.count[word]
        return self.flat[ranges(self.begin[word], count)], count

    def texts(self, cp: np.ndarray, bounds: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The ids of each text as bytes, from its words in order."""
        if not len(begin):
            return [b""] * (len(bounds) - 1)
        ids, count = self.ids(cp, begin, end)
        cut = 4 * np.concatenate(([0], np.cumsum(count)))[np.searchsorted(begin, bounds)]
        raw = ids.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def contractions(cp: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many characters after the apostrophes at ``at`` belong to 's, 't, 'm, 'd, 're, 've or 'll (0 for none); ``last`` bounds their texts."""
    padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
    a = np.where(at + 1 < last, padded[at + 1], 0)
    b = np.where(at + 2 < last, padded[at + 2], 0)
    s, t, m, d, r, e, v, ell = map(ord, "stmdrevl")
    one = (a == s) | (a == t) | (a == m) | (a == d)
    two = ((a == r) & (b == e)) | ((a == v) & (b == e)) | ((a == ell) & (b == ell))
    return np.where(one, 1, np.where(two, 2, 0))
