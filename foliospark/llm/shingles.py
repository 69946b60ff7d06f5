"""Five-word shingle sets as 128-bit digests, computed on whole Arrow buffers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP = (np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15))
#: Bytes of text handled at a time; a longer text is a slice of its own.
SLICE = 1 << 20
#: Bytes of a word that is long.
LONG = 256

#: A set of shingles: the two halves of its digests, ascending by the first, then the second half.
Set = tuple[np.ndarray, np.ndarray]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE bytes each."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, s in enumerate(size.tolist()):
        if total + s > SLICE and i > start:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(size):
        yield start, len(size)


def shingle_sets(texts: pa.Array) -> Iterator[Set]:
    """For each text the digests of its distinct shingles.

    Words are runs of bytes outside space and U+0009..U+000D with A-Z lower-cased. A
    text of one to four words has the whole sequence as its one shingle; a null text
    or one without words has none.

    A word has a digest of 128 bits, and a shingle's digest mixes those of its words in
    order. Two different shingles share a digest with a chance of about 2^-120, so sets
    of n and m shingles are miscounted with a chance of about n * m * 2^-120.
    """
    for lo, hi in slices(texts):
        yield from _sets(texts.slice(lo, hi - lo))


def _digests(letters: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128-bit digests of words, as two columns: eight letters at a time go through the mixer of either half; long words have BLAKE2 digests."""
    padded = np.concatenate([letters, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(letters) + 1, np.uint64, padded, strides=(1,))  # the eight letters from each place on
    out = np.empty((len(begin), 2), np.uint64)
    out[:] = size[:, None].astype(np.uint64) * np.array(_STEP)
    live = np.flatnonzero(size <= LONG)
    at, left = begin[live], size[live]
    a, b = out[live, 0], out[live, 1]
    while len(live):
        part = eight[at] & _FIRST[np.minimum(left, 8)]
        a = mix((a ^ part) * _STEP[1])
        b = mix((b + part) * _STEP[0] ^ (a >> np.uint64(7)))
        out[live, 0], out[live, 1] = a, b
        on = left > 8
        live, at, left, a, b = live[on], at[on] + 8, left[on] - 8, a[on], b[on]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(letters[begin[i] : begin[i] + size[i]], digest_size=16).digest(), np.uint64)
    return out


def _chained(digests: np.ndarray, n: int, half: int) -> np.ndarray:
    """Digests of every n words in a row."""
    m = len(digests) - n + 1
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = mix(h * _STEP[half] + digests[k : k + m, half])
    return h


def _ascending(a: np.ndarray, b: np.ndarray) -> Set:
    order = np.argsort(a)
    x, y = a[order], b[order]
    again, differ = x[1:] == x[:-1], y[1:] != y[:-1]
    if (again & differ).any():  # equal in the first half only
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        again = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    keep = np.concatenate(([True], ~again))
    return x[keep], y[keep]


def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each digest, equal for equal digests; the numbers are 0 to their count less one."""
    _, first, at = np.unique(a, return_index=True, return_inverse=True)
    if (b != b[first[at]]).any():  # equal in the first half only
        _, at = np.unique(np.column_stack([a, b]), axis=0, return_inverse=True)
    return at.ravel()


def common(x: Set, y: Set) -> int:
    """How many digests two sets share."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    if not len(x[0]):
        return 0
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    same = y[0][at] == x[0]
    if (y[1][at] != x[1])[same].any():  # equal in the first half only
        return len(set(zip(*(h.tolist() for h in x))) & set(zip(*(h.tolist() for h in y))))
    return int(same.sum())


def to_bytes(x: Set) -> bytes:
    return x[0].tobytes() + x[1].tobytes()


def _sets(texts: pa.Array) -> Iterator[Set]:
    part = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = part.buffers()
    off = np.frombuffer(offs, np.int64)[part.offset : part.offset + len(part) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    word = ~_BLANK[raw]
    if not word.any():
        yield from (none for _ in range(len(part)))
        return
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    ws = np.flatnonzero(start)
    letters = _LOWER[raw[word]]
    begin = np.cumsum(word)[ws] - 1  # where each word begins among the letters
    digests = _digests(letters, begin, np.diff(np.append(begin, len(letters))))
    count = np.searchsorted(ws, off)  # words before each text
    a, b = (_chained(digests, WORDS, half) for half in (0, 1)) if len(ws) >= WORDS else none
    for i, j in zip(count[:-1].tolist(), count[1:].tolist()):
        if j - i >= WORDS:
            yield _ascending(a[i : j - WORDS + 1], b[i : j - WORDS + 1])
        elif j > i:
            yield _chained(digests[i:j], j - i, 0), _chained(digests[i:j], j - i, 1)
        else:
            yield none
