"""Fuzzy search by the similarity of character sequences, for which Spark has no built-in."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sequence_ratio(a: Column, b: Column) -> Column:
    """Twice the matched characters over all characters; the order of the arguments matters."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(left, right)], dtype="float64")

    return ratio(a, b)


#: Up to so many characters of the shorter and the longer text, matched characters are counted with str.find.
SHORT, LONGER = 24, 96


def _matched(a: str, b: str) -> int:
    """The characters that SequenceMatcher matches: the longest run that both hold, the first in a and then in b, and so on to its left and right."""
    at = most = 0
    for i in range(len(a)):
        while i + most < len(a) and a[i : i + most + 1] in b:
            at, most = i, most + 1
    if not most:
        return 0
    to = b.find(a[at : at + most])
    left = _matched(a[:at], b[:to]) if at and to else 0
    return left + most + (_matched(a[at + most :], b[to + most :]) if at + most < len(a) and to + most < len(b) else 0)


def ratio_of(a: str, b: str) -> float:
    """SequenceMatcher's ratio, which short texts get without its tables (these leave frequent characters out from 200 characters on)."""
    if min(len(a), len(b)) <= SHORT and max(len(a), len(b)) <= LONGER:
        return 2.0 * _matched(a, b) / (len(a) + len(b)) if a or b else 1.0
    return SequenceMatcher(None, a, b).ratio()


class Postings:
    """Where the characters and pairs of characters of a page's words stand: for each of them how often the words up to each place hold it.

    The words of a window are joined by ``glue``, empty ones left out.
    """

    def __init__(self, words: list[str], glue: str):
        self.words, self.glue, self.sums = words, glue, {}
        self.letters: np.ndarray | None = None  # made for the first target that stands nowhere as it is
        self.filled = self._sums([i for i, w in enumerate(words) if w])
        self.length = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        self.text = glue.join(w for w in words if w)
        self.begin: dict[int, int] | None = None
    def _sums(self, places: list[int] | np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bincount(places, minlength=len(self.words))[: len(self.words)])])

    def of(self, gram: str) -> np.ndarray | None:
        if self.letters is None:
            self.letters = np.frombuffer("".join(self.words).encode("utf-32-le", "surrogatepass"), np.uint32)
            self.owner = np.repeat(np.arange(len(self.words)), np.diff(self.length))
            self.inside = self.owner[1:] == self.owner[:-1]
        if gram not in self.sums:
            here = self.letters == ord(gram[0])
            if len(gram) == 2:
                here = here[:-1] & (self.letters[1:] == ord(gram[1])) & self.inside
            at = self.owner[np.flatnonzero(here)]
            self.sums[gram] = self._sums(at) if len(at) else None
        return self.sums[gram]

    def shared(self, grams: Counter, size: int) -> np.ndarray:
        """For each window of so many words how many of these grams its words hold."""
        out = np.zeros(len(self.words) - size + 1, np.int64)
        for g, n in grams.items():
            sums = self.of(g)
            if sums is not None:
                out += np.minimum(sums[size:] - sums[:-size], n)
        return out

    def equal(self, target: str) -> list[tuple[int, int]] | None:
        """Size and start of each window that begins and ends with a word that isn't empty and says just the target."""
        out, at = [], self.text.find(target)
        if at >= 0 and self.begin is None:  # where in the text each word that isn't empty begins and ends
            begin = (self.length[:-1] + len(self.glue) * self.filled[:-1]).tolist()
            self.begin = {x: i for i, (x, w) in enumerate(zip(begin, self.words)) if w}
            self.end = {x + len(w): i for i, (x, w) in enumerate(zip(begin, self.words)) if w}
        while at >= 0:
            i, j = self.begin.get(at), self.end.get(at + len(target))
            if i is not None and j is not None:
                out.append((j - i + 1, i))
            at = self.text.find(target, at + 1)
        return out


def _bounds(target: str, page: Postings, size: int) -> np.ndarray:
    """No window of ``size`` words has a higher ratio; 0 for those without text.

    Matched characters are at most those that both hold. And m blocks of M matched characters hold M - m pairs
    that follow one another on both sides, while at least m - 1 characters stand unmatched between them; so 3 M is at most the length of both
    and one and the pairs shared. Pairs that lie across words aren't posted and count as shared.
    """
    filled = page.filled[size:] - page.filled[:-size]
    joints = np.maximum(filled - 1, 0)
    length = page.length[size:] - page.length[:-size] + len(page.glue) * joints
    both = length + len(target)
    single = page.shared(Counter(target) - Counter({page.glue: len(target)}), size) + (np.minimum(joints, target.count(page.glue)) if page.glue else 0)
    double = page.shared(Counter(target[k : k + 2] for k in range(len(target) - 1)), size) + joints * (len(page.glue) + 1)
    return np.where(length > 0, 2 * np.minimum(single, (both + 1 + double) / 3) / np.maximum(both, 1), 0.0)


def best_window(target: str, words: list[str], ys: list[int], sizes: list[int], glue: str, spread: float | None, target_first: bool, least: float = 0.0, page: Postings | None = None) -> tuple[float, int, int]:
    """Score, size and start of the run of words most similar to ``target``; ties go to the smaller size, then the first.

    Windows that say just the target are looked up in the page's text. If there are none, windows are ruled out by their characters and pairs of characters
    (:func:`_bounds`), exactly, for all windows of a size at once; the ratio of the others is computed by falling bound, until no bound
    reaches the best score. A score below ``least`` counts as none. With ``spread`` a run's ys differ by no more than that, and one more than
    twice as long as the target counts 0.7 times.
    """
    sizes = [n for n in sizes if n <= len(words)]
    if not sizes or not target:
        return (0.0, 0, 0)
    page = page or Postings(words, glue)
    level = lambda size, start: spread is None or max(ys[start : start + size]) - min(ys[start : start + size]) <= spread
    equal = page.equal(target)
    if equal and min(equal)[0] >= min(sizes):  # shorter ones can be within longer windows, beside empty words
        said = [(n, i) for n, i in sorted(equal) if n in sizes and level(n, i)]
        if said:
            return (1.0, *said[0])
    bound = np.concatenate([_bounds(target, page, n) for n in sizes])
    size = np.repeat(sizes, [len(words) - n + 1 for n in sizes])
    start = np.concatenate([np.arange(len(words) - n + 1) for n in sizes])
    if spread is not None:
        length = page.length[start + size] - page.length[start] + len(glue) * np.maximum(page.filled[start + size] - page.filled[start] - 1, 0)
        bound = np.where(length > 2 * len(target), 0.7 * bound, bound)
    left = np.flatnonzero((bound > 0) & (bound >= least - 1e-12))
    best, scores = (0.0, 0, 0), {}
    for k in left[np.lexsort((start[left], size[left], -bound[left]))]:
        if bound[k] < best[0] - 1e-12:
            break
        n, i = int(size[k]), int(start[k])
        if not level(n, i):
            continue
        text = glue.join(w for w in words[i : i + n] if w)
        if text not in scores:
            pair = (target, text) if target_first else (text, target)
            scores[text] = ratio_of(*pair) * (0.7 if spread is not None and len(text) > 2 * len(target) else 1)
        if (scores[text], -n, -i) > (best[0], -best[1], -best[2]) and scores[text] > 0:
            best = (scores[text], n, i)
    return best if best[0] >= least else (0.0, 0, 0)


def window_search(target: Column, words: Column, ys: Column, sizes: Column, spread: Column, glue: str, target_first: bool, least: float = 0.0) -> Column:
    """:func:`best_window` for each of the row's targets (with a list of sizes each), as structs of score, size and start. The row's postings are made once. ys are only asked for where there is a spread."""

    @F.pandas_udf("array<struct<score:double,size:int,start:int>>")
    def search(t: pd.Series, w: pd.Series, y: pd.Series, n: pd.Series, d: pd.Series) -> pd.Series:
        rows = []
        for targets, b, c, sizes, f in zip(t, w, y, n, d):
            words, ys = list(b), [] if c is None else list(c)
            page, spread = Postings(words, glue), None if pd.isna(f) else float(f)
            found = [best_window(a, words, ys, sorted({int(k) for k in e if k >= 1}), glue, spread, target_first, least, page) for a, e in zip(targets, sizes)]
            rows.append([{"score": s, "size": k, "start": i} for s, k, i in found])
        return pd.Series(rows)

    return search(target, words, ys, sizes, spread)
