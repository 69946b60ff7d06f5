"""Merge tables of a BPE vocabulary: greedy proposals, pair checks and exact merging."""

from __future__ import annotations

import heapq

import numpy as np

from .lookup import IntTable

#: Failing words of more symbols are merged one by one with a heap, shorter ones together.
LONG = 256


class Merges:
    """Tokens numbered by age: ``base`` symbols, then one for each merge in order.

    A sequence of tokens is what merging yields if each token is what its own symbols
    merge to and every adjacent pair is compatible: no merge across their border
    would have come before the merges that made them.
    """

    def __init__(self, base: int, pairs: list[tuple[int, int]], made: list[int]):
        """``pairs`` of ages in order of the merges, and the age of what each makes."""
        self.base = base
        n = max([base - 1, *made]) + 1
        left, right = list(range(n)), list(range(n))
        self.merge: dict[tuple[int, int], int] = {}
        symbols: list[tuple[int, ...]] = [(i,) for i in range(base)] + [()] * (n - base)
        for (a, b), new in zip(pairs, made):
            if not symbols[new]:
                left[new], right[new] = a, b
                symbols[new] = symbols[a] + symbols[b]
            self.merge.setdefault((a, b), new)
        self.left, self.right, self.symbols = np.array(left), np.array(right), symbols
        self.pair = IntTable(np.array([a * n + b for a, b in self.merge], np.int64), np.array(list(self.merge.values()), np.int64))
        own = np.concatenate([np.ones(base, bool), self.compatible(self.left[base:], self.right[base:], np.arange(base, n))])
        for t in range(base, n):
            own[t] &= own[left[t]] and own[right[t]]
        child: dict[int, int] = {}
        token = [-1]
        for t in np.flatnonzero(own).tolist():
            node = 0
            for b in symbols[t]:
                k = node * base + b
                node = child.get(k, 0)
                if not node:
                    node = child[k] = len(token)
                    token.append(-1)
            token[node] = t
        self.edge, self.token = IntTable(np.array(list(child), np.int64), np.array(list(child.values()), np.int64)), np.array(token)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair of tokens can stand side by side.

        Undoes the merges of the two tokens along their border, the youngest first; the pair fails
        when the border's parts have a merge older than what was undone last.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 60) if limit is None else limit.copy()
        good, live, n = np.ones(len(a), bool), np.arange(len(a)), len(self.left)
        while len(live):
            x, y = a[live], b[live]
            new = self.pair.get(x * n + y)
            clash = (new >= 0) & (new < limit[live])
            good[live[clash]] = False
            live, x, y = live[~clash], x[~clash], y[~clash]
            undo_a = (x > y) & (x >= self.base)
            undo_b = ~undo_a & (y >= self.base)
            undo_a |= ~undo_b & (x >= self.base)
            done = ~undo_a & ~undo_b
            limit[live] = np.where(undo_a, x, y + 1)
            a[live] = np.where(undo_a, self.right[x], x)
            b[live] = np.where(undo_b, self.left[y], y)
            live = live[~done]
        return good

    def propose(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: word numbers and tokens, in order."""
        end = np.cumsum(size)
        pos = np.concatenate(([0], end[:-1]))
        live, who, what = np.flatnonzero(pos < end), [], []
        while len(live):
            best, stop = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
            node, cur, go = np.zeros(len(live), np.int64), pos[live], np.arange(len(live))
            while len(go):
                to = self.edge.get(node[go] * self.base + raw[cur[go]])
                go, to = go[to >= 0], to[to >= 0]
                node[go] = to
                cur[go] += 1
                t = self.token[node[go]]
                full = go[t >= 0]
                best[full], stop[full] = t[t >= 0], cur[full]
                go = go[cur[go] < end[live[go]]]
            who.append(live)
            what.append(best)
            pos[live] = stop
            live = live[stop < end[live]]
        who, what = np.concatenate([*who, np.zeros(0, np.int64)]), np.concatenate([*what, np.zeros(0, np.int64)])
        order = np.argsort(who, kind="stable")
        return who[order], what[order]

    def merged(self, word: list[int]) -> list[int]:
        """Exact merging: the oldest merge first, the leftmost of equals."""
        part = list(word)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m, i, part[i], part[i + 1]) for i in range(n - 1) if (m := self.merge.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            m, i, a, b = heapq.heappop(queue)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = m, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (x := self.merge.get((m, part[after[j]]))) is not None:
                    heapq.heappush(queue, (x, i, m, part[after[j]]))
            h = before[i]
            if h >= 0 and (x := self.merge.get((part[h], m))) is not None:
                heapq.heappush(queue, (x, h, part[h], m))
        return [p for p in part if p >= 0]

    def merged_together(self, part: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words in step, as word numbers and tokens: each step applies the oldest merge that each word has."""
        words, tokens = [], []
        word = np.repeat(np.arange(len(size)), size)
        n = len(self.left)
        while len(part):
            same = word[1:] == word[:-1]
            new = np.full(len(part), 1 << 60)
            at = np.flatnonzero(same)
            m = self.pair.get(part[at] * n + part[at + 1])
            new[at[m >= 0]] = m[m >= 0]
            begin = np.flatnonzero(np.concatenate(([True], ~same)))
            oldest = np.minimum.reduceat(new, begin)
            span = np.diff(np.append(begin, len(part)))
            over = oldest == 1 << 60
            ready = np.repeat(over, span)
            words.append(word[ready])
            tokens.append(part[ready])
            take = (new == np.repeat(oldest, span)) & (new < 1 << 60)
            at = np.flatnonzero(take)
            if len(at):  # of overlapping merges, as in aaa, every other one counts from the left
                fresh = np.concatenate(([True], (np.diff(at) > 1) | (new[at[1:]] != new[at[:-1]])))
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
            part = part.copy()
            part[at] = new[at]
            keep = ~ready
            keep[at + 1] = False
            part, word = part[keep], word[keep]
        words, tokens = np.concatenate([*words, np.zeros(0, np.int64)]), np.concatenate([*tokens, np.zeros(0, np.int64)])
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def encode(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ages of the tokens of words, one word after another, and how many each has; words are given as their symbols one after another and their sizes.

        Speculates, verifies every adjacent pair, and merges exactly the words that fail.
        """
        who, what = self.propose(raw, size)
        near = np.flatnonzero(who[1:] == who[:-1])
        bad = np.zeros(len(size), bool)
        bad[who[near[~self.compatible(what[near], what[near + 1])]]] = True
        end = np.cumsum(size)
        good = ~bad[who]
        who, what = [who[good]], [what[good]]
        short = np.flatnonzero(bad & (size <= LONG))
        if len(short):
            begin = end[short] - size[short]
            w, t = self.merged_together(raw[np.arange(size[short].sum()) + np.repeat(begin - (np.cumsum(size[short]) - size[short]), size[short])], size[short])
            who.append(short[w])
            what.append(t)
        for i in np.flatnonzero(bad & (size > LONG)).tolist():
            t = self.merged(raw[end[i] - size[i] : end[i]].tolist())
            who.append(np.full(len(t), i))
            what.append(np.array(t))
        who, what = np.concatenate(who), np.concatenate(what)
        return what[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(size))
