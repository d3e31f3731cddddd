"""A bidirectional FM-index over a delimited vocabulary, and its search scheme for one error, in numpy.

The text is `$w1$w2...$wm` over distinct words in code-point order, read as a circle, and the index is the
Burrows-Wheeler transform of it and of its mirror image. A pattern that was found is a pair of suffix-rank
intervals of one size: `lo` among the suffixes, `lo_r` among those of the mirror. One more symbol on the left is
a step in the first transform, which moves the second interval by the symbols that are smaller; one on the right
is the mirror of that. The rows of `$` come first, in the order of the words, so that the rank of a whole match
`$word$` is the word's own.

A search for words at distance one matches one half of the word exactly, outwards from its middle up to the
delimiter, and goes on over the other half with one inserted, deleted or replaced symbol. Of the alignments of
two words the one with the rightmost error counts, so that either half finds other words.
"""

from __future__ import annotations

import numpy as np

CELLS = 1 << 23


class Ranks:
    """How many symbols below c stand before a row of a transform; counts are kept for every step-th row."""

    def __init__(self, bwt: np.ndarray, sigma: int):
        self.step = max(2, -(-len(bwt) * (sigma + 1) // CELLS))
        rows = len(bwt) // self.step + 1
        own = np.bincount(np.arange(len(bwt)) // self.step * sigma + bwt, minlength=rows * sigma).reshape(rows, sigma)
        self.kept = np.zeros((rows, sigma + 1), np.int32)
        self.kept[1:, 1:] = np.cumsum(np.cumsum(own, axis=0)[:-1], axis=1)
        self.bwt = np.concatenate([bwt, np.full(self.step, sigma, bwt.dtype)])
        self.first = np.cumsum(np.concatenate([[0], np.bincount(bwt, minlength=sigma)]))

    def below(self, row: np.ndarray, c: np.ndarray) -> np.ndarray:
        block = row // self.step
        out = self.kept[block, c].astype(np.int64)
        for k in range(self.step - 1):
            at = block * self.step + k
            out += (at < row) & (self.bwt[at] < c)
        return out


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """The places of a circular text in the order of what follows up to the next delimiter (0), ties by place."""
    n = len(text)
    ends = np.append(np.flatnonzero(text == 0), n)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols up to the next delimiter
    bits = int(sigma).bit_length()
    step = 62 // bits
    padded = np.concatenate([text.astype(np.int64), np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = (key << bits) | np.where(left > k, padded[k : k + n], 0)
    while True:
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order]) != 0
        tied = ~np.append(new, True) | ~np.append(True, new)
        longer = left > step
        if not (tied & longer[order]).any():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, new))
        after = np.zeros(n, np.int64)
        after[longer] = rank[np.flatnonzero(longer) + step] + 1
        key, step = rank * np.int64(n + 1) + after, step * 2


def points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words, and where each word starts, with the end."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return flat, np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])


class FMIndex:
    """words: distinct, not empty, in code-point order."""

    def __init__(self, words: list[str]):
        flat, starts = points(words)
        self.alphabet, symbols = np.unique(flat, return_inverse=True)
        self.sigma, self.size = len(self.alphabet) + 1, len(flat) + len(words)
        self.forward = self._transform(symbols + 1, starts)
        turned = [w[::-1] for w in words]
        order = sorted(range(len(words)), key=turned.__getitem__)
        flat, starts = points([turned[k] for k in order])
        self.mirror = self._transform(np.searchsorted(self.alphabet, flat) + 1, starts)

    def _transform(self, symbols: np.ndarray, starts: np.ndarray) -> Ranks:
        text = np.insert(symbols, starts[:-1], 0)
        return Ranks(text[suffix_order(text, self.sigma) - 1].astype(np.int32), self.sigma)

    def extend(self, state: tuple, c: np.ndarray, right: bool) -> tuple:
        """The pattern of state = (lo, lo_r, size) with the symbol c on the right or left; size 0 if there is none."""
        lo, other, size = state if not right else (state[1], state[0], state[2])
        ranks = self.mirror if right else self.forward
        a, b = ranks.below(lo, c), ranks.below(lo + size, c)
        a1, b1 = ranks.below(lo, c + 1), ranks.below(lo + size, c + 1)
        lo, other, size = ranks.first[c] + a1 - a, other + b - a, (b1 - a1) - (b - a)
        return (other, lo, size) if right else (lo, other, size)

    def children(self, state: tuple, right: bool) -> tuple:
        """As extend, for every symbol: arrays of one row for a state and one column for a symbol."""
        lo, other, size = state if not right else (state[1], state[0], state[2])
        ranks, c = (self.mirror if right else self.forward), np.arange(self.sigma + 1)[None, :]
        a, b = ranks.below(lo[:, None], c), ranks.below((lo + size)[:, None], c)
        own = np.diff(a, axis=1)
        lo, other, size = ranks.first[None, :-1] + own, other[:, None] + (b - a)[:, :-1], np.diff(b, axis=1) - own
        return (other, lo, size) if right else (lo, other, size)

    def near(self, patterns: list[str], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, rank of a word) for all words at distance one whose rightmost possible error lies in
        [first, last): a range on one side of the pattern's middle, len // 2. An insertion before place k counts as k,
        one at the end as the last place. Symbols must be of the index's alphabet."""
        flat, starts = points(patterns)
        text = np.append(np.searchsorted(self.alphabet, flat) + 1, 0)
        size = np.diff(starts)
        found = [self._search(text, starts[:-1], size, first, last, right) for right in (True, False)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _search(self, text, starts, size, first, last, right):
        """right: the left half is exact, the error is in the right one; else the other way round."""
        half = size // 2
        q = np.flatnonzero((first >= half) if right else (first < half))
        symbol = lambda q, k: np.where((k < 0) | (k >= size[q]), 0, text[np.minimum(starts[q] + k, len(text) - 1)])
        step = 1 if right else -1
        # the exact half, outwards from the middle, with the delimiter at its end
        k = half[q] - 1 if right else half[q]
        state = (np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.size, np.int64))
        exact = []
        while len(q):
            state = self.extend(state, symbol(q, k), not right)
            over = (k < 0) if right else (k >= size[q])
            keep = state[2] > 1  # a single one is the word itself
            exact.append([x[over & keep] for x in (q, *state)])
            keep &= ~over
            q, k, state = q[keep], k[keep] - step, tuple(x[keep] for x in state)
        if not exact:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q, *state = (np.concatenate(x) for x in zip(*exact, strict=True))
        # the other half: states without an error yet (q, k, state), and with it (q1, k1, state1)
        k = half[q] if right else half[q] - 1
        q1 = k1 = np.empty(0, np.int64)
        state1 = (q1, q1, q1)
        hits = []
        while len(q) or len(q1):
            made = []
            if len(q1):
                state1 = self.extend(state1, symbol(q1, k1), right)
                over = (k1 >= size[q1]) if right else (k1 < 0)
                keep = state1[2] > 0
                hits.append((q1[over & keep], state1[0][over & keep]))
                keep &= ~over
                made.append((q1[keep], k1[keep] + step, *(x[keep] for x in state1)))
            if len(q):
                here, inner = symbol(q, k), symbol(q, k if right else k + 1)
                gap = k if right else k + 1
                inside = (k >= first[q]) & (k < last[q])
                gap_in = (gap >= first[q]) & ((gap < last[q]) | ((gap == size[q]) & (last[q] == size[q])))
                if not right:
                    gap_in &= gap < half[q]  # an insertion in the middle is the right side's
                some = self.children(state, right)
                at, c = np.nonzero(some[2])
                letter = c > 0
                for ok, move in ((inside[at] & letter & (c != here[at]), step), (gap_in[at] & letter & (c != inner[at]), 0)):
                    made.append((q[at[ok]], k[at[ok]] + move, *(x[at[ok], c[ok]] for x in some)))
                gone = inside & (symbol(q, k + 1) != here)
                made.append((q[gone], k[gone] + step, *(x[gone] for x in state)))
                rows = np.arange(len(q))
                state = tuple(x[rows, here] for x in some)
                over = (k >= size[q]) if right else (k < 0)
                ahead = (k + 1 < last[q]) | (last[q] == size[q]) if right else k >= first[q]
                keep = (state[2] > 1) & ~over & ahead
                q, k, state = q[keep], k[keep] + step, tuple(x[keep] for x in state)
            q1, k1, *state1 = (np.concatenate(x) for x in zip(*made, strict=True))
        if not hits:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*hits, strict=True))
