"""A compressed full-text index over sequences of words: wavelet matrix of the Burrows–Wheeler transform, backward search for many
patterns at once, and the intervals of streamed texts whose matching statistics reach a threshold.

Words are numbers from 1 on; 0 ends a sequence and is never matched, so no match crosses the end of one.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of sequences that each end with 0, by prefix doubling of what is still tied. The ends count as different
    words, in order of place, so every suffix is told apart before its sequence ends."""
    n, ends = len(text), text == 0
    key = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
    order = np.argsort(key, kind="stable")
    rank, depth = np.empty(n, np.int64), 1
    slots, key = np.arange(n), key[order]
    while len(slots):
        opens = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(opens, np.arange(len(slots)), 0))]
        tied = ~opens | np.append(~opens[1:], False)
        slots = slots[tied]
        member = order[slots]
        key = rank[member] * n + rank[member + depth] if len(slots) else key[:0]
        again = np.argsort(key, kind="stable")
        order[slots], key = member[again], key[again]
        depth *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence: one level of packed bits and counts per 64 of them for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        rest = np.asarray(symbols)
        for level in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bit = (rest >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.levels.append((level, words, counts, int(len(bit) - bit.sum())))
            rest = np.concatenate([rest[~bit], rest[bit]])
        self.first = np.zeros(n_symbols, np.int64)
        self.first = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, counts, zeros in self.levels:
            block = at >> 6
            ones = counts[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place `at`."""
        return self._down(symbols, at) - self.first[symbols]


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int):
        """text: sequences that each end with 0, of words below n_symbols."""
        self.bwt = WaveletMatrix(text[suffix_order(text) - 1], n_symbols)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])

    def begin(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with single words."""
        return self.starts[symbols], self.starts[symbols + 1]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one step of backward search: each pattern gets one more word in front."""
        at = self.bwt.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return self.starts[symbols] + at[: len(symbols)], self.starts[symbols] + at[len(symbols) :]

    def intervals(self, text: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, count: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, start, stop), in text: the intervals of the queries text[begins:ends] in which every window of `length` words occurs
        at least `count` times in the index. All queries go on step by step, together.

        A window is searched from its end. Where a string becomes too rare, every window that holds it is, so the next one begins behind
        its first word. From a window that is found, the longest string that begins with it and is found as well is sought by halving."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        q = np.flatnonzero(ends - begins >= length)
        a, last = begins[q].copy(), ends[q] - 1  # first word of the window, last word of the query
        growing = np.zeros(len(q), bool)
        found, limit = last.copy(), last.copy()  # while growing: ends that are known to be found, and that may be
        e = a + length - 1
        p, fresh = e.copy(), np.ones(len(q), bool)
        low, high = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        while len(q):
            word = text[p]
            new, old = np.flatnonzero(fresh), np.flatnonzero(~fresh)
            low[new], high[new] = self.begin(word[new])
            low[old], high[old] = self.extend(word[old], low[old], high[old])
            fresh[:] = False
            good = high - low >= count
            on = good & (p > a)
            p[on] -= 1
            # a window that is too rare
            lost = ~good & ~growing
            a[lost] = p[lost] + 1
            # a window that is found, and tests of longer strings
            won = good & ~on & ~growing
            found[won], limit[won] = e[won], last[won]
            longer, shorter = good & ~on & growing, ~good & growing
            found[longer], limit[shorter] = e[longer], e[shorter] - 1
            settled = (won | longer | shorter) & (found == limit)
            if settled.any():
                out.append((q[settled], a[settled], found[settled] + 1))
                a[settled] = found[settled] - length + 2
            tests = (won | longer | shorter) & ~settled
            growing[won], growing[settled] = True, False
            e[tests] = np.where(won[tests], limit[tests], (found[tests] + limit[tests] + 1) // 2)
            windows = lost | settled
            e[windows] = a[windows] + length - 1
            again = windows | tests
            p[again], fresh[again] = e[again], True
            live = ~(windows & (e > last))
            if not live.all():
                q, a, last, growing, found, limit, e, p, fresh, low, high = (x[live] for x in (q, a, last, growing, found, limit, e, p, fresh, low, high))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
