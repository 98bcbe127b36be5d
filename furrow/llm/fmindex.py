"""A compressed FM-index over integer sequences, with batched backward search and least owners of intervals."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit vector, with counts before each word, per bit of the symbols."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1])
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each symbol how often it occurs before the place, counted from where its run begins in the last level."""
        for level in range(self.bits):
            word = at >> 6
            ones = self.before[level][word] + np.bitwise_count(self.words[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Index of sequences (symbols from 1, owners as integers), for patterns of up to depth symbols.

    Suffixes are ordered by their first depth symbols: intervals of patterns up
    to that length are those of the full order.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, symbols: int, depth: int):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            if width >= depth:
                break
            key = rank * (int(after.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = new
            width *= 2
            if new[-1] == n - 1:
                break
        order = np.argsort(rank, kind="stable")
        last = text[order - 1]
        self.matrix = WaveletMatrix(last.astype(np.int64), symbols)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.runs = self.matrix.rank(np.arange(symbols), np.zeros(symbols, np.int64))
        self.n = n
        self.least = [owner[order]]
        width = 1
        while 2 * width <= n:
            self.least.append(np.minimum(self.least[-1][: n - 2 * width + 1], self.least[-1][width : n - width + 1]))
            width *= 2
        # one gather for all levels of the table of minima
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in self.least])))[:-1]
        self.flat = np.concatenate(self.least)
        del self.least

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a symbol put before each."""
        base = self.starts[symbol] - self.runs[symbol]
        both = self.matrix.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        return base + both[: len(lo)], base + both[len(lo) :]

    def searched(self, pattern: list[int], owner: int) -> int:
        """How many symbols at the end of the pattern a sequence of a lesser owner has, one pattern at a time."""
        matrix, lo, hi, done = self.matrix, 0, self.n, 0
        for symbol in reversed(pattern):
            base = int(self.starts[symbol]) - int(self.runs[symbol])
            a, b = lo, hi
            for level in range(matrix.bits):
                words, before = matrix.words[level], matrix.before[level]
                ones = [int(before[x >> 6]) + (int(words[x >> 6]) & ((1 << (x & 63)) - 1)).bit_count() for x in (a, b)]
                a, b = (matrix.zeros[level] + ones[0], matrix.zeros[level] + ones[1]) if symbol >> (matrix.bits - 1 - level) & 1 else (a - ones[0], b - ones[1])
            lo, hi = base + a, base + b
            if hi <= lo:
                break
            level = (hi - lo).bit_length() - 1
            offset = int(self.offsets[level])
            if min(self.flat[offset + lo], self.flat[offset + hi - (1 << level)]) >= owner:
                break
            done += 1
        return done

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least owner within each interval (not empty)."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        offset = self.offsets[level]
        return np.minimum(self.flat[offset + lo], self.flat[offset + hi - (1 << level)])


def _rest(index: FMIndex, text: list[int], owner: int, length: int, window: int, base: int, resume: int) -> list[int]:
    """Starts of matching windows of one sequence from a state of earlier_intervals on, by the same steps."""
    out, last = [], len(text) - length
    while window <= last:
        got = index.searched(text[window : window + length], owner)
        if got == length:
            out.append(window)
            if resume < 0:
                if window == last:
                    break
                base, window = window, min(window + length, last)
            else:
                window, base, resume = resume, -1, -1
        else:
            if base < 0:
                window += length - got
                continue
            if resume < 0:
                resume = window + length - got
            if window - 1 > base:
                window -= 1
            else:
                window, base, resume = resume, -1, -1
    return out


#: With fewer sequences left, one at a time is faster than all of them together.
FEW = 24


def earlier_intervals(index: FMIndex, text: np.ndarray, first: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matching statistics of sequences streamed against the index, as far as they tell windows above a threshold.

    Sequence q is text[first[q]:first[q + 1]] of owner[q]. Returns (q, start, end),
    relative to the sequence, such that the intervals cover exactly the windows
    of length symbols that also occur in a sequence of a lesser owner.

    A window is searched backwards from its end. If only its last symbols match,
    no window that holds these and the symbol before them can match, so seeking
    goes on behind that symbol. From a match the next window to try is the
    adjacent one; if it fails, those between are tried from the right, as the
    last that matches tells how far the words are covered. All sequences take
    one backward step at a time, together.
    """
    begin, last = first[:-1], np.diff(first) - length
    q = np.flatnonzero(last >= 0)
    window = np.zeros(len(q), np.int64)  # the start of the window in work
    base = np.full(len(q), -1)  # the last match, if windows behind it are in work
    resume = np.full(len(q), -1)  # where to seek when these are done
    at = window + length
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), index.n)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(q) >= FEW:
        symbol = text[begin[q] + at - 1]
        new_lo, new_hi = index.extend(symbol, lo, hi)
        fits = new_hi > new_lo
        fits[fits] = index.least_owner(new_lo[fits], new_hi[fits]) < owner[q[fits]]
        at = at - fits
        lo, hi = np.where(fits, new_lo, lo), np.where(fits, new_hi, hi)
        found = fits & (at == window)
        failed = ~fits
        if found.any() or failed.any():
            if found.any():
                out.append((q[found], window[found]))
            seeking = base < 0
            # a match in a leap or while seeking: leap on; one between a match and a failed leap ends the run
            leap = found & (resume < 0)
            back = failed & ~seeking
            first_back = back & (resume < 0)
            resume = np.where(first_back, at, resume)
            between = back & (window - 1 > base)
            ended = (found & ~leap) | (back & ~between)
            next_window = np.select([leap, between, ended, failed], [np.minimum(window + length, last[q]), window - 1, resume, at], window)
            over = (leap & (window == last[q])) | (next_window > last[q])
            base = np.select([leap, ended], [window, -1], base)
            resume = np.where(ended, -1, resume)
            moved = found | failed
            window = np.where(moved, next_window, window)
            at = np.where(moved, window + length, at)
            lo, hi = np.where(moved, 0, lo), np.where(moved, index.n, hi)
            if over.any():
                stay = ~(over & moved)
                q, window, base, resume, at, lo, hi = (x[stay] for x in (q, window, base, resume, at, lo, hi))
    for i, w, b, r in zip(q.tolist(), window.tolist(), base.tolist(), resume.tolist(), strict=True):
        starts = _rest(index, text[first[i] : first[i + 1]].tolist(), int(owner[i]), length, w, b, r)
        out.append((np.full(len(starts), i), np.array(starts, np.int64)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    which, start = (np.concatenate([x[i] for x in out]) for i in (0, 1))
    return which, start, start + length
