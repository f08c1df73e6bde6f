"""A run-length index of one text: Burrows-Wheeler transform by runs, samples at run ends, match lengths.

The suffixes of the text are sorted once, by prefix doubling, and forgotten once the index stands. The index
keeps the transform by its runs, of which repetitive text has few, and for the first and the last place of each
run a sample: where in the text its suffix starts, and how long a prefix it shares with its neighbour outside
the run. From a sampled position on, the text is streamed: the suffix that starts one byte later has one byte
less in common with its own neighbour, until the next sample. A position's longest match anywhere else is the
longer of those with its two neighbours.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a byte text in order, and each suffix's rank. The end of the text comes before any byte."""
    n = len(text)
    symbols = np.zeros(n + 8, np.uint64)
    symbols[:n] = text.astype(np.uint64) + np.uint64(1)
    packed = np.zeros(n, np.uint64)
    # nine bits would be needed for 257 symbols: seven of them make 63 bits
    for k in range(7):
        packed = packed << np.uint64(9) | symbols[k : n + k]
    order = np.argsort(packed, kind="stable")
    own = packed[order]
    new = np.ones(n, bool)
    new[1:] = own[1:] != own[:-1]
    # the rank of a class of equal prefixes is the place of its first member
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    width = 7
    while True:
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        open_ = np.flatnonzero(~(new & last))
        if not len(open_):
            return order, rank
        at = order[open_]
        ahead = at + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[open_] = fresh
        place = np.maximum.accumulate(np.where(fresh, open_, 0))
        rank[at] = place
        width *= 2


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of pairs of suffixes."""
    n, step = len(text), 16
    padded = np.zeros(n + step, np.uint8)
    padded[:n] = text
    words = np.lib.stride_tricks.sliding_window_view(padded, step)
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    while len(left):
        x, y = a[left] + out[left], b[left] + out[left]
        room = n - np.maximum(x, y)
        alive = room > 0
        left, x, y, room = left[alive], x[alive], y[alive], room[alive]
        differ = words[x] != words[y]
        some = differ.any(axis=1)
        same = np.where(some, differ.argmax(axis=1), step)
        out[left] += np.minimum(same, room)
        left = left[~some & (room > step)]
    return out


class RunIndex:
    """The index of ``text``, a byte array. All it keeps grows with the runs, but for the text itself."""

    def __init__(self, text: np.ndarray):
        self.size = n = len(text)
        order, _ = suffix_order(text)
        before = np.where(order > 0, text[order - 1].astype(np.int16), -1)
        heads = np.flatnonzero(np.append(True, before[1:] != before[:-1])) if n else np.zeros(0, np.int64)
        tails = np.append(heads[1:], n)[: len(heads)] - 1
        # the transform itself begins with the byte before the empty suffix
        every = np.append(text[-1:].astype(np.int16), before)
        runs = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if n else heads
        #: The byte of each run, -1 for the end of the text, and the run's length.
        self.symbols, self.lengths = every[runs], np.diff(np.append(runs, len(every)))
        self.above = self._samples(text, order, heads, -1)
        self.below = self._samples(text, order, tails, 1)

    @staticmethod
    def _samples(text: np.ndarray, order: np.ndarray, places: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The text positions of sampled suffixes, in order, and what they share with the next in ``step``."""
        at, other = order[places], places + step
        inside = (other >= 0) & (other < len(order))
        shared = np.zeros(len(places), np.int64)
        shared[inside] = _common(text, at[inside], order[other[inside]])
        by = np.argsort(at)
        return at[by], shared[by]

    def matches(self, begin: int, end: int) -> np.ndarray:
        """The longest match elsewhere of what starts at each position from ``begin`` to before ``end``."""
        stream = np.arange(begin, end)
        out = np.zeros(len(stream), np.int64)
        for at, shared in (self.above, self.below):
            last = np.searchsorted(at, stream, "right") - 1
            # before the first sample nothing is shared: the text's first position is always one
            np.maximum(out, shared[last] - (stream - at[last]), out=out)
        return out

    def text(self) -> np.ndarray:
        """The text, read back from its end on out of the runs alone."""
        symbols = np.repeat(self.symbols, self.lengths)
        # the place of the suffix that is one byte longer: those of one byte keep their order
        longer = np.empty(len(symbols), np.int64)
        longer[np.argsort(symbols, kind="stable")] = np.arange(len(symbols))
        out, place = np.zeros(self.size, np.uint8), 0
        for i in range(self.size - 1, -1, -1):
            out[i] = symbols[place]
            place = longer[place]
        return out


def match_lengths(text: np.ndarray) -> np.ndarray:
    """For each position: the longest match of what starts there with what starts anywhere else."""
    return RunIndex(text).matches(0, len(text)) if len(text) > 1 else np.zeros(len(text), np.int64)
