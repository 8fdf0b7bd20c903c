"""Suffix order of one shard by induced sorting over disk-backed bucket queues.

A queue hands out suffixes by (first symbol, arrival), which is the order of a
priority queue keyed by (first symbol, rank of the next suffix), since suffixes
arrive in the order of their successors. Whole buckets are moved as arrays. Beyond
``budget`` bytes the queued tuples go to one temporary file, which is gone when
the shard is done.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Symbols of a shard: 0 ends a segment, 1 to 256 are its bytes.
SYMBOLS = 257


class BucketQueues:
    """First-in first-out queues of suffix numbers, one for each symbol, on disk beyond a budget of memory."""

    def __init__(self, budget: int) -> None:
        self.budget, self.held, self.file = budget, 0, None
        self.queues: list[list] = [[] for _ in range(SYMBOLS)]

    def put(self, symbols: np.ndarray, suffixes: np.ndarray) -> None:
        """Append each suffix to its symbol's queue, keeping the order."""
        if not len(suffixes):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, suffixes = symbols[order], suffixes[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for piece, at in zip(np.split(suffixes, cuts), [0, *cuts.tolist()], strict=True):
            self.queues[int(symbols[at])].append(piece)
        self.held += suffixes.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115 - closed in close()
        self.file.seek(0, 2)
        for queue in self.queues:
            for i, piece in enumerate(queue):
                if isinstance(piece, np.ndarray):
                    queue[i] = (self.file.tell(), len(piece), piece.dtype)
                    self.file.write(piece.tobytes())
        self.held = 0

    def take(self, symbol: int, dtype) -> np.ndarray:
        """Everything in a symbol's queue, which is then empty."""
        pieces = []
        for piece in self.queues[symbol]:
            if not isinstance(piece, np.ndarray):
                at, n, kind = piece
                self.file.seek(at)
                piece = np.frombuffer(self.file.read(n * np.dtype(kind).itemsize), kind)
            else:
                self.held -= piece.nbytes
            pieces.append(piece)
        self.queues[symbol] = []
        return np.concatenate(pieces) if pieces else np.zeros(0, dtype)

    def close(self) -> None:
        if self.file:
            self.file.close()


def _induce(t: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, budget: int) -> list[np.ndarray]:
    """All suffixes in order, by symbol: first those that fall (L), then those that rise (S), from the order of the seeds."""
    n, dtype = len(t), seeds.dtype
    up, down = BucketQueues(budget), BucketQueues(budget)
    own = BucketQueues(budget)
    own.put(t[seeds], seeds)
    up.put(t[n - 1 :], np.array([n - 1], dtype))
    falls: list[np.ndarray] = []
    for c in range(SYMBOLS):
        rounds, now = [], up.take(c, dtype)
        while len(now):
            rounds.append(now)
            before = now[now > 0] - 1
            before = before[~is_s[before]]
            symbols = t[before]
            up.put(symbols[symbols != c], before[symbols != c])
            now = before[symbols == c]
        falls.append(np.concatenate(rounds) if rounds else np.zeros(0, dtype))
        before = own.take(c, dtype) - 1
        up.put(t[before], before)
    out: list[np.ndarray] = []
    for c in range(SYMBOLS - 1, -1, -1):
        rounds, now = [], down.take(c, dtype)
        while len(now):
            rounds.append(now)
            before = now[now > 0] - 1
            before = before[is_s[before]]
            symbols = t[before]
            down.put(symbols[symbols != c], before[symbols != c])
            now = before[symbols == c]
        if rounds:
            out.append(np.concatenate(rounds)[::-1])
        last = falls[c][::-1]
        before = last[last > 0] - 1
        before = before[is_s[before]]
        down.put(t[before], before)
        out.append(falls[c])
        falls[c] = falls[c][:0]
    for queues in (up, down, own):
        queues.close()
    return out[::-1]


def equal_stretches(t: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``t`` at ``a`` and at ``b`` of these lengths are the same, symbol by symbol, a word of eight bytes at a time."""
    size = t.dtype.itemsize
    per = 8 // size
    padded = np.concatenate([t, np.zeros(per, t.dtype)])
    words = np.ndarray((len(t),), "<u8", padded.data, strides=(size,))
    same, live, at = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        left = lengths[live] - at
        differ = words[a[live] + at] ^ words[b[live] + at]
        short = left < per
        differ[short] &= (np.uint64(1) << (left[short] * (8 * size)).astype(np.uint64)) - np.uint64(1)
        same[live[differ != 0]] = False
        live, at = live[(differ == 0) & (left > per)], at + per
    return same


def _ranks(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a reduced string by their first ``depth`` names at least; what is known grows twofold or more each round."""
    rank, known = names.astype(np.int64), 1
    while known < depth:
        most = int(rank.max()) + 2
        key, times = rank, 1
        for times in (2, 3):  # three ranks to a key where they fit
            if most**times >= 1 << 62:
                times -= 1
                break
            after = np.zeros(len(rank), np.int64)
            after[: -known * (times - 1)] = rank[known * (times - 1) :] + 1
            key = key * most + after
        order = np.argsort(key)
        new = np.empty(len(key), np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        if new.max() == len(new) - 1:
            return new
        rank, known = new, known * times
    return rank


def suffix_order(t: np.ndarray, depth: int, budget: int = 64 << 20) -> np.ndarray:
    """The suffixes of ``t`` in the order of their first ``depth`` symbols at least; equal ones in any order.

    Suffixes that begin where a rise follows a fall are sorted by the stretch up
    to the next such place, named, ordered through the reduced string of names
    (which has at most half the length), and induce the order of all others.
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    dtype = np.int32 if n < 1 << 31 else np.int64
    slope = np.sign(np.diff(t.astype(np.int16), append=np.int16(-1))).astype(np.int8)
    turn = np.where(slope != 0, np.arange(n, dtype=dtype), np.array(n, dtype))
    is_s = slope[np.minimum.accumulate(turn[::-1])[::-1]] > 0
    places = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(dtype) + 1
    if len(places) > 1:
        ordered = np.concatenate(_induce(t, is_s, places, budget))
        chosen = np.zeros(n, bool)
        chosen[places] = True
        ordered = ordered[chosen[ordered]]
        # Names: equal stretches get one.
        number = np.empty(n, dtype)
        number[places] = np.arange(len(places), dtype=dtype)
        ends = np.append(places[1:] + 1, n)
        size = ends - places
        i = number[ordered]
        before, after = i[:-1], i[1:]
        differ = size[before] != size[after]
        alike = np.flatnonzero(~differ)
        differ[alike] = ~equal_stretches(t, places[before[alike]], places[after[alike]], size[before[alike]])
        names = np.empty(len(places), np.int64)
        names[i] = np.concatenate([[0], np.cumsum(differ)])
        if names.max() < len(places) - 1:
            places = places[np.argsort(_ranks(names, depth // 2 + 2), kind="stable")]
        else:
            places = ordered
    return np.concatenate(_induce(t, is_s, places, budget))
