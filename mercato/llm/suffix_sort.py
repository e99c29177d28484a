"""Suffix sorting by induction, with bucket queues that spill to disk.

The suffixes that start at a left-most falling place (LMS) are named and sorted
first; all others are induced from them: a suffix goes to the queue of its
first symbol when the suffix one place later leaves its own.  A queue is drained
symbol by symbol, so it is a priority queue by (symbol, order of arrival), and
what it holds beyond its memory goes to a temporary file that vanishes with
the task.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY = 256 << 20


class SymbolQueue:
    """Priority queue of positions by symbol; equal symbols leave in order of arrival."""

    def __init__(self, symbols: int, memory: int = MEMORY):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if hi > lo:
                self.parts[keys[lo]].append(values[lo:hi])
        self.held += values.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="symbol-queue-")
        self.file.seek(0, 2)
        for parts in self.parts:
            for i, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    at = self.file.tell()
                    self.file.write(part.tobytes())
                    parts[i] = (at, len(part), part.dtype)
        self.held = 0

    def drain(self, key: int) -> np.ndarray | None:
        parts, self.parts[key] = self.parts[key], []
        if not parts:
            return None
        out = []
        for part in parts:
            if isinstance(part, np.ndarray):
                self.held -= part.nbytes
            else:
                at, n, kind = part
                self.file.seek(at)
                part = np.frombuffer(self.file.read(n * kind.itemsize), kind)
            out.append(part)
        return out[0] if len(out) == 1 else np.concatenate(out)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def rising(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one counts as such."""
    n = len(t)
    out = np.ones(n, bool)
    if n > 1:
        differ = np.flatnonzero(t[:-1] != t[1:])
        up = np.append(t[differ] < t[differ + 1], True)
        out = np.repeat(up, np.diff(np.concatenate(([-1], differ, [n - 1]))))
    return out


def induce(t: np.ndarray, up: np.ndarray, lms: np.ndarray, symbols: int, memory: int) -> np.ndarray:
    """Order of all suffixes of ``t`` from the given order of its LMS suffixes."""
    falling: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    raised: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    seeds, queue = SymbolQueue(symbols, memory), SymbolQueue(symbols, memory)
    seeds.push(t[lms], lms)

    def pass_on(batch: np.ndarray, kind: bool) -> None:
        before = batch[batch > 0] - 1
        before = before[up[before] == kind]
        if len(before):
            queue.push(t[before], before)

    for c in range(symbols):
        while (batch := queue.drain(c)) is not None:
            falling[c].append(batch)
            pass_on(batch, False)
        if (batch := seeds.drain(c)) is not None:
            pass_on(batch, False)
    for c in range(symbols - 1, -1, -1):
        while (batch := queue.drain(c)) is not None:
            raised[c].append(batch)
            pass_on(batch, True)
        for batch in reversed(falling[c]):
            pass_on(batch[::-1], True)
    seeds.close()
    queue.close()
    out = [np.array([len(t) - 1])]
    for c in range(symbols):
        out += falling[c]
        out += [b[::-1] for b in reversed(raised[c])]
    return np.concatenate(out)


_K = np.uint64(0x9E3779B97F4A7C15)


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def suffix_order(t: np.ndarray, symbols: int, depth: int, memory: int = MEMORY) -> np.ndarray:
    """Starts of the suffixes of ``t`` in an order that is right for their first ``depth`` symbols.

    ``t`` ends with a 0 that stands nowhere else.  The names of the LMS pieces
    form a shorter text, which is sorted the same way while its alphabet is
    small enough to keep a queue per symbol, else by doubling its ranks.
    """
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1]
    up = rising(t)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if len(lms) < 2:
        return induce(t, up, lms, symbols, memory)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    pieces = induce(t, up, lms, symbols, memory)
    pieces = pieces[is_lms[pieces]]
    # Equal pieces (up to and with the next LMS place) get one name.
    place = np.arange(lms[0], n) - np.repeat(lms, np.diff(np.append(lms, n)))
    mixed = _scatter(t[lms[0]:].astype(np.uint64) * _K + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(1))
    digest = np.add.reduceat(mixed, lms - lms[0])
    size = np.diff(np.append(lms, n - 1))
    tail = t[np.append(lms[1:], n - 1)].astype(np.uint64)
    digest = _scatter(digest + tail * _K) + size.astype(np.uint64)
    number = np.zeros(n, np.int64)
    number[lms] = np.arange(len(lms))
    row = number[pieces]
    name = np.empty(len(lms), np.int64)
    name[row] = np.cumsum(np.append(0, digest[row][1:] != digest[row][:-1]))
    kinds = int(name[row[-1]]) + 1
    if kinds < len(lms):
        if kinds <= 4096:
            shorter = np.append(name + 1, 0)
            order = suffix_order(shorter, kinds + 1, depth // 2 + 1, memory)[1:]
        else:
            covered = 2                            # a piece is two symbols long at least
            step, rank = 1, name
            while covered < depth + 2 and kinds < len(lms):
                later = np.zeros(len(rank), np.int64)
                later[:-step] = rank[step:] + 1
                pair = rank * (kinds + 1) + later
                order = np.argsort(pair)
                rank = np.empty_like(rank)
                rank[order] = np.cumsum(np.append(0, pair[order][1:] != pair[order][:-1]))
                kinds = int(rank[order[-1]]) + 1
                step, covered = step * 2, covered * 2
        pieces = lms[order]
    return induce(t, up, pieces, symbols, memory)


def equal_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For starts in suffix order: whether each shares its first ``length`` bytes with the one before it.

    This is the common-prefix value of neighbours, as far as it matters here:
    whether it reaches ``length``.  ``data`` (bytes) holds that many from each start.
    """
    same = np.ones(max(0, len(order) - 1), bool)
    padded = np.append(data, np.zeros(8, np.uint8))
    words = np.ndarray((len(padded) - 7,), "<u8", padded.tobytes(), strides=(1,))
    for at in range(0, length, 8):
        left = length - at
        column = words[order + at]
        if left < 8:
            column = column & np.uint64((1 << 8 * left) - 1)
        same &= column[1:] == column[:-1]
    return np.append(False, same) if len(order) else same
