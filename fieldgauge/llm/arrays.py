"""Words of many texts as numpy arrays: places and 64-bit hashes, found without a Python loop over words."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
BLOCK = 500_000


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("up", _STEP), ("down", _BACK)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[name] = p
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    first: int            # position of the first text of this group
    data: np.ndarray      # the texts' bytes, each followed by one \n
    text_at: np.ndarray   # where each text begins in data, and the end
    start: np.ndarray     # of each word, in data
    end: np.ndarray
    hash: np.ndarray      # of each word's bytes
    word_at: np.ndarray   # each text's first word, and the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.word_at) - 1), self.counts)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte ranges; the same bytes give the same hash wherever they stand."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, "right")))
        low, high = int(start[at]), int(end[stop - 1])
        up, down = _power(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        a, z = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = mixed((sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64))
        at = stop
    return out


def words(texts, lower: bool = True, group_bytes: int = BLOCK) -> Iterator[Words]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text (null: none), some megabytes of text at a time."""
    group, size, first = [], 0, 0
    for n, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        group.append(b)
        size += len(b)
        if size >= group_bytes:
            yield _words(group, first, lower)
            group, size, first = [], 0, n + 1
    if group:
        yield _words(group, first, lower)


def _words(group: list[bytes], first: int, lower: bool) -> Words:
    joined = b"\n".join(group) + b"\n"
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    text_at = np.zeros(len(group) + 1, np.int64)
    np.cumsum(np.fromiter((len(b) + 1 for b in group), np.int64, len(group)), out=text_at[1:])
    edge = np.diff(np.concatenate(([True], _SPACES[data])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return Words(first, data, text_at, start, end, _hashes(data, start, end), np.searchsorted(start, text_at))


def runs(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size`` consecutive words of one text, and the first word of each."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    text = w.text_of_word()
    at = np.flatnonzero(text[:n] == text[size - 1:])
    h = np.zeros(len(at), np.uint64)
    for i in range(size):
        h = mixed(h * np.uint64(3) + w.hash[at + i])
    return h, at


def per_text(w: Words, flags: np.ndarray) -> np.ndarray:
    """Sum of a value of each byte over each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[w.text_at])
