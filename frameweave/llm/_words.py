"""Words of many texts at once, each as a 64-bit hash, with array operations only."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

#: Bytes that are hashed together.
BLOCK = 1 << 19

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def not_in(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the bytes outside ``ranges``."""
    table = np.ones(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = False
    return table


#: Words are what white space of ASCII parts; or letters, digits and all that is not ASCII.
BY_SPACE = not_in((0x20, 0x20), (0x09, 0x0D))
BY_SIGNS = not_in((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the input sways every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base, dtype=np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers


class Words:
    """The words of ``texts``, lower-cased in A-Z: ``hashes``, ``starts`` and ``ends`` in ``data``, ``cuts`` by text."""

    def __init__(self, texts: list[bytes], table: np.ndarray) -> None:
        self.data = b" ".join([*texts, b""]).translate(LOWER)
        codes = np.frombuffer(self.data, dtype=np.uint8)
        inside = table[codes]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = np.empty(len(self.starts), dtype=np.uint64)
        begin = 0
        while begin < len(self.starts):  # in blocks, since every byte takes several 64-bit numbers
            low = int(self.starts[begin])
            stop = max(begin + 1, int(np.searchsorted(self.ends, low + BLOCK, side="right")))
            block = codes[low : int(self.ends[stop - 1])]
            power, inverse = _up_to(len(block) + 1)
            total = np.zeros(len(block) + 1, dtype=np.uint64)
            np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[: len(block)], out=total[1:])
            starts, ends = self.starts[begin:stop] - low, self.ends[begin:stop] - low
            size = (ends - starts).astype(np.uint64)
            self.hashes[begin:stop] = mix((total[ends] - total[starts]) * inverse[starts] + size * np.uint64(0xD6E8FEB86659FD93))
            begin = stop
        stops = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
        self.cuts = np.concatenate(([0], np.searchsorted(self.starts, stops)))

    def counts(self) -> np.ndarray:
        return np.diff(self.cuts)

    def of_text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.cuts) - 1), self.counts())

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, at the run's first word; runs cross texts, so mask them by ``of_text``."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(k + 1)
        out ^= out >> np.uint64(29)
    return mix(out)
