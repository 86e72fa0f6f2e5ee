"""Vectorised hashes of words and shingles over batches of whole texts."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Separators of words: space and the five controls from tab to carriage return.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
CHUNK = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class WordHasher:
    """Hashes each word of a concatenation in one pass, by differences of a prefix polynomial modulo 2**64."""

    def __init__(self, separators: bytes | np.ndarray = BLANKS):
        self.separator = np.zeros(256, bool)
        self.separator[np.frombuffer(bytes(separators), np.uint8)] = True
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                    p = np.full(size, np.uint64(base))
                    p[0] = 1
                    setattr(self, name, np.cumprod(p))

    def words(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and for each document the index of its first word (one more at the end)."""
        if not docs:
            return np.zeros(0, np.uint64), np.zeros(1, np.int64)
        sep = bytes([int(np.flatnonzero(self.separator)[0])])
        raw = np.frombuffer(sep.join(docs).translate(_LOWER) + sep, np.uint8)
        blank = self.separator[raw]
        edge = np.diff(blank.astype(np.int8), prepend=np.int8(1))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self._powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=total[1:])
            h = (total[ends] - total[starts]) * self.down[starts]
            h = mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = np.cumsum([0] + [len(d) + 1 for d in docs])
        return h, np.searchsorted(starts, at)

    def chunks(self, docs: list[bytes], size: int = CHUNK):
        """Bounds of consecutive documents of about size bytes together."""
        first, held = 0, 0
        for i, d in enumerate(docs):
            held += len(d)
            if held >= size:
                yield first, i + 1
                first, held = i + 1, 0
        if first < len(docs):
            yield first, len(docs)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its shingles; fewer words than width make one shingle."""
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(0x100000001B3) + words[k : k + len(rolled)]
        rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = 0xA5A5A5A5 + b - a
            for w in words[a:b].tolist():
                h = (h * 0x100000001B3 + w) % (1 << 64)
            out.append(mixed(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(docs: list[bytes], width: int, hasher: WordHasher) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for a, b in hasher.chunks(docs):
        out += shingles(*hasher.words(docs[a:b]), width)
    return out
