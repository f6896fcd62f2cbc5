"""Shared text kernels: words, order-free hashing of word runs, and the fold that decides held-out rows.

Words are runs of anything but space and the control characters 9 to 13, after lower-casing A-Z only. On UTF-8 bytes
that is ``bytes.lower().split()``: both act on ASCII alone.
"""

from __future__ import annotations

import zlib

import numpy as np

SHINGLE = 5
_BLOCK = 1 << 20
_U = np.uint64


def words(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8; none for null or blank text."""
    return text.lower().split() if text else []


def fold(doc_id: int | None, mod: int) -> int:
    """crc32 of the decimal id, modulo ``mod``; a null id counts as the empty string."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that hash order is a random order."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """What ``np.unique`` gives, by a sort: its hash table takes several times as long."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class RunHasher:
    """64-bit polynomial hashes of word runs, for all runs of a text at once.

    With H the prefix sums of ``table[byte] * base**i`` (mod 2**64), the run over bytes [s, e) hashes to
    ``(H[e] - H[s]) * base**-s``, which does not depend on where the run stands. Long texts go in blocks that overlap
    by ``width - 1`` words, so memory is bounded by the block, not by the text.
    """

    def __init__(self, seed: int = 20240229):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
        self.base = int(rng.integers(2**62, 2**63)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 4096)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_U(self.base), _U(self.inverse)))

    def _runs(self, joined: bytes, width: int) -> np.ndarray:
        raw = np.frombuffer(joined, np.uint8)
        self._grow(len(raw) + 1)
        with np.errstate(over="ignore"):
            prefix = np.zeros(len(raw) + 1, np.uint64)
            weighed = self.table.take(raw)
            weighed *= self.up[: len(raw)]
            np.cumsum(weighed, out=prefix[1:])
            gaps = np.flatnonzero(raw == 32)
            starts = np.concatenate([[0], gaps + 1])
            ends = np.concatenate([gaps, [len(raw)]])
            if len(starts) < width:
                starts, ends = starts[:1], ends[-1:]
            else:
                starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
            return mix((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def shingles(self, found: list[bytes], width: int = SHINGLE) -> np.ndarray:
        """Sorted distinct hashes of all runs of ``width`` words; of the whole sequence if it is shorter; none if empty."""
        if not found:
            return np.zeros(0, np.uint64)
        step = max(width, _BLOCK // 8)
        if len(found) <= step:
            return distinct(self._runs(b" ".join(found), width))
        parts = [distinct(self._runs(b" ".join(found[i : i + step + width - 1]), width)) for i in range(0, len(found) - width + 1, step)]
        return distinct(np.concatenate(parts))
