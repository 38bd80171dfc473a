"""Words of texts and hashes of runs of words, in numpy.

Words are runs of other than ASCII white space. A word's hash mixes all its bytes: sixteen at a time for
short words, by the xxhash library for longer ones. Runs of words are sums of powers over these hashes;
they choose places and groups, and where two runs have to be the same the callers compare more.
"""

from __future__ import annotations

import numpy as np

from .word_cache import SHORT, lanes

_A, _B, _C = map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
_MULTIPLIER = 0xD6E8FEB86659FD93


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of one text (or of a part of it), joined by single spaces."""

    def __init__(self, words: list[bytes]):
        self.raw = b" ".join(words)
        text = np.frombuffer(self.raw, np.uint8)
        gaps = np.flatnonzero(text == 32)
        self.starts = np.concatenate(([0], gaps + 1))
        self.ends = np.append(gaps, len(text))
        size = self.ends - self.starts
        first, second = lanes(text, self.starts, size)
        self.hashes = mixed(mixed(first * _A + size.astype(np.uint64)) + second * _B)
        for k in np.flatnonzero(size > SHORT).tolist():
            import xxhash

            self.hashes[k] = xxhash.xxh64_intdigest(self.raw[self.starts[k] : self.ends[k]], 3)

    def __len__(self) -> int:
        return len(self.starts)

    def runs(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word that has so many."""
        n = len(self) - size + 1
        out = np.zeros(n, np.uint64)
        if size <= 8:  # a factor of its own for each place
            for k in range(size):
                out += mixed(self.hashes[k : k + n] + np.uint64(k + 1)) * (_A + np.uint64(2 * k))
            return mixed(out)
        power = _powers(len(self) + 1, _MULTIPLIER)
        back = _powers(len(self) + 1, pow(_MULTIPLIER, -1, 1 << 64))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(self.hashes * power[:-1])))
        return mixed((sums[size:] - sums[:n]) * back[:n])


_KEPT: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """Powers of base mod 2^64 from the zeroth on; as many as the longest run of words so far needs."""
    if base not in _KEPT or len(_KEPT[base]) < n:
        _KEPT[base] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1 << 12) - 1, np.uint64(base)))))
    return _KEPT[base][:n]
