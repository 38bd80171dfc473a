"""Ids of texts whose encoding is that of their space-parted words, one numpy pass per group of texts.

Words are found over the joined bytes and looked up in a table of fixed size, in which each has two
places, and their ids are gathered; only words that the table lacks go to the encoder, once per group. A slot holds the
word itself (its bytes in two machine words, its length and whether it begins a text), and a hit
compares all of them: hashes choose slots and never stand for words. Words of more than 16 bytes are
kept by their bytes in a dictionary of bounded bytes; words of more than LONGEST_KEPT bytes are encoded
anew for each group of texts that has them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

SHORT = 16  # bytes of the longest word that a slot can hold
LONG_BYTES = 24 << 20  # of the longer words that are kept, with their ids and what each entry takes
LONGEST_KEPT = 4096
_ENTRY = 300
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD)))


def lanes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The first SHORT bytes of each word as integers of eight bytes, zeros behind its end."""
    padded = np.concatenate((raw, np.zeros(SHORT, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(raw) + SHORT - 7,), (1,))
    return [eight[start + at] & _KEEP[np.clip(size - at, 0, 8)] for at in range(0, SHORT, 8)]


class WordCache:
    """encode(words, first) -> ids of each word; first says whether a word begins its text."""

    def __init__(self, encode: Callable[[list[bytes], list[bool]], list[list[int]]], mark_first: bool, vocabulary: int, bits: int = 20, width: int = 12, group: int = 1 << 19):
        self.encode, self.mark_first, self.shift, self.width, self.group = encode, mark_first, np.uint64(64 - bits), width, group
        self.dtype = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.key = [np.zeros(1 << bits, np.uint64) for _ in range(SHORT // 8)]
        self.code = np.zeros(1 << bits, np.uint8)  # 0: free; else twice the length, and whether it begins a text
        self.size = np.zeros(1 << bits, np.uint8)
        self.ids = np.zeros((1 << bits, width), self.dtype)
        self.long: dict[tuple[bytes, bool], np.ndarray] = {}
        self.long_bytes = 0

    def _known_long(self, words: list[tuple[bytes, bool]]) -> list[np.ndarray]:
        new = list(dict.fromkeys(w for w in words if w not in self.long))
        fresh: dict[tuple[bytes, bool], np.ndarray] = {}
        if new:
            got = self.encode([w for w, _ in new], [f for _, f in new])
            fresh = dict(zip(new, (np.array(g, self.dtype) for g in got), strict=True))
        found = [fresh[w] if w in fresh else self.long[w] for w in words]
        for word, ids in fresh.items():
            size = len(word[0]) + ids.nbytes + _ENTRY
            if len(word[0]) > LONGEST_KEPT or size > LONG_BYTES:
                continue
            if self.long_bytes + size > LONG_BYTES:
                self.long.clear()
                self.long_bytes = 0
            self.long[word] = ids
            self.long_bytes += size
        return found

    def _same(self, slot: np.ndarray, code: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
        """Which slots hold exactly these words."""
        hit = self.code[slot] == code
        for key, part in zip(self.key, parts, strict=True):
            hit &= key[slot] == part
        return hit

    def _group(self, texts: list[bytes], begins: list[bool]) -> list[np.ndarray]:
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        gaps = np.flatnonzero(raw == 32)
        start, end = np.concatenate(([0], gaps + 1)), np.append(gaps, len(raw))
        length = end - start
        words_of = np.array([t.count(b" ") + 1 for t in texts])
        text_end = np.cumsum(words_of)
        first = np.zeros(len(start), bool)
        if self.mark_first:
            first[text_end - words_of] = begins
        short = length <= SHORT
        code = np.where(short, 2 * (length + 1) + first, 0).astype(np.uint8)
        parts = lanes(raw, start, length)
        h = code.astype(np.uint64)
        for part, factor in zip(parts, _MIX, strict=True):
            h += part
            h *= factor
            h ^= h >> np.uint64(32)
        slot = ((h * _MIX[0]) >> self.shift).view(np.int64)
        hit = self._same(slot, code, parts) & short
        again = np.flatnonzero(~hit & short)  # a word that finds its place taken has another
        other = ((h[again] * _MIX[1]) >> self.shift).view(np.int64)
        found = self._same(other, code[again], [part[again] for part in parts])
        slot[again[found]] = other[found]
        hit[again[found]] = True
        table, size = self.ids[slot], self.size[slot].astype(np.int64)
        apart: dict[int, np.ndarray] = {}  # words whose ids don't come from the table
        miss, other = again[~found], other[~found]
        body = raw.tobytes() if len(miss) or not short.all() else b""
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            # words that share a hash but aren't the same are entries of their own
            odd = code[miss] != code[miss[one]][back]
            for part in parts:
                odd |= part[miss] != part[miss[one]][back]
            back[odd] = len(one) + np.arange(int(odd.sum()))
            mine = np.concatenate((one, np.flatnonzero(odd)))
            at = miss[mine]
            got = self.encode([body[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)], first[at].tolist())
            n = np.fromiter(map(len, got), np.int64, len(got))
            fits = n <= self.width
            new = np.zeros((len(got), self.width), self.dtype)
            new[(np.arange(self.width) < n[:, None]) & fits[:, None]] = np.fromiter((i for g, f in zip(got, fits.tolist(), strict=True) if f for i in g), self.dtype)
            table[miss], size[miss] = new[back], n[back]
            store = np.flatnonzero(fits)
            of = at[store]
            to = np.where(self.code[slot[of]] == 0, slot[of], other[mine[store]])
            to, last = np.unique(to[::-1], return_index=True)  # one of the words that want a slot gets all of it
            store, of = store[::-1][last], of[::-1][last]
            for key, part in zip(self.key, parts, strict=True):
                key[to] = part[of]
            self.code[to], self.size[to], self.ids[to] = code[of], n[store], new[store]
            if not fits.all():
                apart = {int(w): np.array(got[b], self.dtype) for w, b in zip(miss.tolist(), back.tolist(), strict=True) if not fits[b]}
        if not short.all():
            at = np.flatnonzero(~short).tolist()
            apart |= zip(at, self._known_long([(body[start[i] : end[i]], bool(first[i])) for i in at]), strict=True)
            size[at] = [len(apart[i]) for i in at]
        ends = np.cumsum(size)
        if apart:
            out = np.empty(int(ends[-1]), self.dtype)
            inside = size.copy()
            free = np.ones(len(out), bool)
            for w, ids in apart.items():
                out[ends[w] - size[w] : ends[w]] = ids
                free[ends[w] - size[w] : ends[w]] = False
                inside[w] = 0
            out[free] = table[np.arange(self.width) < inside[:, None]]
        else:
            out = table[np.arange(self.width) < size[:, None]]
        return np.split(out, ends[text_end[:-1] - 1])

    def encode_parts(self, parts: list[tuple[bytes, bool]]) -> list[np.ndarray]:
        """Ids of each part; the flag says whether it begins a text. Other parts follow a space, which is
        not in them and belongs to their first word. Parts of any length are encoded in bounded memory."""
        cut: list[tuple[bytes, bool]] = []
        pieces: list[int] = []  # of each part
        for text, begins in parts:
            at, n = 0, 1
            while len(text) - at > self.group and (gap := text.find(b" ", at + self.group)) >= 0:
                cut.append((text[at:gap], begins and at == 0))
                at, n = gap + 1, n + 1
            cut.append((text[at:] if at else text, begins and at == 0))
            pieces.append(n)
        out: list[np.ndarray] = []
        at = 0
        while at < len(cut):
            upto, size = at, 0
            while upto < len(cut) and size < self.group:
                size += len(cut[upto][0])
                upto += 1
            out += self._group([t for t, _ in cut[at:upto]], [f for _, f in cut[at:upto]])
            at = upto
        if len(out) == len(parts):
            return out
        ends = np.cumsum(pieces)
        return [out[e - n] if n == 1 else np.concatenate(out[e - n : e]) for e, n in zip(ends.tolist(), pieces, strict=True)]
