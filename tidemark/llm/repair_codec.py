"""Re-Pair grammar compression of token ids (numpy, one shard at a time).

Each round counts the adjacent pairs of the sequence, takes the most frequent ones of which no two can
overlap, and replaces every occurrence by a new nonterminal, until no pair is left that pays for its
rule. The sequence is a linked list, and a round looks only at places whose pair can be frequent: a
pair that was rare stays rare, so later rounds visit little more than what the round before changed.

A shard keeps its rules, the number of ids each nonterminal expands to, the remaining symbols, and the
first id of every STEP-th symbol. A file ends with the place and first id of each shard. Random access
reads the file's end, one shard's rules and marks, and the symbols between two marks; only those that
cover the range are expanded.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MAGIC = b"RPG2"
INDEX = b"RPGX"
STEP = 1024  # symbols from one mark to the next
#: A rule costs two symbols and a length of 32 bits, less than four symbols of 17 bits or more; an
#: occurrence saves one symbol.
MIN_COUNT = 4


@dataclass
class Grammar:
    base: int  # ids below base are terminals
    left: np.ndarray
    right: np.ndarray
    sizes: np.ndarray  # ids that each nonterminal expands to
    sequence: np.ndarray

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol expands to."""
        out = np.ones(len(symbols), np.int64)
        inner = symbols >= self.base
        out[inner] = self.sizes[symbols[inner] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a run of symbols: terminals are put in place, nonterminals become their halves."""
        ends = np.cumsum(self.lengths(symbols))
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        place = np.concatenate((ends[:0], [0], ends[:-1])) if len(ends) else ends
        while len(symbols):
            done = symbols < self.base
            out[place[done]] = symbols[done]
            rule, place = symbols[~done] - self.base, place[~done]
            left = self.left[rule]
            symbols = np.concatenate((left, self.right[rule]))
            place = np.concatenate((place, place + self.lengths(left)))
        return out

    def decode(self) -> np.ndarray:
        return self.expand(self.sequence)


def _choose(firsts: list[int], seconds: list[int]) -> np.ndarray:
    """Numbers of the pairs to replace: each in turn, unless it can share an occurrence's symbol with one
    that is taken already."""
    begins: set[int] = set()
    ends: set[int] = set()
    chosen = []
    for k, (a, b) in enumerate(zip(firsts, seconds, strict=True)):
        if a in ends or b in begins or (a == b and (a in begins or b in ends)):
            continue
        begins.add(a)
        ends.add(b)
        chosen.append(k)
    return np.array(chosen, np.int64)


def _without_overlaps(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which of the places, in ascending order, are every second one of their run of neighbours."""
    start = np.concatenate(([True], following[at[:-1]] != at[1:]))
    number = np.arange(len(at))
    return (number - np.maximum.accumulate(np.where(start, number, 0))) % 2 == 0


def _sorted(pairs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, pairs in order), equal pairs as they stood. Symbols have the given number of bits, so that
    a pair and its number mostly fit in one integer, which sorts faster."""
    room = len(pairs).bit_length()
    if 2 * bits + room > 63:
        order = np.argsort(pairs, kind="stable")
        return order, pairs[order]
    low = (1 << bits) - 1
    both = ((pairs >> 32) << bits | (pairs & 0xFFFFFFFF)) << room | np.arange(len(pairs))
    both.sort()
    pairs = both >> room
    return both & ((1 << room) - 1), (pairs >> bits) << 32 | (pairs & low)


def compress(ids: np.ndarray, base: int, min_count: int = MIN_COUNT) -> Grammar:
    """Goes on until no pair occurs min_count times without overlaps."""
    n = len(ids)
    if n and int(ids.max()) >= base:
        raise ValueError("ids are less than the vocabulary's size")
    symbols = ids.astype(np.int32)
    following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    alive = np.ones(n, bool)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    sizes = np.empty(0, np.int64)
    rules = 0
    look = np.arange(n - 1, dtype=np.int32)  # places whose pair can be frequent, ascending
    while len(look) >= min_count:
        a, b = symbols[look], symbols[following[look]]
        pair = a.astype(np.int64) << 32 | b
        counted = np.ones(len(look), bool)
        same = np.flatnonzero(a == b)
        if len(same):
            counted[same] = _without_overlaps(look[same], following)
        order, ordered = _sorted(pair, int(base + rules).bit_length())
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        sizes_of = np.diff(np.append(heads, len(ordered)))
        counts = sizes_of
        if not counted.all():
            over = np.searchsorted(ordered[heads], pair[~counted])
            counts = sizes_of - np.bincount(over, minlength=len(heads))
        frequent = np.flatnonzero(counts >= min_count)
        if not len(frequent):
            break
        frequent = frequent[np.argsort(-counts[frequent], kind="stable")]
        keys = ordered[heads[frequent]]
        chosen = _choose((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist())
        symbol_of = np.zeros(len(heads), np.int32)  # 0: rare; -1: frequent, but not replaced in this round
        symbol_of[frequent] = -1
        symbol_of[frequent[chosen]] = base + rules + np.arange(len(chosen))
        new = np.empty(len(look), np.int32)
        new[order] = np.repeat(symbol_of, sizes_of)
        taken = (new > 0) & counted
        kept = look[(new != 0) & ~taken]
        at, new = look[taken], new[taken]
        second = following[at]
        after = following[second]
        symbols[at], following[at] = new, after
        before[after] = at  # before has a place behind the last, for the end
        alive[second] = False
        first_half, second_half = keys[chosen] >> 32, keys[chosen] & 0xFFFFFFFF
        left.append(first_half)
        right.append(second_half)
        part = Grammar(base, None, None, sizes, None)
        sizes = np.concatenate((sizes, part.lengths(first_half) + part.lengths(second_half)))
        rules += len(chosen)
        again = np.concatenate((kept, at, before[at]))
        if len(again) > n >> 5:
            seen = np.zeros(n + 1, bool)
            seen[again] = True
            look = np.flatnonzero(seen[:n]).astype(np.int32)
        else:
            look = np.unique(again)
            look = look[look >= 0]
        look = look[alive[look] & (following[look] < n)]
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return Grammar(base, join(left), join(right), sizes, symbols[alive].astype(np.int64))


def _pack(values: np.ndarray, width: int) -> bytes:
    """Low 16 bits of each value, then a bit plane for each further bit."""
    planes = [np.packbits(((values >> bit) & 1).astype(bool)).tobytes() for bit in range(16, width)]
    return b"".join([(values & 0xFFFF).astype("<u2").tobytes(), *planes])


def _packed_size(n: int, width: int) -> int:
    return 2 * n + (width - 16) * -(-n // 8)


def _unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    out = np.frombuffer(raw, "<u2", n).astype(np.int64)
    for bit, at in zip(range(16, width), range(2 * n, len(raw), -(-n // 8)), strict=False):
        out |= np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n).astype(np.int64) << bit
    return out


_HEAD = ("base", "rules", "symbols", "documents", "ids", "width")


def write_shard(out: io.RawIOBase, doc_ids: list[int | None], counts: np.ndarray, grammar: Grammar) -> int:
    """Layout, little-endian: magic, six u64 (see _HEAD); rules: left, right (packed), expansion lengths
    u32; marks u64; symbols (packed); doc ids i64, null flags u8, counts u32. Returns the bytes written."""
    ends = np.cumsum(grammar.lengths(grammar.sequence))
    total = int(ends[-1]) if len(ends) else 0
    if max(total, int(counts.max(initial=0))) >> 32:
        raise ValueError("a shard holds fewer than 2^32 ids")
    width = max(16, int(grammar.base + len(grammar.left)).bit_length())
    head = [grammar.base, len(grammar.left), len(grammar.sequence), len(doc_ids), total, width]
    body = b"".join(
        [
            MAGIC,
            np.array(head, "<u8").tobytes(),
            _pack(grammar.left, width),
            _pack(grammar.right, width),
            grammar.sizes.astype("<u4").tobytes(),
            np.concatenate(([0], ends))[:-1][::STEP].astype("<u8").tobytes(),
            _pack(grammar.sequence, width),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            counts.astype("<u4").tobytes(),
        ]
    )
    out.write(body)
    return len(body)


def write_index(out: io.RawIOBase, shards: list[tuple[int, int]]) -> int:
    """The file's end: (place, first id) of each shard, their number, magic."""
    body = np.array(shards, "<u8").tobytes() + np.array([len(shards)], "<u8").tobytes()
    out.write(INDEX + body + INDEX)
    return len(body) + 8


def _head(source: io.RawIOBase) -> dict[str, int] | None:
    """Sizes of the next shard; None behind the last."""
    mark = source.read(4)
    if not mark or mark == INDEX:
        return None
    if mark != MAGIC:
        raise ValueError("not a Re-Pair shard file")
    return dict(zip(_HEAD, np.frombuffer(source.read(48), "<u8").tolist(), strict=True))


def _rules(source: io.RawIOBase, head: dict[str, int]) -> Grammar:
    n, width = head["rules"], head["width"]
    left, right = (_unpack(source.read(_packed_size(n, width)), n, width) for _ in range(2))
    return Grammar(head["base"], left, right, np.frombuffer(source.read(4 * n), "<u4").astype(np.int64), np.empty(0, np.int64))


def read_shards(source: io.RawIOBase) -> Iterator[tuple[list[int | None], np.ndarray, Grammar]]:
    """(doc ids, token counts, grammar) of each shard of a file."""
    while head := _head(source):
        grammar, n, docs = _rules(source, head), head["symbols"], head["documents"]
        source.read(8 * -(-n // STEP))
        grammar.sequence = _unpack(source.read(_packed_size(n, head["width"])), n, head["width"])
        ids, nulls, counts = (np.frombuffer(source.read(np.dtype(kind).itemsize * docs), kind) for kind in ("<i8", "u1", "<u4"))
        yield [None if none else d for d, none in zip(ids.tolist(), nulls.tolist(), strict=True)], counts, grammar


def _read_part(source, place: int, start: int, end: int) -> np.ndarray:
    """Ids start .. end of the shard at a place of a seekable file."""
    source.seek(place)
    head = _head(source)
    grammar, n, width = _rules(source, head), head["symbols"], head["width"]
    marks = np.frombuffer(source.read(8 * -(-n // STEP)), "<u8").astype(np.int64)
    first = max(0, int(np.searchsorted(marks, start, side="right")) - 1)
    begin, stop = first * STEP, min(n, int(np.searchsorted(marks, end)) * STEP)  # STEP is whole bytes of a plane
    symbols_at, low = source.tell(), []
    source.seek(symbols_at + 2 * begin)
    low.append(source.read(2 * (stop - begin)))
    for plane in range(width - 16):
        source.seek(symbols_at + 2 * n + plane * -(-n // 8) + begin // 8)
        low.append(source.read(-(-(stop - begin) // 8)))
    symbols = _unpack(b"".join(low), stop - begin, width)
    ends = np.cumsum(grammar.lengths(symbols)) + int(marks[first])
    a, b = np.searchsorted(ends, [start, end - 1], side="right")
    skip = start - (int(ends[a - 1]) if a else int(marks[first]))
    return grammar.expand(symbols[a : b + 1])[skip : skip + end - start]


def read_range(source, start: int, length: int) -> np.ndarray:
    """Ids start .. start+length of a seekable file, as far as it has them."""
    size = source.seek(0, 2)
    source.seek(size - 12)
    count, mark = np.frombuffer(source.read(8), "<u8")[0], source.read(4)
    if mark != INDEX:
        raise ValueError("not a Re-Pair shard file")
    source.seek(size - 12 - 16 * int(count))
    index = np.frombuffer(source.read(16 * int(count)), "<u8").astype(np.int64).reshape(-1, 2)
    out = [np.empty(0, np.uint32)]
    for k in range(max(0, int(np.searchsorted(index[:, 1], start, side="right")) - 1), len(index)):
        place, begin = index[k].tolist()
        if begin >= start + length:
            break
        source.seek(place)
        ids = _head(source)["ids"]
        first, last = max(0, start - begin), min(ids, start + length - begin)
        if first < last:
            out.append(_read_part(source, place, first, last))
    return np.concatenate(out)
