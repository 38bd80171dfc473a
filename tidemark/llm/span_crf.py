"""Personal data in whole texts: fixed patterns, and a semi-Markov conditional random field that adds spans.

The field labels stretches of tokens, not single tokens: a candidate segment (at most ``longest`` tokens)
is scored by features of the whole span, such as its digits, separators, groups, check digit, neighbours
and the word before it, and a segmentation by the sum over its segments and the pairs of kinds that
follow each other. Tokens outside of segments are single ones of kind none, so that entities are bounded
and the dynamic programme over boundaries and kinds has longest x kinds^2 steps a token. A segment whose
score can't beat leaving its tokens alone, whatever stands beside it, is in no best segmentation and is
dropped before; the programme over the others is exact.

Entities hold a digit or an at sign, so only regions are looked at: runs of pieces (between white space)
that hold one, parted by single spaces. Regions of many texts are scored together, in numpy.

The weights are fitted by maximum likelihood (forward and backward sums over all segmentations) on a
bounded sample of distinct regions, labelled by the patterns: at most ``sample`` of each kind and of none,
picked by a hash from all documents, of at most ``sample_tokens`` tokens. The patterns' own spans always
stay; the field's are added where they touch none.

Defined results: a null text is an empty one and has no span; texts are searched whole, whatever their
length; rows that repeat, and null doc_ids, are rows of their own; of kinds that overlap, the patterns'
spans all stay; offsets count code points; with no span to learn from nothing is added; further columns
are not looked at; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, free_name, lean, materialise, small_batches

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)  # as the last label of a segmentation
Span = tuple[int, int, int]  # start, end, kind

# The patterns and what they have to pass.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)

_SEED = re.compile(r"[0-9@]+")
_PIECE = re.compile(r"[^\x20\x09-\x0D]*")
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_TOKEN = re.compile(r"[^\W_]+|[^\x20\x09-\x0D]")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[\W_]*\Z")
_SYMBOLS = {".": 3, "-": 4, "@": 5, "(": 6, ")": 7, "+": 8, ":": 9, "_": 10, "%": 10}
_DIGITS, _LETTERS, _MIXED, _OTHER, _EDGE = 0, 1, 2, 11, 12
_WORDS = 256  # buckets of the word before


@dataclass(frozen=True)
class SpanField:
    longest: int = 16  # tokens of a segment
    chars: int = 80
    sample: int = 128
    sample_tokens: int = 40
    steps: int = 60
    rate: float = 0.3
    prior: float = 1e-3  # squared weights, for each region


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Of each at sign what the pattern takes left and right of it; a local part begins behind the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain and (local := _LOCAL.search(text, max(done, _run_start(text, at, done)), at)):
            yield local.start(), domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _run_start(text: str, end: int, least: int) -> int:
    while end > least and text[end - 1] in _LOCAL_CHARS:
        end -= 1
    return end


def _small(number: str) -> bool:
    short = number.lstrip("0")
    return len(short) < 4 and int(short or "0") <= 255


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of pieces with a digit or an at sign, parted by single spaces."""
    end = 0
    for seed in _SEED.finditer(text):
        s = seed.start()
        if s < end:
            continue
        begin = max(text.rfind(c, end, s) for c in _WHITE) + 1
        begin = max(begin, end)
        end = _PIECE.match(text, s).end()
        while text[end : end + 1] == " ":
            more = _PIECE.match(text, end + 1).end()
            if not _SEED.search(text, end + 1, more):
                break
            end = more
        yield begin, end


def base_spans(text: str, found: list[tuple[int, int]] | None = None) -> list[Span]:
    """The patterns' spans, by start and kind. All but telephone numbers lie within regions (found)."""
    spans: list[Span] = []
    for begin, end in regions(text) if found is None else found:
        part = text[begin:end]
        if "@" in part:
            spans += [(begin + s, begin + e, 0) for s, e in _emails(part)]
        if part.count(".") > 2:
            spans += [(begin + m.start(), begin + m.end(), 1) for m in _IP.finditer(part) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(part):
            if m.end() - m.start() >= CARD_DIGITS[0]:
                digits = m[0].replace(" ", "").replace("-", "")
                if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                    spans.append((begin + m.start(), begin + m.end(), 2))
    for m in _PHONE.finditer(text):
        if PHONE_DIGITS[0] <= sum(map(str.isdigit, m[0])) <= PHONE_DIGITS[1]:
            spans.append((m.start(), m.end(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


class Tokens:
    """Tokens of many regions, one after the other."""

    def __init__(self) -> None:
        self.start: list[int] = []
        self.end: list[int] = []
        self.kind: list[int] = []
        self.word: list[int] = []  # bucket of the word before
        self.text: list[str] = []
        self.first = [0]  # first token of each region, and the number of all

    def add(self, text: str, begin: int, end: int) -> None:
        before = _WORD_BEFORE.search(text, max(0, begin - 32), begin)
        word = _bucket(before[1]) if before else 0
        for m in _TOKEN.finditer(text, begin, end):
            t = m[0]
            kind = _SYMBOLS.get(t)
            if kind is None:
                kind = _OTHER if not t[0].isalnum() else _MIXED if not t.isascii() else _DIGITS if t.isdigit() else _LETTERS if t.isalpha() else _MIXED
            self.start.append(m.start())
            self.end.append(m.end())
            self.kind.append(kind)
            self.word.append(word)
            self.text.append(t)
            if kind == _LETTERS:
                word = _bucket(t)
        self.first.append(len(self.text))

    def __len__(self) -> int:
        return len(self.text)


def _bucket(word: str) -> int:
    return 1 + zlib.crc32(word.lower().encode()) % (_WORDS - 1)


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values)))


#: Number of values of each feature; a feature's weights lie one after the other.
_FEATURES = (25, 13 * 13, 5 * 5 * 3 * 2 * 2 * 4, 6 * 3, 9 * 8, 26, 26, 4, 4, 17, _WORDS, 1)
_OFFSETS = np.concatenate(([0], np.cumsum(_FEATURES)))
N_WEIGHTS = int(_OFFSETS[-1])


def candidates(tokens: Tokens, cfg: SpanField) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, tokens, features) of all candidate segments: of one region, from a letter, digit, plus
    or bracket to a letter or digit, with a digit or at sign, parted by single spaces at most."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(_FEATURES)), np.int64)
    start, end, kind, word = (np.array(x, np.int64) for x in (tokens.start, tokens.end, tokens.kind, tokens.word))
    first = np.array(tokens.first)
    region = np.repeat(np.arange(len(first) - 1), np.diff(first))
    opens = np.zeros(n, bool)
    opens[first[:-1][np.diff(first) > 0]] = True
    space = ~opens & (start != np.concatenate(([0], end[:-1])))  # a space before it
    count = {k: _sums(kind == k) for k in range(12)}
    spaces = _sums(space)
    digits_of = np.where(kind == _DIGITS, end - start, 0)
    digits = _sums(digits_of)
    wide = np.where(kind == _DIGITS, np.searchsorted([2, 3, 4, 5, 9, 12, 20], digits_of, "right"), -1)
    large = _sums([k == _DIGITS and not _small(t) for k, t in zip(tokens.kind, tokens.text, strict=True)])
    # check digits: sums with the doubled ones at even and at odd places
    every = np.frombuffer("".join(t for k, t in zip(tokens.kind, tokens.text, strict=True) if k == _DIGITS).encode(), np.uint8).astype(np.int64) - 48
    doubled = np.array([0, 2, 4, 6, 8, 1, 3, 5, 7, 9])[every]
    even = np.arange(len(every)) % 2 == 0
    check = np.stack([_sums(np.where(even, every, doubled)), _sums(np.where(even, doubled, every))])

    out_first, out_size, out = [], [], []
    widest = wide.copy()
    for size in range(1, cfg.longest + 1):
        i = np.arange(n - size + 1)
        if not len(i):
            break
        j = i + size - 1
        if size > 1:
            widest = np.maximum(widest[:-1], wide[size - 1 :])
        some = (count[_DIGITS][j + 1] > count[_DIGITS][i]) | (count[5][j + 1] > count[5][i]) | (count[_MIXED][j + 1] > count[_MIXED][i])
        ok = some & (region[i] == region[j]) & ((kind[i] <= _MIXED) | (kind[i] == 8) | (kind[i] == 6)) & (kind[j] <= _MIXED) & (end[j] - start[i] <= cfg.chars)
        i, j, high = i[ok], j[ok], widest[ok]
        if not len(i):
            continue
        of = lambda sums, i=i, j=j: sums[j + 1] - sums[i]
        at = lambda k, most, of=of: np.minimum(of(count[k]), most)
        gaps = np.minimum(spaces[j + 1] - spaces[i + 1], 3)
        parens = (of(count[6]) + of(count[7]) > 0).astype(np.int64)
        signature = ((((at(3, 4) * 5 + at(4, 4)) * 3 + at(5, 2)) * 2 + at(8, 1)) * 2 + parens) * 4 + gaps
        others = np.minimum(of(count[9]) + of(count[10]) + of(count[_OTHER]), 2)
        letters = np.minimum(of(count[_LETTERS]) + of(count[_MIXED]), 5)
        n_digits = of(digits)
        left = np.where(opens[i], _EDGE, kind[np.maximum(i - 1, 0)]) * 2 + space[i]
        after = np.minimum(j + 1, n - 1)
        closed = (j + 1 >= n) | opens[after]
        right = np.where(closed, _EDGE, kind[after]) * 2 + np.where(closed, 0, space[after])
        parity = (digits[j + 1] - 1) % 2  # the last digit's place isn't doubled
        total = check[parity, digits[j + 1]] - check[parity, digits[i]]
        card = (n_digits >= CARD_DIGITS[0]) & (n_digits <= CARD_DIGITS[1])
        features = np.column_stack([
            np.minimum(n_digits, 24), kind[i] * 13 + kind[j], signature, letters * 3 + others,
            np.minimum(of(count[_DIGITS]), 8) * 8 + np.maximum(high, 0), left, right,
            (of(large) == 0) * 2 + (of(count[3]) == 3), card * 2 + (card & (total % 10 == 0)), np.full(len(i), size), word[i], np.zeros(len(i), np.int64),
        ])
        out_first.append(i)
        out_size.append(np.full(len(i), size))
        out.append(features + _OFFSETS[:-1])
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(_FEATURES)), np.int64)
    return np.concatenate(out_first), np.concatenate(out_size), np.concatenate(out)


@dataclass(frozen=True)
class Weights:
    spans: np.ndarray  # (kinds, N_WEIGHTS)
    pairs: np.ndarray  # (kinds + 1, kinds + 1): label before, label; none after none is 0

    def scores(self, features: np.ndarray) -> np.ndarray:
        """(segments, kinds)."""
        out = np.zeros((len(features), len(KINDS)))
        for column in features.T:
            out += self.spans[:, column].T
        return out


def best_segments(size: int, first: list[int], length: list[int], scores: np.ndarray, weights: Weights) -> list[tuple[int, int, int]]:
    """(first token, tokens, kind) of the segments of the best segmentation of ``size`` tokens; of equally
    good ones, one with the fewest segments."""
    pairs = weights.pairs.tolist()
    labels = range(NONE + 1)
    ending: dict[int, list[int]] = {}
    for c, (f, n) in enumerate(zip(first, length, strict=True)):
        ending.setdefault(f + n, []).append(c)
    low = -np.inf
    best: list[list[tuple[float, int]]] = [[(low, 0)] * NONE + [(0.0, 0)]]  # (score, -segments)
    back: list[list[tuple | None]] = [[None] * (NONE + 1)]
    for end in range(1, size + 1):
        now: list[tuple[float, int]] = [(low, 0)] * (NONE + 1)
        come: list[tuple | None] = [None] * (NONE + 1)
        for y in labels:
            s, k = best[end - 1][y]
            if (got := (s + pairs[y][NONE], k)) > now[NONE]:
                now[NONE], come[NONE] = got, (end - 1, y, -1)
        for c in ending.get(end, ()):
            for kind in range(NONE):
                own = float(scores[c, kind])
                for y in labels:
                    s, k = best[first[c]][y]
                    if (got := (s + pairs[y][kind] + own, k - 1)) > now[kind]:
                        now[kind], come[kind] = got, (first[c], y, c)
        best.append(now)
        back.append(come)
    out, at, y = [], size, max(labels, key=lambda y: best[size][y])
    while at:
        before, label, c = back[at][y]
        if c >= 0:
            out.append((first[c], length[c], y))
        at, y = before, label
    return out[::-1]


def segment(tokens: Tokens, weights: Weights, cfg: SpanField) -> list[list[Span]]:
    """Spans of each region's best segmentation, as offsets in its text."""
    out: list[list[Span]] = [[] for _ in tokens.first[1:]]
    first, size, features = candidates(tokens, cfg)
    scores = weights.scores(features)
    # what a segment adds at most against leaving its tokens alone
    enter = (weights.pairs[:, :NONE] - weights.pairs[:, NONE:]).max(axis=0)
    leave = (weights.pairs[:NONE] - weights.pairs[NONE:]).max(axis=1)
    live = np.flatnonzero((scores + enter + leave > 0).any(axis=1))
    region = np.searchsorted(tokens.first, first[live], "right") - 1
    for r in np.unique(region).tolist():
        own = live[region == r]
        at, upto = int(first[own].min()), int((first[own] + size[own]).max())
        upto += upto < tokens.first[r + 1]  # a token of kind none behind the last segment
        for f, n, kind in best_segments(upto - at, (first[own] - at).tolist(), size[own].tolist(), scores[own], weights):
            out[r].append((tokens.start[at + f], tokens.end[at + f + n - 1], kind))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - np.where(np.isfinite(top), top, 0)).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


class Sample:
    """Regions with their labelled segments, padded to one length, for the likelihood."""

    def __init__(self, texts: list[tuple[str, int]], cfg: SpanField):
        """texts: (text, where its region begins); what stands before gives the word before."""
        tokens, gold = Tokens(), []
        for r, (text, begin) in enumerate(texts):
            at = len(tokens)
            tokens.add(text, begin, len(text))
            starts = {s: i for i, s in enumerate(tokens.start[at:], at)}
            ends = {e: i for i, e in enumerate(tokens.end[at:], at)}
            done = at
            for s, e, kind in sorted(base_spans(text), key=lambda s: (s[0], -s[1])):
                if s in starts and e in ends and starts[s] >= done:
                    gold.append((starts[s], ends[e] - starts[s] + 1, kind))
                    done = ends[e] + 1
        first, size, self.features = candidates(tokens, cfg)
        region = np.searchsorted(tokens.first, first, "right") - 1
        self.cell = (region, first - np.array(tokens.first)[region], size - 1)
        self.length = np.diff(tokens.first)
        self.shape = (len(texts), int(self.length.max(initial=1)), cfg.longest)
        known = {(f, n): c for c, (f, n) in enumerate(zip(first.tolist(), size.tolist(), strict=True))}
        self.gold = [(known[f, n], kind) for f, n, kind in gold if (f, n) in known]
        self.pairs = np.zeros((NONE + 1, NONE + 1))
        held = {(int(region[c]), int(self.cell[1][c])): (int(size[c]), kind) for c, kind in self.gold}
        for r, n in enumerate(self.length.tolist()):
            at, y = 0, NONE
            while at < n:
                step, label = held.get((r, at), (1, NONE))
                self.pairs[y, label] += 1
                at, y = at + step, label

    def loss(self, weights: Weights) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log likelihood, and its slopes by both kinds of weights."""
        b, n, most = self.shape
        kinds = NONE
        scores = weights.scores(self.features)
        s = np.full((b, n, most, kinds), -np.inf)
        s[self.cell] = scores
        into = np.full((b, n + 1, kinds + 1), -np.inf)  # sums of what leads to a segment of a kind that begins here
        alpha = np.full((b, n + 1, kinds + 1), -np.inf)
        alpha[:, 0, NONE] = 0
        for at in range(n + 1):
            if at:
                alpha[:, at, NONE] = into[:, at - 1, NONE]
                reach = np.arange(min(at, most))
                alpha[:, at, :kinds] = _logsum(into[:, at - 1 - reach, :kinds] + s[:, at - 1 - reach, reach], 1)
            into[:, at] = _logsum(alpha[:, at, :, None] + weights.pairs, 1)
        rows = np.arange(b)
        total = _logsum(alpha[rows, self.length], 1)
        beta = np.full((b, n + 1, kinds + 1), -np.inf)
        begin = np.full((b, n + 1, kinds + 1), -np.inf)  # sums of what a segment of a kind that begins here leads to
        for at in range(n, -1, -1):
            if at < n:
                begin[:, at, NONE] = beta[:, at + 1, NONE]
                reach = np.arange(min(n - at, most))
                begin[:, at, :kinds] = _logsum(s[:, at, reach] + beta[:, at + 1 + reach, :kinds], 1)
                beta[:, at] = _logsum(begin[:, at, None, :] + weights.pairs, 2)
            beta[self.length == at, at] = 0
        region, at, reach = self.cell
        share = np.exp(into[region, at, :kinds] + scores + beta[region, at + reach + 1, :kinds] - total[region, None])
        by_span = np.zeros_like(weights.spans)
        for c, kind in self.gold:
            share[c, kind] -= 1
        for column in self.features.T:
            for kind in range(kinds):
                by_span[kind] += np.bincount(column, share[:, kind], N_WEIGHTS)
        met = alpha[:, :n, :, None] + weights.pairs + begin[:, :n, None, :] - total[:, None, None, None]
        by_pair = np.exp(met).sum(axis=(0, 1)) - self.pairs
        right = sum(scores[c, kind] for c, kind in self.gold) + (self.pairs * weights.pairs).sum()
        by_pair[NONE, NONE] = 0
        return float(total.sum() - right), by_span, by_pair


def fit(texts: list[tuple[str, int]], cfg: SpanField) -> Weights | None:
    """Maximum likelihood by Adam steps over the whole sample; None without a labelled segment."""
    sample = Sample(texts, cfg)
    if not sample.gold:
        return None
    parts = [np.zeros((NONE, N_WEIGHTS)), np.zeros((NONE + 1, NONE + 1))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]
    for t in range(1, cfg.steps + 1):
        _, *slopes = sample.loss(Weights(*parts))
        for i, slope in enumerate(slopes):
            g = slope / len(texts) + cfg.prior * parts[i]
            first, second = moments[i]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            step = cfg.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
            parts[i] = parts[i] - step
            if i:
                parts[i][NONE, NONE] = 0
    return Weights(*parts)


def sample_regions(docs: DataFrame, cfg: SpanField, text_col: str, keep) -> list[tuple[str, int]]:
    """Distinct regions from all documents, each with up to 32 letters before it. A task gives the least
    hashes of each kind, and the least of these make the sample."""
    schema = "kind int, h long, text string, begin int"

    def run(batches) -> Iterator:
        import heapq

        import pyarrow as pa
        import xxhash

        held: list[list[tuple]] = [[] for _ in range(NONE + 1)]
        met: list[set] = [set() for _ in range(NONE + 1)]
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for begin, end in regions(text or ""):
                    if end - begin > cfg.sample_tokens * 8:
                        continue
                    from_ = max(0, begin - 32)
                    part = text[from_:end]
                    h = xxhash.xxh64_intdigest(part[begin - from_ :].encode(), 12) >> 1
                    tokens = None
                    for kind in {k for _, _, k in base_spans(part)} or {NONE}:
                        if h in met[kind] or (len(held[kind]) >= cfg.sample and h >= -held[kind][0][0]):
                            continue
                        if tokens is None:
                            tokens = Tokens()
                            tokens.add(part, begin - from_, len(part))
                        if len(tokens) > cfg.sample_tokens:
                            continue
                        met[kind].add(h)
                        heapq.heappush(held[kind], (-h, part, begin - from_))
                        if len(held[kind]) > cfg.sample:
                            met[kind].discard(-heapq.heappop(held[kind])[0])
        rows = [(kind, -h, part, begin) for kind, own in enumerate(held) for h, part, begin in own]
        if rows:
            kind, h, part, begin = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(h, pa.int64()), pa.array(part), pa.array(begin, pa.int32())], ["kind", "h", "text", "begin"])

    found = keep(docs.select(F.col(text_col)).mapInArrow(lean(run), schema), "regions")
    each = found.groupBy("kind", "h").agg(F.min(F.struct("text", "begin")).alias("r"))
    out: dict[str, int] = {}
    for kind in range(NONE + 1):
        for r in each.filter(F.col("kind") == kind).orderBy("h").limit(cfg.sample).collect():
            out[r.r.text] = r.r.begin
    return sorted(out.items())


def _overlaps(span: Span, others: list[Span]) -> bool:
    return any(span[0] < e and s < span[1] for s, e, _ in others)


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, cfg: SpanField = SpanField(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per document: doc_id, n_email, n_ip, n_card, n_phone (the patterns' spans), base_sha256 (hash of
    these spans as text), spans (all, kind:start:end by start and kind), n_added."""
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "span-field")
    texts = sample_regions(docs, cfg, text_col, work.keep)
    sent = spark.sparkContext.broadcast(fit(texts, cfg) if texts else None)
    counts = [f"n_{k}" for k in KINDS]

    def solve(texts: list[str]) -> list[tuple]:
        tokens, owner, base = Tokens(), [], []
        added: list[list[Span]] = [[] for _ in texts]

        def settle() -> None:
            for d, spans in zip(owner, segment(tokens, sent.value, cfg), strict=True):
                added[d] += spans

        for d, text in enumerate(texts):
            found = list(regions(text))
            base.append(base_spans(text, found))
            if sent.value is None:
                continue
            for begin, end in found:
                tokens.add(text, begin, end)
                owner.append(d)
                if len(tokens) > 1 << 15:
                    settle()
                    tokens, owner = Tokens(), []
        if owner:
            settle()
        rows = []
        for own, more in zip(base, added, strict=True):
            more = [s for s in more if not _overlaps(s, own)]
            n = [sum(k == kind for _, _, k in own) for kind in range(NONE)]
            every = sorted([*own, *more], key=lambda s: (s[0], s[2], s[1]))
            rows.append((*n, hashlib.sha256(_written(own).encode()).hexdigest(), _written(every), len(more)))
        return rows

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = solve([t or "" for t in batch.column(1).to_pylist()])
            if rows:
                *n, digest, spans, more = zip(*rows, strict=True)
                cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(digest), pa.array(spans), pa.array(more, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *counts, "base_sha256", "spans", "n_added"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string, n_added long"
    return work.result(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run), schema), "spans")


def redact_text(text: str, spans: str) -> str:
    """text with each stretch of spans (as ``find`` writes them) replaced by its kind in capitals."""
    out, at = [], 0
    for kind, s, e in sorted((x.split(":") for x in spans.split(",") if x), key=lambda x: (int(x[1]), -int(x[2]))):
        if int(s) >= at:
            out += [text[at : int(s)], f"<{kind.upper()}>"]
        elif int(e) <= at:
            continue
        at = int(e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, cfg: SpanField = SpanField(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the personal data that ``find`` finds. Rows are matched by a number of their own."""
    number = free_name(docs, "row_number")
    numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = find(numbered.select(F.col(number).alias("n"), F.col(text_col).alias("t")), cfg, "n", "t")
    spans = free_name(docs, "spans")

    @F.pandas_udf("string")
    def cut(texts, found):
        return texts.combine(found, lambda t, s: t if t is None or not s else redact_text(t, s))

    facts = found.select(F.col("doc_id").alias(f"{number}_f"), F.col("spans").alias(spans)).filter(F.col(spans) != "")
    joined = numbered.join(facts, F.col(number) == F.col(f"{number}_f"), "left")
    return joined.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(cut(text_col, spans))).select(*docs.columns)
