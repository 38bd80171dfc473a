"""Naive Bayes support vectors: a quality classifier over n-gram indicators.

Tokens are runs of letters, digits or other signs. The n-grams are words, pairs of words, and one to
three shapes in a row (kind, case, length, and whether the word repeats the one before it or the
text's own earlier half of the pair), hashed into a fixed number of indicators. Each indicator is
scaled by its class log-count ratio, each text's vector to unit length, and a linear hinge-loss model
is fitted by dual coordinate descent. A logistic curve, fitted on rows that the descent did not see,
turns margins into scores.

The fit uses a sample of at most ``max_rows`` labelled doc_ids, picked by a hash of doc_id, one text of
each, with at most ``max_indicators`` indicators together (the first rows of the hash' order that keep to
it); the bounds are parameters and do not grow with the data, so the sample's ids are broadcast and its
indicators come to the driver. Every whole text is scored, without a shuffle.

Defined results: null text counts as empty and, like every text without a token, has the bias' score;
a doc_id with several labels has the least, and of several texts the least is learnt from; null labels are not learnt from; with no label of a class
every score is the share of label 1 among the sample (0.5 if there is none); texts of any length are
scored whole; rows that repeat are scored each; further columns of the documents are not looked at; an
empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import give_back_memory, lean, materialise, small_batches


@dataclass(frozen=True)
class NbSvm:
    buckets: int = 1 << 18
    max_rows: int = 6000
    max_indicators: int = 1 << 26  # of all sampled rows together
    alpha: float = 1.0  # smoothing of the log-count ratios
    cost: float = 1.0
    epochs: int = 20
    threshold: float = 0.7
    held_fold: int = 2  # crc32(doc_id) mod 4 of rows that are never learnt from


_MIX = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.zeros(256, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other sign
_KIND[33:128] = 3
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_POWERS = np.cumprod(np.full(1 << 16, np.uint64(0x100000001B3)))
_INVERSE = np.cumprod(np.full(1 << 16, np.uint64(pow(0x100000001B3, -1, 1 << 64))))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _block_indicators(raw: np.ndarray, flags: np.ndarray) -> None:
    buckets = np.uint64(len(flags) - 1)
    kind = _KIND[raw]
    edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    end = np.append(edge[1:], len(raw))
    word = kind[edge] > 0
    edge, end = edge[word], end[word]
    if not len(edge):
        return
    prefix = np.concatenate(([np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(raw)])))
    h = _mixed((prefix[end] - prefix[edge]) * _INVERSE[edge])
    upper = np.concatenate(([0], np.cumsum((raw >= 65) & (raw <= 90))))
    caps = upper[end] - upper[edge]
    size = end - edge
    case = np.where(caps == 0, 0, np.where(caps == 1, 1, np.where(caps == size, 2, 3)))
    again = np.zeros(len(h), np.int64)
    again[1:] += h[1:] == h[:-1]
    again[2:] += 2 * (h[2:] == h[:-2])
    bound = (raw[edge - 1] != 32) & (raw[edge - 1] != 10) & (edge > 0)  # glued to the token before it
    shape = (((kind[edge].astype(np.int64) * 4 + case) * 16 + np.minimum(size, 15)) * 4 + again) * 2 + bound
    sign = kind[edge] == 3
    s = _mixed(np.where(sign, h, shape.astype(np.uint64) + np.uint64(1 << 40)))
    for n in (h, *(_mixed(h[:-1] + np.uint64(3) * h[1:]),) * (len(h) > 1), s):
        flags[n & buckets] = True
    if len(s) > 1:
        pair = _mixed(s[:-1] * np.uint64(5) + s[1:])
        flags[pair & buckets] = True
        if len(s) > 2:
            flags[_mixed(pair[:-1] * np.uint64(7) + s[2:]) & buckets] = True


def indicators(text: str | None, buckets: int) -> np.ndarray:
    """Sorted numbers of the n-gram indicators that a whole text sets."""
    flags = np.zeros(buckets, bool)
    raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    block = len(_POWERS) - 1
    for at in range(0, len(raw), block - 512):  # blocks overlap, so that no n-gram is cut out
        _block_indicators(raw[at : at + block], flags)
    return np.flatnonzero(flags).astype(np.uint32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    share: float | None = None  # set if there was nothing to tell classes apart

    def score(self, found: np.ndarray) -> float:
        if self.share is not None:
            return self.share
        margin = self.bias + (self.weights[found].sum() / np.sqrt(len(found)) if len(found) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method for a logistic curve over margins, targets drawn in by the class counts."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(rows: list[np.ndarray], y: np.ndarray, cfg: NbSvm) -> Model:
    """y: 1 or -1. A fifth of the rows is kept for the logistic curve."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1), 0.0, 1.0, 0.0, float((y > 0).mean()) if len(y) else 0.5)
    kept = np.arange(len(y)) % 5 == 4
    if len(set(y[~kept].tolist())) < 2 or len(set(y[kept].tolist())) < 2:
        kept[:] = False
    train = np.flatnonzero(~kept)
    counts = {}
    for sign in (1, -1):
        c = np.full(cfg.buckets, cfg.alpha)
        for i in train[y[train] == sign]:
            c[rows[i]] += 1
        counts[sign] = c / c.sum()
    ratio = np.log(counts[1] / counts[-1])
    # hinge loss, min 1/2 |w|^2 + C sum max(0, 1 - y w x), one dual variable at a time; the bias is a
    # constant indicator
    w, bias = np.zeros(cfg.buckets), 0.0
    alpha = np.zeros(len(y))
    scale = {i: 1 / np.sqrt(max(1, len(rows[i]))) for i in train}
    square = {i: float(np.square(ratio[rows[i]]).sum()) * scale[i] ** 2 + 1.0 for i in train}
    share = {s: (y[train] == s).mean() for s in (1, -1)}
    cost = {s: cfg.cost * 0.5 / share[s] for s in (1, -1)}  # both classes weigh alike
    rng = np.random.default_rng(17)
    for _ in range(cfg.epochs):
        most = 0.0
        for i in rng.permutation(train).tolist():
            at, s = rows[i], int(y[i])
            x = ratio[at] * scale[i]
            gradient = s * (float(w[at] @ x) + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[s])
            change = new - alpha[i]
            if change:
                w[at] += change * s * x
                bias += change * s
                alpha[i] = new
                most = max(most, abs(change))
        if most < 1e-3:
            break
    model = Model(w * ratio, bias, 1.0, 0.0)
    inner = np.flatnonzero(kept) if kept.any() else train
    margins = np.array([model.bias + (model.weights[rows[i]].sum() / np.sqrt(len(rows[i])) if len(rows[i]) else 0.0) for i in inner])
    model.slope, model.shift = _logistic(margins, y[inner])
    return model


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, cfg: NbSvm = NbSvm(), label: str = "quality") -> Model:
    small_batches(docs.sparkSession)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id")) != cfg.held_fold))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.max_rows)  # bounded, so it can be broadcast
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    picked = picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).select("doc_id", "text", "y")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [indicators(t, cfg.buckets).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.binary())], ["doc_id", "y", "found"])

    found = materialise(picked.mapInArrow(lean(run), "doc_id long, y int, found binary"), "sample")
    sizes = found.select("doc_id", (F.length("found") / 4).cast("long").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    upto = int(np.searchsorted(np.cumsum([r.n for r in sizes]), cfg.max_indicators, side="right"))
    kept = [r.doc_id for r in sizes[:upto]]  # at most max_rows ids
    if upto < len(sizes):
        found = found.filter(F.col("doc_id").isin(kept))
    got = found.toArrow()
    packed = got.column("found").combine_chunks()
    every = np.frombuffer(packed.buffers()[2], np.uint32) if len(packed) and packed.buffers()[2] else np.empty(0, np.uint32)
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // 4 if len(packed) else np.zeros(1, np.int32)
    order = np.argsort(got.column("doc_id").to_numpy())
    model = fit([every[ends[i] : ends[i + 1]] for i in order], np.where(got.column("y").to_numpy()[order] > 0, 1, -1).astype(np.int64), cfg)
    del got, packed, every
    give_back_memory()
    return model


def score(docs: DataFrame, model: Model, cfg: NbSvm = NbSvm()):
    """A string column function: text -> score."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts):
        return texts.map(lambda t: sent.value.score(indicators(t, cfg.buckets)), na_action=None).astype("float64")

    return scored


def accept(docs: DataFrame, labels: DataFrame, cfg: NbSvm = NbSvm()) -> DataFrame:
    """The documents that are predicted to have label 1, as they are."""
    return docs.filter(score(docs, train(docs, labels, cfg), cfg)("text") >= cfg.threshold)


def classify(docs: DataFrame, labels: DataFrame, cfg: NbSvm = NbSvm()) -> DataFrame:
    """docs with held_out, score and predicted, which replace columns of these names."""
    scored = score(docs, train(docs, labels, cfg), cfg)
    return (
        docs.withColumn("held_out", fold(F.col("doc_id")) == cfg.held_fold)
        .withColumn("score", scored("text"))
        .withColumn("predicted", (F.col("score") >= cfg.threshold).cast("int"))
    )
