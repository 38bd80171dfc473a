"""Encoder and decoder of windows: a narrow layer between two networks that give back what they get.

Training rows are dealt into mini-batches by a hash and written in folders of their own, so that a step
reads its batch and nothing else; each task adds up its rows' gradients, and the sums, as long as the
model, go to the driver, which takes the step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Workspace
from . import network, windows
from .network import Adam, Layer, flat, shaped


@dataclass(frozen=True)
class AutoencoderParams:
    interface: int = 4  # numbers that a window becomes
    hidden: tuple[int, ...] = (16,)  # layers of the encoder before it; the decoder has them in reverse
    epochs: int = 10
    batches: int = 4
    lr: float = 0.01
    seed: int = 0


@dataclass(frozen=True)
class Autoencoder:
    encoder: list[Layer]
    decoder: list[Layer]

    @property
    def size(self) -> int:
        return self.encoder[0].weights.shape[1]

    def save(self, spark, path: str) -> None:
        network.save({"encoder": self.encoder, "decoder": self.decoder}, spark, path)

    @staticmethod
    def load(spark, path: str) -> Autoencoder:
        nets = network.load(spark, path)
        return Autoencoder(nets["encoder"], nets["decoder"])


def fresh(size: int, params: AutoencoderParams) -> Autoencoder:
    """relu layers, a tanh interface; relu layers, and sums at the end."""
    rng = np.random.default_rng(params.seed)

    def stack(widths: Sequence[int], last: str) -> list[Layer]:
        out = []
        for k, (m, n) in enumerate(zip(widths[:-1], widths[1:], strict=True)):
            most = np.sqrt(6 / (m + n))
            out.append(Layer(rng.uniform(-most, most, (n, m)), np.zeros(n), last if k == len(widths) - 2 else "relu"))
        return out

    encoder = stack([size, *params.hidden, params.interface], "tanh")
    return Autoencoder(encoder, stack([params.interface, *reversed(params.hidden), size], "none"))


def gradients(rows: DataFrame, layers: Sequence[Layer], column: str = "w") -> np.ndarray:
    """Sums over all rows of the squared error, the number of values, and the slopes of half the squared
    error by every weight and bias of a stack that should give back ``column``; empty without a row."""

    def run(batches) -> Iterator:
        import pandas as pd

        total = None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[column].to_numpy())
            lost = np.zeros(1)

            def slope(out: np.ndarray, x=x, lost=lost) -> np.ndarray:
                lost[0] += ((out - x) ** 2).sum()
                return out - x

            parts = network.backward(x, layers, slope)
            part = np.concatenate([lost, [x.size], *parts])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "g": total})

    sums = rows.select(column).mapInPandas(run, "i long, g double").groupBy("i").agg(F.sum("g").alias("g"))
    return np.array([r.g for r in sums.orderBy("i").collect()])  # as long as the model


def usable(rows: DataFrame, column: str = "w") -> DataFrame:
    """Rows whose windows are there and hold finite numbers only."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.filter(F.col(column).isNotNull() & ~bad)


def fit(rows: DataFrame, params: AutoencoderParams = AutoencoderParams(), column: str = "w") -> tuple[Autoencoder, list[float]]:
    """(networks, mean squared error of each epoch's batches before their steps). Windows that are null or
    hold other than finite numbers aren't learnt from; windows of several lengths, or none, raise ValueError."""
    work = Workspace(rows.sparkSession, "autoencoder")
    try:
        doubles = rows.select(F.transform(column, lambda v: v.cast("double")).alias("w"))
        batch = F.pmod(F.xxhash64("w", F.lit(params.seed)), F.lit(params.batches))
        dealt = usable(doubles).withColumn("batch", batch)
        kept = [work.keep(dealt.filter(F.col("batch") == b).select("w"), f"batch-{b}") for b in range(params.batches)]
        lengths = {n for k in kept for r in [k.agg(F.min(F.size("w")), F.max(F.size("w"))).first()] if r[0] is not None for n in r}
        if len(lengths) != 1:
            raise ValueError("no window to learn from" if not lengths else f"windows of several lengths: {sorted(lengths)}")
        nets = fresh(lengths.pop(), params)
        n, adam, losses = len(nets.encoder), Adam(params.lr), []
        layers = [*nets.encoder, *nets.decoder]
        for _ in range(params.epochs):
            lost = values = 0.0
            for part in kept:
                found = gradients(part, layers)
                if not len(found):
                    continue
                lost, values = lost + found[0], values + found[1]
                [layers] = shaped(adam.step(flat([layers]), found[2:] / found[1]), [layers])
            losses.append(float(lost / values))
        return Autoencoder(layers[:n], layers[n:]), losses
    finally:
        work.drop()


def encode(rows: DataFrame, nets: Autoencoder, column: str = "w", output: str = "code") -> DataFrame:
    return network.predict(rows, nets.encoder, column, output)


def decode(rows: DataFrame, nets: Autoencoder, column: str = "code", output: str = "decoded") -> DataFrame:
    return network.predict(rows, nets.decoder, column, output)


def calculate_mse(rows: DataFrame, nets: Autoencoder, column: str = "w") -> float | None:
    """Mean squared error of windows given back; None without one."""
    both = decode(encode(usable(rows, column), nets, column), nets)
    gap = F.aggregate(F.zip_with(column, "decoded", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    found = both.agg(F.sum(gap), F.sum(F.size(column))).first()
    return found[0] / found[1] if found[1] else None


def fit_encoder(rows: DataFrame, column: str = "w", **params) -> list[Layer]:
    return fit(rows, AutoencoderParams(**params), column)[0].encoder


def fit_decoder(rows: DataFrame, column: str = "w", **params) -> list[Layer]:
    return fit(rows, AutoencoderParams(**params), column)[0].decoder


def reconstruct(series: DataFrame, nets: Autoencoder, value: str, name: str = "pos") -> DataFrame:
    """(pos, output): a series cut into the networks' windows, encoded, decoded and put together again, the
    mean of all windows on a position."""
    held = windows.sliding_window(series, nets.size, value, name=name)
    back = decode(encode(held, nets), nets)
    return windows.overlap_add(back.select("row_id", F.col("decoded").alias("w")))
