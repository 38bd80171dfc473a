"""Small feed-forward networks over array columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import relu

ACTIVATIONS = {"relu": relu, "tanh": F.tanh, "none": lambda x: x}
_ARRAYS = {"relu": lambda x: np.maximum(x, 0.0), "tanh": np.tanh, "none": lambda x: x}
WIDE = 64  # units from which numpy over Arrow batches is faster than expressions


@dataclass(frozen=True)
class Layer:
    weights: np.ndarray  # (outputs, inputs)
    bias: np.ndarray
    activation: str = "none"


def actor_critic(inputs: int, hidden: int = 64, seed: int = 0) -> tuple[list[Layer], list[Layer]]:
    """Fresh actor (linear, relu, linear, tanh) and critic (linear, relu, linear)."""
    rng = np.random.default_rng(seed)

    def layer(n: int, m: int, activation: str) -> Layer:
        most = 1 / np.sqrt(m)
        return Layer(rng.uniform(-most, most, (n, m)), rng.uniform(-most, most, n), activation)

    return [layer(hidden, inputs, "relu"), layer(1, hidden, "tanh")], [layer(hidden, inputs, "relu"), layer(1, hidden, "none")]


def _apply(vector: Column, layer: Layer) -> Column:
    units = [F.struct(F.array(*map(F.lit, w)).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(layer.weights.tolist(), layer.bias, strict=True)]
    total = lambda u: F.aggregate(F.zip_with(u["w"], vector, lambda a, x: a * x.cast("double")), F.lit(0.0), lambda s, p: s + p) + u["b"]
    return F.transform(F.array(*units), lambda u: ACTIVATIONS[layer.activation](total(u)))


def evaluate(x: np.ndarray, layers: Sequence[Layer]) -> np.ndarray:
    for layer in layers:
        x = _ARRAYS[layer.activation](x @ layer.weights.T + layer.bias)
    return x


def predict(df: DataFrame, layers: Sequence[Layer], features: str, output: str = "Prediction") -> DataFrame:
    """df with the network's output array. Narrow networks are column expressions; wide ones go through
    numpy, a batch at a time. A null vector gives null."""
    if max(len(layer.bias) for layer in layers) < WIDE:
        out, at = df, F.col(features)
        for i, layer in enumerate(layers):
            out = out.withColumn(f"_layer{i}", _apply(at, layer))
            at = F.col(f"_layer{i}")
        return out.withColumn(output, F.when(F.col(features).isNotNull(), at)).select(*df.columns, output)

    @F.pandas_udf("array<double>")
    def batch(vectors):
        import pandas as pd

        at = np.flatnonzero(vectors.notna())
        out = [None] * len(vectors)
        if len(at):
            for i, found in zip(at, evaluate(np.stack(vectors.iloc[at].to_numpy()), layers), strict=True):
                out[i] = found
        return pd.Series(out, dtype=object)

    return df.withColumn(output, batch(F.col(features)))


def check_spaces(df: DataFrame, features: str, inputs: int, layers: Sequence[Layer] | None = None) -> None:
    """Observations are vectors of ``inputs`` numbers, and a policy takes them and gives one action;
    ValueError otherwise. Null vectors are allowed."""
    odd = df.filter(F.size(features) != inputs).select(F.size(features).alias("n")).first()
    if odd is not None:
        raise ValueError(f"an observation has {odd.n} numbers, not {inputs}")
    if layers is not None:
        if layers[0].weights.shape[1] != inputs:
            raise ValueError(f"the policy takes {layers[0].weights.shape[1]} numbers, not {inputs}")
        if len(layers[-1].bias) != 1:
            raise ValueError(f"the policy gives {len(layers[-1].bias)} actions, not 1")


def save(layers: dict[str, Sequence[Layer]], spark, path: str) -> None:
    """A Parquet table with a row per unit."""
    rows = [
        (net, i, k, layer.weights[k].tolist(), float(layer.bias[k]), layer.activation)
        for net, stack in layers.items()
        for i, layer in enumerate(stack)
        for k in range(len(layer.bias))
    ]
    spark.createDataFrame(rows, "net string, layer int, unit int, weights array<double>, bias double, activation string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> dict[str, list[Layer]]:
    out: dict[str, list[Layer]] = {}
    found = spark.read.parquet(path).orderBy("net", "layer", "unit").collect()  # a row a unit: the model's own size
    for net, i in sorted({(r.net, r.layer) for r in found}):
        units = [r for r in found if (r.net, r.layer) == (net, i)]
        out.setdefault(net, []).append(Layer(np.array([u.weights for u in units]), np.array([u.bias for u in units]), units[0].activation))
    return out


@dataclass
class Adam:
    """Driver-side moments of a parameter vector."""

    lr: float
    t: int = 0
    m: np.ndarray = field(default_factory=lambda: np.zeros(1))
    v: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def step(self, at: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient * gradient
        return at - self.lr * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def flat(nets: Sequence[Sequence[Layer]]) -> np.ndarray:
    return np.concatenate([x.ravel() for net in nets for layer in net for x in (layer.weights, layer.bias)])


def shaped(vector: np.ndarray, nets: Sequence[Sequence[Layer]]) -> list[list[Layer]]:
    out, at = [], 0
    for net in nets:
        stack = []
        for layer in net:
            w, b = layer.weights.size, layer.bias.size
            stack.append(Layer(vector[at : at + w].reshape(layer.weights.shape), vector[at + w : at + w + b], layer.activation))
            at += w + b
        out.append(stack)
    return out


def gradients(df: DataFrame, actor: Sequence[Layer], critic: Sequence[Layer], clip: float) -> np.ndarray:
    """Sums over all rows (state, action, logp, ret, adv) of the loss, the row count, and the gradient
    of the clipped policy loss and half the squared value error, as one vector: each task adds up its
    rows, and the tasks' vectors are added by position."""

    def run(batches) -> Iterator:
        import pandas as pd

        total = None
        for pdf in batches:
            part = _batch_gradients(np.stack(pdf["state"]), *(pdf[c].to_numpy() for c in ("action", "logp", "ret", "adv")), actor, critic, clip)
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "g": total})

    sums = df.select("state", "action", "logp", "ret", "adv").mapInPandas(run, "i long, g double").groupBy("i").agg(F.sum("g").alias("g"))
    return np.array([r.g for r in sums.orderBy("i").collect()])  # as long as the model


def backward(x: np.ndarray, layers: Sequence[Layer], slope) -> list[np.ndarray]:
    """Weight and bias gradients, first layer first; slope(output) is the loss' derivative by the output."""
    seen = [x]
    for layer in layers:
        seen.append(_ARRAYS[layer.activation](seen[-1] @ layer.weights.T + layer.bias))
    d, out = slope(seen[-1]), []
    for layer, before, after in zip(reversed(layers), reversed(seen[:-1]), reversed(seen[1:]), strict=True):
        d = d * {"relu": (after > 0), "tanh": 1 - after * after, "none": 1.0}[layer.activation]
        out = [(d.T @ before).ravel(), d.sum(axis=0), *out]
        d = d @ layer.weights
    return out


def _batch_gradients(x, action, logp, ret, adv, actor, critic, clip) -> np.ndarray:
    losses = np.zeros(1)

    def policy(mean: np.ndarray) -> np.ndarray:
        gap = action - mean[:, 0]
        ratio = np.exp(-0.5 * gap * gap - 0.5 * np.log(2 * np.pi) - logp)
        plain, bounded = ratio * adv, np.clip(ratio, 1 - clip, 1 + clip) * adv
        losses[0] -= np.minimum(plain, bounded).sum()
        return np.where(plain <= bounded, -adv * ratio * gap, 0.0)[:, None]

    def value(v: np.ndarray) -> np.ndarray:
        gap = v[:, 0] - ret
        losses[0] += 0.5 * (gap * gap).sum()
        return gap[:, None]

    parts = [*backward(x, actor, policy), *backward(x, critic, value)]
    return np.concatenate([losses, [len(x)], *parts])
