"""What a run trains, saves, loads and acts with: a stack of layers, or a genome of an evolved network."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evolution, network
from .operators.network import Layer


class Policy(Protocol):
    inputs: int

    def act(self, frame: DataFrame, features: str, output: str) -> DataFrame:
        """frame with the array of outputs for each vector of features."""

    def genome(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """connections (genome_id, key, weight, enabled) and nodes (genome_id, key)."""

    def save(self, spark: SparkSession, path: str) -> None: ...


@dataclass(frozen=True)
class Layers:
    """An actor, and the networks that were trained beside it."""

    actor: Sequence[Layer]
    others: dict[str, Sequence[Layer]]

    @property
    def inputs(self) -> int:
        return self.actor[0].weights.shape[1]

    @property
    def outputs(self) -> int:
        return len(self.actor[-1].bias)

    def act(self, frame: DataFrame, features: str = "state", output: str = "Prediction") -> DataFrame:
        return network.predict(frame, self.actor, features, output)

    def genome(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        rows = [("best", f"{i}-{a}-{b}", float(w), True) for i, layer in enumerate(self.actor) for b, ws in enumerate(layer.weights) for a, w in enumerate(ws)]
        nodes = [("best", f"{i}-{b}") for i, layer in enumerate(self.actor) for b in range(len(layer.bias))]
        return spark.createDataFrame(rows, "genome_id string, key string, weight double, enabled boolean"), spark.createDataFrame(nodes, "genome_id string, key string")

    def save(self, spark: SparkSession, path: str) -> None:
        network.save({"actor": self.actor, **self.others}, spark, path)


@dataclass(frozen=True)
class Evolved:
    """One genome, as rows of its connections."""

    net: evolution.Graph

    @property
    def inputs(self) -> int:
        return self.net.inputs

    @property
    def outputs(self) -> int:
        return self.net.outputs

    def act(self, frame: DataFrame, features: str = "state", output: str = "Prediction") -> DataFrame:
        return evolution.predict(frame, self.net, features, output)

    def genome(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        rows = [("best", str(c.innovation), c.weight, c.enabled) for c in self.net.connections]
        nodes = [("best", str(n)) for n in self.net.nodes()]
        return spark.createDataFrame(rows, "genome_id string, key string, weight double, enabled boolean"), spark.createDataFrame(nodes, "genome_id string, key string")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.net.inputs, self.net.outputs, *c) for c in self.net.connections]
        spark.createDataFrame(rows, f"inputs int, outputs int, {evolution.CONNECTION}").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Layers | Evolved:
    """A saved policy of either kind; rows are as many as the model has units or connections."""
    saved = spark.read.parquet(path)
    if "innovation" in saved.columns:
        rows = saved.orderBy("innovation").collect()
        links = [evolution.Connection(r.innovation, r.src, r.dst, r.src_depth, r.dst_depth, r.weight, r.enabled) for r in rows]
        return Evolved(evolution.Graph(rows[0].inputs, rows[0].outputs, links))
    nets = network.load(spark, path)
    return Layers(nets.pop("actor"), nets)


def as_policy(of) -> Layers | Evolved:
    """A policy, or a bare stack of layers as one."""
    return of if isinstance(of, Layers | Evolved) else Layers(of, {})


def check(frame: DataFrame, features: str, policy: Layers | Evolved) -> None:
    """Observations are vectors of as many numbers as the policy takes, and it gives one action."""
    network.check_spaces(frame, features, policy.inputs)
    if policy.outputs != 1:
        raise ValueError(f"the policy gives {policy.outputs} actions, not 1")


def first_output(frame: DataFrame, policy, features: str, output: str) -> DataFrame:
    return as_policy(policy).act(frame, features, output).withColumn(output, F.col(output)[0])
