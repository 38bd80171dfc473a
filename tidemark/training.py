"""Policy training: rollout, returns and gradient sums are Spark plans; the driver takes the steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.numeric import gaussian_logprob
from .operators import network, windows
from .operators.network import Adam, Layer, flat, shaped
from .sources.scratch import materialise


@dataclass(frozen=True)
class PpoParams:
    gamma: float = 0.99
    eps_clip: float = 0.2
    k_epochs: int = 4
    lr: float = 3e-4
    hidden: int = 64
    max_steps: int = 6300
    seed: int = 0


Environment = Callable[[DataFrame], DataFrame]  # (pos, y, prediction) -> (pos, reward)
Fresh = Callable[[int, int, int], tuple[list[Layer], list[Layer]]]  # inputs, hidden, seed -> actor, critic


def rollout(frame: DataFrame, actor: Sequence[Layer], critic: Sequence[Layer], params: PpoParams, epoch: int = 0, environment: Environment | None = None) -> DataFrame:
    """frame (pos, state, y) as trajectory: pos, state, action, logp, reward, ret, adv. The policy looks
    at its row only, so all steps are taken at once; its samples are a function of seed and position.
    Without an environment, rewards are those of predictions. A trajectory of another length than
    max_steps ends with its last step once more."""
    seen = network.predict(network.predict(frame, actor, "state", "_mean"), critic, "state", "_value")
    mean, value = F.col("_mean")[0], F.col("_value")[0]
    unit = lambda k: (F.pmod(F.xxhash64("pos", F.lit(params.seed), F.lit(epoch), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noise = F.sqrt(-2 * F.ln(unit(0))) * F.cos(F.lit(2 * np.pi) * unit(1))
    acted = seen.select("pos", "state", "y", (mean + noise).alias("action"), mean.alias("mean"), value.alias("value"))
    acted = materialise(acted.withColumn("logp", gaussian_logprob(F.col("action"), F.col("mean"))), "acted")
    rewarded = environment or (lambda rows: windows.step_rewards(rows, "y", "prediction", params.max_steps))
    rewards = rewarded(acted.withColumnRenamed("action", "prediction")).filter(F.col("pos") < params.max_steps).select("pos", "reward")
    steps = windows.pad(acted.join(rewards, "pos"), params.max_steps, [])
    steps = windows.discounted_return(steps, params.gamma)
    return windows.advantage(steps).withColumnRenamed("advantage", "adv")


def train(
    frame: DataFrame, inputs: int, epochs: int, params: PpoParams = PpoParams(), environment: Environment | None = None, fresh: Fresh = network.actor_critic
) -> tuple[dict[str, list[Layer]], list[float]]:
    """Networks and the mean loss before each step. environment gives the rewards, fresh the networks to
    begin with."""
    nets = [*fresh(inputs, params.hidden, params.seed)]
    adam, losses = Adam(params.lr), []
    for epoch in range(epochs):
        steps = materialise(rollout(frame, *nets, params, epoch, environment), "trajectory")
        for _ in range(params.k_epochs):
            found = network.gradients(steps, *nets, params.eps_clip)
            if not len(found):
                raise ValueError("x_train_data is empty.")
            losses.append(float(found[0] / found[1]))
            nets = shaped(adam.step(flat(nets), found[2:] / found[1]), nets)
    return {"actor": nets[0], "critic": nets[1]}, losses
