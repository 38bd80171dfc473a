"""The plugins that the package brings along.

An optimizer takes (frame, inputs, epochs, environment, agent, parameters) and gives (policy, losses). An
environment turns (pos, y, prediction) into rewards; its ``score`` says what a report calls the fitness of
errors. An agent acts with a policy; one with networks to train has ``fresh``, and one that trades by a rule
of its own, without a policy, has ``rule``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame

from . import policies, training
from .operators import autoencoder, evolution, network, orders, windows
from .registry import register


@register("optimizers", "openrl", "openrl_optimizer", params=training.PpoParams)
def ppo(frame: DataFrame, inputs: int, epochs: int, environment: training.Environment | None = None, agent=None, **params):
    """Policy gradients. environment: rewards of a frame (pos, y, prediction); agent: the plugin whose
    networks are trained, found as its ``fresh``."""
    fresh = network.actor_critic if agent is None else getattr(agent, "fresh", None)
    if fresh is None:
        raise ValueError(f"the agent {agent.__name__} has no networks to train")
    nets, losses = training.train(frame, inputs, epochs, training.PpoParams(**params), environment, fresh)
    return policies.Layers(nets.pop("actor"), nets), losses


def _evolved(frame: DataFrame, inputs: int, epochs: int, environment, params: dict):
    fitness = getattr(environment, "fitness", None)
    graph, curve = evolution.evolve(frame, inputs, epochs, evolution.EvolutionParams(**params), fitness)
    return policies.Evolved(graph), [1 / f if f else float("inf") for f in curve]


@register("optimizers", "neat", params=evolution.EvolutionParams)
def neat(frame: DataFrame, inputs: int, epochs: int, environment=None, agent=None, **params):
    """Evolution of weights and topology, ``epochs`` generations of it; the environment's ``fitness``, if it
    has one, turns mean absolute and squared errors into what is maximised. The losses are the inverse of
    each generation's best fitness."""
    return _evolved(frame, inputs, epochs, environment, params)


@register("optimizers", "neat_p2p", params={f: v for f, v in vars(evolution.EvolutionParams()).items()} | {"islands": 4})
def neat_p2p(frame: DataFrame, inputs: int, epochs: int, environment=None, agent=None, islands: int = 4, **params):
    """The same on islands, peers that evolve apart; every few generations each sends its best genome to
    the next."""
    return _evolved(frame, inputs, epochs, environment, params | {"islands": islands})


@register("environments", "prediction", params={"max_steps": 6300})
def prediction(frame: DataFrame, max_steps: int = 6300) -> DataFrame:
    """Rewards of predictions: frame has pos, y, prediction."""
    return windows.step_rewards(frame, "y", "prediction", max_steps)


prediction.score = lambda errors: errors["fitness"]


@register("environments", "custom", params={"max_steps": 6300})
def custom(frame: DataFrame, max_steps: int = 6300) -> DataFrame:
    return windows.value_rewards(frame, "y", max_steps)


custom.score = lambda errors: (errors["mae"], errors["mse"])


@register("agents", "openrl_ppo", params={"output": "Prediction"})
def actor(frame: DataFrame, policy, features: str = "state", output: str = "Prediction") -> DataFrame:
    """The policy's first output for each row; a stack of layers is a policy too."""
    return policies.first_output(frame, policy, features, output)


actor.fresh = network.actor_critic


# The rule's default dates.
BUY_DATES = ("16/04/2010 20:00", "20/04/2010 02:00", "26/04/2010 00:00", "30/04/2010 18:00")
SELL_DATES = ("19/04/2010 01:00", "21/04/2010 04:00", "23/04/2010 12:00", "30/04/2010 09:00")


def _dates(given: Sequence[str | datetime] | str) -> list[datetime]:
    """Dates, or their text; a text with commas is a list (as the command line has it)."""
    given = [d.strip() for d in given.split(",") if d.strip()] if isinstance(given, str) else given
    return [datetime.strptime(d, "%d/%m/%Y %H:%M") if isinstance(d, str) else d for d in given]


@register("agents", "dummy_automation", params={"capital_risk": 0.1, "leverage": 100, "buy_dates": BUY_DATES, "sell_dates": SELL_DATES})
def date_rule(frame: DataFrame, capital_risk: float = 0.1, leverage: float = 100, buy_dates=BUY_DATES, sell_dates=SELL_DATES, by=()) -> DataFrame:
    """Ledger of a rule that trades on dates (``dd/MM/yyyy HH:mm``)."""
    return orders.ledger(rule_rows(frame, buy_dates, sell_dates, by), capital_risk, leverage, by)


def rule_rows(frame: DataFrame, buy_dates=BUY_DATES, sell_dates=SELL_DATES, by=()) -> DataFrame:
    """The rows of the rule's run, with its actions."""
    buys, sells = _dates(buy_dates), _dates(sell_dates)
    return orders.until_done(orders.signals(frame, buys, sells, by), len({*buys, *sells}), by)


date_rule.rule = rule_rows

register("encoders", "ann", params=autoencoder.AutoencoderParams)(autoencoder.fit_encoder)
register("decoders", "ann", params=autoencoder.AutoencoderParams)(autoencoder.fit_decoder)
