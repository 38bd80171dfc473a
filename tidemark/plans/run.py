"""Train or load a policy, evaluate it, report; or run an agent that trades by a rule."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import policies, registry
from ..operators import genome, metrics, network, orders
from ..sources.scratch import materialise
from ..sources.series import write_series
from .prepare import Prepared, market, prepare

log = logging.getLogger(__name__)
FIRST_OUTPUTS = 5


def _plugin(spark: SparkSession, group: str, config: dict) -> tuple[Callable, dict]:
    """(plugin of a run, its own parameters); executors get the package of one from elsewhere."""
    name = config[f"{group.removesuffix('s')}_plugin"]
    found, wanted = registry.load_plugin(group, name)
    registry.ship(spark, group, name)
    return found, {k: config[k] for k in wanted if k in config}


def environment(spark: SparkSession, config: dict) -> Callable[[DataFrame], DataFrame]:
    """The environment plugin of a run: (pos, y, prediction) -> (pos, reward). Its ``score`` and ``fitness``
    stay with it."""
    rewards, params = _plugin(spark, "environments", config)
    out = partial(rewards, **params)
    for attribute in ("score", "fitness"):
        if hasattr(rewards, attribute):
            setattr(out, attribute, getattr(rewards, attribute))
    return out


def evaluate(frame: DataFrame, policy, max_steps: int, env: Callable | None = None):
    """What the environment calls the fitness of the first action that each state gives: its ``score`` of
    {mae, mse, fitness}, or the inverse of the mean absolute error."""
    acted = policies.first_output(frame.filter(F.col("pos") < max_steps), policy, "state", "p")
    first = acted.filter(F.col("pos") < FIRST_OUTPUTS).orderBy("pos").select("p").collect()
    log.info("first outputs: %s", [r.p for r in first])
    found = metrics.errors(acted, "y", "p").first().asDict()
    return getattr(env, "score", lambda errors: errors["fitness"])(found)


def train_and_evaluate(spark: SparkSession, config: dict) -> dict:
    """The report: time, fitness over three times max_steps of training rows, fitness on validation rows
    (None without them), and information of rows and network."""
    began = time.time()
    agent, own = _plugin(spark, "agents", config)
    if hasattr(agent, "rule"):
        return run_rule(spark, config, agent, own)
    data: Prepared = prepare(spark, config)
    train = materialise(data.train, "train")
    fit, params = _plugin(spark, "optimizers", config)
    env = environment(spark, config)
    first = train.filter(F.col("part") == "train")
    network.check_spaces(first, "state", data.inputs)
    trained, losses = fit(first, data.inputs, config["epochs"], environment=env, agent=agent, **params)
    policies.as_policy(trained).save(spark, config["save_model"])
    policy = policies.load(spark, config["save_model"])
    links, nodes = policy.genome(spark)
    wide = train.select("pos", *[F.col("state")[i].alias(f"v{i}") for i in range(data.inputs)])
    facts = genome.total_information(links, nodes).first()
    packed = genome.serialised(links).first()
    return {
        "training_fitness": evaluate(train, policy, 3 * config["max_steps"], env),
        "validation_fitness": None if data.validation is None else evaluate(data.validation, policy, config["max_steps"], env),
        "data_bits": metrics.shannon_hartley(wide, wide.columns[1:], config["periodicity_minutes"]).first()["bits"],
        "n_connections": facts.n_connections,
        "n_nodes": facts.n_nodes,
        "weight_entropy": facts.entropy,
        "total_information": facts.total_information,
        "genome_bits": packed.bits,
        "kolmogorov": genome.complexity(links).first().complexity,
        "loss": losses[-1] if losses else None,
        "execution_time": time.time() - began,
    }


def run_rule(spark: SparkSession, config: dict, agent: Callable, params: dict) -> dict:
    """The report of an agent that trades by dates: its orders go to ``evaluate_file``, totals and the account
    at the end of the run are reported. The rows are those of x, see ``prepare.market``."""
    began = time.time()
    rows = materialise(market(spark, config), "market")
    ledger = materialise(agent(rows, **params), "ledger")
    write_series(ledger, config["evaluate_file"], name="opened_at", keep_name=True)
    total = ledger.agg(F.count(F.lit(1)).alias("n"), F.sum("profit").alias("profit"), F.sum("pips").alias("pips"), F.count_if(~F.col("balanced")).alias("unbalanced")).first()
    dates = {k: v for k, v in params.items() if k in ("buy_dates", "sell_dates")}
    end = orders.account(agent.rule(rows, **dates), ledger).first()
    return {
        "orders": total.n, "profit": total.profit, "pips": total.pips, "unbalanced": total.unbalanced,
        "balance": end.balance if end else None, "equity": end.equity if end else None, "num_closes": end.num_closes if end else 0,
        "execution_time": time.time() - began,
    }


def score_saved(spark: SparkSession, config: dict) -> DataFrame:
    """Predictions of a saved policy for the first third of x, also written as CSV."""
    agent, params = _plugin(spark, "agents", config)
    if hasattr(agent, "rule"):
        raise ValueError(f"the agent {agent.__name__} trades by a rule and has no policy to load")
    data = prepare(spark, config)
    policy = policies.load(spark, config["load_model"])
    rows = data.train.filter(F.col("part") == "train")
    policies.check(rows, "state", policy)
    output = params.get("output", "Prediction")
    out = agent(rows, policy, **params).select("pos", F.col(output).alias("Prediction"))
    write_series(out, config["evaluate_file"], include_date=False)
    return out
