"""Queries of what a run does with files: preparing, scoring a saved policy, and the figures it reports."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import config as options
from .. import policies
from ..operators import network
from ..sources.scratch import shared_root
from ..sources.series import read_series, write_series
from . import run
from .catalogue import ORDERED, events, query
from .prepare import Prepared, prepare

OFFSET, STEPS = 5, 700
POLICY = policies.Layers([network.Layer(np.array([[0.75, -0.5]]), np.array([0.125]), "tanh")], {})
_ACTION = "tanh(0.75 * a - 0.5 * b + 0.125)"
#: x is two columns of events, y the value; x is skipped by OFFSET and cut in three
_ROWS = f"""{ORDERED}, x AS (SELECT pos - {OFFSET} AS pos, value / 500 AS a, (user_id % 10) / 10 AS b FROM ev WHERE pos >= {OFFSET}),
    whole AS (SELECT ev.pos, a, b, value / 500 AS y, n - {OFFSET} AS n FROM ev JOIN x ON ev.pos = x.pos),
    parts AS (SELECT *, CASE WHEN pos < n // 3 THEN 'train' WHEN pos < 2 * (n // 3) THEN 'prune' ELSE 'stabilize' END AS part FROM whole)"""


def _files(spark: SparkSession, sf_dir: str) -> dict:
    """A run's options, with x and y written as CSV files; the same rows are those of validation."""
    folder = f"{shared_root(spark)}/tidemark/run-{uuid.uuid4().hex}"
    rows = events(spark, sf_dir, "value", "user_id")
    write_series(rows.select("pos", (F.col("value") / 500).alias("a"), (F.col("user_id") % 10 / 10).alias("b")), f"{folder}/x", headers=False)
    write_series(rows.select("pos", (F.col("value") / 500).alias("y")), f"{folder}/y", headers=False)
    given = {"x_train_file": f"{folder}/x", "y_train_file": f"{folder}/y", "x_validation_file": f"{folder}/xv", "y_validation_file": f"{folder}/y"}
    write_series(rows.select("pos", (F.col("value") / 1000).alias("a"), F.lit(0.25).alias("b")), f"{folder}/xv", headers=False)
    return options.merge(options.DEFAULTS, {}, {"headers": False, "input_offset": OFFSET}, {}, given | {"save_model": f"{folder}/net", "evaluate_file": f"{folder}/out", "max_steps": STEPS})


@query(f"WITH {_ROWS} SELECT pos, part, round(a, 12) AS a, round(b, 12) AS b, round(y, 12) AS y FROM parts")
def prepared_rows(spark, sf_dir):
    found: Prepared = prepare(spark, _files(spark, sf_dir) | {"x_validation_file": None})
    assert found.validation is None and found.inputs == 2  # only both files make a validation set
    state = [F.round(F.col("state")[i], 12).alias(c) for i, c in enumerate("ab")]
    return found.train.select("pos", "part", *state, F.round("y", 12).alias("y"))


@query(f"WITH {_ROWS} SELECT pos, round({_ACTION}, 9) AS prediction FROM parts WHERE part = 'train'")
def scored_file(spark, sf_dir):
    """The predictions of a saved policy, read back from the file that they go to."""
    given = _files(spark, sf_dir) | {"x_validation_file": None}
    POLICY.save(spark, given["save_model"])
    run.score_saved(spark, given | {"load_model": given["save_model"]})
    found = read_series(spark, given["evaluate_file"])
    return found.frame.select("pos", F.round("Prediction", 9).alias("prediction"))


@query(f"""WITH {_ROWS},
    seen AS (SELECT {_ACTION} - y AS gap FROM whole WHERE pos < {3 * STEPS}),
    held AS (SELECT tanh(0.75 * v.value / 1000 - 0.5 * 0.25 + 0.125) - ev.value / 500 AS gap FROM ev JOIN ev v ON v.pos = ev.pos + {OFFSET} WHERE ev.pos < {STEPS})
    SELECT round(1 / (SELECT avg(abs(gap)) FROM seen), 8) AS training_fitness, round((SELECT avg(abs(gap)) FROM held), 9) AS validation_mae,
           round((SELECT avg(gap * gap) FROM held), 9) AS validation_mse""")
def fitness_record(spark, sf_dir):
    """What a run reports of a policy: over three times max_steps of its rows, and over max_steps of those of
    validation, by two environments."""
    given = _files(spark, sf_dir)
    data = prepare(spark, given | _cut_to_pair(spark, given))
    fitness = run.evaluate(data.train, POLICY, 3 * STEPS, run.environment(spark, given | {"environment_plugin": "prediction"}))
    mae, mse = run.evaluate(data.validation, POLICY, STEPS, run.environment(spark, given | {"environment_plugin": "custom"}))
    return spark.createDataFrame([(round(fitness, 8), round(mae, 9), round(mse, 9))], "training_fitness double, validation_mae double, validation_mse double")


def _cut_to_pair(spark: SparkSession, given: dict) -> dict:
    """Validation rows have to be as many on both sides after the offset: y without its last ones."""
    path, y = f"{given['y_validation_file']}-cut", read_series(spark, given["y_validation_file"], False).frame
    write_series(y.filter(F.col("pos") < y.count() - OFFSET), path, headers=False)
    return {"y_validation_file": path}

