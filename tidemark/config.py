"""Options of a run: defaults, precedence, the smallest difference worth saving, and the command line."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import registry
from .functions.cells import convert_type

# Option names and defaults.
DEFAULTS = {
    "x_train_file": None,
    "y_train_file": None,
    "x_validation_file": None,
    "y_validation_file": None,
    "target_column": None,
    "output_file": "csv_output.csv",
    "save_model": "model",
    "load_model": None,
    "evaluate_file": "model_eval.csv",
    "optimizer_plugin": "openrl",
    "environment_plugin": "prediction",
    "agent_plugin": "openrl_ppo",
    "remote_log": None,
    "remote_load_config": None,
    "remote_save_config": None,
    "username": None,
    "password": None,
    "load_config": None,
    "save_config": "config_out.json",
    "save_log": "debug_out.json",
    "quiet_mode": False,
    "force_date": True,
    "headers": True,
    "multiline": False,
    "max_steps": 6300,
    "batch_size": 32,
    "epochs": 150,
    "input_offset": 0,
    "mse_threshold": 0.001,
    "time_horizon": 0,
    "periodicity_minutes": 60,
    "num_hidden": 0,
    "stabilization_cycles": 0,
    "number_of_segments": 0,
    "overfitting_threshold": 0.5,
}
SHORT = {
    "y_train_file": "ytf", "x_validation_file": "xvf", "y_validation_file": "yvf", "target_column": "tc", "output_file": "of",
    "save_model": "sm", "load_model": "lm", "evaluate_file": "ef", "optimizer_plugin": "op", "environment_plugin": "ep",
    "agent_plugin": "ap", "remote_log": "rl", "remote_load_config": "rlc", "remote_save_config": "rsc", "username": "u",
    "password": "p", "load_config": "lc", "save_config": "sc", "save_log": "sl", "quiet_mode": "qm", "force_date": "fd",
    "headers": "hdr", "batch_size": "bs", "epochs": "e", "input_offset": "io", "mse_threshold": "mt", "time_horizon": "th",
}
#: Options that nothing reads; they are taken, with a warning by the command line.
UNUSED = ("output_file", "quiet_mode", "batch_size", "mse_threshold", "stabilization_cycles", "number_of_segments", "overfitting_threshold", "time_horizon", "num_hidden")
SECRET = ("username", "password")
_FLAGS = ("quiet_mode", "force_date", "headers", "multiline")
_INTEGERS = ("target_column", "max_steps", "batch_size", "epochs", "input_offset", "time_horizon", "num_hidden", "periodicity_minutes", "stabilization_cycles", "number_of_segments")
_REALS = ("mse_threshold", "overfitting_threshold")


def parser() -> argparse.ArgumentParser:
    """Flags have a negative form; nothing has a value unless it is given."""
    found = argparse.ArgumentParser(prog="tidemark", argument_default=argparse.SUPPRESS, allow_abbrev=False)
    for name in DEFAULTS:
        spellings = [*([f"-{SHORT[name]}"] if name in SHORT else []), f"--{name}"]
        if name in _FLAGS:
            found.add_argument(*spellings, action=argparse.BooleanOptionalAction)
        else:
            found.add_argument(*spellings, type=int if name in _INTEGERS else float if name in _REALS else str)
    return found


def unknown_options(args: Sequence[str]) -> tuple[dict, list[str]]:
    """({option: value}, positional arguments) of what the parser left: ``--a 1``, ``--a=1``, or ``--a``
    alone, which is true."""
    options, positional, i = {}, [], 0
    while i < len(args):
        word = args[i]
        i += 1
        if not word.startswith("-"):
            positional.append(word)
            continue
        key, given, value = word.lstrip("-").partition("=")
        if not given and i < len(args) and not args[i].startswith("-"):
            value, given = args[i], "="
            i += 1
        options[key] = convert_type(value) if given else True
    return options, positional


def merge(defaults: dict, plugin_params: dict, file_config: dict, unknown: dict, given: dict, positional: Sequence[str] = ()) -> dict:
    """Later ones win: defaults, plugin parameters, files, unknown options, options. The first positional
    argument is x_train_file where no source sets it."""
    merged = defaults | plugin_params | file_config | unknown | given
    if positional and merged.get("x_train_file") == defaults.get("x_train_file"):
        merged["x_train_file"] = positional[0]
    return merged


def difference(config: dict, *, redact: bool = True) -> dict:
    """What differs from the defaults and from the three plugins' own parameters; no secrets."""
    known = [DEFAULTS]
    for group in registry.GROUPS:
        name = config.get(f"{group.removesuffix('s')}_plugin", DEFAULTS[f"{group.removesuffix('s')}_plugin"])
        known.append(registry.get_plugin_params(group, name))
    return {k: v for k, v in config.items() if not any(k in d and d[k] == v for d in known) and not (redact and k in SECRET)}


def table_difference(config: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (key, value) of config that known lacks."""
    seen = known.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
    return config.join(seen, F.col("key").eqNullSafe(F.col("_k")) & F.col("value").eqNullSafe(F.col("_v")), "left_anti")
