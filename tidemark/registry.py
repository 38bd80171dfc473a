"""Operator plugins by group and name: the package's own, and those that other installed packages announce.

Another package announces a plugin by an entry point in the group ``tidemark.optimizers``,
``tidemark.environments``, ``tidemark.agents``, ``tidemark.encoders`` or ``tidemark.decoders``. It may be

* a function, whose default parameters stand in its attribute ``plugin_params`` (a dict or a dataclass);
* a class with ``plugin_params``: it is made without arguments, gets its parameters through
  ``set_params`` (or as keywords of the call, if it has none), and is called like a function.

The package's own names come first, then entry points in the order in which they are found. A name that
nobody has raises ImportError, and so does one whose package can't be loaded. ``ship`` brings the package
of a plugin to the executors, where its functions are looked up by name.
"""

from __future__ import annotations

import dataclasses
import inspect
import logging
import os
import sys
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from importlib import import_module, metadata
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)
GROUPS = ("optimizers", "environments", "agents")  # those that a run names
ALL_GROUPS = (*GROUPS, "encoders", "decoders")
ENTRY_POINTS = "tidemark.{}"
_FOUND: dict[tuple[str, str], tuple[Callable, dict]] = {}
_PACKAGES: dict[tuple[str, str], str] = {}  # module of a plugin that isn't the package's own
_SHIPPED: dict[str, set[str]] = {}  # packages by application


def _values(params) -> dict:
    return {f.name: f.default for f in dataclasses.fields(params)} if isinstance(params, type) else dict(params or {})


def register(group: str, *names: str, params: dict | type | None = None):
    """Decorator: the callable is found under each name, with its default parameters (a dict or a
    dataclass)."""
    if group not in ALL_GROUPS:
        raise ValueError(f"unknown group {group}")
    values = _values(params)

    def keep(f: Callable) -> Callable:
        for name in names:
            _FOUND[group, name] = (f, values)
        return f

    return keep


def load_plugin(group: str, name: str) -> tuple[Callable, list[str]]:
    """(callable, names of its parameters); ImportError if there is none."""
    f, params = _entry(group, name)
    return f, list(params)


def get_plugin_params(group: str, name: str) -> dict:
    return dict(_entry(group, name)[1])


def names(group: str) -> list[str]:
    """The package's own, and those of entry points, loaded or not."""
    from . import builtin  # noqa: F401

    return sorted({n for g, n in _FOUND if g == group} | {e.name for e in _announced(group)})


def _announced(group: str) -> list[metadata.EntryPoint]:
    return list(metadata.entry_points(group=ENTRY_POINTS.format(group)))


def _as_function(plugin, params: dict) -> Callable:
    """A plugin class as a function of what its instances are called with, and parameters as keywords."""
    if not inspect.isclass(plugin):
        return plugin

    @wraps(plugin, updated=())
    def run(*args, **given):
        made, own = plugin(), {k: v for k, v in given.items() if k in params}
        if hasattr(made, "set_params"):
            made.set_params(**own)
            own = {}
        return made(*args, **own, **{k: v for k, v in given.items() if k not in params})

    for attribute in ("fresh", "score", "rule"):  # what a run looks for on an agent or environment
        if hasattr(plugin, attribute):
            setattr(run, attribute, getattr(plugin, attribute))
    return run


def _entry(group: str, name: str) -> tuple[Callable, dict]:
    from . import builtin  # noqa: F401  registers what the package brings along

    if (group, name) in _FOUND:
        return _FOUND[group, name]
    found = next((e for e in _announced(group) if e.name == name), None)
    if found is None:
        raise ImportError(f"Plugin {name} not found in group {group}.")
    try:
        plugin = found.load()
    except Exception as e:
        log.exception("plugin %s of group %s can't be loaded from %s", name, group, found.value)
        raise ImportError(f"Plugin {name} of group {group} can't be loaded from {found.value}.") from e
    if not callable(plugin):
        raise ImportError(f"Plugin {name} of group {group} is not callable.")
    params = _values(getattr(plugin, "plugin_params", None))
    _FOUND[group, name] = (_as_function(plugin, params), params)
    _PACKAGES[group, name] = found.module
    log.info("plugin %s of group %s comes from %s", name, group, found.module)
    return _FOUND[group, name]


def forget() -> None:
    """Plugins of other packages are looked up anew from here on."""
    for key in [*_PACKAGES]:
        del _FOUND[key], _PACKAGES[key]


def _zipped(module: str) -> str | None:
    """A zip with the module's top-level package; None if it lies in one already."""
    top = import_module(module.partition(".")[0])
    files = [Path(p) for p in getattr(top, "__path__", [])]
    single = Path(top.__file__) if not files and top.__file__ else None
    if single is not None and not single.is_file():
        return None  # imported from an archive
    handle, out = tempfile.mkstemp(prefix=f"{top.__name__}-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if single is not None:
            z.write(single, single.name)
        for folder in files:
            for p in sorted(folder.rglob("*")):
                if p.is_file() and "__pycache__" not in p.parts:
                    z.write(p, Path(top.__name__) / p.relative_to(folder))
    return out


def ship(spark: SparkSession, group: str, name: str) -> None:
    """Executors get the package of a plugin that isn't the package's own, once per application. Spark's
    file server hands it out, so the driver's folder needn't be shared."""
    _entry(group, name)
    module = _PACKAGES.get((group, name))
    if module is None:
        return
    top = module.partition(".")[0]
    sent = _SHIPPED.setdefault(spark.sparkContext.applicationId, set())
    if top in sent:
        return
    path = _zipped(module)
    if path:
        before = list(sys.path)
        spark.sparkContext.addPyFile(path)
        sys.path[:] = before  # the driver has imported it from where it is installed
    sent.add(top)


def add_debug_info(info: dict, plugin_vars: dict, wanted: list[str] | None = None) -> dict:
    """info with the named variables of a plugin."""
    return info | {k: v for k, v in plugin_vars.items() if wanted is None or k in wanted}
