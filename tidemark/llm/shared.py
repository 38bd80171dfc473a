"""Shared folders, materialised intermediate tables and small binary files of the llm operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Workspace, materialise, shared_root  # noqa: F401  the first two are for the operators


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2048, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of bounded rows and bytes, so that neither the executor nor
    its workers hold more than a few megabytes of them besides one text; lower settings of the session
    are kept. The settings stay, as frames are run after the operator that makes them has returned."""
    units = {"": 0, "k": 10, "m": 20, "g": 30}
    for key, most in BATCH_LIMITS.items():
        now = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(key).lower())
        if not (now and 0 < int(now[1]) << units[now[2]] <= most):
            spark.conf.set(key, most)


def give_back_memory() -> None:
    """Freed memory that the process' allocators still hold goes back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a mapInArrow that gives memory back when its task ends: workers live on, and what
    their allocators hold would stay beside the next task's."""

    def lean_run(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back_memory()

    return lean_run


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores behind it, so that no column of df has the name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def open_fs(path: str):
    """(file system, path inside it) of any URI that pyarrow can open; used inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def make_dir(path: str) -> None:
    system, inner = open_fs(path)
    system.create_dir(inner, recursive=True)


HEAVY_KEYS = 2000


def skew_safe_lookup(rows: DataFrame, facts: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """Inner equi-join of rows with facts, which hold one row per key and, in ``copies``, the number
    of rows that have it. Keys with at least total / HEAVY_KEYS rows are at most HEAVY_KEYS, a size
    that doesn't grow with the data, so those facts are broadcast; no other key is large enough to
    unbalance the sort-merge join of the rest."""
    limit = max(2, total // HEAVY_KEYS)
    heavy = F.broadcast(facts.filter(F.col(copies) >= limit))
    light = facts.filter(F.col(copies) < limit)
    rest = rows.join(heavy.select(key), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light.hint("merge"), key))
