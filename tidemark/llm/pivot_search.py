"""Exact inner-product top-k by a pivot-distance index.

Vectors are lifted by one coordinate, sqrt(M^2 - |x|^2) with M the largest norm, which turns the
largest inner products into the least distances. Every vector is keyed by its nearest pivot and the
distance to it; the index is sorted by that key, in ranges whose ties are cut by the id, so the
vectors around one pivot, or one vector repeated over and over, fill many tasks. A run of an index
range is an annulus around its pivot. A query takes the annuli of a range by the least distance that
the triangle inequality allows, expands from the nearest outwards, and stops when the bound says
that none that is left can reach its k-th score. Distances only order and stop the search, with a
margin for rounding; scores are exact integers.

Pivots, and the scores that a query starts with, come from a bounded sample (``sample`` rows); the
index holds every row. Queries are sorted by pivot and distance too and go in blocks of ``block`` rows,
one block after the other, so that neither the driver nor a broadcast holds more. A block reads only the
ranges of the index that some query of it can need: for each pivot an interval of distances, which
becomes a filter on the sorted files. The higher the scores that its queries start with, the narrower.

Defined results: vectors that are null or hold null, NaN or infinite components take no part;
shorter vectors count as padded with zeros; ties go to the smaller id; rows with the query's own id
are not candidates; a query id that repeats is searched once, with its least vector; candidates that
repeat are rows of their own; null ids take no part, nor do vectors whose squared length is 2^62 or more in
whole steps, as their scores may not fit 64 bits; further columns are not looked at; an empty table gives no
row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.position import with_position
from .shared import lean, materialise, shared_path

#: Up to this squared length all sums of products are exact as doubles; above it integers are used.
EXACT = float(1 << 53)
RESULT = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class PivotSearch:
    k: int = 5
    pivots: int = 32
    sample: int = 1024
    annulus: int = 256
    block: int = 16384
    scale: int = 256


def whole_vectors(rows: DataFrame, scale: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): components floor(scale * x) as doubles that hold integers; unusable rows and those too long
    for scores of 64 bits go."""
    doubles = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), doubles.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)
    large = F.exists("v", lambda x: F.abs(x) * scale >= float(1 << 31))  # also keeps floor() within its type
    whole = kept.filter(~large).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    return whole.filter(_length2("v") < float(1 << 62))


def _length2(v: str):
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def _matrix(column, dims: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _lift(m: np.ndarray, radius2: float) -> np.ndarray:
    return np.column_stack([m, np.sqrt(np.maximum(0.0, radius2 - (m * m).sum(axis=1)))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T))


def _spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Each pivot is the sample's vector that is farthest from those before it."""
    chosen = [0]
    far = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _none(kind: type):
    return -np.inf if kind is np.float64 else -np.iinfo(np.int64).max


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int, kind: type):
        self.none = _none(kind)
        self.score = np.full((queries, k), self.none, kind)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        if scores.shape[1] > 4 * k:
            # only scores that reach the k-th of their own row matter; equal ones all stay
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
            floor = np.maximum(least, self.score[rows, -1])
            hit = scores >= floor[:, None]
            live = np.flatnonzero(hit.any(axis=1))
            for r in live.tolist():
                at = np.flatnonzero(hit[r])
                self._merge(rows[r], scores[r, at], ids[at])
            return
        for r in range(len(rows)):
            self._merge(rows[r], scores[r], ids)

    def _merge(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.score[row], scores)), np.concatenate((self.id[row], ids))
        order = np.lexsort((i, -s))[: self.score.shape[1]]
        self.score[row], self.id[row] = s[order], i[order]


def _margins(q: np.ndarray, radius2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query: its squared length and the largest one together, and what rounding can do to a
    score and to a distance."""
    both = (q * q).sum(axis=1) + radius2
    return both, 1e-6 * both + 1e-3, 1e-6 * np.sqrt(both)


def needed_ranges(q: np.ndarray, floor: np.ndarray, pivot_dist: np.ndarray, radius2: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) distance from each pivot at which a row can reach some query's floor."""
    both, margin, slack = _margins(q, radius2)
    gap = np.sqrt(np.maximum(0.0, both + 2 * margin - 2 * floor)) + slack
    return (pivot_dist - gap[:, None]).min(axis=0), (pivot_dist + gap[:, None]).max(axis=0)


def _search(q, q_ids, floor, pivot_dist, radius2, x, x_ids, x_pivot, x_dist, best: _Best, cfg: PivotSearch) -> None:
    """All queries of a block against some rows of the index. Within a pivot the rows mostly ascend in
    distance, but a task may read files out of order, so an annulus' radii come from all its rows."""
    cuts = [0]
    for e in np.flatnonzero(np.append(x_pivot[1:] != x_pivot[:-1], True)) + 1:
        cuts += [*range(cuts[-1] + cfg.annulus, int(e), cfg.annulus), int(e)]
    begin, end = np.array(cuts[:-1]), np.array(cuts[1:])
    center, inner, outer = x_pivot[begin], np.minimum.reduceat(x_dist, begin), np.maximum.reduceat(x_dist, begin)
    gap = np.maximum(0.0, np.maximum(pivot_dist[:, center] - outer, inner - pivot_dist[:, center]))
    both, margin, slack = _margins(q, radius2)
    gap = np.maximum(0.0, gap - slack[:, None])
    reach = both[:, None] / 2 - gap * gap / 2 + margin[:, None]  # highest score an annulus can hold
    kind = best.score.dtype.type
    order = np.argsort(-reach, axis=1)
    going = np.arange(len(q))
    for step in range(len(begin)):
        at = order[going, step]
        need = np.maximum(floor[going], best.score[going, -1])
        keep = reach[going, at] >= need
        going, at = going[keep], at[keep]
        if not len(going):
            break
        for ring in np.unique(at).tolist():
            rows = going[at == ring]
            s = slice(begin[ring], end[ring])
            scores = q[rows].astype(kind, copy=False) @ x[s].T.astype(kind, copy=False)
            scores[q_ids[rows][:, None] == x_ids[s][None]] = best.none
            best.add(rows, scores, x_ids[s])


def build_index(rows: DataFrame, cfg: PivotSearch):
    """(index, dims, radius2, pivots, sample ids, sample): rows as whole_vectors gives them."""
    facts = rows.agg(F.max(F.size("v")), F.max(_length2("v"))).first()
    if facts[0] is None:
        return None
    dims, radius2 = int(facts[0]), float(facts[1])
    taken = rows.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id", "v").limit(cfg.sample).collect()
    sample = np.zeros((len(taken), dims))
    for i, r in enumerate(taken):
        sample[i, : len(r.v)] = r.v
    sample_ids = np.array([r.vec_id for r in taken], np.int64)
    pivots = _spread_pivots(_lift(sample, radius2), cfg.pivots)

    keyed = materialise(_keyed(rows, dims, radius2, pivots), "vectors")
    order = ["pivot", "dist", "vec_id"]
    index = materialise(keyed.repartitionByRange(*order).sortWithinPartitions(*order), "pivot-index")
    return index, dims, radius2, pivots, sample_ids, sample


def _keyed(rows: DataFrame, dims: int, radius2: float, pivots: np.ndarray) -> DataFrame:
    """rows (vec_id, v) with the nearest pivot and the distance to it."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                d = _distances(_lift(_matrix(part.column(1), dims), radius2), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "v", "pivot", "dist"]
                )

    return rows.mapInArrow(lean(run), "vec_id long, v array<double>, pivot int, dist double")


def _searcher(sent, dims: int, radius2: float, cfg: PivotSearch):
    def run(batches) -> Iterator:
        import pyarrow as pa

        q, q_ids, floor, pivot_dist = sent.value
        best = _Best(len(q), cfg.k, np.float64 if radius2 < EXACT else np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids, _, center, dist = (part.column(i).to_numpy() if i != 1 else None for i in range(4))
                _search(q, q_ids, floor, pivot_dist, radius2, _matrix(part.column(1), dims), ids, center, dist, best, cfg)
        r, c = np.nonzero(best.score > best.none)
        if len(r):
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[r]), pa.array(best.id[r, c]), pa.array(best.score[r, c].astype(np.int64))], ["query_id", "vec_id", "score"]
            )

    return run


def top_k(rows: DataFrame, is_query, cfg: PivotSearch = PivotSearch(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best of all rows for each row that is_query (a column) picks."""
    spark = rows.sparkSession
    usable = whole_vectors(rows, cfg.scale, id_col, vec_col)
    built = build_index(usable, cfg)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if built is None:
        return empty
    index, dims, radius2, pivots, sample_ids, sample = built
    kind = np.float64 if radius2 < EXACT else np.int64
    queries = _keyed(usable.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), dims, radius2, pivots)
    queries = materialise(with_position(queries, "pivot", "dist", "vec_id").withColumn("block", F.floor(F.col("pos") / cfg.block)), "queries")
    last = queries.agg(F.max("block")).first()[0]
    if last is None:
        return empty
    folder = shared_path(spark, "found")
    for b in range(last + 1):
        taken = queries.filter(F.col("block") == b).select("vec_id", "v").collect()  # cfg.block rows at most
        q = np.zeros((len(taken), dims))
        for i, r in enumerate(taken):
            q[i, : len(r.v)] = r.v
        q_ids = np.array([r.vec_id for r in taken], np.int64)
        first = q.astype(kind) @ sample.T.astype(kind)
        first[q_ids[:, None] == sample_ids[None]] = _none(kind)
        floor = np.full(len(q), -np.inf)
        if first.shape[1] >= cfg.k:
            least = np.partition(first, first.shape[1] - cfg.k, axis=1)[:, -cfg.k]
            floor = np.where(least == _none(kind), -np.inf, least)
        pivot_dist = _distances(np.column_stack([q, np.zeros(len(q))]), pivots)
        low, high = needed_ranges(q, floor, pivot_dist, radius2)
        near = [(F.col("pivot") == p) & F.col("dist").between(float(a), float(z)) for p, (a, z) in enumerate(zip(low, high, strict=True))]
        sent = spark.sparkContext.broadcast((q, q_ids, floor, pivot_dist))
        rows_near = index.filter(reduce(or_, near)).select("vec_id", "v", "pivot", "dist")
        rows_near.mapInArrow(lean(_searcher(sent, dims, radius2, cfg)), RESULT).write.mode("append").parquet(folder)
        sent.destroy()
    found = spark.read.schema(RESULT).parquet(folder)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")
