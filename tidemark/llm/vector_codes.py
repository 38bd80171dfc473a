"""Product codes of vectors: integer codebooks trained in rounds over all vectors.

Components become integers, vectors are cut into equal consecutive parts, and each part position has a
codebook that begins as that part of the vectors with the smallest ids. In a round the codebooks, whose
size is fixed, are broadcast; a task finds each part's nearest entry from whole matrix products,
|x|^2 - 2 x c + |c|^2 in int64, the first of equals, and adds up what its vectors give each entry. These
sums, a row for each entry and task, are merged by a grouped shuffle, and an entry that was used becomes
its parts' mean, rounded down. The vectors are packed once into a table of 32-bit integers, so that no
round reads the wider source or crosses Arrow element by element.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do those
whose squared length is 2^58 or more in ``scale`` steps, as int64 products couldn't hold their distances;
shorter vectors count as padded with zeros, and so does a length that the parts don't divide; rows that
repeat are rows of their own; a null id is coded too, with the largest as regards the first codebooks, and
equal ids go by their vectors; with fewer vectors than entries the codebooks are as short as the table; a
sum of errors that 64 bits don't hold is null; further columns are not looked at; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, lean, skew_safe_lookup, small_batches

LONGEST = float(1 << 58)
_ROWS = 1024  # vectors whose distances are held at once


@dataclass(frozen=True)
class VectorCodes:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


def integer_vectors(rows: DataFrame, cfg: VectorCodes, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): usable rows, v the integers as 32-bit little-endian bytes."""
    label = F.col(label_col) if label_col in rows.columns else F.lit(None)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = batch.column(2)
            size = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(), 0).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(flat * cfg.scale)
                sums = np.concatenate(([0], np.cumsum(size)))
                owner = np.repeat(np.arange(len(size)), size)
                length = np.bincount(owner, whole * whole, len(size))
            at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (length < LONGEST))  # NaN isn't less
            packed = [whole[sums[i] : sums[i + 1]].astype("<i4").tobytes() for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(packed, pa.binary())], ["vec_id", "label", "v"])

    return rows.select(F.col(id_col).cast("long"), label.cast("string"), F.col(vec_col)).mapInArrow(lean(run), "vec_id long, label string, v binary")


def _matrix(packed: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(packed), dims), np.int64)
    if all(len(p) == 4 * dims for p in packed):
        out[:] = np.frombuffer(b"".join(packed), "<i4").reshape(-1, dims)
        return out
    for i, p in enumerate(packed):
        out[i, : len(p) // 4] = np.frombuffer(p, "<i4")
    return out


def nearest(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts): index of each part's nearest entry, the first of equals, and the squared distance to
    it. x: integers (rows, parts * width), codebooks: (parts, entries, width)."""
    parts, _, width = codebooks.shape
    code, error = (np.empty((len(x), parts), np.int64) for _ in range(2))
    for p in range(parts):
        own, book = x[:, p * width : (p + 1) * width], codebooks[p]
        d = own @ np.ascontiguousarray(-2 * book.T)
        d += (book * book).sum(axis=1)
        code[:, p] = d.argmin(axis=1)
        error[:, p] = d[np.arange(len(x)), code[:, p]] + (own * own).sum(axis=1)
    return code, error


def _sums(packed: DataFrame, sent, width: int) -> DataFrame:
    """(part, entry, n, s): how many parts have the entry as their nearest, and their sums by component."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        books = sent.value
        parts, entries, _ = books.shape
        n, s = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                x = _matrix(batch.column(0).slice(at, _ROWS).to_pylist(), parts * width)
                code, _ = nearest(x, books)
                cell = code + np.arange(parts) * entries
                n += np.bincount(cell.ravel(), minlength=len(n))
                np.add.at(s, cell, x.reshape(len(x), parts, width))
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)), pa.array(n[used]), pa.array(list(s[used]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"]
            )

    each = packed.select("v").mapInArrow(lean(run), "part int, entry int, n long, s array<long>")
    merged = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
    return merged.select("part", "entry", "n", F.array(*[f"s{i}" for i in range(width)]).alias("s"))


def train_codebooks(packed: DataFrame, cfg: VectorCodes) -> np.ndarray | None:
    """(parts, entries, width); None without vectors. What comes to the driver is as large as the codebooks."""
    longest = packed.agg(F.max(F.octet_length("v"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // (4 * cfg.parts)))
    first = packed.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(cfg.entries).collect()
    books = _matrix([bytes(r.v) for r in first], cfg.parts * width).reshape(len(first), cfg.parts, width).transpose(1, 0, 2).copy()
    for _ in range(cfg.rounds):
        sent = packed.sparkSession.sparkContext.broadcast(books)
        found = _sums(packed, sent, width).collect()  # a row for each entry
        sent.destroy()
        books = books.copy()
        for r in found:
            books[r.part, r.entry] = np.array(r.s, np.int64) // r.n
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(packed: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hexadecimal digits a part (more for more than 256 entries)."""
    sent = packed.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape
    digits = max(2, len(f"{entries - 1:x}"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                code, error = nearest(_matrix(part.column(2).to_pylist(), parts * width), sent.value)
                text = ["".join(f"{k:0{digits}x}" for k in row) for row in code.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text), pa.array(error.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return packed.select("vec_id", "label", "v").mapInArrow(lean(run), "vec_id long, label string, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code_col: str = "code") -> DataFrame:
    """codes with ``decoded``, the integer vector that each code stands for."""
    sent = codes.sparkSession.sparkContext.broadcast(books)
    parts, entries, _ = books.shape
    digits = max(2, len(f"{entries - 1:x}"))

    @F.pandas_udf("array<long>")
    def looked_up(column):
        def one(code):
            return None if code is None else np.concatenate([sent.value[p, int(code[digits * p : digits * (p + 1)], 16)] for p in range(parts)])

        return column.map(one)

    return codes.withColumn("decoded", looked_up(F.col(code_col)))


def compress(rows: DataFrame, cfg: VectorCodes = VectorCodes(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Row per usable vector: vec_id, code, error, label_error (over its label; nulls are one),
    codebooks_sha256."""
    spark = rows.sparkSession
    small_batches(spark)
    work = Workspace(spark, "vector-codes")
    packed = work.keep(integer_vectors(rows, cfg, id_col, vec_col, label_col), "packed")
    books = train_codebooks(packed, cfg)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    label = F.when(F.col("label").isNull(), "null").otherwise(F.concat(F.lit("="), "label"))
    coded = work.keep(encode(packed, books).withColumn("label", label), "coded")
    total = F.expr("try_cast(sum(CAST(error AS DECIMAL(38, 0))) AS long)")
    facts = work.keep(coded.groupBy("label").agg(F.count(F.lit(1)).alias("copies"), total.alias("label_error")), "labels")
    joined = skew_safe_lookup(coded, facts, "label", "copies", coded.count())
    out = joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
    return work.result(out, "codes")
