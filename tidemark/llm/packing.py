"""Sequence packing by Karmarkar-Karp multiway differencing.

A document's ids are cut every ``window`` tokens; whole windows are sequences of their own, and the
rest is cut into pieces of at most ``piece`` tokens. The pieces are dealt into shards of a fixed
number of tokens. In a shard, each piece begins as a partial partition over k windows; the two with
the largest spread are merged again and again, the heavy windows of one with the light ones of the
other, until one partition is left: k windows of nearly equal load. k begins at the least possible
number and rises while a window is over capacity. Very small pieces are bundled before.

Defined results: a null text is an empty one (its document is the end id alone); rows with equal
doc_id, and rows that are alike, are packed as documents of their own; a null doc_id is carried along;
a text of any length is cut whole; an empty table gives no row; further columns are not looked at.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, materialise, small_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


@dataclass(frozen=True)
class Packing:
    tokenizer: str  # path of the tokenizers JSON file
    window: int = 2048
    piece: int = 512
    end_id: int = 1
    shard_windows: int = 192  # mean windows of a shard: a shard is one task's work


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window number (0..k-1) of each piece, by multiway differencing."""
    n = len(sizes)
    parent = np.arange(n)
    empty = np.full(k - 1, -1, np.int64)
    # heap of (-spread, tie, loads descending, a piece that stands for each window or -1)
    heap = []
    for i, s in enumerate(sizes.tolist()):
        loads = np.zeros(k, np.int64)
        loads[0] = s
        heap.append((-s, i, loads, np.concatenate(([i], empty))))
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, la, ra = heapq.heappop(heap)
        _, _, lb, rb = heapq.heappop(heap)
        loads, rb = la + lb[::-1], rb[::-1]
        both = (ra >= 0) & (rb >= 0)
        parent[rb[both]] = ra[both]
        stands = np.where(ra >= 0, ra, rb)
        order = np.argsort(-loads, kind="stable")
        loads, stands = loads[order], stands[order]
        loads = loads - loads[-1]
        heapq.heappush(heap, (-int(loads[0]), tie, loads, stands))
        tie += 1
    while True:
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    stands = heap[0][3]
    window = np.full(n, -1, np.int64)
    used = stands[stands >= 0]
    window[used] = np.arange(len(used))
    return window[parent]


def bundles(sizes: np.ndarray, least: int) -> np.ndarray:
    """Bundle of each piece: pieces of fewer than ``least`` tokens are put together, in bundles of fewer
    than twice as many, so that a shard's differencing has no more parts than its tokens allow."""
    small = sizes < least
    begin = np.cumsum(sizes[small]) - sizes[small]
    out = np.empty(len(sizes), np.int64)
    out[small] = np.unique(begin // least, return_inverse=True)[1]
    taken = int(out[small].max(initial=-1)) + 1
    out[~small] = taken + np.arange(int((~small).sum()))
    return out


def pack_shard(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each piece, windows). The number of windows rises until every load fits."""
    bundle = bundles(sizes, capacity // 16)
    loads = np.bincount(bundle, weights=sizes).astype(np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(loads, k)
        if np.bincount(window, weights=loads, minlength=k).max() <= capacity:
            return window[bundle], k
        k += 1


def pieces(docs: DataFrame, cfg: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per piece of each whole document, with the crc32 of its ids."""
    small_batches(docs.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        from .byte_bpe import encoder

        words = encoder(cfg.tokenizer)
        end = int(cfg.end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, packed in zip(part.column(0).to_pylist(), words.packed_many(part.column(1).to_pylist()), strict=True):
                    ids = packed + end
                    n = len(ids) // 4
                    whole = n - n % cfg.window
                    cuts = [*range(0, whole, cfg.window), *range(whole, n, cfg.piece), n]
                    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                        rows.append((doc, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), n))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run), PIECES)


def pack(docs: DataFrame, cfg: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per piece, with its sequence and its offset in it."""
    cut = materialise(pieces(docs, cfg, id_col, text_col).withColumn("salt", F.monotonically_increasing_id()), "pieces")
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    shards = max(1, round(tokens / (cfg.window * cfg.shard_windows)))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("salt"), F.lit(shards))).drop("salt")

    def run(pdf):
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], kind="stable", na_position="first").reset_index(drop=True)
        sizes = pdf["length"].to_numpy(np.int64)
        full = sizes == cfg.window
        window = np.zeros(len(pdf), np.int64)
        count = int(full.sum())
        window[full] = np.arange(count)
        if count < len(pdf):
            rest, _ = pack_shard(sizes[~full], cfg.window)
            window[~full] = rest + count
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.concatenate(([True], np.diff(window[order]) != 0))
        begin = (ends - sizes[order])[first][np.cumsum(first) - 1]
        offset = np.empty(len(pdf), np.int64)
        offset[order] = ends - sizes[order] - begin
        pdf["sequence_id"] = (int(pdf["shard"].iloc[0]) << 32) + window
        pdf["offset"] = offset
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf.drop(columns="shard")

    return dealt.groupBy("shard").applyInPandas(run, PACKED)
