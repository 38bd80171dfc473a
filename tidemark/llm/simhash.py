"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of whole texts are reduced to the distinct ones. The 64 bits lie on a ring of nine
segments. If two fingerprints differ in at most d = 4 bits, the ring has a place from which every
chain of consecutive segments stays within its share of the budget: l segments differ in at most
floor(4 l / 9) bits. The first two segments are then equal, and one of the next two, which gives the
two index keys of each of the nine places; pairs that share a key have to pass the longer chains one
after another, and the last chain, all nine segments, is the full Hamming check.

Keys with many fingerprints are cut into blocks, and each pair of blocks is a task's work of bounded
size. A task returns a spanning forest of the links it found, not all pairs; the links of all tasks
then join in connected components.

Defined results: null or wordless text has fingerprint zero; equal fingerprints are linked; rows with
a null doc_id are grouped too but never name a component unless it has no other document (then null);
rows that repeat are rows of their own; texts of any length are read whole; an empty table gives no row;
``near_duplicates`` doesn't look at further columns, ``keep_one`` carries them along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard_join
from .components import connected_components
from .jaccard_join import Alike
from .shared import Workspace, free_name, lean, materialise, skew_safe_lookup, small_batches

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
# widths of the ring's segments, from the highest bit
WIDTHS = (8, 7, 7, 7, 7, 7, 7, 7, 7)
BLOCK = 1024


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes."""
    import xxhash

    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    count, total = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, total, 1 << 16):
        upto = min(total, at + (1 << 16))
        cuts = map(slice, starts[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist())
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[c], SEED) for c in cuts), "<u8", upto - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int32)
    return int(((count * 2 > total).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = np.array([fingerprint(t, size) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(lean(run), "doc_id long, fp long")


def _ring() -> list[tuple[int, list[int], int, int]]:
    """For each place: its number, the masks of its chains of 3 and more segments, its two key masks."""
    ends = np.cumsum(WIDTHS)
    segment = [((1 << w) - 1) << (64 - int(e)) for w, e in zip(WIDTHS, ends, strict=True)]
    n, out = len(segment), []
    for i in range(n):
        order = [segment[(i + j) % n] for j in range(n)]
        chains = [sum(order[: j + 1]) for j in range(n)]
        out.append((i, chains, chains[1] | order[2], chains[1] | order[3]))
    return out


RING = _ring()
BUDGETS = [MAX_BITS * (j + 1) // len(WIDTHS) for j in range(len(WIDTHS))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring_keys(distinct: DataFrame, *more: str) -> DataFrame:
    """18 rows per fingerprint: place, masked bits (the key), fp; more: columns that are carried along."""
    keys = [
        F.struct(F.lit(2 * i + j).cast("byte").alias("place"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("bits"))
        for i, _, *masks in RING
        for j, mask in enumerate(masks)
    ]
    return distinct.select("fp", *more, F.explode(F.array(*keys)).alias("k")).select("k.place", "k.bits", "fp", *more)


def _forest(left: np.ndarray, right: np.ndarray | None, place: int) -> list[tuple[int, int]]:
    """Links between two blocks of fingerprints (or within one) that pass all chains, as a forest."""
    _, chains, *_ = RING[place // 2]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, all_right = [], left if right is None else right
    for at in range(0, len(left), 256):
        a = left[at : at + 256]
        i, j = np.divmod(np.arange(len(a) * len(all_right)), len(all_right))
        if right is None:
            upper = j > i + at
            i, j = i[upper], j[upper]
        x = a[i] ^ all_right[j]
        for mask, budget in zip(chains[2:], BUDGETS[2:], strict=True):
            ok = np.bitwise_count(x & np.uint64(mask)) <= budget
            i, j, x = i[ok], j[ok], x[ok]
        for p, q in zip(a[i].tolist(), all_right[j].tolist(), strict=True):
            rp, rq = root(p), root(q)
            if rp != rq:
                parent[rq] = rp
                links.append((p, q))
    return links


def links(distinct: DataFrame, block: int = BLOCK, keep: Callable[[DataFrame, str], DataFrame] = materialise) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within MAX_BITS do."""
    keyed = keep(ring_keys(distinct), "ring-keys")
    sizes = keyed.groupBy("place", "bits").count().filter("count > 1")
    # rows of a key that stands alone end here; the join of a key with many rows is split by AQE
    shared = keyed.join(sizes, ["place", "bits"])
    blocks = F.ceil(F.col("count") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    tiled = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiled = tiled.select("place", "bits", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "own", "fp")
    tile = ["place", "bits", "t1", "t2"]

    def run(batches) -> Iterator:
        import pyarrow as pa

        def solve(table: pa.Table) -> list[tuple[int, int]]:
            cols = [table.column(c).to_numpy() for c in (*tile, "own", "fp")]
            fps = cols[5].view(np.uint64)
            change = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(fps)]
            found = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                first, mine = cols[2][s], cols[4][s:e]
                if cols[3][s] == first:
                    found += _forest(fps[s:e], None, int(cols[0][s])) if e - s > 1 else []
                else:
                    found += _forest(fps[s:e][mine == first], fps[s:e][mine != first], int(cols[0][s]))
            return found

        def result(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if not table.num_rows:
                continue
            # the last tile may go on in the next batch; a tile is bounded by two blocks
            same = np.ones(table.num_rows, bool)
            for c in tile:
                col = table.column(c).to_numpy()
                same &= col == col[-1]
            keep = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = table.slice(keep)
            if keep:
                yield result(solve(table.slice(0, keep)))
        if held is not None and held.num_rows:
            yield result(solve(held))

    dealt = tiled.repartition(*tile).sortWithinPartitions(*tile)
    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """Row per document: doc_id, fp, component_id, the least doc_id that links can reach."""
    work = Workspace(docs.sparkSession, "fingerprints")
    keep = work.keep
    rows = keep(fingerprints(docs, id_col, text_col, size), "fingerprints")
    classes = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "classes")
    found = connected_components(links(classes.select("fp"), keep=keep), keep=keep)
    labelled = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    facts = keep(labelled.join(names, "component").select("fp", "copies", "component_id"), "class-names")
    out = skew_safe_lookup(rows, facts, "fp", "copies", rows.count()).select("doc_id", "fp", "component_id")
    return work.result(out, "groups")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0")).cast(T.StringType())


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: Alike | None = None) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least doc_id. Rows without
    a doc_id can't be told apart by it and all stay; so do rows that share the least doc_id. alike: groups
    are linked by that similarity of shingle sets, exactly: all pairs within MAX_BITS bits come from the ring of
    fingerprints, those that are alike though further apart from the sets' rare shingles, and the sets decide."""
    mine = free_name(docs, "stays_id")
    groups = jaccard_join.near_duplicates(docs, id_col, text_col, alike, links, ring_keys, MAX_BITS) if alike else near_duplicates(docs, id_col, text_col)
    stays = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(mine)).distinct()
    named = docs.filter(F.col(id_col).isNotNull()).join(stays.hint("merge"), F.col(id_col).cast("long") == F.col(mine), "left_semi")
    return named.unionByName(docs.filter(F.col(id_col).isNull()))
