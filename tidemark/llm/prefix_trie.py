"""Prefix tree of conversations by prefix-doubling naming.

Every distinct sequence of a conversation's first d turns is a node of depth d. Sequences get dense names,
so that equal ones are equal integers and no text is compared or moved more than once:

* turns are named by a 256-bit digest of role and text; a block of 2^(k+1) turns, at a multiple of its own
  length, is named by the pair of its halves' names, one join a round;
* the first d turns are the blocks of d's binary digits, from the largest on. From the highest digit down,
  prefixes that end with a block of 2^k turns are named by the pair (name of the prefix before, name of
  the block), one join a round. n turns make less than 2 n blocks and n prefixes, in 2 log2(longest) rounds.

A round names its pairs by one range sort, whose ties are cut by conversation and place: a first turn
that a third of the conversations share is spread over many tasks, each numbers the pairs it sees, and a
row a task settles where pairs go on in the next one.

A node's figures over its subtree are sums over its members: each node counts once, with its smallest
member, whose suffix sums over its own depths are added up by node. Ids of the conversations that end at
a node are written in runs of sorted ids, and the runs of a node go through one hash in order.

Defined results: turns are ordered by turn number, null ones first; equal numbers go by role, then by the
digest of role and text; null roles and texts are empty; rows that repeat are turns of their own; turns
without a conversation id take no part; texts of any length are one digest; an empty table gives no row
and no root; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.position import with_position
from .shared import Workspace, lean, skew_safe_lookup, small_batches

ROOT = 0
BLOCK = 1 << 16  # depths of one conversation that a window holds
RUN = 4096  # ids of a run


def digested(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, at, key, bytes): turns by place, with the digest of role and text and the text's bytes."""
    said, spoken = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    key = F.sha2(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, spoken), 256)
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), said.alias("role"), F.unhex(key).alias("key"), F.octet_length(spoken).cast("long").alias("bytes"))
    placed = with_position(rows.filter("conv_id IS NOT NULL"), "turn", "role", "key", by=("conv_id",), name="at")
    return placed.select("conv_id", "at", "key", "bytes")


def spliced(turns: DataFrame, base: Column, first: Column, most: int, keep) -> DataFrame:
    """turns, where the first ``first`` turns of each conversation are those of conversation ``base`` (as
    many as it has): columns over conv_id, first at most ``most``."""
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("copies"))
    facts = own.select("conv_id", "copies", base.alias("_base"), first.cast("long").alias("_first"))
    heads = keep(turns.filter(F.col("at") < most).withColumnRenamed("conv_id", "_base"), "heads")  # of each conversation a few turns
    given = facts.join(heads, "_base").filter("at < _first").select("conv_id", "at", "key", "bytes")
    held = heads.groupBy("_base").agg(F.count(F.lit(1)).alias("_held"))
    facts = facts.join(held, "_base", "left").select("conv_id", "copies", "_first", F.least("_first", F.coalesce("_held", F.lit(0))).alias("_given"))
    rest = skew_safe_lookup(turns, keep(facts, "splices"), "conv_id", "copies", turns.count()).filter("at >= _first")
    return given.unionByName(rest.select("conv_id", (F.col("at") - F.col("_first") + F.col("_given")).alias("at"), "key", "bytes"))


def _named(rows: DataFrame, keys: list[str], ties: list[str], start: int, keep) -> tuple[DataFrame, int]:
    """rows with ``name``: from ``start`` on, equal where the keys are equal, ascending with them; and the
    number after the last."""
    names = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", local long, part int"

    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, at, last = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in keys:
                column = batch.column(names.index(k))
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first = [batch.column(names.index(k))[0].as_py() for k in keys]
            new[0] = first != last
            local = at + np.cumsum(new)
            at, last = int(local[-1]), [batch.column(names.index(k))[n - 1].as_py() for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(np.full(n, part, np.int32))], [*names, "local", "part"])

    order = [*keys, *ties]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = keep(dealt.mapInArrow(lean(run), schema), "named")
    row = F.struct(*keys)
    ends = marked.groupBy("part").agg(F.max("local").alias("most"), F.min(row).alias("lo"), F.max(row).alias("hi")).orderBy("part").collect()  # a row a task
    offsets, before, seen = [], start, None
    for r in ends:
        same = seen is not None and seen == r.lo
        before -= same
        offsets.append((r.part, before))
        before += r.most + 1
        seen = r.hi
    placed = marked.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, "part int, _before long")), "part")
    return placed.select(*names, (F.col("local") + F.col("_before")).alias("name")), before


def prefixes(turns: DataFrame, everyone: DataFrame, keep) -> DataFrame:
    """(conv_id, depth, node, bytes, ends): row per conversation (of ``everyone``, turnless ones too) and
    depth; node names the prefix, root included; bytes of its last turn's text; ends: whether the
    conversation has no more turns."""
    turns = keep(turns, "turns")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    lengths = keep(everyone.join(counts, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length")), "lengths")
    longest = lengths.agg(F.max("length")).first()[0] or 0
    single, _ = _named(turns.select("conv_id", "at", "key"), ["key"], ["conv_id", "at"], 0, keep)
    blocks = [single.select("conv_id", "at", "name")]
    while 2 << (len(blocks) - 1) <= longest:
        size = 1 << (len(blocks) - 1)
        left = blocks[-1].filter(F.col("at") % (2 * size) == 0).withColumnRenamed("name", "a")
        right = blocks[-1].filter(F.col("at") % (2 * size) == size).select("conv_id", (F.col("at") - size).alias("at"), F.col("name").alias("b"))
        pairs, _ = _named(left.join(right, ["conv_id", "at"]), ["a", "b"], ["conv_id", "at"], 0, keep)
        blocks.append(pairs.select("conv_id", "at", "name"))
    known = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).cast("long").alias("node"))
    free = ROOT + 1
    for k in range(len(blocks) - 1, -1, -1):
        size = 1 << k
        before = known.filter(F.col("depth") % (2 * size) == 0).select("conv_id", F.col("depth").alias("at"), F.col("node").alias("a"))
        pairs = before.join(blocks[k].withColumnRenamed("name", "b"), ["conv_id", "at"])
        # a node of the round is a pair: the prefix before tells the depth too
        named, free = _named(pairs, ["a", "b"], ["conv_id", "at"], free, keep)
        known = known.unionByName(named.select("conv_id", (F.col("at") + size).alias("depth"), F.col("name").alias("node")))
    said = turns.select("conv_id", (F.col("at") + 1).alias("depth"), "bytes")
    rows = known.join(said, ["conv_id", "depth"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    last = lengths.select("conv_id", F.col("length").alias("depth"), F.lit(True).alias("ends"))
    return keep(rows.join(last, ["conv_id", "depth"], "left").withColumn("ends", F.coalesce("ends", F.lit(False))), "members")


def _suffix_sums(rows: DataFrame, columns: list[str], keep) -> DataFrame:
    """rows (conv_id, depth, ...) with the columns summed over the conversation's own and greater depths;
    a window holds BLOCK depths, and one row for each block."""
    rows = rows.withColumn("_b", F.floor(F.col("depth") / BLOCK))
    back = W.partitionBy("conv_id", "_b").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumns({c: F.sum(c).over(back) for c in columns})
    tall = keep(rows.filter(F.col("depth") % BLOCK == 0).filter("_b > 0").select("conv_id").distinct(), "tall")
    if tall.first() is None:
        return local.drop("_b")
    later = W.partitionBy("conv_id").orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.join(tall, "conv_id", "left_semi").groupBy("conv_id", "_b").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    carried = sums.select("conv_id", "_b", *[F.coalesce(F.sum(f"_{c}").over(later), F.lit(0)).alias(f"_{c}") for c in columns])
    joined = local.join(carried, ["conv_id", "_b"], "left")
    return joined.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in columns}).select(*[c for c in rows.columns if c != "_b"])


def _end_digests(ends: DataFrame, keep) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): hash of the ids, ascending and joined by commas. Runs are
    made where the sorted rows lie; a task then hashes a node's runs one after the other."""

    def runs(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            node, conv = (batch.column(k).to_numpy() for k in (0, 1))
            cuts = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]))
            cuts = np.unique(np.concatenate([cuts, np.arange(0, len(node), RUN)]))
            begin = cuts[:-1]
            text = [",".join(map(str, conv[s:e].tolist())) for s, e in zip(begin.tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node[begin]), pa.array(conv[begin]), pa.array(text)], ["node", "first", "ids"])

    def hashed(batches) -> Iterator:
        import pyarrow as pa

        now, state = None, None
        for batch in batches:
            done = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node == now:
                    state.update(b"," + text.encode())
                    continue
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = node, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in ((0, pa.int64()), (1, pa.string()))], ["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    dealt = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    written = keep(dealt.mapInArrow(lean(runs), "node long, first long, ids string"), "runs")
    return written.repartition("node").sortWithinPartitions("node", "first").mapInArrow(lean(hashed), "node long, ends_sha256 string")


def trie(turns: DataFrame, everyone: DataFrame, keep) -> DataFrame:
    """Row per node of (conv_id, at, key, bytes): conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. everyone: the conversations, by conv_id."""
    rows = prefixes(turns, everyone, keep)
    facts = rows.groupBy("node").agg(
        F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("node_bytes"), F.bool_and("ends").alias("leaf"), F.min("depth").alias("node_depth")
    )
    facts = keep(facts, "nodes")
    seen = skew_safe_lookup(rows, facts.select("node", "least", "n_convs", "node_bytes", "leaf"), "node", "n_convs", rows.count())
    own = F.col("conv_id") == F.col("least")
    weighed = seen.select(
        "conv_id", "depth", "node", "least",
        F.when(own, (F.col("n_convs") - 1) * F.col("node_bytes")).otherwise(0).alias("saved"),
        F.when(own & F.col("leaf"), 1).otherwise(0).cast("long").alias("leaves"),
    )
    summed = keep(_suffix_sums(weighed, ["saved", "leaves"], keep), "suffix-sums")
    subtree = summed.groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    chosen = summed.filter("conv_id = least")
    above = summed.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    parents = keep(chosen.select("conv_id", "depth", "node").join(above, ["conv_id", "depth"]).select("node", "parent", "parent_conv_id"), "parents")
    children = parents.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    ends = _end_digests(rows.filter("ends"), keep)
    out = facts.join(subtree, "node").join(parents, "node", "left").join(children, "node", "left").join(ends, "node", "left")
    return out.select(
        F.col("least").alias("conv_id"), F.col("node_depth").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, splice: tuple[Column, Column, int] | None = None) -> DataFrame:
    """The tree of turns (conv_id, turn, role, text), see ``trie``; splice: base, first and most of
    ``spliced``, where conversations are to be rebuilt before."""
    small_batches(turns.sparkSession)
    work = Workspace(turns.sparkSession, "prefix-trie")
    rows = work.keep(digested(turns), "digested")
    everyone = work.keep(rows.select("conv_id").distinct(), "conversations")
    if splice:
        rows = spliced(rows, *splice, work.keep)
    return work.result(trie(rows, everyone, work.keep), "trie")
