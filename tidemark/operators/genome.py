"""Information in a network genome: connections(genome_id, key, weight, enabled), nodes(genome_id, key)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.deflate import raw_deflater
from . import metrics
from .position import with_position


def counts(connections: DataFrame, nodes: DataFrame) -> DataFrame:
    """genome_id, n_connections (disabled ones too), n_nodes."""
    c = connections.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_connections"))
    n = nodes.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return c.join(n, "genome_id", "full").na.fill(0, ["n_connections", "n_nodes"])


def weight_entropy(connections: DataFrame, bins: int = 50) -> DataFrame:
    """genome_id, entropy of the enabled weights scaled to [0, 1]; 0 without enabled weights or spread."""
    enabled = connections.filter("enabled and weight is not null")
    facts = enabled.groupBy("genome_id").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    scaled = enabled.join(facts.filter("hi > lo"), "genome_id").withColumn("v", (F.col("weight") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    found = metrics.entropy(metrics.histogram(scaled, "v", bins, ["genome_id"]), ["genome_id"])
    every = connections.select("genome_id").distinct()
    return every.join(found, "genome_id", "left").na.fill(0.0, ["entropy"])


def total_information(connections: DataFrame, nodes: DataFrame, bins: int = 50, node_information: float | None = None) -> DataFrame:
    """counts, entropy and total: all connections times the entropy of the enabled ones, and what the
    nodes hold, if given."""
    facts = counts(connections, nodes).join(weight_entropy(connections, bins), "genome_id", "left").na.fill(0.0, ["entropy"])
    return facts.withColumn("total_information", F.col("n_connections") * F.col("entropy") + F.lit(node_information or 0.0))


#: Bytes of a genome's piece that is one row.
PIECE_BYTES = 1 << 22


def _connection_json() -> Column:
    return F.to_json(F.struct("key", "weight", "enabled"))


def serialised(connections: DataFrame) -> DataFrame:
    """genome_id and bits: the length of the genome as a JSON list of its connections. A sum of lengths, so
    that no genome is ever one row."""
    size = F.sum(F.octet_length(_connection_json()) + 1)  # a comma or the closing bracket behind each, the opening one
    return connections.groupBy("genome_id").agg(((size + 1) * 8).cast("long").alias("bits"))


def pieces(connections: DataFrame) -> DataFrame:
    """(genome_id, piece, bytes): the JSON list in key order, cut between connections into pieces of about
    PIECE_BYTES."""
    placed = with_position(connections.select("genome_id", "key", "weight", "enabled"), "key", "weight", "enabled", by=("genome_id",), name="_at")
    rows = placed.withColumn("_json", _connection_json())
    most = rows.agg(F.max(F.octet_length("_json"))).first()[0] or 1
    rows = rows.withColumn("piece", F.floor(F.col("_at") / max(1, PIECE_BYTES // most)))
    joined = rows.groupBy("genome_id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_json"))), lambda r: r["_json"]), ",").alias("_text"))
    last = rows.groupBy(F.col("genome_id").alias("_g")).agg(F.max("piece").alias("_last"))
    ends = joined.join(last, F.col("genome_id").eqNullSafe(F.col("_g")))
    text = F.concat(F.when(F.col("piece") == 0, "[").otherwise(","), "_text", F.when(F.col("piece") == F.col("_last"), "]").otherwise(""))
    return ends.select("genome_id", "piece", text.cast("binary").alias("bytes"))


def complexity(connections: DataFrame) -> DataFrame:
    """genome_id, complexity: bytes of the raw deflate stream of the JSON list. A genome's pieces go through
    one compressor in order, so that a task holds a piece at a time."""

    def run(batches) -> Iterator:
        now, packer, size = None, None, 0
        for batch in batches:
            done = []
            for genome, piece, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if packer is None or piece == 0:
                    if packer is not None:
                        done.append((now, size + len(packer.flush())))
                    now, packer, size = genome, raw_deflater(), 0
                size += len(packer.compress(data))
            yield given(done, batch.schema.field(0).type)
        if packer is not None:
            yield given([(now, size + len(packer.flush()))], batch.schema.field(0).type)

    def given(rows: list[tuple], kind):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], kind), pa.array([n for _, n in rows], pa.int64())], ["genome_id", "complexity"])

    kind = connections.schema["genome_id"].dataType.simpleString()
    dealt = pieces(connections).repartition("genome_id").sortWithinPartitions("genome_id", "piece")
    return dealt.mapInArrow(run, f"genome_id {kind}, complexity long")
