"""Genomes of any size: bits are a sum, complexity goes piece by piece."""

import json
import zlib

from pyspark.sql import functions as F

from tidemark.operators import genome


def rows(spark, n):
    return spark.range(n).select(F.lit("big").alias("genome_id"), F.concat(F.lit("c-"), "id").alias("key"), F.lit(0.5).alias("weight"), (F.col("id") % 2 == 0).alias("enabled"))


def test_bits_of_ten_million_connections(spark):
    n = 10_000_000
    digits = sum(len(str(b)) * (min(n, 10 * b) - b) for b in (10**k for k in range(7))) + 1  # of the keys 0 .. n - 1
    each = len('{"key":"c-","weight":0.5,"enabled":}') * n + digits + 4 * (n // 2) + 5 * (n // 2)
    [r] = genome.serialised(rows(spark, n)).collect()
    assert r.bits == 8 * (each + n + 1)


def test_complexity_is_that_of_the_whole_genome(spark, monkeypatch):
    small = rows(spark, 500).unionByName(spark.createDataFrame([("a", "k", 1.5, True), ("b", "k", None, None), ("b", "é", 2.0, False)], "genome_id string, key string, weight double, enabled boolean"))
    held = {}
    for r in small.collect():
        held.setdefault(r.genome_id, []).append({k: v for k, v in (("key", r.key), ("weight", r.weight), ("enabled", r.enabled)) if v is not None})
    want = {}
    for g, own in held.items():
        text = json.dumps(sorted(own, key=lambda c: c["key"]), separators=(",", ":"), ensure_ascii=False).encode()
        packer = zlib.compressobj(9, zlib.DEFLATED, -15)
        want[g] = (len(text) * 8, len(packer.compress(text)) + len(packer.flush()))
    bits = {r.genome_id: r.bits for r in genome.serialised(small).collect()}
    assert bits == {g: b for g, (b, _) in want.items()}
    for size in (genome.PIECE_BYTES, 1000):
        monkeypatch.setattr(genome, "PIECE_BYTES", size)
        assert {r.genome_id: r.complexity for r in genome.complexity(small).collect()} == {g: c for g, (_, c) in want.items()}
    assert genome.pieces(small).filter("genome_id = 'big'").count() > 10
