"""Re-Pair compressed token files: write ids of whole texts in ascending doc_id order, read them back.

Documents are range-partitioned by doc_id, so that every file holds one run of the global order;
within a file, whole documents are gathered into shards of about ``shard_ids`` ids, and each shard
has its own grammar. Executors write each file under a name of its own; the manifest that the
successful attempts return says which files count, so a lost executor leaves only an orphan file.

Defined results: a null text is an empty one and has only its end id; rows with equal doc_id follow
each other by text; a null doc_id comes first; a text of any length is whole in one shard, which it then
makes larger; an empty table gives no file and no row; further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repair_codec
from .shared import lean, make_dir, open_fs, shared_path, small_batches

MANIFEST = "part int, path string, documents long, ids long, bytes long"
DOCUMENT_IDS = "doc_id long, start long, n_tokens long, ids_crc32 long"


@dataclass(frozen=True)
class TokenFormat:
    tokenizer: str  # path of the tokenizers JSON file
    vocabulary: int = 50257
    end_id: int = 2
    shard_ids: int = 1 << 18
    min_count: int = repair_codec.MIN_COUNT  # a pair that occurs less often doesn't pay for its rule


def write_tokens(docs: DataFrame, folder: str, fmt: TokenFormat, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; returns their manifest (a row a file) in the order of the ids."""
    spark = docs.sparkSession
    make_dir(folder)
    small_batches(spark)

    def write(batches) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        from .byte_bpe import encoder

        words = encoder(fmt.tokenizer)
        end = int(fmt.end_id).to_bytes(4, "little")
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.rpg"
        system, inner = open_fs(path)
        done, sink = {"documents": 0, "ids": 0, "bytes": 0}, None
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        shards: list[tuple[int, int]] = []  # place and first id of each
        size = 0

        def flush() -> None:
            nonlocal sink, size
            ids = np.frombuffer(b"".join(parts), "<u4")
            counts = np.array([len(p) // 4 for p in parts], np.int64)
            grammar = repair_codec.compress(ids, fmt.vocabulary, fmt.min_count)
            sink = sink or system.open_output_stream(inner)
            shards.append((done["bytes"], done["ids"]))
            done["bytes"] += repair_codec.write_shard(sink, doc_ids, counts, grammar)
            done["documents"] += len(parts)
            done["ids"] += len(ids)
            doc_ids.clear()
            parts.clear()
            size = 0

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, packed in zip(part.column(0).to_pylist(), words.packed_many(part.column(1).to_pylist()), strict=True):
                    if parts and size + len(packed) // 4 >= fmt.shard_ids:
                        flush()
                    doc_ids.append(doc)
                    parts.append(packed + end)
                    size += len(packed) // 4 + 1
        if parts:
            flush()
        if sink:
            done["bytes"] += repair_codec.write_index(sink, shards)
            sink.close()
            row = {"part": TaskContext.get().partitionId(), "path": path, **done}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    ordered = docs.select(F.col(id_col).cast("long"), F.col(text_col)).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, text_col)
    files = sorted(ordered.mapInArrow(lean(write), MANIFEST).collect())  # a row a file, never a row a document
    return spark.createDataFrame(files, MANIFEST)


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: its id, the ids before it, its ids and their crc32."""
    files, start = [], 0
    for f in manifest.orderBy("part").collect():
        files.append((f.path, start))
        start += f.ids

    def read(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inner = open_fs(path)
                with system.open_input_stream(inner) as source:
                    for doc_ids, counts, grammar in repair_codec.read_shards(source):
                        ids = grammar.decode().astype("<u4").tobytes()
                        ends = np.cumsum(counts.astype(np.int64))
                        starts = ends - counts
                        crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids, pa.int64()), pa.array(starts + begin), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        begin += len(ids) // 4

    if not files:
        return spark.createDataFrame([], DOCUMENT_IDS)
    rows = spark.createDataFrame(files, "path string, begin long").repartition(len(files))
    return rows.mapInArrow(lean(read), DOCUMENT_IDS)


def read_range(path: str, start: int, length: int) -> np.ndarray:
    """Random access: ids start .. start+length of one file of the manifest."""
    system, inner = open_fs(path)
    with system.open_input_file(inner) as source:
        return repair_codec.read_range(source, start, length)


def store_and_read(docs: DataFrame, fmt: TokenFormat) -> DataFrame:
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, shared_path(spark, "tokens"), fmt))
