"""Queries of the llm operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_rotation, digest_index, nbsvm, packing, piece_bpe, pivot_search, prefix_trie, simhash, span_crf, sparse_suffix, token_store, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repair_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = token_store.TokenFormat(_vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_store.store_and_read(_table(spark, sf_dir, "documents"), fmt)


def op2_exact_dedup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    index = digest_index.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}").create()
    rows = index.ingest(_table(spark, sf_dir, "documents"))
    index.drop()  # the answer holds what it needs of it
    return rows.select(
        "doc_id", "keep_id", F.col("copies").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def digest_index_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches into one index: what the first has brought, the second doesn't keep."""
    import uuid

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    index = digest_index.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets=16).create()
    batches = [index.ingest(docs.filter(F.pmod("doc_id", F.lit(2)) == k)).withColumn("batch", F.lit(k)) for k in (0, 1)]
    index.compact()
    index.drop()
    return batches[0].union(batches[1]).select("doc_id", "batch", "keep_id", F.col("copies").alias("batch_copies"), "kept")


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(_table(spark, sf_dir, "conversations"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicate_archives(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return nbsvm.classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op8_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op9_sparse_suffix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.repeated_passages(_table(spark, sf_dir, "documents")).drop("text_key")


def op10_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.Packing(_vocabulary("byte_bpe_50k.json")))


def op11_prefix_doubling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    first = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), (conv - conv % 5, first, 8))


def op12_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_crf.find(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_repair_token_store,
        op2_exact_dedup_index,
        digest_index_batches,
        op3_perspective_rotation,
        op4_warc_revisits,
        op5_pivot_top_k,
        op6_quality_nbsvm,
        op7_sentencepiece,
        op8_simhash_pigeonring,
        op9_sparse_suffix_passages,
        op10_karmarkar_karp_packing,
        op11_prefix_doubling_trie,
        op12_semi_markov_pii,
        op13_vector_codes,
    )
}

#: crc32 of a string, bit by bit; the polynomial is a fixed value
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: CAST(ord(c) AS BIGINT))),
                lambda held, byte: list_reduce(list_prepend(xor(held, byte), CAST(range(0, 8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Rounds of assigning and averaging, one after the other."""
    near = """a{0} AS (SELECT vec_id, part, v, first(entry ORDER BY d, entry) AS entry, min(d) AS d FROM (
            SELECT p.vec_id, p.part, p.v, b.entry, list_sum(list_transform(list_zip(p.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
            FROM pieces p JOIN b{0} b ON p.part = b.part) GROUP BY vec_id, part, v)"""
    mean = """b{1} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{0} b LEFT JOIN (
            SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
                SELECT part, entry, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{0}, (SELECT unnest(range(1, (SELECT width + 1 FROM size))) AS i) GROUP BY part, entry, i)
            GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)"""
    steps = [s for k in range(rounds) for s in (near.format(k), mean.format(k, k + 1))] + [near.format(rounds)]
    return f"""
        WITH whole AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        size AS (SELECT max(len(v)) // {parts} AS width FROM whole),
        pieces AS (SELECT vec_id, p AS part, v[p * width + 1 : (p + 1) * width] AS v FROM whole, size, (SELECT unnest(range(0, {parts})) AS p)),
        b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM pieces QUALIFY entry < {entries}),
        {', '.join(steps)},
        coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
        sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN whole USING (vec_id), sha"""


ORACLE_SQL: dict[str, str] = {
    "op11_prefix_doubling_trie": f"""
        WITH t AS (
            SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS said,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) - 1 AS place
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM t),
        parts AS (
            SELECT c.conv_id, 0 AS own, b.place, b.said FROM c JOIN t b ON b.conv_id = c.base AND b.place < c.h
            UNION ALL SELECT t.conv_id, 1, t.place, t.said FROM t JOIN c ON c.conv_id = t.conv_id AND t.place >= c.h),
        whole AS (SELECT c.conv_id, coalesce(list(said ORDER BY own, place) FILTER (WHERE said IS NOT NULL), []) AS said FROM c LEFT JOIN parts USING (conv_id) GROUP BY c.conv_id),
        members AS (SELECT conv_id, len(said) AS n, depth, said[1:depth] AS node FROM (SELECT *, unnest(range(0, len(said) + 1)) AS depth FROM whole)),
        nodes AS (
            SELECT node, depth, min(conv_id) AS least, count(*) AS n_convs, coalesce(octet_length(encode(node[depth].t)), 0) AS bytes, bool_and(n = depth) AS leaf,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
            FROM members GROUP BY node, depth),
        own AS (
            SELECT m.conv_id, m.depth, m.node, CASE WHEN m.conv_id = least THEN (n_convs - 1) * bytes ELSE 0 END AS saved, CASE WHEN m.conv_id = least AND leaf THEN 1 ELSE 0 END AS leaf
            FROM members m JOIN nodes USING (node, depth)),
        below AS (
            SELECT node, depth, sum(saved) AS saved, sum(leaf) AS leaves FROM (
                SELECT node, depth, sum(saved) OVER w AS saved, sum(leaf) OVER w AS leaf FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY depth DESC))
            GROUP BY node, depth),
        children AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL)
        SELECT n.least AS conv_id, n.depth, p.least AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
               CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN below b ON n.node = b.node AND n.depth = b.depth LEFT JOIN children c ON n.node = c.node AND n.depth = c.depth
        LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]""",
    "op13_vector_codes": _codes_sql(),
    "op2_exact_dedup_index": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "digest_index_batches": """
        WITH d AS (SELECT doc_id, CAST(doc_id % 2 AS INTEGER) AS batch, coalesce(text, '') AS t FROM documents),
        b AS (SELECT t, batch, max(doc_id) AS top, count(*) AS n FROM d GROUP BY t, batch),
        k AS (SELECT t, arg_min(top, batch) AS keep_id FROM b GROUP BY t)
        SELECT d.doc_id, d.batch, k.keep_id, b.n AS batch_copies, d.doc_id = k.keep_id AS kept
        FROM d JOIN b ON d.t = b.t AND d.batch = b.batch JOIN k ON d.t = k.t""",
    "op3_perspective_rotation": """
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                   (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1) // 1024 AS part
            FROM conversations),
        speakers AS (SELECT DISTINCT conv_id, role AS participant FROM said),
        lines AS (
            SELECT s.conv_id, s.part, p.participant, s.turn, s.role, s.text, s.role = p.participant AS own,
                   CASE WHEN s.role = p.participant THEN '<|assistant|>' ELSE '<|user name=' || s.role || '|>' END || chr(10) AS head
            FROM said s JOIN speakers p ON s.conv_id = p.conv_id),
        placed AS (
            SELECT *, coalesce(sum(length(head) + length(text) + 8) OVER (
                       PARTITION BY conv_id, part, participant ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
            FROM lines)
        SELECT conv_id, part, participant, CAST(coalesce(sum(sum(length(head) + length(text) + 8)) OVER (
                   PARTITION BY conv_id, participant ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS part_start,
               count(*) AS n_turns, count(*) FILTER (WHERE own) AS own_turns,
               string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered,
               coalesce(string_agg(CAST(place + length(head) AS BIGINT) || '-' || CAST(place + length(head) + length(text) + 8 AS BIGINT), ',' ORDER BY turn, role, text) FILTER (WHERE own), '') AS spans
        FROM placed GROUP BY conv_id, part, participant""",
    # base32 of a digest's 160 bits: five hexadecimal digits are four of its letters
    "op4_warc_revisits": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        h AS (SELECT *, upper(sha1(payload)) AS hex, max(page_id) OVER (PARTITION BY payload) AS original FROM p),
        d AS (SELECT *, list_transform(range(0, 40), lambda i: strpos('0123456789ABCDEF', hex[i + 1]) - 1) AS n FROM h)
        SELECT page_id, octet_length(payload) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(list_sum(list_transform(range(0, 5),
                   lambda b: ((n[1 + (5 * k + b) // 4] >> (3 - (5 * k + b) % 4)) & 1) << (4 - b))) AS INTEGER)]), '') AS payload_digest,
               CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> original THEN original END AS refers_to
        FROM d""",
    "op5_pivot_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
