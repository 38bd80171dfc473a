"""WARC archives of pages, deduplicated with revisit records.

Executors write gzip archives, one member per record, under names of their own into the shared
folder; the manifest that the successful attempts return says which archives count. Headers alone
are shuffled by payload digest: each is joined to the original of its digest (the row with the
largest page_id), and the second set of archives is written file by file from the first, with fresh
headers: the original as a response with its payload, the others as revisits that refer to it by its
record id, its address and its date. Archives are turned over at ``ARCHIVE_BYTES``.

Defined results: null html is an empty payload; payloads of fewer than min_bytes bytes are all
responses; rows with the original's page_id are responses too; a null page_id is an original only
where its payload has no other; null url gives no target field; every record has an id of its own,
also where page_ids repeat; a payload of any length is one record, held whole in its task; an empty
table gives no archive; further columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, make_dir, materialise, open_fs, shared_path, skew_safe_lookup, small_batches

# Fixed values of the archive format.
VERSION = "WARC/1.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CONTENT = "application/http; msgtype=response"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 1 << 30
MANIFEST = "part int, path string, records long, bytes long"
HEADERS = "path string, offset long, size long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, *facts) -> str:
    """An id from what tells the record from all others of these archives."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, (archive, *facts))))}>"


def _address(url: str | None) -> str | None:
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def build_record(own_id: str, page_id: int | None, url: str | None, digest: str, payload_bytes: int, payload: bytes | None, refers_to: tuple[str, int | None, str | None] | None = None) -> bytes:
    """A response record, or a revisit if there is no payload, of a response (record id, page_id, url);
    uncompressed."""
    of_id, of_page, of_url = refers_to or (None, None, None)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields = [
        ("WARC-Type", "revisit" if payload is None else "response"),
        ("WARC-Record-ID", own_id),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _address(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("WARC-Profile", PROFILE if payload is None else None),
        ("WARC-Refers-To", of_id),
        ("WARC-Refers-To-Target-URI", _address(of_url)),
        ("WARC-Refers-To-Date", DATE if refers_to else None),
        ("X-Page-Id", page_id),
        ("X-Payload-Length", payload_bytes),
        ("X-Refers-To-Page-Id", of_page),
        ("Content-Type", CONTENT),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload); the payload's digest is checked where the record has one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if first != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{payload_digest(payload)}":
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return fields, payload


def _member(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def read_archive(source, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, record) of each gzip member of an open archive."""
    offset, data = 0, b""
    while True:
        data = data or source.read(chunk)
        if not data:
            return
        unpacker, out, size = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not data:
                data = source.read(chunk)
                if not data:
                    raise EOFError("archive ends within a record")
            out.append(unpacker.decompress(data))
            size += len(data) - len(unpacker.unused_data)
            data = unpacker.unused_data
        yield offset, size, b"".join(out)
        offset += size


class _Writer:
    """The archives of a task, each begun with its first record."""

    def __init__(self, folder: str, level: int, most: int = ARCHIVE_BYTES):
        from pyspark import TaskContext

        self.folder, self.part, self.level, self.most = folder, TaskContext.get().partitionId(), level, most
        self.sink, self.done = None, []

    def add(self, record: bytes) -> None:
        member = _member(record, self.level)
        if self.sink is not None and self.done[-1]["bytes"] + len(member) > self.most:
            self.sink.close()
            self.sink = None
        if self.sink is None:
            path = f"{self.folder}/part-{self.part:06d}-{len(self.done):04d}-{uuid.uuid4().hex}.warc.gz"
            system, inner = open_fs(path)
            self.sink = system.open_output_stream(inner, compression=None)
            self.done.append({"part": self.part, "path": path, "records": 0, "bytes": 0})
        self.sink.write(member)
        self.done[-1]["records"] += 1
        self.done[-1]["bytes"] += len(member)

    def manifest(self) -> Iterator:
        import pyarrow as pa

        if self.sink is not None:
            self.sink.close()
            kinds = [("part", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]
            yield pa.RecordBatch.from_pylist(self.done, schema=pa.schema(kinds))


def write_responses(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """A response record per row; returns the manifest, a row per archive."""
    make_dir(folder)
    small_batches(pages.sparkSession)

    def run(batches) -> Iterator:
        out, number = _Writer(folder, level), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for page, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    payload = (html or "").encode("utf-8")
                    own_id = record_id(folder, out.part, number)
                    out.add(build_record(own_id, page, url, payload_digest(payload), len(payload), payload))
                    number += 1
        yield from out.manifest()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html"))
    return pages.sparkSession.createDataFrame(sorted(rows.mapInArrow(lean(run), MANIFEST).collect()), MANIFEST)


def read_headers(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Row per record, read from the archives."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        kinds = [("path", pa.string()), *((c, pa.int64()) for c in ("offset", "size", "page_id")), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        schema = pa.schema(kinds)
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = open_fs(path)
                with system.open_input_stream(inner, compression=None) as source:
                    rows = []
                    for offset, size, raw in read_archive(source):
                        f, _ = parse_record(raw)
                        rows.append((path, offset, size, number(f.get("X-Page-Id")), f.get("WARC-Target-URI"), int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], number(f.get("X-Refers-To-Page-Id"))))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    paths = [(r.path,) for r in manifest.collect()]  # archives, not records
    if not paths:
        return spark.createDataFrame([], HEADERS)
    return spark.createDataFrame(paths, "path string").repartition(len(paths)).mapInArrow(lean(run), HEADERS)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """headers with the original of their payload (page_id, path, offset, url), and whether they revisit it."""
    original = F.max(F.struct("page_id", "path", "offset", "url")).alias("original")
    facts = headers.groupBy("payload_digest").agg(original, F.count(F.lit(1)).alias("copies"))
    joined = skew_safe_lookup(headers.drop("record_type", "refers_to"), materialise(facts, "payloads"), "payload_digest", "copies", headers.count())
    other = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("original.page_id"))
    return joined.withColumn("revisit", other).drop("copies")


def write_deduplicated(resolved: DataFrame, folder: str, archives: int, level: int = 6) -> DataFrame:
    """Archives with fresh headers; payloads come from the archives that the rows name, of which there are
    so many. A task takes the rows of about one."""
    make_dir(folder)
    cols = ["path", "offset", "size", "page_id", "url", "payload_bytes", "payload_digest", "revisit", "original"]

    def run(batches) -> Iterator:
        out, opened, source = _Writer(folder, level), None, None
        for batch in batches:
            for row in batch.to_pylist():
                payload, of, refers_to = None, row["original"], None
                if row["revisit"]:
                    refers_to = (record_id(folder, of["path"], of["offset"]), of["page_id"], of["url"])
                else:
                    if row["path"] != opened:
                        system, inner = open_fs(row["path"])
                        opened, source = row["path"], system.open_input_file(inner)
                    raw = zlib.decompress(source.read_at(row["size"], row["offset"]), 31)
                    payload = parse_record(raw)[1]
                own_id = record_id(folder, row["path"], row["offset"])
                out.add(build_record(own_id, row["page_id"], row["url"], row["payload_digest"], row["payload_bytes"], payload, refers_to))
        yield from out.manifest()

    dealt = resolved.select(*cols).repartition(max(1, archives), "path").sortWithinPartitions("path", "offset")
    return resolved.sparkSession.createDataFrame(sorted(dealt.mapInArrow(lean(run), MANIFEST).collect()), MANIFEST)


def deduplicate_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages to archives to deduplicated archives; the headers of the latter, read back."""
    spark = pages.sparkSession
    first = write_responses(pages, shared_path(spark, "warc-all"))
    headers = materialise(read_headers(spark, first), "warc-headers")
    second = write_deduplicated(resolve(headers, min_bytes), shared_path(spark, "warc-deduplicated"), first.count())
    return read_headers(spark, second)
