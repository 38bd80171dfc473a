"""Settings and logs of a remote store as a data source: ``register`` makes ``tidemark_remote`` known.

    spark.read.format("tidemark_remote").option("url", u).load()            # key, value (JSON)
    frame.write.format("tidemark_remote").option("url", u).mode("append").save()
    stream.writeStream.format("tidemark_remote").option("url", u).option("query", name).start()

Options: url, username and password (basic authentication where both are given), part_rows (rows of a
request, 1,000), and for streams query, a name of their own that stays the same when they are started again. A read is one object, of which each setting is a row. A write sends rows as form field
``json_rows``, a JSON list a request.

Tasks send nothing themselves: each writes its rows to files in ``stage`` (a folder that driver and executors
share, by default spark.checkpoint.dir) and names them in its commit message. Spark gives the
driver the messages of one attempt of each task, and these files' rows are sent, a request for each file,
one at a time; so a task that is tried again, or speculated, sends nothing twice. What has been sent is marked
beside the files, by query and batch: a batch that is replayed after a failure goes on behind the last mark.
Only a request whose reply is lost may reach the store again; it has the same ``Idempotency-Key``.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .scratch import shared_root
from .settings import RemoteError, request

log = logging.getLogger(__name__)
NAME = "tidemark_remote"


@dataclass
class Staged(WriterCommitMessage):
    """Files of a task, in the order of its rows."""

    files: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url = self.options["url"]
        try:
            with request(url, self.options.get("username"), self.options.get("password")) as reply:
                found = json.load(reply)
        except (OSError, ValueError) as e:
            raise RemoteError(f"can't load the settings from {url}") from e
        if not isinstance(found, dict):
            raise RemoteError(f"the settings at {url} are no object")
        for key, value in found.items():
            yield key, json.dumps(value)


class _Sender:
    """What tasks stage and the driver sends."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = dict(options), schema.names
        if not self.options.get("stage"):
            self.options["stage"] = f"{shared_root(SparkSession.active())}/tidemark/remote"
        self.rows = int(self.options.get("part_rows", 1000))

    def stage(self, iterator: Iterator) -> Staged:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self._uri())
        system.create_dir(root, recursive=True)
        files, part = [], []

        def write() -> None:
            name = f"{uuid.uuid4().hex}.json"
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(json.dumps(part, default=str).encode())
            files.append(name)
            part.clear()

        for row in iterator:
            part.append(dict(zip(self.names, row, strict=True)))
            if len(part) == self.rows:
                write()
        if part:
            write()
        return Staged(files)

    def _uri(self) -> str:
        at = self.options["stage"]
        return at if "://" in at or at.startswith("file:") else f"file://{at}"

    def send(self, messages: list, batch: str) -> None:
        """Requests of a batch, but those that a mark says have been sent."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self._uri())
        system.create_dir(f"{root}/sent", recursive=True)
        mark = f"{root}/sent/{batch}"
        done = 0
        if system.get_file_info(mark).type == fs.FileType.File:
            with system.open_input_stream(mark) as f:
                done = int(f.read())
        files = [name for m in messages if m is not None for name in m.files]
        try:
            for k, name in enumerate(files):
                if k >= done:
                    with system.open_input_stream(f"{root}/{name}") as f:
                        self._post(f.read().decode(), f"{batch}-{k}")
                    with system.open_output_stream(mark) as f:
                        f.write(str(k + 1).encode())
        finally:
            self.forget(messages)  # a replay of the batch writes its files anew

    def _post(self, rows: str, key: str) -> None:
        try:
            with request(self.options["url"], self.options.get("username"), self.options.get("password"), {"json_rows": rows}, {"Idempotency-Key": key}):
                pass
        except OSError as e:
            raise RemoteError(f"can't send to {self.options['url']}") from e

    def forget(self, messages: list) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self._uri())
        for m in messages:
            for name in m.files if m is not None else ():
                if system.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                    system.delete_file(f"{root}/{name}")


class _Writer(DataSourceWriter):
    def __init__(self, sender: _Sender):
        self.sender, self.job = sender, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        return self.sender.stage(iterator)

    def commit(self, messages: list) -> None:
        self.sender.send(messages, self.job)

    def abort(self, messages: list) -> None:
        self.sender.forget(messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, sender: _Sender):
        self.sender = sender

    def write(self, iterator: Iterator) -> Staged:
        return self.sender.stage(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self.sender.send(messages, f"{self.sender.options['query']}-{batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        self.sender.forget(messages)


class RemoteSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _checked(self) -> dict:
        options = dict(self.options)
        if not options.get("url"):
            raise ValueError("the option url is missing")
        return options

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._checked())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(_Sender(self._checked(), schema))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        options = self._checked()
        if not options.get("query"):
            raise ValueError("the option query is missing: marks of what has been sent stand under it")
        return _StreamWriter(_Sender(options, schema))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RemoteSource)
