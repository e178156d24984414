"""A topic on shared storage: messages by routing key, with a sink that commits and a source that acknowledges.

Data files lie under ``data``; each belongs to one routing key and holds a JSON line for each message. What
counts is the log: numbered entries that list files, each written whole and never changed. A file that no entry lists is not
there for readers, so a task that fails, a task that runs twice or an epoch that is given up leaves nothing visible. An entry
also carries the last epoch of each writer; an epoch that comes again writes nothing.

``place`` of a message is (entry, row): its entry, and its row among the entry's messages. A consumer's offsets are the place
after the last message of a batch. ``prefetch`` bounds how many messages one batch takes; committing a batch
acknowledges them, and a new query of the same consumer begins after the last acknowledged one.

The folder must be reachable from the driver and all executors, by any path that ``pyarrow.fs`` knows (a mounted folder, an object store).
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as _fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "wardlight_topic"
SCHEMA = "routing_key string, type string, content_type string, body string, entry long, row long"
CONTENT_TYPE = "application/json"
#: Messages that a batch of a consumer takes at most.
PREFETCH = 100_000
#: Files of a task that are open at a time, and messages in one file at most.
OPEN_FILES, FILE_ROWS = 64, 500_000


def bound(keys: list[str], routing_key: str) -> bool:
    """Whether one of the binding keys fits: words between dots, ``*`` for one word, ``#`` for any number of words."""
    return any(_binding(k).fullmatch(f".{routing_key}") for k in keys)


def _binding(key: str) -> re.Pattern:
    words = {"*": r"\.[^.]*", "#": r"(?:\.[^.]*)*"}
    return re.compile("".join(words.get(w, r"\." + re.escape(w)) for w in key.split(".")))


class Topic:
    """Files and log of a topic."""

    def __init__(self, path: str):
        self.fs, self.root = _fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (_fs.LocalFileSystem(), path)

    def place(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def read(self, place: str) -> dict | None:
        if self.fs.get_file_info(place).type != _fs.FileType.File:
            return None
        with self.fs.open_input_stream(place) as f:
            return json.loads(f.read())

    def replace(self, place: str, content: dict) -> None:
        """Write a small file whole: readers see the old or the new one."""
        self.fs.create_dir(os.path.dirname(place), recursive=True)
        with self.fs.open_output_stream(passing := f"{place}.{uuid.uuid4().hex}") as f:
            f.write(json.dumps(content).encode())
        self.fs.move(passing, place)

    def create(self, place: str, content: dict | bytes) -> bool:
        """Write a file whole unless it is there. Of two writers at once one wins on a mounted folder; elsewhere a topic needs one writer at a time."""
        self.fs.create_dir(os.path.dirname(place), recursive=True)
        self.fs.create_dir(self.place("passing"), recursive=True)
        with self.fs.open_output_stream(passing := self.place("passing", uuid.uuid4().hex)) as f:
            f.write(content if isinstance(content, bytes) else json.dumps(content).encode())
        if isinstance(self.fs, _fs.LocalFileSystem):
            try:
                os.link(passing, place)
            except FileExistsError:
                return False
            finally:
                os.unlink(passing)
            return True
        if self.fs.get_file_info(place).type != _fs.FileType.NotFound:
            self.fs.delete_file(passing)
            return False
        self.fs.move(passing, place)
        return True

    def entry(self, number: int) -> dict | None:
        """A log entry: ``files`` as (routing key, path, messages), ``epochs`` by writer."""
        return self.read(self.place("log", f"{number:020d}.json"))

    def next_entry(self, known: int = 0) -> int:
        """The number of the first entry that is not there, at or after one that is known to be due: doubling steps, then halves."""
        there = lambda n: self.fs.get_file_info(self.place("log", f"{n:020d}.json")).type == _fs.FileType.File
        if not there(known):
            return known
        step = 1
        while there(known + step):
            step *= 2
        low, high = known + step // 2, known + step  # low is there, high is not
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if there(mid) else (low, mid)
        return high

    def delete(self, files: list) -> None:
        for _, name, _ in files:
            place = self.place("data", name)
            if self.fs.get_file_info(place).type == _fs.FileType.File:
                self.fs.delete_file(place)

    def commit(self, writer: str, epoch: int, files: list) -> bool:
        """List files as the next entry, unless the writer has committed the epoch; then they are deleted."""
        at = 0
        while files:  # an empty epoch writes nothing, however often it comes
            at = self.next_entry(at)
            epochs = self.entry(at - 1)["epochs"] if at else {}
            if epoch >= 0 and epochs.get(writer, -1) >= epoch:
                self.delete(files)
                return False
            if self.create(self.place("log", f"{at:020d}.json"), {"files": files, "epochs": epochs | ({writer: epoch} if epoch >= 0 else {})}):
                return True
        return False


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written: (routing key, path, messages)."""

    files: list


class _Writing:
    def __init__(self, path: str, default_key: str | None, names: list[str]):
        self.path, self.default_key, self.names = path, default_key, names

    def write(self, iterator) -> Written:
        """One file for each routing key; a task with many keys closes the file that it opened first and goes on in a new one."""
        topic, open_files, done = Topic(self.path), {}, []
        topic.fs.create_dir(topic.place("data"), recursive=True)

        def close(key: str) -> None:
            f, name, n = open_files.pop(key)
            f.close()
            done.append((key, name, n))

        try:
            for row in iterator:
                message = {n: row[n] for n in self.names}
                key = message.get("routing_key") or self.default_key
                if not key:
                    raise ValueError("a message has no routing key")
                if key not in open_files:
                    if len(open_files) >= OPEN_FILES:
                        close(next(iter(open_files)))
                    name = f"{uuid.uuid4().hex}.jsonl"
                    open_files[key] = [topic.fs.open_output_stream(topic.place("data", name)), name, 0]
                own = open_files[key]
                own[0].write(json.dumps([message.get("type"), message.get("content_type") or CONTENT_TYPE, message.get("body")]).encode() + b"\n")
                own[2] += 1
                if own[2] >= FILE_ROWS:
                    close(key)
            for key in list(open_files):
                close(key)
        except BaseException:
            for f, name, n in open_files.values():
                f.close()
                done.append((None, name, n))
            topic.delete(done)
            raise
        return Written(done)

    def _files(self, messages: list) -> list:
        return [f for m in messages if m is not None for f in m.files]


class TopicWriter(_Writing, DataSourceWriter):
    """A batch as one entry, which no later one repeats."""

    def commit(self, messages) -> None:
        Topic(self.path).commit("batch", -1, self._files(messages))

    def abort(self, messages) -> None:
        Topic(self.path).delete(self._files(messages))


class TopicStreamWriter(_Writing, DataSourceStreamWriter):
    """Each epoch as one entry, once."""

    def __init__(self, path: str, default_key: str | None, names: list[str], writer: str):
        super().__init__(path, default_key, names)
        self.writer = writer

    def commit(self, messages, batchId: int) -> None:
        Topic(self.path).commit(self.writer, batchId, self._files(messages))

    def abort(self, messages, batchId: int) -> None:
        Topic(self.path).delete(self._files(messages))


@dataclass
class Slice(InputPartition):
    """Messages from ``first`` to before ``last`` of a file whose first message is row ``row`` of its entry."""

    routing_key: str
    name: str
    first: int
    last: int
    entry: int
    row: int


def _read(path: str, part: Slice) -> Iterator[tuple]:
    topic = Topic(path)
    with topic.fs.open_input_stream(topic.place("data", part.name), buffer_size=1 << 20) as f:
        rest, n = b"", 0
        while n < part.last:
            more = f.read(1 << 20)
            *lines, rest = (rest + more).split(b"\n")
            for line in lines:
                if part.first <= n < part.last:
                    kind, content_type, body = json.loads(line)
                    yield part.routing_key, kind, content_type, body, part.entry, part.row + n
                n += 1
            if not more:
                break


def _slices(topic: Topic, keys: list[str], start: dict, end: dict) -> list[Slice]:
    """The messages between two places that are bound, file by file; so each partition has one routing key."""
    out = []
    for number in range(start["entry"], end["entry"] + (end["row"] > 0)):
        row = 0
        for key, name, n in topic.entry(number)["files"]:
            first = max(0, start["row"] - row) if number == start["entry"] else 0
            last = min(n, end["row"] - row) if number == end["entry"] else n
            if first < last and bound(keys, key):
                out.append(Slice(key, name, first, last, number, row))
            row += n
    return out


class TopicReader(DataSourceReader):
    """All messages that are committed when the read is planned."""

    def __init__(self, path: str, keys: list[str]):
        self.path, self.keys = path, keys

    def partitions(self) -> list[Slice]:
        topic = Topic(self.path)
        return _slices(topic, self.keys, {"entry": 0, "row": 0}, {"entry": topic.next_entry(), "row": 0}) or [Slice("", "", 0, 0, 0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return _read(self.path, partition) if partition.last else iter(())


class TopicStreamReader(DataSourceStreamReader):
    """A consumer: batches of at most ``prefetch`` messages from the last acknowledged one on.

    Spark repeats a batch that it has planned and not finished, and so knows more than the last acknowledgement; the place up to which
    batches were planned is kept beside it, and a consumer that starts again goes on from there.
    """

    def __init__(self, path: str, keys: list[str], consumer: str, prefetch: int):
        self.path, self.keys, self.prefetch = path, keys, prefetch
        self.topic = Topic(path)
        self.own = self.topic.place("consumers", f"{consumer}.json")
        self.state = self.topic.read(self.own) or {"acknowledged": {"entry": 0, "row": 0}, "planned": {"entry": 0, "row": 0}}

    def initialOffset(self) -> dict:
        return self.state["acknowledged"]

    def latestOffset(self) -> dict:
        at, left = dict(self.state["planned"]), self.prefetch
        while left > 0 and (entry := self.topic.entry(at["entry"])) is not None:
            row = 0
            for key, _, n in entry["files"]:
                if row + n > at["row"]:
                    fits = bound(self.keys, key)
                    first = max(0, at["row"] - row)
                    take = min(n - first, left) if fits else n - first
                    left -= take if fits else 0
                    at["row"] = row + first + take
                    if left <= 0:
                        break
                row += n
            if left > 0 or at["row"] >= sum(n for _, _, n in entry["files"]):
                at = {"entry": at["entry"] + 1, "row": 0}
        return at

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        if (end["entry"], end["row"]) > (self.state["planned"]["entry"], self.state["planned"]["row"]):
            self._keep(planned=end)
        return _slices(self.topic, self.keys, start, end)

    def read(self, partition: Slice) -> Iterator[tuple]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        self._keep(acknowledged=end)

    def _keep(self, **state: dict) -> None:
        self.state = self.state | state
        self.topic.replace(self.own, self.state)


class TopicSource(DataSource):
    """Options: ``path``; to read ``routing_keys`` (comma-separated, blanks ignored, default #), ``consumer`` and ``prefetch``; to write ``routing_key`` for rows without one, and ``writer``, the name under which a stream's epochs are known."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _keys(self) -> list[str]:
        return [k.strip() for k in self.options.get("routing_keys", "#").split(",") if k.strip()]

    def reader(self, schema) -> TopicReader:
        return TopicReader(self.options["path"], self._keys())

    def streamReader(self, schema) -> TopicStreamReader:
        return TopicStreamReader(self.options["path"], self._keys(), self.options.get("consumer", "default"), int(self.options.get("prefetch", PREFETCH)))

    def writer(self, schema, overwrite: bool) -> TopicWriter:
        if overwrite:
            raise ValueError("a topic is appended to")
        return TopicWriter(self.options["path"], self.options.get("routing_key"), schema.fieldNames())

    def streamWriter(self, schema, overwrite: bool) -> TopicStreamWriter:
        return TopicStreamWriter(self.options["path"], self.options.get("routing_key"), schema.fieldNames(), self.options.get("writer", "stream"))


def publish(messages: DataFrame, path: str, routing_key: str | None = None) -> None:
    """Append (type, body) and, unless all go to ``routing_key``, (routing_key) as one entry; ``content_type`` is optional."""
    messages.sparkSession.dataSource.register(TopicSource)
    out = messages.write.format(FORMAT).mode("append").option("path", path)
    (out.option("routing_key", routing_key) if routing_key else out).save()


def start_publishing(messages: DataFrame, path: str, checkpoint: str, writer: str = "stream"):
    """A stream's (routing_key, type, body), each epoch once; to be given a trigger and started."""
    messages.sparkSession.dataSource.register(TopicSource)
    return messages.writeStream.format(FORMAT).option("path", path).option("writer", writer).option("checkpointLocation", checkpoint)


def messages(spark: SparkSession, path: str, routing_keys: str = "#") -> DataFrame:
    """All messages of a topic that are committed (see ``SCHEMA``)."""
    spark.dataSource.register(TopicSource)
    return spark.read.format(FORMAT).option("path", path).option("routing_keys", routing_keys).load()


def consume(spark: SparkSession, path: str, routing_keys: str = "#", consumer: str = "default", prefetch: int = PREFETCH) -> DataFrame:
    """A stream of a topic's messages."""
    spark.dataSource.register(TopicSource)
    return spark.readStream.format(FORMAT).option("path", path).option("routing_keys", routing_keys).option("consumer", consumer).option("prefetch", prefetch).load()


def orphans(path: str) -> list[str]:
    """Data files that no entry lists: what failed tasks left, or what running ones have not committed yet."""
    topic = Topic(path)
    listed = {name for n in range(topic.next_entry()) for _, name, _ in topic.entry(n)["files"]}
    found = topic.fs.get_file_info(_fs.FileSelector(topic.place("data"), allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name not in listed)
