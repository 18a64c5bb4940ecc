"""Recordings as a Spark data source: spark.read.format("recording") and spark.readStream.format("recording").

One row for each message: path, mission_id, topic, schema, seq, log_time_ns, publish_time_ns, size_bytes, payload (JSON,
where decode is on) and error. An MCAP file with a chunk index is read chunk by chunk, in parallel, and filters on topic
and log_time_ns leave chunks out; one without is read in order up to its torn end. Other formats are one partition a
file. A file that can't be read gives a row with its error. Streams follow MCAP files as they grow: only whole records
are read, and the offset holds the channels seen so far, so a restart goes on where it stopped.

Options: decode (false), what (messages, topics or schemas), speed (streams: 0 reads all there is, else recorded
time passes so many times as fast as the clock), chunkBytes (of one partition). Paths are on file systems that executors
mount; recordings.read_arrivals() reads any store that Spark reaches.
"""

from __future__ import annotations

import glob
import os
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidemark.sources import recordings
from tidemark.sources.decode import as_json

MESSAGES = "path string, mission_id string, topic string, schema string, seq long, log_time_ns long, publish_time_ns long, size_bytes long, payload string, error string"
TOPICS = "path string, mission_id string, topic string, schema string, n long, start_ns long, end_ns long, qos string, partial boolean, in_progress boolean, error string"
SCHEMAS = "path string, topic string, schema string, text string"
#: Seconds since its last change within which an incomplete file counts as still being written.
FRESH_S = 5.0


def resolved(path: str, roots: list[str] | None = None) -> list[str]:
    """The recordings at a path: a file of a known kind, or those in a folder, in order; raises for others.

    With roots, a path outside of all of them is refused.
    """
    real = os.path.realpath(path.removeprefix("file://"))
    if roots is not None and not any(real == (r := os.path.realpath(x)) or real.startswith(r + os.sep) for x in roots):
        raise PermissionError(f"{path} is under none of the configured roots")
    if os.path.isdir(real):
        return sorted(f for k in recordings.READERS for f in glob.glob(f"{glob.escape(real)}/**/*.{k}", recursive=True) if os.path.isfile(f))
    if real.rsplit(".", 1)[-1].lower() not in recordings.READERS:
        raise ValueError(f"no reader for {path}: a recording ends in {', '.join(sorted(recordings.READERS))}")
    if not os.path.exists(real):
        raise FileNotFoundError(path)
    return [real]


def kind_of(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def name_of(path: str) -> str:
    """mission_id() of a file, of which two ends are read."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        if size <= 2 << 20:
            return recordings.mission_id(f.read())
        head = f.read(1 << 20)
        f.seek(-(1 << 20), os.SEEK_END)
        return recordings.mission_of(size, head, f.read())


@dataclass
class Index:
    """The summary of an MCAP file."""

    channels: dict[int, tuple[str, int, dict[str, str]]]  # topic, schema, metadata
    schemas: dict[int, tuple[str, str]]  # name, text
    chunks: list[tuple[int, int, int, int, frozenset[int]]]  # start, end, offset, length, channels
    counts: dict[int, int]
    start: int
    end: int


def _map(r: bytes, at: int, key: str, value: str) -> tuple[dict, int]:
    n = struct.unpack_from("<I", r, at)[0]
    size = struct.calcsize("<" + key + value)
    return dict(struct.unpack_from("<" + key + value, r, at + 4 + i * size) for i in range(n // size)), at + 4 + n


def _strings(r: bytes, at: int) -> dict[str, str]:
    end, out = at + 4 + struct.unpack_from("<I", r, at)[0], {}
    at += 4
    while at < end:
        k, at = recordings._text(r, at)
        out[k], at = recordings._text(r, at)
    return out


def channel_of(r: bytes) -> tuple[int, tuple[str, int, dict[str, str]]]:
    i, schema = struct.unpack_from("<HH", r)
    topic, at = recordings._text(r, 4)
    _, at = recordings._text(r, at)
    return i, (topic, schema, _strings(r, at))


def schema_of(r: bytes) -> tuple[int, tuple[str, str]]:
    name, at = recordings._text(r, 2)
    _, at = recordings._text(r, at)
    n = struct.unpack_from("<I", r, at)[0]
    return struct.unpack_from("<H", r)[0], (name, bytes(r[at + 4 : at + 4 + n]).decode("utf-8", "replace"))


def summary(path: str) -> Index | None:
    """The summary at the end of a whole file; nothing else is read."""
    with open(path, "rb") as f:
        if f.read(8) != recordings.MAGIC:
            raise ValueError("not an MCAP file")
        size = os.path.getsize(path)
        if size < 45:
            return None
        f.seek(size - 37)
        tail = f.read(37)
        if tail[29:] != recordings.MAGIC or tail[0] != 0x02:
            return None
        begin = struct.unpack_from("<Q", tail, 9)[0]
        if not begin:
            return None
        f.seek(begin)
        data = f.read(size - 37 - begin)
    out = Index({}, {}, [], {}, 0, 0)
    for op, r in recordings.mcap_records(data):
        if op == 0x03:
            i, s = schema_of(r)
            out.schemas[i] = s
        elif op == 0x04:
            i, c = channel_of(r)
            out.channels[i] = c
        elif op == 0x08:
            a, b, at, n = struct.unpack_from("<QQQQ", r)
            out.chunks.append((a, b, at, n, frozenset(_map(r, 32, "H", "Q")[0])))
        elif op == 0x0B:
            out.start, out.end = struct.unpack_from("<QQ", r, 26)
            out.counts = _map(r, 42, "H", "Q")[0]
    return out


def records_from(path: str, at: int, end: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(offset, opcode, content) of the whole records from an offset on, one in memory at a time."""
    with open(path, "rb") as f:
        size = os.path.getsize(path) if end is None else end
        f.seek(at)
        while at + 9 <= size:
            head = f.read(9)
            if head[:8] == recordings.MAGIC:
                at += 8
                f.seek(at)
                continue
            n = struct.unpack_from("<Q", head, 1)[0]
            if at + 9 + n > size:
                return
            yield at, head[0], f.read(n)
            at += 9 + n


class Messages:
    """Messages of records, with the channels and schemas that come along."""

    def __init__(self, channels: dict | None = None, schemas: dict | None = None) -> None:
        self.channels, self.schemas = channels or {}, schemas or {}

    def of(self, at: int, op: int, r: bytes) -> Iterator[tuple[str, str, int, int, int, bytes, str]]:
        """(topic, schema, seq, log time, publish time, payload, schema's text)"""
        if op == 0x03:
            i, s = schema_of(r)
            self.schemas[i] = s
        elif op == 0x04:
            i, c = channel_of(r)
            self.channels[i] = c
        elif op == 0x05:
            i, _, log, pub = struct.unpack_from("<HIQQ", r)
            topic, schema, _ = self.channels.get(i, ("?", 0, {}))
            name, text = self.schemas.get(schema, ("", ""))
            yield topic, name, at, log, pub or log, r[22:], text
        elif op == 0x06:
            size = struct.unpack_from("<Q", r, 16)[0]
            how, k = recordings._text(r, 28)
            n = struct.unpack_from("<Q", r, k)[0]
            for j, (inner, x) in enumerate(recordings.mcap_records(recordings._unpacked(r[k + 8 : k + 8 + n], how, size))):
                yield from self.of(at + j, inner, x)  # a chunk has more bytes than records


@dataclass
class Part(InputPartition):
    path: str
    chunks: tuple[tuple[int, int], ...] | None = None  # offsets and lengths; None: the whole file
    start: int = 0
    end: int | None = None
    channels: dict | None = None
    until: int | None = None
    after: int | None = None

    def __post_init__(self) -> None:
        self.value = None


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.topics: set[str] | None = None
        self.low, self.high = None, None  # of log time, included

    def pushFilters(self, filters):  # noqa: N802
        """Topics and log times go to the scan; the rest is for Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column == "topic" and isinstance(f, EqualTo | In):
                these = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.topics = these if self.topics is None else self.topics & these
            elif column == "log_time_ns" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    x = f.value + isinstance(f, GreaterThan)
                    self.low = x if self.low is None else max(self.low, x)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    x = f.value - isinstance(f, LessThan)
                    self.high = x if self.high is None else min(self.high, x)
            else:
                yield f

    def wanted(self, topic: str, log: int) -> bool:
        return (self.topics is None or topic in self.topics) and (self.low is None or log >= self.low) and (self.high is None or log <= self.high)

    def partitions(self) -> list[Part]:
        each, out = int(self.options.get("chunkBytes", 64 << 20)), []
        what = self.options.get("what", "messages")
        for path in resolved(self.options["path"]):
            try:
                index = summary(path) if kind_of(path) == "mcap" and what == "messages" else None
            except (ValueError, OSError, struct.error):
                index = None
            if index is None or not index.chunks:
                out.append(Part(path))
                continue
            ids = {i for i, c in index.channels.items() if self.topics is None or c[0] in self.topics}
            group, held = [], 0
            for a, b, at, n, has in sorted(index.chunks, key=lambda x: x[2]):
                if (self.low is not None and b < self.low) or (self.high is not None and a > self.high) or (has and not has & ids):
                    continue
                group.append((at, n))
                held += n
                if held >= each:
                    out.append(Part(path, tuple(group)))
                    group, held = [], 0
            if group:
                out.append(Part(path, tuple(group)))
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        what = self.options.get("what", "messages")
        try:
            yield from {"messages": self._messages, "topics": self._topics, "schemas": self._schemas}[what](part)
        except Exception as e:  # any broken file is a row, and stops no other
            said = f"{type(e).__name__}: {e}"
            if what == "messages":
                yield (part.path, None, None, None, None, None, None, None, None, said)
            elif what == "topics":
                yield (part.path, None, None, None, None, None, None, None, None, None, said)

    def _rows(self, part: Part) -> Iterator[tuple[str, str, int, int, int, int, bytes, str]]:
        """(topic, schema, seq, log time, publish time, size, payload, schema's text)"""
        kind = kind_of(part.path)
        if kind == "mcap":
            if part.chunks is not None:
                index = summary(part.path)
                m = Messages(index.channels, index.schemas)
                spans = ((at, at + n) for at, n in part.chunks)
            else:
                with open(part.path, "rb") as f:
                    if f.read(8) != recordings.MAGIC:
                        raise ValueError("not an MCAP file")
                m, spans = Messages(), iter([(8, None)])
            for at, end in spans:
                for offset, op, r in records_from(part.path, at, end):
                    if op == 0x0F:
                        return
                    for topic, schema, seq, log, pub, data, text in m.of(offset, op, r):
                        yield topic, schema, seq, log, pub, len(data), data, text
        elif kind == "db3":
            yield from recordings.db3_rows(part.path, self.topics, self.low)
        else:
            with open(part.path, "rb") as f:
                data = f.read()
            for k, (topic, log, pub, size) in enumerate(recordings.READERS[kind](data)):
                yield topic, "", k, log, pub, size, b"", ""

    def _messages(self, part: Part) -> Iterator[tuple]:
        mission, decode = name_of(part.path), str(self.options.get("decode", "false")).lower() == "true"
        for topic, schema, seq, log, pub, size, data, text in self._rows(part):
            if self.wanted(topic, log):
                yield (part.path, mission, topic, schema, seq, log, pub, size, as_json(schema, text, data) if decode and text else None, None)

    def _topics(self, part: Part) -> Iterator[tuple]:
        """From the summary's statistics, or else from a scan of what can be read."""
        mission, index = name_of(part.path), summary(part.path) if kind_of(part.path) == "mcap" else None
        if index is not None and index.counts:
            for i, (topic, schema, meta) in sorted(index.channels.items()):
                yield (part.path, mission, topic, index.schemas.get(schema, ("", ""))[0], index.counts.get(i, 0), index.start, index.end, meta.get("offered_qos_profiles"), False, False, None)
            return
        seen: dict[str, list] = {}
        for topic, schema, _, log, *_ in self._rows(part):
            x = seen.setdefault(topic, [schema, 0, log, log])
            x[1], x[2], x[3] = x[1] + 1, min(x[2], log), max(x[3], log)
        partial = kind_of(part.path) == "mcap" and index is None
        fresh = partial and time.time() - os.path.getmtime(part.path) < FRESH_S
        for topic, (schema, n, a, b) in sorted(seen.items()):
            yield (part.path, mission, topic, schema, n, a, b, None, partial, fresh, None)

    def _schemas(self, part: Part) -> Iterator[tuple]:
        if kind_of(part.path) != "mcap":
            return
        index = summary(part.path)
        channels, schemas = (index.channels, index.schemas) if index else ({}, {})
        if index is None:
            m = Messages()
            for offset, op, r in records_from(part.path, 8):
                for _ in m.of(offset, op, r):
                    pass
            channels, schemas = m.channels, m.schemas
        for topic, schema, _ in channels.values():
            if schema in schemas:
                yield (part.path, topic, *schemas[schema])


class RecordingStream(DataSourceStreamReader):
    """Follows MCAP files; the offset of each is after its last whole record and holds the topics of its channels."""

    def __init__(self, options: dict) -> None:
        self.options, self.speed = options, float(options.get("speed", 0))
        self.began: float | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        limit = None
        if self.speed > 0:
            self.began = self.began or time.time()
            limit = int((time.time() - self.began) * self.speed * 1e9)
        for path in resolved(self.options["path"]):
            if kind_of(path) != "mcap":
                continue
            at, first = 8, None
            for offset, op, r in records_from(path, 8):
                if op == 0x0F:
                    break
                when = struct.unpack_from("<Q", r, 6)[0] if op == 0x05 else struct.unpack_from("<Q", r)[0] if op == 0x06 else None
                if limit is not None and when is not None:
                    first = when if first is None else first
                    if when - first > limit:
                        break
                at = offset + 9 + len(r)
            out[path] = at
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(path, start=int(start.get(path, 8)), end=int(at)) for path, at in sorted(end.items()) if int(at) > int(start.get(path, 8))]

    def read(self, part: Part) -> Iterator[tuple]:
        mission, m = os.path.basename(part.path), Messages()  # the ends of a growing file do not name it yet
        decode = str(self.options.get("decode", "false")).lower() == "true"
        for offset, op, r in records_from(part.path, 8, part.end):
            if offset < part.start:
                if op in (0x03, 0x04):  # channels that came before
                    for _ in m.of(offset, op, r):
                        pass
                elif op == 0x06:
                    for inner, x in recordings.mcap_records(recordings.unpacked_chunk(r)):
                        if inner in (0x03, 0x04):
                            for _ in m.of(offset, inner, x):
                                pass
                continue
            for topic, schema, seq, log, pub, data, text in m.of(offset, op, r):
                yield (part.path, mission, topic, schema, seq, log, pub, len(data), as_json(schema, text, data) if decode and text else None, None)

    def commit(self, end: dict) -> None:
        """Offsets are Spark's to keep."""


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return {"messages": MESSAGES, "topics": TOPICS, "schemas": SCHEMAS}[self.options.get("what", "messages")]

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(dict(self.options))

    def streamReader(self, schema) -> RecordingStream:  # noqa: N802
        return RecordingStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)
