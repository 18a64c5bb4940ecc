"""Recordings in four container formats as tables of arrivals and metadata.

Files are read by Spark's binary source, so any store that Spark reaches will do, and parsed one by one on the
executors. A file that fails gives a row with its error and stops nothing else.
"""

from __future__ import annotations

import hashlib
import sqlite3
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Arrival = tuple[str, int, int, int]  # topic, log time, publish time, size
MAGIC = b"\x89MCAP0\r\n"
ULOG = b"ULog\x01\x12\x35"
BAG = b"#ROSBAG V2.0\n"


class Torn(ValueError):
    """The data end within a record; what was read before stands."""


def _text(b: memoryview | bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", b, at)[0]
    return bytes(b[at + 4 : at + 4 + n]).decode(), at + 4 + n


def _unpacked(data: bytes, kind: str, size: int) -> bytes:
    if not kind or kind == "none":
        return data
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if kind == "bz2":
        import bz2

        return bz2.decompress(data)
    return pa.input_stream(pa.py_buffer(data), compression="lz4").read()


def mcap_records(b: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(opcode, content) of records one after another; raises Torn at an incomplete one."""
    while at < len(b):
        if b[at : at + 8] == MAGIC:
            at += 8
            continue
        if at + 9 > len(b):
            raise Torn(at)
        op, n = b[at], struct.unpack_from("<Q", b, at + 1)[0]
        if at + 9 + n > len(b):
            raise Torn(at)
        yield op, b[at + 9 : at + 9 + n]
        at += 9 + n


def mcap(b: bytes) -> Iterator[Arrival]:
    if b[:8] != MAGIC:
        raise ValueError("not an MCAP file")
    topics: dict[int, str] = {}

    def each(records: Iterator[tuple[int, bytes]]) -> Iterator[Arrival]:
        for op, r in records:
            if op == 0x04:
                topics[struct.unpack_from("<H", r)[0]] = _text(r, 4)[0]
            elif op == 0x05:
                channel, _, log, pub = struct.unpack_from("<HIQQ", r)
                yield topics.get(channel, "?"), log, pub or log, len(r) - 22
            elif op == 0x06:
                size = struct.unpack_from("<Q", r, 16)[0]
                kind, at = _text(r, 28)
                n = struct.unpack_from("<Q", r, at)[0]
                yield from each(mcap_records(_unpacked(r[at + 8 : at + 8 + n], kind, size)))
            elif op == 0x0F:
                return

    yield from each(mcap_records(b))


def unpacked_chunk(r: bytes) -> bytes:
    """The records within a chunk's content."""
    size = struct.unpack_from("<Q", r, 16)[0]
    kind, at = _text(r, 28)
    n = struct.unpack_from("<Q", r, at)[0]
    return _unpacked(r[at + 8 : at + 8 + n], kind, size)


def write_mcap(rows: list[Arrival], chunk: int = 0, indexed: bool = False, schemas: dict[str, tuple[str, str]] | None = None, payloads: list[bytes] | None = None, qos: dict[str, str] | None = None) -> bytes:
    """An MCAP file of empty payloads of the given sizes, or of payloads; chunks of so many messages, zstd, or none.

    schemas are (name, text) by topic, qos the text of delivery settings. indexed adds the summary: schemas, channels, chunk index and statistics.
    """
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    record = lambda op, r: struct.pack("<BQ", op, len(r)) + r
    pairs = lambda kind, d: struct.pack("<I", len(d) * struct.calcsize("<" + kind)) + b"".join(struct.pack("<" + kind, *x) for x in d.items())
    settings = lambda t: text("offered_qos_profiles") + text(qos[t]) if qos and t in qos else b""
    strings = lambda t: struct.pack("<I", len(settings(t))) + settings(t)
    ids = {t: i + 1 for i, t in enumerate(dict.fromkeys(r[0] for r in rows))}
    of = {t: i + 1 for i, t in enumerate(schemas or {})}
    known = [record(0x03, struct.pack("<H", of[t]) + text(name) + text("ros2msg") + text(body)) for t, (name, body) in (schemas or {}).items()]
    known += [record(0x04, struct.pack("<HH", i, of.get(t, 0)) + text(t) + text("cdr" if t in of else "") + strings(t)) for t, i in ids.items()]
    out = [MAGIC, record(0x01, text("") + text("tidemark")), *known]
    body = payloads or [bytes(r[3]) for r in rows]
    messages = [record(0x05, struct.pack("<HIQQ", ids[t], k, log, pub) + x) for k, ((t, log, pub, _), x) in enumerate(zip(rows, body, strict=True))]
    at, index = sum(map(len, out)), []
    if chunk:
        import zstandard

        for a in range(0, len(messages), chunk):
            raw, some = b"".join(messages[a : a + chunk]), rows[a : a + chunk]
            packed = zstandard.compress(raw)
            first, last = min(r[1] for r in some), max(r[1] for r in some)
            out.append(record(0x06, struct.pack("<QQQI", first, last, len(raw), 0) + text("zstd") + struct.pack("<Q", len(packed)) + packed))
            where = {ids[t]: 0 for t in dict.fromkeys(r[0] for r in some)}
            index.append(record(0x08, struct.pack("<QQQQ", first, last, at, len(out[-1])) + pairs("HQ", where) + struct.pack("<Q", 0) + text("zstd") + struct.pack("<QQ", len(packed), len(raw))))
            at += len(out[-1])
    else:
        out += messages
    out.append(record(0x0F, struct.pack("<I", 0)))
    begin = sum(map(len, out)) if indexed else 0
    if indexed:
        n: dict[int, int] = {}
        for r in rows:
            n[ids[r[0]]] = n.get(ids[r[0]], 0) + 1
        times = [r[1] for r in rows] or [0]
        out += [*known, *index, record(0x0B, struct.pack("<QHIIIIQQ", len(rows), len(of), len(ids), 0, 0, len(index), min(times), max(times)) + pairs("HQ", n))]
    return b"".join([*out, record(0x02, struct.pack("<QQI", begin, 0, 0)), MAGIC])


def db3(b: bytes) -> Iterator[Arrival]:
    con = sqlite3.connect(":memory:")
    con.deserialize(b)
    for topic, t, size in con.execute("SELECT name, timestamp, length(data) FROM messages JOIN topics ON topics.id = topic_id ORDER BY timestamp, messages.id"):
        yield topic, t, t, size


def db3_rows(path: str, topics: set[str] | None = None, low: int | None = None) -> Iterator[tuple[str, str, int, int, int, int, bytes, str]]:
    """Messages of a file on disk in order of time; SQLite filters by topic and time."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    where, args = ["timestamp >= ?"], [low if low is not None else -(1 << 62)]
    if topics is not None:
        where.append(f"name IN ({', '.join('?' * len(topics))})")
        args += sorted(topics)
    sql = f"SELECT name, type, messages.id, timestamp, length(data) FROM messages JOIN topics ON topics.id = topic_id WHERE {' AND '.join(where)} ORDER BY timestamp, messages.id"
    for topic, kind, k, t, size in con.execute(sql, args):
        yield topic, kind or "", k, t, t, size, b"", ""


def write_db3(rows: list[Arrival]) -> bytes:
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE topics(id INTEGER PRIMARY KEY, name TEXT, type TEXT, serialization_format TEXT, offered_qos_profiles TEXT)")
    con.execute("CREATE TABLE messages(id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
    ids = {t: i + 1 for i, t in enumerate(dict.fromkeys(r[0] for r in rows))}
    con.executemany("INSERT INTO topics VALUES (?, ?, '', 'cdr', '')", [(i, t) for t, i in ids.items()])
    con.executemany("INSERT INTO messages(topic_id, timestamp, data) VALUES (?, ?, ?)", [(ids[t], log, bytes(n)) for t, log, _, n in rows])
    con.commit()
    return con.serialize()


def ulg(b: bytes) -> Iterator[Arrival]:
    """Datasets as topics; microseconds; a time of 0 is unset and left out; sorted by time."""
    if b[:7] != ULOG:
        raise ValueError("not a ULog file")
    fields: dict[str, int] = {}
    names: dict[int, tuple[str, str]] = {}
    out: list[Arrival] = []
    at = 16
    while at + 3 <= len(b):
        n, kind = struct.unpack_from("<HB", b, at)
        r = b[at + 3 : at + 3 + n]
        if len(r) < n:
            break
        if kind == ord("F"):
            name, _, spec = r.decode().partition(":")
            fields[name] = len([f for f in spec.split(";") if f])
        elif kind == ord("A"):
            multi, i = struct.unpack_from("<BH", r)
            name = r[3:].decode()
            names[i] = (f"/{name}" + (f"_{multi}" if multi else ""), name)
        elif kind == ord("D"):
            i = struct.unpack_from("<H", r)[0]
            t = struct.unpack_from("<Q", r, 2)[0]
            if t and i in names:
                topic, name = names[i]
                out.append((topic, t * 1000, t * 1000, 8 * max(1, fields.get(name, 2) - 1)))
        at += 3 + n
    yield from sorted(out, key=lambda x: x[1])


def write_ulg(rows: list[Arrival]) -> bytes:
    message = lambda kind, r: struct.pack("<HB", len(r), ord(kind)) + r
    names = list(dict.fromkeys(r[0].lstrip("/") for r in rows))
    out = [ULOG + b"\x01" + struct.pack("<Q", 0)]
    out += [message("F", f"{n}:uint64_t timestamp;float value;".encode()) for n in names]
    out += [message("A", struct.pack("<BH", 0, i) + n.encode()) for i, n in enumerate(names)]
    out += [message("D", struct.pack("<HQf", names.index(t.lstrip("/")), log // 1000, 0.0)) for t, log, _, _ in rows]
    return b"".join(out)


def bag(b: bytes) -> Iterator[Arrival]:
    if b[: len(BAG)] != BAG:
        raise ValueError("not a bag of version 2.0")
    topics: dict[int, str] = {}

    def records(b: bytes, at: int) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
        while at + 4 <= len(b):
            n = struct.unpack_from("<I", b, at)[0]
            head, fields, i = b[at + 4 : at + 4 + n], {}, 0
            while i + 4 <= len(head):
                k = struct.unpack_from("<I", head, i)[0]
                name, _, value = head[i + 4 : i + 4 + k].partition(b"=")
                fields[name] = value
                i += 4 + k
            at += 4 + n
            if at + 4 > len(b):
                return
            n = struct.unpack_from("<I", b, at)[0]
            if at + 4 + n > len(b):
                return
            yield fields, b[at + 4 : at + 4 + n]
            at += 4 + n

    def each(b: bytes, at: int) -> Iterator[Arrival]:
        for f, data in records(b, at):
            op = f.get(b"op", b"\0")[0]
            if op == 0x07:
                topics[struct.unpack("<I", f[b"conn"])[0]] = f[b"topic"].decode()
            elif op == 0x05:
                yield from each(_unpacked(data, f[b"compression"].decode(), struct.unpack("<I", f[b"size"])[0]), 0)
            elif op == 0x02:
                sec, nsec = struct.unpack("<II", f[b"time"])
                t = sec * 1_000_000_000 + nsec
                yield topics.get(struct.unpack("<I", f[b"conn"])[0], "?"), t, t, len(data)

    yield from each(b, len(BAG))


def write_bag(rows: list[Arrival], chunk: int = 500) -> bytes:
    """A ROS 1 bag of empty payloads of the given sizes, in plain chunks of so many messages."""
    def record(fields: dict[str, bytes], data: bytes) -> bytes:
        head = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in fields.items())
        return struct.pack("<I", len(head)) + head + struct.pack("<I", len(data)) + data

    ids = {t: i for i, t in enumerate(dict.fromkeys(r[0] for r in rows))}
    out = [BAG, record({"op": b"\x03", "index_pos": bytes(8), "conn_count": struct.pack("<I", len(ids)), "chunk_count": bytes(4)}, b" ")]
    for at in range(0, len(rows), chunk):
        inner = [record({"op": b"\x07", "conn": struct.pack("<I", i), "topic": t.encode()}, b"") for t, i in ids.items()] if not at else []
        inner += [record({"op": b"\x02", "conn": struct.pack("<I", ids[t]), "time": struct.pack("<II", *divmod(log, 1_000_000_000))}, bytes(size)) for t, log, _, size in rows[at : at + chunk]]
        raw = b"".join(inner)
        out.append(record({"op": b"\x05", "compression": b"none", "size": struct.pack("<I", len(raw))}, raw))
    return b"".join(out)


READERS: dict[str, Callable[[bytes], Iterator[Arrival]]] = {"mcap": mcap, "db3": db3, "ulg": ulg, "bag": bag}


def mission_of(size: int, head: bytes, tail: bytes) -> str:
    h = hashlib.blake2b(str(size).encode(), digest_size=12)
    h.update(head)
    h.update(tail)
    return h.hexdigest()


def mission_id(b: bytes) -> str:
    """Of the size, the first MiB, and the last one of files over two."""
    return mission_of(len(b), b[: 1 << 20], b[-(1 << 20) :] if len(b) > 2 << 20 else b"")


def claimed(b: bytes) -> int | None:
    """How many messages the summary of an MCAP file speaks of, if it has one."""
    if b[-8:] != MAGIC or len(b) < 45 or not (at := struct.unpack_from("<Q", b, len(b) - 28)[0]):
        return None
    for op, r in mcap_records(b[:-8], at):
        if op == 0x0B:
            return struct.unpack_from("<Q", r)[0]
    return None


def integrity(b: bytes, kind: str) -> dict[str, object]:
    """Readable, summary present, messages read and claimed, bytes after the last whole record, issues, score from 0 to 100.

    Points go for a missing summary, a torn end, messages that are claimed and don't decode, and each issue; a file
    without messages that can be read has none.
    """
    n, torn, readable, summary, says, issues = 0, 0, True, True, None, []
    try:
        if kind == "mcap":
            ends_well = b[-8:] == MAGIC and len(b) > 45
            summary = ends_well and struct.unpack_from("<Q", b, len(b) - 28)[0] != 0
            if not ends_well:
                at = 8
                while at + 9 <= len(b) and at + 9 + struct.unpack_from("<Q", b, at + 1)[0] <= len(b):
                    at += 9 + struct.unpack_from("<Q", b, at + 1)[0]
                torn = len(b) - at
            says = claimed(b) if summary else None
        elif kind == "db3":
            con = sqlite3.connect(":memory:")
            con.deserialize(b)
            if (said := con.execute("PRAGMA quick_check").fetchone()) and said[0] != "ok":
                issues.append(f"sqlite: {said[0]}"[:200])
        for _ in READERS[kind](b):
            n += 1
    except Torn:
        pass
    except Exception as e:  # whatever a broken file raises is its state
        issues.append(f"{type(e).__name__}: {e}"[:200])
        readable = n > 0
    lost = (says - n) / says if says and n < says else 0.0
    if lost:
        issues.append(f"{says} messages claimed, {n} decode")
    truncated = torn > 4096
    if truncated:
        issues.append("records end mid-stream")
    readable = readable and (n > 0 or summary)
    share = 100.0 * torn / max(1, len(b))
    score = max(0.0, 100.0 - (0 if summary else 15) - (min(35.0, 10 + share) if truncated else 0) - 80 * lost - min(20, 6 * len(issues)))
    return {"readable": readable, "summary": summary, "messages": n, "claimed": says, "torn_bytes": torn, "truncated": truncated, "corrupt_share": lost, "issues": issues, "file_score": score if readable else 0.0}


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, kind) of recordings anywhere under root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{mcap,db3,bag,ulg}").load(root)
    return found.select("path", "length", F.lower(F.element_at(F.split("path", r"\."), -1)).alias("kind"))


def _parsed(spark: SparkSession, root: str | list[str], run, schema: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{mcap,db3,bag,ulg}").load(root)
    return found.select("path", F.lower(F.element_at(F.split("path", r"\."), -1)).alias("kind"), "content").mapInArrow(run, schema)


def read_arrivals(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """(path, mission_id, topic, seq, log_time_ns, publish_time_ns, size_bytes) of all recordings, whole records only."""
    schema = pa.schema([("path", pa.string()), ("mission_id", pa.string()), ("topic", pa.string()), *[(c, pa.int64()) for c in ("seq", "log_time_ns", "publish_time_ns", "size_bytes")]])

    def run(batches):
        for b in batches:
            for path, kind, content in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                rows: list[tuple] = []
                name = mission_id(content)
                try:
                    for k, (topic, log, pub, size) in enumerate(READERS[kind](content)):
                        rows.append((path, name, topic, k, log, pub, size))
                        if len(rows) >= 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                except Exception:  # a torn or broken file ends here; read_metadata() tells
                    pass
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _parsed(spark, root, run, "path string, mission_id string, topic string, seq long, log_time_ns long, publish_time_ns long, size_bytes long")


def read_integrity(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """(path, mission_id) and integrity() of all recordings."""
    schema = pa.schema([("path", pa.string()), ("mission_id", pa.string()), ("readable", pa.bool_()), ("summary", pa.bool_()), ("messages", pa.int64()), ("claimed", pa.int64()), ("torn_bytes", pa.int64()), ("truncated", pa.bool_()), ("corrupt_share", pa.float64()), ("issues", pa.list_(pa.string())), ("file_score", pa.float64())])

    def run(batches):
        for b in batches:
            for path, kind, content in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                found = integrity(content, kind)
                found |= {"path": path, "mission_id": mission_id(content)}
                yield pa.RecordBatch.from_arrays([pa.array([found[f.name]], f.type) for f in schema], schema=schema)

    return _parsed(spark, root, run, "path string, mission_id string, readable boolean, summary boolean, messages long, claimed long, torn_bytes long, truncated boolean, corrupt_share double, issues array<string>, file_score double")


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(path, mission_id, topic, n, start_ns, end_ns, bytes) per topic."""
    return read_arrivals(spark, root).groupBy("path", "mission_id", "topic").agg(F.count("*").alias("n"), F.min("log_time_ns").alias("start_ns"), F.max("log_time_ns").alias("end_ns"), F.sum("size_bytes").alias("bytes"))


def timed(arrivals: DataFrame) -> DataFrame:
    """Arrivals of files in the form that detectors take; us keeps microseconds, pub_us those of publishing."""
    from tidemark.sources.events import relative

    return relative(arrivals.withColumn("us", F.floor(F.col("log_time_ns") / 1000)).withColumn("pub_us", F.floor(F.col("publish_time_ns") / 1000)))


def synthetic(topics: dict[str, float], seconds: float, seed: int = 42, cv: float = 0.02, start_ns: int = 1_780_000_000_000_000_000) -> list[Arrival]:
    """Arrivals of topics at given rates: lognormal spacings of that coefficient of variation."""
    rng, out = np.random.default_rng(seed), []
    sigma = np.sqrt(np.log1p(cv * cv))
    for topic, hz in topics.items():
        n = int(seconds * hz * 1.2) + 10
        dt = np.maximum(rng.lognormal(-np.log(hz) - sigma * sigma / 2, sigma, n), 0.02 / hz)
        t = rng.random() / hz + np.cumsum(dt)
        out += [(topic, start_ns + int(x * 1e9), start_ns + int(x * 1e9), 100) for x in t[t < seconds]]
    return sorted(out, key=lambda r: (r[1], r[0]))


def generated(spark: SparkSession, n: int, missions: int, hz: list[float], silence_s: float = 12.0) -> DataFrame:
    """About n arrivals (mission_id, topic, seq, us, t) of recordings whose topics have these rates, made where they run.

    Spacings vary by a tenth; all topics but the last are silent once, at three fifths of their arrivals.
    """
    each = n // (missions * len(hz))
    i, k = F.col("id") % each, F.floor(F.col("id") / each) % len(hz)
    late = F.when((i > 0.6 * each) & (k < len(hz) - 1), silence_s).otherwise(0.0)
    noise = (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0 - 0.5) * 0.1
    t = (i + noise + 1) / F.element_at(F.array(*map(F.lit, hz)), (k + 1).cast("int")) + late
    rows = spark.range(each * missions * len(hz)).select(F.format_string("m%04d", F.floor(F.col("id") / (each * len(hz)))).alias("mission_id"), F.format_string("/t%d", k).alias("topic"), F.col("id").alias("seq"), (t * 1e6).cast("long").alias("us"))
    return rows.withColumn("t", F.col("us") / F.lit(1e6))
