"""The recording data source: pushed filters, torn files, decoded payloads, metadata, and streams over growing files."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import datasource, decode, recordings

ODOM = """std_msgs/Header header
string child_frame_id
geometry_msgs/Point position
float64[3] extra
float32[] ranges
uint8[] data
int32 LIMIT=5
bool ok
================================================================================
MSG: std_msgs/Header
builtin_interfaces/Time stamp
string frame_id
================================================================================
MSG: geometry_msgs/Point
float64 x
float64 y
"""


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    datasource.register(spark)
    at = tmp_path_factory.mktemp("recordings")
    rows = recordings.synthetic({"/imu": 100.0, "/odom": 20.0}, 20.0, 3)
    values = [{"header": {"stamp": {"sec": k, "nanosec": 7}, "frame_id": "map"}, "child_frame_id": "b" * (k % 5), "position": {"x": 0.5 * k, "y": -1.0}, "extra": [1.0, 2.0, 3.0], "ranges": [float(i) for i in range(k % 4)], "data": [1, 2, 3], "ok": True} for k in range(len(rows))]
    name = "nav_msgs/msg/Odometry"
    payloads = [decode.encoded(name, ODOM, v) if r[0] == "/odom" else b"xy" for r, v in zip(rows, values, strict=True)]
    whole = recordings.write_mcap(rows, 100, True, {"/odom": (name, ODOM)}, payloads)
    (at / "a.mcap").write_bytes(whole)
    plain = recordings.write_mcap(rows)
    (at / "torn.mcap").write_bytes(plain[: len(plain) // 2])
    (at / "bad.mcap").write_bytes(b"nothing at all")
    for kind, write in (("db3", recordings.write_db3), ("bag", recordings.write_bag), ("ulg", recordings.write_ulg)):
        (at / f"x.{kind}").write_bytes(write(rows))
    return at, rows, values


def of(spark, path, **options):
    return spark.read.format("recording").options(path=str(path), **options).load()


def test_all_formats_and_errors(spark, folder):
    at, rows, _ = folder
    got = {r.path.rsplit("/", 1)[1]: r for r in of(spark, at).groupBy("path").agg(F.count("topic").alias("n"), F.countDistinct("seq").alias("seqs"), F.max("error").alias("error")).collect()}
    for name in ("a.mcap", "x.db3", "x.bag", "x.ulg"):
        assert (got[name].n, got[name].seqs, got[name].error) == (len(rows), len(rows), None)
    assert 0 < got["torn.mcap"].n < len(rows) and got["torn.mcap"].error is None
    assert got["bad.mcap"].n == 0 and "not an MCAP file" in got["bad.mcap"].error
    a = of(spark, at / "a.mcap").orderBy("seq").select("topic", "log_time_ns").collect()
    assert [tuple(r) for r in a] == [(t, x) for t, x, _, _ in rows]


def test_filters_leave_chunks_out(spark, folder):
    at, rows, _ = folder
    low, high = rows[300][1], rows[700][1]
    df = of(spark, at / "a.mcap", chunkBytes="1").where((F.col("topic") == "/odom") & F.col("log_time_ns").between(low, high))
    want = [r for r in rows if r[0] == "/odom" and low <= r[1] <= high]
    assert df.count() == len(want) > 10
    reader = datasource.RecordingReader({"path": str(at / "a.mcap"), "chunkBytes": 1})
    assert len(reader.partitions()) == -(-len(rows) // 100)
    reader.low, reader.high = low, high
    assert len(reader.partitions()) <= 6
    reader.topics = {"/none"}
    assert reader.partitions() == []
    assert of(spark, at / "x.db3").where("topic = '/odom'").count() == sum(r[0] == "/odom" for r in rows)


def test_payloads_decode(spark, folder):
    at, rows, values = folder
    got = of(spark, at / "a.mcap", decode="true").where("topic = '/odom'").orderBy("seq").collect()
    own = [v for r, v in zip(rows, values, strict=True) if r[0] == "/odom"]
    first = json.loads(got[7].payload)
    assert first == {**own[7], "data": "<3 bytes>"} and got[7].schema == "nav_msgs/msg/Odometry"
    x = of(spark, at / "a.mcap", decode="true").where("topic = '/odom'").select(F.get_json_object("payload", "$.position.x").cast("double").alias("v"))
    assert x.agg(F.sum("v")).first()[0] == pytest.approx(sum(v["position"]["x"] for v in own))
    assert decode.as_json("a/B", "float64 x", b"\0\1\0\0\0") is None
    assert decode.plain({"a": {"b": {"c": 1}}, "l": list(range(9)), "n": float("nan")}, 2, 3) == {"a": {"b": "<deeper>"}, "l": [0, 1, 2, "<6 more>"], "n": None}
    schema = of(spark, at / "a.mcap", what="schemas").collect()
    assert [(r.topic, r.text) for r in schema] == [("/odom", ODOM)]


def test_inspection(spark, folder):
    from tidemark import inspect

    at, rows, values = folder
    path = str(at / "a.mcap")
    own = [v for r, v in zip(rows, values, strict=True) if r[0] == "/odom"]
    assert [r.topic for r in inspect.list_topics(spark, path, hide=["/im*"]).collect()] == ["/odom"]
    assert inspect.topic_schema(spark, path, "/odom").first().text == ODOM
    some = inspect.sample_messages(spark, path, "/odom", 5).orderBy("position").collect()
    assert len(some) == 5 and json.loads(some[0].payload)["position"] == own[0]["position"] and json.loads(some[-1].payload)["position"] == own[-1]["position"]
    one = inspect.get_message_at(spark, path, "/odom", 10.0).collect()
    assert len(one) == 1 and abs(one[0].t - 10) < 0.1 and inspect.get_message_at(spark, path, "/odom", 99.0).count() == 0
    s = inspect.field_stats(spark, path, "/odom", "extra[1]").first()
    assert (s.n, s.min, s.max) == (len(own), 2.0, 2.0)
    with pytest.raises(PermissionError):
        inspect.field_stats(spark, path, "/odom", "position.x", secret=["position"])


def test_integrity_counts_what_is_claimed(folder, tmp_path):
    at, rows, _ = folder
    whole = (at / "a.mcap").read_bytes()
    ok = recordings.integrity(whole, "mcap")
    assert (ok["claimed"], ok["messages"], ok["file_score"], ok["issues"]) == (len(rows), len(rows), 100.0, [])
    middle = len(whole) // 2
    broken = recordings.integrity(whole[:middle] + bytes(64) + whole[middle + 64 :], "mcap")
    assert broken["readable"] and 0 < broken["messages"] < len(rows) and broken["corrupt_share"] > 0.2 and broken["file_score"] < 80 and broken["issues"]
    db = recordings.write_db3(rows)
    assert recordings.integrity(db, "db3")["file_score"] == 100.0
    assert recordings.integrity(b"nothing", "db3")["file_score"] == 0.0


def test_metadata_from_the_summary(spark, folder):
    at, rows, _ = folder
    got = {(r.path.rsplit("/", 1)[1], r.topic): r for r in of(spark, at, what="topics").collect()}
    n = sum(r[0] == "/imu" for r in rows)
    assert got["a.mcap", "/imu"].n == got["x.bag", "/imu"].n == n and not got["a.mcap", "/imu"].partial
    assert got["torn.mcap", "/imu"].partial and got["torn.mcap", "/imu"].in_progress in (True, False) and got["bad.mcap", None].error
    assert got["a.mcap", "/imu"].start_ns == rows[0][1] and got["a.mcap", "/imu"].end_ns == rows[-1][1]


def test_paths(folder, tmp_path):
    at, _, _ = folder
    assert len(datasource.resolved(str(at))) == 6
    with pytest.raises(ValueError, match="no reader"):
        datasource.resolved(str(tmp_path / "x.txt"))
    assert datasource.resolved(str(at / "a.mcap"), [str(at)]) == [str(at / "a.mcap")]
    for path in (str(at / ".." / "other.mcap"), "/etc/passwd"):
        with pytest.raises(PermissionError):
            datasource.resolved(path, [str(at)])


def test_stream_follows_a_growing_file(spark, folder, tmp_path):
    _, rows, _ = folder
    plain = recordings.write_mcap(rows)
    cuts = [len(plain) // 3, 2 * len(plain) // 3 + 5, len(plain)]
    (tmp_path / "in").mkdir()
    seen = []
    for cut in cuts:  # a restart each time; the cuts are within records
        (tmp_path / "in" / "g.mcap").write_bytes(plain[:cut])
        s = spark.readStream.format("recording").option("path", str(tmp_path / "in")).load()
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(spark.read.parquet(str(tmp_path / "out")).count())
    out = spark.read.parquet(str(tmp_path / "out"))
    assert seen[0] < seen[1] < seen[2] == len(rows) == out.select("seq").distinct().count()
    assert out.where("topic = '?'").count() == 0


def test_replay_keeps_pace(folder):
    at, rows, _ = folder
    r = datasource.RecordingStream({"path": str(at / "torn.mcap"), "speed": "1e-9"})
    paced = r.latestOffset()
    whole = datasource.RecordingStream({"path": str(at / "torn.mcap")}).latestOffset()
    assert list(paced.values())[0] < list(whole.values())[0]
    fast = datasource.RecordingStream({"path": str(at / "torn.mcap"), "speed": "1e12"})
    fast.began = 0.0
    assert fast.latestOffset() == whole
