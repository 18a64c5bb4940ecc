"""Windows against sequential folds on generated recordings, batch against stream, and files there and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import folds
from tidemark.config import ROBOT
from tidemark.operators import cadence, gaps, series
from tidemark.sources import recordings
from tidemark.sources.events import KEYS


def recording(seed=1, hz=20.0):
    rows = recordings.synthetic({"/a": hz, "/b": 5.0}, 60.0, seed, cv=0.1)
    start = rows[0][1]
    return [r for r in rows if not (r[0] == "/a" and 30 < (r[1] - start) / 1e9 < 36)]


def frame(spark, rows):
    out = spark.createDataFrame([("m", t, k, log // 1000) for k, (t, log, _, _) in enumerate(rows)], "mission_id string, topic string, seq long, us long")
    from tidemark.sources.events import relative

    return relative(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_equal_the_fold(spark, seed):
    rows = recording(seed)
    found = gaps.gaps(gaps.candidates(cadence.timed(frame(spark, rows), ROBOT)[0], ROBOT), ROBOT)
    got = {(r.topic, round(r.t_start, 5), round(r.t_end, 5)) for r in found.collect()}
    want = set()
    t0 = rows[0][1] // 1000
    for topic in ("/a", "/b"):
        f = folds.TopicFold(ROBOT)
        for t, log, _, _ in rows:
            if t == topic:
                f.push((log // 1000 - t0) / 1e6)
        want |= {(topic, round(g[0], 5), round(g[1], 5)) for g in f.gaps}
    assert got == want and any(e - s > 5 for _, s, e in got)


def test_stream_equals_fold(spark, tmp_path):
    rows = recording(3)
    arrivals = frame(spark, rows).select(*KEYS, "us", "seq", "t")
    arrivals.where("t < 33").coalesce(1).write.parquet(str(tmp_path / "in"))
    arrivals.where("t >= 33").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from tidemark.streaming import monitor

    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = monitor.gaps_of(stream).writeStream.format("memory").queryName("gaps_seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    long = spark.sql("select * from gaps_seen where t_end - t_start > 5").collect()
    assert [r.topic for r in long] == ["/a"]


def test_files_there_and_back(spark, tmp_path):
    rows = recording(4)
    for name, data in {"a.mcap": recordings.write_mcap(rows), "b.mcap": recordings.write_mcap(rows, 100), "c.db3": recordings.write_db3(rows), "d.ulg": recordings.write_ulg(rows)}.items():
        (tmp_path / name).write_bytes(data)
    whole = recordings.write_mcap(rows)
    (tmp_path / "torn.mcap").write_bytes(whole[: len(whole) * 6 // 10])
    (tmp_path / "bad.mcap").write_bytes(b"nothing")
    n = {r["path"].rsplit("/", 1)[1]: r["n"] for r in recordings.read_arrivals(spark, str(tmp_path)).groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert n["a.mcap"] == n["b.mcap"] == n["c.db3"] == n["d.ulg"] == len(rows)
    assert 0 < n["torn.mcap"] < len(rows) and "bad.mcap" not in n
    state = {r.path.rsplit("/", 1)[1]: r for r in recordings.read_integrity(spark, str(tmp_path)).collect()}
    assert not state["bad.mcap"].readable and state["bad.mcap"].file_score == 0
    assert state["torn.mcap"].torn_bytes > 0 == state["a.mcap"].torn_bytes and state["torn.mcap"].messages < state["a.mcap"].messages
    assert recordings.files(spark, str(tmp_path)).count() == 6


def test_kernels():
    v = np.concatenate([np.zeros(40), np.ones(40) * 5])
    assert series.all_cuts(v, 20, 1) == [40]
    assert series.dtw(v, v) == 0
    z = series.rolling_mad(np.concatenate([np.arange(200) % 7.0, [99.0], np.arange(200) % 7.0]), 101)
    assert int(np.argmax(z)) == 200


def test_alerts_clock_and_trend():
    a = folds.AlertFold()
    seen = [(t, x) for t in range(0, 200) if (x := a.update(float(t), min(t, 20) * 0.5 if t > 5 else 0.0))]
    assert seen[0][1] in ("raise", "critical") and seen[-1][1] == "clear"
    c = folds.ClockFold()
    for k in range(100):
        c.push("/a", k * 0.1 + (2.0 if k > 50 else 0.0), k * 0.1)
    assert len(c.steps) == 1 and abs(c.steps[0][1] - 2.0) < 1e-6 and c.backward == 0
    f = folds.TrendFold(ROBOT)
    t = 0.0
    for k in range(4000):
        dt = 0.02 + 0.00001 * k
        t += dt
        f.push(t, dt, 0.02)
    assert f.episodes


def stalled_rows():
    rows = recordings.synthetic({"/a": 20.0, "/b": 10.0, "/c": 50.0}, 60.0, 8)
    start = rows[0][1]
    return [r for r in rows if not 30 < (r[1] - start) / 1e9 < 37]


def test_snapshots_leave_the_state_alone():
    rows = stalled_rows()
    fold, seen = folds.MissionFold(ROBOT), []
    plain = folds.MissionFold(ROBOT)
    for topic, log, _, _ in rows:
        t = (log - rows[0][1]) / 1e9
        fold.push(topic, t)
        plain.push(topic, t)
        if fold.n % 50 == 0:
            seen.append(fold.snapshot())
    assert fold.snapshot() == plain.snapshot() and fold.topics == plain.topics
    assert 6.5 < seen[-1]["stalled_s"] < 7.5 and len(fold.stalls) == 1
    assert [s["stalled_s"] for s in seen] == sorted(s["stalled_s"] for s in seen)


def test_stalls_equal_the_batch(spark):
    from tidemark.plans.detect import audited

    rows = stalled_rows()
    fold = folds.MissionFold(ROBOT, 3)
    t0 = rows[0][1] // 1000
    for topic, log, _, _ in rows:
        fold.push(topic, (log // 1000 - t0) / 1e6)
    got = [(round(r.t_start, 5), round(r.t_end, 5)) for r in audited(frame(spark, rows), None, ROBOT)["stalls"].collect()]
    assert got == [(round(a, 5), round(b, 5)) for a, b in fold.stalls]


def test_stream_restarts_with_its_state(spark, tmp_path):
    from tidemark.streaming import monitor

    rows = stalled_rows()
    arrivals = frame(spark, rows).select(*KEYS, "us", "seq", "t")
    pressure = monitor.Pressure()
    spark.streams.addListener(pressure)
    for k, part in enumerate(("t < 20", "t >= 20 and t < 45", "t >= 45")):
        arrivals.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(arrivals.schema).parquet(str(tmp_path / "in"))
        q = monitor.snapshots_of(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == k + 1
    spark.streams.removeListener(pressure)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()
    whole = folds.MissionFold(ROBOT)
    t0 = rows[0][1] // 1000
    for topic, log, _, _ in rows:
        whole.push(topic, (log // 1000 - t0) / 1e6)
    assert got[-1].n == len(rows) and abs(got[-1].stalled_s - whole.stalled()) < 1e-6 and got[1].alert in ("raise", "critical") and pressure.rows in (0, len(rows))


def test_state_of_another_version_is_refused():
    from tidemark.streaming import monitor

    class State:
        exists, get = True, (monitor.VERSION + 1, b"")

    with pytest.raises(ValueError, match="version"):
        monitor._restored(State(), dict)


def test_drift_equals_the_fold(spark):
    from tidemark.operators import degradation

    rng = np.random.default_rng(3)
    t, rows = 0.0, []
    for k in range(6000):
        t += (0.02 + 0.00001 * max(0, k - 1500)) * (1 + 0.02 * rng.normal())
        rows.append(("m", "/a", k, int(t * 1e6)))
    f = spark.createDataFrame(rows, "mission_id string, topic string, seq long, us long").withColumn("t", F.col("us") / 1e6)
    timed, periods = cadence.timed(f, ROBOT)
    got = degradation.degradation(timed, f.groupBy("mission_id").agg(F.max("t").alias("t_end")), ROBOT).collect()
    assert len(got) == 1 and got[0].slope < -0.15 and got[0].hz_end < got[0].hz_start
    mean, want, period = None, [], periods.first().period
    t0, edge, last = None, None, None
    for r in rows:  # the rule, one arrival after another
        x = r[3] / 1e6
        dt, last = (None, x) if last is None else (x - last, x)
        if dt is None:
            continue
        mean = dt if mean is None else mean + ROBOT.ewma * (dt - mean)
        if edge is None:
            t0, edge = x, x + ROBOT.bucket
            continue
        while x >= edge:
            want.append(1 / mean)
            edge += ROBOT.bucket
    buckets = [r.hz for r in degradation.rate_buckets(timed, ROBOT).orderBy("k").collect()]
    assert np.allclose(buckets, want, rtol=1e-9) and period > 0 and t0 is not None


def test_change_points_against_force(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(m, 1, 60) for m in (0, 5, 1)])
    d = spark.createDataFrame([("k", i, i, float(x)) for i, x in enumerate(v)], "key string, us long, seq long, v double")
    got = [(r.cut, r.mean_before, r.mean_after) for r in series.changepoints(d, ["key"], 20, 2).orderBy("cut").collect()]

    def sse(x):
        return ((x - x.mean()) ** 2).sum()

    first = min(range(20, 161), key=lambda i: sse(v[:i]) + sse(v[i:]))
    second = min((sse(v[a:i]) + sse(v[i:b]) - sse(v[a:b]), i) for a, b in ((0, first), (first, 180)) if b - a >= 40 for i in range(a + 20, b - 19))[1]
    cuts = sorted([first, second])
    assert [g[0] for g in got] == cuts and got[0][1] == pytest.approx(v[: cuts[0]].mean()) and got[1][2] == pytest.approx(v[cuts[1] :].mean())


def test_similar_recordings(spark):
    from tidemark.operators import fleet

    f = spark.createDataFrame([(i, float(i % 4), float(i), ["a", "b"], ["x"]) for i in range(20)], "id int, f1 double, f2 double, topics array<string>, templates array<string>")
    s = spark.createDataFrame([(i, k, float(np.sin(k / 5 + (i % 5)))) for i in range(20) for k in range(60)], "id int, i int, v double")
    got = fleet.most_similar(f, "id", ["f1", "f2"], "topics", "templates", 0, s, 3).collect()
    assert [r.id for r in got] == [5, 10] + [got[2].id] and got[0].distance == got[1].distance == 0 and "same topics" in got[0].why


def test_results():
    from tidemark.functions import fitted, next_page, page_start, spaced, tokens

    assert page_start(next_page(10, 5, 100)) == 15 and next_page(10, 5, 15) is None
    assert spaced(5, 3) == [0, 2, 4] and tokens("x" * 36) == 11
    assert fitted({"a": "x" * 40000}, [lambda r: r | {"a": "x"}, lambda r: r])["truncated"]


def test_reports_and_pictures():
    from tidemark.functions import results
    from tidemark.operators import frames, qos

    page = results.plot_html({"a<b": [(0.0, 1.0), (1.0, None), (2.0, 3.0)]}, "x & y")
    assert page.count("M") == 2 and "a&lt;b" in page and "x &amp; y" in page
    assert len(results.layout([f"/t{k}" for k in range(9)], 4.0)["panels"]) == 6
    text = results.report({"mission_id": "m", "verdict": "healthy", "score": 99, "confidence": 1.0}, [], [{"topic": "/a", "status": "assessed", "n": 3, "score": 100}])
    assert text.startswith("# m: healthy") and "None." in text and "| /a | assessed | 3 | 100 |" in text
    image = frames.raw_image(bytes(range(12)), 2, 2, "bgr8")
    assert image.shape == (2, 2, 3) and image[0, 0].tolist() == [2, 1, 0] and frames.raw_image(bytes(8), 2, 2, "mono16").dtype == np.uint16
    assert frames.contact_sheet([image] * 5, 4).shape == (4, 8, 3)
    text = "- history: keep_last\n  depth: 5\n  reliability: best_effort\n  durability: volatile\n  deadline: {sec: 0, nsec: 10000000}\n"
    assert qos.parsed(text) == {"history": "keep_last", "depth": 5, "reliability": "best_effort", "durability": "volatile", "deadline_s": 0.01}
    assert qos.parsed(None)["deadline_s"] is None
