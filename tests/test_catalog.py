"""From files to catalog tables, reports and manifests."""

import json

import pytest

from tidemark import catalog
from tidemark.operators.gate import Policy
from tidemark.sources import recordings


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("fleet")
    for robot in ("r1", "r2"):
        (root / robot).mkdir()
    topics = {"/imu": 50.0, "/odom": 20.0, "/scan": 10.0}
    clean = recordings.synthetic(topics, 60.0, 5)
    start = clean[0][1]
    (root / "r1" / "clean.mcap").write_bytes(recordings.write_mcap(clean, 200, True))
    stalled = [r for r in recordings.synthetic(topics, 60.0, 6) if not 30 < (r[1] - start) / 1e9 < 37]
    (root / "r1" / "stall.mcap").write_bytes(recordings.write_mcap(stalled, 200, True))
    gap = [r for r in recordings.synthetic(topics, 60.0, 7) if not (r[0] == "/scan" and 20 < (r[1] - start) / 1e9 < 28)]
    (root / "r2" / "gap.db3").write_bytes(recordings.write_db3(gap))
    (root / "r2" / "bad.mcap").write_bytes(b"nothing at all")
    return root


def test_index_fills_the_tables_and_goes_on(spark, folder, tmp_path):
    at = str(tmp_path / "catalog")
    m = recordings.mission_id((folder / "r1" / "clean.mcap").read_bytes())
    lines = spark.createDataFrame([(m, "INFO", float(k), k, f"imu0 took {k} ms at '/dev/x{k}'") for k in range(9)], "mission_id string, level string, t double, id long, msg string")
    samples = spark.createDataFrame([(m, "/imu:z", float(k), 9.81) for k in range(5)] + [(m, "/odom:x", 0.0, 1.0)], "mission_id string, signal_key string, t double, v double")
    errors = catalog.index(spark, str(folder), at, signals=samples, lines=lines).collect()
    assert [(r.template, r.n) for r in catalog.read(spark, at, "log_patterns").collect()] == [("imu0 took <num> ms at <str>", 9)]
    assert [(r.signal_key, r.n) for r in catalog.read(spark, at, "signals").collect()] == [("/imu:z", 5)]
    assert catalog.read_signal(spark, f"{at}/samples", m, "/imu:z").count() == 5
    assert [r.path.rsplit("/", 1)[1] for r in errors] == ["bad.mcap"]
    missions = {r.path.rsplit("/", 1)[1]: r for r in catalog.read(spark, at, "missions").collect()}
    assert set(missions) == {"clean.mcap", "stall.mcap", "gap.db3"} and missions["gap.db3"].robot_id == "r2"
    assert missions["clean.mcap"].verdict == "healthy" and missions["stall.mcap"].score < missions["clean.mcap"].score
    kinds = {(r.path.rsplit("/", 1)[1], r.kind, r.topic) for r in catalog.query(spark, at, "SELECT path, kind, topic FROM events JOIN missions USING (mission_id) WHERE severity >= :least", least=2).collect()}
    assert ("stall.mcap", "stall", None) in kinds and ("gap.db3", "gap", "/scan") in kinds and not any(k[0] == "clean.mcap" for k in kinds)
    assert catalog.read(spark, at, "topics").count() == 9
    s = catalog.status(spark, at, str(folder)).first()
    assert (s.found, s.indexed, s.waiting) == (4, 3, 1)
    before = {r.mission_id: r.indexed_at for r in catalog.read(spark, at, "missions").collect()}
    more = recordings.synthetic({"/imu": 50.0}, 60.0, 9)
    (folder / "r2" / "more.bag").write_bytes(recordings.write_bag(more))
    catalog.index(spark, str(folder), at)
    after = {r.mission_id: r.indexed_at for r in catalog.read(spark, at, "missions").collect()}
    assert len(after) == 4 and all(after[m] == t for m, t in before.items())
    (folder / "r2" / "more.bag").unlink()
    one = missions["gap.db3"]
    assert catalog.mission_at(spark, at, one.path).count() == 1 and catalog.versions(spark, at).where("index_version = 2").count() == 4
    assert [r.tag for r in catalog.tag(spark, at, one.mission_id, ["night", "rain"]).orderBy("tag").collect()] == ["night", "rain"]
    assert [r.tag for r in catalog.tag(spark, at, one.mission_id, [], ["rain"]).collect()] == ["night"]
    assert catalog.tag(spark, at, one.mission_id, [], ["night"]).count() == 0


def test_audit_of_a_file(spark, folder):
    found = catalog.audit(spark, str(folder / "r1" / "stall.mcap"), roots=[str(folder)])
    stall = found["findings"].where("detector = 'stall'").collect()
    assert len(stall) == 1 and stall[0].rolled_up == 3 and 6.5 < stall[0].t_end - stall[0].t_start < 7.5
    assert found["findings"].where("detector = 'gap'").count() == 0
    text = catalog.markdown(found, found["recordings"].first().mission_id)
    assert "stall" in text and "tells of the recorder" in text and "| /imu |" in text
    assert catalog.explained(found, "stall").first().next_step == catalog.NEXT_STEPS["stall"]
    only = catalog.audit(spark, str(folder / "r2" / "gap.db3"), topics=["/s*"])
    assert [r.topic for r in only["topics"].collect()] == ["/scan"]
    with pytest.raises(PermissionError):
        catalog.audit(spark, str(folder), roots=["/nowhere"])


def test_delivery_settings(spark, tmp_path):
    rows = recordings.synthetic({"/imu": 50.0, "/odom": 30.0, "/scan": 10.0}, 30.0, 5)
    text = "- history: keep_last\n  depth: 3\n  reliability: {}\n  durability: volatile\n  deadline: {{sec: {}, nsec: 0}}\n"
    (tmp_path / "q.mcap").write_bytes(recordings.write_mcap(rows, 100, True, qos={"/imu": text.format("best_effort", 0), "/odom": text.format("reliable", 5)}))
    found = catalog.audit(spark, str(tmp_path / "q.mcap"))
    got = {r.topic: r.issues for r in catalog.qos_report(spark, str(tmp_path / "q.mcap"), found).collect()}
    assert got == {"/imu": ["best_effort", "shallow_queue"], "/odom": ["shallow_queue", "deadline_mismatch"], "/scan": ["no_settings"]}


def test_tables_trimming_and_command_line(spark, folder, capsys):
    from tidemark.__main__ import main
    from tidemark.sources import sinks

    spark.sql("CREATE DATABASE IF NOT EXISTS fleet_test")
    sinks.create_catalog(spark, "fleet_test")
    sinks.create_catalog(spark, "fleet_test")
    assert {t.name for t in spark.catalog.listTables("fleet_test")} >= set(sinks.CATALOG)
    spark.sql("DROP DATABASE fleet_test CASCADE")
    a = recordings.timed(recordings.read_arrivals(spark, str(folder / "r1" / "clean.mcap")))
    some = sinks.trimmed(a, 10.0, 20.0, ["/odom"])
    assert some.agg({"t": "min"}).first()[0] >= 10 and some.select("topic").distinct().count() == 1 and 190 < some.count() < 210
    assert main(["gate", str(folder / "r1")]) == 1
    assert '"accept"' in capsys.readouterr().out


def test_gate_of_a_folder(spark, folder, tmp_path):
    out = catalog.gate_folder(spark, str(folder), Policy(topics=("/scan",)), str(tmp_path / "m.json"))
    assert out == json.loads((tmp_path / "m.json").read_text())
    assert out["exit"] == 1 and out["reasons"]["unreadable"] == 1 and out["reasons"]["recorder_stall"] == 1
    assert [p.rsplit("/", 1)[1] for p in out["train_on"]][:1] == ["clean.mcap"]


def test_clock_events_count_once_for_all_topics(spark):
    from tidemark.operators import clock

    rows = []
    for k in range(200):
        for i, topic in enumerate(("/a", "/b")):
            us = k * 100_000 + i * 1000
            rows.append(("m", topic, 2 * k + i, us, us / 1e6, us - (2_000_000 if us > 10_000_000 else 0)))
    f = spark.createDataFrame(rows, "mission_id string, topic string, seq long, us long, t double, pub_us long")
    got = clock.events(clock.with_clock(f)).collect()
    assert sorted(r.kind for r in got) == ["backward", "step"]
    r = clock.report(clock.with_clock(f)).first()
    assert (r.backward, r.steps, r.lagging) == (1, 1, False) and r.peak_lag == r.growth == 0  # the step is no lag
