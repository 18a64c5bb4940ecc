"""From recordings to catalog tables, reports and decisions: indexing, lookups, tags, audits of a file, gates of a folder."""

from __future__ import annotations

import fnmatch
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import ROBOT, Config
from tidemark.functions.results import report
from tidemark.operators import clock, fleet, gate, logs, qos
from tidemark.operators.findings import caveats, findings, related
from tidemark.plans.detect import audited
from tidemark.sources import recordings
from tidemark.sources.datasource import register, resolved
from tidemark.sources.sinks import CATALOG, cache_signals, read_signal, replace_missions  # noqa: F401  read_signal is part of the catalog
from tidemark.sources.tables import kept

#: Of rows that indexing writes; rows of another version are written again.
VERSION = 2
#: Broken files that indexing tells of.
ERRORS = 20
# fixed values: what to look at next, by detector
NEXT_STEPS = {
    "gap": "Compare with other topics of that time; a gap of one topic is its sensor, node or network.",
    "rate_degradation": "Look at load, temperature and queues from the drift's beginning on.",
    "jitter": "Look at scheduling and at what else ran when the spacing widened.",
    "dropped": "Check queue depth and reliability settings, then the recorder's lag.",
    "stall": "Check the recorder's disk and processor; no single topic explains it.",
    "subsystem": "Check the bus or driver that these topics share.",
    "implausible_stalls": "Most topics depend on events; take the recorder as not judged.",
    "unassessable": "Record this topic longer, or judge it by events instead of a rate.",
}


def rows_of(found: dict[str, DataFrame], places: DataFrame, c: Config = ROBOT) -> dict[str, DataFrame]:
    """Rows of the tables missions, topics and events; places(mission_id, path, robot_id, start_time, size_bytes)."""
    missions = found["recordings"].join(places, "mission_id", "left").select("mission_id", "path", "robot_id", "start_time", F.col("t_end").alias("duration_s"), "size_bytes", F.col("messages").cast("long").alias("messages"), "verdict", F.round("score", 1).alias("score"), F.lit(VERSION).alias("index_version"), F.current_timestamp().cast("timestamp_ntz").alias("indexed_at"))
    topics = found["topics"].select("mission_id", "topic", "n", F.col("observed_hz").alias("hz"), "score")
    events = findings(found, c).select("mission_id", F.col("detector").alias("kind"), "topic", F.col("t_start").alias("t"), "severity", F.to_json(F.struct("t_end", "value", "rolled_up")).alias("detail"))
    return {"missions": missions, "topics": topics, "events": events}


def write(rows: dict[str, DataFrame], folder: str) -> None:
    """Replaces the rows of the missions that each table's rows have; the others stay."""
    for name, df in rows.items():
        replace_missions(df, f"{folder}/{name}")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the catalog; empty where nothing is written yet."""
    schema = spark.createDataFrame([], CATALOG[name][0]).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def query(spark: SparkSession, folder: str, sql: str, **values) -> DataFrame:
    """A statement over the tables of the catalog; :names in it stand for values."""
    for name in CATALOG:
        read(spark, folder, name).createOrReplaceTempView(name)
    return spark.sql(sql, args=values)


def mission_at(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """The mission of a path, if it is indexed."""
    return read(spark, folder, "missions").where(F.col("path") == path)


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """(mission_id, index_version) of all missions."""
    return read(spark, folder, "missions").select("mission_id", "index_version")


def status(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """(found, indexed, waiting): recordings under root, and those of them that the catalog has at this version."""
    found = recordings.files(spark, root).select("path")
    done = read(spark, folder, "missions").where(F.col("index_version") == VERSION).select("path").distinct()
    return found.join(done.withColumn("done", F.lit(1)), "path", "left").agg(F.count("*").alias("found"), F.count("done").alias("indexed"), F.sum(F.col("done").isNull().cast("long")).alias("waiting"))


def tag(spark: SparkSession, folder: str, mission_id: str, add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """Adds tags to a mission and takes others away; returns its tags."""
    now = F.current_timestamp().cast("timestamp_ntz")
    mine = read(spark, folder, "tags").where(F.col("mission_id") == mission_id)
    new = spark.createDataFrame([(mission_id, t) for t in add], "mission_id string, tag string").withColumn("created_at", now)
    left = kept(fleet.upserted(mine, new, ["mission_id", "tag"], "created_at").where(~F.col("tag").isin(list(remove) or [""])))
    if left.isEmpty():
        none = {c: F.lit(None).cast(k) for c, k in left.dtypes if c != "mission_id"}
        left = spark.range(1).select(F.lit(mission_id).alias("mission_id"), *[x.alias(c) for c, x in none.items()])  # empties the mission's folder
    replace_missions(left, f"{folder}/tags")
    return read(spark, folder, "tags").where((F.col("mission_id") == mission_id) & F.col("tag").isNotNull())


def _arrivals(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Arrivals of files, kept, and their state; a file's times count from its first message."""
    state = kept(recordings.read_integrity(spark, paths))
    return kept(recordings.timed(recordings.read_arrivals(spark, paths))), state


def index(spark: SparkSession, root: str, folder: str, force: bool = False, signals: DataFrame | None = None, lines: DataFrame | None = None, c: Config = ROBOT) -> DataFrame:
    """Audits the recordings under root that the catalog lacks at this version, or all with force, and writes their rows.

    signals(mission_id, signal_key, t, v) and lines(mission_id, level, t, id, msg) are samples and log lines of them, for
    the signal cache and the log patterns. Returns (path, error) of files that can't be read, some of them; these stop
    no others.
    """
    found = recordings.files(spark, root)
    done = read(spark, folder, "missions").select("path", F.col("index_version").alias("version"))
    todo = found if force else fleet.unindexed(found, done, "path", VERSION)
    paths = [r.path for r in todo.select("path").orderBy("path").toLocalIterator()]
    errors = spark.createDataFrame([], "path string, error string")
    if paths:
        arrivals, state = _arrivals(spark, paths)
        scores = state.select("mission_id", "file_score").groupBy("mission_id").agg(F.min("file_score").alias("file_score"))
        first = arrivals.groupBy("mission_id").agg(F.timestamp_micros(F.min("us")).cast("timestamp_ntz").alias("start_time"))
        places = state.join(todo.select("path", "length"), "path").join(first, "mission_id", "left")
        places = places.groupBy("mission_id").agg(F.min("path").alias("path"), F.min(F.element_at(F.split("path", "/"), -2)).alias("robot_id"), F.min("start_time").alias("start_time"), F.min("length").alias("size_bytes"))
        rows = rows_of(audited(arrivals, scores, c), places, c)
        if signals is not None:
            stats = cache_signals(signals, f"{folder}/samples")
            rows["signals"] = stats.select("mission_id", "signal_key", "n", "mean", "std")
        if lines is not None:
            rows["log_patterns"] = logs.clusters(lines, by=["mission_id"]).select("mission_id", "template", "level", "n")
        write(rows, folder)
        errors = state.where("not readable").select("path", F.lit("no message can be read").alias("error")).orderBy("path").limit(ERRORS)
    return errors


def audit(spark: SparkSession, path: str, topics: list[str] | None = None, roots: list[str] | None = None, c: Config = ROBOT) -> dict[str, DataFrame]:
    """The health of a recording, or of all in a folder: audited() with findings, caveats, clocks and files.

    topics are names, or beginnings that end in *. A path outside of roots is refused.
    """
    arrivals, state = _arrivals(spark, resolved(path, roots))
    if topics:
        names = [r.topic for r in arrivals.select("topic").distinct().toLocalIterator()]
        arrivals = kept(arrivals.where(F.col("topic").isin([n for n in names if any(fnmatch.fnmatchcase(n, t) for t in topics)])))
    found = audited(arrivals, state.select("mission_id", "file_score"), c)
    found["recordings"] = kept(found["recordings"])
    found["findings"] = kept(findings(found, c))
    found["files"] = state
    found["clocks"] = kept(clock.report(clock.with_clock(arrivals), c))
    incomplete = state.select("mission_id", (F.col("truncated") | ~F.col("summary")).alias("incomplete"), "corrupt_share")
    found["caveats"] = kept(caveats(found, found["findings"], found["clocks"], incomplete))
    return found


def markdown(found: dict[str, DataFrame], mission_id: str) -> str:
    """The report of one recording of an audit, with its caveats; a recording has a bounded number of findings and topics."""
    mine = {k: [r.asDict() for r in found[k].where(F.col("mission_id") == mission_id).collect()] for k in ("recordings", "findings", "topics", "caveats")}
    for f in mine["findings"]:
        f["topic"] = f"{f['detector']} {f['topic'] or ''}".strip()
    out = report(mine["recordings"][0], mine["findings"], mine["topics"])
    return out + "\n## Caveats\n\n" + "".join(f"- {r['caveat']}\n" for r in sorted(mine["caveats"], key=lambda r: r["place"]))


def explained(found: dict[str, DataFrame], detector: str) -> DataFrame:
    """Findings of a detector with what overlaps them and what to look at next."""
    all_ = found["findings"]
    return related(all_.where(F.col("detector") == detector), all_).withColumn("next_step", F.lit(NEXT_STEPS[detector]))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(mission_id, topic, reliability, history, depth, durability, deadline_s) of topics; nulls where a file has none."""
    register(spark)
    topics = spark.read.format("recording").options(path=path, what="topics").load().where("error is null").select("mission_id", "topic", "qos")

    def run(batches):
        for b in batches:
            found = [qos.parsed(x) for x in b.qos]
            yield b[["mission_id", "topic"]].assign(**{k: [f[k] for f in found] for k in ("reliability", "history", "depth", "durability", "deadline_s")})

    return topics.mapInPandas(run, "mission_id string, topic string, reliability string, history string, depth int, durability string, deadline_s double")


def qos_report(spark: SparkSession, path: str, found: dict[str, DataFrame]) -> DataFrame:
    """(mission_id, topic, issues): what speaks against each topic's delivery settings at its rate; no_settings without any."""
    health = found["topics"].select("mission_id", "topic", F.coalesce("expected_hz", "observed_hz").alias("hz"), (F.col("dropped") / (F.col("n") + F.col("dropped"))).alias("drop_rate"))
    rows = qos.checked(settings(spark, path).join(health, ["mission_id", "topic"], "left"))
    return rows.select("mission_id", "topic", F.when(F.col("reliability").isNull() & F.col("history").isNull(), F.array(F.lit("no_settings"))).otherwise(F.col("issues")).alias("issues"))


def decided(found: dict[str, DataFrame], policy: gate.Policy) -> DataFrame:
    """Each recording of an audit with the reasons against it as training data and the decision."""
    topics = found["topics"].groupBy("mission_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"), F.max("longest_gap_s").alias("longest_gap_s"), (F.sum("dropped") / F.sum(F.col("n") + F.col("dropped"))).alias("loss"))
    files = found["files"].groupBy("mission_id").agg(F.max("path").alias("path"), F.max(F.col("truncated") | ~F.col("readable")).alias("truncated"), F.max("corrupt_share").alias("corrupt_share"))
    rows = found["recordings"].drop("topics").join(topics, "mission_id").join(found["clocks"], "mission_id").join(files, "mission_id")
    return gate.decided(rows.withColumn("lag_s", F.col("peak_lag")), policy)


def manifest(episodes: DataFrame, policy: gate.Policy, broken: DataFrame | None = None) -> dict:
    """What gates write: the policy, counts, reasons, the recordings to train on, and exit, 1 where any is rejected.

    broken(path) are files that could not be read; they count as rejected.
    """
    counts = {r.decision: {"n": r.n, "seconds": round(r.seconds, 3)} for r in gate.summary(episodes).collect()}
    codes = {r.code: r.n for r in gate.rejections(episodes).collect()}
    n = broken.count() if broken is not None else 0
    if n:
        counts["reject"] = {"n": counts.get("reject", {"n": 0})["n"] + n, "seconds": counts.get("reject", {"seconds": 0.0})["seconds"]}
        codes["unreadable"] = n
    train_on = [r.path for r in episodes.where("decision = 'accept'").select("path").orderBy("path").toLocalIterator()]
    return {"policy": vars(policy) | {"topics": list(policy.topics)}, "summary": counts, "reasons": dict(sorted(codes.items(), key=lambda x: (-x[1], x[0]))), "train_on": train_on, "exit": int("reject" in counts)}


def gate_folder(spark: SparkSession, root: str, policy: gate.Policy | None = None, to: str | None = None) -> dict:
    """Decides on all recordings in a folder; writes the manifest as JSON if asked to."""
    policy = policy or gate.Policy()
    found = audit(spark, root)
    out = manifest(kept(decided(found, policy)), policy, found["files"].where("not readable"))
    if to:
        with open(to, "w") as f:
            json.dump(out, f, indent=1)
    return out
