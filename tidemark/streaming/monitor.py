"""Live monitoring of streams of arrivals: gaps per topic and alerts per recording, with state that survives restarts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.config import ROBOT, Config
from tidemark.folds import AlertFold, MissionFold, TopicFold

STATE = "version int, fold binary"
VERSION = 1


def _restored(state: GroupState, make):
    if not state.exists:
        return make()
    version, data = state.get
    if version != VERSION:
        raise ValueError(f"state of version {version}")
    return pickle.loads(data)


def gaps_of(arrivals: DataFrame, config: Config = ROBOT) -> DataFrame:
    """(mission_id, topic, t_start, t_end, period, n) of a stream (mission_id, topic, us, seq, t), as each gap ends.

    Order is trusted within a batch after sorting; an arrival before the last one counts but moves nothing.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = _restored(state, lambda: TopicFold(config))
        rows = pd.concat(list(parts)).sort_values(["us", "seq"])
        found = [tuple(g) for t in rows.t.tolist() if (g := fold.push(t)) is not None]
        state.update((VERSION, pickle.dumps(fold)))
        yield pd.DataFrame([(*key, a, b, p, fold.n) for a, b, p, _ in found], columns=["mission_id", "topic", "t_start", "t_end", "period", "n"])

    out = "mission_id string, topic string, t_start double, t_end double, period double, n long"
    return arrivals.select("mission_id", "topic", "us", "seq", "t").groupBy("mission_id", "topic").applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.NoTimeout)


SNAPSHOT = "mission_id string, n long, t double, topics int, gaps int, longest_gap_s double, stalled_s double, evicted long, alert string"


def snapshots_of(arrivals: DataFrame, every: int = 0, config: Config = ROBOT) -> DataFrame:
    """Snapshots of recordings with alerts, of a stream (mission_id, topic, us, seq, t).

    One at the end of each batch, or after every so many arrivals of a recording. A snapshot is worked out on a copy of
    the state; stalled_s never falls, and alert is raise, critical, clear or null.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold, alerts, most = _restored(state, lambda: (MissionFold(config), AlertFold(), 0.0))
        rows, out = pd.concat(list(parts)).sort_values(["us", "seq"]), []

        def look() -> None:
            nonlocal most
            s = fold.snapshot()
            most = s["stalled_s"] = max(most, s["stalled_s"])
            out.append({"mission_id": key[0], **s, "alert": alerts.update(s["t"], most)})

        for topic, t in zip(rows.topic.tolist(), rows.t.tolist(), strict=True):
            fold.push(topic, t)
            if every and fold.n % every == 0:
                look()
        if not every:
            look()
        state.update((VERSION, pickle.dumps((fold, alerts, most))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SNAPSHOT.split(", ")])

    return arrivals.select("mission_id", "topic", "us", "seq", "t").groupBy("mission_id").applyInPandasWithState(run, SNAPSHOT, STATE, "append", GroupStateTimeout.NoTimeout)


class Pressure(StreamingQueryListener):
    """How a stream keeps up: rows taken, batches in which more came than were dealt with, and the worst ratio of the two."""

    def __init__(self) -> None:
        self.rows, self.batches, self.behind, self.worst = 0, 0, 0, 0.0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        """Nothing to count yet."""

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches += 1
        self.rows += p.numInputRows
        if p.processedRowsPerSecond and p.inputRowsPerSecond > p.processedRowsPerSecond:
            self.behind += 1
            self.worst = max(self.worst, p.inputRowsPerSecond / p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        """An idle stream is not behind."""

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        """What was counted stays."""


def alerts_of(snapshots: DataFrame) -> DataFrame:
    """(mission_id, t, alert) of a stream of snapshots (mission_id, t, stalled_s)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = _restored(state, AlertFold)
        rows = pd.concat(list(parts)).sort_values("t")
        found = [(key[0], t, a) for t, s in zip(rows.t.tolist(), rows.stalled_s.tolist(), strict=True) if (a := fold.update(t, s)) is not None]
        state.update((VERSION, pickle.dumps(fold)))
        yield pd.DataFrame(found, columns=["mission_id", "t", "alert"])

    return snapshots.groupBy("mission_id").applyInPandasWithState(run, "mission_id string, t double, alert string", STATE, "append", GroupStateTimeout.NoTimeout)


def counts(arrivals: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, topic, n) of a stream with ts; rows later than allowed are left out."""
    return arrivals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "topic").agg(F.count("*").alias("n"))
