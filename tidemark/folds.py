"""The detectors that depend on order, as folds over arrivals. Streams use them, and tests hold the windows against them."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np

from tidemark.config import ROBOT, Config
from tidemark.operators.series import all_cuts as all_cuts  # noqa: PLC0414  one place for kernels


@dataclass
class TopicFold:
    """Cadence and gaps of one topic; push() takes seconds in order."""

    config: Config = ROBOT
    n: int = 0
    first: float | None = None
    last: float | None = None
    bins: dict[int, int] = field(default_factory=dict)
    ring: list[float] = field(default_factory=list)
    positive: int = 0
    period: float | None = None
    period_cv: float = 0.0
    gaps: list[list[float]] = field(default_factory=list)  # start, end, period, silent
    evicted: int = 0  # gaps that the cap has let go

    def _mode(self) -> float:
        c = self.config
        best = min(self.bins, key=lambda b: (-self.bins[b], b))
        scale = c.bins / (math.log(c.hi) - math.log(c.lo))
        return math.exp(math.log(c.lo) + (best + 0.5) / scale)

    def _warm(self) -> None:
        mode = self._mode()
        wide = [d for d in self.ring if 0.5 * mode <= d <= 1.5 * mode]
        seen = float(np.median(wide)) if wide else mode
        near = [d for d in self.ring if abs(d - seen) < self.config.refine * seen]
        self.period = float(np.median(near)) if near else seen
        self.period_cv = float(np.std(near, ddof=1) / np.mean(near)) if len(near) > 2 else 0.02

    def provisional(self) -> float | None:
        if self.period is not None:
            return self.period
        if self.positive >= 5:
            return self._mode()
        return float(np.median(self.ring)) if self.ring else None

    def push(self, t: float) -> list[float] | None:
        """The gap that this arrival ends, or has merged into, if any."""
        c, dt = self.config, None if self.last is None else t - self.last
        self.n += 1
        self.first = t if self.first is None else self.first
        self.last = t
        if dt is None or dt <= 0:
            return None
        scale = c.bins / (math.log(c.hi) - math.log(c.lo))
        b = min(c.bins - 1, math.floor((math.log(min(max(dt, c.lo), c.hi)) - math.log(c.lo)) * scale))
        self.bins[b] = self.bins.get(b, 0) + 1
        self.positive += 1
        self.ring = [*self.ring, dt][-c.ring :]
        if self.period is None and self.n >= c.warm_messages and t - self.first >= c.warm_seconds:
            self._warm()
        p = self.provisional()
        if p is None or dt <= max(c.gap_k * p, c.gap_floor):
            return None
        if self.gaps and t - dt - self.gaps[-1][1] <= c.merge_periods * p:
            self.gaps[-1][1] = t
            self.gaps[-1][3] += dt
        else:
            self.gaps.append([t - dt, t, p, dt])
        last = self.gaps[-1]
        if len(self.gaps) > c.gap_cap:  # the longest stay
            self.gaps.remove(min(self.gaps, key=lambda g: g[1] - g[0]))
            self.evicted += 1
        return last

    def nominal(self) -> float:
        """The spacing to expect: learned, else the mean so far, else 0."""
        return self.period or ((self.last - self.first) / (self.n - 1) if self.n > 1 and self.last > self.first else 0.0)

    def blind(self) -> bool:
        """Whether there is no usable rate yet."""
        if self.period is None or self.n < 2 or self.last <= self.first:
            return True
        return 1 / self.period > self.config.aperiodic_ratio * self.n / (self.last - self.first)


@dataclass
class MissionFold:
    """All topics of a recording in order: gaps, and what of them are stalls, judged as each silence ends."""

    config: Config = ROBOT
    expected: int = 0  # topics that the recording declares; 0 if it can't tell
    topics: dict[str, TopicFold] = field(default_factory=dict)
    silences: dict[str, list[tuple[float, float]]] = field(default_factory=dict)  # of the last minute
    stalls: list[list[float]] = field(default_factory=list)  # disjoint, in order
    n: int = 0
    end: float = 0.0

    def push(self, topic: str, t: float) -> float | None:
        """The share of topics that were silent with the silence that this arrival ends, if it ends one."""
        fold = self.topics.setdefault(topic, TopicFold(self.config))
        self.n, self.end = self.n + 1, max(self.end, t)
        gap = fold.push(t)
        if gap is None or fold.blind():
            return None
        own = [x for x in self.silences.get(topic, []) if x[1] >= t - 60 and x[0] != gap[0]]
        self.silences[topic] = [*own, (gap[0], gap[1])]
        share = self._share(topic, gap[0], gap[1])
        if share > self.config.system_wide:
            self._stall(gap[0], gap[1])
        return share

    def _share(self, topic: str, start: float, end: float) -> float:
        there = {k: f for k, f in self.topics.items() if k != topic and f.first <= start}
        due = {k: f for k, f in there.items() if not f.blind() and 0 < f.nominal() < end - start}
        if not due:
            return 0.0
        need = self.config.overlap * (end - start)
        silent = sum(f.last <= start or sum(max(0.0, min(end, b) - max(start, a)) for a, b in self.silences.get(k, ())) >= need for k, f in due.items())
        return silent / max(len(due), (self.expected - 1) * len(due) / len(there))

    def _stall(self, start: float, end: float) -> None:
        out: list[list[float]] = []
        for a, b in sorted([*self.stalls, [start, end]]):
            if out and a <= out[-1][1] + self.config.stall_slack:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        self.stalls = out

    def stalled(self) -> float:
        """Seconds in stalls, without those that are too long for one; what is sent on from here never falls."""
        return sum(b - a for a, b in self.stalls if b - a <= self.config.stall_fraction * max(self.end, 1e-9))

    def snapshot(self) -> dict[str, object]:
        """The state as if the recording ended here, worked out on a copy: silences that last still count as gaps."""
        twin = pickle.loads(pickle.dumps(self))
        for f in twin.topics.values():
            p = f.provisional()
            if p and self.end - f.last > max(self.config.gap_k * p, self.config.gap_floor):
                f.gaps.append([f.last, self.end, p, self.end - f.last])
        gaps = [g for f in twin.topics.values() for g in f.gaps]
        return {"n": self.n, "t": self.end, "topics": len(twin.topics), "gaps": len(gaps), "longest_gap_s": max((g[1] - g[0] for g in gaps), default=0.0), "stalled_s": self.stalled(), "evicted": sum(f.evicted for f in twin.topics.values())}


@dataclass
class ClockFold:
    """Steps and backward jumps of a recording's two clocks, deduplicated over topics in publish time, and the lag."""

    least: float = 0.5
    alpha: float = 0.01
    seen: dict[str, tuple[float, float]] = field(default_factory=dict)
    offset: float = 0.0
    last_step: float = -math.inf
    last_back: float = -math.inf
    steps: list[tuple[float, float]] = field(default_factory=list)
    backward: int = 0
    largest: float = 0.0
    lag: float | None = None
    first_lag: float | None = None
    peak: float = 0.0

    def push(self, topic: str, t: float, pub: float) -> None:
        if topic in self.seen:
            t0, p0 = self.seen[topic]
            if pub < p0:
                self.largest = max(self.largest, p0 - pub)
                if pub - self.last_back > 1:
                    self.backward += 1
                    self.last_back = pub
            d = (t - t0) - (pub - p0)
            if abs(d) > self.least and pub - self.last_step >= 1:
                self.steps.append((t, d))
                self.offset += d
                self.last_step = pub
        self.seen[topic] = (t, pub)
        d = t - pub - self.offset
        self.lag = d if self.lag is None else self.lag + self.alpha * (d - self.lag)
        self.first_lag = self.lag if self.first_lag is None else self.first_lag
        self.peak = max(self.peak, abs(d))


@dataclass
class TrendFold:
    """Drift of a topic's rate: an average of spacings read in buckets, tested over the last ones."""

    config: Config = ROBOT
    mean: float | None = None
    open: float | None = None
    hz: list[tuple[float, float]] = field(default_factory=list)
    episodes: list[list[float]] = field(default_factory=list)  # start, end, peak
    active: bool = False

    def push(self, t: float, dt: float, period: float | None) -> None:
        c = self.config
        if period is not None and dt > 5 * period:
            return
        self.mean = dt if self.mean is None else self.mean + c.ewma * (dt - self.mean)
        if self.open is None:
            self.open = t
            return
        while t >= self.open + c.bucket:
            self.open += c.bucket
            self.hz = [*self.hz, (self.open, 1 / self.mean)][-c.bucket_keep :]
            self._test(period)

    def _test(self, period: float | None) -> None:
        if len(self.hz) < self.config.bucket_least:
            return
        x, y = np.array(self.hz).T
        i, j = np.triu_indices(len(x), 1)
        slope = float(np.median((y[j] - y[i]) / (x[j] - x[i])))
        s = np.sign(y[j] - y[i])
        tau = float(s.sum() / max(1.0, np.abs(s).sum()))
        n = len(x)
        z = abs(tau) / math.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1)))
        rel = slope * (x[-1] - x[0]) * (period if period else 1 / y.mean())
        if abs(rel) > self.config.drift and z > 1.959963984540054:
            if self.active:
                e = self.episodes[-1]
                e[1], e[2] = float(x[-1]), max(e[2], rel, key=abs)
            else:
                self.episodes.append([float(x[0]), float(x[-1]), rel])
                self.active = True
        else:
            self.active = False


@dataclass
class AlertFold:
    """Raises and clears an alert as the seconds covered by stalls grow."""

    # fixed values: published defaults
    floor: float = 0.5
    dwell: float = 5.0
    urgent: float = 5.0
    interval: float = 60.0
    clear_after: float = 30.0
    critical: float = 0.05
    seconds: float = 0.0
    since: float | None = None
    grown: float = -math.inf
    sent: float = -math.inf
    raised: bool = False
    base: float = 0.0

    def update(self, t: float, stalled: float) -> str | None:
        """'raise', 'critical' or 'clear' at stream time t, given the stalled seconds so far."""
        if stalled > self.seconds:
            self.since = t if self.since is None else self.since
            self.grown = t
        self.seconds = max(self.seconds, stalled)
        new = self.seconds - self.base
        ripe = self.since is not None and (t - self.since >= self.dwell or new >= self.urgent)
        if new >= self.floor and ripe and t - self.sent >= self.interval:
            self.sent, self.base, self.raised, self.since = t, self.seconds, True, None
            return "critical" if t > 0 and self.seconds / t >= self.critical else "raise"
        if self.raised and t - self.grown >= self.clear_after:
            self.raised, self.since = False, None
            return "clear"
        return None
