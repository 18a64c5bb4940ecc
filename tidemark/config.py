"""Thresholds of the detectors, with a preset for robot recordings and one for the slow streams of the events table."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    # fixed values: published defaults
    warm_messages: int = 50
    warm_seconds: float = 10.0
    bins: int = 64
    lo: float = 0.001
    hi: float = 10.0
    ring: int = 50
    refine: float = 0.25
    aperiodic_ratio: float = 5.0
    gap_k: float = 5.0
    gap_floor: float = 0.25
    merge_periods: float = 2.0
    gap_cap: int = 1000
    jitter_window: int = 200
    jitter_mult: float = 2.0
    jitter_floor: float = 0.35
    jitter_sustain: float = 5.0
    jitter_least: int = 50
    ewma: float = 0.02
    bucket: float = 10.0
    bucket_keep: int = 30
    bucket_least: int = 8
    drift: float = 0.15
    step: float = 0.5
    lag_growth: float = 0.1
    overlap: float = 0.5
    system_wide: float = 0.7
    isolated: float = 0.2
    stall_slack: float = 0.5
    stall_fraction: float = 0.5
    columns: int = 120
    column_s: float = 0.5


ROBOT = Config()
SENSITIVITY = {"low": {"gap_k": 7.0, "jitter_mult": 3.0, "jitter_floor": 0.5, "drift": 0.25}, "medium": {}, "high": {"gap_k": 3.5, "jitter_mult": 1.5, "jitter_floor": 0.22, "drift": 0.08}}
EVENTS = replace(ROBOT, warm_seconds=600.0, lo=1.0, hi=100_000.0, gap_floor=60.0, bucket=3600.0, jitter_sustain=600.0, jitter_mult=1.02, jitter_floor=0.2, step=0.05)
EDGE = replace(ROBOT, bins=32, ring=16, jitter_window=48, bucket_keep=12, gap_cap=16)


def with_sensitivity(config: Config, level: str) -> Config:
    return replace(config, **SENSITIVITY[level])
