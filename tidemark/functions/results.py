"""What is done with small results on the driver: token budgets, page tokens, even samples, reports, plots, layouts."""

from __future__ import annotations

import base64
import html
import json
from collections.abc import Callable

PER_TOKEN = 3.6


def tokens(text: str) -> int:
    return int(len(text) / PER_TOKEN) + 1


def fitted(result: dict, ladder: list[Callable[[dict], dict]], most: int = 4000) -> dict:
    """The result after as few reductions as bring it under the budget; marked if any was needed."""
    for step in ladder:
        if tokens(json.dumps(result, default=str)) <= most:
            break
        result = step(result) | {"truncated": True}
    return result


def next_page(offset: int, returned: int, total: int) -> str | None:
    """A token for the rows after those returned."""
    at = offset + returned
    return base64.urlsafe_b64encode(json.dumps({"offset": at}).encode()).decode() if at < total else None


def page_start(token: str | None) -> int:
    return json.loads(base64.urlsafe_b64decode(token))["offset"] if token else 0


def spaced(n: int, k: int) -> list[int]:
    """k evenly spaced positions of n, the first and last among them; halves go to the even one."""
    return list(range(n)) if n <= k else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})


def report(mission: dict, findings: list[dict], topics: list[dict]) -> str:
    """A recording's verdict, findings and topics as Markdown."""
    lines = [f"# {mission['mission_id']}: {mission['verdict']}", "", f"Score {mission['score']}, confidence {mission['confidence']}.", "", "## Findings", ""]
    lines += [f"- {f['topic']} {f['t_start']:.3f}-{f['t_end']:.3f} s, severity {f['severity']}" for f in sorted(findings, key=lambda f: (-f["severity"], f["t_start"]))] or ["None."]
    lines += ["", "| topic | status | messages | score |", "|-|-|-|-|"]
    return "\n".join([*lines, *[f"| {t['topic']} | {t['status']} | {t['n']} | {t['score']} |" for t in topics]]) + "\n"


def plot_html(series: dict[str, list[tuple[float, float | None]]], title: str = "") -> str:
    """Lines of up to eight series as a page with one SVG; empty bins break a line."""
    chosen = dict(list(series.items())[:8])
    points = [p for s in chosen.values() for p in s if p[1] is not None]
    lo_t, hi_t = min((p[0] for p in points), default=0), max((p[0] for p in points), default=1)
    lo_v, hi_v = min((p[1] for p in points), default=0), max((p[1] for p in points), default=1)
    x = lambda t: 900 * (t - lo_t) / ((hi_t - lo_t) or 1)
    y = lambda v: 300 - 300 * (v - lo_v) / ((hi_v - lo_v) or 1)
    paths = []
    for name, s in chosen.items():
        d, pen = [], "M"
        for t, v in s:
            if v is None:
                pen = "M"
            else:
                d.append(f"{pen}{x(t):.1f},{y(v):.1f}")
                pen = "L"
        paths.append(f'<path d="{" ".join(d)}" fill="none" stroke="currentColor"><title>{html.escape(name)}</title></path>')
    return f'<!doctype html><title>{html.escape(title)}</title><svg viewBox="0 0 900 300">{"".join(paths)}</svg>\n'


def layout(topics: list[str], focus_s: float | None = None) -> dict:
    """Up to six plot panels for a viewer."""
    return {"panels": [{"type": "Plot", "paths": [t]} for t in topics[:6]], "focus_s": focus_s}
