"""Gates where a unit's mean lies on a bound or on half of the last digit."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.plans import fleet

TOPICS = ("view", "click", "signup", "purchase", "error")


@pytest.fixture(scope="module")
def layouts(tmp_path_factory):
    """The same events as one file in order, and as seven files of rows in random order; users 0 to 39 have means of 45 or 50."""
    draw, rows = random.Random(5), []
    for user in range(400):
        cents = [draw.randrange(10_000) for _ in range(80)]
        if user < 40:
            cents[-1] = (4500 if user % 2 else 5000) * 80 - sum(cents[:-1])
        rows += [(user, TOPICS[draw.randrange(5)], c / 100) for c in cents]
    draw.shuffle(rows)
    rows = [(i, 1_704_067_200_000_000 + i * 50_000_000, *r) for i, r in enumerate(rows)]
    out = []
    for name, parts in (("one", [rows]), ("many", None)):
        if parts is None:
            draw.shuffle(rows)
            parts = [rows[i::7] for i in range(7)]
        folder = tmp_path_factory.mktemp(name)
        (folder / "events.parquet").mkdir()
        for i, part in enumerate(parts):
            ids, ts, users, topics, values = zip(*part, strict=True)
            pq.write_table(pa.table({"event_id": ids, "ts": pa.array(ts, pa.timestamp("us")), "user_id": users, "event_type": topics, "value": values, "props": ['{"k": 1}'] * len(ids)}), folder / "events.parquet" / f"{i}.parquet")
        out.append(str(folder))
    return out


def test_verdicts_at_a_bound(spark, layouts):
    for d in layouts:
        got = {r.user_id: r.verdict for r in fleet.gate_decisions(spark, d).where("user_id < 40").collect()}
        assert got == {u: "degraded" if u % 2 else "healthy" for u in range(40)}


def test_rejections_at_a_bound(spark, layouts):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{layouts[0]}/events.parquet/*.parquet'")
    cents = "SELECT user_id, sum(round(value * 100)::BIGINT) AS s, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL"
    want = dict(zip(("compromised", "message_loss"), con.sql(f"SELECT count(*) FILTER (s < 4500 * n), count(*) FILTER (100 * errors > 22 * n) FROM ({cents})").fetchall()[0], strict=True))
    for d in layouts:
        got = {r.code: r.n for r in fleet.gate_rejections(spark, d).collect()}
        assert {k: got[k] for k in want} == want


def test_scores_do_not_depend_on_layout(spark, layouts):
    con = duckdb.connect(config={"threads": 1})  # so that it sums in order of rows
    con.sql(f"CREATE VIEW events AS FROM '{layouts[0]}/events.parquet/*.parquet'")
    sql = f"SELECT user_id, score, before, passed FROM ({fleet.SQL['quality_gate']}) WHERE user_id >= 40 ORDER BY user_id"  # no verdicts at a bound
    want = con.sql(sql).fetchall()
    for d in layouts:
        assert [tuple(r) for r in fleet.quality_gate(spark, d).where("user_id >= 40").orderBy("user_id").collect()] == want
