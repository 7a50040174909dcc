"""Reliable rows and nearest runs against all pairs; no pairs are made that only grow with the table."""

import math
import random

import duckdb
import pytest

from colloquy.operators import intervals as iv
from colloquy.operators import sessions as ss
from colloquy.plans import catalogue, registry  # noqa: F401


@pytest.mark.parametrize(("seed", "width", "lengths"), [(1, 300, (0, 90)), (2, 50, (10, 400)), (3, 10_000_000, (0, 160))])
def test_rows_explained_by_reliable_ones(spark, monkeypatch, seed, width, lengths):
    monkeypatch.setattr(iv.bucketed, "__defaults__", ("start", width))
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), i, s := rng.randrange(3000), s + rng.choice([0, rng.randrange(200)]), rng.choice([[0], [0, 1], [1, None], [], None])) for i in range(300)]
    good = [(rng.choice(["a", "b", None]), rng.choice([0, 1, None]), s := rng.randrange(3000), s + rng.randrange(*lengths)) for _ in range(250)] + [("a", 0, None, 9), ("a", 0, 9, None)]
    want = set()
    for d, i, s, e, ids in rows:
        covered = [any(g[:2] == (d, m) and None not in g and min(e, g[3]) - max(s, g[2]) >= 0.8 * (e - s) for g in good) for m in set(ids or [])]
        if covered and e > s and all(covered):
            want.add(i)
    got = ss.explained_by_reliable(spark.createDataFrame(rows, "day string, id long, start long, end long, me_ids array<int>"), spark.createDataFrame(good, "day string, me_id int, start long, end long"), ["day"], 60)
    assert {r.id for r in got.collect()} == want and want


@pytest.mark.parametrize(("seed", "width"), [(7, 3_600_000), (8, 600_000), (9, 10_000_000_000)])
def test_rows_without_length_null_turns_and_equal_ids_are_explained_as_in_sql(spark, tmp_path, monkeypatch, seed, width):
    monkeypatch.setattr(iv.bucketed, "__defaults__", ("start", width))
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(240)]), 1_704_067_200 + 600 * rng.randrange(288), rng.choice([None, -1, *range(6)]), rng.choice(["error", "error", "view"]), rng.choice([None, -600.0, 0.0, 0.0, 0.0, 600.0, 1200.0, 6000.0])) for _ in range(200)]
    rows += [(1000 + i, None if i % 20 == 0 else 1_704_067_200 + 600 * rng.randrange(288), rng.randrange(6), "view", -4800.0 + 600 * rng.randrange(3)) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double").selectExpr("event_id", "timestamp_seconds(at) AS ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * REPLACE (epoch_ms(epoch_ms(ts)) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    want = [r[0] for r in c.sql(registry.oracle_sql()["audio_reliable_filter"]).fetchall()]
    got = [r.id for r in registry.queries()["audio_reliable_filter"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    points = {r[0] for r in rows if r[3] == "error" and r[4] == 0}
    assert points & set(want) and points - set(want)


def test_long_rows_are_not_broadcast_in_buckets(spark):
    """A few rows that cover many buckets each stay out of the driver's memory."""
    frame = spark.createDataFrame([("a", 0, 100_000_000)], "k string, start long, end long")
    assert "BroadcastHashJoin" not in iv.overlap_join(frame, frame, ["k"], 1000)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("seed", "width", "longest"), [(4, 40, 60), (5, 300, 8), (6, 10_000_000, 200)])
def test_nearest_runs(spark, monkeypatch, seed, width, longest):
    monkeypatch.setattr(iv.bucketed, "__defaults__", ("start", width))
    rng = random.Random(seed)
    runs = [(rng.choice(["a", "b", None]), f := rng.randrange(2000), f + rng.choice([0, rng.randrange(longest)])) for _ in range(80)]
    points = [(rng.choice(["a", "b", None]), i, rng.randrange(-100, 2100)) for i in range(300)] + [("a", 900, None)]
    want = {}
    for d, i, at in points:
        near = [((0 if f <= at <= t else min(abs(at - f), abs(at - t))), f - t, f) for k, f, t in runs if k == d and d is not None and at is not None]
        if near and min(near)[0] <= 50:
            want[i] = (min(near)[2], min(near)[0])
    got = ss.nearest_run(spark.createDataFrame(points, "day string, id long, at long"), spark.createDataFrame(runs, "day string, first long, last long"), ["day"], 50)
    assert {r.id: (r.first, r.d) for r in got.collect()} == want


def test_shares_of_overlaps_of_no_length(spark, tmp_path):
    """An interval without length has overlaps of 0: shares of 0 by 0 are NaN, as in SQL, and no error."""
    rows = [(1, "2024-01-01 00:00:10", "signup", 0.0), (2, "2024-01-01 00:00:05", "view", 20.0), (3, "2024-01-01 00:00:20", "signup", 5.0), (4, "2024-01-01 00:00:24", "click", 2.0)]
    frame = spark.createDataFrame(rows, "event_id long, at string, event_type string, value double").selectExpr("event_id", "timestamp(at) AS ts", "event_id AS user_id", "event_type", "value", "'' AS props")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.id, r.track): r.ratio for r in registry.queries()["interval_overlap_agg_join"](spark, str(tmp_path)).collect()}
    assert math.isnan(got.pop((1, "view"))) and got == {(3, "view"): 5 / 6, (3, "click"): 1 / 6}
