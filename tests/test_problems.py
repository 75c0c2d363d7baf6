"""Grid, interval and fault operators: definitions, edge cases, brute force and held-out accuracy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkline.operators import grid, intervals, spikes

FRAME = "patient_id string, subject_role string, interview_type string, frame int, ts_s double, confidence double, success int, au04_r double, au12_r double, au25_r double, au45_r double"


def frames(spark, rows):
    return spark.createDataFrame(rows, FRAME)


def reading(frame, ts, a=1.0, b=1.0, c=1.0, d=0.2, who="VP1", kind="Bind", conf=0.9, ok=1):
    return (who, "patient", kind, frame, ts, conf, ok, a, b, c, d)


def test_grid_cells(spark):
    rows = [reading(1, 3.2, 1.0), reading(2, 3.9, 2.0), reading(2, 3.9, 2.0, kind=" BINDUNG"), reading(3, 6.0, 3.0), reading(4, 5.0, None), reading(5, 5.1, ok=0), reading(6, 5.2, conf=0.49), reading(7, None)]
    got = {r.cell_s: r for r in grid.regular_grid(frames(spark, rows)).collect()}
    assert sorted(got) == [3, 4, 5, 6]
    assert got[3].status == "observed" and got[3].au04_r == pytest.approx(1.5)
    assert got[4].status == got[5].status == "unsupported" and got[4].au04_r is None
    assert got[3].interview_type == "bindung"


def test_grid_milliseconds_and_nulls(spark):
    rows = [reading(1, 29_466.0, who=None), reading(2, 31_900.0, who=None), reading(3, float("nan"), who=None)]
    got = sorted((r.cell_s, r.status) for r in grid.regular_grid(frames(spark, rows)).collect())
    assert got == [(29, "observed"), (30, "unsupported"), (31, "observed")]


def test_grid_empty_and_extra_columns(spark):
    df = frames(spark, [reading(1, 1.0)]).withColumn("cell", F.lit(7)).withColumn("n", F.lit("x")).withColumn("r", F.lit(None)).withColumn("v0", F.lit(1)).withColumn("status", F.lit(2))
    assert grid.regular_grid(df).count() == 1
    assert grid.regular_grid(df.limit(0)).count() == 0
    assert grid.regular_grid(df.limit(0)).columns == ["patient_id", "subject_role", "interview_type", "cell_s", "au04_r", "au12_r", "status"]


def test_grid_fill_beats_the_mean(spark):
    rng = np.random.default_rng(3)
    base, rows, held = np.stack([np.sin(np.arange(60) / 9), np.cos(np.arange(60) / 15)]), [], {}
    for p in range(60):
        w = rng.normal(0, 0.6, 2)
        for t in range(60):
            y = 2.5 + w @ base[:, t] + rng.normal(0, 0.05)
            if 1 < t < 58 and rng.random() < 0.15:
                held[(f"P{p}", t)] = y
            else:
                rows.append(reading(t, t + 0.5, float(y), float(5 - y), who=f"P{p}"))
    got = {(r.patient_id, r.cell_s): r.au04_r for r in grid.regular_grid(frames(spark, rows)).filter("status = 'filled'").collect()}
    assert set(got) == set(held)
    err = np.mean([(got[k] - held[k]) ** 2 for k in held])
    means = {f"P{p}": np.mean([r[7] for r in rows if r[0] == f"P{p}"]) for p in range(60)}
    assert err < 0.3 * np.mean([(means[k[0]] - held[k]) ** 2 for k in held])


def brute_gaps(rows):
    out = set()
    for key in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((min(a, b), max(a, b)) for k, a, b in rows if k == key and a is not None and b is not None)
        # An interval without length covers nothing, but may bound the session.
        first, last = spans[0][0], max(hi for _, hi in spans)
        spans = sorted([(lo, hi) for lo, hi in spans if hi > lo] + [(first, first), (last, last)])
        end = None
        for lo, hi in spans:
            if end is not None and lo > end:
                out.add((key, end, lo))
            end = hi if end is None else max(end, hi)
    return out


def test_gaps_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(12):
        for _ in range(rnd.randint(1, 40)):
            a = rnd.randint(0, 600_000)
            b = a + rnd.choice([0, rnd.randint(0, 3000), rnd.randint(0, 90_000)])
            rows.append((k, float(b if rnd.random() < 0.2 else a), float(a if rnd.random() < 0.2 else b)))
    rows += rows[:20] + [(3, None, 5.0), (3, 5.0, None), (None, 1.0, 2.0), (4, float("nan"), 9.0)]
    rows = [(k, a, b) for k, a, b in rows]
    df = spark.createDataFrame(rows, "session_id long, start_s double, end_s double").withColumn("lo", F.lit("x")).withColumn("slice", F.lit(1))
    got = {tuple(r) for r in intervals.gaps(df).collect()}
    want = brute_gaps([(k, a, b) for k, a, b in rows if not any(isinstance(x, float) and math.isnan(x) for x in (a, b) if x is not None)])
    # Sessions whose times stay below the limit of milliseconds are seconds.
    big = {k for k in range(12) if max(max(a or 0, b or 0) for q, a, b in rows if q == k) > 4000}
    assert {g for g in got if g[0] in big} == {(k, int(a), int(b)) for k, a, b in want if k in big}


def test_periods_join_touching_and_nested(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.0, 3.0), (1, 2.5, 2.6), (1, 5.0, 5.0), (1, 7.0, 6.0)], "session_id long, start_s double, end_s double")
    assert sorted(tuple(r) for r in intervals.covered_periods(df).collect()) == [(1, 0, 3000), (1, 6000, 7000)]
    assert sorted(tuple(r) for r in intervals.gaps(df).collect()) == [(1, 3000, 6000)]
    assert intervals.gaps(df.limit(0)).count() == 0


def plain(n, rng):
    x = np.clip(np.round(1 + 0.2 * np.sin(np.arange(n) / 15) + rng.normal(0, 0.06, n), 2), 0, 5)
    return x


def test_faults(spark):
    rng = np.random.default_rng(0)
    n = 300
    a, c, d = plain(n, rng), plain(n, rng) + 0.5, np.round(np.clip(0.2 + rng.normal(0, 0.05, n), 0, 5), 2)
    d[::23] = 1.4  # regular blinks
    d[1::23] = 0.7
    a[100], a[200:202] = 3.9, [3.5, 3.1]  # spikes
    c[50:90] = c[50]  # stuck
    c[120] = 7.5  # off the scale
    d[10] = -1.0
    rows = [reading(i, i * 0.2, float(a[i]), 1.0, float(c[i]), float(d[i])) for i in range(n)]
    rows += rows[95:105] + [reading(400, 80.0, 9.0, ok=0), reading(401, 80.2, None, None, None, None), reading(None, 1.0, 9.0)]
    got = {(r.frame, r.channel, r.fault) for r in spikes.flag_faults(frames(spark, rows)).collect()}
    want = {(i, "au04_r", "spike") for i in (100, 200, 201)} | {(i, "au25_r", "stuck") for i in range(50, 90)}
    want |= {(120, "au25_r", "off_scale"), (10, "au45_r", "off_scale")}
    assert got == want


def test_faults_resting_channel_and_edges(spark):
    rng = np.random.default_rng(1)
    rest = np.where(rng.random(200) < 0.5, 0.0, 0.4)
    rest[60:80] = 0.0
    rows = [reading(i, i * 0.2, float(rest[i]), c=1.0, d=None) for i in range(200)]
    df = frames(spark, rows).withColumn("part", F.lit(1)).withColumn("r", F.lit("x"))
    assert spikes.flag_faults(df).count() == 0  # rests at 0 often; a channel that never moves is no fault
    assert spikes.flag_faults(df.limit(0)).count() == 0
    few = frames(spark, [reading(1, None, 6.0), reading(2, None, 1.0)])
    assert [r.fault for r in spikes.flag_faults(few).collect()] == ["off_scale"]


def test_long_recordings_are_judged_by_stretches(spark):
    rng = np.random.default_rng(2)
    n = spikes.STRETCH + 300
    a = plain(n, rng)
    a[spikes.STRETCH - 20 : spikes.STRETCH + 20] = 1.11
    rows = [reading(i, i * 0.04, float(a[i]), c=None, d=None) for i in range(n)]
    got = [r.frame for r in spikes.flag_faults(frames(spark, rows), stuck_seconds=1.0).filter("fault = 'stuck'").collect()]
    assert sorted(got) == list(range(spikes.STRETCH - 20, spikes.STRETCH + 20))


def test_one_endless_interval_stays_small(spark):
    """A corrupt end time some years away is cut in three, not into millions of slices."""
    rows = [(1, 0.5, 10.0), (1, 5.0, 3.0e8), (1, 70.0, 71.0), (1, 4.0e8, 4.1e8), (2, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "session_id long, start_s double, end_s double")
    times = intervals.turn_times(df, longest_s=10**10)
    assert sorted(tuple(r) for r in intervals._swept(times, "session_id").collect()) == [(1, 500, 300_000_000_000), (1, 400_000_000_000, 410_000_000_000), (2, 1000, 2000)]
    assert [tuple(r) for r in intervals.gaps(df, longest_s=10**10).collect()] == [(1, 300_000_000_000, 400_000_000_000)]
