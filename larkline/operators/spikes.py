"""Implausible readings per recording and channel: off-scale, stuck and spiking.

Spikes are found by phase-space thresholding: readings lie with their first and second
differences in ellipsoids fitted to the recording. The axes start from the spread of the
inner readings and grow over all that lies within ``reach`` times the ellipsoids, over long
excursions, and over brief ones that come too often to be faults; so blinks, speech and
restless faces end up inside, however little of the time they take. What stays outside
and goes beyond the values inside is a spike; spikes are replaced by interpolation and the
ellipsoids fitted again until none is found. Near the surface a tie-break decides: a
spike clears the values inside by ``min_gap`` and comes and goes at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkline.core import cut, finite, interview_type

KEY = ("patient_id", "subject_role", "interview_type")

#: Frames of one recording that one task fits ellipsoids to (some four minutes at 60 frames a second). A
#: longer recording is fitted stretch by stretch, and a spike must clear the range of all its stretches.
STRETCH = 16384

#: Readings of the neighbouring stretches that a stretch also sees.
HALO = 512

#: Readings over which ``max_events`` excursions are few; more readings may hold more in proportion.
HABIT = 320


def _slope(x: np.ndarray) -> np.ndarray:
    d = np.empty_like(x)
    d[1:-1] = (x[2:] - x[:-2]) / 2
    d[0], d[-1] = x[1] - x[0], x[-1] - x[-2]
    return d


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last places of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _inside(work: np.ndarray, bad: np.ndarray, o: dict) -> tuple[np.ndarray, np.ndarray]:
    """Readings inside the grown ellipsoids, and those outside that exceed the values inside."""
    n, had = len(work), len(_runs(bad)[0])
    few = max(o["events"], o["events"] * n // HABIT)
    u = work - np.median(work)
    d = _slope(work)
    axes = np.stack((np.maximum(u, 0), np.maximum(-u, 0), np.abs(d), np.abs(_slope(d))))
    size = np.maximum(np.quantile(axes[:, ~bad], o["core"], axis=1), o["floor"])
    inside = np.zeros(n, bool)
    while True:
        p = (axes / size[:, None]) ** 2
        value = p[0] + p[1]
        new = (np.maximum(np.maximum(value + p[2], value + p[3]), p[2] + p[3]) <= o["reach"] ** 2) & ~inside
        if not new.any():
            beyond = ~inside & ~bad & ((axes[0] > size[0]) | (axes[1] > size[1]))
            start, end = _runs(beyond)
            brief = end - start <= o["longest"]
            # Brief excursions beyond the few farthest are habit, long ones taken in from below.
            far = np.array([value[i:j].max() for i, j in zip(start, end, strict=True)])
            taken = ~brief
            order = np.flatnonzero(brief)[np.argsort(far[brief], kind="stable")]
            taken[order[: max(0, len(order) + had - few)]] = True
            if not taken.any():
                return inside, beyond
            for i, j, short in zip(start[taken], end[taken], brief[taken], strict=True):
                new[i:j] = short | (value[i:j] <= np.median(value[i:j]))
        inside |= new
        size = np.maximum(size, axes[:, inside].max(1))


def phase_space(v: np.ndarray, o: dict, gate: bool = True) -> tuple[np.ndarray, float, float]:
    """Mask of spikes, and the least and greatest value of all other readings.

    Without ``gate`` the tie-break alone decides (for tests).
    """
    n = len(v)
    bad, at, work = np.zeros(n, bool), np.arange(n), v.copy()
    for _ in range(o["rounds"]):
        beyond = _inside(work, bad, o)[1] if gate else ~bad
        new = np.zeros(n, bool)
        kept = ~beyond & ~bad if gate else ~bad & (np.abs(v - np.median(v)) <= np.quantile(np.abs(v - np.median(v)), o["core"]))
        for y in (v, -v):
            if not kept.any():
                break
            top = y[kept].max()
            near = top + o["min_gap"] / 4
            for i, j in zip(*_runs((y >= top + o["min_gap"]) & ~bad), strict=True):
                if j - i <= o["longest"] and (i == 0 or bad[i - 1] or y[i - 1] <= near) and (j == n or bad[j] or y[j] <= near):
                    new[i:j] = True
        if not new.any():
            break
        bad |= new
        if bad.all():
            break
        work[bad] = np.interp(at[bad], at[~bad], v[~bad])
    rest = v[~bad]
    return bad, float(rest.min(initial=np.inf)), float(rest.max(initial=-np.inf))


def _stuck(v: np.ndarray, t: np.ndarray, low: float, seconds: float, least: int, rests: float) -> np.ndarray:
    """Readings of stretches that show one value for seconds in a channel that otherwise moves."""
    n = len(v)
    cutp = np.flatnonzero(v[1:] != v[:-1]) + 1
    start = np.concatenate(([0], cutp))
    end = np.concatenate((cutp, [n]))
    hit = np.zeros(n, bool)
    for i, j in zip(start[end - start >= least], end[end - start >= least], strict=True):
        span = t[i:j][~np.isnan(t[i:j])]
        if not len(span) or span[-1] - span[0] < seconds:
            continue
        rest = np.concatenate((v[:i], v[j:]))
        if len(np.unique(rest)) < 5 or v[i] == low and np.mean(rest == low) >= rests:
            continue
        hit[i:j] = True
    return hit


def faults_of(t: np.ndarray, v: np.ndarray, o: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Masks (off-scale, stuck, spike) of one channel in frame order, v without NaN; the range of the rest."""
    off = (v < o["low"]) | (v > o["high"])
    stuck, spike = np.zeros(len(v), bool), np.zeros(len(v), bool)
    at = np.flatnonzero(~off)
    if len(at) >= o["least"]:
        stuck[at] = _stuck(v[at], t[at], o["low"], o["stuck_s"], o["stuck_n"], o["rests"])
        at = at[~stuck[at]]
    lo, hi = float(v[at].min(initial=np.inf)), float(v[at].max(initial=-np.inf))
    if len(at) >= o["least"]:
        spike[at], lo, hi = phase_space(v[at], o)
    return off, stuck, spike, lo, hi


def flag_faults(
    frames: DataFrame,
    channels: tuple[str, ...] = ("au04_r", "au25_r", "au45_r"),
    low: float = 0.0,
    high: float = 5.0,
    min_confidence: float = 0.5,
    stuck_seconds: float = 2.0,
    stuck_readings: int = 8,
    rests: float = 0.02,
    min_gap: float = 0.6,
    reach: float = 1.8,
    core: float = 0.9,
    floor: float = 0.3,
    max_readings: int = 5,
    max_events: int = 4,
    min_readings: int = 16,
    rounds: int = 12,
) -> DataFrame:
    """Flag the faulty readings of tracked frames, judged against their own recording.

    Result: patient_id, subject_role, interview_type, frame, channel, value, fault, one row a
    faulty reading; fault is ``off_scale`` (outside low..high), ``stuck`` (one value for at least
    ``stuck_seconds`` and ``stuck_readings``; a rest at ``low`` only where the channel rests there
    in less than the share ``rests`` of its other readings) or ``spike`` (outside the ellipsoids for
    at most ``max_readings``; excursions beyond ``max_events`` in 320 readings are habit).

    Defined cases: rows with success other than 1, confidence below ``min_confidence`` or null, or
    a null frame are not judged; null and NaN values are no readings; repeated rows count once and,
    should a frame hold several values, each is judged; rows with a null id, which belong to no
    recording, are held against the scale alone. Recordings with fewer than ``min_readings`` readings are only held against the
    scale. Other columns, whatever their names, are ignored; an empty table gives no rows.

    One shuffle: map-side sets pack each recording's readings into one row, which also drops
    repeated rows before they travel. Recordings beyond STRETCH frames are cut there, and the few rows
    found are held against the range of all stretches.
    """
    o = {"low": low, "high": high, "stuck_s": stuck_seconds, "stuck_n": stuck_readings, "rests": rests, "min_gap": min_gap,
         "reach": reach, "core": core, "floor": floor, "longest": max_readings, "events": max_events, "least": min_readings, "rounds": rounds}
    d = len(channels)
    part = F.floor(F.col("frame") / STRETCH)
    near = F.array_distinct(
        F.array(part, F.greatest(F.floor((F.col("frame") - HALO) / STRETCH), F.least(part, F.lit(0))), F.floor((F.col("frame") + HALO) / STRETCH))
    )
    rows = (
        frames.filter((F.col("success") == 1) & (F.col("confidence") >= min_confidence) & F.col("frame").isNotNull())
        .select(
            *KEY[:2],
            interview_type("interview_type").alias("interview_type"),
            F.col("frame").cast("long").alias("frame"),
            finite("ts_s").alias("t"),
            *[finite(c).alias(f"v{i}") for i, c in enumerate(channels)],
        )
        .filter(F.coalesce(*[F.col(f"v{i}") for i in range(d)]).isNotNull())
    )
    stray = F.col("patient_id").isNull() | F.col("subject_role").isNull() | F.col("interview_type").isNull()
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"v{i}").alias("value")) for i, c in enumerate(channels)]))
    alone = rows.filter(stray).select(*KEY, F.col("frame").cast("int").alias("frame"), each).distinct()
    alone = alone.filter((F.col("value") < low) | (F.col("value") > high)).withColumn("fault", F.lit("off_scale"))
    rows = rows.filter(~stray).withColumn("part", F.explode(near))
    packed = rows.groupBy(*KEY, "part").agg(
        F.collect_set(F.struct("frame", F.coalesce("t", F.lit(float("nan"))).alias("t"),
                               *[F.coalesce(f"v{i}", F.lit(float("nan"))).alias(f"v{i}") for i in range(d)])).alias("r")
    )
    schema = "patient_id string, subject_role string, interview_type string, frame int, channel string, value double, fault string, lo double, hi double"

    def judge(batches, ranges=False):
        for batch in batches:
            lists = batch.column("r")
            flat, ends = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            frame = flat.field(0).to_numpy(zero_copy_only=False)
            t, vs = flat.field(1).to_numpy(zero_copy_only=False), [flat.field(2 + i).to_numpy(zero_copy_only=False) for i in range(d)]
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            out: list[list] = [[], [], [], [], [], [], []]  # row of the batch, frame, channel, value, fault, lo, hi
            for k in range(batch.num_rows):
                i, j = ends[k], ends[k + 1]
                order = np.lexsort([*(x[i:j] for x in vs), t[i:j], frame[i:j]])
                f, tt = frame[i:j][order], t[i:j][order]
                if len(tt) and np.nanmax(tt, initial=-np.inf) - np.nanmin(tt, initial=np.inf) > 1000:
                    tt = tt / 1000.0  # milliseconds
                for c in range(d):
                    v = vs[c][i:j][order]
                    has = ~np.isnan(v)
                    *masks, lo, hi = faults_of(tt[has], v[has], o)
                    own = (f[has] // STRETCH) == parts[k]
                    found = [(name, np.flatnonzero(mask & own)) for name, mask in zip(("off_scale", "stuck", "spike"), masks, strict=True)]
                    if ranges and has.any():
                        # The range of one stretch of several, for the spikes of the others.
                        for x, y in zip(out, (k, None, channels[c], None, "range", lo, hi), strict=True):
                            x.append(y)
                    for name, at in found:
                        for x, y in zip(out, (k, f[has], channels[c], v[has], name, lo, hi), strict=True):
                            x += y[at].tolist() if isinstance(y, np.ndarray) else [y] * len(at)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x).take(at) for x in KEY), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.string()),
                 pa.array(out[5], pa.float64()), pa.array(out[6], pa.float64())],
                names=[*KEY, "frame", "channel", "value", "fault", "lo", "hi"],
            )

    of = F.floor(F.col("frame") / STRETCH)
    if frames.select(F.min(of) == F.max(of)).first()[0] is not False:  # no recording can lie in two stretches
        return packed.mapInArrow(judge, schema).drop("lo", "hi").unionByName(alone)
    stretch = rows.select(*KEY, of.alias("s")).groupBy(*KEY).agg(F.min("s").alias("a"), F.max("s").alias("b"))
    long = cut(stretch.filter("a < b").select(*KEY))
    if long.isEmpty():
        return packed.mapInArrow(judge, schema).drop("lo", "hi").unionByName(alone)
    found = packed.join(long, list(KEY), "left_anti").mapInArrow(judge, schema).drop("lo", "hi")
    parts = cut(packed.join(long, list(KEY), "left_semi").mapInArrow(lambda batches: judge(batches, True), schema))
    return found.unionByName(_clear_of_all(parts, min_gap)).unionByName(alone)


def _clear_of_all(parts: DataFrame, min_gap: float) -> DataFrame:
    """Faults of recordings in several stretches, without spikes that lie in the range of another stretch."""
    ranges = parts.filter("fault = 'range'").groupBy(*KEY, "channel").agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
    clear = (F.col("value") >= F.col("most") + min_gap) | (F.col("value") <= F.col("least") - min_gap)
    got = parts.filter("fault <> 'range'").join(ranges, [*KEY, "channel"])
    return got.filter((F.col("fault") != "spike") | clear).select(*KEY, "frame", "channel", "value", "fault")


def fault_report(frames: DataFrame, **options) -> DataFrame:
    """Faults counted per recording, channel and kind."""
    found = flag_faults(frames, **options)
    return found.groupBy(*KEY, "channel", "fault").agg(F.countDistinct("frame").alias("readings"))
