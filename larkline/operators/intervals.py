"""Overlapping and gapped time intervals: covered periods and gaps by a sweep line.

Boundaries become plus and minus events, their running sum is the number of
intervals active, and a period ends where the sum falls to zero. The sweep runs
within time slices first, so no single entity has to be swept by one task; only
the merged slices meet in a second sweep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of a slice of the first sweep.
SLICE_MS = 60_000


def merge_periods(intervals: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Sweep line: maximal covered periods per key; touching intervals join. Columns: key, start, end."""
    ends = F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step"))
    )
    events = intervals.select(*key, F.inline(ends)).groupBy(*key, "at").agg(F.sum("step").alias("step"))
    by = Window.partitionBy(*key).orderBy("at")
    swept = events.withColumn("active", F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    opens = swept.withColumn("before", F.lag("active", 1, 0).over(by)).filter((F.col("before") == 0) | (F.col("active") == 0))
    # Zero before and zero after is an interval without length: it opens nothing.
    runs = opens.filter((F.col("before") == 0) != (F.col("active") == 0)).withColumn("stop", F.lead("at").over(by))
    return runs.filter(F.col("before") == 0).select(*key, F.col("at").alias(start), F.col("stop").alias(end))


def turn_times(turns: DataFrame, key: str = "session_id", start: str = "start_s", end: str = "end_s", longest_s: int = 4000) -> DataFrame:
    """Key, lo, hi in whole milliseconds; times in order, rows with a null time dropped.

    A session lasts some 20 minutes, so one whose times exceed ``longest_s`` holds milliseconds.
    """
    a, b = F.col(start).cast("double"), F.col(end).cast("double")
    ok = ~(F.isnan(a) | F.isnan(b))
    rows = (
        turns.filter(F.col(key).isNotNull() & a.isNotNull() & b.isNotNull() & ok)
        .select(key, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )
    unit = rows.groupBy(key).agg(F.when(F.max("b") > longest_s, F.lit(1.0)).otherwise(F.lit(1000.0)).alias("unit"))

    def whole(c: str) -> Column:
        return F.round(F.col(c) * F.col("unit")).cast("long")

    return rows.join(unit, key).select(key, whole("a").alias("lo"), whole("b").alias("hi"))


def covered_periods(turns: DataFrame, key: str = "session_id", start: str = "start_s", end: str = "end_s", longest_s: int = 4000) -> DataFrame:
    """Continuous periods covered by at least one interval: key, start_ms, end_ms.

    Defined cases: intervals with a null or NaN time or a null key cover nothing; swapped times
    are put in order; touching and nested intervals join; intervals without length join the
    period that holds them and else cover nothing; repeated rows change nothing; other columns are
    ignored; an empty table gives no rows.
    """
    times = turn_times(turns, key, start, end, longest_s)
    return _swept(times, key).select(key, F.col("lo").alias("start_ms"), F.col("hi").alias("end_ms"))


def _swept(times: DataFrame, key: str) -> DataFrame:
    # An interval is cut at the first and the last slice border inside it, however many lie between: its
    # ends are swept in their slices, the whole slices between meet those in the second sweep.
    at = times.select(key, "lo", "hi", F.floor(F.col("lo") / SLICE_MS).alias("a"), F.floor(F.col("hi") / SLICE_MS).alias("b"))
    one = F.struct(F.col("a").alias("slice"), "lo", "hi")
    head = F.struct(F.col("a").alias("slice"), "lo", ((F.col("a") + 1) * SLICE_MS).alias("hi"))
    tail = F.struct(F.col("b").alias("slice"), (F.col("b") * SLICE_MS).alias("lo"), "hi")
    ends = at.select(key, F.inline(F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(head, tail))))
    between = at.filter("b > a + 1").select(key, ((F.col("a") + 1) * SLICE_MS).alias("lo"), (F.col("b") * SLICE_MS).alias("hi")).distinct()
    return merge_periods(merge_periods(ends, [key, "slice"], "lo", "hi").drop("slice").unionByName(between), [key], "lo", "hi")


def gaps(turns: DataFrame, key: str = "session_id", start: str = "start_s", end: str = "end_s", longest_s: int = 4000) -> DataFrame:
    """Stretches between a key's earliest start and latest end that nothing covers.

    Columns: key, gap_start_ms, gap_end_ms; the cases are those of covered_periods.
    """
    times = turn_times(turns, key, start, end, longest_s)
    # An interval without length opens no period, but bounds its key's extent: it is one more point.
    edges = times.groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    points = edges.select(key, F.explode(F.array("lo", "hi")).alias("lo")).withColumn("hi", F.col("lo"))
    found = _swept(times, key).unionByName(points)
    by = Window.partitionBy(key).orderBy("lo", "hi")
    ended = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return (
        found.withColumn("ended", ended)
        .filter(F.col("lo") > F.col("ended"))
        .select(key, F.col("ended").alias("gap_start_ms"), F.col("lo").alias("gap_end_ms"))
    )
