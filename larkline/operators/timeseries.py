"""Time-series operators: binning, smoothing, filling, resampling, padding, scaling, patching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkline.operators import joins


def bin_index(row: Column, n: Column, bins: int) -> Column:
    """Bin of 0-based row of n rows when edges lie at trunc(i * n / bins)."""
    return F.floor(((row + 1) * bins - 1) / n).cast("int")


def equal_count_bins(df: DataFrame, key: list[str], order: list[Column], values: list[str], bins: int = 8) -> DataFrame:
    """Mean of each value in ``bins`` runs of about equal row counts; a bin without rows is 0.0.

    Every key has all bins. Columns: key, bin, values.
    """
    w = Window.partitionBy(*key)
    row, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    got = df.withColumn("bin", bin_index(row, n, bins)).groupBy(*key, "bin").agg(F.struct(*[F.avg(v).alias(v) for v in values]).alias("m"))
    # The few bins of a key as one map: all of them come out without reading the rows again.
    kept = got.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "m"))).alias("m"))
    full = kept.select(*key, "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).withColumn("m", F.try_element_at("m", F.col("bin")))
    return full.select(*key, "bin", *[F.coalesce(f"m.{v}", F.lit(0.0)).alias(v) for v in values])


def rolling_mean(value: Column | str, key: list[str], order: list[Column], source_rate: float, target_rate: float) -> Column:
    """Centred mean over the odd window ceil(source / target); at rates that do not fall, the value itself."""
    ratio = source_rate / target_rate
    if ratio <= 1:
        return F.col(value) if isinstance(value, str) else value
    size = -int(-ratio // 1)
    half = (size + 1 - size % 2) // 2
    return F.avg(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(-half, half))


def fill_linear(df: DataFrame, key: list[str], order: list[Column], value: str, both_ends: bool = True) -> DataFrame:
    """Nulls between two values by row position; at the ends the nearest value, at the start only if asked."""
    w = Window.partitionBy(*key).orderBy(*order)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    df = df.withColumn("_i", F.row_number().over(w))
    df = df.withColumns({"_p": F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("_i") - F.col("_p.i")) / (F.col("_n.i") - F.col("_p.i"))
    start = F.col("_n.v") if both_ends else F.lit(None).cast("double")
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_p").isNull(), start).when(F.col("_n").isNull(), F.col("_p.v")).otherwise(line)
    return df.withColumn(value, filled).drop("_i", "_p", "_n")


def resample(df: DataFrame, key: list[str], at: str, numeric: list[str], nearest: list[str], rate: float) -> DataFrame:
    """Grid k / rate from each key's first time, numbers interpolated, other columns from the nearest row.

    Columns: key, k, t (rebased to 0, 6 digits), numeric, nearest, frame (from 1).
    """
    span = df.groupBy(*key).agg(F.min(at).alias("_t0"), F.max(at).alias("_t1"))
    steps = F.floor((F.col("_t1") - F.col("_t0")) * rate + 1e-9)
    grid = span.select(*key, "_t0", F.explode(F.sequence(F.lit(0).cast("long"), steps)).alias("k")).withColumn(at, F.col("_t0") + F.col("k") / rate)
    out = joins.at_grid(grid, df, key, at, numeric, nearest, ["k"])
    return out.select(*key, "k", F.round(F.col("k") / rate, 6).alias("t"), *numeric, *nearest, (F.col("k") + 1).alias("frame"))


def downsample_positions(n: Column, most: int) -> Column:
    """Array of the positions trunc(i * (n - 1) / (most - 1)) of at most ``most`` rows, all of them if fewer."""
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (i * ((n - 1) / F.lit(most - 1))).cast("int"))
    return F.when(n > most, even).otherwise(F.sequence(F.lit(0), n.cast("int") - 1))


def downsample(df: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """Rows of evenly spread positions where a key has more than ``most``."""
    w = Window.partitionBy(*key)
    df = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    # Row i is kept if a step of the even spread falls on it.
    step = (F.col("_n") - 1) / F.lit(most - 1)
    j = F.ceil(F.col("_i") / step - 1e-9)
    near = [(F.col("_i") == (x * step).cast("int")) & (x >= 0) & (x < most) for x in (j - 1, j, j + 1)]
    return df.filter((F.col("_n") <= most) | near[0] | near[1] | near[2]).drop("_i", "_n")


def decimate(series: Column | str, factor: int) -> Column:
    """Every factor-th element of an array."""
    return F.filter(F.col(series) if isinstance(series, str) else series, lambda _, i: i % factor == 0)


def tumbling_modes(df: DataFrame, key: list[str], at: str, label: str, width: float, share: float = 0.5) -> DataFrame:
    """Windows from each key's first time with their most frequent label, if it holds the share; ties the smallest.

    Columns: key, window, label, n, rows.
    """
    first = df.groupBy(*key).agg(F.min(at).alias("_t0"))
    rows = df.join(first, key).withColumn("window", F.floor((F.col(at) - F.col("_t0")) / width))
    per = rows.groupBy(*key, "window", label).agg(F.count("*").alias("n"))
    best = per.groupBy(*key, "window").agg(F.sum("n").alias("rows"), F.min(F.struct(-F.col("n"), F.col(label))).alias("_b"))
    top = best.select(*key, "window", F.col(f"_b.{label}").alias(label), (-F.col("_b")["col1"]).alias("n"), "rows")
    return top.filter(F.col("n") >= share * F.col("rows"))


def median_step(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """Median of the positive steps between neighbouring times."""
    d = F.col(at) - F.lag(at).over(Window.partitionBy(*key).orderBy(at))
    return df.withColumn("_d", d).filter("_d > 0").groupBy(*key).agg(F.percentile("_d", 0.5).alias("step"))


def append_segment(first: DataFrame, second: DataFrame, key: list[str], at: str, frame: str) -> DataFrame:
    """Second recording moved behind the first: times by last time plus a median step, frames by the last frame."""
    end = first.groupBy(*key).agg(F.max(at).alias("_t"), F.max(frame).alias("_f")).join(median_step(first, key, at), key)
    start = second.groupBy(*key).agg(F.min(at).alias("_s"), F.min(frame).alias("_g"))
    moved = second.join(end, key).join(start, key)
    moved = moved.withColumn(at, F.col(at) - F.col("_s") + F.col("_t") + F.col("step")).withColumn(frame, F.col(frame) - F.col("_g") + F.col("_f") + 1)
    return first.select(*key, at, frame).unionByName(moved.select(*key, at, frame))


def pad_forward(series: Column, length: Column) -> Column:
    """The array continued with its last element up to the length."""
    return F.concat(series, F.array_repeat(F.try_element_at(series, F.lit(-1)), F.greatest(length - F.size(series), F.lit(0))))


def pad_zero(series: Column, patch: int, most: int | None = None) -> Column:
    """The array cut to ``most`` and continued with zeros to a multiple of the patch size."""
    x = F.slice(series, 1, most) if most else series
    return F.concat(x, F.array_repeat(F.lit(0.0), (F.ceil(F.size(x) / patch) * patch - F.size(x)).cast("int")))


def patches(series: Column, patch: int) -> Column:
    """Array of consecutive slices; null where the length is no multiple of the patch size."""
    n = F.size(series)
    cut = F.transform(F.sequence(F.lit(0), F.greatest((n / patch).cast("int") - 1, F.lit(0))), lambda i: F.slice(series, i * patch + 1, F.lit(patch)))
    return F.when((n % patch == 0) & (n > 0), cut)


def zscore(value: Column | str, key: list[str], ddof: int = 0, mode: str = "add", eps: float = 1e-8) -> Column:
    """(x - mean) / spread over the key; spread + eps ('add'), at least eps ('clamp'), or centred only up to eps ('center')."""
    w = Window.partitionBy(*key)
    x = F.col(value) if isinstance(value, str) else value
    mean, sd = F.avg(x).over(w), (F.stddev_samp(x) if ddof else F.stddev_pop(x)).over(w)
    sd = F.coalesce(sd, F.lit(0.0))
    if mode == "add":
        return (x - mean) / (sd + eps)
    if mode == "clamp":
        return (x - mean) / F.greatest(sd, F.lit(eps))
    return F.when(sd > eps, F.try_divide(x - mean, sd)).otherwise(x - mean)


def once(value: Column, body) -> Column:
    """body(value) with the value computed once, not anew for each element of an array in the body."""
    return F.transform(F.array(value), body)[0]


def zscore_array(series: Column, ddof: int = 0, mode: str = "add", eps: float = 1e-8) -> Column:
    """zscore of an array in place."""
    n = F.size(series)
    mean = F.aggregate(series, F.lit(0.0), lambda a, x: a + x) / n

    def scaled(m: Column) -> Column:
        sd = F.sqrt(F.aggregate(series, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.greatest(n - ddof, F.lit(1)))
        div = sd + eps if mode == "add" else F.greatest(sd, F.lit(eps)) if mode == "clamp" else F.when(sd > eps, sd).otherwise(1.0)
        return once(div, lambda s: F.transform(series, lambda x: (x - m) / s))

    return once(mean, scaled)


def convolve_same(df: DataFrame, key: list[str], order: list[Column], value: str, kernel: Sequence[float]) -> Column:
    """Centred correlation with an odd kernel, zeros beyond the ends; a sum of lags, so one window sort."""
    w, half = Window.partitionBy(*key).orderBy(*order), len(kernel) // 2
    total = F.lit(0.0)
    for i, k in enumerate(kernel):
        shift = i - half
        x = F.lag(value, -shift).over(w) if shift < 0 else F.lead(value, shift).over(w)
        total = total + F.lit(float(k)) * F.coalesce(x, F.lit(0.0))
    return total


def first_k(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")


def minutes(ms: Column | str) -> Column:
    """mm:ss of whole milliseconds."""
    s = F.floor((F.col(ms) if isinstance(ms, str) else ms) / 1000)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def length_buckets(df: DataFrame, size: str, ident: str, batch: int, drop_last: bool = False) -> DataFrame:
    """Batch numbers of rows sorted by size; counts per size give the offsets, so no task sorts all rows."""
    per = df.groupBy(size).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(size).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.withColumn("_s", before)  # a row a distinct size
    row = F.row_number().over(Window.partitionBy(size).orderBy(ident)) - 1
    out = df.withColumn("_r", row).join(starts, size).withColumn("batch", F.floor((F.col("_s") + F.col("_r")) / batch))
    if drop_last:
        n = F.count("*").over(Window.partitionBy("batch"))
        out = out.withColumn("_c", n).filter(F.col("_c") == batch).drop("_c")
    return out.drop("_n", "_s", "_r")


def sequence_mask(n: Column, most: Column) -> Column:
    """Array of ``most`` booleans, true before position n."""
    return F.transform(F.sequence(F.lit(0), most.cast("int") - 1), lambda i: i < n)


def early_stop(losses: Column, patience: int = 5, margin: float = 1e-4) -> Column:
    """Fold over an ordered array of losses: best value, its index, and the index at which training stops.

    A loss improves if it is below the best by more than the margin; after ``patience`` others it stops.
    """
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(-1).alias("at"), F.lit(0).alias("bad"), F.lit(-1).alias("stop"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        live, better = a["stop"] < 0, x + margin < a["best"]
        bad = F.when(better, 0).otherwise(a["bad"] + 1)
        return F.struct(
            F.when(live & better, x).otherwise(a["best"]).alias("best"), F.when(live & better, a["i"]).otherwise(a["at"]).alias("at"),
            F.when(live, bad).otherwise(a["bad"]).alias("bad"), F.when(live & (bad >= patience), a["i"]).otherwise(a["stop"]).alias("stop"), (a["i"] + 1).alias("i"),
        )

    return F.aggregate(losses, start, step)
