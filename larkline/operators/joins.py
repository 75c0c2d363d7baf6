"""Joins on time: containment, overlap, tolerance bands, nearest, interpolation; and scored matches.

Time joins never compare all pairs of a key: the interval side is laid over time
buckets, both sides join on key and bucket, and the exact predicate follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last in the order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).withColumn("_n", F.max("_k").over(Window.partitionBy(*key))).filter("_k = _n").drop("_k", "_n")


def _buckets(lo: Column, hi: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long")))


def containment_join(points: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, end: str, width: float, closed: str = "left") -> DataFrame:
    """Points within intervals of the same key; ``closed`` is 'left' (end excluded) or 'both'.

    ``width`` is the bucket width in units of ``at``: about the length of a usual interval.
    """
    left = points.withColumn("_b", F.floor(F.col(at) / width).cast("long"))
    right = intervals.filter(F.col(end) >= F.col(start)).withColumn("_b", _buckets(F.col(start), F.col(end), width))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end) if closed == "both" else F.col(at) < F.col(end))
    return left.join(right, [*key, "_b"]).filter(inside).drop("_b")


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], lspan: tuple[str, str], rspan: tuple[str, str], width: float) -> DataFrame:
    """Pairs of intervals of a key with right end > left start and right start < left end.

    A pair that shares several buckets is kept in the later of the two first ones only.
    """
    a = left.withColumn("_la", F.floor(F.col(lspan[0]) / width).cast("long")).withColumn("_b", _buckets(F.col(lspan[0]), F.col(lspan[1]), width))
    b = right.withColumn("_ra", F.floor(F.col(rspan[0]) / width).cast("long")).withColumn("_b", _buckets(F.col(rspan[0]), F.col(rspan[1]), width))
    both = a.join(b, [*key, "_b"]).filter(F.col("_b") == F.greatest("_la", "_ra"))
    return both.filter((F.col(rspan[1]) > F.col(lspan[0])) & (F.col(rspan[0]) < F.col(lspan[1]))).drop("_b", "_la", "_ra")


def band_match(left: DataFrame, right: DataFrame, key: list[str], lid: str, index: tuple[str, str], lspan: tuple[str, str], rspan: tuple[str, str], order: str, tolerance: int = 100) -> DataFrame:
    """At most one right row a left row: both ends within the tolerance, equal index first, then order.

    A right row whose index is equal but outside the tolerance does not stand in the way of others.
    """
    width = max(1, 2 * tolerance)
    a = left.withColumn("_b", F.explode(F.sequence(F.floor((F.col(lspan[0]) - tolerance) / width).cast("long"), F.floor((F.col(lspan[0]) + tolerance) / width).cast("long"))))
    b = right.withColumn("_b", F.floor(F.col(rspan[0]) / width).cast("long"))
    near = (F.abs(F.col(lspan[0]) - F.col(rspan[0])) <= tolerance) & (F.abs(F.col(lspan[1]) - F.col(rspan[1])) <= tolerance)
    both = a.join(b, [*key, "_b"]).filter(near).drop("_b")
    w = Window.partitionBy(*key, lid).orderBy(F.when(F.col(index[0]) == F.col(index[1]), 0).otherwise(1), order)
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def _neighbours(grid: DataFrame, series: DataFrame, key: list[str], at: str, values: list[str], carry: list[str] | None = None) -> DataFrame:
    """Each grid row with the last series row at or before it (_p) and the first one after that (_n).

    One sort: series rows stand before grid rows of the same time. ``carry``: grid columns to keep.
    """
    carry = carry or []
    s = series.select(*key, F.col(at).alias("_t"), F.struct(F.col(at).alias("t"), *values).alias("_v"), F.lit(0).alias("_g"))
    rows = grid.select(*key, F.col(at).alias("_t"), F.lit(None).cast(s.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_g"), *carry)
    rows = rows.unionByName(s, allowMissingColumns=True)
    by = Window.partitionBy(*key).orderBy("_t", "_g")
    ahead = F.expr(f"lead(_v) ignore nulls over (partition by {', '.join(f'`{k}`' for k in key)} order by _t, _g)")
    rows = rows.withColumns({"_p": F.last("_v", True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "_n": ahead})
    return rows.filter("_g = 1").withColumnRenamed("_t", at)


def _nearest(at: str, value: str) -> Column:
    back = F.col("_p").isNotNull() & (F.col("_n").isNull() | (F.col(at) - F.col("_p.t") <= F.col("_n.t") - F.col(at)))
    return F.when(back, F.col(f"_p.{value}")).otherwise(F.col(f"_n.{value}")).alias(value)


def _line(at: str, value: str) -> Column:
    a, b, ta, tb = F.col(f"_p.{value}"), F.col(f"_n.{value}"), F.col("_p.t"), F.col("_n.t")
    return F.when(F.col("_p").isNull(), b).when(F.col("_n").isNull() | (ta == tb), a).otherwise(a + (b - a) * (F.col(at) - ta) / (tb - ta)).alias(value)


def asof_nearest(grid: DataFrame, series: DataFrame, key: list[str], at: str, values: list[str]) -> DataFrame:
    """Values of the series row nearest in time to each grid row; a tie takes the earlier one."""
    return _neighbours(grid, series, key, at, values).select(*key, at, *[_nearest(at, v) for v in values])


def interpolate(grid: DataFrame, series: DataFrame, key: list[str], at: str, values: list[str]) -> DataFrame:
    """Linear interpolation of the series at the grid's times; outside its range the end values hold."""
    return _neighbours(grid, series, key, at, values).select(*key, at, *[_line(at, v) for v in values])


def at_grid(grid: DataFrame, series: DataFrame, key: list[str], at: str, numeric: list[str], nearest: list[str], carry: list[str]) -> DataFrame:
    """Both in one pass: ``numeric`` interpolated, ``nearest`` of the nearest row; the grid's ``carry`` columns stay."""
    rows = _neighbours(grid, series, key, at, [*numeric, *nearest], carry)
    return rows.select(*key, at, *carry, *[_line(at, v) for v in numeric], *[_nearest(at, v) for v in nearest])


def best_candidate(left: DataFrame, candidates: DataFrame, on: list[str], lid: str, score: Column, ties: list[Column]) -> DataFrame:
    """The candidate with the highest positive score for each left row; ties by the given order."""
    both = left.join(candidates, on).withColumn("score", score).filter("score > 0")
    w = Window.partitionBy(lid).orderBy(F.desc("score"), *ties)
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def token_coverage(tokens: Column, text: Column) -> Column:
    """How many of the tokens the text holds."""
    return F.aggregate(tokens, F.lit(0), lambda n, t: n + F.when(text.contains(t), 1).otherwise(0))


def merge_new(old: DataFrame, new: DataFrame, key: list[Column]) -> DataFrame:
    """Old rows, and those new ones whose key expressions the old ones do not hold."""
    names = [f"_k{i}" for i in range(len(key))]
    seen = old.select(*[k.alias(n) for k, n in zip(key, names, strict=True)]).distinct()
    fresh = new.withColumns(dict(zip(names, key, strict=True))).join(seen, names, "left_anti").drop(*names)
    return old.unionByName(fresh)


def group_pairs(df: DataFrame, key: list[str], pos: str, value: str) -> DataFrame:
    """Pairs of rows i < j of a small group (such as the raters of one sample), from one sorted array."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
    got = df.groupBy(*key).agg(rows.alias("_r")).select(*key, F.posexplode("_r").alias("_i", "_a"), "_r")
    got = got.select(*key, "_a", F.explode(F.slice("_r", F.col("_i") + 2, F.greatest(F.size("_r"), F.lit(1)))).alias("_c"))
    return got.select(*key, F.col("_a.p").alias("pos_a"), F.col("_c.p").alias("pos_b"), F.col("_a.v").alias("a"), F.col("_c.v").alias("b"))


def assign(rows: DataFrame, ident: str, scores: str, least: float) -> DataFrame:
    """One-to-one assignment of the greatest total score in each row's small matrix: ident, i, j, score.

    ``scores``: array of arrays (i by j). Pairs below ``least`` are left out after the assignment. Null,
    empty and ragged matrices give no rows. Augmenting paths, cubic in the matrix, a row at a time.
    """
    kind = dict(rows.dtypes)[ident]

    def solve(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for r, m in enumerate(b.column(1).to_pylist()):
                if not m or not m[0] or any(x is None or len(x) != len(m[0]) for x in m):
                    continue
                for i, j in best_assignment(m):
                    if m[i][j] >= least:
                        for x, y in zip(out, (r, i, j, m[i][j]), strict=True):
                            x.append(y)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.float64())], names=[ident, "i", "j", "score"]
            )

    return rows.select(ident, F.col(scores).cast("array<array<double>>").alias("m")).mapInArrow(solve, f"`{ident}` {kind}, i int, j int, score double")


def best_assignment(m: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (i, j) of the assignment with the greatest sum, by shortest augmenting paths over potentials."""
    flip = len(m) > len(m[0])
    cost = -np.array(m, float).T if flip else -np.array(m, float)
    n, k = cost.shape
    u, v, owner = np.zeros(n), np.zeros(k), np.full(k, -1)
    for start in range(n):
        low, back, done = np.full(k, np.inf), np.full(k, -1), np.zeros(k, bool)
        row, col, shift = start, -1, 0.0
        while True:
            new = shift + cost[row] - u[row] - v
            better = ~done & (new < low)
            low[better], back[better] = new[better], col
            col = int(np.argmin(np.where(done, np.inf, low)))
            done[col], shift = True, low[col]
            if owner[col] < 0:
                break
            row = owner[col]
        u[start] += shift
        for c in np.flatnonzero(done):
            if c != col:
                u[owner[c]] += shift - low[c]
                v[c] -= shift - low[c]
        while col >= 0:
            before = back[col]
            owner[col] = owner[before] if before >= 0 else start
            col = before
    pairs = [(int(owner[c]), c) for c in range(k) if owner[c] >= 0]
    return sorted((c, r) for r, c in pairs) if flip else sorted(pairs)
