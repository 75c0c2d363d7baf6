"""Ranks within groups of any size: salted numbers plus the counts before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which every group is cut, so that a hot group is ranked by many tasks.
SALTS = 64


def spread(value: Column, size: int) -> Column:
    """Part of a number 0 .. size - 1 such that the parts keep its order."""
    return F.floor(value * SALTS / size).cast("int")


def rank_within(df: DataFrame, group: list[str], order: list[Column], salt: Column, name: str = "rank") -> DataFrame:
    """Adds ``name``: 0-based position in its group by (salt, order).

    ``salt`` is any integer column, taken modulo ``SALTS``; where it lies in 0 .. SALTS - 1 and
    rises with the order, the position is that of the order itself.
    """
    cut = F.pmod(salt, F.lit(SALTS)).cast("int")
    df = df.withColumn("__salt", cut)
    own = F.row_number().over(Window.partitionBy(*group, "__salt").orderBy(*order)) - 1
    sizes = df.groupBy(*group, "__salt").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("__start", F.coalesce(before, F.lit(0))).drop("__n")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "__salt"]]
    got = df.withColumn("__own", own).alias("l").join(starts.alias("r"), on)
    return got.select("l.*", (F.col("l.__own") + F.col("r.__start")).alias(name)).drop("__salt", "__own")
