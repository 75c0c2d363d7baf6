"""Splits, folds, batches and ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkline.operators.ranks import rank_within, spread


def hash_share(ident: Column | str, seed: int = 0, parts: int = 1000) -> Column:
    """A fixed pseudo-random number 0..parts-1 of an integer id, the same in SQL: no shuffle, no state."""
    x = (F.col(ident) if isinstance(ident, str) else ident).cast("long") + seed * 7919
    return F.pmod(F.pmod(x, F.lit(1_000_003)) * 48271 % 2_147_483_647, F.lit(parts)).cast("int")


def random_split(df: DataFrame, ident: str, test: float = 0.1, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Column split: test, val or train by the hash of the id."""
    h = hash_share(ident, seed)
    return df.withColumn("split", F.when(h < int(test * 1000), "test").when(h < int((test + val) * 1000), "val").otherwise("train"))


def stratified_split(df: DataFrame, label: str, ident: str, test: float = 0.1, val: float = 0.05, seed: int = 42) -> DataFrame:
    """Column split: of each label the first floor(test n) rows in hash order are test, the next floor(val n) val.

    A hot label is ranked in parts of the hash, each by its own task.
    """
    h = hash_share(ident, seed, 1_000_003)
    rows = rank_within(df, [label], [h, F.col(ident)], spread(h, 1_000_003), "__r")
    n = df.groupBy(label).agg(F.count("*").alias("__n")).withColumnRenamed(label, "__l")
    t, v = F.floor(F.col("__n") * test), F.floor(F.col("__n") * val)
    rows = rows.join(n, F.col(label).eqNullSafe(F.col("__l")))
    return rows.withColumn("split", F.when(F.col("__r") < t, "test").when(F.col("__r") < t + v, "val").otherwise("train")).drop("__r", "__n", "__l")


def group_split(df: DataFrame, group: str, groups: dict[str, list[str]]) -> DataFrame:
    """Column split by lists of groups; groups on no list get null."""
    table = F.create_map(*[F.lit(x) for s, gs in groups.items() for g in gs for x in (g, s)])
    return df.withColumn("split", F.try_element_at(table, F.col(group)))


def fraction_split(df: DataFrame, ident: str, fraction: float, seed: int = 42) -> DataFrame:
    """Column part: the first rows in hash order 'a', the others 'b', at least one row on either side.

    Ranks come from parts of the hash and their counts, so no task orders all rows.
    """
    n = df.count()
    k = max(1, min(n - 1, int(n * fraction)))
    h = hash_share(ident, seed, 1_000_003)
    rows = rank_within(df, [], [h, F.col(ident)], spread(h, 1_000_003), "__r")
    return rows.withColumn("part", F.when(F.col("__r") < k, "a").otherwise("b")).drop("__r")


def leave_one_out(df: DataFrame, group: str, label: str, least_train: int = 5, least_classes: int = 2) -> DataFrame:
    """Folds that hold one group out: group, train, test, classes, usable, from counts alone.

    Samples of a fold need no copy: its training rows are all rows of other groups.
    """
    per = df.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    whole = per.groupBy(label).agg(F.sum("n").alias("total"))
    groups = per.groupBy(group).agg(F.sum("n").alias("test"))
    n = per.agg(F.sum("n")).first()[0] or 0
    kinds = whole.count()
    # A class is missing from a fold's training rows if the group holds all of it.
    gone = per.join(whole, label).filter("n = total").groupBy(group).agg(F.count("*").alias("gone"))
    out = groups.join(gone, group, "left").na.fill(0, ["gone"])
    out = out.withColumn("train", F.lit(n) - F.col("test")).withColumn("classes", F.lit(kinds) - F.col("gone"))
    usable = (F.col("train") >= least_train) & (F.col("test") > 0) & (F.col("classes") >= least_classes)
    return out.select(group, "train", "test", "classes", usable.alias("usable"))


def balanced_batches(df: DataFrame, label: str, ident: str, per_class: int) -> DataFrame:
    """Column batch: each batch holds ``per_class`` rows of every class, in order of an integer id.

    What exceeds the smallest class is left out. A hot class is ranked in ranges of the id.
    """
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    lo, hi = df.agg(F.min(ident), F.max(ident)).first()
    salt = spread(F.col(ident) - F.lit(lo or 0), (hi or 0) - (lo or 0) + 1)
    b = F.floor(F.col("__r") / per_class)
    return rank_within(df, [label], [F.col(ident)], salt, "__r").withColumn("batch", b).drop("__r").filter(F.col("batch") < least // per_class)


def first_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of the groups that have at least k."""
    w = Window.partitionBy(*group)
    rows = df.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return rows.filter((F.col("_k") <= k) & (F.col("_n") >= k)).drop("_k", "_n")


def assign_reviewers(df: DataFrame, group: list[str], order: list[Column], reviewers: list[str], each: int = 2) -> DataFrame:
    """Round robin: row i of a group goes to reviewers i, i + 1, ... of the list."""
    i = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    rows = df.withColumn("_i", i).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    names = F.array(*map(F.lit, reviewers))
    return rows.withColumn("reviewer", F.element_at(names, (F.pmod(F.col("_i") + F.col("_j"), F.lit(len(reviewers))) + 1).cast("int"))).drop("_i", "_j")
