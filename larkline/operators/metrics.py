"""Classification, regression, voting and agreement metrics from one table of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_counts(df: DataFrame, gold: str, pred: str, by: list[str] | None = None, labels: list[str] | None = None, skip_unknown_gold: bool = False) -> DataFrame:
    """tp, fp, fn and support of each class.

    Without ``labels`` every label seen is a class. With them they are the classes, seeded even
    without a row, and a prediction outside them only counts as a miss; gold labels outside are
    classes too unless ``skip_unknown_gold`` leaves their rows out.
    """
    by = by or []
    rows = df.select(*by, F.col(gold).alias("g"), F.col(pred).alias("p")).filter("g is not null")
    if labels is not None and skip_unknown_gold:
        rows = rows.filter(F.col("g").isin(*labels))
    hit = F.col("g").eqNullSafe(F.col("p"))
    known = F.col("p").isin(*labels) if labels is not None else F.col("p").isNotNull()
    parts = F.array(
        F.struct(F.col("g").alias("class"), hit.cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (~hit).cast("long").alias("fn"), F.lit(1).cast("long").alias("support")),
        F.struct(F.when(known & ~hit, F.col("p")).alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(1).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("support")),
    )
    long = rows.select(*by, F.inline(parts)).filter("class is not null")
    if labels is not None:
        zero = [F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn", "support")]
        long = long.unionByName(rows.select(*by).distinct().select(*by, F.explode(F.array(*map(F.lit, labels))).alias("class"), *zero))
    return long.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")])


def with_f1(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of each class; 0 where undefined."""

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def averages(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """accuracy (over all rows), macro, weighted and micro F1, weighted precision and recall."""
    c = with_f1(counts)
    weight = lambda x: F.coalesce(F.try_divide(F.sum(F.col(x) * F.col("support")), F.sum("support")), F.lit(0.0))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return c.groupBy(*(by or [])).agg(
        F.coalesce(F.try_divide(tp, F.sum("support")), F.lit(0.0)).alias("accuracy"), F.avg("f1").alias("macro_f1"), weight("f1").alias("weighted_f1"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("micro_f1"), weight("precision").alias("weighted_precision"), weight("recall").alias("weighted_recall"),
    )


def confusion(df: DataFrame, gold: str, pred: str, labels: list[str]) -> DataFrame:
    """Counts of every gold and predicted label of the list, zeros included."""
    got = df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    one = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "gold string, pred string")
    return one.join(got, ["gold", "pred"], "left").na.fill(0, ["n"])


def regression(df: DataFrame, truth: str, guess: str, by: list[str] | None = None) -> DataFrame:
    """n, mse, mae, r2 and Pearson r; r is 0 where n <= 2 or a spread is at most 1e-12."""
    rows = df.select(*(by or []), F.col(truth).alias("y"), F.col(guess).alias("x")).dropna(subset=["y", "x"])
    e = F.col("y") - F.col("x")
    sx, sy = F.stddev_pop("x"), F.stddev_pop("y")
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count("*"))).alias("r2"),
        F.when((F.count("*") > 2) & (sx > 1e-12) & (sy > 1e-12), F.try_divide(F.covar_pop("x", "y"), sx * sy)).otherwise(0.0).alias("r"),
    )


def majority(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """Most frequent label of each key, ties to the larger label: key, label, votes."""
    per = df.filter(F.col(label).isNotNull()).groupBy(*key, label).agg(F.count("*").alias("n"))
    return per.groupBy(*key).agg(F.max(F.struct("n", label)).alias("b")).select(*key, F.col(f"b.{label}").alias(label), F.col("b.n").alias("votes"))


def roc_auc(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from counts by distinct score, ties half."""
    by = by or []
    per = df.groupBy(*by, score).agg(F.sum(positive).alias("p"), F.sum(1 - F.col(positive)).alias("q"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0)))
    return per.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))


def six_statistics(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """mean, std (population), max, min, range and median of each key."""
    v = F.col(value)
    return df.groupBy(*key).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"), (F.max(v) - F.min(v)).alias("range"), F.percentile(v, 0.5).alias("median")
    )


def mean_vectors(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """Element-wise mean of equally long arrays: key, vector."""
    long = df.select(*key, F.posexplode(vector).alias("i", "v")).groupBy(*key, "i").agg(F.avg("v").alias("v"))
    rows = F.sort_array(F.collect_list(F.struct("i", "v")))
    return long.groupBy(*key).agg(F.transform(rows, lambda x: x["v"]).alias("vector"))


def value_shares(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """Counts of each label and their percentage of the key's rows."""
    n = df.groupBy(*key, label).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(*key)), 6))


def discover_targets(df: DataFrame, name: str, value: str, ratio: float = 0.99) -> DataFrame:
    """Labels of a long table typed by their values: regression, classification, or none.

    A label is a regression target if at least ``ratio`` of its values are finite numbers, else a
    classification target if it has two classes or more. Columns: name, task, n, classes.
    """
    from larkline.operators.clean import finite_or_null

    rows = df.filter(F.col(value).isNotNull())
    got = rows.groupBy(name).agg(F.count("*").alias("n"), F.avg(finite_or_null(value).isNotNull().cast("double")).alias("numeric"), F.count_distinct(value).alias("classes"))
    task = F.when(F.col("numeric") >= ratio, "regression").when(F.col("classes") >= 2, "classification").otherwise("none")
    return got.select(name, task.alias("task"), "n", "classes")


def consensus(df: DataFrame, question: str, answer: str, guess: str, needed: int = 3) -> DataFrame:
    """Per question min(1, matches / needed), averaged with each annotator left out once."""
    per = df.groupBy(question).agg(F.count("*").alias("n"), F.sum((F.col(answer) == F.col(guess)).cast("long")).alias("m"))
    m, n = F.col("m"), F.col("n")
    one = F.least(F.lit(1.0), (m - 1) / needed) * m + F.least(F.lit(1.0), m / needed) * (n - m)
    return per.select(question, F.when(n > 0, one / n).alias("score"))
