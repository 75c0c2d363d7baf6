"""Hooks for models, and closed-form and Spark ML regression by fold."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkline.functions import arrays

#: Evaluation functions by dataset: each makes a metric column of truth and guess.
EVALUATORS: dict[str, Callable[[Column, Column], Column]] = {}


def evaluator(name: str):
    """Register an evaluation function; the registry holds column expressions, so they run in the JVM."""

    def keep(f: Callable[[Column, Column], Column]):
        EVALUATORS[name] = f
        return f

    return keep


@evaluator("exact")
def exact(truth: Column, guess: Column) -> Column:
    return F.coalesce((truth == guess).cast("double"), F.lit(0.0))


@evaluator("first_three")
def first_three(truth: Column, guess: Column) -> Column:
    return F.coalesce((F.left(truth, F.lit(3)) == F.left(guess, F.lit(3))).cast("double"), F.lit(0.0))


def evaluate(df: DataFrame, dataset: str, truth: str, guess: str) -> DataFrame:
    """Mean of the dataset's metric times 100, missing counted as 0."""
    return df.agg(F.count("*").alias("n"), (F.avg(EVALUATORS[dataset](F.col(truth), F.col(guess))) * 100).alias("score"))


def generate(df: DataFrame, prompt: str, model: Callable[[list[str]], list[str]] | None = None, out: str = "generated") -> DataFrame:
    """A column of model answers, by Arrow batches; without a model the prompt's text itself."""
    if model is None:
        return df.withColumn(out, F.trim(prompt))
    import pandas as pd

    @F.pandas_udf("string")
    def call(p: pd.Series) -> pd.Series:
        return pd.Series(model(p.fillna("").tolist()))

    return df.withColumn(out, call(prompt))


def regressors(rows: int, spread: float = 1.0, features: str = "features", label: str = "label", seed: int = 42) -> dict:
    """Regressors by name, linear ones on standardised features. Their fits are Spark's own, over all rows.

    ``a`` weighs the squares against the sum of squared errors, as in ridge_by_group; Spark's penalty
    stands beside their mean over a target of deviation one, hence the number of rows and the target's spread.
    """
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    scaled = StandardScaler(inputCol=features, outputCol="scaled", withMean=True)
    own, plain = {"labelCol": label, "featuresCol": "scaled"}, {"labelCol": label, "featuresCol": features, "seed": seed}
    linear = {f"Ridge(a={a:g})": LinearRegression(regParam=a * spread / rows, elasticNetParam=0.0, **own) for a in (0.1, 1.0, 10.0)}
    linear["Lasso(a=0.1)"] = LinearRegression(regParam=0.1, elasticNetParam=1.0, maxIter=200, **own)
    return {k: _pipeline(scaled, m) for k, m in linear.items()} | {
        "RF(100)": _pipeline(RandomForestRegressor(numTrees=100, **plain)), "GBR(100)": _pipeline(GBTRegressor(maxIter=100, maxDepth=3, **plain)),
    }


def classifiers(rows: int, features: str = "features", label: str = "label", seed: int = 42) -> dict:
    """Classifiers by name; ``C`` weighs the sum of losses over ``rows``, Spark's penalty stands beside their mean.

    Margins with kernels have no counterpart, the linear one stands for them.
    """
    from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler

    scaled = StandardScaler(inputCol=features, outputCol="scaled", withMean=True)
    own, plain = {"labelCol": label, "featuresCol": "scaled"}, {"labelCol": label, "featuresCol": features}
    linear = {f"LogReg(C={c:g})": LogisticRegression(regParam=1 / (c * rows), maxIter=200, **own) for c in (0.1, 1.0, 10.0)}
    linear["LinearSVC"] = OneVsRest(classifier=LinearSVC(regParam=1 / rows, maxIter=100, **own), **own)
    boosted = OneVsRest(classifier=GBTClassifier(maxIter=100, maxDepth=3, seed=seed, **plain), **plain)
    return {k: _pipeline(scaled, m) for k, m in linear.items()} | {"RF(200)": _pipeline(RandomForestClassifier(numTrees=200, seed=seed, **plain)), "GBC(100)": _pipeline(boosted)}


def _pipeline(*stages):
    from pyspark.ml import Pipeline

    return Pipeline(stages=list(stages))


#: Formatters of a series by model name: the first pattern that the name matches.
FORMATTERS: list[tuple[str, Callable[[Column], Column]]] = [
    (r"(?i)llama|gpt2|gemma", lambda x: arrays.digits(x)),
    (r".*", lambda x: arrays.two_decimals(x)),
]


def format_series(series: Column, model: Column) -> Column:
    """The series as text, by the formatter of the row's model."""
    out = F.when(F.lit(False), F.lit(""))
    for pattern, f in FORMATTERS:
        out = out.when(model.rlike(pattern), f(series))
    return out


class SeriesDataset(ABC):
    """What a question-answer dataset over series has to say of a row; each method gives a column."""

    @abstractmethod
    def rows(self, spark, folder: str) -> DataFrame: ...

    @abstractmethod
    def answer(self) -> Column: ...

    @abstractmethod
    def pre_prompt(self) -> Column: ...

    @abstractmethod
    def post_prompt(self) -> Column: ...

    @abstractmethod
    def series(self) -> Column:
        """Array of (text, values), one a series."""

    def samples(self, spark, folder: str, ident: str, end: str = "") -> DataFrame:
        """ident, prompt (before, series texts, after), answer with the end mark; rows without an answer are left out."""
        inner = F.array_join(F.transform(self.series(), lambda s: s["text"]), "\n")
        prompt = F.concat_ws("\n", self.pre_prompt(), inner, self.post_prompt())
        return self.rows(spark, folder).filter(self.answer().isNotNull()).select(ident, prompt.alias("prompt"), F.concat(self.answer(), F.lit(end)).alias("answer"))


def ridge_by_group(df: DataFrame, group: str, features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """Leave-one-group-out ridge with standardised features: group, n, mse of its held-out rows.

    Only the sums behind the normal equations are shuffled, one row a group, so a fold is the total
    minus its group's own sums; no sample is copied into folds.
    """
    rows = df.select(group, *features, target).dropna()
    k = len(features)
    cols = [F.lit(1.0), *map(F.col, features), F.col(target)]
    sums = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k + 2) for j in range(i, k + 2)]
    got = rows.groupBy(group).agg(*sums)
    names = [f"s{i}_{j}" for i in range(k + 2) for j in range(i, k + 2)]
    total = [x or 0.0 for x in got.agg(*[F.sum(n) for n in names]).first()]  # one row

    def matrices(values: np.ndarray) -> np.ndarray:
        m = np.zeros((len(values), k + 2, k + 2))
        at = 0
        for i in range(k + 2):
            for j in range(i, k + 2):
                m[:, i, j] = m[:, j, i] = values[:, at]
                at += 1
        return m

    def solve(batches):
        whole = matrices(np.array([total], float))[0]
        for b in batches:
            own_all = matrices(np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], 1).astype(float))
            out: list[list] = [[], [], []]
            for r, own in enumerate(own_all):
                m = whole - own
                n = m[0, 0]
                if n < 5 or own[0, 0] == 0:
                    continue
                mean = m[0, 1:] / n
                cov = m[1:, 1:] / n - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
                sd[sd == 0] = 1.0
                z = cov[:k, :k] / np.outer(sd, sd)
                w = np.linalg.solve(z * n + alpha * np.eye(k), cov[:k, k] / sd * n) / sd
                intercept = mean[k] - mean[:k] @ w
                coef = np.concatenate(([intercept], w, [-1.0]))
                for x, y in zip(out, (r, int(own[0, 0]), float(coef @ own @ coef / own[0, 0])), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([b.column(group).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=[group, "n", "mse"])

    return got.mapInArrow(solve, f"`{group}` {dict(rows.dtypes)[group]}, n long, mse double")
