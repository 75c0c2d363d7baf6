"""Gradient-boosted trees of depth two, fitted on all rows of a table and scored as a Spark column.

A split looks at a feature only through the thresholds tried, so rows that lie between the same
thresholds are alike to it. A table is fitted from the numbers of its rows in such cells: every row
counts, and what reaches the driver is bounded by the thresholds, not by the rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _split(at: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, edges: list[np.ndarray], rows: np.ndarray) -> tuple[int, int]:
    """Feature and threshold (left: at most that threshold's number) of the best gain among the cells, feature -1 for none."""
    best = (1e-9, -1, 0)
    gs, hs, ns = g[rows].sum(), h[rows].sum(), n[rows].sum()
    if ns < 20:
        return best[1:]
    for f, cuts in enumerate(edges):
        gl, hl, nl = (np.bincount(at[rows, f], v[rows], len(cuts) + 1).cumsum()[:-1] for v in (g, h, n))
        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
        gain[(nl < 10) | (nl > ns - 10)] = 0.0
        c = int(gain.argmax())
        if gain[c] > best[0]:
            best = (float(gain[c]), f, c)
    return best[1:]


def _fit(at: np.ndarray, y: np.ndarray, n: np.ndarray, edges: list[np.ndarray], rounds: int, rate: float) -> dict | None:
    """Logistic boosting over cells: the thresholds below each value, the class, the number of rows."""
    if n.sum() < 60 or y.min() == y.max():
        return None
    mean = float((n * y).sum() / n.sum())
    prior = float(np.log(mean / (1 - mean)))
    s, trees = np.full(len(y), prior), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-s))
        g, h = n * (y - p), n * p * (1 - p)
        f, c = _split(at, g, h, n, edges, np.arange(len(y)))
        if f < 0:
            break
        sides = []
        for side in (at[:, f] <= c, at[:, f] > c):
            rows = np.flatnonzero(side)
            f2, c2 = _split(at, g, h, n, edges, rows)
            leaves = []
            for leaf in [rows] if f2 < 0 else [rows[at[rows, f2] <= c2], rows[at[rows, f2] > c2]]:
                w = float(rate * g[leaf].sum() / (h[leaf].sum() + 1))
                s[leaf] += w
                leaves.append(w)
            sides.append((f2, 0.0 if f2 < 0 else float(edges[f2][c2]), leaves))
        trees.append((f, float(edges[f][c]), sides))
    return {"prior": prior, "trees": trees}


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.3, bins: int = 12) -> dict | None:
    """Logistic boosting; None for fewer than 60 rows or one class only."""
    if len(y) < 60:
        return None
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[:-1])) for f in range(x.shape[1])]
    at = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
    return _fit(at, y, np.ones(len(y)), edges, rounds, rate)


def fit_table(rows: DataFrame, features: list[str], y: str, rounds: int = 24, rate: float = 0.3, bins: int = 12) -> dict | None:
    """``fit`` on all rows of a table of doubles, without nulls.

    The thresholds are exact quantiles. At most ``bins`` thresholds a feature bound the cells that
    the driver gets.
    """
    rows = rows.select(*features, F.col(y).cast("int").alias("y")).persist()
    try:
        shares = np.linspace(0, 1, bins + 1)[:-1].tolist()
        found = rows.agg(*(F.percentile(f, F.array(*map(F.lit, shares))).alias(f) for f in features)).first()
        if found[0] is None:
            return None
        edges = [np.unique(found[f]) for f in features]

        def cells(batches):
            for b in batches:
                cell = np.zeros(b.num_rows, np.int64)
                for f, cuts in zip(features, edges, strict=True):
                    cell = cell * (bins + 1) + np.searchsorted(cuts, b.column(f).to_numpy())
                cell, n = np.unique(cell * 2 + b.column("y").to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

        got = rows.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    finally:
        rows.unpersist()
    cell, n = (got.column(c).to_numpy() for c in ("cell", "n"))
    order = cell.argsort()  # sums of floats in one order
    cell, y, n = cell[order] // 2, cell[order] % 2, n[order]
    at = np.stack([cell // (bins + 1) ** k % (bins + 1) for k in reversed(range(len(features)))], 1)
    return _fit(at, y.astype(float), n.astype(float), edges, rounds, rate)


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of the rows."""
    s = np.full(len(x), model["prior"])
    for f, c, sides in model["trees"]:
        for side, (f2, c2, leaves) in zip((x[:, f] <= c, x[:, f] > c), sides, strict=True):
            s[side] += leaves[0] if f2 < 0 else np.where(x[side, f2] <= c2, leaves[0], leaves[-1])
    return s


def score_column(model: dict, features: list[str]) -> Column:
    """Log odds as a column expression over the feature columns."""

    def leaf(f: int, c: float, leaves: list[float]) -> Column:
        return F.lit(leaves[0]) if f < 0 else F.when(F.col(features[f]) <= c, leaves[0]).otherwise(leaves[-1])

    trees = [F.when(F.col(features[f]) <= c, leaf(*a)).otherwise(leaf(*b)) for f, c, (a, b) in model["trees"]]
    return reduce(lambda p, q: p + q, trees, F.lit(model["prior"]))
