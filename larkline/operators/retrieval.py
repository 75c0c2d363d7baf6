"""Top-k search by cosine similarity of a stated query set against all rows, in blocks."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkline.core import cut

#: Queries whose vectors travel in one broadcast: with 1,024 numbers each, at most 16 MB.
BLOCK = 2048


def top_k(base: DataFrame, queries: DataFrame, ident: str, vector: str, k: int, skip_self: bool = True) -> DataFrame:
    """query, neighbour, cosine, rank of the k nearest base rows; ties by the smaller id.

    Queries come in blocks of bounded size, one at a time in the driver; every task keeps k candidates
    of each query, so a query sends k rows a task to the final ranking. Null or zero vectors match
    nothing. Where there are several blocks, each one's result is written to the shared folder.
    """
    spark = base.sparkSession
    stream = queries.select(F.col(ident), vector).filter(F.col(vector).isNotNull()).toLocalIterator()
    kind, found, shared = dict(base.dtypes)[ident], None, None
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    while rows := [(r[0], r[1]) for r in islice(stream, BLOCK)]:
        if found is not None:
            # The block before is done with: written, and its vectors let go.
            found = cut(found)
            shared.unpersist()
        q = np.array([v for _, v in rows], dtype=float)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast(([i for i, _ in rows], q))

        def search(batches, shared=shared):
            ids, q = shared.value
            best: list[list[tuple[float, object]]] = [[] for _ in ids]
            for b in batches:
                own = b.column(0).to_pylist()
                x = np.array(b.column(1).to_pylist(), dtype=float)
                n = np.linalg.norm(x, axis=1)
                s = np.round((x / np.maximum(n, 1e-300)[:, None]) @ q.T, 9)
                s[n == 0] = -np.inf
                for j, qid in enumerate(ids):
                    c = s[:, j]
                    take = min(len(c), k + 1)
                    low = np.partition(c, -take)[-take]
                    top = [(-c[i], own[i]) for i in np.flatnonzero(c >= low) if c[i] > -np.inf and not (skip_self and own[i] == qid)]
                    best[j] = sorted(best[j] + top)[:k]
            cols = [[ids[j] for j, h in enumerate(best) for _ in h], [i for h in best for _, i in h], [float(-c) for h in best for c, _ in h]]
            yield pa.RecordBatch.from_arrays([pa.array(c) if c else pa.array([], pa.int64() if n < 2 else pa.float64()) for n, c in enumerate(cols)], names=["query", "neighbour", "cosine"])

        part = base.filter(F.col(vector).isNotNull()).select(ident, vector).mapInArrow(search, f"query {kind}, neighbour {kind}, cosine double")
        part = part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.limit(0).select(F.col(ident).alias("query"), F.col(ident).alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank"))
    return found
