"""Mixing sources to target shares of all tokens, small ones repeated up to a cap.

Documents are counted by exact token length; each source's budget is met by whole
passes, a proportional draw from every length, and, for what remains, bounded
subset sums over the lengths left. Seeded ranks within a length decide which
documents a draw takes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkline.core import cut, source_name
from larkline.llm.ranks import rank_within
from larkline.llm.tokens import VOCABULARY, token_lengths

#: Tokens that the dynamic programme may have to fill; what exceeds it is taken greedily before.
WINDOW = 1 << 16


def subset_sum(counts: dict[int, int], target: int) -> dict[int, int]:
    """Items by length whose sum is the largest reachable one within ``target``, bounded by the counts."""
    mask = (1 << (target + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], target // length)
        power = 1
        while left > 0:
            take = min(power, left)
            steps.append((reach, length, take))
            reach |= reach << (length * take) & mask
            left, power = left - take, power * 2
        if reach >> target & 1:
            break
    best, out = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> best & 1:
            best -= length * take
            out[length] = out.get(length, 0) + take
    return out


def fit_budget(counts: dict[int, int], budget: int, max_repeats: int, seed: int = 7) -> tuple[int, dict[int, int]]:
    """Whole passes over a source and the extra documents by length that bring it closest to its budget.

    The extra draw takes every length in proportion, rounded at random, so that it looks like the
    source; only the small remainder is fitted exactly.
    """
    whole = sum(k * n for k, n in counts.items())
    if not whole or max_repeats < 1 or budget <= 0:
        return 0, {}
    passes = min(max_repeats, budget // whole)
    rest = budget - passes * whole
    if passes == max_repeats or not rest:
        return passes, {}
    rng, lengths = np.random.default_rng(seed), np.array(sorted(counts))
    rng.shuffle(lengths)
    # What the draw leaves open gives the exact fit room to choose.
    slack, extra = min(WINDOW // 8, rest // 4), dict.fromkeys(counts, 0)
    share = (rest - slack) / whole
    for k in lengths.tolist():
        x = counts[k] * share
        n = min(int(x) + int(rng.random() < x - int(x)), max(0, rest - slack) // k)
        extra[k], rest = n, rest - n * k
    left = {k: counts[k] - n for k, n in extra.items() if counts[k] > n}
    for k in lengths.tolist():
        if rest <= WINDOW:
            break
        n = min(left.get(k, 0), (rest - WINDOW // 2) // k)
        if n > 0:
            extra[k], left[k], rest = extra[k] + n, left[k] - n, rest - n * k
    for k, n in subset_sum({k: n for k, n in left.items() if n and k <= rest}, min(rest, WINDOW)).items():
        extra[k] += n
    return passes, {k: n for k, n in extra.items() if n}


def mix_sources(
    documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
    total_tokens: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """The documents of the mixture: ``id_col``, source, tokens, repeats (at least 1).

    Without ``total_tokens`` the mixture is the largest in which every source that has texts can
    hold its share; with it, a source whose repeats do not suffice falls short and the others keep
    their budgets.

    Defined cases: sources are compared in lower case with underscores; texts whose source is
    null, blank or no target, and texts without tokens, are not drawn; targets with a null or
    non-positive share or fewer than one repeat draw nothing; ids may repeat, each row counts;
    other columns are ignored; an empty table gives no rows. The driver gets the counts by source
    and exact length, bounded by the longest text's tokens a source.
    """
    rows = documents.select(F.col(id_col).alias("id"), source_name(source).alias("source"), F.col(text).alias("text"))
    lengths = cut(token_lengths(rows, ["id", "source"], "text", vocabulary)).filter("tokens > 0")
    want = {
        r[0]: (float(r[1]), int(r[2]))
        for r in targets.select(source_name("source"), "target_share", "max_repeats").dropna().collect()
        if r[1] > 0 and r[2] >= 1
    }
    counts: dict[str, dict[int, int]] = {}
    known = lengths.filter(F.col("source").isin(*want)) if want else lengths.limit(0)
    for r in known.groupBy("source", "tokens").count().collect():
        counts.setdefault(r[0], {})[r[1]] = r[2]
    size = {s: sum(k * n for k, n in c.items()) for s, c in counts.items()}
    share = sum(want[s][0] for s in counts) or 1.0
    total = total_tokens
    if total is None:
        total = min((int(size[s] * want[s][1] * share / want[s][0]) for s in counts), default=0)
    plans = {s: fit_budget(c, round(total * want[s][0] / share), want[s][1], seed) for s, c in counts.items()}
    shared = documents.sparkSession.sparkContext.broadcast(plans)
    mix = F.xxhash64(F.lit(seed), F.col("id"))
    ranked = rank_within(known, ["source", "tokens"], [mix, F.col("id")], mix, "rank")
    kind = dict(rows.dtypes)["id"]

    def draw(batches):
        for b in batches:
            rank, size = b.column("rank").to_numpy(), b.column("tokens").to_numpy()
            plan = [shared.value[s] for s in b.column("source").to_pylist()]
            n = np.array([p + (r < extra.get(int(k), 0)) for (p, extra), r, k in zip(plan, rank, size, strict=True)], np.int32)
            at = pa.array(np.flatnonzero(n))
            cols = [b.column(c).take(at) for c in ("id", "source", "tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n).take(at)], names=["id", "source", "tokens", "repeats"])

    return ranked.mapInArrow(draw, f"id {kind}, source string, tokens int, repeats int").withColumnRenamed("id", id_col)


def mixture_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share, tokens and repeats of each target source; shares are of all tokens mixed."""
    got = mixture.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats")
    )
    want = targets.select(source_name("source").alias("source"), "target_share", "max_repeats")
    # One row a source by now, so one window holds them all.
    return want.join(got, "source", "left").withColumn("total", F.sum("tokens").over(Window.partitionBy())).select(
        "source", "target_share", "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(F.coalesce("tokens", F.lit(0)) / F.col("total"), 6).alias("actual_share"),
    )
