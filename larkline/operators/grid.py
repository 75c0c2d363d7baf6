"""Irregular readings onto a one-second grid, missing cells filled by low-rank factors.

The source-by-time matrix has a row per recording and a column per channel and
second since the recording's first cell. It is kept in blocks of ``BLOCK`` seconds of
one recording, so no recording is ever one row. Alternating least squares fits rank
``rank`` factors: the row step solves small normal equations, summed over the blocks of
recordings that have several; the column step sums such equations over all recordings.
Only columns that at least ``min_rows`` recordings hold can be filled, and only their
factors reach the driver: the seconds that many recordings share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkline.core import cut, finite, interview_type

KEY = ("patient_id", "subject_role", "interview_type")

#: Seconds of a block of the matrix.
BLOCK = 256

CHUNK = 1024

NONE = "\0"


def observed_cells(frames: DataFrame, channels: tuple[str, ...], min_confidence: float) -> DataFrame:
    """Mean of each channel per recording and whole second, over usable readings counted once.

    Columns: KEY, cell, v0.., first and last cell of the recording.
    """
    d = len(channels)
    rows = (
        frames.filter((F.col("success") == 1) & (F.col("confidence") >= min_confidence))
        .select(
            # Null ids stand together as one recording; a mark keeps them through the joins.
            *[F.coalesce(c, F.lit(NONE)).alias(k) for k, c in zip(KEY, (*map(F.col, KEY[:2]), interview_type("interview_type")), strict=True)],
            F.col("frame").alias("frame"),
            finite("ts_s").alias("t"),
            *[finite(c).alias(f"v{i}") for i, c in enumerate(channels)],
        )
        .dropna(subset=["t", *[f"v{i}" for i in range(d)]])
        .distinct()
    )
    sums = [F.sum(f"v{i}").alias(f"v{i}") for i in range(d)]
    raw = rows.groupBy(*KEY, F.floor("t").alias("cell")).agg(*sums, F.count("*").alias("n"))
    # A recording lasts minutes; a span above 1000 is in milliseconds.
    span = raw.groupBy(*KEY).agg(F.min("cell").alias("first"), F.max("cell").alias("last"))
    unit = F.when(F.col("last") - F.col("first") > 1000, 1000).otherwise(1)
    both = raw.join(span.select(*KEY, unit.alias("unit"), F.floor(F.col("first") / unit).alias("first"), F.floor(F.col("last") / unit).alias("last")), list(KEY))
    cells = both.groupBy(*KEY, "first", "last", F.floor(F.col("cell") / F.col("unit")).alias("cell")).agg(*sums, F.sum("n").alias("n"))
    return cells.select(*KEY, "first", "last", "cell", *[(F.col(f"v{i}") / F.col("n")).alias(f"v{i}") for i in range(d)])


def _blocks(cells: DataFrame, d: int, low: float, high: float) -> DataFrame:
    """A row a recording and block: first, last, block, r (its cells), the recording's sums and counts to fit."""
    fits = [(F.col(f"v{i}") >= low) & (F.col(f"v{i}") <= high) for i in range(d)]
    of_all = [x for i, ok in enumerate(fits) for x in (F.sum(F.when(ok, F.col(f"v{i}"))).alias(f"s{i}"), F.count(F.when(ok, 1)).alias(f"c{i}"))]
    block = F.floor((F.col("cell") - F.col("first")) / BLOCK).alias("block")
    own = cells.groupBy(*KEY, "first", "last", block).agg(
        F.sort_array(F.collect_list(F.struct("cell", *[f"v{i}" for i in range(d)]))).alias("r"), *of_all
    )
    # Recordings of one block have their sums at hand; those of several take them from all of theirs.
    many = F.col("last") - F.col("first") >= BLOCK
    own = cut(own)
    several = own.filter(many)
    if several.isEmpty():
        return own
    names = [f"{x}{i}" for i in range(d) for x in "sc"]
    total = several.groupBy(*KEY, "first", "last").agg(*[F.sum(x).alias(x) for x in names])
    every = total.withColumn("block", F.explode(F.expr(f"sequence(0L, cast((last - first) div {BLOCK} as bigint))")))
    joined = every.join(several.select(*KEY, "block", "r"), [*KEY, "block"], "left")
    return own.filter(~many).unionByName(joined.withColumn("r", F.coalesce("r", F.array().cast(dict(own.dtypes)["r"]))).select(own.columns))


def _dense(batch: pa.RecordBatch, d: int, low: float, high: float):
    """Of each row: its cells, values, the matrix rows, the mask of cells to fit, the recording's means and counts."""
    lists = batch.column("r")
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
    flat = lists.flatten()
    cell = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    vals = np.stack([flat.field(1 + i).to_numpy(zero_copy_only=False) for i in range(d)])
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    start = batch.column("first").to_numpy() + batch.column("block").to_numpy() * BLOCK
    rel = cell - start[row]
    n = np.stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(d)], 1)
    total = np.stack([batch.column(f"s{i}").fill_null(0.0).to_numpy(zero_copy_only=False) for i in range(d)], 1)
    mean = total / np.maximum(n, 1)
    z, m = np.zeros((batch.num_rows, d * BLOCK)), np.zeros((batch.num_rows, d * BLOCK))
    for i in range(d):
        ok = (vals[i] >= low) & (vals[i] <= high)
        z[row[ok], i * BLOCK + rel[ok]] = vals[i][ok] - mean[row[ok], i]
        m[row[ok], i * BLOCK + rel[ok]] = 1
    return cell, vals, ends, start, z, m, mean, n


def _equations(z: np.ndarray, m: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = v.shape[1]
    return (m @ (v[:, :, None] * v[:, None, :]).reshape(len(v), r * r)).reshape(-1, r, r), z @ v


class Factors:
    """Column factors by block; columns outside ``count`` have none."""

    def __init__(self, d: int, rank: int) -> None:
        self.d, self.rank = d, rank
        self.v: dict[int, np.ndarray] | None = None
        self.count: dict[int, np.ndarray] = {}

    def of(self, block: int) -> np.ndarray:
        if self.v is None:  # the start: slow waves
            k = (np.arange(BLOCK) + 0.5) / BLOCK
            return np.concatenate([np.stack([np.cos(np.pi * j * 2 * k) for j in range(1, self.rank + 1)], 1)] * self.d)
        got = self.v.get(block)
        return np.zeros((self.d * BLOCK, self.rank)) if got is None else got

    def seen(self, block: int) -> np.ndarray:
        got = self.count.get(block)
        return np.zeros(self.d * BLOCK) if got is None else got

    def rows(self, batch: pa.RecordBatch, z: np.ndarray, m: np.ndarray, reg: float) -> np.ndarray:
        """Row factors: those the batch brings (``u``), else from the row itself."""
        out = np.zeros((len(z), self.rank))
        brought = batch.column("u").is_valid().to_numpy(zero_copy_only=False)
        if brought.any():
            out[brought] = np.array(batch.column("u").filter(pa.array(brought)).to_pylist())
        blocks = batch.column("block").to_numpy()
        for b in np.unique(blocks[~brought]):
            at = np.flatnonzero((blocks == b) & ~brought)
            a, y = _equations(z[at], m[at], self.of(b))
            out[at] = np.linalg.solve(a + reg * np.eye(self.rank), y[:, :, None])[:, :, 0]
        return out


def _trust(z: np.ndarray, m: np.ndarray, v: np.ndarray, u: np.ndarray, reg: float, d: int) -> np.ndarray:
    """How far each row may follow its factors, 0 to 1 a channel: the best scale of its leave-one-out predictions.

    Where the factors say nothing of a cell that its other cells do not, the row stays at its mean.
    """
    a, _ = _equations(z, m, v)
    inverse = np.linalg.inv(a + reg * np.eye(v.shape[1]))
    lever = np.minimum(np.einsum("cr,krs,cs->kc", v, inverse, v, optimize=True), 0.99)
    alone = (z - (z - u @ v.T) / (1 - lever)) * m
    up, down = ((x.reshape(len(z), d, BLOCK)).sum(2) for x in (z * alone, alone * alone))
    return np.clip(up / np.maximum(down, 1e-12), 0, 1)


def _with_rows(packed: DataFrame, f: Factors, reg: float, low: float, high: float, several: bool) -> DataFrame:
    """``packed`` with u: row factors of the recordings of several blocks, null for the others."""
    none = F.lit(None).cast("array<double>").alias("u")
    if not several:
        return packed.select("*", none)
    r, many = f.rank, F.col("last") - F.col("first") >= BLOCK
    up = np.triu_indices(r)
    wide = len(up[0]) + r

    def part(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, CHUNK):
                some = batch.slice(s, CHUNK)
                _, _, _, _, z, m, _, _ = _dense(some, f.d, low, high)
                blocks, total = some.column("block").to_numpy(), np.zeros((some.num_rows, wide))
                for b in np.unique(blocks):
                    at = np.flatnonzero(blocks == b)
                    a, y = _equations(z[at], m[at], f.of(b))
                    total[at] = np.concatenate((a[:, up[0], up[1]], y), 1)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in KEY), *(pa.array(x) for x in total.T)], names=[*KEY, *(f"x{i}" for i in range(wide))])

    keys = "patient_id string, subject_role string, interview_type string"
    sums = packed.filter(many).mapInArrow(part, keys + "".join(f", x{i} double" for i in range(wide))).groupBy(*KEY).agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in range(wide)])

    def solve(batches):
        for batch in batches:
            x = np.stack([batch.column(f"x{i}").to_numpy() for i in range(wide)], 1) if batch.num_rows else np.zeros((0, wide))
            a = np.zeros((len(x), r, r))
            a[:, up[0], up[1]] = a[:, up[1], up[0]] = x[:, : len(up[0])]
            u = np.linalg.solve(a + reg * np.eye(r), x[:, len(up[0]) :, None])[:, :, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(u.tolist(), pa.list_(pa.float64()))], names=[*KEY, "u"])

    u = sums.mapInArrow(solve, f"{keys}, u array<double>")
    return packed.filter(~many).select("*", none).unionByName(packed.filter(many).join(u, list(KEY)).select(*packed.columns, "u"))


def _fit(packed: DataFrame, d: int, rank: int, reg: float, col_reg: float, rounds: int, min_rows: int, low: float, high: float, several: bool) -> Factors:
    f = Factors(d, rank)
    up = np.triu_indices(rank)
    wide = len(up[0]) + rank + 1
    for _ in range(rounds):

        def sums(batches, f=f):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for s in range(0, batch.num_rows, CHUNK):
                    some = batch.slice(s, CHUNK)
                    _, _, _, _, z, m, _, _ = _dense(some, d, low, high)
                    u, blocks = f.rows(some, z, m, reg), some.column("block").to_numpy()
                    for b in np.unique(blocks):
                        at = np.flatnonzero(blocks == b)
                        own = np.concatenate((m[at].T @ (u[at][:, up[0]] * u[at][:, up[1]]), z[at].T @ u[at], m[at].sum(0)[:, None]), 1)
                        total[b] = total[b] + own if b in total else own
            for b, x in total.items():
                at = np.flatnonzero(x[:, -1])
                yield pa.RecordBatch.from_arrays([pa.array(b * d * BLOCK + at), *(pa.array(y) for y in x[at].T)], names=["i", *(f"x{j}" for j in range(wide))])

        rows = _with_rows(packed, f, reg, low, high, several)
        got = rows.mapInArrow(sums, "i long" + "".join(f", x{j} double" for j in range(wide))).groupBy("i").agg(*[F.sum(f"x{j}").alias(f"x{j}") for j in range(wide)])
        got = got.filter(F.col(f"x{wide - 1}") >= min_rows).toArrow()
        x = np.stack([got.column(f"x{j}").to_numpy() for j in range(wide)], 1) if got.num_rows else np.zeros((0, wide))
        a = np.zeros((len(x), rank, rank))
        a[:, up[0], up[1]] = a[:, up[1], up[0]] = x[:, : len(up[0])]
        new = np.linalg.solve(a + col_reg * np.eye(rank), x[:, len(up[0]) : -1, None])[:, :, 0]
        i = got.column("i").to_numpy()
        g = Factors(d, rank)
        g.v = {}
        for b in np.unique(i // (d * BLOCK)):
            at = i // (d * BLOCK) == b
            g.v[b], g.count[b] = np.zeros((d * BLOCK, rank)), np.zeros(d * BLOCK)
            g.v[b][i[at] % (d * BLOCK)], g.count[b][i[at] % (d * BLOCK)] = new[at], x[at, -1]
        f = g
    return f


def regular_grid(
    frames: DataFrame,
    channels: tuple[str, ...] = ("au04_r", "au12_r"),
    low: float = 0.0,
    high: float = 5.0,
    min_confidence: float = 0.5,
    rank: int = 6,
    reg: float = 1.0,
    col_reg: float = 0.1,
    rounds: int = 4,
    min_rows: int = 16,
    only_missing: bool = False,
) -> DataFrame:
    """One row per recording and second from its first to its last usable reading.

    Result: patient_id, subject_role, interview_type, cell_s, the channels, status. ``observed``
    cells hold the exact mean of their readings; ``filled`` ones the low-rank estimate within
    low..high, drawn to the recording's mean as far as its own cells do not bear the factors out; ``unsupported`` ones null: fewer than 2 x ``rank`` observed cells in the recording
    or than ``min_rows`` recordings with that second. ``only_missing`` leaves observed cells out.

    Defined cases: a reading is usable if time and all channels are numbers (null, NaN, infinite
    are not), success is 1 and confidence at least ``min_confidence``; repeated rows count once;
    readings off the scale count as observed but are not fitted; recordings whose times span more
    than 1000 hold milliseconds; rows with null ids form a recording of their own; other columns are
    ignored; a recording without a usable reading, and an empty table, give no rows. Recordings of
    any length are treated alike.
    """
    d = len(channels)
    packed = _blocks(observed_cells(frames, channels, min_confidence), d, low, high)
    several = not packed.filter(F.col("last") - F.col("first") >= BLOCK).isEmpty()
    if several:
        packed = cut(packed)
    f = _fit(packed, d, rank, reg, col_reg, rounds, min_rows, low, high, several)
    schema = "patient_id string, subject_role string, interview_type string, cell_s int, " + "".join(f"{c} double, " for c in channels) + "status string"

    def fill(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(s, CHUNK)
                cell, vals, ends, start, z, m, mean, n = _dense(batch, d, low, high)
                u, last, blocks = f.rows(batch, z, m, reg), batch.column("last").to_numpy(), batch.column("block").to_numpy()
                trust = np.zeros((batch.num_rows, d))
                for b in np.unique(blocks):
                    own = np.flatnonzero(blocks == b)
                    trust[own] = _trust(z[own], m[own], f.of(b), u[own], reg, d)
                rows, at, status, value = [], [], [], []
                for k in range(batch.num_rows):
                    own = cell[ends[k] : ends[k + 1]] - start[k]
                    span = np.arange(min(BLOCK, last[k] + 1 - start[k]))
                    y = np.full((d, len(span)), np.nan)
                    y[:, own] = vals[:, ends[k] : ends[k + 1]]
                    kind = np.zeros(len(span), np.int8)
                    kind[own] = 1
                    gap = np.flatnonzero(kind == 0)
                    if len(gap) and (n[k] >= 2 * rank).all():
                        v, count = f.of(blocks[k]), f.seen(blocks[k])
                        gap = gap[np.all([count[i * BLOCK + gap] >= min_rows for i in range(d)], axis=0)]
                        for i in range(d):
                            y[i, gap] = np.clip(mean[k, i] + trust[k, i] * (v[i * BLOCK + gap] @ u[k]), low, high)
                        kind[gap] = 2
                    keep = np.flatnonzero(kind != 1) if only_missing else span
                    rows.append(np.full(len(keep), k))
                    at.append(span[keep] + start[k])
                    status.append(kind[keep])
                    value.append(y[:, keep])
                rows, value = np.concatenate(rows), np.concatenate(value, axis=1)
                names = pa.array(["unsupported", "observed", "filled"]).take(pa.array(np.concatenate(status).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(rows)) for c in KEY), pa.array(np.concatenate(at).astype(np.int32)),
                     *(pa.array(x, from_pandas=True) for x in value), names],
                    names=[*KEY, "cell_s", *channels, "status"],
                )

    out = _with_rows(packed, f, reg, low, high, several).mapInArrow(fill, schema)
    return out.withColumns({k: F.nullif(k, F.lit(NONE)) for k in KEY})


def grid_coverage(frames: DataFrame, **options) -> DataFrame:
    """Cells per recording and status."""
    return regular_grid(frames, **options).groupBy(*KEY, "status").agg(F.count("*").alias("cells"))
