"""Queries of the core's training-data operators: grid, intervals, faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkline.core import table
from larkline.operators import grid, intervals, spikes
from larkline.plans.base import TYPE_SQL
from larkline.plans.registry import Registry

R = Registry()

USABLE_SQL = f"""usable as (select distinct patient_id, subject_role, {TYPE_SQL} as itype, frame, ts_s, au04_r, au12_r from frames
 where success = 1 and confidence >= 0.5 and ts_s is not null and au04_r is not null and au12_r is not null),
unit as (select patient_id, subject_role, itype, case when max(ts_s) - min(ts_s) > 1000 then 1000 else 1 end as u from usable group by all),
cells as (select patient_id, subject_role, itype, cast(floor(ts_s / u) as int) as cell, avg(au04_r) as au04_r, avg(au12_r) as au12_r
 from usable join unit using (patient_id, subject_role, itype) group by all),
steps as (select *, lead(cell) over (partition by patient_id, subject_role, itype order by cell) as nxt from cells)"""

TIMES_SQL = """rows as (select distinct session_id, least(start_s, end_s) as a, greatest(start_s, end_s) as b from turns
 where start_s is not null and end_s is not null and session_id is not null),
unit as (select session_id, case when max(b) > 4000 then 1 else 1000 end as u from rows group by 1),
times as (select session_id, cast(round(a * u) as bigint) as lo, cast(round(b * u) as bigint) as hi from rows join unit using (session_id)),
spans as (select * from times where hi > lo union all select session_id, min(lo), min(lo) from times group by 1 union all select session_id, max(hi), max(hi) from times group by 1),
ended as (select *, max(hi) over (partition by session_id order by lo, hi rows between unbounded preceding and 1 preceding) as e from spans)"""


@R.add(
    "p2_found",
    f"""with {USABLE_SQL}
select patient_id, subject_role, itype as interview_type, cast(unnest(range(cell + 1, nxt)) as int) as cell_s from steps where nxt > cell + 1""",
)
def p2_found(spark, sf_dir):
    return grid.regular_grid(table(spark, sf_dir, "frames"), only_missing=True).select(*grid.KEY, "cell_s")


@R.add(
    "p2_observed",
    f"""with {USABLE_SQL}
select patient_id, subject_role, itype as interview_type, cell as cell_s, round(au04_r, 6) as au04_r, round(au12_r, 6) as au12_r from cells""",
)
def p2_observed(spark, sf_dir):
    found = grid.regular_grid(table(spark, sf_dir, "frames")).filter("status = 'observed'")
    return found.select(*grid.KEY, "cell_s", F.round("au04_r", 6).alias("au04_r"), F.round("au12_r", 6).alias("au12_r"))


@R.add(
    "p2_coverage",
    f"""with {USABLE_SQL}, f as (select patient_id, subject_role, itype, min(cell) as f, count(*) filter (au04_r between 0 and 5) as n04, count(*) filter (au12_r between 0 and 5) as n12 from cells group by all),
c as (select cell - f as rel, count(*) filter (au04_r between 0 and 5) as c04, count(*) filter (au12_r between 0 and 5) as c12 from cells join f using (patient_id, subject_role, itype) group by 1),
gap as (select patient_id, subject_role, itype, cast(unnest(range(cell + 1, nxt)) as int) as cell from steps where nxt > cell + 1),
st as (select patient_id, subject_role, itype, 'observed' as status from cells
 union all select patient_id, subject_role, itype, case when n04 >= 12 and n12 >= 12 and coalesce(c04, 0) >= 16 and coalesce(c12, 0) >= 16 then 'filled' else 'unsupported' end
 from gap join f using (patient_id, subject_role, itype) left join c on c.rel = gap.cell - f.f)
select patient_id, subject_role, itype as interview_type, status, count(*) as cells from st group by all""",
)
def p2_coverage(spark, sf_dir):
    return grid.grid_coverage(table(spark, sf_dir, "frames"))


@R.add("p2_held_out")
def p2_held_out(spark, sf_dir):
    """Error of cells that hold readings but were kept from the fit, beside that of the recording's mean.

    A tenth of the seconds is left out, told by a hash of recording and second.
    """
    frames = table(spark, sf_dir, "frames")
    truth = grid.regular_grid(frames).filter("status = 'observed'").select(*grid.KEY, "cell_s", "au04_r", "au12_r")
    second = F.floor(F.when(F.col("ts_s") > 1000, F.col("ts_s") / 1000).otherwise(F.col("ts_s")))
    kept = frames.filter(F.coalesce(F.pmod(F.xxhash64("patient_id", "subject_role", second), F.lit(10)) != 0, F.lit(True)))
    filled = grid.regular_grid(kept, only_missing=True).filter("status = 'filled'").select(*grid.KEY, "cell_s", F.col("au04_r").alias("f04"), F.col("au12_r").alias("f12"))
    truth = truth.filter("au04_r between 0 and 5 and au12_r between 0 and 5")  # readings off the scale are not fitted either
    means = truth.groupBy(*grid.KEY).agg(F.avg("au04_r").alias("m04"), F.avg("au12_r").alias("m12"))
    both = truth.join(filled, [*grid.KEY, "cell_s"]).join(means, list(grid.KEY))
    rmse = lambda a, b: F.round(F.sqrt(F.avg((F.col(a) - F.col(b)) ** 2)), 6)
    rows = [F.struct(F.lit(c).alias("channel"), rmse(c, f).alias("rmse"), rmse(c, m).alias("rmse_of_mean"), F.count("*").alias("cells")) for c, f, m in (("au04_r", "f04", "m04"), ("au12_r", "f12", "m12"))]
    return both.agg(F.array(*rows).alias("r")).select(F.inline("r"))


@R.add("p3_found", f"with {TIMES_SQL} select session_id, e as gap_start_ms, lo as gap_end_ms from ended where lo > e")
def p3_found(spark, sf_dir):
    return intervals.gaps(table(spark, sf_dir, "turns"))


@R.add(
    "p3_periods",
    f"""with {TIMES_SQL}, runs as (select *, sum(case when e is null or lo > e then 1 else 0 end)
 over (partition by session_id order by lo, hi rows between unbounded preceding and current row) as g from ended)
select session_id, min(lo) as start_ms, max(hi) as end_ms from runs group by session_id, g having max(hi) > min(lo)""",
)
def p3_periods(spark, sf_dir):
    return intervals.covered_periods(table(spark, sf_dir, "turns"))


@R.add("p4_found")
def p4_found(spark, sf_dir):
    return spikes.flag_faults(table(spark, sf_dir, "frames")).select(*spikes.KEY, "frame", "channel").distinct()


@R.add("p4_report")
def p4_report(spark, sf_dir):
    return spikes.fault_report(table(spark, sf_dir, "frames"))
