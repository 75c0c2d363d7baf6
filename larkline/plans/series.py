"""Queries of window and time-series operators (W)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkline.core import table
from larkline.operators import timeseries, turns
from larkline.plans.base import FR, OK, TU, fr, ok, tu
from larkline.plans.joining import KEY
from larkline.plans.registry import Registry

R = Registry()

K = "patient_id, subject_role, itype"


@R.add("W-01_speaker_turns", "with s as (select distinct session_id, pos, lower(trim(speaker_id)) as sp, least(start_s, end_s) as lo, greatest(start_s, end_s) as hi, trim(text) as text from segments where trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> ''), o as (select *, lag(sp) over w as prev, row_number() over w as i from s window w as (partition by session_id order by lo, pos)), g as (select *, sum(case when i = 1 or sp is distinct from prev then 1 else 0 end) over (partition by session_id order by lo, pos) - 1 as turn_index from o) select session_id, turn_index, sp as speaker, arg_min(lo, i) as start, arg_max(hi, i) as end, count(*) as segments, sum(length(text)) + count(*) - 1 as chars from g group by session_id, turn_index, sp", longs=("turn_index", "chars"))
def w01(spark, d):
    s = table(spark, d, "segments").select("session_id", "pos", "speaker_id", F.least("start_s", "end_s").alias("lo"), F.greatest("start_s", "end_s").alias("hi"), "text").distinct()
    got = turns.merge_speakers(s, "session_id", [F.col("lo"), F.col("pos")], "speaker_id", "lo", "hi", "text")
    return got.select("session_id", "turn_index", "speaker", "start", "end", "segments", F.length("text").alias("chars"))


@R.add("W-02_heatmap_bins", f"with {OK}, r as (select *, row_number() over (partition by {K} order by ts, frame) - 1 as r, count(*) over (partition by {K}) as n from ok), b as (select {K}, ((r + 1) * 8 - 1) // n as bin, avg(au04_r) as a, avg(au12_r) as b from r group by all), f as (select distinct {K}, unnest(range(0, 8)) as bin from ok) select {K}, f.bin, round(coalesce(a, 0.0), 6) as au04, round(coalesce(b, 0.0), 6) as au12 from f left join b using ({K}, bin)")
def w02(spark, d):
    got = timeseries.equal_count_bins(ok(spark, d), KEY, [F.col("ts"), F.col("frame")], ["au04_r", "au12_r"])
    return got.select(*KEY, "bin", F.round("au04_r", 6).alias("au04"), F.round("au12_r", 6).alias("au12"))


@R.add("W-02_event_bins", "with r as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as r, count(*) over (partition by user_id, event_type) as n from events), b as (select user_id, event_type, ((r + 1) * 8 - 1) // n as bin, avg(value) as v from r group by all), f as (select distinct user_id, event_type, unnest(range(0, 8)) as bin from events) select user_id, event_type, f.bin, round(coalesce(v, 0.0), 6) as mean from f left join b using (user_id, event_type, bin)")
def w02b(spark, d):
    got = timeseries.equal_count_bins(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["value"])
    return got.select("user_id", "event_type", "bin", F.round("value", 6).alias("mean"))


@R.add("W-03_shared_scale", f"with {OK} select patient_id, itype, frame, subject_role, min(au12_r) over (partition by patient_id, itype) as low, max(au12_r) over (partition by patient_id, itype) as high from ok")
def w03(spark, d):
    w = Window.partitionBy("patient_id", "itype")
    return ok(spark, d).select("patient_id", "itype", "frame", "subject_role", F.min("au12_r").over(w).alias("low"), F.max("au12_r").over(w).alias("high"))


@R.add("W-04_rolling_mean", f"with {OK} select {K}, frame, round(avg(au12_r) over (partition by {K} order by frame rows between 2 preceding and 2 following), 6) as au12 from ok")
def w04(spark, d):
    return ok(spark, d).select(*KEY, "frame", F.round(timeseries.rolling_mean("au12_r", KEY, [F.col("frame")], 25, 6), 6).alias("au12"))


@R.add("W-05_linear_fill", f"with {FR}, r as (select *, row_number() over (partition by {K} order by frame) as i from fr), n as (select *, max(case when au04_r is not null then i end) over (partition by {K} order by i rows between unbounded preceding and current row) as pi, min(case when au04_r is not null then i end) over (partition by {K} order by i rows between current row and unbounded following) as ni from r) select {K}, n.frame, round(case when n.au04_r is not null then n.au04_r when pi is null then b.au04_r when ni is null then a.au04_r else a.au04_r + (b.au04_r - a.au04_r) * (n.i - pi) / (ni - pi) end, 6) as au04 from n left join (select {K}, i as pi, au04_r from r) a using ({K}, pi) left join (select {K}, i as ni, au04_r from r) b using ({K}, ni)")
def w05(spark, d):
    got = timeseries.fill_linear(fr(spark, d), KEY, [F.col("frame")], "au04_r")
    return got.select(*KEY, "frame", F.round("au04_r", 6).alias("au04"))


W06 = f"""with {OK}, s as (select * from ok where au12_r is not null), sp as (select {K}, min(ts) as t0, max(ts) as t1 from s group by all),
g0 as (select *, unnest(range(0, cast(floor((t1 - t0) * 2 + 1e-9) as bigint) + 1)) as k from sp), gr as (select *, t0 + k / 2.0::double as ts from g0),
p as (select gr.*, o.au12_r as pv, o.ts as pt, o.frame as pf from gr asof left join s o on gr.patient_id = o.patient_id and gr.subject_role = o.subject_role and gr.itype = o.itype and gr.ts >= o.ts),
n as (select p.*, o.au12_r as nv, o.ts as nt, o.frame as nf from p asof left join s o on p.patient_id = o.patient_id and p.subject_role = o.subject_role and p.itype = o.itype and p.ts <= o.ts)
select {K}, k, round(k / 2.0::double, 6) as t, k + 1 as frame, round(case when nt is null or pt = nt then pv else pv + (nv - pv) * (ts - pt) / (nt - pt) end, 6) as au12, case when nt is null or ts - pt <= nt - ts then pf else nf end as src from n"""


@R.add("W-06_resample", W06)
def w06(spark, d):
    s = ok(spark, d).filter("au12_r is not null").withColumnRenamed("frame", "src")
    return timeseries.resample(s, KEY, "ts", ["au12_r"], ["src"], 2.0).select(*KEY, "k", "t", "frame", F.round("au12_r", 6).alias("au12"), "src")


@R.add("W-07_downsample", f"with {OK}, r as (select {K}, frame, row_number() over (partition by {K} order by frame) - 1 as i, count(*) over (partition by {K}) as n from ok), k as (select distinct {K}, n, unnest(range(0, 100)) as j from r), p as (select {K}, n, cast(trunc(j * ((n - 1) / 99.0::double)) as bigint) as i from k) select distinct r.patient_id, r.subject_role, r.itype, r.frame from r left join p using ({K}, i) where r.n <= 100 or p.n is not null")
def w07(spark, d):
    return timeseries.downsample(ok(spark, d), KEY, [F.col("frame")], 100).select(*KEY, "frame")


@R.add("W-08_decimate", f"with {FR}, s as (select {K}, list(coalesce(au12_r, 0.0) order by frame) as x from fr group by all) select {K}, len(list_filter(x, lambda v, i: (i - 1) % 5 = 0)) as n, round(list_sum(list_filter(x, lambda v, i: (i - 1) % 5 = 0)), 6) as total from s")
def w08(spark, d):
    s = fr(spark, d).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("frame", F.coalesce("au12_r", F.lit(0.0)).alias("v")))).alias("r"))
    x = timeseries.decimate(F.transform("r", lambda e: e["v"]), 5)
    return s.select(*KEY, F.size(x).alias("n"), F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@R.add("W-09_tumbling_modes", "with f as (select user_id, min(ts) as t0 from events group by 1), w as (select user_id, (epoch_us(e.ts) - epoch_us(t0)) // 259200000000 as win, event_type, count(*) as n from events e join f using (user_id) group by all), b as (select *, sum(n) over (partition by user_id, win) as rows, row_number() over (partition by user_id, win order by n desc, event_type) as k from w) select user_id, win, event_type, n, rows from b where k = 1 and n >= 0.5 * rows", longs=("rows",))
def w09(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return timeseries.tumbling_modes(e, ["user_id"], "t", "event_type", 259200).withColumnRenamed("window", "win")


@R.add("W-10_median_step", f"with {OK}, s as (select {K}, ts - lag(ts) over (partition by {K} order by ts) as d from ok) select {K}, round(quantile_cont(d, 0.5), 6) as step from s where d > 0 group by all")
def w10(spark, d):
    return timeseries.median_step(ok(spark, d), KEY, "ts").withColumn("step", F.round("step", 6))


@R.add("W-11_append_segment", f"""with {OK}, a as (select patient_id, itype, ts, frame from ok where subject_role = 'therapist'), b as (select patient_id, itype, ts, frame from ok where subject_role = 'patient'),
st as (select patient_id, itype, quantile_cont(d, 0.5) as step from (select *, ts - lag(ts) over (partition by patient_id, itype order by ts) as d from a) where d > 0 group by all),
e as (select patient_id, itype, max(ts) as t, max(frame) as f from a group by all), s as (select patient_id, itype, min(ts) as s, min(frame) as g from b group by all)
select patient_id, itype, round(ts, 6) as ts, frame from a union all select b.patient_id, b.itype, round(b.ts - s.s + e.t + st.step, 6), b.frame - g + f + 1 from b join e using (patient_id, itype) join st using (patient_id, itype) join s using (patient_id, itype)""")
def w11(spark, d):
    o = ok(spark, d)
    parts = [o.filter(F.col("subject_role") == r).select("patient_id", "itype", "ts", "frame") for r in ("therapist", "patient")]
    return timeseries.append_segment(*parts, ["patient_id", "itype"], "ts", "frame").withColumn("ts", F.round("ts", 6))


ARR = f"{OK}, s as (select {K}, list(coalesce(au12_r, 0.0) order by frame) as x from ok group by all)"


def arr(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("frame", F.coalesce("au12_r", F.lit(0.0)).alias("v"))))
    return ok(spark, d).groupBy(*KEY).agg(F.transform(rows, lambda e: e["v"]).alias("x"))


def total(x):
    return F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6)


@R.add("W-12_pad_forward", f"with {ARR}, m as (select patient_id, itype, max(len(x)) as m from s group by all) select {K}, greatest(len(x), m) as n, round(list_sum(x) + (m - len(x)) * x[-1], 6) as total from s join m using (patient_id, itype)")
def w12(spark, d):
    s = arr(spark, d).withColumn("m", F.max(F.size("x")).over(Window.partitionBy("patient_id", "itype")))
    p = timeseries.pad_forward(F.col("x"), F.col("m"))
    return s.select(*KEY, F.size(p).alias("n"), total(p).alias("total"))


@R.add("W-13_pad_patches", f"with {ARR} select {K}, cast(ceil(least(len(x), 200) / 16.0) * 16 as int) as n, round(list_sum(x[1:200]), 6) as total from s")
def w13(spark, d):
    p = timeseries.pad_zero(F.col("x"), 16, 200)
    return arr(spark, d).select(*KEY, F.size(p).alias("n"), total(p).alias("total"))


@R.add("W-14_zscore_add", f"with {OK} select {K}, frame, round((au12_r - avg(au12_r) over w) / (stddev_samp(au12_r) over w + 1e-8), 6) as z from ok where au12_r is not null window w as (partition by {K})")
def w14a(spark, d):
    o = ok(spark, d).filter("au12_r is not null")
    return o.select(*KEY, "frame", F.round(timeseries.zscore("au12_r", KEY, 1, "add", 1e-8), 6).alias("z"))


@R.add("W-14_zscore_clamp", f"with {OK} select {K}, frame, round((au04_r - avg(au04_r) over w) / greatest(stddev_pop(au04_r) over w, 1e-6), 6) as z from ok where au04_r is not null window w as (partition by {K})")
def w14b(spark, d):
    o = ok(spark, d).filter("au04_r is not null")
    return o.select(*KEY, "frame", F.round(timeseries.zscore("au04_r", KEY, 0, "clamp", 1e-6), 6).alias("z"))


@R.add("W-14_zscore_center", f"with {ARR}, m as (select {K}, x, list_avg(x) as m, list_stddev_pop(x) as sd from s) select {K}, round(list_max(x) - m, 6) as high, round((list_max(x) - m) / case when sd > 1e-6 then sd else 1 end, 6) as z from m")
def w14c(spark, d):
    s = arr(spark, d)
    z = timeseries.zscore_array(F.col("x"), 0, "center", 1e-6)
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    return s.select(*KEY, F.round(F.array_max("x") - mean, 6).alias("high"), F.round(F.array_max(z), 6).alias("z"))


@R.add("W-15_patches", f"with {ARR}, e as (select {K}, unnest(range(0, cast(ceil(len(x) / 4.0) as bigint))) as i, x from s) select {K}, i, round(list_sum(x[i * 4 + 1:i * 4 + 4]) / 4, 6) as mean from e")
def w15(spark, d):
    s = arr(spark, d).select(*KEY, F.posexplode(timeseries.patches(timeseries.pad_zero(F.col("x"), 4), 4)).alias("i", "p"))
    return s.select(*KEY, "i", F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v) / 4, 6).alias("mean"))


@R.add("W-16_convolution", f"with {OK}, c as (select {K}, 0.25 * coalesce(lag(x) over w, 0) + 0.5 * x + 0.25 * coalesce(lead(x) over w, 0) as y from (select {K}, frame, coalesce(au12_r, 0.0) as x from ok) window w as (partition by {K} order by frame)) select {K}, round(max(y), 6) as max_pool, round(avg(y), 6) as mean_pool from c group by all")
def w16(spark, d):
    o = ok(spark, d).withColumn("x", F.coalesce("au12_r", F.lit(0.0)))
    o = o.withColumn("y", timeseries.convolve_same(o, KEY, [F.col("frame")], "x", [0.25, 0.5, 0.25]))
    return o.groupBy(*KEY).agg(F.round(F.max("y"), 6).alias("max_pool"), F.round(F.avg("y"), 6).alias("mean_pool"))


@R.add("W-17_first_k", f"with {TU} select session_id, turn_index, lo from (select *, row_number() over (partition by session_id order by turn_index, lo, hi, speaker) as k from tu) where k <= 5")
def w17(spark, d):
    order = [F.col(c) for c in ("turn_index", "lo", "hi", "speaker")]
    return timeseries.first_k(tu(spark, d), ["session_id"], order, 5).select("session_id", "turn_index", "lo")


@R.add("W-18_default_sort_key", "select session_id, place, coalesce(turn_index, -1) as turn_index from (select *, row_number() over (partition by session_id order by coalesce(turn_index, 1000000000), start_s nulls last, end_s nulls last, speech_unsummarised, speaker_id) as place from turns)")
def w18(spark, d):
    order = [F.coalesce("turn_index", F.lit(10**9)), F.asc_nulls_last("start_s"), F.asc_nulls_last("end_s"), F.asc_nulls_last("speech_unsummarised"), F.asc_nulls_last("speaker_id")]
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(*order))
    return table(spark, d, "turns").withColumn("place", place).select("session_id", "place", F.coalesce("turn_index", F.lit(-1)).alias("turn_index"))


@R.add("W-19_clock_labels", f"with {TU} select session_id, turn_index, printf('%02d:%02d', (lo // 1000) // 60, (lo // 1000) % 60) as label from tu")
def w19(spark, d):
    return tu(spark, d).select("session_id", "turn_index", timeseries.minutes("lo").alias("label"))


@R.add("W-20_length_buckets", f"with {TU}, s as (select session_id, count(*) as n from tu group by 1), b as (select *, (row_number() over (order by n, session_id) - 1) // 16 as batch from s) select session_id, n, batch from b where batch in (select batch from b group by batch having count(*) = 16)")
def w20(spark, d):
    s = tu(spark, d).groupBy("session_id").agg(F.count("*").alias("n"))
    return timeseries.length_buckets(s, "n", "session_id", 16, drop_last=True).select("session_id", "n", "batch")


@R.add("W-22_sequence_mask", f"with {TU}, s as (select session_id, count(*) as n from tu group by 1), m as (select max(n) as m from s) select session_id, m as width, n as valid from s, m")
def w22(spark, d):
    s = tu(spark, d).groupBy("session_id").agg(F.count("*").alias("n"))
    most = s.agg(F.max("n")).first()[0] or 1
    mask = timeseries.sequence_mask(F.col("n"), F.lit(most))
    return s.select("session_id", F.size(mask).cast("long").alias("width"), F.size(F.filter(mask, lambda x: x)).cast("long").alias("valid"))


@R.add("W-23_early_stop")
def w23(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.floor(F.hour("ts") + F.dayofmonth("ts") * 24).alias("epoch")).agg(F.avg("value").alias("loss"))
    runs = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("epoch", "loss"))).alias("r"))
    s = timeseries.early_stop(F.transform("r", lambda x: x["loss"]))
    return runs.select("user_id", s["best"].alias("best"), s["at"].alias("best_epoch"), s["stop"].alias("stopped"))


@R.add("W-24_first_index", f"with {TU} select session_id, speaker, min(turn_index) as first_turn from tu group by all")
def w24(spark, d):
    return tu(spark, d).groupBy("session_id", "speaker").agg(F.min("turn_index").alias("first_turn"))


