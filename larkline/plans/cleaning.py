"""Queries of projections, filters and cleaning (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkline.core import table
from larkline.operators import clean
from larkline.plans.base import AUS, FR, PR, SE, TU, fr, pr, se, tu
from larkline.plans.registry import Registry

R = Registry()


@R.add("P-01_projection", "select patient_id, frame, au04_r from frames")
def p01(spark, d):
    return clean.present(table(spark, d, "frames"), ["patient_id", "no_such_column", "frame", "au04_r"])


@R.add("P-02_columns_by_pattern", f"with long as (unpivot (select {', '.join(AUS)} from frames) on {', '.join(AUS)} into name channel value v) select channel, count(v) as readings from long group by channel")
def p02(spark, d):
    df = table(spark, d, "frames")
    aus = clean.columns_like(df, "au", "_r")
    return df.select(aus).unpivot([], aus, "channel", "v").groupBy("channel").agg(F.count("v").alias("readings"))


@R.add("P-03_drop_columns", "select session_id, patient_id, split from sessions")
def p03(spark, d):
    return clean.without(table(spark, d, "sessions"), "therapist_id", "interview_type", "file_name", "session_date", "lang", "blri_ges_pr", "blri_ges_in", "updated_at", "nothing")


@R.add("P-04_drop_field", "select event_id, user_id from events")
def p04(spark, d):
    row = table(spark, d, "events").select(F.struct("event_id", "user_id", "value").alias("r"))
    return row.select(F.col("r").dropFields("value").alias("r")).select("r.event_id", "r.user_id")


@R.add("P-05_units", f"with {TU} select session_id, turn_index, lo / 1000.0::double as start_s, (hi - lo) / 1000.0::double as seconds from tu")
def p05(spark, d):
    return tu(spark, d).select("session_id", "turn_index", (F.col("lo") / 1000).alias("start_s"), ((F.col("hi") - F.col("lo")) / 1000).alias("seconds"))


@R.add("P-06_numeric_coercion", "select session_id, try_cast(blri_ges_in as double) is null as bad, count(*) as n from sessions group by all")
def p06(spark, d):
    return table(spark, d, "sessions").groupBy("session_id", clean.number("blri_ges_in").isNull().alias("bad")).agg(F.count("*").alias("n"))


@R.add("P-07_finite_or_null", f"with {SE} select session_id, pr, inn from se")
def p07(spark, d):
    return se(spark, d).select("session_id", "pr", "inn")


@R.add("P-08_coerce_ms", "select session_id, turn_index, greatest(coalesce(cast(trunc(start_s) as bigint), 0), 0) as start_ms, greatest(greatest(coalesce(cast(trunc(start_s) as bigint), 0), 0), greatest(coalesce(cast(trunc(end_s) as bigint), 0), 0)) as end_ms from turns")
def p08(spark, d):
    start, end = clean.coerce_ms("start_s"), clean.coerce_ms("end_s")
    return table(spark, d, "turns").select("session_id", "turn_index", start.alias("start_ms"), F.greatest(start, end).alias("end_ms"))


@R.add("P-09_confidence", f"with {FR} select patient_id, subject_role, itype, count(*) as frames from fr where success = 1 and confidence >= 0.8 group by all")
def p09(spark, d):
    return clean.tracked(fr(spark, d), 0.8).groupBy("patient_id", "subject_role", "itype").agg(F.count("*").alias("frames"))


@R.add("P-10_drop_null_times", "select count(*) as n from frames where ts_s is not null")
def p10(spark, d):
    return table(spark, d, "frames").dropna(subset=["ts_s"]).agg(F.count("*").alias("n"))


@R.add("P-11_membership", f"with {SE}, held as (select therapist from se where therapist is not null group by therapist having count(distinct split) = 1) select session_id from se where therapist in (select therapist from held)")
def p11(spark, d):
    s = se(spark, d)
    held = s.filter("therapist is not null").groupBy("therapist").agg(F.count_distinct("split").alias("k")).filter("k = 1").select("therapist")
    return s.join(held, "therapist", "left_semi").select("session_id")


@R.add("P-12_exclusion", "select session_id, file_name from sessions where coalesce(regexp_replace(lower(trim(file_name)), '^vp', ''), '') not in (select regexp_replace(lower(trim(file_name)), '^vp', '') from sessions where lang = 'en' and file_name is not null)")
def p12(spark, d):
    s = table(spark, d, "sessions")
    out = s.filter("lang = 'en'").select(F.regexp_replace(F.lower(clean.strip("file_name")), "^vp", "").alias("f"))
    return clean.excluding(s, F.coalesce("file_name", F.lit("")), out, "vp").select("session_id", "file_name")


@R.add("P-13_minimum_rows", f"with {FR} select patient_id, subject_role, itype, frame from fr where (patient_id, subject_role, itype) in (select (patient_id, subject_role, itype) from fr where success = 1 group by patient_id, subject_role, itype having count(*) >= 300)")
def p13(spark, d):
    key = ["patient_id", "subject_role", "itype"]
    return clean.groups_with(fr(spark, d), key, F.sum((F.col("success") == 1).cast("int")) >= 300).select(*key, "frame")


@R.add("P-14_series_length", f"with {FR}, s as (select patient_id, itype, subject_role, list(au04_r order by frame) filter (au04_r is not null) as a, list(au12_r) filter (au12_r is not null) as b, list(au25_r) filter (au25_r is not null) as c from fr group by all) select patient_id, itype, subject_role, len(a) as n from s where len(a) >= 320 and len(b) >= 320 and len(c) >= 320")
def p14(spark, d):
    s = fr(spark, d).groupBy("patient_id", "itype", "subject_role").agg(*[F.collect_list(c).alias(c) for c in ("au04_r", "au12_r", "au25_r")])
    return s.filter(" and ".join(f"size({c}) >= 320" for c in ("au04_r", "au12_r", "au25_r"))).select("patient_id", "itype", "subject_role", F.size("au04_r").alias("n"))


@R.add("P-15_prefix_filter", "select pair_id, stage from predictions where not starts_with(stage, 'cot')")
def p15(spark, d):
    return table(spark, d, "predictions").filter(~F.col("stage").startswith("cot")).select("pair_id", "stage")


@R.add("P-16_required_fields", r"with p as (select pair_id, concat_ws(',', case when coalesce(trim(regexp_replace(generated, '\s+', ' ', 'g')), '') = '' then 'generated' end, case when coalesce(trim(regexp_replace(gold, '\s+', ' ', 'g')), '') = '' then 'gold' end) as missing from predictions) select pair_id, missing from p where missing <> ''")
def p16(spark, d):
    return clean.invalid_rows(table(spark, d, "predictions"), ["generated", "gold"]).select("pair_id", "missing")


@R.add("P-17_series_valid", f"with {FR} select patient_id, subject_role, itype, count(au04_r) = count(*) as valid from fr group by all")
def p17(spark, d):
    s = fr(spark, d).groupBy("patient_id", "subject_role", "itype").agg(F.collect_list(F.struct("au04_r")).alias("s"))
    return s.select("patient_id", "subject_role", "itype", clean.all_finite(F.transform("s", lambda x: x["au04_r"])).alias("valid"))


@R.add("P-18_stray_headers", "select event_type from events where event_type <> 'event_type'")
def p18(spark, d):
    e = table(spark, d, "events").select("event_type")
    return clean.stray_headers(e.unionByName(e.limit(1).select(F.lit("event_type").alias("event_type"))), "event_type")


@R.add("P-19_text_guards", f"with {TU} select session_id, turn_index from tu where trim(coalesce(summary, '')) <> '' and not starts_with(lower(trim(summary)), 'error:')")
def p19(spark, d):
    return tu(spark, d).filter(clean.usable_text("summary")).select("session_id", "turn_index")


@R.add("P-20_placeholder", f"with {TU} select session_id, turn_index, case when trim(coalesce(summary, '')) = '' then '[UNK]' else summary end as summary from tu")
def p20(spark, d):
    return tu(spark, d).withColumn("summary", F.when(clean.blank("summary"), "[UNK]").otherwise(F.col("summary"))).select("session_id", "turn_index", "summary")


@R.add("P-21_fallback_keys", f"with {TU} select session_id, turn_index, coalesce(nullif(trim(summary), ''), nullif(trim(speech), ''), '[UNK]') as text from tu")
def p21(spark, d):
    return tu(spark, d).select("session_id", "turn_index", F.coalesce(F.trim(clean.first_filled("summary", "speech")), F.lit("[UNK]")).alias("text"))


@R.add("P-22_swap", "select session_id, pos, least(start_s, end_s) as start_s, greatest(start_s, end_s) as end_s from segments")
def p22(spark, d):
    lo, hi = clean.ordered("start_s", "end_s")
    return table(spark, d, "segments").select("session_id", "pos", lo.alias("start_s"), hi.alias("end_s"))


@R.add("P-23_minimum_duration", f"with {TU} select session_id, turn_index, speaker from tu where hi - lo >= 1500 and speaker in ('client', 'therapist')")
def p23(spark, d):
    return tu(spark, d).filter("hi - lo >= 1500 and speaker in ('client', 'therapist')").select("session_id", "turn_index", "speaker")


@R.add("P-24_remap", "select pair_id, case stage when 'cot_activity' then 'Activity' when 'cot_sleep' then 'Sleep' when 'cot_ecg' then 'ECG' else stage end as label from predictions")
def p24(spark, d):
    names = {"cot_activity": "Activity", "cot_sleep": "Sleep", "cot_ecg": "ECG"}
    return table(spark, d, "predictions").select("pair_id", clean.remap("stage", names, F.col("stage")).alias("label"))


@R.add("P-25_name_parse", r"with g as (select 'Simulation-L' || (p_size * 10) || '-N' || (p_partkey % 5 + 1) as name, p_partkey from part) select p_partkey, cast(regexp_extract(name, 'Simulation-L(\d+)-N(\d+)', 1) as int) as len, cast(regexp_extract(name, 'Simulation-L(\d+)-N(\d+)', 2) as int) as n from g")
def p25(spark, d):
    name = F.concat(F.lit("Simulation-L"), F.col("p_size") * 10, F.lit("-N"), F.col("p_partkey") % 5 + 1)
    pattern = r"Simulation-L(\d+)-N(\d+)"
    return table(spark, d, "part").select("p_partkey", *[F.regexp_extract(name, pattern, i).cast("int").alias(c) for i, c in ((1, "len"), (2, "n"))])


@R.add("P-26_sentinels", "select p_partkey, nullif(case when p_size % 7 = 0 then -1 else p_size end, -1) as gb, p_size * (p_partkey % 5 + 1) as total from part")
def p26(spark, d):
    raw = F.when(F.col("p_size") % 7 == 0, -1).otherwise(F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", F.nullif(raw, F.lit(-1)).alias("gb"), (F.col("p_size") * (F.col("p_partkey") % 5 + 1)).alias("total"))


@R.add("P-27_discrepancy", f"with {SE} select session_id, case when (pr - inn) * 4 between -6 and 6 then 'equally empathic' when pr - inn is not null then 'discrepancy' end as label from se")
def p27(spark, d):
    return se(spark, d).select("session_id", clean.discrepancy((F.col("pr") - F.col("inn")) * 4).alias("label"))


@R.add("P-28_quantile_bins", "select o_orderkey, case when o_totalprice <= 50000 then 'poor' when o_totalprice <= 140000 then 'reasonable' when o_totalprice <= 240000 then 'good' else 'very_good' end as bin from orders")
def p28(spark, d):
    return table(spark, d, "orders").select("o_orderkey", clean.quantile_bin("o_totalprice", (50000, 140000, 240000)).alias("bin"))


@R.add("P-29_completion", "with q as (select session_id, case when blri_ges_pr is null then '' else 'x' end as a, coalesce(split, '') as b, coalesce(lang, '') as c from sessions) select session_id, case (trim(a) <> '')::int + (trim(b) <> '')::int + (trim(c) <> '')::int when 3 then 'Completed' when 0 then 'Not Started' else 'In Progress' end as status from q")
def p29(spark, d):
    s = table(spark, d, "sessions")
    return s.select("session_id", clean.completion([F.col("blri_ges_pr").cast("string"), F.col("split"), F.col("lang")]).alias("status"))


@R.add("P-30_extremes", f"with {SE} select session_id, round(pr - inn, 6) as diff from se where abs(pr - inn) > 1.5 order by diff desc")
def p30(spark, d):
    diff = F.col("pr") - F.col("inn")
    return se(spark, d).filter(F.abs(diff) > 1.5).select("session_id", F.round(diff, 6).alias("diff")).orderBy(F.desc("diff"))


@R.add("P-31_siblings", f"with {FR}, {SE}, have as (select patient_id, itype, bool_or(subject_role = 'therapist') as t, bool_or(subject_role = 'patient') as p from fr group by all) select session_id from se join have on patient = patient_id and se.itype = have.itype where t and p and session_id in (select session_id from segments)")
def p31(spark, d):
    role = F.col("subject_role")
    have = fr(spark, d).groupBy("patient_id", "itype").agg(F.bool_or(role == "therapist").alias("t"), F.bool_or(role == "patient").alias("p"))
    s = se(spark, d).join(have.filter("t and p").withColumnRenamed("patient_id", "patient"), ["patient", "itype"], "left_semi")
    return s.join(table(spark, d, "segments"), "session_id", "left_semi").select("session_id")


@R.add("P-32_optional_criteria", f"with {PR} select pair_id from pr where stage in ('cot_ecg', 'cot_sleep')")
def p32(spark, d):
    return clean.matching(pr(spark, d), stage=["cot_ecg", "cot_sleep"], template_id=[], interview_type=[]).select("pair_id")


@R.add("P-33_swap_labels", f"with {TU} select session_id, turn_index, case when session_id % 10 = 3 then case speaker when 'client' then 'therapist' when 'therapist' then 'client' else speaker end else speaker end as speaker from tu")
def p33(spark, d):
    t = tu(spark, d).withColumn("last", (F.col("session_id") % 10).cast("string"))
    return clean.swap_labels(t, "last", ["3"], "speaker").select("session_id", "turn_index", "speaker")


@R.add("P-34_valid_rows", f"with {SE} select session_id, itype is not null and pr is not null as valid from se")
def p34(spark, d):
    return se(spark, d).select("session_id", (F.col("itype").isNotNull() & F.col("pr").isNotNull()).alias("valid"))


@R.add("P-35_whole_sessions", "with b as (select session_id, bool_and(trim(coalesce(summary, '')) <> '' and turn_index is not null) as good from turns group by 1) select session_id from b where good")
def p35(spark, d):
    t = table(spark, d, "turns")
    return clean.groups_with(t, ["session_id"], F.bool_and(~clean.blank("summary") & F.col("turn_index").isNotNull())).select("session_id").distinct()


@R.add("P-36_either_target", f"with {SE} select session_id from se where pr is not null or inn is not null")
def p36(spark, d):
    return se(spark, d).filter("pr is not null or inn is not null").select("session_id")


@R.add("P-37_client_first", f"with {TU} select session_id, arg_min(speaker, turn_index) as first_speaker from (select *, row_number() over (partition by session_id, turn_index order by lo, hi, speaker) as k from tu) where k = 1 group by session_id having arg_min(speaker, turn_index) = 'client'")
def p37(spark, d):
    one = clean.latest(tu(spark, d), ["session_id", "turn_index"], [F.col("lo"), F.col("hi"), F.col("speaker")])
    return clean.starts_with_speaker(one, "session_id", "turn_index", "speaker")


@R.add("P-38_member_present", "select pair_id from predictions where generated is not null and (gold is not null or template_id is not null)")
def p38(spark, d):
    entries = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))) for c in ("generated", "gold", "template_id")]
    m = F.map_from_entries(F.array_compact(F.array(*entries)))
    has = lambda k: F.map_contains_key(m, F.lit(k))
    return table(spark, d, "predictions").filter(has("generated") & (has("gold") | has("template_id"))).select("pair_id")


@R.add("P-39_column_by_row", f"with {SE} select session_id, case itype when 'bindung' then pr when 'personal' then inn end as target from se")
def p39(spark, d):
    return se(spark, d).select("session_id", F.when(F.col("itype") == "bindung", F.col("pr")).when(F.col("itype") == "personal", F.col("inn")).alias("target"))


@R.add("P-40_first_map_entry", f"with {SE} select session_id, pr as value from se")
def p40(spark, d):
    m = F.create_map(F.lit("T3_BLRI_ges_In"), F.col("inn"), F.lit("T5_BLRI_ges_Pr"), F.col("pr"), F.lit("T5_other"), F.lit(0.0))
    return se(spark, d).select("session_id", clean.first_by_key(m, "T5", "BLRI_ges_Pr").alias("value"))


@R.add("P-41_strip_inline_series", r"select pair_id, trim(regexp_replace(input_text, '\s+with a mean of [0-9.]+', '', 'g')) as prompt, try_cast(nullif(regexp_extract(input_text, 'with a mean of ([0-9.]+[0-9])', 1), '') as double) as mean from predictions")
def p41(spark, d):
    t = F.col("input_text")
    mean = F.nullif(F.regexp_extract(t, r"with a mean of ([0-9.]+[0-9])", 1), F.lit("")).try_cast("double")
    return table(spark, d, "predictions").select("pair_id", F.trim(F.regexp_replace(t, r"\s+with a mean of [0-9.]+", "")).alias("prompt"), mean.alias("mean"))
