"""The cleaned tables that queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkline.core import interview_type, patient_key, split_name, table, therapist_key
from larkline.operators import clean

AUS = ["au01_r", "au02_r", "au04_r", "au05_r", "au06_r", "au07_r", "au09_r", "au10_r", "au12_r", "au14_r", "au15_r", "au17_r", "au20_r", "au23_r", "au25_r", "au26_r", "au45_r"]

TYPE_SQL = """case when contains(lower(trim(interview_type)), 'bind') then 'bindung'
 when starts_with(lower(trim(interview_type)), 'pers') or starts_with(lower(trim(interview_type)), 'st') then 'personal'
 when starts_with(lower(trim(interview_type)), 'wun') or contains(lower(trim(interview_type)), 'wf') then 'wunder' end"""

#: fr: each frame of a recording once, in seconds.
FR = f"""raw_fr as (select distinct patient_id, subject_role, {TYPE_SQL} as itype, frame, ts_s, confidence, success, {", ".join(AUS)} from frames),
fr as (select * exclude (ts_s), case when max(ts_s) over k - min(ts_s) over k > 1000 then ts_s / 1000 else ts_s end as ts from raw_fr
 window k as (partition by patient_id, subject_role, itype))"""

#: ok: the tracked frames of fr with a time, null readings as they are.
OK = f"{FR}, ok as (select * from fr where success = 1 and confidence >= 0.5 and ts is not null)"

#: tu: each turn once, in milliseconds and order of time.
TU = """raw_tu as (select distinct session_id, turn_index, lower(trim(speaker_id)) as speaker, start_s, end_s, speech_unsummarised as speech, summary from turns),
tu as (select session_id, turn_index, speaker, speech, summary, cast(round(least(start_s, end_s) * u) as bigint) as lo, cast(round(greatest(start_s, end_s) * u) as bigint) as hi
 from (select *, case when max(greatest(start_s, end_s)) over (partition by session_id) > 4000 then 1 else 1000 end as u from raw_tu)
 where start_s is not null and end_s is not null and turn_index is not null)"""

#: se: the newest export of each session, ids and splits in one spelling.
SE = f"""se as (select session_id, {TYPE_SQL} as itype, lang, session_date,
 nullif(regexp_extract(upper(regexp_replace(patient_id, '[^0-9A-Za-z]', '', 'g')), '^(VP[0-9]{{7}})$', 1), '') as patient,
 nullif(regexp_extract(upper(regexp_replace(therapist_id, '[^0-9A-Za-z]', '', 'g')), '^(?:TH)?([A-Z][0-9][A-Z]{{3}})$', 1), '') as therapist,
 case lower(trim(split)) when 'training' then 'train' when 'valid' then 'val' when 'validation' then 'val' else lower(trim(split)) end as split,
 blri_ges_pr as pr, case when isfinite(try_cast(blri_ges_in as double)) then try_cast(blri_ges_in as double) end as inn, file_name
 from (select *, row_number() over (partition by session_id order by updated_at desc nulls last) as k from sessions) where k = 1)"""

#: pr: each prediction once.
PR = "pr as (select distinct pair_id, patient_id, therapist_id, interview_type, turn_index, template_id, stage, input_text, generated, gold from predictions)"

RECORDING = ["patient_id", "subject_role", "itype"]


def fr(spark, sf_dir) -> DataFrame:
    # Repeated rows have the same values: told by frame and time, so channels that a query leaves out are not read.
    rows = table(spark, sf_dir, "frames").select(
        "patient_id", "subject_role", interview_type("interview_type").alias("itype"), "frame", "ts_s", "confidence", "success", *AUS
    ).dropDuplicates([*RECORDING, "frame", "ts_s", "confidence", "success"])
    w = Window.partitionBy(*RECORDING)
    ms = F.max("ts_s").over(w) - F.min("ts_s").over(w) > 1000
    return rows.withColumn("ts", F.when(ms, F.col("ts_s") / 1000).otherwise(F.col("ts_s"))).drop("ts_s")


def ok(spark, sf_dir) -> DataFrame:
    return clean.tracked(fr(spark, sf_dir)).filter("ts is not null")


def tu(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "turns").select(
        "session_id", "turn_index", F.lower(F.trim("speaker_id")).alias("speaker"), "start_s", "end_s", F.col("speech_unsummarised").alias("speech"), "summary"
    ).distinct()
    lo, hi = clean.ordered("start_s", "end_s")
    w = Window.partitionBy("session_id")
    unit = F.when(F.max(hi).over(w) > 4000, 1).otherwise(1000)
    rows = rows.withColumns({"lo": F.round(lo * unit).cast("long"), "hi": F.round(hi * unit).cast("long")})
    return rows.dropna(subset=["start_s", "end_s", "turn_index"]).drop("start_s", "end_s")


def se(spark, sf_dir) -> DataFrame:
    rows = clean.latest(table(spark, sf_dir, "sessions"), ["session_id"], [F.desc_nulls_last("updated_at")])
    return rows.select(
        "session_id", interview_type("interview_type").alias("itype"), "lang", "session_date",
        patient_key("patient_id").alias("patient"), therapist_key("therapist_id").alias("therapist"), split_name("split").alias("split"),
        F.col("blri_ges_pr").alias("pr"), clean.finite_or_null("blri_ges_in").alias("inn"), "file_name",
    )


def pr(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "predictions").select(
        "pair_id", "patient_id", "therapist_id", "interview_type", "turn_index", "template_id", "stage", "input_text", "generated", "gold"
    ).distinct()
