"""Queries of sources (S), sinks (K), streams (R) and hooks (U): each writes a table and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkline import models
from larkline.core import scratch, table
from larkline.functions import arrays, text
from larkline.plans.base import OK, PR, SE, TU, ok, pr, se, tu
from larkline.plans.registry import Registry
from larkline.sources import readers, sinks, tsfile
from larkline.streaming import windows

R = Registry()


@R.add("S-01_csv_scan", "select event_id, user_id, event_type from events")
def s01(spark, d):
    path = scratch(spark)
    e = table(spark, d, "events")
    e.select(F.col("event_id").alias(" event_id"), F.col("user_id").alias("user_id "), "event_type").write.option("header", True).csv(path)
    got = readers.csv(spark, path)
    return got.select(F.col("event_id").try_cast("long").alias("event_id"), F.col("user_id").try_cast("long").alias("user_id"), "event_type")


@R.add("S-02_whitespace_table", "select event_id::double as event_id, user_id::double as user_id, value from events")
def s02(spark, d):
    path = scratch(spark)
    table(spark, d, "events").select(F.concat_ws("  ", F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("value").cast("string")).alias("value")).write.text(path)
    return readers.whitespace_table(spark, path, ["event_id", "user_id", "value"])


@R.add("S-03_labelled_series", "select event_type as label, round(value + user_id, 6) as total from events")
def s03(spark, d):
    path = scratch(spark)
    table(spark, d, "events").select(F.concat_ws("\t", "event_type", F.col("value").cast("string"), F.col("user_id").cast("string")).alias("value")).write.text(path)
    return readers.labelled_series(spark, path).select("label", F.round(F.col("series")[0] + F.col("series")[1], 6).alias("total"))


@R.add("S-04_json_arrays", "select session_id, pos, text from (select distinct session_id, pos, text from segments)")
def s04(spark, d):
    path = scratch(spark)
    g = table(spark, d, "segments").select("session_id", "pos", "text").distinct()
    one = g.groupBy("session_id").agg(F.to_json(F.collect_list(F.struct("session_id", F.col("pos").alias("place"), "text"))).alias("value"))
    files = one.unionByName(one.limit(1).select("session_id", F.lit("{broken").alias("value")))
    files.withColumn("part", F.monotonically_increasing_id() % 1_000_003).drop("session_id").write.option("maxRecordsPerFile", 1).partitionBy("part").text(path)
    return readers.json_arrays(spark, path, "session_id long, place int, text string").select("session_id", F.col("place").alias("pos"), "text")


@R.add("S-05_json_lines", f"with {PR} select pair_id, generated, gold from pr")
def s05(spark, d):
    path = scratch(spark)
    rows = pr(spark, d).select(F.to_json(F.struct("pair_id", "generated", "gold")).alias("value"))
    rows.unionByName(rows.limit(1).select(F.lit("not json").alias("value"))).write.text(path)
    return readers.json_lines(spark, path, "pair_id long, generated string, gold string")


@R.add("S-06_nested_results", f"with {PR} select pair_id, stage from pr")
def s06(spark, d):
    path = scratch(spark)
    g = pr(spark, d).groupBy("stage").agg(F.to_json(F.struct(F.collect_list(F.struct("pair_id", "stage")).alias("detailed_results"))).alias("value"))
    g.select("stage", "value").write.partitionBy("stage").text(path)
    return readers.nested_results(spark, path, "detailed_results", "pair_id long, stage string")


@R.add("S-10_ts_archive", "select event_type as target, user_id::double as a, value as b from events")
def s10(spark, d):
    path = scratch(spark)
    e = table(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.concat(F.lit("?,"), F.col("value").cast("string")), "event_type").alias("value"))
    e.write.text(path)
    return tsfile.read_ts(spark, path).select("target", F.col("dims")[0][0].alias("a"), F.col("dims")[1][1].alias("b"))


@R.add("S-12_parquet_scan", "select embedding[1]::double as first, label from embeddings")
def s12(spark, d):
    return table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("first"), "label")


@R.add("S-14_discovery", "select count(*) - 1 as files from (select distinct l_returnflag, l_linestatus from lineitem)")
def s14(spark, d):
    path = scratch(spark)
    keys = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct().coalesce(1)
    keys.write.option("maxRecordsPerFile", 1).json(path)
    found = readers.files(spark, path, "*.json")
    return readers.files(spark, path, "*.json", found.orderBy("name").limit(1)).agg(F.count("*").alias("files"))


@R.add("S-16_diarization", f"with {TU} select session_id, speaker, lo / 1000.0::double as start from tu where speaker in ('client', 'therapist')")
def s16(spark, d):
    path = scratch(spark)
    t = tu(spark, d).filter("speaker in ('client', 'therapist')")
    t.select(F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA>", F.col("session_id").cast("string"), F.col("lo") / 1000, (F.col("hi") - F.col("lo")) / 1000, "speaker").alias("value")).write.text(path)
    return readers.diarization(spark, path).select(F.col("file").cast("long").alias("session_id"), "speaker", "start")


@R.add("S-17_quoted_pairs", f"with {SE} select itype as generated, lang as gold from se where itype is not null and lang is not null")
def s17(spark, d):
    s = se(spark, d).dropna(subset=["itype", "lang"])
    raw = s.groupBy("itype").agg(F.array_join(F.collect_list(F.to_json(F.struct(F.col("itype").alias("generated"), F.col("lang").alias("gold")))), " ... ").alias("raw"))
    return readers.quoted_pairs(raw, "raw", "generated", "gold").select("generated", "gold")


@R.add("S-18_reports", f"with {SE} select session_id, itype as kind, lang from se where itype is not null and lang is not null")
def s18(spark, d):
    s = se(spark, d).dropna(subset=["itype", "lang"])
    raw = s.select(F.concat(F.lit("Session: "), F.col("session_id").cast("string"), F.lit("\nKind: "), "itype", F.lit("\nLanguage: "), "lang").alias("raw"))
    return readers.report_fields(raw, "raw", ["Session", "Kind", "Language"]).select(F.col("Session").cast("long").alias("session_id"), F.col("Kind").alias("kind"), F.col("Language").alias("lang"))


@R.add("S-20_annotations", "select pair_id, template_id from predictions where stage = 'cot_ecg'")
def s20(spark, d):
    path = scratch(spark)
    sinks.append_lines(table(spark, d, "predictions").select("pair_id", "template_id", "stage"), path)
    return readers.json_lines(spark, path, "pair_id long, template_id int, stage string").filter("stage = 'cot_ecg'").drop("stage")


@R.add("K-01_partitioned_json", f"with {SE} select session_id, itype from se where itype is not null")
def k01(spark, d):
    path = scratch(spark)
    sinks.json_by(se(spark, d).filter("itype is not null").select("session_id", "itype"), path, "itype")
    return spark.read.schema("session_id long, itype string").json(path)


@R.add("K-02_append_lines", "select event_id from events")
def k02(spark, d):
    path, e = scratch(spark), table(spark, d, "events").select("event_id")
    sinks.append_lines(e.filter("event_id % 2 = 0"), path)
    sinks.append_lines(e.filter("event_id % 2 = 1"), path)
    return spark.read.schema("event_id long").json(path)


@R.add("K-05_append_csv", "select event_id, event_type from events")
def k05(spark, d):
    path, e = scratch(spark), table(spark, d, "events").select("event_id", "event_type")
    sinks.append_csv(e.filter("event_id % 2 = 0"), path)
    sinks.append_csv(e.filter("event_id % 2 = 1"), path)
    return spark.read.schema("event_id long, event_type string").option("header", True).csv(path)


@R.add("K-07_leads", "select vec_id, 0 as lead, generate_subscripts(embedding, 1) - 1 as i, round(unnest(embedding)::double, 6) as mv from embeddings")
def k07(spark, d):
    path = scratch(spark)
    sinks.leads(table(spark, d, "embeddings").select("vec_id", F.array(F.col("embedding").cast("array<double>")).alias("s")), path, "vec_id", "s")
    got = spark.read.schema("vec_id long, seconds double, mv double, lead int").option("header", True).csv(path)
    return got.select("vec_id", "lead", F.round(F.col("seconds") * 100).cast("int").alias("i"), F.round("mv", 6).alias("mv"))


@R.add("K-09_resume", "select event_id from events")
def k09(spark, d):
    path, e = scratch(spark), table(spark, d, "events").select("event_id")
    sinks.resume(spark, e.filter("event_id % 3 = 0"), path, ["event_id"], lambda x: x)
    sinks.resume(spark, e, path, ["event_id"], lambda x: x)
    return spark.read.parquet(path)


@R.add("K-10_pending", "select event_id from events where event_id not in (select event_id from events where event_type = 'view')")
def k10(spark, d):
    e = table(spark, d, "events")
    return sinks.pending(e, e.filter("event_type = 'view'"), ["event_id"]).select("event_id")


@R.add("K-12_shards", "select event_id from events")
def k12(spark, d):
    path = scratch(spark)
    sinks.shards(table(spark, d, "events").select("event_id"), path, 1000)
    return spark.read.parquet(path)


@R.add("R-01_resumable_stream", "select event_id, user_id from events")
def r01(spark, d):
    root = scratch(spark)
    table(spark, d, "events").select("event_id", "user_id").repartition(4).write.parquet(f"{root}/in")
    s = windows.file_stream(spark, f"{root}/in", "event_id long, user_id long", 2)
    for _ in range(2):  # the second run finds nothing new
        windows.run_once(s, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema("event_id long, user_id long").parquet(f"{root}/out")


@R.add("R-02_tumbling_windows", "select user_id, epoch_us(ts) // 86400000000 as day, count(*) as n, round(avg(value), 6) as mean, max(value) as high from events group by all")
def r02(spark, d):
    got = windows.tumbling(table(spark, d, "events"), "ts", ["user_id"], "value", "1 day")
    return got.select("user_id", F.expr("unix_micros(start) div 86400000000").alias("day"), "n", F.round("mean", 6).alias("mean"), F.col("max").alias("high"))


@R.add("R-03_session_windows", "with s as (select user_id, epoch_us(ts) as t, lag(epoch_us(ts)) over (partition by user_id order by ts) as p from events), g as (select user_id, t, sum(case when p is null or t - p >= 3600000000 then 1 else 0 end) over (partition by user_id order by t rows between unbounded preceding and current row) as g from s) select user_id, min(t) as start, count(*) as n from g group by user_id, g")
def r03(spark, d):
    got = windows.sessions(table(spark, d, "events"), "ts", ["user_id"], "1 hour")
    return got.select("user_id", F.unix_micros("start").alias("start"), "n")


@R.add("U-01_model_hook", f"with {PR} select pair_id, trim(input_text) as generated from pr where input_text is not null")
def u01(spark, d):
    rows = pr(spark, d).filter("input_text is not null").select("pair_id", "input_text")
    return models.generate(rows, "input_text").select("pair_id", "generated")


@R.add("U-02_evaluators", f"with {PR} select count(*) as n, avg(coalesce((generated = gold)::int, 0)) * 100 as score from pr")
def u02(spark, d):
    return models.evaluate(pr(spark, d), "exact", "gold", "generated")


@R.add("U-07_mean_embeddings", "with e as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(v::double) as v from e group by all) select label, round(sqrt(sum(v * v)), 6) as length from m group by 1")
def u07(spark, d):
    from larkline.operators import metrics

    got = metrics.mean_vectors(table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e")), ["label"], "e")
    return got.select("label", F.round(arrays.norm(F.col("vector")), 6).alias("length"))


@R.add("U-08_ridge_folds")
def u08(spark, d):
    o = ok(spark, d).dropna(subset=["au04_r", "au12_r", "au25_r"]).filter("au04_r between 0 and 5 and au12_r between 0 and 5 and au25_r between 0 and 5")
    return models.ridge_by_group(o, "itype", ["au04_r", "au25_r"], "au12_r")


@R.add("F-16_normal_answers", "select event_id, (case user_id % 3 when 0 then '2 cats' when 1 then 'dog 1' else 'cat' end) as answer from events")
def f16(spark, d):
    raw = F.when(F.col("user_id") % 3 == 0, "The two  cats!").when(F.col("user_id") % 3 == 1, "a dog, one").otherwise("An (cat).")
    return table(spark, d, "events").select("event_id", text.normal_answer(raw).alias("answer"))


@R.add("F-35_concatenated_features", f"with {OK}, s as (select patient_id, itype, subject_role, avg(au04_r) as a, avg(au12_r) as b from ok group by all), t as (select * from s where subject_role = 'therapist'), p as (select * from s where subject_role = 'patient') select t.patient_id, t.itype, round(t.a + p.b, 6) as ends from t join p using (patient_id, itype)")
def f35(spark, d):
    s = ok(spark, d).groupBy("patient_id", "itype", "subject_role").agg(F.array(F.avg("au04_r"), F.avg("au12_r")).alias("v"))
    t, p = (s.filter(F.col("subject_role") == r).select("patient_id", "itype", F.col("v").alias(r)) for r in ("therapist", "patient"))
    both = t.join(p, ["patient_id", "itype"]).withColumn("f", F.concat("therapist", "patient"))
    return both.select("patient_id", "itype", F.round(F.col("f")[0] + F.element_at("f", -1), 6).alias("ends"))


@R.add("F-36_mean_lines", f"with {OK}, s as (select patient_id, itype, subject_role, round(avg(au04_r), 6) as a, round(avg(au12_r), 6) as b from ok where au04_r is not null and au12_r is not null group by all) select patient_id, itype, subject_role, 'AU04_r=' || printf('%.3f', a) || ' AU12_r=' || printf('%.3f', b) as line from s")
def f36(spark, d):
    s = ok(spark, d).dropna(subset=["au04_r", "au12_r"]).groupBy("patient_id", "itype", "subject_role")
    m = F.create_map(F.lit("AU04_r"), F.round(F.avg("au04_r"), 6), F.lit("AU12_r"), F.round(F.avg("au12_r"), 6))
    return s.agg(arrays.mean_line(m).alias("line"))
