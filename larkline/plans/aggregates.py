"""Queries of aggregations and metrics (A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkline.core import table
from larkline.functions import text
from larkline.operators import clean, joins, metrics, turns
from larkline.plans.base import OK, PR, SE, TU, ok, pr, se, tu
from larkline.plans.joining import KEY, OKS, oks
from larkline.plans.registry import Registry

R = Registry()

K = "patient_id, subject_role, itype"

#: lb: label of both sides of the label-answering stages: what follows the last answer mark.
LB = PR + r""", lb as (select pair_id, stage, template_id, lower(trim(regexp_replace(regexp_replace(string_split(g, 'Answer: ')[-1], '<\|[^|>]*\|>|<eos>', '', 'g'), '[.!?,;:\s]+$', ''))) as p, lower(trim(regexp_replace(regexp_replace(string_split(r, 'Answer: ')[-1], '<\|[^|>]*\|>|<eos>', '', 'g'), '[.!?,;:\s]+$', ''))) as g from (select pair_id, stage, template_id, generated as g, gold as r from pr where stage <> 'stage6_psy' and generated is not null and gold is not null))"""


def lb(spark, d):
    rows = pr(spark, d).filter("stage <> 'stage6_psy' and generated is not null and gold is not null")
    return rows.select("pair_id", "stage", "template_id", text.label("generated").alias("p"), text.label("gold").alias("g"))


SLEEP = ["wake", "n1", "n2", "n3", "rem", "movement"]
SL = "('wake', 'n1', 'n2', 'n3', 'rem', 'movement')"


@R.add("A-01_counts", f"with {SE} select therapist, count(*) as n, count(distinct patient) as patients, array_to_string(list_sort(list_distinct(list(itype))), ',') as types from se where therapist is not null group by 1")
def a01(spark, d):
    g = se(spark, d).filter("therapist is not null").groupBy("therapist")
    return g.agg(F.count("*").alias("n"), F.count_distinct("patient").alias("patients"), F.array_join(F.sort_array(F.collect_set("itype")), ",").alias("types"))


@R.add("A-02_value_shares", f"with {SE}, c as (select split, itype, count(*) as n from se group by all) select split, itype, n, round(100.0::double * n / sum(n) over (partition by split), 6) as pct from c")
def a02(spark, d):
    return metrics.value_shares(se(spark, d), ["split"], "itype")


@R.add("A-03_window_statistics", f"with {OKS}, {TU} select session_id, subject_role, turn_index, lo, round(avg(au04_r), 6) as mean04, round(stddev_pop(au04_r), 6) as std04 from oks join tu using (session_id) where ms >= lo and ms < hi group by all having count(*) >= 10")
def a03(spark, d):
    got = joins.containment_join(oks(spark, d), tu(spark, d), ["session_id"], "ms", "lo", "hi", 10_000)
    g = got.groupBy("session_id", "subject_role", "turn_index", "lo").agg(F.count("*").alias("n"), F.round(F.avg("au04_r"), 6).alias("mean04"), F.round(F.stddev_pop("au04_r"), 6).alias("std04"))
    return g.filter("n >= 10").drop("n")


@R.add("A-04_six_statistics", f"with {OK} select {K}, round(avg(au12_r), 6) as mean, round(stddev_pop(au12_r), 6) as std, max(au12_r) as max, min(au12_r) as min, round(max(au12_r) - min(au12_r), 6) as range, round(quantile_cont(au12_r, 0.5), 6) as median from ok group by all")
def a04(spark, d):
    got = metrics.six_statistics(ok(spark, d), KEY, "au12_r")
    return got.select(*KEY, *[F.round(c, 6).alias(c) if c in ("mean", "std", "range", "median") else F.col(c) for c in got.columns[3:]])


@R.add("A-05_session_vectors", f"with {OKS}, {TU}, t as (select session_id, turn_index, lo, avg(au04_r) as a, avg(au12_r) as b from oks join tu using (session_id) where ms >= lo and ms < hi group by all) select session_id, round(avg(a), 6) as au04, round(avg(b), 6) as au12 from t group by 1")
def a05(spark, d):
    got = joins.containment_join(oks(spark, d), tu(spark, d), ["session_id"], "ms", "lo", "hi", 10_000)
    per = got.groupBy("session_id", "turn_index", "lo").agg(F.avg("au04_r").alias("a"), F.avg("au12_r").alias("b"))
    return per.groupBy("session_id").agg(F.round(F.avg("a"), 6).alias("au04"), F.round(F.avg("b"), 6).alias("au12"))


@R.add("A-06_mean_pooling", "with e as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings) select label, i, round(avg(v::double), 6) as v from e group by all")
def a06(spark, d):
    got = metrics.mean_vectors(table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding")), ["label"], "embedding")
    return got.select("label", F.posexplode("vector").alias("i", "v")).select("label", "i", F.round("v", 6).alias("v"))


@R.add("A-07_required_sessions", f"with {OK}, s as (select patient_id, itype, avg(au12_r) as v from ok group by all), q as (select * from (values ('T3', 'personal'), ('T5', 'personal'), ('T5', 'bindung'), ('T7', 'personal'), ('T7', 'bindung'), ('T7', 'wunder')) t(target, itype)) select patient_id, target, count(*) as sessions, round(avg(v), 6) as v from s join q using (itype) group by all")
def a07(spark, d):
    s = ok(spark, d).groupBy("patient_id", "itype").agg(F.avg("au12_r").alias("v"))
    need = {"personal": ["T3", "T5", "T7"], "bindung": ["T5", "T7"], "wunder": ["T7"]}
    table_ = F.create_map(*[x for k, v in need.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = s.select("patient_id", F.explode(table_[F.col("itype")]).alias("target"), "v")
    return rows.groupBy("patient_id", "target").agg(F.count("*").alias("sessions"), F.round(F.avg("v"), 6).alias("v"))


@R.add("A-08_summary", f"with {SE} select itype, count(pr) as n, round(avg(pr), 6) as mean, round(quantile_cont(pr, 0.5), 6) as median, round(stddev_pop(pr), 6) as sd, min(pr) as low, max(pr) as high from se group by 1")
def a08(spark, d):
    return se(spark, d).groupBy("itype").agg(
        F.count("pr").alias("n"), F.round(F.avg("pr"), 6).alias("mean"), F.round(F.percentile("pr", 0.5), 6).alias("median"), F.round(F.stddev_pop("pr"), 6).alias("sd"), F.min("pr").alias("low"), F.max("pr").alias("high")
    )


@R.add("A-09_quartiles", f"with {SE} select itype, round(quantile_cont(pr, 0.25), 6) as q1, round(quantile_cont(pr, 0.5), 6) as q2, round(quantile_cont(pr, 0.75), 6) as q3 from se group by 1")
def a09(spark, d):
    q = se(spark, d).groupBy("itype").agg(F.percentile("pr", [0.25, 0.5, 0.75]).alias("q"))
    return q.select("itype", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)])


@R.add("A-10_histogram", "with m as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) select least(cast(floor((o_totalprice - lo) / ((hi - lo) / 20)) as int), 19) as bin, count(*) as n from orders, m group by 1")
def a10(spark, d):
    o = table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("v"))
    lo, hi = o.agg(F.min("v"), F.max("v")).first()
    return o.groupBy(F.least(F.floor((F.col("v") - lo) / F.lit((hi - lo) / 20)).cast("int"), F.lit(19)).alias("bin")).agg(F.count("*").alias("n"))


@R.add("A-11_pivot", f"with {SE} select patient, round(avg(pr) filter (itype = 'personal'), 6) as personal, round(avg(pr) filter (itype = 'bindung'), 6) as bindung, round(avg(pr) filter (itype = 'wunder'), 6) as wunder from se where patient is not null group by 1")
def a11(spark, d):
    return se(spark, d).filter("patient is not null").groupBy("patient").pivot("itype", ["personal", "bindung", "wunder"]).agg(F.round(F.avg("pr"), 6))


@R.add("A-12_unpivot", f"with {SE}, u as (unpivot (select session_id, pr as T3_pr, inn as T5_in from se) on T3_pr, T5_in into name measure value v) select session_id, case left(measure, 2) when 'T3' then 'personal' else 'bindung' end as itype, v from u")
def a12(spark, d):
    wide = se(spark, d).select("session_id", F.col("pr").alias("T3_pr"), F.col("inn").alias("T5_in"))
    long = wide.unpivot("session_id", ["T3_pr", "T5_in"], "measure", "v").filter("v is not null")
    return long.select("session_id", F.when(F.left("measure", F.lit(2)) == "T3", "personal").otherwise("bindung").alias("itype"), "v")


@R.add("A-13_target_discovery", "with l as (select 'pr' as name, cast(blri_ges_pr as varchar) as v from sessions union all select 'lang', lang from sessions union all select 'in', blri_ges_in from sessions), s as (select name, count(*) as n, avg((isfinite(try_cast(v as double)) is true)::int) as r, count(distinct v) as classes from l where v is not null group by 1) select name, case when r >= 0.99 then 'regression' when classes >= 2 then 'classification' else 'none' end as task, n from s")
def a13(spark, d):
    s = table(spark, d, "sessions").select(F.col("blri_ges_pr").cast("string").alias("pr"), "lang", F.col("blri_ges_in").alias("in"))
    return metrics.discover_targets(s.unpivot([], ["pr", "lang", "in"], "name", "v"), "name", "v").select("name", "task", "n")


@R.add("A-14_last_filled", f"with {SE} select patient, arg_max(pr, (session_date, session_id)) filter (pr is not null) as pr, arg_max(inn, (session_date, session_id)) filter (inn is not null) as inn from se where patient is not null group by 1")
def a14(spark, d):
    order = F.struct("session_date", "session_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return se(spark, d).filter("patient is not null").groupBy("patient").agg(last("pr"), last("inn"))


@R.add("A-15_speaker_imbalance", "with s as (select session_id, sum((lower(trim(speaker_id)) = 'client')::int) as client, sum((lower(trim(speaker_id)) = 'therapist')::int) as therapist from segments group by 1) select session_id, coalesce(client, 0) as client, coalesce(therapist, 0) as therapist, coalesce(client, 0) + coalesce(therapist, 0) > 0 and least(coalesce(client, 0), coalesce(therapist, 0)) < 0.1 * (coalesce(client, 0) + coalesce(therapist, 0)) as imbalanced from s", longs=("client", "therapist"))
def a15(spark, d):
    return turns.speaker_shares(table(spark, d, "segments"), "session_id", "speaker_id")


@R.add("A-16_longest_speaker", f"with {TU}, s as (select session_id, speaker, sum((hi - lo) / 1000.0::double) as sec from tu where speaker is not null group by all) select session_id, arg_max(speaker, (round(sec, 6), speaker)) as client from s group by 1")
def a16(spark, d):
    return turns.longest_speaker(tu(spark, d).filter("speaker is not null"), "session_id", "speaker", (F.col("hi") - F.col("lo")) / 1000)


@R.add("A-17_majority_vote", f"with {LB}, c as (select stage, template_id, p, count(*) as n from lb group by all) select stage, template_id, arg_max(p, (n, p)) as p, max(n) as votes from c group by all")
def a17(spark, d):
    return metrics.majority(lb(spark, d), ["stage", "template_id"], "p")


@R.add("A-18_confusion", f"with {LB}, l as (select unnest(['wake', 'n1', 'n2', 'n3', 'rem', 'movement']) as x) select a.x as gold, b.x as pred, count(pair_id) as n from l a join l b on true left join lb on g = a.x and p = b.x and stage = 'cot_sleep' group by all")
def a18(spark, d):
    return metrics.confusion(lb(spark, d).filter("stage = 'cot_sleep'"), "g", "p", SLEEP)


@R.add("A-19_accuracy", f"with {LB} select stage, count(*) as total, sum((p = g)::int) as correct, sum((p <> g)::int) as incorrect, round(100.0::double * sum((p = g)::int) / count(*), 6) as pct from lb group by 1", longs=("correct", "incorrect"))
def a19(spark, d):
    hit = (F.col("p") == F.col("g")).cast("long")
    return lb(spark, d).groupBy("stage").agg(F.count("*").alias("total"), F.sum(hit).alias("correct"), F.sum(1 - hit).alias("incorrect"), F.round(100 * F.sum(hit) / F.count("*"), 6).alias("pct"))


def f1_sql(long: str, by: str = "") -> str:
    b = by + ", " if by else ""
    return f"c as (select {b}class, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(support) as support from ({long}) group by all), f as (select *, coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) as f1 from c)"


A20A = f1_sql("select stage, g as class, (p = g)::int as tp, 0 as fp, (p <> g)::int as fn, 1 as support from lb union all select stage, p, 0, 1, 0, 0 from lb where p <> g", "stage")


@R.add("A-20a_f1_open", f"with {LB}, {A20A} select stage, class, tp, fp, fn, round(f1, 6) as f1 from f", longs=("tp", "fp", "fn"))
def a20a(spark, d):
    return metrics.with_f1(metrics.class_counts(lb(spark, d), "g", "p", ["stage"])).select("stage", "class", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


A20B = f1_sql(f"select g as class, (p = g)::int as tp, 0 as fp, (p <> g)::int as fn, 1 as support from s union all select p, 0, 1, 0, 0 from s where p <> g and p in {SL} union all select unnest(['wake', 'n1', 'n2', 'n3', 'rem', 'movement']), 0, 0, 0, 0")


@R.add("A-20b_f1_allowed", f"with {LB}, s as (select * from lb where stage = 'cot_sleep'), {A20B} select class, tp, fp, fn, round(f1, 6) as f1 from f", longs=("tp", "fp", "fn"))
def a20b(spark, d):
    c = metrics.class_counts(lb(spark, d).filter("stage = 'cot_sleep'"), "g", "p", labels=SLEEP)
    return metrics.with_f1(c).select("class", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@R.add("A-20c_f1_supported", f"with {LB}, s as (select * from lb where stage = 'cot_sleep' and g in {SL}), {A20B} select class, tp, fp, fn, round(f1, 6) as f1 from f", longs=("tp", "fp", "fn"))
def a20c(spark, d):
    c = metrics.class_counts(lb(spark, d).filter("stage = 'cot_sleep'"), "g", "p", labels=SLEEP, skip_unknown_gold=True)
    return metrics.with_f1(c).select("class", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


A20D = f1_sql("select template_id, g as class, (p = g)::int as tp, 0 as fp, (p <> g)::int as fn, 1 as support from lb where stage = 'cot_ecg' union all select template_id, p, 0, 1, 0, 0 from lb where stage = 'cot_ecg' and p <> g", "template_id")


@R.add("A-20d_f1_template", f"with {LB}, {A20D} select template_id, round(avg(f1), 6) as macro_f1, count(*) as classes from f group by 1")
def a20d(spark, d):
    c = metrics.with_f1(metrics.class_counts(lb(spark, d).filter("stage = 'cot_ecg'"), "g", "p", ["template_id"]))
    return c.groupBy("template_id").agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("*").alias("classes"))


@R.add("A-21_averages", f"with {LB}, {A20A} select stage, round(sum(tp)::double / sum(support), 6) as accuracy, round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1, round(2.0::double * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) as micro_f1 from f group by 1")
def a21(spark, d):
    a = metrics.averages(metrics.class_counts(lb(spark, d), "g", "p", ["stage"]), ["stage"])
    return a.select("stage", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "micro_f1")])


@R.add("A-22_template_rollup", f"with {LB}, t as (select template_id, count(*) as n, avg((p = g)::int) as acc from lb where stage = 'cot_ecg' group by 1) select sum(n) as n, round(sum(acc * n) / sum(n), 6) as overall, round(avg(acc), 6) as mean_of_templates from t", longs=("n",))
def a22(spark, d):
    t = lb(spark, d).filter("stage = 'cot_ecg'").groupBy("template_id").agg(F.count("*").alias("n"), F.avg((F.col("p") == F.col("g")).cast("int")).alias("acc"))
    return t.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), 6).alias("overall"), F.round(F.avg("acc"), 6).alias("mean_of_templates"))


@R.add("A-23_regression", f"with {SE}, r as (select itype, pr as y, inn as x from se where pr is not null and inn is not null and itype is not null) select itype, count(*) as n, round(avg((y - x) ** 2), 6) as mse, round(avg(abs(y - x)), 6) as mae, round(1 - sum((y - x) ** 2) / (var_pop(y) * count(*)), 6) as r2, round(corr(x, y), 6) as r from r group by 1")
def a23(spark, d):
    got = metrics.regression(se(spark, d).filter("itype is not null"), "pr", "inn", ["itype"])
    return got.select("itype", "n", *[F.round(c, 6).alias(c) for c in ("mse", "mae", "r2", "r")])


@R.add("A-24_bin_accuracy", f"with {SE}, r as (select itype, pr as y, inn as x from se where pr is not null and inn is not null) select itype, round(avg(((y <= 3) = (x <= 3) and (y <= 4) = (x <= 4) and (y <= 5) = (x <= 5))::int), 6) as accuracy, round(avg(abs(y - x)), 6) as mae from r group by 1")
def a24(spark, d):
    r, edges = se(spark, d).dropna(subset=["pr", "inn"]), (3, 4, 5)
    same = clean.quantile_bin("pr", edges) == clean.quantile_bin("inn", edges)
    return r.groupBy("itype").agg(F.round(F.avg(same.cast("int")), 6).alias("accuracy"), F.round(F.avg(F.abs(F.col("pr") - F.col("inn"))), 6).alias("mae"))


@R.add("A-25_metric_means", f"with {SE} select itype, round(avg(coalesce(pr, 0)) * 100, 6) as pr, round(avg(coalesce(inn, 0)) * 100, 6) as inn from se group by 1")
def a25(spark, d):
    return se(spark, d).groupBy("itype").agg(*[F.round(F.avg(F.coalesce(c, F.lit(0.0))) * 100, 6).alias(c) for c in ("pr", "inn")])


RATERS = "k as (select o_orderkey // 4 as sample, o_orderpriority as v, o_orderkey as i from orders), q as (select least(a.v, b.v) as a, greatest(a.v, b.v) as b from k a join k b using (sample) where a.i < b.i)"


@R.add("A-26_agreement", f"with {RATERS} select a || ' ↔ ' || b as pair, count(*) as n, a = b as agreed from q group by all")
def a26(spark, d):
    from larkline.plans.joining import j19

    q = j19(spark, d).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return q.groupBy(F.concat("x", F.lit(" ↔ "), "y").alias("pair"), (F.col("x") == F.col("y")).alias("agreed")).agg(F.count("*").alias("n"))


@R.add("A-27_response_rates", "select o_orderpriority as question, case when grouping(o_clerk_group) = 1 then 'all' else o_clerk_group end as reviewer, count(*) as n, round(avg((o_orderstatus = 'F')::int), 6) as yes, round(avg((o_orderstatus = 'P')::int), 6) as partly from (select *, 'r' || (o_custkey % 4) as o_clerk_group from orders) group by grouping sets ((o_orderpriority), (o_orderpriority, o_clerk_group))")
def a27(spark, d):
    o = table(spark, d, "orders").withColumn("reviewer", F.concat(F.lit("r"), F.col("o_custkey") % 4))
    rate = lambda s: F.round(F.avg((F.col("o_orderstatus") == s).cast("int")), 6)
    g = o.groupingSets([["o_orderpriority"], ["o_orderpriority", "reviewer"]], "o_orderpriority", "reviewer")
    return g.agg(F.count("*").alias("n"), rate("F").alias("yes"), rate("P").alias("partly")).select(F.col("o_orderpriority").alias("question"), F.coalesce("reviewer", F.lit("all")).alias("reviewer"), "n", "yes", "partly")


@R.add("A-28_consensus", "with q as (select l_orderkey as question, l_returnflag as a, min(l_returnflag) over (partition by l_orderkey) as guess from lineitem), s as (select question, count(*) as n, sum((a = guess)::int) as m from q group by 1) select question, round((least(1.0::double, (m - 1) / 3.0::double) * m + least(1.0::double, m / 3.0::double) * (n - m)) / n, 6) as score from s")
def a28(spark, d):
    w = Window.partitionBy("l_orderkey")
    q = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question"), F.col("l_returnflag").alias("a"), F.min("l_returnflag").over(w).alias("guess"))
    return metrics.consensus(q, "question", "a", "guess").withColumn("score", F.round("score", 6))


@R.add("A-29_missing_classes", f"with {SE}, s as (select distinct split from se where split is not null), c as (select distinct therapist from se where therapist is not null) select s.split, c.therapist from s join c on true where not exists (select 1 from se where se.split = s.split and se.therapist = c.therapist)")
def a29(spark, d):
    s = se(spark, d)
    full = s.filter("therapist is not null").select("therapist").distinct().select(F.explode(F.array(*map(F.lit, ("train", "val", "test")))).alias("split"), "therapist")
    held = s.filter("split is not null").select("split").distinct()
    return full.join(held, "split", "left_semi").join(s.select("split", "therapist"), ["split", "therapist"], "left_anti")


@R.add("A-30_success_rates", f"with {TU} select session_id, round(avg((trim(coalesce(summary, '')) <> '')::int), 6) as success, round(avg(hi - lo), 6) as ms, round(avg(length(speech)), 6) as chars from tu group by 1")
def a30(spark, d):
    return tu(spark, d).groupBy("session_id").agg(F.round(F.avg((~clean.blank("summary")).cast("int")), 6).alias("success"), F.round(F.avg(F.col("hi") - F.col("lo")), 6).alias("ms"), F.round(F.avg(F.length("speech")), 6).alias("chars"))


@R.add("A-31_grid_extremes", "select p_size % 4 as length, p_partkey % 5 as n, min(p_retailprice)::double as low, max(p_retailprice)::double as high from part group by all")
def a31(spark, d):
    return table(spark, d, "part").groupBy((F.col("p_size") % 4).alias("length"), (F.col("p_partkey") % 5).alias("n")).agg(F.min("p_retailprice").cast("double").alias("low"), F.max("p_retailprice").cast("double").alias("high"))


@R.add("A-32_roc_auc", "with s as (select l_returnflag as flag, l_quantity::double as score, (l_linestatus = 'O')::int as y from lineitem), p as (select flag, score, sum(y) as p, sum(1 - y) as q from s group by all), b as (select *, coalesce(sum(q) over (partition by flag order by score rows between unbounded preceding and 1 preceding), 0) as below from p) select flag, round(sum(p * (below + q / 2.0::double)) / nullif(sum(p) * sum(q), 0), 6) as auc from b group by 1")
def a32(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("double").alias("score"), (F.col("l_linestatus") == "O").cast("int").alias("y"))
    return metrics.roc_auc(s, "score", "y", ["flag"]).select("flag", F.round("auc", 6).alias("auc"))


@R.add("A-33_duplicate_keys", "select session_id, pos, count(*) as n from segments group by all having count(*) > 1")
def a33(spark, d):
    return table(spark, d, "segments").groupBy("session_id", "pos").agg(F.count("*").alias("n")).filter("n > 1")


@R.add("A-34_balanced_batches", f"with {LB}, s as (select * from lb where stage = 'cot_sleep' and g in {SL}), r as (select pair_id, g, row_number() over (partition by g order by pair_id) - 1 as r from s), m as (select min(n) // 2 as batches from (select count(*) as n from s group by g)) select pair_id, g, r // 2 as batch from r, m where r // 2 < batches")
def a34(spark, d):
    from larkline.operators import splits

    return splits.balanced_batches(lb(spark, d).filter(F.col("stage").eqNullSafe("cot_sleep") & F.col("g").isin(*SLEEP)), "g", "pair_id", 2).select("pair_id", "g", "batch")


@R.add("A-35_turn_sequence", f"with {SE}, {TU}, j as (select patient, case itype when 'personal' then 0 when 'bindung' then 1 when 'wunder' then 2 end as rank, session_id, turn_index, lo, hi, speaker from se join tu using (session_id) where patient is not null and itype is not null) select patient, row_number() over (partition by patient order by rank, session_id, turn_index, lo, hi, speaker) as step, session_id, turn_index from j")
def a35(spark, d):
    rank = F.array_position(F.array(*map(F.lit, ("personal", "bindung", "wunder"))), F.col("itype"))
    j = se(spark, d).filter("patient is not null and itype is not null").withColumn("rank", rank).join(tu(spark, d), "session_id")
    w = Window.partitionBy("patient").orderBy("rank", "session_id", "turn_index", "lo", "hi", "speaker")
    return j.select("patient", F.row_number().over(w).alias("step"), "session_id", "turn_index")


@R.add("A-36_type_as_target", f"with {SE} select session_id, list_position(['bindung', 'personal', 'wunder'], itype) - 1 as target from se where itype is not null")
def a36(spark, d):
    pos = F.array_position(F.array(*map(F.lit, ("bindung", "personal", "wunder"))), F.col("itype")) - 1
    return se(spark, d).filter("itype is not null").select("session_id", pos.alias("target"))


@R.add("A-37_label_universe", r"with o as (select distinct trim(unnest(string_split(regexp_extract(input_text, '(?m)^Options: (.*)$', 1), ','))) as label, stage from predictions where contains(input_text, 'Options: ')) select stage, label from o where label <> ''")
def a37(spark, d):
    p = table(spark, d, "predictions").filter(F.col("input_text").contains("Options: "))
    names = p.select("stage", F.explode(F.split(F.regexp_extract("input_text", r"(?m)^Options: (.*)$", 1), ",")).alias("label"))
    return names.select("stage", F.trim("label").alias("label")).filter("label <> ''").distinct()


@R.add("A-38_permutation_mean", "select user_id, event_type, round(avg(value), 6) as score from (select *, row_number() over (partition by user_id, event_type order by event_id) as k from events) where k <= 6 group by all")
def a38(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return table(spark, d, "events").withColumn("k", k).filter("k <= 6").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("score"))


@R.add("A-39_known_rows", f"with {LB} select count(*) as n, sum((p not in {SL})::int) as unknown_pred, sum((g not in {SL})::int) as unknown_gold, sum((p in {SL} and g in {SL})::int) as known, round(avg((p = g)::int) filter (p in {SL} and g in {SL}), 6) as accuracy from lb where stage = 'cot_sleep'", longs=("unknown_pred", "unknown_gold", "known"))
def a39(spark, d):
    p, g = F.col("p").isin(*SLEEP), F.col("g").isin(*SLEEP)
    num = lambda c: F.sum(c.cast("long"))
    return lb(spark, d).filter("stage = 'cot_sleep'").agg(
        F.count("*").alias("n"), num(~p).alias("unknown_pred"), num(~g).alias("unknown_gold"), num(p & g).alias("known"), F.round(F.avg(F.when(p & g, (F.col("p") == F.col("g")).cast("int"))), 6).alias("accuracy")
    )


@R.add("A-40_metric_margins", f"with {LB} select coalesce(stage, 'all') as dataset, coalesce(cast(template_id as varchar), 'all') as model, round(avg((p = g)::int), 6) as accuracy from lb where stage = 'cot_ecg' group by grouping sets ((stage), (template_id))")
def a40(spark, d):
    rows = lb(spark, d).filter("stage = 'cot_ecg'").withColumn("hit", (F.col("p") == F.col("g")).cast("int"))
    g = rows.groupingSets([["stage"], ["template_id"]], "stage", "template_id").agg(F.round(F.avg("hit"), 6).alias("accuracy"))
    return g.select(F.coalesce("stage", F.lit("all")).alias("dataset"), F.coalesce(F.col("template_id").cast("string"), F.lit("all")).alias("model"), "accuracy")


@R.add("A-41_running_mean", "select user_id, event_id, round(sum(value * (1 + event_id % 3)) over w / sum(1 + event_id % 3) over w, 9) as mean from events window w as (partition by user_id order by event_id)")
def a41(spark, d):
    w, n = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0), 1 + F.col("event_id") % 3
    return table(spark, d, "events").select("user_id", "event_id", F.round(F.sum(F.col("value") * n).over(w) / F.sum(n).over(w), 9).alias("mean"))


@R.add("A-42_reviewer_pivot", "with k as (select o_orderkey // 4 as sample, o_orderpriority as v, row_number() over (partition by o_orderkey // 4 order by o_orderkey) as i from orders) select sample, coalesce(max(v) filter (i = 1), '') as reviewer_1, coalesce(max(v) filter (i = 2), '') as reviewer_2, coalesce(max(v) filter (i = 3), '') as reviewer_3, coalesce(max(v) filter (i = 4), '') as reviewer_4 from k group by 1")
def a42(spark, d):
    o = table(spark, d, "orders").select(F.expr("o_orderkey div 4").alias("sample"), F.col("o_orderpriority").alias("v"), "o_orderkey")
    k = o.withColumn("i", F.row_number().over(Window.partitionBy("sample").orderBy("o_orderkey")))
    most = k.agg(F.max("i")).first()[0] or 0  # a column for each reviewer of the largest sample
    wide = k.groupBy("sample").pivot("i", list(range(1, most + 1))).agg(F.max("v")).na.fill("")
    return wide.select("sample", *[F.col(str(i)).alias(f"reviewer_{i}") for i in range(1, most + 1)])
