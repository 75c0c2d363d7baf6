"""Queries of joins (J) and set operations (U-A to U-D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkline.core import table
from larkline.operators import clean, joins
from larkline.plans.base import FR, OK, PR, SE, TU, fr, ok, pr, se, tu
from larkline.plans.registry import Registry

R = Registry()

#: A video of a session's frames, keyed like its turns.
OKS = f"{OK}, {SE}, oks as (select session_id, subject_role, frame, ts, cast(round(ts * 1000) as bigint) as ms, au04_r, au12_r, au25_r, confidence from ok join se on ok.patient_id = se.patient and ok.itype = se.itype)"


def oks(spark, d):
    s = se(spark, d).select("session_id", F.col("patient").alias("patient_id"), "itype")
    rows = ok(spark, d).join(s, ["patient_id", "itype"])
    return rows.select("session_id", "subject_role", "frame", "ts", F.round(F.col("ts") * 1000).cast("long").alias("ms"), "au04_r", "au12_r", "au25_r", "confidence")


@R.add("J-01_equi", f"with {SE} select d.doc_id, s.therapist from documents d join se s using (session_id)")
def j01(spark, d):
    return table(spark, d, "documents").join(se(spark, d), "session_id").select("doc_id", "therapist")


@R.add("J-02_last_write_wins", "with l as (select *, row_number() over (partition by session_id order by doc_id desc) as k from documents where session_id is not null) select s.session_id, l.doc_id from (select distinct session_id from sessions) s left join l on l.session_id = s.session_id and k = 1")
def j02(spark, d):
    last = joins.last_wins(table(spark, d, "documents").filter("session_id is not null"), ["session_id"], [F.col("doc_id")])
    return table(spark, d, "sessions").select("session_id").distinct().join(last.select("session_id", "doc_id"), "session_id", "left")


@R.add("J-03_four_part_key", f"with {PR}, {SE}, {TU} select pair_id, session_id from pr join se on pr.patient_id = se.patient and pr.therapist_id = se.therapist and pr.interview_type = se.itype join (select distinct session_id, turn_index from tu) t using (session_id, turn_index)")
def j03(spark, d):
    s = se(spark, d).select("session_id", F.col("patient").alias("patient_id"), F.col("therapist").alias("therapist_id"), F.col("itype").alias("interview_type"))
    t = tu(spark, d).select("session_id", "turn_index").distinct()
    return pr(spark, d).join(s, ["patient_id", "therapist_id", "interview_type"]).join(t, ["session_id", "turn_index"]).select("pair_id", "session_id")


BAND = "r as (select session_id, turn_index as ridx, lo + (turn_index % 5) * 40 as rlo, hi - (turn_index % 3) * 60 as rhi, row_number() over (partition by session_id order by lo, hi, turn_index, speaker) as rpos from tu)"


@R.add("J-04_band_match", f"with {TU}, one as (select * from (select *, row_number() over (partition by session_id, turn_index order by lo, hi, speaker) as k from tu) where k = 1), {BAND}, m as (select o.session_id, o.turn_index, rpos, ridx, row_number() over (partition by o.session_id, o.turn_index order by case when o.turn_index = ridx then 0 else 1 end, rpos) as k2 from one o join r on o.session_id = r.session_id and abs(lo - rlo) <= 100 and abs(hi - rhi) <= 100) select session_id, turn_index, rpos, ridx from m where k2 = 1")
def j04(spark, d):
    from pyspark.sql import Window

    t = tu(spark, d)
    one = clean.latest(t, ["session_id", "turn_index"], [F.col("lo"), F.col("hi"), F.col("speaker")]).select("session_id", "turn_index", "lo", "hi")
    i, w = F.col("turn_index"), Window.partitionBy("session_id").orderBy("lo", "hi", "turn_index", "speaker")
    r = t.select("session_id", i.alias("ridx"), (F.col("lo") + i % 5 * 40).alias("rlo"), (F.col("hi") - i % 3 * 60).alias("rhi"), F.row_number().over(w).alias("rpos"))
    m = joins.band_match(one, r, ["session_id"], "turn_index", ("turn_index", "ridx"), ("lo", "hi"), ("rlo", "rhi"), "rpos")
    return m.select("session_id", "turn_index", "rpos", "ridx")


@R.add("J-05_frames_in_turns", f"with {OKS}, {TU} select session_id, subject_role, turn_index, speaker, count(*) as frames, round(avg(au12_r) + 1e-9, 6) as au12 from oks join tu using (session_id) where ms >= lo and ms < hi group by all")
def j05(spark, d):
    got = joins.containment_join(oks(spark, d), tu(spark, d), ["session_id"], "ms", "lo", "hi", 10_000)
    # Means of 32 frames lie on half a digit: a billionth more, and the order of summing decides nothing.
    mean = F.round(F.avg("au12_r") + 1e-9, 6)
    return got.groupBy("session_id", "subject_role", "turn_index", "speaker").agg(F.count("*").alias("frames"), mean.alias("au12"))


@R.add("J-05_closed_windows", f"with {OKS}, {TU} select session_id, subject_role, turn_index, lo, count(*) as frames from oks join tu using (session_id) where ms >= lo and ms <= hi group by all")
def j05b(spark, d):
    got = joins.containment_join(oks(spark, d), tu(spark, d), ["session_id"], "ms", "lo", "hi", 10_000, "both")
    return got.groupBy("session_id", "subject_role", "turn_index", "lo").agg(F.count("*").alias("frames"))


SEG = "sg as (select distinct session_id, pos, cast(round(least(start_s, end_s) * 1000) as bigint) as slo, cast(round(greatest(start_s, end_s) * 1000) as bigint) as shi, text from segments where start_s is not null and end_s is not null)"


def sg(spark, d):
    lo, hi = clean.ordered("start_s", "end_s")
    ms = lambda c: F.round(c * 1000).cast("long")
    return table(spark, d, "segments").dropna(subset=["start_s", "end_s"]).select("session_id", "pos", ms(lo).alias("slo"), ms(hi).alias("shi"), "text").distinct()


@R.add("J-06_overlap_texts", f"with {TU}, {SEG}, t as (select distinct session_id, turn_index, lo, hi from tu) select t.session_id, t.turn_index, t.lo, coalesce(nullif(string_agg(coalesce(text, ''), ' ' order by slo, pos), ''), '[UNK]') as texts from t left join sg on sg.session_id = t.session_id and shi > lo and slo < hi group by all")
def j06(spark, d):
    t = tu(spark, d).select("session_id", "turn_index", "lo", "hi").distinct()
    both = joins.overlap_join(t, sg(spark, d), ["session_id"], ("lo", "hi"), ("slo", "shi"), 10_000)
    parts = F.sort_array(F.collect_list(F.struct("slo", "pos", F.coalesce("text", F.lit("")).alias("text"))))
    texts = both.groupBy("session_id", "turn_index", "lo", "hi").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("texts"))
    return t.join(texts, ["session_id", "turn_index", "lo", "hi"], "left").select("session_id", "turn_index", "lo", F.coalesce(F.nullif("texts", F.lit("")), F.lit("[UNK]")).alias("texts"))


GRID = "g0 as (select patient_id, subject_role, itype, min(ts) as t0, max(ts) as t1 from ok group by all), g as (select *, unnest(range(0, cast(floor(t1 - t0) as bigint) + 1)) as k from g0), gr as (select patient_id, subject_role, itype, k + t0 as ts from g)"


def grid(spark, d):
    g = ok(spark, d).groupBy("patient_id", "subject_role", "itype").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("t1") - F.col("t0"))))
    return g.select("patient_id", "subject_role", "itype", "t0", k.alias("k")).select("patient_id", "subject_role", "itype", (F.col("k") + F.col("t0")).alias("ts"))


KEY = ["patient_id", "subject_role", "itype"]


@R.add("J-07_asof_nearest", f"with {OK}, {GRID}, p as (select gr.*, o.frame as pf, o.ts as pt from gr asof left join ok o on gr.patient_id = o.patient_id and gr.subject_role = o.subject_role and gr.itype = o.itype and gr.ts >= o.ts), n as (select p.*, o.frame as nf, o.ts as nt from p asof left join ok o on p.patient_id = o.patient_id and p.subject_role = o.subject_role and p.itype = o.itype and p.ts <= o.ts) select patient_id, subject_role, itype, round(ts, 6) as ts, case when nt is null or ts - pt <= nt - ts then pf else nf end as frame from n")
def j07(spark, d):
    got = joins.asof_nearest(grid(spark, d), ok(spark, d), KEY, "ts", ["frame"])
    return got.withColumn("ts", F.round("ts", 6))


@R.add("J-08_interpolation", f"with {OK}, {GRID}, s as (select * from ok where au12_r is not null), p as (select gr.*, o.au12_r as pv, o.ts as pt from gr asof left join s o on gr.patient_id = o.patient_id and gr.subject_role = o.subject_role and gr.itype = o.itype and gr.ts >= o.ts), n as (select p.*, o.au12_r as nv, o.ts as nt from p asof left join s o on p.patient_id = o.patient_id and p.subject_role = o.subject_role and p.itype = o.itype and p.ts <= o.ts) select patient_id, subject_role, itype, round(ts, 6) as ts, round(case when pt is null then nv when nt is null or pt = nt then pv else pv + (nv - pv) * (ts - pt) / (nt - pt) end, 6) as au12_r from n")
def j08(spark, d):
    got = joins.interpolate(grid(spark, d), ok(spark, d).filter("au12_r is not null"), KEY, "ts", ["au12_r"])
    return got.select(*KEY, F.round("ts", 6).alias("ts"), F.round("au12_r", 6).alias("au12_r"))


CAND = "c as (select p.p_partkey, p.p_type, s.s_suppkey, (contains(lower(s.s_name), right(cast(p.p_partkey as varchar), 1)))::int + (contains(s.s_name, '00'))::int as score from (select distinct l_partkey, l_suppkey from lineitem) l join part p on p.p_partkey = l.l_partkey join supplier s on s.s_suppkey = l.l_suppkey)"


@R.add("J-09_candidate_scores", f"with {CAND}, b as (select *, row_number() over (partition by p_partkey order by score desc, s_suppkey) as k from c where score > 0) select p_partkey, s_suppkey, score from b where k = 1")
def j09(spark, d):
    # Candidates of a part are those who delivered it: a few each, whatever the tables' sizes.
    delivered = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    s = delivered.join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    p = table(spark, d, "part").select("p_partkey")
    name = F.col("s_name")
    score = F.lower(name).contains(F.right(F.col("p_partkey").cast("string"), F.lit(1))).cast("int") + name.contains("00").cast("int")
    return joins.best_candidate(p, s, ["p_partkey"], "p_partkey", score, [F.col("s_suppkey")]).select("p_partkey", "s_suppkey", "score")


TIER = "case when contains(file_name, 'geschnitten') then 1 when contains(lower(file_name), 'bind') or contains(lower(file_name), 'wun') or contains(lower(file_name), 'pers') then 2 else 3 end"


@R.add("J-10_tiers", f"with f as (select distinct session_id, file_name, {TIER} as tier from sessions where file_name is not null), s as (select distinct nullif(regexp_extract(upper(regexp_replace(patient_id, '[^0-9A-Za-z]', '', 'g')), '^(VP[0-9]{{7}})$', 1), '') as patient, session_id from sessions), m as (select patient, file_name, tier, row_number() over (partition by patient order by tier, length(file_name) desc, file_name) as k from f join s using (session_id) where patient is not null) select patient, file_name, tier from m where k = 1")
def j10(spark, d):
    f = table(spark, d, "sessions").filter("file_name is not null")
    from larkline.core import patient_key

    low = F.lower("file_name")
    tier = F.when(F.col("file_name").contains("geschnitten"), 1).when(low.contains("bind") | low.contains("wun") | low.contains("pers"), 2).otherwise(3)
    rows = f.select(patient_key("patient_id").alias("patient"), "file_name", tier.alias("tier")).filter("patient is not null").distinct()
    return clean.latest(rows, ["patient"], [F.col("tier"), F.desc(F.length("file_name")), F.col("file_name")])


@R.add("J-11_fuzzy_match", "with t as (select doc_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 4)) as toks from documents), c as (select t.doc_id, s.st, len(list_filter(toks, lambda x: contains(s.st, x))) as score, least(2, len(toks)) as need from t join (select source as st from mix_targets) s on true), b as (select *, row_number() over (partition by doc_id order by score desc, st) as k from c where score >= 1 and score >= need) select doc_id, st, score from b where k = 1")
def j11_fuzzy(spark, d):
    docs = table(spark, d, "documents")
    toks = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) > 4))
    # The catalogue is a fixed table of nine sources, so it travels inside the plan.
    names = [r[0] for r in table(spark, d, "mix_targets").select("source").collect()]
    both = docs.select("doc_id", toks.alias("toks"), F.explode(F.array(*map(F.lit, names))).alias("st"))
    score = joins.token_coverage(F.col("toks"), F.col("st"))
    both = both.withColumn("score", score).filter((F.col("score") > 0) & (F.col("score") >= F.least(F.lit(2), F.size("toks"))))
    return clean.latest(both, ["doc_id"], [F.desc("score"), F.col("st")]).select("doc_id", "st", "score")


@R.add("J-11_fuzzy_sources", "with t as (select doc_id, list_distinct(list_filter(string_split_regex(lower(source), '[^a-z]+'), lambda x: length(x) > 2)) as toks from documents where source is not null), c as (select t.doc_id, s.st, len(list_filter(toks, lambda x: contains(s.st, x))) as score, least(2, len(toks)) as need from t join (select source as st from mix_targets) s on true), b as (select *, row_number() over (partition by doc_id order by score desc, st) as k from c where score >= 1 and score >= need) select doc_id, st, score from b where k = 1")
def j11_sources(spark, d):
    """Raw spellings of a source against the catalogue of nine."""
    docs = table(spark, d, "documents").filter("source is not null")
    toks = F.array_distinct(F.filter(F.split(F.lower("source"), "[^a-z]+"), lambda x: F.length(x) > 2))
    names = [r[0] for r in table(spark, d, "mix_targets").select("source").collect()]
    both = docs.select("doc_id", toks.alias("toks"), F.explode(F.array(*map(F.lit, names))).alias("st"))
    both = both.withColumn("score", joins.token_coverage(F.col("toks"), F.col("st")))
    both = both.filter((F.col("score") > 0) & (F.col("score") >= F.least(F.lit(2), F.size("toks"))))
    return clean.latest(both, ["doc_id"], [F.desc("score"), F.col("st")]).select("doc_id", "st", "score")


@R.add("J-12_candidate_keys", f"with {FR}, {SE}, f as (select distinct patient_id, itype, subject_role from fr), r as (select patient_id as k, subject_role, 1 as size from f union select patient_id || '_' || itype, subject_role, 2 from f), l as (select session_id, unnest([patient, patient || '_' || itype]) as k from se where patient is not null and itype is not null), m as (select session_id, k, subject_role, size, row_number() over (partition by session_id order by size desc, k, subject_role) as n from l join r using (k)) select session_id, k, subject_role, size from m where n = 1")
def j12_keys(spark, d):
    f = fr(spark, d).select("patient_id", "itype", "subject_role").distinct()
    both = F.concat_ws("_", "patient_id", "itype")
    r = f.select(F.col("patient_id").alias("k"), "subject_role", F.lit(1).alias("size")).union(f.select(both, "subject_role", F.lit(2))).distinct()
    l = se(spark, d).filter("patient is not null and itype is not null").select("session_id", F.explode(F.array(F.col("patient"), F.concat_ws("_", "patient", "itype"))).alias("k"))
    return clean.latest(l.join(r, "k"), ["session_id"], [F.desc("size"), F.col("k"), F.col("subject_role")]).select("session_id", "k", "subject_role", "size")


@R.add("J-13_star_lookup", "select l_orderkey, l_linenumber, p_brand, s_name from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey")
def j13(spark, d):
    # Dimension sides: the planner broadcasts them while their size allows, and joins by shuffle beyond.
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return table(spark, d, "lineitem").join(p, "l_partkey").join(s, "l_suppkey").select("l_orderkey", "l_linenumber", "p_brand", "s_name")


@R.add("J-14_first_wins", f"with {SE}, f as (select patient, therapist, min(session_id) as first_session from se where patient is not null and therapist is not null group by all) select session_id, first_session from se join f using (patient, therapist)")
def j14(spark, d):
    s = se(spark, d).dropna(subset=["patient", "therapist"])
    return s.join(s.groupBy("patient", "therapist").agg(F.min("session_id").alias("first_session")), ["patient", "therapist"]).select("session_id", "first_session")


@R.add("J-15_dyad_rows", f"with {OK} select patient_id, itype, round(avg(au12_r) filter (subject_role = 'therapist'), 6) as therapist, round(avg(au12_r) filter (subject_role = 'patient'), 6) as patient from ok group by all having count(distinct subject_role) = 2")
def j15(spark, d):
    # One conditional aggregation instead of a self join.
    mean = lambda who: F.round(F.avg(F.when(F.col("subject_role") == who, F.col("au12_r"))), 6)
    got = ok(spark, d).groupBy("patient_id", "itype").agg(mean("therapist").alias("therapist"), mean("patient").alias("patient"), F.count_distinct("subject_role").alias("k"))
    return got.filter("k = 2").drop("k")


@R.add("J-16_semi", "select session_id from sessions where session_id in (select session_id from segments)")
def j16(spark, d):
    return table(spark, d, "sessions").join(table(spark, d, "segments"), "session_id", "left_semi").select("session_id")


@R.add("J-17_orphans", "select session_id, 'no_segments' as kind from (select distinct session_id from turns) where session_id not in (select session_id from segments) union all select session_id, 'no_turns' from (select distinct session_id from sessions) where session_id not in (select session_id from turns)")
def j17(spark, d):
    t, g, s = (table(spark, d, n).select("session_id").distinct() for n in ("turns", "segments", "sessions"))
    return t.join(g, "session_id", "left_anti").withColumn("kind", F.lit("no_segments")).union(s.join(t, "session_id", "left_anti").withColumn("kind", F.lit("no_turns")))


@R.add("J-18_default", "select p.pair_id, coalesce(q.template_id, -1) as template_id from (select distinct pair_id from predictions) p left join (select distinct pair_id, template_id from predictions where stage = 'cot_ecg') q using (pair_id)")
def j18(spark, d):
    p = table(spark, d, "predictions")
    q = p.filter("stage = 'cot_ecg'").select("pair_id", "template_id").distinct()
    return p.select("pair_id").distinct().join(q, "pair_id", "left").select("pair_id", F.coalesce("template_id", F.lit(-1)).alias("template_id"))


@R.add("J-19_rater_pairs", "with r as (select o_orderkey // 4 as sample, o_orderkey as pos, o_orderpriority as v from orders) select a.sample, a.pos as pos_a, b.pos as pos_b, a.v as a, b.v as b from r a join r b on a.sample = b.sample and a.pos < b.pos")
def j19(spark, d):
    # A sample has four raters: the rows of four keys in a row, so that every row takes part.
    o = table(spark, d, "orders").select(F.expr("o_orderkey div 4").alias("sample"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("v"))
    return joins.group_pairs(o, ["sample"], "pos", "v")


@R.add("J-20_grid_product", "select r_name, s.stage from region join (select distinct stage from predictions) s on true")
def j20(spark, d):
    regions = [r[0] for r in table(spark, d, "region").select("r_name").collect()]  # a fixed table of five
    return table(spark, d, "predictions").select("stage").distinct().select(F.explode(F.array(*map(F.lit, regions))).alias("r_name"), "stage")


@R.add("J-22_merge_new", f"with {SEG}, a as (select * from sg where pos % 2 = 0), b as (select * from sg where coalesce(pos % 2 <> 0 or pos % 3 = 0, true)) select session_id, pos, text from a union all select session_id, pos, text from b where not exists (select 1 from a where a.session_id = b.session_id and round(a.slo / 1000.0, 3) = round(b.slo / 1000.0, 3) and round(a.shi / 1000.0, 3) = round(b.shi / 1000.0, 3) and coalesce(a.text, '') = coalesce(b.text, ''))")
def j22(spark, d):
    s = sg(spark, d)
    key = [F.col("session_id"), F.round(F.col("slo") / 1000, 3), F.round(F.col("shi") / 1000, 3), F.coalesce("text", F.lit(""))]
    # Every segment is on a side: the even positions, and all others with every third again.
    new = s.filter("coalesce(pos % 2 <> 0 or pos % 3 = 0, true)")
    return joins.merge_new(s.filter("pos % 2 = 0"), new, key).select("session_id", "pos", "text")


@R.add("J-23_turns_with_predictions", f"with {PR}, {SE}, {TU} select distinct session_id, turn_index, speaker from tu where (session_id, turn_index) in (select (session_id, turn_index) from pr join se on pr.patient_id = se.patient and pr.interview_type = se.itype)")
def j23(spark, d):
    s = se(spark, d).select("session_id", F.col("patient").alias("patient_id"), F.col("itype").alias("interview_type"))
    keys = pr(spark, d).join(s, ["patient_id", "interview_type"]).select("session_id", "turn_index")
    return tu(spark, d).join(keys, ["session_id", "turn_index"], "left_semi").select("session_id", "turn_index", "speaker").distinct()


@R.add("U-A_concatenate", "select session_id, 'segments' as part from segments union all select session_id, 'turns' from turns")
def ua(spark, d):
    a, b = (table(spark, d, n).select("session_id", F.lit(n).alias("part")) for n in ("segments", "turns"))
    return a.unionByName(b)


@R.add("U-B_intersection", "select session_id from segments intersect select session_id from documents")
def ub(spark, d):
    return table(spark, d, "segments").select("session_id").intersect(table(spark, d, "documents").select("session_id"))


@R.add("U-C_difference", "select session_id from sessions except all select session_id from segments")
def uc(spark, d):
    return table(spark, d, "sessions").select("session_id").exceptAll(table(spark, d, "segments").select("session_id"))


@R.add("U-D_dedup_merge", "select distinct session_id, round(least(start_s, end_s), 1) as start_s from segments")
def ud(spark, d):
    return table(spark, d, "segments").select("session_id", F.round(F.least("start_s", "end_s"), 1).alias("start_s")).dropDuplicates()
