"""Queries of scalar functions (F), splits and samples (T) and hooks (U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkline.core import table
from larkline.functions import arrays, text
from larkline.operators import retrieval, splits
from larkline.plans.aggregates import LB, lb
from larkline.plans.base import PR, SE, TU, pr, se, tu
from larkline.plans.registry import Registry
from larkline.plans.series import ARR, K, arr
from larkline.plans.joining import KEY

R = Registry()



@R.add("F-01_file_parts", r"with f as (select distinct file_name, regexp_replace(file_name, '\.[^.]*$', '') as s from sessions where file_name is not null), t as (select file_name, s, string_split(replace(s, '-', '_'), '_') as t from f) select file_name, t[1] as ident, case when contains(lower(s), 'geschnitten') then t[-3] else t[-2] end as kind from t")
def f01(spark, d):
    ident, kind = text.file_parts("file_name")
    return table(spark, d, "sessions").filter("file_name is not null").select("file_name").distinct().select("file_name", ident.alias("ident"), kind.alias("kind"))


@R.add("F-02_type_names", "select interview_type as raw, case when contains(lower(trim(interview_type)), 'bind') then 'bindung' when starts_with(lower(trim(interview_type)), 'pers') or starts_with(lower(trim(interview_type)), 'st') then 'personal' when starts_with(lower(trim(interview_type)), 'wun') or contains(lower(trim(interview_type)), 'wf') then 'wunder' end as name, count(*) as n from frames group by all")
def f02(spark, d):
    from larkline.core import interview_type

    return table(spark, d, "frames").groupBy(F.col("interview_type").alias("raw"), interview_type("interview_type").alias("name")).agg(F.count("*").alias("n"))


@R.add("F-03_rename", r"select distinct file_name, regexp_replace(regexp_replace(regexp_replace(lower(file_name), '(\.csv)+$', '.csv'), '[-\s]+', '_', 'g'), '_in\.csv$', '_Inhalt.csv') as renamed from sessions where file_name is not null")
def f03(spark, d):
    x = F.regexp_replace(F.regexp_replace(F.lower("file_name"), r"(\.csv)+$", ".csv"), r"[-\s]+", "_")
    return table(spark, d, "sessions").filter("file_name is not null").select("file_name", F.regexp_replace(x, r"_in\.csv$", "_Inhalt.csv").alias("renamed")).distinct()


@R.add("F-04_drop_rules", r"select distinct file_name from sessions where file_name is not null and not regexp_matches(file_name, '(?i)^VP0000(003|005)') and not starts_with(file_name, 'NN')")
def f04(spark, d):
    f = F.col("file_name")
    return table(spark, d, "sessions").filter(f.isNotNull() & ~f.rlike("(?i)^VP0000(003|005)") & ~f.startswith("NN")).select("file_name").distinct()


@R.add("F-05_prefix_fixpoint", r"select distinct file_name, regexp_replace(file_name, '^(?:VP|0|NN-)+', '') as stem from sessions where file_name is not null")
def f05(spark, d):
    return table(spark, d, "sessions").filter("file_name is not null").select("file_name", text.without_prefixes("file_name", "VP", "0", "NN-").alias("stem")).distinct()


@R.add("F-06_stems", r"select distinct file_name, regexp_replace(file_name, '[-\s]+', '_', 'g') as stem from sessions where file_name is not null")
def f06(spark, d):
    return table(spark, d, "sessions").filter("file_name is not null").select("file_name", text.stem("file_name").alias("stem")).distinct()


@R.add("F-07_answers", f"with {PR} select pair_id, regexp_replace(regexp_replace(regexp_replace(string_split(generated, 'Answer: ')[-1], '<\\|[^|>]*\\|>|<eos>', '', 'g'), '^\\s+|\\s+$', '', 'g'), '\\.$', '') as answer from pr where generated is not null")
def f07(spark, d):
    return pr(spark, d).filter("generated is not null").select("pair_id", text.answer("generated").alias("answer"))


@R.add("F-08_last_labels", f"with {PR}, x as (select pair_id, regexp_replace(regexp_replace(generated, '^\\s+|\\s+$', '', 'g'), '<\\|[^|>]*\\|>|<eos>', '', 'g') as t from pr where generated is not null), y as (select pair_id, case when regexp_matches(t, '(?i)answer:') then string_split_regex(t, '(?i)answer:\\s*')[-1] else string_split_regex(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '\\s+')[-1] end as l from x) select pair_id, lower(regexp_replace(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '[.!?,;:\\s]+$', '')) as label from y")
def f08(spark, d):
    return pr(spark, d).filter("generated is not null").select("pair_id", text.last_label("generated").alias("label"))


STAGE_SQL = r"""x as (select pair_id, regexp_replace(regexp_replace(lower(trim(g)), '[.,;:!?\s]+$', ''), '^\([^)]{0,2}\)\s*(.)', '\1') as x from lb where lb.stage = 'cot_sleep'),
y as (select *, replace(replace(x, 'non rem', 'non-rem'), 'nrem', 'non-rem') as y from x)
select pair_id, case when x = 'w' then 'wake' when x in ('rem', 'rapid eye movement') then 'rem sleep' when x in ('artifact', 'artifacts', 'movement time') then 'movement'
 when x in ('1', 's1', 'n1', 'stage 1') then 'non-rem stage 1' when x in ('2', 's2', 'n2', 'stage 2') then 'non-rem stage 2' when x in ('3', 's3', 'n3', 'stage 3', '4', 's4', 'n4', 'stage 4') then 'non-rem stage 3'
 when contains(y, 'wake') then 'wake' when contains(y, 'rem') and not contains(y, 'non-rem') then 'rem sleep' when contains(y, 'movement') or contains(y, 'artifact') then 'movement'
 when contains(y, 'stage 4') or contains(y, 'stage 3') then 'non-rem stage 3' when contains(y, 'stage 2') or contains(y, 'spindle') or contains(y, 'k-complex') then 'non-rem stage 2'
 when contains(y, 'stage 1') then 'non-rem stage 1' else y end as stage from y"""


@R.add("F-09_sleep_stages", f"with {LB}, {STAGE_SQL}")
def f09(spark, d):
    return lb(spark, d).filter("stage = 'cot_sleep'").select("pair_id", text.sleep_stage("g").alias("stage"))


@R.add("F-10_choices", "select event_id, '(' || chr(cast(97 + user_id % 4 as int)) || ')' as choice from events")
def f10(spark, d):
    letter = F.char(97 + F.col("user_id") % 4)
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("The answer is ("), letter, F.lit(")"))).when(F.col("event_id") % 3 == 1, F.concat(letter, F.lit(") so"))).otherwise(F.concat(F.lit(" "), letter, F.lit(": yes")))
    return table(spark, d, "events").select("event_id", text.choice(raw).alias("choice"))


@R.add("F-11_categories", f"with {SE} select session_id, case when pr - inn between -1 and 1 then 'equally empathic' when pr - inn is not null then 'discrepancy' else 'unknown' end as category from se")
def f11(spark, d):
    diff = F.col("pr") - F.col("inn")
    said = F.when(diff.between(-1, 1), "I think so. Answer: discrepancy no, Answer: Equally empathic").when(diff.isNotNull(), "A discrepancy is seen").otherwise("nothing")
    return se(spark, d).select("session_id", text.category(said).alias("category"))


@R.add("F-12_plain", r"select pair_id, regexp_replace(lower(regexp_replace(gold, '^\s+|\s+$', '', 'g')), '[.,!?;:]+$', '') as plain from predictions where gold is not null")
def f12(spark, d):
    return table(spark, d, "predictions").filter("gold is not null").select("pair_id", text.plain("gold").alias("plain"))


@R.add("F-13_first_three", "select pair_id, left(generated, 3) = left(gold, 3) as same from predictions")
def f13(spark, d):
    return table(spark, d, "predictions").select("pair_id", (F.left("generated", F.lit(3)) == F.left("gold", F.lit(3))).alias("same"))


F14 = f"""with {PR}, x as (select pair_id, list_filter(string_split_regex(regexp_replace(lower(regexp_replace(generated, '^\\s+|\\s+$', '', 'g')), '[.,!?;:]+$', ''), '\\s+'), lambda w: w <> '') as a, list_filter(string_split_regex(regexp_replace(lower(regexp_replace(gold, '^\\s+|\\s+$', '', 'g')), '[.,!?;:]+$', ''), '\\s+'), lambda w: w <> '') as b from pr where generated is not null and gold is not null),
ta as (select pair_id, w, count(*) as n from (select pair_id, unnest(a) as w from x) group by all), tb as (select pair_id, w, count(*) as n from (select pair_id, unnest(b) as w from x) group by all), m as (select pair_id, sum(least(ta.n, tb.n)) as m from ta join tb using (pair_id, w) group by 1)
select x.pair_id, round(case when len(a) = 0 or len(b) = 0 then (len(a) = len(b))::int::double else 2.0::double * coalesce(m, 0) / (len(a) + len(b)) end, 6) as f1 from x left join m using (pair_id)"""


@R.add("F-14_token_f1", F14)
def f14(spark, d):
    return pr(spark, d).filter("generated is not null and gold is not null").select("pair_id", F.round(text.token_f1(F.col("generated"), F.col("gold")), 6).alias("f1"))


@R.add("F-15_bins_and_scores", r"select pair_id, nullif(regexp_extract(generated, '\b(yes|no|none)\b', 1), '') as word, try_cast(nullif(regexp_extract(generated, '(-?\d+(?:\.\d+)?)', 1), '') as double) as score from predictions where generated is not null")
def f15(spark, d):
    g = F.col("generated")
    return table(spark, d, "predictions").filter("generated is not null").select("pair_id", F.nullif(F.regexp_extract(g, r"\b(yes|no|none)\b", 1), F.lit("")).alias("word"), F.nullif(F.regexp_extract(g, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double").alias("score"))


@R.add("F-17_before_next", r"select pair_id, string_split(string_split_regex(generated, 'Question|Answer|Short')[1], ', ')[1] as head from predictions where generated is not null")
def f17(spark, d):
    return table(spark, d, "predictions").filter("generated is not null").select("pair_id", text.before_next("generated").alias("head"))


@R.add("F-18_descriptions", r"select pair_id, regexp_replace(regexp_replace(replace(regexp_replace(generated, '^[^:\n]{0,49}:\s*', ''), '*', ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') as text from predictions where generated is not null")
def f18(spark, d):
    return table(spark, d, "predictions").filter("generated is not null").select("pair_id", text.description("generated").alias("text"))


@R.add("F-19_sentence_chunks")
def f19(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.posexplode(text.pack_sentences("text", 40)).alias("chunk", "text"))


@R.add("F-20_wrapped")
def f20(spark, d):
    return tu(spark, d).filter("summary is not null").select("session_id", "turn_index", "lo", text.wrap("summary", 40).alias("lines"))


@R.add("F-21_sections", r"select pair_id, nullif(regexp_replace(regexp_extract(input_text, '(?s)Options:\s*(.*?)(?:\n\s*\n|$)', 1), '^\s+|\s+$', '', 'g'), '') as options from predictions")
def f21(spark, d):
    return table(spark, d, "predictions").select("pair_id", text.section("input_text", "Options:").alias("options"))


@R.add("F-22_context_sentences", f"with {SE} select session_id, concat_ws(' ', case when itype is not null then 'Interview: ' || itype || '.' end, case when lang is not null then 'Language: ' || lang || '.' end, case when pr is not null then 'Score: ' || printf('%.1f', pr) || '.' end) as context from se")
def f22(spark, d):
    parts = [F.when(F.col("itype").isNotNull(), F.concat(F.lit("Interview: "), "itype", F.lit("."))), F.when(F.col("lang").isNotNull(), F.concat(F.lit("Language: "), "lang", F.lit("."))), F.when(F.col("pr").isNotNull(), F.concat(F.lit("Score: "), F.format_string("%.1f", "pr"), F.lit(".")))]
    return se(spark, d).select("session_id", F.concat_ws(" ", *parts).alias("context"))


@R.add("F-23_prompts", f"with {ARR} select {K}, 'This is a series of ' || len(x) || ' values with mean ' || printf('%.4f', round(list_avg(x), 6)) || ' and std ' || printf('%.4f', round(list_stddev_pop(x), 6)) || '.' as prompt from s")
def f23(spark, d):
    from larkline.plans.base import ok

    o = ok(spark, d).withColumn("v", F.coalesce("au12_r", F.lit(0.0)))
    g = o.groupBy(*KEY).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("m"), F.round(F.stddev_pop("v"), 6).alias("sd"))
    return g.select(*KEY, F.format_string("This is a series of %d values with mean %.4f and std %.4f.", "n", "m", "sd").alias("prompt"))


@R.add("F-24_dyads", f"with {SE} select session_id, string_split(patient || '_' || itype, '_')[1] as id, string_split(patient || '_' || itype, '_')[2] as type from se where patient is not null and itype is not null")
def f24(spark, d):
    parts = F.split(F.concat_ws("_", "patient", "itype"), "_")
    return se(spark, d).filter("patient is not null and itype is not null").select("session_id", parts[0].alias("id"), parts[1].alias("type"))


@R.add("F-25_interview_text", f"with {TU} select session_id, string_agg('turn ' || turn_index || ' | ' || coalesce(speaker, '?') || ': ' || coalesce(summary, ''), chr(10) order by turn_index, lo, hi, coalesce(speaker, '?'), coalesce(summary, '')) as text from tu group by 1")
def f25(spark, d):
    who, said = F.coalesce("speaker", F.lit("?")), F.coalesce("summary", F.lit(""))
    rows = F.sort_array(F.collect_list(F.struct("turn_index", "lo", "hi", who.alias("w"), said.alias("s"))))
    line = lambda x: F.concat(F.lit("turn "), x["turn_index"].cast("string"), F.lit(" | "), x["w"], F.lit(": "), x["s"])
    return tu(spark, d).groupBy("session_id").agg(F.array_join(F.transform(rows, line), "\n").alias("text"))


@R.add("F-26_paths", r"select distinct file_name, regexp_replace(replace('C:\data\' || file_name, '\', '/'), '^([A-Za-z]):/', '/mnt/c/') as path from sessions where file_name is not null")
def f26(spark, d):
    p = F.translate(F.concat(F.lit("C:\\data\\"), "file_name"), "\\", "/")
    return table(spark, d, "sessions").filter("file_name is not null").select("file_name", F.regexp_replace(p, "^([A-Za-z]):/", "/mnt/c/").alias("path")).distinct()


@R.add("F-27_shortened", "select p_partkey, case when length(p_name) > 20 then left(p_name, 20) || '...' else p_name end as name from part")
def f27(spark, d):
    return table(spark, d, "part").select("p_partkey", text.shorten("p_name").alias("name"))


@R.add("F-30_digits", f"with {ARR} select {K}, array_to_string(list_transform(x, lambda v: trim(regexp_replace(cast(cast(floor(v * 1000 + 1e-9) as bigint) as varchar), '(.)', '\\1 ', 'g'))), ', ') || ', ' as digits from s")
def f30(spark, d):
    return arr(spark, d).select(*KEY, arrays.digits("x").alias("digits"))


@R.add("F-31_undigits", f"with {ARR} select {K}, round(list_sum(list_transform(x, lambda v: (floor(v * 1000 + 1e-9) + 0.5) / 1000)), 6) as total from s")
def f31(spark, d):
    back = arrays.undigits(arrays.digits("x"))
    return arr(spark, d).select(*KEY, F.round(F.aggregate(back, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@R.add("F-32_two_decimals", f"with {ARR} select {K}, array_to_string(list_transform(x, lambda v: '\"' || replace(printf('%.2f', abs(v)), '.', '') || '\"'), ',') as text from s")
def f32(spark, d):
    return arr(spark, d).select(*KEY, arrays.two_decimals(F.transform("x", F.abs)).alias("text"))


@R.add("F-33_parse_series", f"with {TU}, s as (select session_id, list(lo order by lo, hi, turn_index, speaker) as x from tu group by 1) select session_id, len(x) as n, list_sum(x)::double as total from s")
def f33(spark, d):
    rows = F.array_sort(F.collect_list("lo"))
    s = tu(spark, d).groupBy("session_id").agg(F.to_json(rows).alias("j")).withColumn("x", arrays.parse_series("j"))
    return s.select("session_id", F.size("x").alias("n"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"))


@R.add("F-34_bracketed_ints", "select o_orderkey, cast(o_orderkey as int) as n from orders")
def f34(spark, d):
    return table(spark, d, "orders").select("o_orderkey", arrays.first_int(F.concat(F.lit("["), "o_orderkey", F.lit("]"))).alias("n"))


@R.add("F-37_softmax", "with e as (select vec_id, list_transform(embedding, lambda v: v::double) as x from embeddings), s as (select vec_id, list_transform(x, lambda v: exp(v - list_max(x))) as e from e) select vec_id, round(list_max(e) / list_sum(e), 6) as confidence from s")
def f37(spark, d):
    x = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(arrays.softmax(x)), 6).alias("confidence"))


@R.add("F-38_unit_vectors", "with e as (select vec_id, list_transform(embedding, lambda v: v::double) as x from embeddings) select vec_id, round(x[1] / sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) as first from e")
def f38(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(arrays.unit(F.col("embedding"))[0], 6).alias("first"))


@R.add("F-39_divmod", f"with {TU} select session_id, turn_index, lo // 60000 as minutes, (lo % 60000) // 1000 as seconds from tu")
def f39(spark, d):
    return tu(spark, d).select("session_id", "turn_index", F.expr("lo div 60000").alias("minutes"), F.expr("(lo % 60000) div 1000").alias("seconds"))


@R.add("F-40_timestamps", "select event_id, epoch_us(ts) // 1000000 as seconds from events")
def f40(spark, d):
    return table(spark, d, "events").select("event_id", F.unix_seconds(F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")))).alias("seconds"))


@R.add("F-41_gib", "select p_partkey, case when p_size % 7 = 0 then -1.0::double else p_size * 1000000000.0::double / 1073741824 end as gib from part")
def f41(spark, d):
    n = F.when(F.col("p_size") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.col("p_size").cast("long") * 1000000000)
    return table(spark, d, "part").select("p_partkey", arrays.gib(n).alias("gib"))


@R.add("F-42_cache_keys", "select p_partkey, left(md5(p_name || '|' || p_size), 8) as key from part")
def f42(spark, d):
    return table(spark, d, "part").select("p_partkey", arrays.cache_key(F.col("p_name"), F.col("p_size").cast("string")).alias("key"))


@R.add("F-43_maps", f"with {SE} select session_id, pr as looked_up, (pr is not null)::int + (inn is not null)::int as entries from se")
def f43(spark, d):
    pairs = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("k"), F.col(c).alias("v"))) for c in ("pr", "inn")]))
    m = F.map_from_entries(pairs)
    return se(spark, d).select("session_id", F.try_element_at(m, F.lit("pr")).alias("looked_up"), F.size(m).alias("entries"))


@R.add("F-44_patch_counts", f"with {ARR} select {K}, cast(ceil(len(x) / 16.0) as bigint) as patches from s")
def f44(spark, d):
    return arr(spark, d).select(*KEY, arrays.patch_count(F.size("x"), 16).alias("patches"))


@R.add("F-45_base64", "select p_partkey, length(p_name) as bytes from part where length(p_name) > 12")
def f45(spark, d):
    raw = F.unbase64(F.base64(F.encode("p_name", "utf-8")))
    return table(spark, d, "part").select("p_partkey", F.length(raw).alias("bytes")).filter("bytes > 12")


@R.add("F-46_rounded_text", "select p_partkey, printf('%.2f', p_retailprice::double) as price from part")
def f46(spark, d):
    return table(spark, d, "part").select("p_partkey", F.format_string("%.2f", F.col("p_retailprice").cast("double")).alias("price"))


@R.add("F-47_dictionary_codes", "with l as (select distinct event_type from events), c as (select event_type, row_number() over (order by event_type) - 1 as code from l) select event_id, code from events join c using (event_type)")
def f47(spark, d):
    e = table(spark, d, "events")
    # A row a class by the time it is numbered; the planner checks its size before it broadcasts it.
    codes = e.select("event_type").distinct().withColumn("code", F.row_number().over(Window.orderBy("event_type")) - 1)
    return e.join(codes, "event_type").select("event_id", "code")


@R.add("T-02_limit", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 100")
def t02(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey")


T03 = """with u as (select vec_id, list_transform(embedding, lambda v: v::double / sqrt(list_sum(list_transform(embedding, lambda z: z::double * z::double)))) as x from embeddings),
s as (select q.vec_id as query, b.vec_id as neighbour, round(list_sum(list_transform(list_zip(q.x, b.x), lambda p: p[1] * p[2])), 9) as c from u q join u b on q.vec_id <> b.vec_id where q.vec_id % 100 = 0)
select query, neighbour, round(c, 6) as cosine, k as rank from (select *, row_number() over (partition by query order by c desc, neighbour) as k from s) where k <= 5"""


@R.add("T-03_nearest", T03)
def t03(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.top_k(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5).withColumn("cosine", F.round("cosine", 6))


@R.add("T-04_top_classes", "select event_type, string_agg(cast(event_id as varchar), ',' order by value desc, event_id) as top from (select *, row_number() over (partition by event_type order by value desc, event_id) as k from events) where k <= 5 group by 1")
def t04(spark, d):
    e = table(spark, d, "events")
    top = splits.first_per_group(e, ["event_type"], [F.desc("value"), F.col("event_id")], 5)
    rows = F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("v"), "event_id")))
    return top.groupBy("event_type").agg(F.array_join(F.transform(rows, lambda x: x["event_id"].cast("string")), ",").alias("top"))


@R.add("T-05_first_correct", f"with {LB}, r as (select *, row_number() over (partition by template_id order by pair_id) as k, count(*) over (partition by template_id) as n from lb where stage = 'cot_ecg' and p = g) select template_id, pair_id from r where k <= 2 and n >= 2")
def t05(spark, d):
    good = lb(spark, d).filter("stage = 'cot_ecg' and p = g")
    return splits.first_per_group(good, ["template_id"], [F.col("pair_id")], 2).select("template_id", "pair_id")


def hash_sql(x: str, seed: int, parts: int) -> str:
    return f"(({x} + {seed * 7919}) % 1000003 * 48271 % 2147483647 % {parts})"


@R.add("T-06_random_split", f"select o_orderkey, case when {hash_sql('o_orderkey', 42, 1000)} < 100 then 'test' when {hash_sql('o_orderkey', 42, 1000)} < 200 then 'val' else 'train' end as split from orders")
def t06(spark, d):
    return splits.random_split(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "split")


@R.add("T-07_stratified_split", f"with r as (select event_id, row_number() over (partition by event_type order by {hash_sql('event_id', 42, 1000003)}, event_id) as r, count(*) over (partition by event_type) as n from events) select event_id, case when r <= floor(n * 0.1) then 'test' when r <= floor(n * 0.1) + floor(n * 0.05) then 'val' else 'train' end as split from r")
def t07(spark, d):
    return splits.stratified_split(table(spark, d, "events"), "event_type", "event_id").select("event_id", "split")


@R.add("T-08_group_split", f"with {SE} select session_id, case when therapist in ('A0AAA', 'A9HEZ') then 'train' when therapist in ('R2ASV') then 'val' end as split from se")
def t08(spark, d):
    return splits.group_split(se(spark, d), "therapist", {"train": ["A0AAA", "A9HEZ"], "val": ["R2ASV"]}).select("session_id", "split")


@R.add("T-09_file_split", "select distinct file_name, case cast(regexp_extract(file_name, '([0-9])[-_]', 1) as int) when 9 then 'test' when 8 then 'val' else 'train' end as split from sessions where regexp_matches(file_name, '[0-9][-_]')")
def t09(spark, d):
    n = F.regexp_extract("file_name", "([0-9])[-_]", 1).cast("int")
    return table(spark, d, "sessions").filter(F.col("file_name").rlike("[0-9][-_]")).select("file_name", F.when(n == 9, "test").when(n == 8, "val").otherwise("train").alias("split")).distinct()


@R.add("T-10_fraction_split", f"with r as (select c_custkey, row_number() over (order by {hash_sql('c_custkey', 1, 1000003)}, c_custkey) as r, count(*) over () as n from customer) select c_custkey, case when r <= greatest(1, least(n - 1, cast(floor(n * 0.8) as bigint))) then 'a' else 'b' end as part from r")
def t10(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return splits.fraction_split(c, "c_custkey", 0.8, seed=1)


@R.add("T-11_leave_one_out", f"with {SE}, r as (select therapist, itype from se where therapist is not null and itype is not null), g as (select therapist, count(*) as test from r group by 1), n as (select count(*) as n, count(distinct itype) as k from r), l as (select itype, count(*) as total from r group by 1), o as (select therapist, count(*) as gone from (select therapist, itype, count(*) as c from r group by all) join l using (itype) where c = total group by 1) select therapist, n - test as train, test, k - coalesce(gone, 0) as classes, n - test >= 5 and k - coalesce(gone, 0) >= 2 as usable from g left join o using (therapist), n")
def t11(spark, d):
    return splits.leave_one_out(se(spark, d).filter("therapist is not null"), "therapist", "itype")


@R.add("T-12_reviewers", "with r as (select pair_id, row_number() over (partition by template_id order by pair_id) - 1 as i from predictions where stage = 'cot_ecg'), j as (select *, unnest([0, 1]) as j from r) select pair_id, ['r1', 'r2', 'r3', 'r4'][(i + j) % 4 + 1] as reviewer from j")
def t12(spark, d):
    p = table(spark, d, "predictions").filter("stage = 'cot_ecg'")
    return splits.assign_reviewers(p, ["template_id"], [F.col("pair_id")], ["r1", "r2", "r3", "r4"]).select("pair_id", "reviewer")


@R.add("T-13_sample", f"select event_id from events order by {hash_sql('event_id', 5, 1000003)}, event_id limit 500")
def t13(spark, d):
    return table(spark, d, "events").orderBy(splits.hash_share("event_id", 5, 1_000_003), "event_id").limit(500).select("event_id")


@R.add("T-14_mini_batches", f"with {LB} select pair_id, stage, (row_number() over (partition by stage order by pair_id) - 1) // 32 as batch from lb")
def t14(spark, d):
    b = F.floor((F.row_number().over(Window.partitionBy("stage").orderBy("pair_id")) - 1) / 32)
    return lb(spark, d).select("pair_id", "stage", b.alias("batch"))


