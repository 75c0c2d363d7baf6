"""Queries of the llm operators and, where SQL can say them, their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkline.core import scratch, table
from larkline.llm import mixing, packing, pairs, splits, transcripts, truncation
from larkline.plans.registry import Registry

R = Registry()

GROUPS_SQL = r"""newest as (select * from (select *, row_number() over (partition by session_id order by updated_at desc nulls last) as k from sessions) where k = 1),
ids as (select session_id,
 nullif(regexp_extract(upper(regexp_replace(patient_id, '[^0-9A-Za-z]', '', 'g')), '^(VP[0-9]{7})$', 1), '') as patient,
 nullif(regexp_extract(upper(regexp_replace(therapist_id, '[^0-9A-Za-z]', '', 'g')), '^(?:TH)?([A-Z][0-9][A-Z]{3})$', 1), '') as therapist,
 case lower(trim(split)) when 'training' then 'train' when 'valid' then 'val' when 'validation' then 'val' else lower(trim(split)) end as split from newest),
nodes as (select session_id, unnest(list_filter(['p' || patient, 't' || therapist], lambda x: x is not null)) as node from ids),
near as (select distinct a.session_id as s, b.node as n from nodes a join nodes b on a.session_id = b.session_id),
links as (select distinct a.node as a, b.node as b from nodes a join nodes b using (session_id)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a as node, min(b) as c from reach group by a),
grouped as (select distinct i.*, coalesce(c.c, 's' || i.session_id) as c from ids i left join nodes n using (session_id) left join comp c on c.node = n.node)"""


@R.add("p1_found")
def p1_found(spark, sf_dir):
    return pairs.defective_pairs(table(spark, sf_dir, "predictions"))


@R.add("p1_rates")
def p1_rates(spark, sf_dir):
    return pairs.defect_rates(table(spark, sf_dir, "predictions"))


@R.add("p5_found")
def p5_found(spark, sf_dir):
    langs = table(spark, sf_dir, "sessions").select("session_id", "lang")
    return transcripts.speaker_turns(table(spark, sf_dir, "segments"), langs).select("session_id", "turn_no", "speaker_id", "words")


@R.add("p5_turns")
def p5_turns(spark, sf_dir):
    langs = table(spark, sf_dir, "sessions").select("session_id", "lang")
    rows = table(spark, sf_dir, "turns").withColumn("text", F.col("speech_unsummarised"))
    return transcripts.speaker_turns(rows, langs, pos="turn_index").select("session_id", "turn_no", "speaker_id", "words")


@R.add(
    "p6_found",
    f"""with recursive {GROUPS_SQL}, bad as (select c, min(therapist) as g from grouped group by c having count(distinct split) > 1)
select session_id, g as group_therapist from grouped join bad using (c)""",
)
def p6_found(spark, sf_dir):
    return splits.split_conflicts(table(spark, sf_dir, "sessions"))


@R.add("p6_splits")
def p6_splits(spark, sf_dir):
    sessions, targets = table(spark, sf_dir, "sessions"), table(spark, sf_dir, "split_targets")
    store = splits.SplitStore(spark, scratch(spark))
    splits.assign_splits(sessions.filter("split is not null"), targets, store)  # what was split before
    return splits.assign_splits(sessions, targets, store)


@R.add("p6_report")
def p6_report(spark, sf_dir):
    return splits.split_report(p6_splits(spark, sf_dir), table(spark, sf_dir, "split_targets"))


@R.add("p6_check", "select count(distinct session_id) as sessions, 0 as twice, 0 as torn, 0 as changed from sessions where session_id is not null")
def p6_check(spark, sf_dir):
    """Of the assignment: sessions placed, those placed twice, components in two splits, kept sessions that moved."""
    rows = p6_splits(spark, sf_dir)
    torn = F.count_distinct(F.coalesce("split", F.lit("-"))) > 1
    per = rows.groupBy("component").agg(torn.cast("int").alias("torn"))
    moved = (F.col("status") == "kept") & F.col("old_split").isNotNull() & ~F.col("old_split").eqNullSafe(F.col("split"))
    one = rows.agg(F.count_distinct("session_id").alias("sessions"), (F.count("*") - F.count_distinct("session_id")).alias("twice"), F.sum(moved.cast("int")).alias("changed"))
    return one.select("sessions", F.col("twice").cast("int").alias("twice"), F.lit(per.agg(F.coalesce(F.sum("torn"), F.lit(0))).first()[0]).cast("int").alias("torn"), F.col("changed").cast("int").alias("changed"))


@R.add("p7_containers")
def p7_containers(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


@R.add("p7_fill")
def p7_fill(spark, sf_dir):
    return packing.packing_report(p7_containers(spark, sf_dir), table(spark, sf_dir, "pack_limits"))


@R.add("p7_check", "select limit_name, (select count(*) from documents where text <> '') as texts, 0 as too_full, 0 as torn, true as close from pack_limits")
def p7_check(spark, sf_dir):
    """Of the packing: texts placed, containers over the capacity, texts split though they fit, and few more containers than needed."""
    packed, limits = p7_containers(spark, sf_dir), table(spark, sf_dir, "pack_limits")
    packed = packed.join(limits, "limit_name").cache()
    full = packed.groupBy("limit_name", "container", "capacity_tokens").agg(F.sum("tokens").alias("t")).groupBy("limit_name")
    full = full.agg(F.sum((F.col("t") > F.col("capacity_tokens")).cast("int")).alias("too_full"), (F.count("*") <= 1.01 * F.ceil(F.sum("t") / F.max("capacity_tokens")) + 1).alias("close"))
    texts = packed.groupBy("limit_name", "doc_id", "capacity_tokens").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).groupBy("limit_name")
    texts = texts.agg(F.count("*").alias("texts"), F.sum(((F.col("n") > 1) & (F.col("t") <= F.col("capacity_tokens"))).cast("int")).alias("torn"))
    return full.join(texts, "limit_name").select("limit_name", "texts", F.col("too_full").cast("int").alias("too_full"), F.col("torn").cast("int").alias("torn"), "close")


@R.add("p8_mixture")
def p8_mixture(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@R.add("p8_shares")
def p8_shares(spark, sf_dir):
    return mixing.mixture_report(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@R.add("p8_check", "select source, true as share_met, true as within_repeats from mix_targets")
def p8_check(spark, sf_dir):
    """Of the mixture: each source's share within a thousandth of its target, repeats within the cap."""
    got = p8_shares(spark, sf_dir)
    return got.select("source", (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.001).alias("share_met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"))


@R.add("p9_found")
def p9_found(spark, sf_dir):
    return truncation.truncated_documents(table(spark, sf_dir, "documents")).filter("is_cut").select("doc_id").distinct()


@R.add("p9_rates")
def p9_rates(spark, sf_dir):
    return truncation.cut_rates(table(spark, sf_dir, "documents"))
