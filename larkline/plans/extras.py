"""Queries of registries, expansions, plans of files, histories and spellings, by the survey's ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkline import models
from larkline.core import scratch, table
from larkline.functions import text
from larkline.operators import joins, splits, timeseries
from larkline.plans.base import OK, PR, RECORDING, SE, TU, ok, pr, se, tu
from larkline.plans.functions import hash_sql
from larkline.plans.registry import Registry
from larkline.plans.series import ARR, K, arr
from larkline.sources import readers, sinks, tsfile
from larkline.streaming import windows

R = Registry()


def probes(spark, d, pairs: dict[str, str], f):
    """Every event with one of the spellings in turn, and what the function makes of it."""
    raw = F.element_at(F.array(*map(F.lit, pairs)), (F.col("event_id") % len(pairs) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", f(raw).alias("name"))


def probe_sql(pairs: dict[str, str]) -> str:
    names = ", ".join("'" + x.replace("'", "''") + "'" for x in pairs.values())
    return f"select event_id, [{names}][event_id % {len(pairs)} + 1] as name from events"


SPELLINGS = {
    "W": "wake", "(a) Wake": "wake", "Awake.": "wake", "n1": "non-rem stage 1", "S1;": "non-rem stage 1", "1": "non-rem stage 1", "(b) Non-REM stage 2": "non-rem stage 2",
    "nrem stage 2": "non-rem stage 2", "sleep stage 2": "non-rem stage 2", "k-complex": "non-rem stage 2", "sleep spindles": "non-rem stage 2", "(c) N3": "non-rem stage 3", "stage 4": "non-rem stage 3",
    "Non REM stage 4": "non-rem stage 3", "deep sleep, stage 3": "non-rem stage 3", "rapid eye movement": "rem sleep", "REM": "rem sleep", "rem sleep!": "rem sleep", "tonic REM phase": "rem sleep",
    "artifact": "movement", "Movement time": "movement", "body movements": "movement", "NREM": "non-rem", "unclear": "unclear", "": "",
}


@R.add("F-09_spellings", probe_sql(SPELLINGS))
def f09_spellings(spark, d):
    return probes(spark, d, SPELLINGS, text.sleep_stage)


ANSWERS = {
    "The two  cats!": "2 cats", "a dog, one": "dog 1", "An (cat).": "cat", "He doesnt know": "he doesn't know", "Im ten": "im 10", "It isnt the one": "it isn't 1",
    "they couldn'tve": "they couldn't've", "five oclock": "5 o'clock", "yall'd've": "y'all'd've", "somebody'd go": "somebodyd go", "she's here": "she's here", "None": "0", "yes/no": "yes no", "": "",
}


@R.add("F-16_contractions", probe_sql(ANSWERS))
def f16_contractions(spark, d):
    return probes(spark, d, ANSWERS, text.normal_answer)


STEMS = {"two dogs": "two dog", "berries and boxes": "berry and box", "the glasses": "the glass", "a bus is here": "a bus is here", "churches": "church", "controllers": "control", "riding ponies": "ride pony", "": ""}


@R.add("F-48_stems", probe_sql(STEMS))
def f48(spark, d):
    return probes(spark, d, STEMS, lambda c: text.stemmed(c, {"controllers": "control", "riding": "ride"}))


@R.add("F-49_equal_stack", "select event_id, user_id % 5 <> 0 as ok from events")
def f49(spark, d):
    path = scratch(spark)
    v = F.col("value").cast("string")
    second = F.when(F.col("user_id") % 5 == 0, v).otherwise(F.concat_ws(",", v, v))
    table(spark, d, "events").select(F.concat_ws(":", F.concat_ws(",", v, v), second, F.col("event_id").cast("string")).alias("value")).write.text(path)
    return tsfile.equal_stack(tsfile.read_ts(spark, path)).select(F.col("target").cast("long").alias("event_id"), "ok")


KERNELS = {k: [((7 * i) % 5 - 2 + i * (k - 1 - i) / k) / k for i in range(k)] for k in (7, 15, 31)}


def kernel_sql(k: int) -> str:
    half = k // 2
    parts = []
    for i, w in enumerate(KERNELS[k]):
        s = i - half
        x = "x" if s == 0 else f"coalesce({'lag' if s < 0 else 'lead'}(x, {abs(s)}) over w, 0)"
        parts.append(f"{w!r}::double * {x}")
    return " + ".join(parts)


@R.add(
    "W-16_kernels",
    f"with {OK}, x as (select {K}, frame, coalesce(au12_r, 0.0) as x from ok), c as (select {K}, {', '.join(f'{kernel_sql(k)} as y{k}' for k in KERNELS)} from x window w as (partition by {K} order by frame))"
    f" select {K}, {', '.join(f'round(max(y{k}), 6) as max{k}, round(avg(y{k}), 6) as mean{k}' for k in KERNELS)} from c group by all",
)
def w16_kernels(spark, d):
    o = ok(spark, d).withColumn("x", F.coalesce("au12_r", F.lit(0.0)))
    o = o.withColumns({f"y{k}": timeseries.convolve_same(o, RECORDING, [F.col("frame")], "x", w) for k, w in KERNELS.items()})
    pools = [f(F.col(f"y{k}")).alias(n) for k in KERNELS for f, n in ((lambda c: F.round(F.max(c), 6), f"max{k}"), (lambda c: F.round(F.avg(c), 6), f"mean{k}"))]
    return o.groupBy(*RECORDING).agg(*pools)


@R.add("T-01_sorted_turns", f"with {TU} select session_id, turn_index, lo, hi, row_number() over (partition by session_id order by lo, hi, turn_index, speaker) as place from tu")
def t01(spark, d):
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("lo", "hi", "turn_index", "speaker"))
    return tu(spark, d).select("session_id", "turn_index", "lo", "hi", place.alias("place"))


@R.add("T-15_batch_membership", "with r as (select event_id, event_type, row_number() over (partition by event_type order by event_id) - 1 as r from events), m as (select min(n) as m from (select count(*) as n from events group by event_type)) select event_id, event_type, r // 8 as batch from r, m where r // 8 < m // 8")
def t15(spark, d):
    return splits.balanced_batches(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 8)


@R.add("S-07_yaml_catalogue", f"with {SE} select session_id, patient, itype from se where itype is not null")
def s07(spark, d):
    path = scratch(spark)
    sinks.yaml_catalogue(se(spark, d).filter("itype is not null").select("session_id", "patient", "itype"), path)
    return readers.yaml_catalogue(spark, path, "session_id long, patient string, itype string")


@R.add("K-06_yaml_unless_there", f"with {SE} select session_id, lang from se where lang = 'de'")
def k06(spark, d):
    path, s = scratch(spark), se(spark, d).select("session_id", "lang")
    sinks.yaml_catalogue(s.filter("lang = 'en'"), path)
    sinks.yaml_catalogue(s.filter("lang = 'de'"), path, force=True)
    sinks.yaml_catalogue(s.filter("lang = 'en'"), path)  # it is there: nothing happens
    return readers.yaml_catalogue(spark, path, "session_id long, lang string")


@R.add("S-11_ecg_paths", "select o_orderkey, printf('%05d/%05d_hr', (o_orderkey // 1000) * 1000, o_orderkey) as path from orders")
def s11(spark, d):
    return table(spark, d, "orders").select("o_orderkey", readers.ecg_path("o_orderkey").alias("path"))


@R.add(
    "S-15_file_plan",
    r"""with f as (select distinct file_name as src, regexp_replace(lower(file_name), '[-\s]+', '_', 'g') as dst, nullif(regexp_extract(file_name, '(?i)(VP\d+)', 1), '') as ident from sessions where file_name is not null),
l as (select *, case when regexp_matches(src, '(?i)^VP0000(003|005)') then 'drop_rule' when ident is null then 'no_ident' end as lost from f),
m as (select *, min(case when lost is null then src end) over (partition by dst) as first from l)
select src, case when lost is null and first = src then dst end as dst, ident, case when lost is not null then lost when first < src then 'taken' when src = dst then 'same' else 'rename' end as reason from m""",
)
def s15(spark, d):
    name = F.col("file_name")
    target = F.regexp_replace(F.lower(name), r"[-\s]+", "_")
    return readers.file_plan(table(spark, d, "sessions"), "file_name", "(?i)^VP0000(003|005)", target, F.nullif(F.regexp_extract(name, r"(?i)(VP\d+)", 1), F.lit("")))


@R.add("K-03_merged_shards", "select event_id, value from events")
def k03(spark, d):
    root = scratch(spark)
    table(spark, d, "events").select("event_id", "value").repartition(6, "event_id").write.parquet(f"{root}/shards")
    spark.read.parquet(f"{root}/shards").coalesce(1).write.parquet(f"{root}/merged")
    return spark.read.parquet(f"{root}/merged")


@R.add("K-04_replaced_whole", "select event_id, value from events")
def k04(spark, d):
    path, e = f"{scratch(spark)}/t", table(spark, d, "events").select("event_id", "value")
    sinks.replace(e.filter("event_type = 'view'"), path)
    sinks.replace(e, path)
    return spark.read.parquet(path)


@R.add("K-08_cache_by_parameters", "select user_id, count(*) as n from events group by 1 union all select user_id + 1000000, count(*) from events where event_type = 'view' group by 1")
def k08(spark, d):
    root, e = scratch(spark), table(spark, d, "events")
    built = []

    def build(kind: str | None):
        def make():
            built.append(kind)
            return (e if kind is None else e.filter(F.col("event_type") == kind)).groupBy("user_id").agg(F.count("*").alias("n"))

        return make

    for _ in range(2):
        whole, some = (sinks.cached(spark, root, {"kind": k, "table": "events"}, build(k)) for k in (None, "view"))
    if built != [None, "view"]:
        raise AssertionError(f"built again: {built}")
    return whole.unionByName(some.withColumn("user_id", F.col("user_id") + 1_000_000))


@R.add("K-11_loss_history", "select (user_id % 7)::int as epoch, round(avg(value), 6) as train, round(max(value), 6) as val from events group by 1")
def k11(spark, d):
    path = scratch(spark)
    h = table(spark, d, "events").groupBy((F.col("user_id") % 7).cast("int").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("train"), F.round(F.max("value"), 6).alias("val"))
    sinks.append_history(h.filter("epoch < 3"), path)
    sinks.append_history(h.filter("epoch >= 3"), path)
    return sinks.history(spark, path)


@R.add("R-04_seeded_shuffle", f"select event_id, row_number() over (order by {hash_sql('event_id', 9, 1000003)}, event_id) - 1 as place from events where value is not null")
def r04(spark, d):
    return readers.shuffled(table(spark, d, "events"), "event_id", 9, F.col("value").isNotNull()).select("event_id", "place")


@R.add("R-05_resampled_shards", f"with s as (select distinct l_returnflag || l_linestatus as shard from lineitem), n as (select *, row_number() over (order by shard) - 1 as n, count(*) over () as k from s), g as (select range as draw from range(100)) select draw, shard from g join n on n.n = {hash_sql('(draw + 3000)', 42, 0).replace('% 0)', '% k)')}")
def r05(spark, d):
    shards = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("shard")).distinct()
    return readers.resampled(shards, "shard", 100, epoch=3)


@R.add(
    "R-06_late_events",
    """with m as (select (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 as mid, max(epoch_us(ts)) as hi from events)
select user_id, epoch_us(ts) // 86400000000 as day, count(*) as n from events, m where epoch_us(ts) > mid group by user_id, day, hi having (day + 1) * 86400000000 <= hi - 86400000000""",
)
def r06(spark, d):
    """The later half comes first; the earlier half, behind the watermark by then, is dropped."""
    root, e = scratch(spark), table(spark, d, "events").select("event_id", "user_id", "value", "ts")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi, last = e.agg(F.min(t), F.max(t), F.max_by("event_id", F.struct(t, "event_id"))).first()
    late = t <= (lo + hi) // 2
    for part in (e.filter(~late & (F.col("event_id") != last)), e.filter(F.col("event_id") == last), e.filter(late)):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    s = windows.file_stream(spark, f"{root}/in", e.schema, 1)
    windows.run_once(windows.tumbling(s, "ts", ["user_id"], "value", "1 day", late="1 day"), f"{root}/out", f"{root}/checkpoint")
    got = spark.read.parquet(f"{root}/out")
    return got.select("user_id", F.expr("unix_micros(start) div 86400000000").alias("day"), "n")


@R.add(
    "U-03_formatters",
    f"with {ARR}, m as (select *, list_transform(x, lambda v: abs(v)) as y from s) select {K}, case when subject_role = 'patient' then array_to_string(list_transform(y, lambda v: trim(regexp_replace(cast(cast(floor(v * 1000 + 1e-9) as bigint) as varchar), '(.)', '\\1 ', 'g'))), ', ') || ', '"
    " else array_to_string(list_transform(y, lambda v: '\"' || replace(printf('%.2f', v), '.', '') || '\"'), ',') end as text from m",
)
def u03(spark, d):
    model = F.when(F.col("subject_role") == "patient", "meta-llama/Llama-3.2-1B").otherwise("gpt-4o")
    return arr(spark, d).select(*RECORDING, models.format_series(F.transform("x", F.abs), model).alias("text"))


class Answers(models.SeriesDataset):
    """Predictions as a dataset: the question, a line on the answer's length, the reference answer."""

    def rows(self, spark, folder):
        return pr(spark, folder)

    def answer(self):
        return F.col("gold")

    def pre_prompt(self):
        return F.trim("input_text")

    def post_prompt(self):
        return F.lit("Answer:")

    def series(self):
        return F.array(F.struct(F.concat(F.lit("Characters: "), F.length("gold").cast("string")).alias("text"), F.array(F.length("gold").cast("double")).alias("values")))


@R.add("U-04_dataset_contract", f"with {PR} select pair_id, trim(input_text) || chr(10) || 'Characters: ' || length(gold) || chr(10) || 'Answer:' as prompt, gold || '<eos>' as answer from pr where gold is not null and input_text is not null")
def u04(spark, d):
    return Answers().samples(spark, d, "pair_id", "<eos>").filter("prompt is not null")


@R.add("U-06_registry")
def u06(spark, d):
    """Held-out error of the linear regressors and accuracy of the linear classifiers over recordings."""
    from pyspark.ml.feature import VectorAssembler

    o = ok(spark, d).dropna(subset=["au04_r", "au12_r", "au25_r"])
    rows = o.groupBy(*RECORDING).agg(*[F.avg(c).alias(c) for c in ("au04_r", "au12_r", "au25_r")]).dropna()
    rows = rows.withColumn("role", (F.col("subject_role") == "patient").cast("double")).withColumn("test", F.pmod(F.xxhash64("patient_id"), F.lit(5)) == 0)
    rows = VectorAssembler(inputCols=["au04_r", "au25_r"], outputCol="features").transform(rows).cache()
    train, test, out = rows.filter("not test"), rows.filter("test"), []
    n, spread = train.agg(F.count("*"), F.stddev_pop("au12_r")).first()
    for kind, label, registry in (("regressor", "au12_r", models.regressors(n, spread or 1.0, label="au12_r")), ("classifier", "role", models.classifiers(n, label="role"))):
        for name, model in registry.items():
            if name.startswith(("Ridge", "Lasso", "LogReg")):
                got = model.fit(train).transform(test)
                error = F.abs(F.col("prediction") - F.col(label)) if kind == "regressor" else (F.col("prediction") != F.col(label)).cast("double")
                out.append(got.agg(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.count("*").alias("n"), F.round(F.avg(error), 6).alias("error")))
    return reduce(lambda a, b: a.unionByName(b), out)


@R.add(
    "U-09_turn_prompts",
    f"with {TU}, t as (select *, unnest([1, 2]) as template from tu) select session_id, turn_index, template, 'Speaker: ' || speaker || chr(10) || case template when 1 then 'What was said: ' else 'Summarise: ' end || coalesce(speech, '') as prompt from t where speaker is not null",
)
def u09(spark, d):
    said = F.concat(F.lit("Speaker: "), F.col("speaker"), F.lit("\n"))
    asks = [F.struct(F.lit(i).alias("template"), F.concat(said, F.lit(w), F.coalesce("speech", F.lit(""))).alias("prompt")) for i, w in ((1, "What was said: "), (2, "Summarise: "))]
    return tu(spark, d).filter("speaker is not null").select("session_id", "turn_index", F.inline(F.array(*asks)))


@R.add("U-09_windows", f"with {TU}, w as (select session_id, turn_index, lo, hi, unnest(range(lo // 3000, hi // 3000 + 1)) as w from tu) select session_id, turn_index, w, least(hi, (w + 1) * 3000) - greatest(lo, w * 3000) as ms from w")
def u09_windows(spark, d):
    w = F.explode(F.sequence(F.floor(F.col("lo") / 3000), F.floor(F.col("hi") / 3000))).alias("w")
    rows = tu(spark, d).select("session_id", "turn_index", "lo", "hi", w)
    return rows.select("session_id", "turn_index", "w", (F.least("hi", (F.col("w") + 1) * 3000) - F.greatest("lo", F.col("w") * 3000)).alias("ms"))


@R.add("J-21_assignment")
def j21(spark, d):
    """Each vector of 64 numbers as scores of eight things for eight places."""
    v = F.col("embedding").cast("array<double>")
    m = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(v, i * 8 + 1, F.lit(8)))
    return joins.assign(table(spark, d, "embeddings").select("vec_id", m.alias("m")), "vec_id", "m", 0.0).withColumn("score", F.round("score", 6))
