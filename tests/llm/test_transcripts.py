import numpy as np
from pyspark.sql import functions as F

from larkline.llm import boost, transcripts

SCHEMA = "session_id long, pos int, speaker_id string, start_s double, end_s double, text string"


def turns(spark, rows, lang="en", **extra):
    df = spark.createDataFrame(rows, SCHEMA)
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    langs = spark.createDataFrame([(s, lang) for s in {r[0] for r in rows if r[0] is not None}] or [(0, lang)], "session_id long, lang string")
    got = transcripts.speaker_turns(df, langs).select("session_id", "turn_no", "speaker_id", "words").collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_what_was_said(spark):
    rows = [
        (1, 3, "unknown", 9.0, 12.0, "<v Therapist> What would be  different after the miracle Er before the exam? #00:01:02-3#"),
        (1, 0, "Th.", 0.0, 2.0, "00:00:00,000 --> 00:00:02,000 You said (laughs) you were – uh – hopeful at 7:15, is that right? erm..."),
        (1, 1, "client", 4.0, 3.0, "[inaudible]"), (1, 2, "therapist ", 5.0, 6.0, "Uh-huh… *sniffs* I'm here. <5.0s>"),
        (1, 4, None, 13.0, 14.0, "00:00:13,000 --> 00:00:14,000 C - [00:13] {sighs} no"), (1, 4, None, 13.0, 14.0, "00:00:13,000 --> 00:00:14,000 C - [00:13] {sighs} no"), (1, 5, "K", 15.0, 16.0, None),
    ]
    assert turns(spark, rows) == [
        (1, 1, "therapist", "you said you were hopeful at 7 15 is that right i m here what would be different after the miracle before the exam"),
        (1, 2, "client", "no"),
    ]


def test_words_of_the_language_stay(spark):
    rows = [(1, 0, "Klient", 0.0, 1.0, "Klient: Er mmh, wollte um zehn ähm-ähm. reden, um 10:30 Uhr, öh. {lacht} aeh, hm")]
    assert turns(spark, rows, "de") == [(1, 1, "client", "er wollte um zehn reden um 10 30 uhr")]
    rows = [(1, 0, "client", 0.0, 1.0, "I um, was er ummm there. Her number, term")]
    assert turns(spark, rows, "en") == [(1, 1, "client", "i was there her number term")]


def test_edges(spark):
    assert turns(spark, [(None, None, None, None, None, "hello there")]) == [(None, 1, "client", "hello there")]
    assert turns(spark, [(1, 0, "client", 0.0, 1.0, " ")]) == []
    long = "word " * 30_000
    assert turns(spark, [(1, 0, "client", 0.0, 1.0, long)], words="x", said=3, at=None, who=1, lang="zz")[0][3] == long.strip()
    ties = [(1, 1, "client", 5.0, 5.0, "b"), (1, 0, "client", 5.0, 6.0, "a"), (1, 2, "therapist", None, None, "c")]
    assert turns(spark, ties) == [(1, 1, "client", "a b"), (1, 2, "therapist", "c")]
    assert transcripts.speaker_turns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_boosting_held_out():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = boost.fit(x[:3000], y[:3000])
    assert np.mean((boost.score(m, x[3000:]) > 0) == (y[3000:] > 0)) > 0.95
    assert boost.fit(x[:10], y[:10]) is None


def test_score_column_equals_score(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    m = boost.fit(x, (x[:, 0] + x[:, 2] > 0).astype(float), rounds=6)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r.s for r in df.select(boost.score_column(m, ["a", "b", "c"]).alias("s")).collect()]
    assert np.allclose(got, boost.score(m, x))


def features(spark, hide=0.0):
    seg = spark.read.parquet("/root/testdata/sf0.01/segments.parquet").filter("text is not null")
    rows = seg.select(
        F.col("session_id").alias("session"), F.col("pos").cast("long").alias("pos"), "speaker_id", F.least("start_s", "end_s").alias("at"), F.greatest("start_s", "end_s").alias("to"), "text", F.lit("en").alias("lang")
    ).distinct()
    rows = rows.withColumn("speaker", F.when(F.rand(7) >= hide, F.col("speaker_id")))
    return transcripts._features(transcripts.cleaned(rows, transcripts.train_fillers(rows, "lang", "text")).filter("words <> ''"))


def test_boundaries_without_labels(spark):
    """Held-out accuracy of the boundary model where both labels are hidden."""
    f = features(spark)
    model = transcripts.train_boundaries(f.filter("session % 2 = 0"), hidden=1.0)
    test = f.filter("session % 2 = 1 and known is not null and k0 is not null").withColumn("f_label", F.lit(0.5))
    ok = test.select(((boost.score_column(model, transcripts.FEATURES) > 0) == (F.col("known") != F.col("k0"))).cast("int").alias("ok"))
    assert ok.agg(F.avg("ok")).first()[0] > 0.9


def test_a_third_of_the_labels_masked(spark):
    """Speakers of whole turns with 30 % of the labels (and all tags of those) missing, against those with all."""
    seg = spark.read.parquet("/root/testdata/sf0.01/segments.parquet").filter("text is not null").distinct()
    seg = seg.withColumn("text", F.regexp_replace("text", r"(?i)(?:^|(?<=\\]))\\s*(?:client|klient(?:in)?|patient|pat|kl|therapist|therapeut(?:in)?|ther|th|[tkcp])\\.?\\s*(?::|-(?=\\s))", " "))
    masked = seg.withColumn("speaker_id", F.when(F.abs(F.hash("session_id", "pos")) % 10 >= 3, F.col("speaker_id")))

    def boundaries(df):
        got = transcripts.speaker_turns(df, None).select("session_id", "start", "speaker_id").collect()
        return {tuple(r) for r in got}

    whole, part = boundaries(seg), boundaries(masked)
    assert len(whole & part) >= 0.95 * len(whole)


def test_the_models_decide(spark):
    """Another boundary model gives other turns, another filler model other words, though all labels are known."""
    rows = [(1, i, ["client", "therapist"][i % 2], float(i), i + 0.5, f"word{i} um, there") for i in range(6)]
    df, langs = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, "en")], "session_id long, lang string")
    never = {"prior": -5.0, "trees": []}
    assert transcripts.speaker_turns(df, langs).count() == 6
    one = transcripts.speaker_turns(df, langs, model=never).collect()
    assert [(r.speaker_id, r.segments) for r in one] == [("client", 6)]
    keep = transcripts.Fillers(never, {})
    got = transcripts.cleaned(df.selectExpr("session_id session", "cast(pos as long) pos", "start_s at", "end_s to", "speaker_id speaker", "text", "'en' lang"), keep)
    assert {r.words for r in got.collect()} == {f"word{i} um there" for i in range(6)}


def test_filler_classifier_on_unseen_sounds(spark):
    texts = spark.createDataFrame([("en", "I was there, um, at home."), ("de", "Es geht um die Arbeit, ähm, und er weiß es.")], "lang string, text string")
    fillers = transcripts.train_fillers(texts, "lang", "text")
    new = {"en": ["uhhhh", "ummmm", "hmmmmm", "uuhm", "ermm", "mhmmm"], "de": ["ähhhh", "öhmm", "äähm", "hmmmm", "mhmmm", "öööh"]}
    words = {"en": ["there", "mother", "number", "harm", "room", "home", "hurt", "rum"], "de": ["um", "er", "mehr", "ihr", "arbeit", "warum", "mutter", "ehre"]}
    found = [fillers(lang, t) for lang in new for t in new[lang]]
    wrong = [t for lang in words for t in words[lang] if fillers(lang, t)]
    assert sum(found) >= 11 and wrong == []


def test_fillers_count_every_text_to_its_end(spark):
    texts = spark.range(25_000).select(F.lit("en").alias("lang"), F.lit("well, um, yes").alias("text"))
    long = spark.createDataFrame([("en", "word " * 1000 + "uhm, there um"), ("de", None)], "lang string, text string")
    pauses = transcripts.train_fillers(texts.union(long), "lang", "text").pauses
    assert pauses["en", "um"] == (25_001, 25_001) and pauses["en", "uhm"] == (1, 1)


def test_boundaries_are_learned_from_every_pair(spark):
    """25,001 pairs of which 6,001 change: no 20,000 of them have that share."""
    i = F.col("id")
    rows = spark.range(25_001).select(
        i.alias("session"), F.lit(1).alias("pos"), F.when(i <= 6_000, "client").otherwise("therapist").alias("known"), F.lit("therapist").alias("k0"),
        *((F.hash(i, F.lit(f)) % 7).cast("double").alias(f) for f in transcripts.FEATURES),
    )
    model = transcripts.train_boundaries(rows)
    assert np.isclose(model["prior"], np.log(6_001 / 19_000), rtol=1e-12)


def test_a_table_is_fitted_as_its_rows(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(3000, 3)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(c)) for r, c in zip(x, y, strict=True)], "a double, b double, c double, y double")
    whole = boost.fit_table(df.repartition(3), ["a", "b", "c"], "y")
    assert np.allclose(boost.score(whole, x), boost.score(boost.fit(x, y), x))
    assert boost.fit_table(df.filter("a > 99"), ["a", "b", "c"], "y") is None and boost.fit_table(df.limit(20), ["a", "b", "c"], "y") is None
