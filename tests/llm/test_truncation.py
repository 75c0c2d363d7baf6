import random

import pytest
from pyspark.sql import functions as F

from larkline.llm import truncation


@pytest.mark.parametrize(
    ("text", "kind"),
    [("", "empty"), (" \n", "empty"), ("All is well.", "closed"), ('"I just do not know ..."', "closed"), ("It was so har…", "marked"), ("and the client [...]", "marked"), ("a mean of 4.", "number"), ("Kind regards\nSupervision 12", "open"), ("the cli", "open")],
)
def test_closing(text, kind):
    assert truncation.closing(text)[0] == kind


def sentences(rnd, n):
    who, verb, what = ["client", "therapist", "neighbour", "sister", "landlord"], ["reports", "mentions", "remembers", "describes", "repeats"], ["the argument at home", "a lost friendship", "the crowded trains", "the sleepless nights", "the new contract"]
    return " ".join(f"The {rnd.choice(who)} {rnd.choice(verb)} {rnd.choice(what)} for the {rnd.randint(2, 99)}th time this {rnd.choice(['week', 'month', 'year'])}." for _ in range(n))


def corpus():
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        t = sentences(rnd, rnd.randint(3, 9))
        tail = rnd.choice(["", "", "\nStatus: closed", "\n- AU12: moderate\n- AU04: faint", "\nKind regards\nSupervision 12", " Answer: walking", " Answer: walking_up"])
        cut = i % 5 == 0
        if cut:
            k = rnd.randint(len(t) // 2, len(t) - 8)
            while t[k - 1] in ". " or t[k] in ". ":
                k -= 1
            t, tail = t[:k], rnd.choice(["", "", "…", " [...]"])
        rows.append((i, t + tail, cut))
    return rows


def test_cut_texts_are_found(spark):
    rows = corpus()
    got = {r.doc_id: r.is_cut for r in truncation.truncated_documents(spark.createDataFrame(rows, "doc_id long, text string, cut boolean")).collect()}
    wrong = [i for i, _, c in rows if got[i] != c]
    assert len(wrong) <= 4


def test_aligned_copies(spark):
    rnd = random.Random(9)
    full = sentences(rnd, 12)
    at = full.rindex("the", 0, len(full) - 20)
    short = full[:at] + "the"
    rows = [(1, full), (2, short), (3, short), (4, full[: full.rindex(". ") + 1]), (5, sentences(rnd, 12)), (6, None), (7, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.reason for r in truncation.truncated_documents(df).collect()}
    assert got == {1: None, 2: "copy_ends_early", 3: "copy_ends_early", 4: None, 5: None, 6: None, 7: None}
    assert truncation.ends_early(full[:-9], full) and not truncation.ends_early(full, full)


def bands(texts):
    return truncation.bands([truncation._hashes(truncation._words(t)[0]) for t in texts])


def test_bands_meet_near_copies():
    rnd, met, far = random.Random(1), 0, 0
    for _ in range(100):
        a = [f"w{rnd.randint(0, 5000)}" for _ in range(200)]
        b = list(a)
        b[rnd.randrange(200)] = "changed"
        (_, ask), (own, _), (other, _) = bands([" ".join(b[:-5]), " ".join(a), " ".join(reversed(a))])
        met += bool(set(ask) & set(own))
        far += bool(set(ask) & set(other))
    assert met >= 98 and far == 0
    assert bands(["too few words", ""]) == [([], []), ([], [])]


def test_bands_do_not_depend_on_the_batch():
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randint(0, 999)}" for _ in range(n)) for n in [8, 9, 11, 12, 13, 0, 3, 20, 68, 70_000, 132, 5]]
    assert bands(texts) == [bands([t])[0] for t in texts]
    long, cut = texts[9], " ".join(texts[9].split()[:40_000])
    assert set(bands([cut])[0][1]) & set(bands([long])[0][0])


@pytest.mark.parametrize("kept", [0.2, 0.5, 0.8])
@pytest.mark.parametrize("changed", [0.0, 0.02])
def test_planted_cuts_are_found_by_alignment(spark, kept, changed):
    """Copies that lost a part of their end, a few words altered: recall of the alignment alone."""
    rnd = random.Random(round(kept * 10 + changed * 1000))
    rows, cuts = [], set()
    for i in range(150):
        words = [f"v{rnd.randint(0, 3000)}" for _ in range(rnd.randint(80, 400))]
        rows.append((2 * i, " ".join(words) + "."))
        at = int(len(words) * kept)
        copy = [f"c{rnd.randint(0, 99)}" if j < at - 4 and rnd.random() < changed else w for j, w in enumerate(words[:at])]
        rows.append((2 * i + 1, " ".join(copy)))
        a, b = truncation.shingles(" ".join(copy[:-1])), set(truncation.shingles(" ".join(words)))
        if sum(x in b for x in a) >= 0.8 * len(a):  # else too much was altered for a copy
            cuts.add(2 * i + 1)
    found = truncation.truncated_documents(spark.createDataFrame(rows, "doc_id long, text string")).filter("reason = 'copy_ends_early'")
    got = {r.doc_id for r in found.collect()}
    assert len(cuts) >= 100 and got <= cuts and len(got) >= (0.99 if not changed else 0.9) * len(cuts)


def test_labels_and_status_lines_are_whole(spark):
    """Closing words that go on elsewhere are whole where the line they stand in ends all over the corpus."""
    rnd = random.Random(3)
    rows = [(i, sentences(rnd, 4) + " It is seen in lead II and in lead III. The end of the talk is near." + rnd.choice(["\nAnswer: lead II", "\nEnd of the talk"])) for i in range(30)]
    rows += [(100 + i, sentences(rnd, 4) + x) for i, x in enumerate([" It is seen in lead", " The end of the", "\nAnswer: lea", "\nAnswer: lead"])]
    got = {r.doc_id: r.is_cut for r in truncation.truncated_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, c in got.items() if c} == {100, 101, 102, 103}


def test_edges(spark):
    rows = [(1, "x " * 50_000 + "end."), (1, "same."), (1, "same."), (None, "cut in the mid"), (2, "ä")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("id", F.lit("a")).withColumn("word", F.lit("b")).withColumn("source", F.lit(" A-b")).withColumn("n", F.lit(0))
    assert truncation.truncated_documents(df).count() == 5
    assert truncation.truncated_documents(df.limit(0)).count() == 0
    rates = truncation.cut_rates(spark.createDataFrame([(i, t, "S 1" if i % 2 else None) for i, t, _ in corpus()], "doc_id long, text string, source string")).collect()
    assert {r.source for r in rates} == {"s_1", None} and sum(r.documents for r in rates) == 400
    twice = spark.createDataFrame([(1, "All is well.", "a"), (1, "All is w", "b"), (None, "All is well and", "b")], "doc_id long, text string, source string")
    assert {r.source: (r.documents, r.cut) for r in truncation.cut_rates(twice).collect()} == {"a": (1, 0), "b": (2, 2)}
