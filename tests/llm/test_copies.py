"""Cut copies whose original is not the longest text of their bucket."""

from larkline.llm import truncation


def windows(text):
    return truncation.windows(*truncation._words(text))


def test_copies_meet_all_longer_texts(spark):
    """All texts in one bucket; only the last of thirty longer ones is the original."""
    words = [f"w{i}" for i in range(120)]
    texts = {"short": " ".join(words[:90]), "original": " ".join(words[:100]) + "."}
    texts |= {f"far{k}": " ".join(f"x{k}y{i}" for i in range(150 + k)) + "." for k in range(30)}
    ids = {k: i for i, k in enumerate(texts)}
    seen = {k: windows(x) for k, x in texts.items()}
    rows = [(ids[k], len(x), [7], [7] if k == "short" else [], int(seen[k][-1]), truncation.marks(seen[k])) for k, x in texts.items()]
    sketches = spark.createDataFrame(rows, "id long, n long, keys array<long>, ask array<long>, tail long, bits array<long>")
    t = spark.createDataFrame([(ids[k], x) for k, x in texts.items()], "id long, text string")
    assert [r.id for r in truncation._aligned(sketches, t, first=2).collect()] == [ids["short"]]


def test_containment_not_similarity():
    words = [f"w{i}" for i in range(120)]
    long = " ".join(words)
    assert truncation.ends_early(" ".join(words[:30]), long) and truncation.ends_early(long[:100], long)
    assert not truncation.ends_early(" ".join([*words[:30], *(f"x{i}" for i in range(30))]), long)


def test_ends_are_judged_where_they_align():
    words = " ".join(f"w{i}" for i in range(80))
    long = f"First one two three four. {words} one two three four and more."
    assert truncation.ends_early(f"First one two three four. {words} one two three four", long)
    long = f"Say one two three four and so on. {words} one two three four\nEnd here."
    assert not truncation.ends_early(f"Say one two three four and so on. {words} one two three four", long)


def test_bit_sets_hold_their_windows(spark):
    text = " ".join(f"w{i % 83}é{i}" for i in range(500))
    own, other = windows(text), windows(" ".join(f"x{i}" for i in range(3000)))
    rows = [(truncation.marks(own), int(h), True) for h in own] + [(truncation.marks(own), int(h), False) for h in other] + [([], 5, False)]
    df = spark.createDataFrame(rows, "bits array<long>, h long, own boolean").withColumn("may", truncation.may_hold("bits", "h"))
    held, missed, false = df.selectExpr("sum(int(own and may))", "sum(int(own and not may))", "sum(int(not own and may))").first()
    assert held == len(own) and missed == 0 and false < 0.06 * len(other)
    # A word cut short counts by its first letter.
    assert windows("one two three fo")[-1] == windows("One two three four five")[0] and len(windows("a b c")) == 0
