"""Text expressions: answer extraction, labels, normalisation, packing, prompts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkline.operators.clean import col, strip

# Fixed value: marks that end a model's answer.
END_MARKS = r"<\|[^|>]*\|>|<eos>"


def answer(c: Column | str) -> Column:
    """What follows the last 'Answer: ', without end marks and a closing period; the whole text without a mark."""
    x = F.regexp_replace(F.element_at(F.split(col(c), "Answer: "), -1), END_MARKS, "")
    return F.regexp_replace(strip(x), r"\.$", "")


def label(c: Column | str) -> Column:
    """The answer in lower case without closing punctuation."""
    x = F.regexp_replace(F.element_at(F.split(col(c), "Answer: "), -1), END_MARKS, "")
    return F.lower(strip(F.regexp_replace(x, r"[.!?,;:\s]+$", "")))


def last_label(c: Column | str) -> Column:
    """After the last 'answer:' of any case, else the last word; closing punctuation off, lower case."""
    x = F.regexp_replace(strip(col(c)), END_MARKS, "")
    after = F.element_at(F.split(x, r"(?i)answer:\s*"), -1)
    word = F.element_at(F.split(strip(x), r"\s+"), -1)
    return F.lower(F.regexp_replace(strip(F.when(x.rlike("(?i)answer:"), after).otherwise(word)), r"[.!?,;:\s]+$", ""))


# Canonical sleep stages and the spellings that stand for them as a whole.
STAGES = ["wake", "non-rem stage 1", "non-rem stage 2", "non-rem stage 3", "rem sleep", "movement"]
STAGE_SPELLINGS = {
    "wake": ["w"],
    "rem sleep": ["rem", "rapid eye movement"],
    "movement": ["artifact", "artifacts", "movement time"],
    "non-rem stage 1": ["1", "s1", "n1", "stage 1"],
    "non-rem stage 2": ["2", "s2", "n2", "stage 2"],
    "non-rem stage 3": ["3", "s3", "n3", "stage 3", "4", "s4", "n4", "stage 4", "non-rem stage 4"],
}
# Words that name a stage within a phrase, in the order in which they count.
STAGE_WORDS = [
    ("wake", ["wake"]), ("rem sleep", ["rem"]), ("movement", ["movement", "artifact"]),
    ("non-rem stage 3", ["stage 4", "stage 3"]), ("non-rem stage 2", ["stage 2", "spindle", "k-complex"]), ("non-rem stage 1", ["stage 1"]),
]


def sleep_stage(c: Column | str) -> Column:
    """Canonical sleep stage of a label's spelling; what names none stays as it is, in lower case.

    Closing punctuation and a leading option mark such as '(a)' are taken off first.
    """
    x = F.regexp_replace(F.lower(strip(c)), r"[.,;:!?\s]+$", "")
    x = F.regexp_replace(x, r"^\([^)]{0,2}\)\s*(?=.)", "")
    whole = F.lit(None)
    for stage, names in STAGE_SPELLINGS.items():
        whole = F.coalesce(whole, F.when(x.isin(names), stage))
    y = F.regexp_replace(F.regexp_replace(x, "non rem", "non-rem"), "nrem", "non-rem")
    named = F.when(y.isin(STAGES), y).when(y == "non-rem stage 4", "non-rem stage 3")
    for stage, words in STAGE_WORDS:
        has = F.lit(False)
        for w in words:
            has = has | (y.contains(w) & ~y.contains("non-rem") if w == "rem" else y.contains(w))
        named = named.when(has, stage)
    return F.coalesce(whole, named, y)


def choice(c: Column | str) -> Column:
    """(a) of '(a)', 'a)' or 'a:' anywhere in the text, else the text in lower case."""
    x = F.lower(strip(c))
    got = F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in (r"\(([a-z])\)", r"(?:^|\s)([a-z])\)", r"(?:^|\s)([a-z]):")])
    return F.coalesce(F.concat(F.lit("("), got, F.lit(")")), x)


def category(c: Column | str) -> Column:
    """The last category named after an answer mark, else by keyword, else unknown."""
    x = F.lower(col(c))
    named = F.regexp_extract_all(x, F.lit(r"answer:\s*(equally empathic|discrepancy)"), F.lit(1))
    word = F.when(x.contains("discrepancy"), "discrepancy").when(x.contains("equally empathic"), "equally empathic").otherwise("unknown")
    return F.coalesce(F.try_element_at(named, F.lit(-1)), word)


def plain(c: Column | str) -> Column:
    """Lower case, white space trimmed, closing punctuation off."""
    return F.regexp_replace(F.lower(strip(c)), r"[.,!?;:]+$", "")


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the multisets of white-space tokens."""
    def words(t: Column) -> Column:
        return F.filter(F.split(plain(t), r"\s+"), lambda w: w != "")

    def score(p: Column) -> Column:
        x, y = p["x"], p["y"]
        count = lambda arr, w: F.size(F.filter(arr, lambda v: v == w))
        both = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, w: n + F.least(count(x, w), count(y, w)))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), (F.size(x) == F.size(y)).cast("double")).otherwise(2.0 * both / (F.size(x) + F.size(y)))

    # The word lists are made once a row, not anew for every word compared.
    return F.transform(F.array(F.struct(words(a).alias("x"), words(b).alias("y"))), score)[0]


def file_parts(c: Column | str) -> tuple[Column, Column]:
    """Identifier and interview type of a file name: first token, and the last but one (but two if cut)."""
    stem = F.regexp_replace(col(c), r"\.[^.]*$", "")
    t = F.split(F.translate(stem, "-", "_"), "_")
    kind = F.when(F.lower(stem).contains("geschnitten"), F.try_element_at(t, F.lit(-3))).otherwise(F.try_element_at(t, F.lit(-2)))
    return F.try_element_at(t, F.lit(1)), kind


def without_prefixes(c: Column | str, *prefixes: str) -> Column:
    """The prefixes taken off until none is left."""
    return F.regexp_replace(col(c), "^(?:" + "|".join(prefixes) + ")+", "")


def stem(c: Column | str) -> Column:
    """Hyphens and white space as one underscore."""
    return F.regexp_replace(col(c), r"[-\s]+", "_")


def description(c: Column | str) -> Column:
    """A short preface up to a colon, stars and surplus white space taken out."""
    x = F.regexp_replace(col(c), r"^[^:\n]{0,49}:\s*", "")
    return strip(F.regexp_replace(F.regexp_replace(x, r"\*", ""), r"\s+", " "))


def before_next(c: Column | str) -> Column:
    """A generation up to the next 'Question', 'Answer' or 'Short', then up to the first ', '."""
    return F.split(F.split(col(c), "Question|Answer|Short", 2)[0], ", ", 2)[0]


def section(c: Column | str, mark: str) -> Column:
    """Text between a mark and the next blank line or the end, else null."""
    return F.nullif(strip(F.regexp_extract(col(c), rf"(?s){mark}\s*(.*?)(?:\n\s*\n|$)", 1)), F.lit(""))


def sentences(c: Column | str) -> Column:
    """Sentences split at white space after ., ! or ?."""
    return F.filter(F.split(strip(c), r"(?<=[.!?])\s+"), lambda x: x != "")


def pack_sentences(c: Column | str, budget: int) -> Column:
    """Chunks of whole sentences of at most ``budget`` words; longer sentences are cut by words."""
    words = lambda s: F.split(s, r"\s+")
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(words(s)) - 1) / budget).cast("int")), lambda i: F.array_join(F.slice(words(s), i * budget + 1, F.lit(budget)), " "))
    pieces = F.flatten(F.transform(sentences(c), cut))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        k = F.size(words(s))
        fits = (a["n"] + k <= budget) & (a["n"] > 0)
        return F.struct(
            F.when(fits | (a["n"] == 0), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"),
            F.when(fits, F.concat(a["open"], F.lit(" "), s)).otherwise(s).alias("open"), F.when(fits, a["n"] + k).otherwise(k).alias("n"),
        )

    return F.aggregate(pieces, start, step, lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def wrap(c: Column | str, width: int) -> Column:
    """Greedy lines of at most ``width`` characters, joined by line ends; longer words stand alone."""
    words = F.filter(F.split(strip(c), r"\s+"), lambda x: x != "")

    def step(a: Column, w: Column) -> Column:
        fits = (F.length(a["line"]) + 1 + F.length(w) <= width) & (a["line"] != "")
        full = F.when(a["text"] == "", a["line"]).otherwise(F.concat(a["text"], F.lit("\n"), a["line"]))
        return F.struct(F.when(fits | (a["line"] == ""), a["text"]).otherwise(full).alias("text"), F.when(fits, F.concat(a["line"], F.lit(" "), w)).otherwise(w).alias("line"))

    start = F.struct(F.lit("").alias("text"), F.lit("").alias("line"))
    return F.aggregate(words, start, step, lambda a: F.when(a["text"] == "", a["line"]).otherwise(F.concat(a["text"], F.lit("\n"), a["line"])))


# Contractions. A word that lacks one apostrophe of them is written out.
CONTRACTIONS = """ain't aren't can't could've couldn't couldn't've didn't doesn't don't hadn't hadn't've hasn't haven't he'd he'd've he's
how'd how'll how's isn't it'd it'd've it'll ma'am mightn't mightn't've might've mustn't must've needn't not've o'clock oughtn't 'ow's'at
shan't she'd've should've shouldn't shouldn't've somebody'd've somebody'll somebody's someone'd someone'd've someone'll someone's
something'd something'd've something'll that's there'd there'd've there're there's they'd they'd've they'll they're they've 'twas wasn't
we'd've we've weren't what'll what're what's what've when's where'd where's where've who'd who'd've who'll who's who've why'll why're why's
won't would've wouldn't wouldn't've y'all y'all'll y'all'd've you'd you'd've you'll you're you've""".split()
NUMBERS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ["a", "an", "the"]


def contraction_table() -> dict[str, str]:
    """Each contraction by every spelling of it that lacks one apostrophe."""
    table = {w[:i] + w[i + 1 :]: w for w in CONTRACTIONS for i, x in enumerate(w) if x == "'"}
    return table | {"somebody'd": "somebodyd"}


def normal_answer(c: Column | str) -> Column:
    """Answer for comparison by question: no punctuation, digits for number words, no articles, contractions written out."""
    number, whole = (F.create_map(*[F.lit(x) for kv in t.items() for x in kv]) for t in (NUMBERS, contraction_table()))
    words = F.split(F.regexp_replace(F.lower(strip(F.regexp_replace(col(c), r"\s+", " "))), r"[;/\[\]\"{}()=+\\_<>@`,?!.-]", " "), r"\s+")
    kept = F.filter(words, lambda w: ~w.isin("", *ARTICLES))
    return F.array_join(F.transform(kept, lambda w: F.coalesce(F.try_element_at(number, w), F.try_element_at(whole, w), w)), " ")


def stemmed(c: Column | str, manual: dict[str, str] | None = None) -> Column:
    """Words by a manual table, else plural nouns in the singular by rule: -ies to -y, -sses, -shes, -ches and -xes without -es, -s off.

    Words of three letters or fewer and those on -ss, -us or -is stay. The table is a parameter.
    """
    table = F.create_map(*[F.lit(x) for kv in (manual or {}).items() for x in kv]).cast("map<string,string>")

    def one(w: Column) -> Column:
        rule = (
            F.when((F.length(w) <= 3) | w.rlike("(?:ss|us|is)$") | ~w.endswith("s"), w)
            .when(w.rlike("[^aeiou]ies$"), F.regexp_replace(w, "ies$", "y"))
            .when(w.rlike("(?:ss|sh|ch|x)es$"), F.regexp_replace(w, "es$", ""))
            .otherwise(F.regexp_replace(w, "s$", ""))
        )
        return F.coalesce(F.try_element_at(table, w), rule)

    return F.array_join(F.transform(F.filter(F.split(strip(c), r"\s+"), lambda w: w != ""), one), " ")


def shorten(c: Column | str, most: int = 20) -> Column:
    """At most ``most`` characters, longer texts with three points behind."""
    return F.when(F.length(col(c)) > most, F.concat(F.left(col(c), F.lit(most)), F.lit("..."))).otherwise(col(c))
