"""Speech transcripts into clean speaker turns.

One pass takes out what was not said: clock marks, sound marks and speaker tags by
pattern, hesitation tokens by a boosted classifier over a token's letters and how
often a pause follows it in its language. Whether two neighbouring segments belong to
different speakers is a second boosted decision over labels, the gap and the words
around the boundary, trained on neighbours whose speakers are known, with a part of
the labels hidden. It decides every boundary. Both are fitted on all texts and all such neighbours.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkline.core import cut
from larkline.llm import boost
from larkline.llm.pairs import WORDS

# Names of the two speakers and words of the languages that sound like hesitation.
CLIENT = r"client|klient(?:in)?|patient(?:in)?|pat|kl|cl|k|c|p"
THERAPIST = r"therapist|therapeut(?:in)?|ther|th|t"
# What is no speech. Times of day as said (10:30) have two parts and no brackets.
NO_SPEECH = [
    r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?\s*-+>\s*\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?",
    r"\(\([^()]*\)\)", r"\([^()]*\)", r"\[[^\[\]]*\]", r"\{[^{}]*\}", r"<[^<>]*>", r"\*[^*\n]*\*", r"#\d[^#\n]*#",
    r"(?<![\d:])\d{1,2}:\d{2}:\d{2}(?:[.,-]\d+)?(?![\d:])",
]
TAG_INSIDE = re.compile(rf"(?:\[\s*|<v\s+)({CLIENT}|{THERAPIST})\s*[\]>]", re.I)
TAG_BEFORE = re.compile(rf"[\s>]*({CLIENT}|{THERAPIST})\.?\s*(?::|[-–—](?=\s))\s*", re.I)
MARKS = re.compile("|".join(NO_SPEECH))
MARKED = re.compile(r"[\[({<*#:]")
WHO = re.compile(rf"(?:({CLIENT})|({THERAPIST}))\Z")
TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*(?:\s?[,.…;!?–—-])?")  # and the pause behind it
PART = re.compile(r"['’-]")

# Sounds of hesitation from which the classifier learns, and words that look like them.
SOUNDS = {"en": "uh um er erm uhm hm hmm mm mhm huh ah eh".split(), "de": "äh ähm öh öhm hm hmm mh mmh mhm eh ehm hä".split()}
LOOKALIKE = {"en": "her are here rare more am an her hear ham harm era arm hum ear ram mere a oh hurry rum".split(), "de": "um er eher mehr am ihr ehe ohr heer arm rum höher uhr höre meer armee ehre herum".split()}

FEATURES = ["f_label", "f_gap", "f_ask_before", "f_ask", "f_len_before", "f_len", "f_you_before", "f_you", "f_me_before", "f_me"]
YOU = set("you your sie ihnen ihr".split())
ME = set("i my me ich mein meine mich mir".split())


def speaker_name(name: str | None) -> str | None:
    """client, therapist or None from any spelling."""
    m = WHO.match("".join(c for c in (name or "").lower() if c.isalpha()))
    return None if not m else "client" if m.group(1) else "therapist"


def tagged_speaker(text: str, stripped: str) -> str | None:
    """The speaker that a tag names, inside the text or before its speech, else None."""
    m = TAG_INSIDE.search(text) or TAG_BEFORE.match(stripped)
    return speaker_name(m.group(1)) if m else None


def _squeezed(token: str) -> str:
    """Repeated letters once, umlauts in one spelling."""
    return re.sub(r"(.)\1+", r"\1", token).replace("ae", "ä").replace("oe", "ö").replace("ue", "ü")


def _shape(token: str) -> list[float]:
    run = best = 1
    for x, y in zip(token, token[1:], strict=False):
        run = run + 1 if x == y else 1
        best = max(best, run)
    t = _squeezed(token)
    n = len(t)
    return [n, best, len(set(t)), sum(c not in "aehmruäöü" for c in t), sum(c in "aeiouäöüy" for c in t) / n, sum(c in "hm" for c in t) / n, t[-1] in "hm"]


class Fillers:
    """Token-level classifier of hesitation sounds.

    ``pauses`` holds by language and token how often it stands and how often a pause follows; a
    token may be missing where the model says no of it either way.
    """

    def __init__(self, model: dict, pauses: dict[tuple[str, str], tuple[int, int]]) -> None:
        self.model, self.pauses = model, pauses
        self.known: dict[str, dict[str, bool]] = {}  # by language, of tokens met

    def features(self, lang: str, token: str) -> list[float]:
        n, followed = self.pauses.get((lang, token), (0, 0))
        own = SQUEEZED.get(lang, ANY_SOUND)
        return [*_shape(token), (followed + 1.2) / (n + 4), _squeezed(token) in own, token in LEXICON.get(lang, ANY)]

    def learn(self, lang: str, tokens: set[str]) -> dict[str, bool]:
        """Decides the tokens not met yet, all at once; of one with hyphens every part must be a sound.

        Tokens with an apostrophe or other characters than letters are none.
        """
        own = self.known.setdefault(lang, {})
        if len(own) > 500_000:
            own.clear()
        new = [t for t in tokens if t not in own]
        parts = sorted({x for t in new for x in t.split("-") if x.isalpha() and len(x) < 30})
        score = boost.score(self.model, np.array([self.features(lang, x) for x in parts], float)) if parts else []
        sounds = {x for x, s in zip(parts, score, strict=True) if s > 0}
        for t in new:
            own[t] = all(x in sounds for x in t.split("-"))
        return own

    def __call__(self, lang: str, token: str) -> bool:
        return self.learn(lang, {token})[token]


# What a language's words are: its function words and the lookalikes.
LEXICON = {lang: set(LOOKALIKE[lang]) | set(WORDS[lang]) for lang in SOUNDS}
ANY = set().union(*LEXICON.values())
SQUEEZED = {lang: {_squeezed(x) for x in own} for lang, own in SOUNDS.items()}
ANY_SOUND = set().union(*SQUEEZED.values())
# Examples: every sound also with one letter twice or three times, and the letters that no sound has.
STRETCHED = {lang: {x[:i] + x[i] * k + x[i + 1 :] for x in own for i in range(len(x)) for k in (1, 2, 3)} for lang, own in SOUNDS.items()}
ANY_STRETCHED = set().union(*STRETCHED.values())
ODD = set("bcdfgijklnopqstvwxyzß")
SHAPES = ["t_len", "t_run", "t_letters", "t_other", "t_vowels", "t_hm", "t_ends", "t_pause", "t_sound", "t_word"]


def _code(lang: str | None) -> str:
    return (lang or "").strip().lower()[:2]


def heard(rows: DataFrame) -> DataFrame:
    """Of rows (session, pos, speaker, at, to, text, lang) the tokens and who is named.

    Columns: session, pos, at, to, known (the speaker that label or tag names), lang (two letters),
    ask, said (tokens in lower case by blanks, a comma at each that a pause follows).
    """
    kind = dict(rows.dtypes)["session"]

    def hear(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for speaker, text, lang in zip(b.column("speaker").to_pylist(), b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                stripped = MARKS.sub(" ", text) if MARKED.search(text) else text
                at = 0
                while (m := TAG_BEFORE.match(stripped, at)) and at < 200:
                    at = m.end()
                found = TOKEN.findall(stripped[at:].lower() + ".")  # the end is a pause
                said = " ".join([t if t[-1].isalnum() else t[:-1].rstrip() + "," for t in found])
                for x, y in zip(out, (speaker_name(speaker) or tagged_speaker(text, stripped), _code(lang), float(stripped.rstrip().endswith("?")), said), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("session", "pos", "at", "to")), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.string())],
                names=["session", "pos", "at", "to", "known", "lang", "ask", "said"],
            )

    return rows.mapInArrow(hear, f"session {kind}, pos long, at double, to double, known string, lang string, ask double, said string")


def vocabulary(said: DataFrame, most: int = 200_000) -> DataFrame:
    """Of what was heard, by lang and token of letters: n, how often it stands alone, and p, how often a pause follows.

    Listed sounds and words and the parts of hyphenated tokens are there too, at zero if they never
    stand alone. A task hands on its counts when it holds ``most``.
    """

    def rows_of(seen):
        rows = Counter(), Counter()
        for lang, own in seen.items():
            for t, k in own.items():
                paused = t.endswith(",")
                t = t.removesuffix(",")
                if t.isalpha():
                    rows[0][lang, t] += k
                    rows[1][lang, t] += k * paused
                elif "-" in t:
                    for x in t.split("-"):
                        if x.isalpha():
                            rows[0][lang, x] += 0
        keys = list(rows[0])
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([rows[0][k] for k in keys], pa.int64()), pa.array([rows[1][k] for k in keys], pa.int64())],
            names=["lang", "token", "n", "p"],
        )

    def count(batches):
        seen: dict[str, Counter] = {}
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("said").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                seen.setdefault(lang, Counter()).update(" ".join(texts).split())
            if sum(map(len, seen.values())) > most:
                yield rows_of(seen)
                seen.clear()
        yield rows_of(seen)

    kinds = "lang string, token string, n long, p long"
    listed = [(lang, t, 0, 0) for lang in SOUNDS for t in sorted(STRETCHED[lang] | LEXICON[lang])]
    counts = said.select("lang", "said").mapInArrow(count, kinds).union(said.sparkSession.createDataFrame(listed, kinds))
    return counts.groupBy("lang", "token").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))


def _examples(lang: str, token: str, n: int, p: int) -> list[tuple[list, float]]:
    """Features and class of a token from which the classifier learns, also as if no list held it; none where the model is to decide."""
    words = LEXICON[lang]
    sound = token in STRETCHED[lang] and token not in words
    if not (sound or token in words or (n and ODD & set(token))):
        return []
    x = Fillers({}, {(lang, token): (n, p)}).features(lang, token)
    if token not in ANY_STRETCHED:
        return [(x, 0.0), ([*x[:-1], False], 0.0)]
    return [(x, 1.0), ([*x[:-2], False, False], 1.0)] if sound else [(x, 0.0)]


def fit_fillers(said: DataFrame) -> Fillers:
    """The classifier from all of what was heard. The driver gets counts of tokens only where they can make a sound of one."""
    vocab = cut(vocabulary(said))

    def examples(batches):
        for b in batches:
            rows = [e for r in zip(*(b.column(c).to_pylist() for c in ("lang", "token", "n", "p")), strict=True) for e in _examples(*r)]
            yield pa.RecordBatch.from_arrays([*(pa.array([float(x[k]) for x, _ in rows], pa.float64()) for k in range(len(SHAPES))), pa.array([y for _, y in rows], pa.float64())], names=[*SHAPES, "y"])

    kinds = ", ".join(f"{c} double" for c in [*SHAPES, "y"])
    model = boost.fit_table(vocab.filter(F.col("lang").isin(*SOUNDS)).mapInArrow(examples, kinds), SHAPES, "y")

    def doubtful(batches):
        for b in batches:
            rows = [r for r in zip(*(b.column(c).to_pylist() for c in ("lang", "token", "n", "p")), strict=True) if len(r[1]) < 30]
            keep = np.zeros(len(rows), bool)
            for book in (Fillers(model, {(lang, t): (n, p) for lang, t, n, p in rows}), Fillers(model, {})):
                if rows:
                    keep |= boost.score(model, np.array([book.features(lang, t) for lang, t, _, _ in rows], float)) > 0
            kept = [r for r, k in zip(rows, keep, strict=True) if k]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["lang", "token", "n", "p"])

    got = vocab.mapInArrow(doubtful, "lang string, token string, n long, p long").toArrow().to_pylist()
    return Fillers(model, {(r["lang"], r["token"]): (r["n"], r["p"]) for r in got})


def train_fillers(texts: DataFrame, lang: str, text: str) -> Fillers:
    """The classifier, from all of all texts and the word lists.

    A sound is a positive example unless its language also uses it as a word; words of the lists and
    all tokens with letters that no sound has are negative ones; other tokens are left to the model.
    """
    none = {"session": F.lit(0), "pos": F.lit(0).cast("long"), "speaker": F.lit(None).cast("string"), "at": F.lit(0.0), "to": F.lit(0.0)}
    rows = texts.select(*(c.alias(k) for k, c in none.items()), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return fit_fillers(heard(rows.filter(F.col("text").isNotNull())))


def worded(said: DataFrame, fillers: Fillers) -> DataFrame:
    """What was heard without hesitation.

    Columns: session, pos, at, to, known, words (lower case, every run of other characters than
    letters and digits one blank), and for the boundary model ask, len, you, me.
    """
    kind = dict(said.dtypes)["session"]

    def clean(batches):
        for b in batches:
            read, met = [], {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("said").to_pylist(), strict=True):
                text = text.replace(",", "")
                tokens = set(text.split())
                met.setdefault(lang, set()).update(tokens)
                read.append((lang, text, tokens))
            sounds = {}
            for lang, tokens in met.items():
                own = fillers.learn(lang, tokens)
                sounds[lang] = {t for t in tokens if own[t]}
            out: list[list] = [[] for _ in range(4)]
            for lang, text, has in read:
                own = sounds[lang]
                if not own.isdisjoint(has):
                    text = " ".join([t for t in text.split() if t not in own])
                    has = has - own
                if PART.search(text):
                    text = PART.sub(" ", text)
                    has = set(text.split())
                out[0].append(text)
                out[1].append(text.count(" ") + bool(text))
                out[2].append(not YOU.isdisjoint(has))
                out[3].append(not ME.isdisjoint(has))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("session", "pos", "at", "to", "known")), pa.array(out[0], pa.string()), b.column("ask"), *(pa.array(x, pa.float64()) for x in out[1:])],
                names=["session", "pos", "at", "to", "known", "words", "ask", "len", "you", "me"],
            )

    return said.mapInArrow(clean, f"session {kind}, pos long, at double, to double, known string, words string, ask double, len double, you double, me double")


def cleaned(rows: DataFrame, fillers: Fillers) -> DataFrame:
    """Of rows (session, pos, speaker, at, to, text, lang) what was said and by whom, as ``worded`` has it."""
    return worded(heard(rows), fillers)


def _features(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy("session").orderBy("at", "pos", "tie")
    shapes = {"ask": "f_ask", "len": "f_len", "you": "f_you", "me": "f_me"}
    rows = rows.withColumn("tie", F.xxhash64("words"))  # rows that share a place: in any fixed order
    rows = rows.withColumns({"w0": F.lag("len").over(by), "k0": F.lag("known").over(by), "until": F.lag("to").over(by), **{f"{f}_before": F.lag(c).over(by) for c, f in shapes.items()}})
    return rows.withColumns(
        {
            "f_label": F.when(F.col("known") == F.col("k0"), 0.0).when(F.col("known") != F.col("k0"), 1.0).otherwise(0.5),
            # In thousandths, so the values that thresholds are taken from are few.
            "f_gap": F.rint(F.least(F.greatest(F.coalesce(F.col("at") - F.col("until"), F.lit(0.0)), F.lit(-60.0)), F.lit(60.0)) * 1000) / 1000,
        }
    ).withColumnsRenamed(shapes)


def train_boundaries(features: DataFrame, hidden: float = 0.5) -> dict | None:
    """Boosted boundary model from all neighbours with known speakers.

    In the share ``hidden`` of them, told by hash, the labels are masked, so the model learns what the
    gap and the words say. None where there are too few.
    """
    known = features.filter(F.col("known").isNotNull() & F.col("k0").isNotNull())
    masked = F.pmod(F.xxhash64("session", "pos"), F.lit(1000)) < hidden * 1000
    label = F.when(masked, 0.5).otherwise(F.col("f_label")).alias("f_label")
    return boost.fit_table(known.select(label, *FEATURES[1:], (F.col("known") != F.col("k0")).alias("y")), FEATURES, "y")


def speaker_turns(
    segments: DataFrame,
    langs: DataFrame | None = None,
    session: str = "session_id",
    pos: str = "pos",
    speaker: str = "speaker_id",
    start: str = "start_s",
    end: str = "end_s",
    text: str = "text",
    model: dict | None = None,
) -> DataFrame:
    """Clean speaker turns: ``session``, turn_no, speaker_id, start, end, segments, words.

    ``langs`` (``session``, lang) gives each session's language; ``model`` is a boundary model fitted before.
    Else both classifiers are fitted on all of the segments.
    Segments go by their earlier time, then position; start and end keep the unit of the input.

    Defined cases: swapped times are put in order; of a null time the other counts, segments with
    neither come last by position; null, blank and wordless texts vanish and split no turn; rows
    loaded twice count once, rows that share session and position but differ are kept; rows with a
    null session form a session of their own; between two boundaries the speaker is
    whom most labels and tags name, the other one of the neighbouring stretch where none does, and
    client first where a whole session names nobody; neighbours of one speaker form one turn; other columns are ignored; an empty table gives no rows.
    """
    raw = segments.select(
        F.col(session).alias("session"),
        F.col(pos).cast("long").alias("pos"),
        F.col(speaker).cast("string").alias("speaker"),
        F.least(F.col(start).cast("double"), F.col(end).cast("double")).alias("at"),
        F.greatest(F.col(start).cast("double"), F.col(end).cast("double")).alias("to"),
        F.col(text).alias("text"),
    ).filter(F.col("text").isNotNull())
    # By session once: dropping repeated rows and joining the language then need no other shuffle.
    rows = raw.repartition("session").distinct()
    if langs is not None:
        one = langs.select(F.col(session).alias("session"), F.col("lang").alias("lang")).groupBy("session").agg(F.max("lang").alias("lang"))
        rows = rows.join(one, "session", "left")
    else:
        rows = rows.withColumn("lang", F.lit(None).cast("string"))
    rows = rows.withColumns({"at": F.coalesce("at", F.lit(1e18)), "to": F.coalesce("to", F.lit(1e18))})
    # Read once for both steps of the fillers; words made once, training and scoring both read them.
    said = cut(heard(rows).filter(F.col("said") != ""))
    features = _features(cut(worded(said, fit_fillers(said)).filter(F.col("words") != "")))
    model = model or train_boundaries(features)
    # Too few known neighbours to learn from: labels alone, and a speaker that nothing names does not change.
    odds = boost.score_column(model, FEATURES) if model else F.col("f_label") - 0.6
    by = Window.partitionBy("session").orderBy("at", "pos", "tie")
    sofar, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    marked = features.withColumn("change", F.when(F.col("w0").isNull(), 0).otherwise((odds > 0).cast("int"))).withColumn("step", F.sum("change").over(sofar))
    # A run between boundaries is its labels' majority, the first of them at a tie.
    run = Window.partitionBy("session", "step")
    votes = F.sum(F.when(F.col("known") == "client", 1).when(F.col("known") == "therapist", -1)).over(run)
    first = F.min(F.when(F.col("known").isNotNull(), F.struct("at", "pos", "known"))).over(run)["known"]
    marked = marked.withColumn("named", F.when(votes > 0, "client").when(votes < 0, "therapist").otherwise(first))
    named = F.when(F.col("named").isNotNull(), F.struct("named", "step"))
    marked = marked.withColumns({"before": F.last(named, True).over(sofar), "after": F.first(named, True).over(ahead)})
    anchor = F.coalesce("before", "after")
    same = F.abs(F.col("step") - anchor["step"]) % 2 == 0
    who = F.when(anchor.isNull(), F.when(F.col("step") % 2 == 0, "client").otherwise("therapist")).when(same, anchor["named"])
    who = who.otherwise(F.when(anchor["named"] == "client", "therapist").otherwise("client"))
    turns = marked.withColumn("who", who).withColumn("new", F.coalesce((F.lag("who").over(by) != F.col("who")).cast("int"), F.lit(1)))
    turns = turns.withColumn("turn_no", F.sum("new").over(sofar).cast("int"))
    parts = F.sort_array(F.collect_list(F.struct("at", "pos", "words")))
    real = F.when(F.col("at") < 1e18, F.col("at"))
    return turns.groupBy("session", "turn_no", "who").agg(
        F.min(real).alias("start"), F.max(F.when(F.col("to") < 1e18, F.col("to"))).alias("end"), F.count("*").alias("segments"),
        F.array_join(F.transform(parts, lambda x: x["words"]), " ").alias("words"),
    ).select(F.col("session").alias(session), "turn_no", F.col("who").alias("speaker_id"), "start", "end", "segments", "words")
