"""Broken prompt and response pairs: empty, truncated, refused, copied or foreign answers.

Copies are found by aligning the tokens of answer and prompt: five-word shingle
containment settles the plain ones, the longest common subsequence (bit-parallel)
those with words changed or left out. Refusals are aligned with refusal templates the
same way. Whether a few closing words are a whole label or the beginning of one is
told by the other answers of the table: by how often they end there, go on, or go on
within the word. Every row is judged on its own otherwise: one map over the table,
and counts of closing labels and opening words that are summed before they travel.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkline.core import cut

# End marks, labels before an answer, placeholders.
MARKS = re.compile(r"<\|[^|<>]*\|>|</?(?:eos|bos|s|pad|end|eot)>|[​‌‍﻿]", re.I)
PREFIX = re.compile(r"^\s*(?:answer|antwort|description|beschreibung|response|output)\s*:\s*", re.I)
OPENER = re.compile(r"^\s*(?:sure|certainly|of course|okay|ok|gerne|klar|natürlich|yes, sure)\s*[.!,:]\s*", re.I)
PLACEHOLDERS = {"None", "NONE", "null", "NULL", "Null", "nan", "NaN", "N/A", "n/a", "NA", "tbd", "TBD", "todo", "TODO", "empty", "no output", "no answer", "keine Antwort", "missing"}
#: Tokens of the longest label, and the share of endings from which closing words count as one.
LABEL_WORDS, LABEL_SHARE = 4, 0.1

# Refusals, and the courtesies that may stand beside one.
REFUSALS = [
    "i cannot help with this request", "i can't help with that", "i am unable to help with this", "i am not able to answer this question",
    "i must decline to answer", "i have to decline this request", "i won't answer this question", "i would rather not answer this",
    "i can't describe what is shown here", "i cannot describe the person in this recording", "i won't assess medical recordings",
    "i cannot give medical advice", "i cannot provide a diagnosis", "this is not something i may comment on",
    "i do not have permission to discuss health data", "i am not allowed to talk about this",
    "i am not able to judge a person from their face", "it would be inappropriate for me to interpret this session",
    "this request falls outside what may be answered here", "such material is confidential and i would rather not go into it",
    "i am not comfortable with answering this", "dabei kann ich nicht helfen", "muss ich diese anfrage ablehnen",
    "darf ich dazu keine auskunft geben", "ist es mir nicht möglich gesichter zu beurteilen",
    "kann ich solche aufnahmen nicht auswerten", "ich kann diese frage nicht beantworten", "dazu möchte ich mich nicht äußern",
    "dazu kann ich nichts sagen", "ich darf diese frage nicht beantworten", "solche inhalte sind vertraulich",
    "i can't do that", "i cannot do that", "i can't assist with that", "i cannot comply with this request", "i refuse to answer", "i will not do this",
    "that's beyond what i do", "this is beyond what i can do", "this is outside my scope", "i'd rather not", "sorry no", "no comment", "i have to pass on this one",
    "i'm not able to do that", "we cannot process this request", "i must refuse", "i decline to answer", "it is not possible for me to answer this",
    "i don't want to answer this", "i don't feel comfortable answering", "i can't comment on this", "i cannot share this information", "i have no answer to give",
    "auf diese bitte gehe ich lieber nicht ein", "darauf gehe ich nicht ein", "darauf möchte ich nicht antworten", "das kann ich nicht machen", "das lehne ich ab",
    "ich lehne das ab", "das geht leider nicht", "leider nein", "tut mir leid das kann ich nicht", "dazu äußere ich mich nicht", "das ist mir nicht erlaubt",
    "ich bin nicht in der lage das zu beantworten", "dabei helfe ich nicht", "ich kann ihnen dabei nicht helfen", "dazu gebe ich keine auskunft",
]
COURTESIES = [
    "thanks for the question", "thank you for your question", "is there anything else you would like to know", "please consult a professional",
    "let me know if there is anything else", "vielen dank für die frage", "danke für die frage", "kann ich sonst etwas für sie tun",
    "bitte wenden sie sich an eine fachperson", "i hope you understand", "ich bitte um verständnis", "i'm sorry", "i apologise", "es tut mir leid",
    "as an ai language model", "als sprachmodell", "such material is confidential",
]
# Function words by language.
WORDS = {
    "en": "over all out up down no so both after before during apart else than through while under between each their more then when who how one two together most within stays near close the and of to is in a was with that for on at it not my by are there this from has which about its being into as an be or his her she he they you i me would what".split(),
    "de": "gegen fast noch schon mehr sehr eher durch vom beim ihre sein seine ihr man kein keine alle vor zu zwischen bleibt zeigt der die das und ist nicht ein eine im mit auf für von zu den des dem es sich bei wird am an nur über etwa als auch sie er ich war wenn dass aus nach eines einer einen zum zur hat sind kaum nimmt".split(),
    "fr": "le la les et est un une des du que qui dans pour avec elle il se au aux sur pas plus vers ce cette son sa ses puis de en je où très leur été lorsque ne".split(),
    "es": "el la los las y es un una de que en con se su del para por más cuando al lo no como pero sus está fue muy le durante hacia".split(),
    "it": "il lo la gli le e è un una di che in con si del della per non più quando sono nel alla dei ma come anche molto verso da al ha suo".split(),
    "nl": "de het een en van is niet met op dat te zijn in voor aan er maar bij naar ook ze hij was wordt over als uit heeft haar".split(),
    "pt": "o a os as e é um uma de que em com se do da para por não mais quando ao na no dos foi muito sua seu pela até está".split(),
    "pl": "i w na z do się nie to jest że o jak po przy oraz od za jego jej przez było który".split(),
    "sv": "och det att en som på är av för med inte den till om var ett hon han sig från när men".split(),
    "da": "og det at en som på er af for med ikke den til om var et hun han sig fra når men der".split(),
    "tr": "ve bir bu da de için ile çok daha gibi olarak sonra kadar ama değil olan".split(),
    "fi": "ja on ei että se hän mutta kun myös niin ovat oli kuin tai jo sen mukaan vain ole hänen joka nyt sitten koska vielä hyvin".split(),
    "ro": "și în este că nu cu pentru din sau care mai dar după fi sunt prin fără foarte între despre când spre lui ei îi își".split(),
    "hu": "a az és egy nem hogy is de meg van volt csak már még ez azt mint vagy ha nagyon után pedig közben úgy amikor el".split(),
    "cs": "a v na je se že s z do to pro si ve ale jak jako jsou po které který byl velmi když při také jeho nebo už před".split(),
    "sk": "a v na je sa že s z do to pre si vo ale ako sú po ktoré ktorý bol veľmi keď pri tiež jeho alebo už pred".split(),
    "id": "dan yang di ke dari untuk dengan pada ini itu tidak adalah dalam juga akan ada saat lebih sudah telah oleh karena bisa sangat dia".split(),
    "no": "og det at i en er på som av for med ikke den til om var et hun han seg fra når men ble etter også eller".split(),
    "hr": "i u na je se da su za s od koji kao ali što ne bi još vrlo nakon kada prema ili nije iz sa njegov".split(),
    "sl": "in je v na se da so za z od ki kot ali ne bi še zelo po ko pri ni iz tudi pa njegov".split(),
    "et": "ja on ei et see ta kui ka aga oli oma nii mis või siis väga pärast juba veel ning kuid mitte".split(),
    "lt": "ir yra kad ne su į iš bet kaip per po jis ji tai dar labai buvo apie už nuo savo arba".split(),
    "lv": "un ir ka ne ar uz no bet kā par pēc viņš viņa tas vēl ļoti bija pie savu vai tika".split(),
    "ca": "el la els les i és un una de que en amb es del per més quan però no com està fou molt seu seva cap durant".split(),
}
SHARED: dict[str, list[str]] = {}
for _lang, _words in WORDS.items():
    for _w in set(_words):
        SHARED.setdefault(_w, []).append(_lang)

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?", re.U)
LABEL = re.compile(r"[^\W_]+(?:[_'’-][^\W_]+)*_?")
SENTENCE = re.compile(r"(?<=[.!?])[\"'”)]*\s+|\n+")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower().replace("’", "'"))


def lcs(a: list[str], b: list[str]) -> tuple[int, int]:
    """Length of the longest common subsequence and the rows of b's last token used, bit-parallel over a."""
    at: dict[str, int] = {}
    for i, t in enumerate(a):
        at[t] = at.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, last = full, -1
    for j, t in enumerate(b):
        m = at.get(t, 0)
        if m:
            x = row & m
            new = ((row + x) | (row - x)) & full
            if new.bit_count() < row.bit_count():
                last = j
            row = new
    return len(a) - row.bit_count(), last


def shingle_containment(a: list[str], b: list[str], k: int = 5) -> float:
    """Share of a's k-word shingles that b holds."""
    if len(a) < k:
        return 0.0
    have = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
    own = [tuple(a[i : i + k]) for i in range(len(a) - k + 1)]
    return sum(s in have for s in own) / len(own)


class Templates:
    """Templates that at least ``of_template`` of their tokens and ``of_sentence`` of a sentence's align with.

    A template that may lack m tokens holds at least one of any m + 1 of its own, so it is looked up by
    its m + 1 least common ones; no sentence that aligns is missed.
    """

    def __init__(self, texts: list[str], of_template: float, of_sentence: float) -> None:
        self.all = [tokens(t) for t in texts]
        self.of_template, self.of_sentence = of_template, of_sentence
        common = Counter(w for t in self.all for w in t)
        self.at: dict[str, list[int]] = {}
        for i, t in enumerate(self.all):
            lack = int((1 - of_template) * len(t) + 1e-9)
            for w in sorted(t, key=lambda w: (w in SHARED, common[w], -len(w), w))[: lack + 1]:
                self.at.setdefault(w, []).append(i)

    def may_align(self, words: set[str]) -> bool:
        return not self.at.keys().isdisjoint(words)

    def align(self, sentence: list[str]) -> bool:
        for i in {i for w in self.at.keys() & set(sentence) for i in self.at[w]}:
            t = self.all[i]
            if len(t) * self.of_template <= len(sentence) and len(sentence) * self.of_sentence <= len(t):
                n = lcs(t, sentence)[0]
                if n >= self.of_template * len(t) and n >= self.of_sentence * len(sentence):
                    return True
        return False


_REFUSALS, _COURTESIES = Templates(REFUSALS, 0.8, 0.45), Templates(COURTESIES, 0.8, 0.7)


def is_refusal(text: str, words: list[str] | None = None) -> bool:
    """All that the text says, but courtesies, is that the task is declined. ``words``: its tokens, if known."""
    if not _REFUSALS.may_align(set(words if words is not None else tokens(text))):
        return False
    refused, other, total = 0, 0, 0
    for s in SENTENCE.split(re.sub(r"[\"“„][^\"”“]*[\"”“]", " ", text)):
        t = tokens(s)
        total += len(t)
        if not t:
            continue
        if _REFUSALS.align(t):
            refused += 1
        elif not _COURTESIES.align(t):
            # A courtesy before the first comma may stand in one sentence with the refusal.
            head, _, tail = s.partition(",")
            if tail and _COURTESIES.align(tokens(head)) and _REFUSALS.align(tokens(tail)):
                refused += 1
            else:
                other += len(t)
                if not refused and other > 60:
                    return False
    return refused > 0 and other <= 0.2 * total


def language(text: str) -> str | None:
    """Best language by function words; a word of k languages counts 1/k."""
    score: dict[str, float] = {}
    for t in tokens(text):
        for lang in SHARED.get(t, ()):
            score[lang] = score.get(lang, 0) + 1 / len(SHARED[t])
    return max(score, key=lambda k: (score[k], k)) if score else None


#: Prompts come once a side and often again: language and tokens of the last few are kept.
KEPT: dict[str, tuple[str | None, list[str]]] = {}


def _prompt(text: str) -> tuple[str | None, list[str]]:
    got = KEPT.get(text)
    if got is None:
        if len(KEPT) >= 256:
            KEPT.clear()
        got = KEPT[text] = (language(text), tokens(text))
    return got


FAR = re.compile("[^\\W\\d_\u0000-\u024f]")
LETTER = re.compile(r"[^\W\d_]")


def _mostly_far(text: str) -> bool:
    """More than half of the letters, and at least eight, are of other alphabets than the Latin one."""
    far = 0 if text.isascii() else len(FAR.findall(text))
    return far > 4 and len(letters := LETTER.findall(text)) >= 8 and far > 0.5 * len(letters)


def is_foreign(prompt: str, text: str, words: list[str] | None = None) -> bool:
    if _mostly_far(text):
        return not _mostly_far(prompt)
    own = _prompt(prompt)[0]
    if own is None:
        return False
    # Words of the prompt's language against those of the one that holds most of the others.
    ours, others = 0, {}
    for t in words if words is not None else tokens(text):
        langs = SHARED.get(t, ())
        if own in langs:
            ours += 1
        else:
            for x in langs:
                others[x] = others.get(x, 0) + 1
    most = max(others.values(), default=0)
    return most >= 2 and most >= 2 * ours


def is_copy(prompt: str, text: str, words: list[str] | None = None) -> bool:
    """The text's tokens are the prompt's, or a passage of it, perhaps with a few left out or changed.

    ``words``: the tokens of the text behind its mark, if known.
    """
    q = _prompt(prompt)[1]
    have = set(q)
    # An opener adds a few words; far from a copy with them is none without them.
    if words is not None and len(words) > 12 and sum(t in have for t in words) < 0.8 * (len(words) - 4):
        return False
    body = OPENER.sub("", PREFIX.sub("", text))
    a = tokens(body)
    if len(a) < 4 or not q:
        return False
    if sum(t in have for t in a) < 0.8 * len(a):
        return False
    near = shingle_containment(a, q) >= 0.8 or lcs(a, q)[0] >= 0.85 * len(a)
    if not near:
        return False
    # What follows the last full sentence must be a passage of the prompt up to one of its ends too.
    rest = tokens(SENTENCE.split(body.strip())[-1])
    for s in SENTENCE.split(prompt):
        t = tokens(s)
        if not rest or lcs(rest, t)[0] >= 0.75 * len(rest) and (rest[-1] in t[-2:] or shingle_containment(t, rest, min(5, max(1, len(t)))) == 1):
            return True
    return False


def closing_label(text: str) -> tuple[str, list[str]] | None:
    """Where a text may end with a label: ``answer`` after an answer's mark or ``bare``, and its tokens; else None."""
    closing = re.split(r"(?i)\b(?:answer|antwort)\s*:", text)[-1]
    words = LABEL.findall(closing.lower())
    if not 0 < len(words) <= LABEL_WORDS or re.search(r"[.!?。！？][\"'”’)*_]*$", text.rstrip()):
        return None
    return ("answer" if closing != text else "bare"), words


def is_truncated(text: str) -> bool:
    """The text, which ends with no label, stops inside a word or sentence."""
    t = text.rstrip().rstrip("\"'”’)*_ ")
    if re.search(r"(?:\.\.\.|…|\[\.\.\.\])$", t.rstrip("]) ") if t.endswith("]") else t):
        return True
    closing = re.split(r"(?i)\b(?:answer|antwort)\s*:", text)[-1]
    if closing != text and 0 < len(LABEL.findall(closing)) <= LABEL_WORDS:
        return False  # a label with a full stop
    if re.search(r"\b(?:near|about|around|reaching|of|is|to|etwa|auf|bei|um|von)\s+\d{1,2}\.$", t):
        return True
    return not re.search(r"[.!?。！？][\"'”’)*_]*$", text.rstrip())


def defect_of(prompt: str | None, answer: str | None) -> str | None:
    """The defect of one answer, None, or ``label?`` where its closing words are a label or the beginning of one.

    Order: empty, copied_question, refusal, other_language, truncated.
    """
    if answer is None:
        return "empty"
    prompt = prompt or ""
    options = {o.strip().lower() for line in re.findall(r"(?im)^options?\s*:\s*(.+)$", prompt) for o in line.split(",")}
    text = MARKS.sub("", answer).strip()
    body = text
    while (m := PREFIX.match(body)) and m.end():
        body = body[m.end() :]
    bare = body.strip().strip("[](){}<>").strip()
    if not re.search(r"[^\W_]", bare, re.U):
        return "empty"
    if bare in PLACEHOLDERS and (body == text.strip() or bare.lower() not in options):
        return "empty"
    if body.strip().strip(".!?\"' ").lower() in options:
        return None
    words = tokens(body)
    if is_copy(prompt, text, words):
        return "copied_question"
    if is_refusal(body, words):
        return "refusal"
    if is_foreign(prompt, body, words):
        return "other_language"
    if re.search(r"(?:\.\.\.|…)[\"'”’)\]]*$", text):
        return "truncated"
    label = closing_label(text)
    if label:
        name = " ".join(label[1])
        if name in options:
            return None
        return "truncated" if any(o.startswith(name) or name.startswith(f"{o} ") for o in options) else "label?"
    return "truncated" if is_truncated(text) else None


def defective_pairs(
    pairs: DataFrame, id_col: str = "pair_id", prompt: str = "input_text", sides: tuple[str, ...] = ("generated", "gold")
) -> DataFrame:
    """Each defective side of a pair: ``id_col``, side, defect; every case once.

    Defined cases: a null answer is empty, whatever its prompt; a null or empty prompt has no
    language and nothing to copy, so only the other defects apply; whole texts of any length are
    aligned; repeated rows count once, rows that share an id but differ are judged each; rows with
    a null id keep it; other columns are ignored; an empty table gives no rows.
    """
    rows = pairs.select(
        F.col(id_col).alias("id"),
        F.col(prompt).alias("prompt"),
        F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("answer")) for s in sides])),
    )

    def judge(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for i, (p, a) in enumerate(zip(b.column("prompt").to_pylist(), b.column("answer").to_pylist(), strict=True)):
                d = defect_of(p, a)
                if d:
                    kind, words = closing_label(MARKS.sub("", a).strip()) if d == "label?" else (None, [])
                    for x, y in zip(out, (i, d, kind, words), strict=True):
                        x.append(y)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(at), b.column("side").take(at), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.string()))],
                names=["id", "side", "defect", "kind", "words"],
            )

    kind = dict(rows.dtypes)["id"]
    found = cut(rows.mapInArrow(judge, f"id {kind}, side string, defect string, kind string, words array<string>").distinct())
    unsure = found.filter("defect = 'label?'").select("id", "side", "kind", F.concat_ws(" ", F.slice("words", 1, F.size("words") - 1)).alias("before"), F.element_at("words", -1).alias("word"))
    return found.filter("defect <> 'label?'").select("id", "side", "defect").union(_broken_labels(found, unsure, rows)).withColumnRenamed("id", id_col)


def _begun(words: DataFrame, asked: DataFrame, kind: str) -> DataFrame:
    """Of (words, ends, c): how often each asked (before, word) ends, goes on, or is the beginning of a longer word."""
    steps = words.select("c", "ends", F.posexplode("words").alias("i", "word"), "words").select(
        F.concat_ws(" ", F.slice("words", 1, F.col("i"))).alias("before"), "word", (F.col("ends") & (F.col("i") == F.size("words") - 1)).alias("end"), "c"
    )
    steps = steps.groupBy("before", "word").agg(F.sum(F.when(F.col("end"), F.col("c")).otherwise(0)).alias("own"), F.sum(F.when(~F.col("end"), F.col("c")).otherwise(0)).alias("on"))
    steps = steps.join(asked.select("before").distinct(), "before", "left_semi")
    parts = steps.select("before", F.explode(F.expr("transform(sequence(1, length(word)), i -> substring(word, 1, i))")).alias("part"), "word", "own", "on")
    whole = F.col("part") == F.col("word")
    return parts.groupBy("before", F.col("part").alias("word")).agg(
        F.sum(F.when(whole, F.col("own")).otherwise(0)).alias(f"{kind}_own"),
        F.sum(F.when(whole, F.col("on")).otherwise(F.col("own") + F.col("on"))).alias(f"{kind}_on"),
    )


def _broken_labels(found: DataFrame, unsure: DataFrame, rows: DataFrame) -> DataFrame:
    """Closing words that are no whole label: id, side, defect.

    They are a label where two answers or more end with them and a share of ``LABEL_SHARE`` or more of
    those that begin so; single ones where the openings of all answers, held beside, leave that share too.
    """
    asked = unsure.select("before", "word").distinct()
    labels = found.filter("defect = 'label?'").select("id", "words").distinct().groupBy("words").agg(F.count("*").alias("c"))
    ends = _begun(labels.withColumn("ends", F.lit(True)), asked, "l")
    # Split no further than the words that are needed; the last part is all the rest.
    parts = F.slice(F.split(F.lower("answer"), r"[^\p{L}\p{N}_'’-]+", LABEL_WORDS + 3), 1, LABEL_WORDS + 2)
    opening = F.slice(F.filter(parts, lambda x: x != ""), 1, LABEL_WORDS + 1)
    starts = rows.filter("answer is not null").select(opening.alias("words")).filter(F.size("words") > LABEL_WORDS).groupBy("words").agg(F.count("*").alias("c"))
    opens = _begun(starts.withColumn("ends", F.lit(False)), asked, "p")
    got = unsure.join(ends, ["before", "word"], "left").join(opens, ["before", "word"], "left").na.fill(0)
    settled = (F.col("l_own") > 1) & (F.col("l_own") >= LABEL_SHARE * (F.col("l_own") + F.col("l_on")))
    single = (F.col("kind") == "answer") | (F.col("l_own") >= LABEL_SHARE * (F.col("l_own") + F.col("l_on") + F.col("p_on")))
    whole = settled | (single & (F.col("l_own") >= LABEL_SHARE * (F.col("l_own") + F.col("l_on"))))
    return got.filter(~whole).select("id", "side", F.lit("truncated").alias("defect"))


def defect_rates(pairs: DataFrame, by: str = "stage", **columns) -> DataFrame:
    """Share of distinct pairs with each defect, per ``by`` and side."""
    key = columns.get("id_col", "pair_id")
    ids = pairs.select(key, by).distinct()
    n = ids.groupBy(by).agg(F.count("*").alias("pairs"))
    found = defective_pairs(pairs, **columns).join(ids, key).groupBy(by, "side", "defect").agg(F.count("*").alias("found"))
    return found.join(n, by).withColumn("share", F.round(F.col("found") / F.col("pairs"), 6))
