import pytest
from pyspark.sql import functions as F

from larkline.llm import pairs

ASK = "One EEG epoch of 30 seconds with a mean of 0.70 is given. Which sleep stage does it belong to? Explain first.\nOptions: Wake, N1, N2, N3, REM, Movement"
TELL = "Describe this speech turn in one short paragraph.\nSpeech content: For the next meeting the client wants to practise one refusal on weekdays. (spoken by therapist)\nDescription:"
DE = "Beschreibe diesen Redebeitrag in einem kurzen Absatz.\nInhalt: Der Klient erklärt, er sei im Auto sehr ausgeschlossen gewesen. (gesprochen von client)\nBeschreibung:"


@pytest.mark.parametrize(
    ("prompt", "answer", "want"),
    [
        (ASK, None, "empty"), (ASK, "", "empty"), (ASK, " \n\t", "empty"), (ASK, "​", "empty"), (ASK, "<eos>", "empty"), (ASK, "[no output]", "empty"),
        (ASK, "Answer: .", "empty"), (ASK, "N/A", "empty"), (ASK, "None", "empty"), (TELL, "Description: <|end|>", "empty"), (ASK, "...", "empty"),
        (ASK, "N2", None), (ASK, "Answer: Answer: REM.<eos>", None), (ASK, "wake\n", None), ("Is it so?\nOptions: yes, none", "none ", None),
        (ASK, "The epoch contains slow drift in the beta range. Answer: N3", None), (ASK, "Power in the theta band is near 4.40. Answer: Mov", "truncated"),
        (ASK, "The epoch contains slow drift in the be", "truncated"), (ASK, "Power in the beta band is near 4.", "truncated"), (ASK, "Power i...", "truncated"),
        (ASK, "Power in the beta band is ne<|end|>", "truncated"), (ASK, "Power in the beta band is near 4.31.", None),
        (ASK, "I'm sorry, but I cannot help with this request. Please consult a professional.", "refusal"), (DE, "Leider kann ich dabei nicht helfen.", "refusal"),
        (TELL, 'The client says "I\'m sorry, I cannot talk about that" and moves on to the exam. The client shows brief blinking (AU45).', None),
        (TELL, "The client declines to answer and returns to the exam. Little else stands out, apart from faint blinking (AU45).", None),
        (ASK, ASK, "copied_question"), (ASK, "one  eeg  epoch  of  30  seconds  with  a  mean  of  0.70  is  given.  Which  sleep  stage  does  it  belong  to?  Explain", "copied_question"),
        (TELL, "Sure. For the next meeting the client wants to practise one refusal on weekdays.", "copied_question"),
        (TELL, "For the next meeting the client wants to practise one refusal on weekdays. The turn deals with trust, and the client seems calm.", None),
        (TELL, "For the next meeting the client wants to practise one refusal on weekdays. The cl", "truncated"),
        (TELL, "Le visage reste neutre, avec un léger sourire vers la fin.", "other_language"), (DE, "The turn deals with trust, and the client comes across as calm.", "other_language"),
        (TELL, 'The word "Heimat" falls, then the new rota is discussed.', None), (TELL, "Терапевт спрашивает о работе и ждёт ответа.", "other_language"),
        (None, "Fine.", None), ("", "Fine.", None),
    ],
)
def test_defects(prompt, answer, want):
    assert pairs.defect_of(prompt, answer) == want


def test_lcs_against_dynamic_programme():
    import random

    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 14))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert pairs.lcs(a, b)[0] == t[-1][-1]


def test_table(spark):
    schema = "pair_id long, input_text string, generated string, gold string"
    rows = [(1, ASK, "", "N2"), (1, ASK, "", "N2"), (2, None, None, None), (None, ASK, "N1", "REM cut off he"), (3, ASK, "x " * 60_000, "Answer: N1")]
    df = spark.createDataFrame(rows, schema).withColumn("id", F.lit(9)).withColumn("side", F.lit("x")).withColumn("answer", F.lit(None)).withColumn("prompt", F.lit(1))
    got = {tuple(r) for r in pairs.defective_pairs(df).collect()}
    assert got == {(1, "generated", "empty"), (2, "generated", "empty"), (2, "gold", "empty"), (None, "gold", "truncated"), (3, "generated", "truncated")}
    assert pairs.defective_pairs(df).count() == 5 and pairs.defective_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("prompt", "answer", "want"),
    [
        (TELL, "As an AI language model, that's beyond what I do.", "refusal"), (ASK, "Sorry, no.", "refusal"), (DE, "Auf diese Bitte gehe ich lieber nicht ein.", "refusal"),
        (DE, "Es tut mir leid, das kann ich nicht machen.", "refusal"), (ASK, "I'd rather not.", "refusal"), (TELL, "I'm sorry, I can't assist with that.", "refusal"),
        (TELL, "I cannot see much tension, because the patient remains calm.", None), (TELL, "We cannot rule out tension here.", None), (TELL, "The client will not answer the letter before Monday.", None),
        (DE, "Der Klient kann dazu heute nichts sagen und schaut lange zum Fenster.", None),
        (TELL, "Asiakas puhuu ensi viikosta, mutta hän ei ole vielä kovin rauhallinen.", "other_language"), (TELL, "Clientul vorbește despre săptămâna viitoare, dar nu este foarte calm.", "other_language"),
        (TELL, "A kliens a jövő hétről beszél, de még nem nagyon nyugodt, és hallgat.", "other_language"), (TELL, "Klient mluví o příštím týdnu, ale ještě není velmi klidný a je unavený.", "other_language"),
        (TELL, "Klien berbicara tentang minggu depan, tetapi dia tidak sangat tenang dan sudah lelah.", "other_language"), (TELL, "Klienten snakker om neste uke, men han er ikke rolig og ser ned.", "other_language"),
    ],
)
def test_defects_in_other_words(prompt, answer, want):
    assert pairs.defect_of(prompt, answer) == want


def test_labels_are_told_by_the_table(spark):
    """No list of labels: single and repeated ones are whole, beginnings of labels and of sentences are not."""
    ask = "Which state or activity is shown? Explain."
    whole = ["drowsy", "Atrial flutter", "jogging", "Answer: jogging", "Answer: walking", "Answer: walking_down", "no", "Answer: not sure"]
    broken = ["Answer: jogg", "Answer: not", "The client", "The clie", "Answer: walking_"]
    prose = ["The client talks about the week and seems calm.", "The client looks down for a while.", "No long pause is seen in the turn."]
    rows = [(i, ask, a, "The face stays neutral.") for i, a in enumerate([*whole, *broken])]
    rows += [(100 + i, ask, (whole[2:] + prose)[i % 9], "Answer: not sure") for i in range(180)]
    got = pairs.defective_pairs(spark.createDataFrame(rows, "pair_id long, input_text string, generated string, gold string")).collect()
    assert sorted((r.pair_id, r.side, r.defect) for r in got) == [(len(whole) + i, "generated", "truncated") for i in range(len(broken))]
