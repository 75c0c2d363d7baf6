"""Refusals that name neither the speaker nor the request."""

from larkline.llm import pairs


def test_refusal_needs_no_cue_word():
    assert pairs.is_refusal("Your request falls outside what may be answered here.")
    assert not pairs.is_refusal("The client walks outside before breakfast.")


def test_lookup_misses_no_alignment():
    """Templates are looked up by a few of their tokens; every sentence that aligns with one is found."""
    import random

    rnd = random.Random(4)
    found = pairs.Templates(pairs.REFUSALS, 0.8, 0.45)
    hits = 0
    for _ in range(4000):
        t = list(rnd.choice(found.all))
        for _ in range(rnd.randint(0, 3)):
            if rnd.random() < 0.5 and len(t) > 1:
                t.pop(rnd.randrange(len(t)))
            else:
                t.insert(rnd.randint(0, len(t)), rnd.choice(["the", "patient", "calm", "so", "nicht", "ist"]))
        want = any(pairs.lcs(x, t)[0] >= max(0.8 * len(x), 0.45 * len(t)) for x in found.all)
        assert found.align(t) == want
        hits += want
    assert hits > 1000
