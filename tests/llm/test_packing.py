import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkline.llm import mixing, packing, tokens


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20), st.integers(50, 70))
def test_plan_holds_every_item(counts, capacity):
    plan = packing.plan_best_fit(counts, capacity)
    held = {}
    for n, items in plan:
        assert n > 0 and sum(k * m for k, m in items) <= capacity
        for k, m in items:
            held[k] = held.get(k, 0) + n * m
    assert held == counts
    # As many containers as best-fit decreasing, item by item.
    rooms = []
    for k in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= k]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - k)
    assert sum(n for n, _ in plan) == len(rooms)


def limits(spark, *caps):
    return spark.createDataFrame([(f"c{c}", c) for c in caps], "limit_name string, capacity_tokens int")


def test_packed_documents(spark):
    rnd = random.Random(1)
    rows = [(i, "word " * rnd.randint(1, 60)) for i in range(400)] + [(1000 + i, "same text here") for i in range(300)] + [(5000, "long " * 900), (6000, ""), (6001, None), (6002, "same text here"), (6002, "same text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("id", F.lit(0)).withColumn("rank", F.lit("x")).withColumn("tokens", F.lit(None)).withColumn("piece", F.lit(1))
    size = {r.doc_id: r.tokens for r in tokens.token_lengths(df.select("doc_id", "text"), ["doc_id"]).collect()}
    got = packing.pack_documents(df, limits(spark, 64, 256)).collect()
    for cap in (64, 256):
        mine = [r for r in got if r.limit_name == f"c{cap}"]
        load, parts = {}, {}
        for r in mine:
            load[r.container] = load.get(r.container, 0) + r.tokens
            parts.setdefault(r.doc_id, []).append((r.piece, r.start_token, r.tokens))
        assert max(load.values()) <= cap
        assert set(parts) == {d for d, n in size.items() if n}
        for d, p in parts.items():
            copies = 2 if d == 6002 else 1
            assert sum(t for _, _, t in p) == copies * size[d]
            assert len(p) == copies * -(-size[d] // cap)
        assert sum(load.values()) > 0.97 * cap * len(load)
    report = {r.limit_name: r for r in packing.packing_report(packing.pack_documents(df, limits(spark, 64)), limits(spark, 64)).collect()}
    assert report["c64"].containers >= report["c64"].least_containers
    assert packing.pack_documents(df.limit(0), limits(spark, 64)).count() == 0


def test_token_round_trip(spark):
    enc = tokens.encoder()
    for t in ("Grübchenbildung (AU14) nimmt ab.", "", "a" * 5000, "x\n\n  y\t😀"):
        ids = enc.encode_ordinary(t)
        assert enc.decode(ids) == t
        assert spark.createDataFrame([(1, t)], "i int, text string").transform(lambda d: tokens.token_lengths(d, ["i"])).first().tokens == len(ids)


def reachable(counts, target):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= target}
    return max(sums)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=7), st.integers(0, 200))
def test_subset_sum_is_the_best(counts, target):
    got = mixing.subset_sum(counts, target)
    assert all(n <= counts[k] for k, n in got.items())
    assert sum(k * n for k, n in got.items()) == reachable(counts, target)


@pytest.mark.parametrize("budget", [0, 1, 777, 5000, 20_000, 10**9])
def test_budget(budget):
    rnd = random.Random(budget)
    counts = {rnd.randint(5, 90): rnd.randint(1, 30) for _ in range(40)}
    whole = sum(k * n for k, n in counts.items())
    passes, extra = mixing.fit_budget(counts, budget, 3)
    assert passes <= 3 and all(0 < n <= counts[k] for k, n in extra.items()) and (passes < 3 or not extra)
    got = passes * whole + sum(k * n for k, n in extra.items())
    assert got <= budget
    if 300 < budget < 3 * whole:
        assert budget == got


def test_mixture(spark):
    rnd = random.Random(2)
    rows = [(i, "word " * rnd.randint(3, 40), rnd.choice(["Big", "big ", "big"])) for i in range(600)]
    rows += [(1000 + i, "tiny text " * rnd.randint(1, 9), rnd.choice(["Small-One", "small one"])) for i in range(40)] + [(2000, "x", None), (2001, "x", "other"), (2002, "", "big"), (2003, None, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("id", F.lit(1)).withColumn("repeats", F.lit(1)).withColumn("tokens", F.lit(0))
    want = spark.createDataFrame([("big", 0.8, 1), ("small_one", 0.2, 3), ("absent", 0.5, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(df, want)
    got = mix.collect()
    assert max(r.repeats for r in got if r.source == "big") == 1 and max(r.repeats for r in got) <= 3
    assert {r.source for r in got} == {"big", "small_one"} and len({r.doc_id for r in got}) == len(got)
    shares = {r.source: r.actual_share for r in mixing.mixture_report(mix, want).collect()}
    assert abs(shares["big"] - 0.8) < 0.002 and abs(shares["small_one"] - 0.2) < 0.002 and shares["absent"] == 0
    assert sorted(map(tuple, mixing.mix_sources(df.repartition(7), want).collect())) == sorted(map(tuple, got))
    short = {r.source: r for r in mixing.mixture_report(mixing.mix_sources(df, want, total_tokens=10**7), want).collect()}
    assert short["small_one"].most_repeats == 3 and short["big"].most_repeats == 1
    assert mixing.mix_sources(df.limit(0), want).count() == 0
