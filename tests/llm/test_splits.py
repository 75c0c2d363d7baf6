import random

from pyspark.sql import functions as F

from larkline.llm import ranks, splits

SCHEMA = "session_id long, patient_id string, therapist_id string, split string, updated_at long"


def union_find(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = a if a is not None else b, b if b is not None else a
        if a is not None:
            up[find(a)] = find(b)
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def groups_of(table):
    out = {}
    for r in table.collect():
        out.setdefault(r.component, set()).add(r.node)
    return {frozenset(g) for g in out.values()}


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    links = [(f"n{rnd.randint(0, 30):02d}", f"n{rnd.randint(0, 30):02d}") for _ in range(18)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)]
    links += [("hub", f"h{i}") for i in range(20)] + [(None, "alone"), ("z", "z"), (None, None)] + [("hub", "h1")] * 3
    df = spark.createDataFrame(links, "a string, b string")
    assert groups_of(splits.components(df)) == union_find(links)
    assert splits.components(df.limit(0)).count() == 0


def test_components_over_many_tasks(spark, monkeypatch):
    """Paths and hubs whose edges lie apart: hooks are flattened and roots meet in later rounds."""
    rnd = random.Random(6)
    links = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(150)] + [("hub", f"h{i}") for i in range(100)] + [(f"n{rnd.randint(0, 90):02d}", f"n{rnd.randint(0, 90):02d}") for _ in range(80)]
    rnd.shuffle(links)
    cut = splits.cut
    monkeypatch.setattr(splits, "cut", lambda df: cut(df.repartition(7) if df.columns == ["a", "b"] else df))
    assert groups_of(splits.components(spark.createDataFrame(links, "a string, b string"))) == union_find(links)


def test_incremental_equals_whole(spark, tmp_path):
    rnd = random.Random(4)
    parts = [[(f"n{rnd.randint(0, 30)}", f"n{rnd.randint(0, 30)}") for _ in range(12)] for _ in range(2)]
    store = splits.SplitStore(spark, str(tmp_path / "table"))
    assert store.read().count() == 0
    for p in parts:
        store.add(spark.createDataFrame(p, "a string, b string"))
    assert groups_of(store.read()) == union_find([x for p in parts for x in p])
    new, merges = splits.update_components(store.read(), spark.createDataFrame([("n1", "x1"), ("x1", "n2")], "a string, b string"))
    assert groups_of(new) == union_find([x for p in parts for x in p] + [("n1", "x1"), ("x1", "n2")])
    assert merges.count() >= 1


def sessions(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_conflicts(spark):
    rows = [
        (1, "VP0000001", "A1BCD", "train", 1), (2, "vp-0000001", "E2FGH", " Test", 1), (3, "VP0000002", "th_e2fgh", None, 1),
        (4, "VP0000003", "Z9ZZZ", "val", 1), (5, "VP0000003", "z9zzz ", "valid", 1), (6, "unknown", "-", "train", 1), (7, "n/a", None, "val", 1),
        (8, "VP0000008", "Q1QQQ", "train", 1), (8, "VP0000008", "Q1QQQ", "val", 2), (9, "VP0000008", None, "val", None), (None, "VP0000001", None, "val", 1),
    ]
    df = sessions(spark, rows).withColumn("component", F.lit("x")).withColumn("node", F.lit(1)).withColumn("session", F.lit(0))
    assert sorted(tuple(r) for r in splits.split_conflicts(df).collect()) == [(1, "A1BCD"), (2, "A1BCD"), (3, "A1BCD")]
    assert splits.split_conflicts(df.limit(0)).count() == 0


def test_assignment(spark):
    rows = [(i, f"VP{i:07d}", None, "train" if i < 40 else None, 1) for i in range(1500)]
    rows += [(9000 + i, "VP9999999", "A1AAA", s, 1) for i, s in enumerate(["train", "val"])]
    rows += [(9100 + i, f"VP8{i:06d}", "H1HHH", None, 1) for i in range(150)]
    want = spark.createDataFrame([("train", 0.7), ("val", 0.15), ("test", 0.15)], "split_name string, target_share double")
    got = splits.assign_splits(sessions(spark, rows), want).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.component, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    assert {r.split for r in got if r.session_id < 40} == {"train"}
    assert {r.status for r in got if 9000 <= r.session_id < 9002} == {"quarantined"} and {r.split for r in got if 9000 <= r.session_id < 9002} == {None}
    whole = [r.split for r in got if r.split]
    for s, share in (("train", 0.7), ("val", 0.15), ("test", 0.15)):
        assert abs(whole.count(s) / len(whole) - share) < 0.01
    report = {r.split: r.sessions for r in splits.split_report(splits.assign_splits(sessions(spark, rows), want), want).collect()}
    assert report[None] == 2
    assert splits.assign_splits(sessions(spark, rows).limit(0), want).count() == 0


def test_ranks(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 3000, 1).otherwise(F.col("id") % 7))
    got = ranks.rank_within(df, ["g"], [F.col("id")], F.xxhash64("id"))
    ok = got.groupBy("g").agg((F.max("rank") + 1 == F.count("*")).alias("a"), (F.count_distinct("rank") == F.count("*")).alias("b"))
    assert all(r.a and r.b for r in ok.collect()) and got.count() == 5000


def test_fill_plan_against_one_by_one():
    rnd = random.Random(5)
    for _ in range(50):
        sizes = {rnd.randint(1, 60): rnd.randint(1, 40) for _ in range(rnd.randint(1, 8))}
        lack = {s: rnd.uniform(-50, 900) for s in ("train", "val", "test")}
        left, want = dict(lack), {}
        for n in sorted(sizes, reverse=True):
            for _ in range(sizes[n]):
                s = max(sorted(left), key=lambda x: left[x])
                left[s] -= n
                want[n, s] = want.get((n, s), 0) + 1
        got = {(n, s): hi - lo for n, s, lo, hi in splits.fill_plan(sizes, lack)}
        assert got == want


def test_many_new_components_fill_all_targets(spark):
    rows = [(i, f"VP{i:07d}", None, None, 1) for i in range(5000)] + [(10_000 + i, f"VP9{i // 40:06d}", None, None, 1) for i in range(2000)]
    want = spark.createDataFrame([("train", 0.7), ("val", 0.15), ("test", 0.15), ("training", 0.0)], "split_name string, target_share double")
    got = splits.split_report(splits.assign_splits(sessions(spark, rows), want), want.filter("target_share > 0")).collect()
    assert {r.split: round(r.share, 3) for r in got} == {"train": 0.7, "val": 0.15, "test": 0.15}
    kept = splits.assign_splits(sessions(spark, [(1, "VP0000001", None, "train", 1)]), want.filter("target_share > 0"))
    assert {r.split: r.sessions for r in splits.split_report(kept, want.filter("target_share > 0")).collect()} == {"train": 1, "val": 0, "test": 0}
