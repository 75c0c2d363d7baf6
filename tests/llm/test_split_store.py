"""Splits over several loads."""

from larkline.llm import splits

KIND = "session_id int, patient_id string, therapist_id string, split string, updated_at string"


def test_splits_are_kept_and_merges_quarantined_over_loads(spark, tmp_path):
    store = splits.SplitStore(spark, str(tmp_path))
    row = lambda i, p, t, s=None: (i, p and f"VP000000{p}", t and f"A1BC{t}", s, "2024-01-01")

    def load(shares, *rows):
        f = spark.createDataFrame(rows, KIND)
        bad = {r.session_id for r in splits.split_conflicts(f, store).collect()}
        got = {r.session_id: (r.split, r.status) for r in splits.assign_splits(f, spark.createDataFrame(shares, "split_name string, target_share double"), store).collect()}
        assert bad == {i for i, r in got.items() if r[1] == "quarantined"}
        return got

    first = load([("train", 0.5), ("val", 0.5)], row(1, 1, "A"), row(2, 2, "B"), row(3, 3, "C"), row(4, None, None))
    assert {r[1] for r in first.values()} == {"new"} and first[1][0] != first[2][0]
    # Splits were not written back, and the only target is another one: what was placed stays.
    again = load([("test", 1.0)], row(2, 2, "B"), row(3, 3, "C"), row(4, None, None), row(5, 5, "E"))
    assert again == {2: (first[2][0], "kept"), 3: (first[3][0], "kept"), 4: (first[4][0], "kept"), 5: ("test", "new")}
    # A link joins two components of different splits, without their old sessions; others stay.
    third = load([("test", 1.0)], row(6, 1, "B"), row(3, 3, "C"))
    assert third == {6: (None, "quarantined"), 3: (first[3][0], "kept")}
    assert load([("test", 1.0)], row(1, 1, "A"), row(5, 5, "E")) == {1: (None, "quarantined"), 5: ("test", "kept")}


def test_a_load_rewrites_only_the_buckets_it_changes(spark, tmp_path):
    store = splits.SplitStore(spark, str(tmp_path), buckets=16)
    store.add(spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(60)], "a string, b string"))
    first = store.manifest()[1]
    store.add(spark.createDataFrame([("a1", "a2"), ("a3", "b3"), ("new", "a5")], "a string, b string"))
    version, second = store.manifest()
    names = spark.createDataFrame([("a1",), ("a2",), ("a5",)], "component string").select(store.bucket()).collect()
    assert version == 1 and {b for b in first if second.get(b) != first[b]} == {r[0] for r in names} != set(first)
    table = {r.node: r.component for r in store.read().collect()}
    assert len(table) == 121 and len(set(table.values())) == 59 and table["b2"] == table["a1"] and table["new"] == table["b5"]
    # Known links change nothing: no new version.
    store.add(spark.createDataFrame([("a1", "b2")], "a string, b string"))
    assert store.manifest()[0] == 1


def test_two_loads_equal_one(spark, tmp_path):
    import random

    rnd = random.Random(8)
    rows = [(i, f"VP{rnd.randint(0, 60):07d}", f"A1BC{rnd.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ')}", rnd.choice(["train", "val", None, None, None, None]), "2024-01-01") for i in range(60)]
    f = spark.createDataFrame(rows, KIND)
    targets = spark.createDataFrame([], "split_name string, target_share double")
    once, twice = splits.SplitStore(spark, str(tmp_path / "a")), splits.SplitStore(spark, str(tmp_path / "b"))
    splits.assign_splits(f, targets, once)
    for part in ("session_id < 30", "session_id >= 30"):
        splits.assign_splits(f.filter(part), targets, twice)
    state = [sorted((r.node, r.component, tuple(sorted(r.splits))) for r in s.read().collect()) for s in (once, twice)]
    assert state[0] == state[1] and any(len(x[2]) > 1 for x in state[0])
