"""The driver's contract: names, schemas and a sample of oracles."""

import duckdb
import pytest

import __spark_entry__ as E

SAMPLE = ["p2_found", "p3_found", "J-05_frames_in_turns", "W-02_event_bins", "A-21_averages", "P-12_exclusion", "T-11_leave_one_out", "F-14_token_f1"]


def test_names_and_oracles():
    q = E.queries()
    assert set(E.oracle_sql()) <= set(q)
    for n in range(2, 5):
        assert f"p{n}_found" in q


def test_entry(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, small, name):
    df = E.queries()[name](spark, small)
    db = duckdb.connect()
    for t in ("frames", "sessions", "segments", "turns", "predictions", "documents", "events", "orders", "embeddings"):
        db.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    res = db.execute(E.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple(map(repr, r))
    got = sorted([tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(cols)).collect()], key=key)
    order = [cols.index(c) for c in sorted(cols)]
    want = sorted([tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in res.fetchall()], key=key)
    assert got == want
