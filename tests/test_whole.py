"""Queries that once cut their input, held against brute force or plain SQL over all of it."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E


def write(folder, **tables):
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")
    return str(folder)


def rows(spark, name, folder):
    df = E.queries()[name](spark, folder)
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def sql(folder, names, text):
    db = duckdb.connect()
    for t in names:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    res = db.execute(text)
    cols = [c[0] for c in res.description]
    order = [cols.index(c) for c in sorted(cols)]
    return sorted(tuple(r[i] for i in order) for r in res.fetchall())


def test_fuzzy_match_reads_whole_texts(spark, tmp_path):
    sources = ["activity_rationales", "session_notes", "turn_summaries"]
    texts = [
        "x " * 40 + "session notes",  # both tokens after the 60th character
        "x " * 40 + "Notes",  # a single token needs one match only
        "notes elsewhere",  # one of two tokens is too little
        "notes notes elsewhere",  # repeats count once
        "rationales activity session notes",  # a tie takes the first name
        "a b c",
        "",
        None,
    ]
    want = []
    for i, text in enumerate(texts):
        toks = {t for t in (text or "").lower().split(" ") if len(t) > 4}
        score, st = min((-sum(t in s for t in toks), s) for s in sources)
        if -score and -score >= min(2, len(toks)):
            want.append((i, -score, st))
    assert len(want) == 3
    d = write(tmp_path, documents={"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}, mix_targets={"source": sources})
    assert rows(spark, "J-11_fuzzy_match", d) == want


def test_every_order_is_paired_and_pivoted(spark, tmp_path):
    from itertools import combinations

    keys = [*range(11), 500, 501, 1000, 1001, 1500, 1501, 2000, 2001, 2500, 2501, 2503]
    votes = [f"v{k * 7 % 5}" for k in keys]
    d = write(tmp_path, orders={"o_orderkey": pa.array(keys, pa.int64()), "o_orderpriority": votes})
    groups = {}
    for k, v in zip(keys, votes, strict=True):
        groups.setdefault(k // 4, []).append((k, v))
    want = sorted((a, b, i, j, s) for s, g in groups.items() for (i, a), (j, b) in combinations(g, 2))
    got = rows(spark, "J-19_rater_pairs", d)
    assert got == want
    assert {p for r in got for p in r[2:4]} == set(keys)
    counts = {}
    for a, b, *_ in want:
        k = (a == b, " ↔ ".join(sorted((a, b))))
        counts[k] = counts.get(k, 0) + 1
    assert rows(spark, "A-26_agreement", d) == sorted((k[0], n, k[1]) for k, n in counts.items())
    wide = rows(spark, "A-42_reviewer_pivot", d)
    assert wide == sorted((*([v for _, v in g] + [""] * 4)[:4], s) for s, g in groups.items())


def test_series_are_whole(spark, tmp_path):
    from larkline.plans.base import AUS
    from larkline.plans.series import ARR, K

    lengths = {"VP1": 3, "VP2": 21, "VP3": 203, "VP4": 1, "VP5": 204}
    at = [(p, i) for p, n in lengths.items() for i in range(n)]
    x = [i * 37 % 491 / 100 for _, i in at]
    frames = {"patient_id": [p for p, _ in at], "subject_role": ["patient"] * len(at), "interview_type": ["bindung"] * len(at), "frame": pa.array([i for _, i in at], pa.int32()),
              "ts_s": [i / 2 for _, i in at], "confidence": [0.9] * len(at), "success": pa.array([1] * len(at), pa.int32()), **{c: x for c in AUS}}
    d = write(tmp_path, frames=frames)
    patches = sql(d, ["frames"], f"with {ARR}, e as (select {K}, unnest(range(0, cast(ceil(len(x) / 4.0) as int))) as i, x from s) select {K}, i, list_sum(x[i * 4 + 1:i * 4 + 4]) / 4 as mean from e")
    got = rows(spark, "W-15_patches", d)
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in patches] and len(got) == 1 + 6 + 51 + 1 + 51
    assert [r[2] for r in got] == pytest.approx([r[2] for r in patches], abs=1e-6)
    text = {r[1]: r[3] for r in rows(spark, "F-32_two_decimals", d)}
    assert text == {p: ",".join('"' + f"{v:.2f}".replace(".", "") + '"' for (q, _), v in zip(at, x, strict=True) if q == p) for p in lengths}


def test_softmax_is_over_all_components(spark, tmp_path):
    import numpy as np

    e = np.random.default_rng(3).normal(size=(5, 64))
    e[0, 40] = 9.0
    d = write(tmp_path, embeddings={"vec_id": pa.array(range(5), pa.int64()), "embedding": e.tolist()})
    got = [r[0] for r in rows(spark, "F-37_softmax", d)]
    assert got == pytest.approx(sorted(np.exp(e.max(1)) / np.exp(e).sum(1)), abs=1e-6)


def test_every_turn_has_a_place(spark, small):
    got = rows(spark, "W-18_default_sort_key", small)
    want = sql(small, ["turns"], "select session_id, coalesce(turn_index, -1) as turn_index, row_number() over (partition by session_id order by coalesce(turn_index, 1000000000), start_s nulls last, end_s nulls last, speech_unsummarised nulls last, speaker_id nulls last) as place from turns")
    assert got == want
    last = {}
    for place, session, _ in got:
        last[session] = max(place, last.get(session, 0))
    assert max(last.values()) > 3 and sum(last.values()) == len(got)


def test_merge_new_holds_every_segment(spark, small):
    from larkline.plans.joining import SEG

    got = sql(small, ["segments"], f"with {SEG} select session_id, pos, text, round(slo / 1000.0, 3) as lo, round(shi / 1000.0, 3) as hi, coalesce(text, '') as t from sg")
    old = {(hi, lo, session, t) for hi, lo, pos, session, t, _ in got if pos % 2 == 0}
    want = [(pos, session, text) for hi, lo, pos, session, t, text in got if pos % 2 == 0 or (hi, lo, session, t) not in old]
    key = lambda r: tuple(map(repr, r))
    merged = E.queries()["J-22_merge_new"](spark, small)
    assert sorted(((r.pos, r.session_id, r.text) for r in merged.collect()), key=key) == sorted(want, key=key)


def test_long_recording_keeps_all_its_spikes(spark):
    import numpy as np

    from larkline.operators import spikes

    n = 20_000  # two stretches
    rng = np.random.default_rng(5)
    v = 1 + 0.2 * np.sin(np.arange(n) / 40) + rng.normal(0, 0.02, n)
    habit = v.copy()
    at = np.arange(100, n, 200)
    v[at] += rng.uniform(1.5, 3, len(at))
    habit[::20] += 2
    f = pa.table({"patient_id": ["VP1"] * n, "subject_role": ["patient"] * n, "interview_type": ["bindung"] * n, "frame": range(n), "ts_s": np.arange(n) / 60, "confidence": np.full(n, 0.9),
                  "success": np.ones(n, int), "au04_r": v, "au25_r": habit, "au45_r": 1 + rng.normal(0, 0.02, n)})
    got = spikes.flag_faults(spark.createDataFrame(f)).collect()
    assert sorted((r.frame, r.channel, r.fault) for r in got) == [(i, "au04_r", "spike") for i in at]


def test_spikes_clear_the_range_of_all_stretches(spark):
    import numpy as np

    from larkline.operators import spikes

    n = 2 * spikes.STRETCH
    rng = np.random.default_rng(6)
    v = 1 + 0.2 * np.sin(np.arange(n) / 40) + rng.normal(0, 0.02, n)
    v[spikes.STRETCH + 2000 : spikes.STRETCH + 6000] += 1.5  # the recording moves there too
    v[500] = 2.5  # a jump within that range
    v[900] = 4.5
    f = pa.table({"patient_id": ["VP1"] * n, "subject_role": ["patient"] * n, "interview_type": ["bindung"] * n, "frame": range(n), "ts_s": np.arange(n) / 60, "confidence": np.full(n, 0.9),
                  "success": np.ones(n, int), "au04_r": v, "au25_r": v * 0 + 1, "au45_r": v * 0 + 1})
    assert [(r.frame, r.fault) for r in spikes.flag_faults(spark.createDataFrame(f)).collect()] == [(900, "spike")]


def test_ellipsoids_decide():
    """A brief jump that only the values, not the phase space, sets apart is none without its differences."""
    import numpy as np

    from larkline.operators import spikes

    o = {"min_gap": 0.6, "reach": 1.8, "core": 0.9, "floor": 0.3, "longest": 5, "events": 4, "rounds": 12}
    rng = np.random.default_rng(7)
    v = 1 + rng.normal(0, 0.05, 400)
    v[20:360:17] = 2.2  # twenty blinks
    v[200], v[300] = 4.6, 4.1
    found = np.flatnonzero(spikes.phase_space(v, o)[0])
    assert found.tolist() == [200, 300]
    assert spikes.phase_space(v, o, gate=False)[0].sum() > 10  # the tie-break alone takes blinks for spikes


def test_long_recordings_fill_like_short_ones(spark):
    """A wave that recordings share, 600 seconds long: cells beyond the first block are filled too, and an empty block."""
    import numpy as np

    from larkline.operators import grid

    rng = np.random.default_rng(8)
    n, rows = 700, []
    for r in range(24):
        amp = rng.uniform(0.3, 1.0)
        for t in range(n):
            if (r == 0 and 255 < t < 515) or (0 < t < n - 1 and rng.random() < 0.15):
                continue
            v = float(2.0 + amp * np.sin(t / 25))
            rows.append((f"VP{r:07d}", "patient", "bindung", t, t + 0.5, 0.9, 1, v, 4 - v))
    f = spark.createDataFrame(rows, "patient_id string, subject_role string, interview_type string, frame int, ts_s double, confidence double, success int, au04_r double, au12_r double")
    got = grid.regular_grid(f, rank=3, reg=0.05, min_rows=8).toPandas()
    assert len(got) == 24 * n and set(got.status) == {"observed", "filled"}
    filled = got[got.status == "filled"]
    assert set(filled.cell_s // grid.BLOCK) == {0, 1, 2} and len(filled[(filled.patient_id == "VP0000000") & filled.cell_s.between(256, 511)]) == 256
    wave = np.sin(filled.cell_s / 25)
    assert np.sqrt(np.mean((filled.au04_r - 2.0 - 0.65 * wave) ** 2)) < 0.3
    one = grid.regular_grid(f.filter("ts_s < 250"), rank=3, reg=0.05, min_rows=8).filter("status = 'filled'").count()
    assert one > 500


def test_frames_without_ids_are_held_against_the_scale(spark):
    from larkline.operators import spikes

    row = (None, "patient", "bindung", 3, 1.0, 0.9, 1, 7.0, 1.0, -1.0)
    f = spark.createDataFrame([row, row], "patient_id string, subject_role string, interview_type string, frame int, ts_s double, confidence double, success int, au04_r double, au25_r double, au45_r double")
    assert sorted((r.channel, r.fault) for r in spikes.flag_faults(f).collect()) == [("au04_r", "off_scale"), ("au45_r", "off_scale")]
