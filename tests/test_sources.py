"""Readers, writers and streams on small files."""

import io
import json
import tarfile

from pyspark.sql import functions as F

from larkline.sources import readers, sinks, tsfile
from larkline.streaming import windows


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ frame, timestamp ,  AU01_r\n1, 0.1,0.5\n2, 0.2,x\n")
    df = readers.csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["frame", "timestamp", "AU01_r"] and df.count() == 2
    (tmp_path / "b.dat").write_text("1.0  2 NaN\n3 4\n\n")
    rows = readers.whitespace_table(spark, str(tmp_path / "b.dat"), ["a", "b", "c"]).collect()
    assert [(r.a, r.b) for r in rows] == [(1.0, 2.0), (3.0, 4.0)] and rows[1].c is None
    (tmp_path / "c.tsv").write_text("1\t0.5\t0.25\n2\tx\t1\n")
    assert [r.series for r in readers.labelled_series(spark, str(tmp_path / "c.tsv")).collect()] == [[0.5, 0.25], [None, 1.0]]


def test_json(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "good.json").write_text(json.dumps([{"text": "a", "start": 1}, {"text": "b", "start": 2}]))
    (tmp_path / "x" / "bad.json").write_text("{oops")
    assert readers.json_arrays(spark, str(tmp_path / "x"), "text string, start int").select("text").collect() == [("a",), ("b",)]
    (tmp_path / "l.jsonl").write_text('{"generated": "a \\"q\\"", "gold": "b"}\nnot json\n')
    assert [tuple(r) for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "generated string, gold string").collect()] == [('a "q"', "b")]
    (tmp_path / "n.json").write_text(json.dumps({"detailed_results": [{"a": 1}, {"a": 2}]}))
    assert readers.nested_results(spark, str(tmp_path / "n.json"), "detailed_results", "a int").count() == 2
    cat = {"interviews": [{"therapist": {"therapist_id": "A0AAA"}, "patient": {"patient_id": "VP1"}, "types": {"bindung": {"transcript": "t", "labels": {"x": "1"}}}}]}
    (tmp_path / "cat.json").write_text(json.dumps(cat))
    r = readers.catalogue(spark, str(tmp_path / "cat.json")).first()
    assert (r.therapist_id, r.interview_type, r.labels) == ("A0AAA", "bindung", {"x": "1"})


def test_reports_and_lines(spark, tmp_path):
    (tmp_path / "d.rttm").write_text("SPEAKER f 1 0.5 1.25 <NA> <NA> S0 <NA>\nOTHER x\n")
    assert tuple(readers.diarization(spark, str(tmp_path / "d.rttm")).first()) == ("f", 0.5, 1.25, "S0")
    df = spark.createDataFrame([('{"generated": "a \\"b\\"", "gold": "c"} {"generated": "d", "gold": "e"}', "Template ID: 3\nQuestion: why\nso?\nAnswer: yes", 12345)], "t string, r string, i int")
    assert [(r.pos, r.gold) for r in readers.quoted_pairs(df, "t", "generated", "gold").collect()] == [(0, "c"), (1, "e")]
    assert tuple(readers.report_fields(df, "r", ["Template ID", "Question", "Answer"]).first()) == ("3", "why\nso?", "yes")
    assert df.select(readers.ecg_path("i")).first()[0] == "12000/12345_hr"


def test_ts_archive(spark, tmp_path):
    (tmp_path / "a.ts").write_text("# c\n@problemName demo\n@data\n1,2,?:4,5:x\n(0,1),(1,2):3:y\n")
    rows = tsfile.read_ts(spark, str(tmp_path / "a.ts")).collect()
    assert [(r.dims, r.target) for r in rows] == [([[1.0, 2.0, None], [4.0, 5.0]], "x"), ([[1.0, 2.0], [3.0]], "y")]
    assert tsfile.header(spark, str(tmp_path / "a.ts"))["problemname"] == "demo"
    (tmp_path / "b.ts").write_text("@data\n1:2:x\n1:x\n")
    try:
        tsfile.read_ts(spark, str(tmp_path / "b.ts"))
        raise AssertionError
    except ValueError:
        pass


def test_tar_shards(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as t:
        for name, data in (("a.txt", b"one"), ("a.png", b"img"), ("b.txt", b"two")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "bad.tar").write_bytes(b"nonsense")
    got = {r.key: sorted(r.members) for r in readers.tar_samples(spark, str(tmp_path / "*.tar")).collect()}
    assert got == {"a": ["png", "txt"], "b": ["txt"]}


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    sinks.json_by(df, str(tmp_path / "j"), "p")
    assert spark.read.json(str(tmp_path / "j")).count() == 10
    path = str(tmp_path / "r")
    assert sinks.resume(spark, df.limit(4), path, ["id"], lambda x: x) == 4
    assert sinks.resume(spark, df, path, ["id"], lambda x: x) == 6
    assert sinks.resume(spark, df, path, ["id"], lambda x: x) == 0
    sinks.catalogue(df, str(tmp_path / "c"))
    sinks.catalogue(df.limit(1), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 10
    sig = spark.createDataFrame([(1, [[0.5, 0.25], [1.0]])], "id int, s array<array<double>>")
    sinks.leads(sig, str(tmp_path / "l"), "id", "s")
    assert spark.read.option("header", True).csv(str(tmp_path / "l")).count() == 3


def test_streams(spark, tmp_path, small):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(src)
    s = windows.file_stream(spark, src, spark.read.parquet(src).schema, 1)
    q = windows.first_seen(s, ["event_id"], "ts", "365 days").select("event_id", "user_id")
    for _ in range(2):
        windows.run_once(q, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(src).select("event_id").distinct().count()
    w = windows.tumbling(s, "ts", ["user_id"], "value", "1 day", "1 day")
    windows.run_once(w, str(tmp_path / "w"), str(tmp_path / "wcp"))
    assert spark.read.parquet(str(tmp_path / "w")).agg(F.sum("n")).first()[0] > 0
    assert windows.sessions(spark.read.parquet(src), "ts", ["user_id"]).agg(F.sum("n")).first()[0] == spark.read.parquet(src).count()


def test_yaml_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "a: b", "x\ny"), (2, None, "é")], "session_id long, patient string, itype string")
    path = str(tmp_path / "y")
    sinks.yaml_catalogue(df, path)
    (tmp_path / "y" / "broken.txt").write_text("interviews: [1, {")
    schema = "session_id long, patient string, itype string"
    assert sorted(tuple(r) for r in readers.yaml_catalogue(spark, path, schema).collect()) == [(1, "a: b", "x\ny"), (2, None, "é")]


def test_file_plan_of_ties_and_nulls(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("A b.csv",), ("a-B.csv",), ("a_b.csv",), ("NN.csv",), (None,), ("x.csv",)], "f string")
    got = readers.file_plan(df, "f", "^NN", F.regexp_replace(F.lower("f"), r"[-\s]", "_"), F.nullif(F.regexp_extract("f", "(?i)(a)", 1), F.lit("")))
    assert {r.src: (r.dst, r.reason) for r in got.collect()} == {
        "A b.csv": ("a_b.csv", "rename"), "a-B.csv": (None, "taken"), "a_b.csv": (None, "taken"), "NN.csv": (None, "drop_rule"), "x.csv": (None, "no_ident"),
    }
