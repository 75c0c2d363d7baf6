"""Readers of delimited, JSON, report and archive files, tolerant of what such files hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkline.operators import ranks, splits


def clean_names(df: DataFrame) -> DataFrame:
    """Headers without byte-order mark and white space."""
    return df.select([F.col(f"`{c}`").alias(c.replace("﻿", "").strip()) for c in df.columns])


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header; names trimmed, blanks before cells ignored. Without a schema all cells are text."""
    reader = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if schema is not None:
        reader = reader.schema(schema)
    return clean_names(reader.csv(path))


def whitespace_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines of cells parted by white space as doubles; cells that are no number, and missing ones, are null."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(cells.alias("c"))
    return rows.select([F.try_element_at("c", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)])


def labelled_series(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Headerless rows label, t1 .. tn: label and series."""
    cells = F.split("value", sep)
    rows = spark.read.text(path).filter(F.trim("value") != "")
    series = F.transform(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), lambda x: x.try_cast("double"))
    return rows.select(F.trim(cells[0]).alias("label"), series.alias("series"))


def json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold an array of records: record columns and the file; files that do not parse are skipped."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"array<struct<{schema}>>").alias("r"))
    return rows.select("file", F.posexplode("r").alias("pos", "x")).select("file", "pos", "x.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are skipped."""
    with_bad = T._parse_datatype_string(schema + ", _bad string")
    rows = spark.read.schema(with_bad).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null").drop("_bad")


def nested_results(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """JSON documents with a list of results in one field, a row each."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.explode(F.from_json("value", f"struct<`{field}`: array<struct<{schema}>>>")[field]).alias("x")).select("x.*")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue as JSON ({"interviews": [{therapist, patient, types: {type: {...}}}]}), flat: a row an interview and type."""
    parts = "therapist struct<therapist_id: string>, patient struct<patient_id: string>, baseline map<string, string>, types map<string, struct<therapist_openface: string, patient_openface: string, transcript: string, labels: map<string, string>, answer: string>>"
    rows = nested_results(spark, path, "interviews", parts)
    return rows.select(F.col("therapist.therapist_id"), F.col("patient.patient_id"), "baseline", F.explode("types").alias("interview_type", "t")).select("therapist_id", "patient_id", "interview_type", "baseline", "t.*")


def yaml_catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """YAML documents with a list of interviews, a row an interview of the given schema; broken documents are skipped.

    Without a YAML library only documents that are JSON, a part of YAML, can be read.
    """
    files = spark.read.text(path, wholetext=True)

    def parse(batches):
        import json

        import pyarrow as pa

        try:
            import yaml

            load, broken = yaml.safe_load, yaml.YAMLError
        except ImportError:
            load, broken = json.loads, ValueError
        for b in batches:
            out = []
            for t in b.column("value").to_pylist():
                try:
                    found = load(t)
                except broken:
                    continue
                rows = found.get("interviews") if isinstance(found, dict) else None
                out += [json.dumps(x, default=str) for x in rows or [] if isinstance(x, dict)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["j"])

    return files.mapInArrow(parse, "j string").select(F.from_json("j", schema).alias("x")).select("x.*")


def resampled(shards: DataFrame, name: str, draws: int, epoch: int, seed: int = 42) -> DataFrame:
    """``draws`` shards drawn with replacement for an epoch: draw, and the shard's row; the same seed draws the same.

    Shards are numbered by name; draw i of an epoch takes a number from a hash of seed, epoch and i.
    """
    n = shards.count()
    drawn = shards.sparkSession.range(draws).select(F.col("id").alias("draw"), splits.hash_share(F.col("id") + epoch * 1_000, seed, max(n, 1)).alias("_n"))
    numbered = shards.withColumn("_n", F.row_number().over(Window.orderBy(name)) - 1)  # a row a shard
    return drawn.join(numbered, "_n").drop("_n")


def shuffled(df: DataFrame, ident: str, seed: int, good: Column | None = None) -> DataFrame:
    """Rows with their place in a seeded order; rows for which ``good`` is not true are skipped."""
    h = splits.hash_share(ident, seed, 1_000_003)
    rows = df if good is None else df.filter(good)
    return ranks.rank_within(rows, [], [h, F.col(ident)], ranks.spread(h, 1_000_003), "place")


def file_plan(df: DataFrame, name: str, drop: str, rename: Column, ident: Column) -> DataFrame:
    """What is to happen to files, nothing of it done: src, dst, ident, reason (drop_rule, no_ident, rename, same, taken).

    ``drop``: pattern of names to drop; ``taken``: an earlier name, in order, has the same target.
    """
    rows = df.filter(F.col(name).isNotNull()).select(F.col(name).alias("src"), rename.alias("dst"), ident.alias("ident")).distinct()
    lost = F.when(F.col("src").rlike(drop), "drop_rule").when(F.col("ident").isNull() | (F.col("ident") == ""), "no_ident")
    rows = rows.withColumn("lost", lost)
    first = F.min(F.when(F.col("lost").isNull(), F.col("src"))).over(Window.partitionBy("dst"))
    reason = F.when(F.col("lost").isNotNull(), F.col("lost")).when(first < F.col("src"), "taken").when(F.col("src") == F.col("dst"), "same").otherwise("rename")
    return rows.withColumn("first", first).select("src", F.when(reason.isin("rename", "same"), F.col("dst")).alias("dst"), "ident", reason.alias("reason"))


def files(spark: SparkSession, path: str, pattern: str = "*", done: DataFrame | None = None) -> DataFrame:
    """Files below a folder by name pattern, without those already in ``done`` (a column name)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).drop("content")
    rows = rows.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return rows if done is None else rows.join(done.select("name"), "name", "left_anti")


def diarization(spark: SparkSession, path: str) -> DataFrame:
    """SPEAKER lines: file, start, seconds, speaker."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.col("value").startswith("SPEAKER"))
    at = lambda i: F.try_element_at(c, F.lit(i))
    return rows.select(at(2).alias("file"), at(4).try_cast("double").alias("start"), at(5).try_cast("double").alias("seconds"), at(8).alias("speaker"))


def quoted_pairs(df: DataFrame, text: str, first: str, second: str) -> DataFrame:
    """Pairs of quoted values of two keys in raw text, by position; escaped quotes belong to the value."""
    value = lambda k: F.regexp_extract_all(F.col(text), F.lit(rf'"{k}"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return df.select(F.posexplode(F.arrays_zip(value(first).alias(first), value(second).alias(second))).alias("pos", "x")).select("pos", "x.*")


def report_fields(df: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """Sections 'Name: ...' of a report, each up to the next named section."""
    stop = "|".join(f"{f}:" for f in fields)
    pick = [F.nullif(F.trim(F.regexp_extract(F.col(text), rf"(?s){f}:\s*(.*?)\s*(?=(?:{stop})|$)", 1)), F.lit("")).alias(f) for f in fields]
    return df.select(*pick)


def ecg_path(ident: Column | str) -> Column:
    """Record path of an ECG id: thousands folder and five-digit name."""
    c = F.col(ident) if isinstance(ident, str) else ident
    return F.format_string("%05d/%05d_hr", F.floor(c / 1000) * 1000, c)


def tar_samples(spark: SparkSession, path: str) -> DataFrame:
    """Members of tar shards grouped by key: shard, key, members (extension -> bytes). A broken shard is skipped."""
    shards = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches):
        import io
        import tarfile

        import pyarrow as pa

        for b in batches:
            rows: list[tuple] = []
            for shard, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as t:
                        for m in t:
                            key, _, ext = m.name.rpartition("/")[2].partition(".")
                            if m.isfile() and key:
                                rows.append((shard, key, ext.lower(), t.extractfile(m).read()))
                except tarfile.TarError:
                    continue
            kinds = (pa.string(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["shard", "key", "ext", "data"])

    members = shards.mapInArrow(read, "shard string, key string, ext string, data binary")
    return members.groupBy("shard", "key").agg(F.map_from_entries(F.collect_list(F.struct("ext", "data"))).alias("members"))
