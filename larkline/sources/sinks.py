"""Writers: partitioned JSON, appended lines and CSV, shards, resumable batches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_by(df: DataFrame, path: str, *parts: str) -> None:
    """JSON files in folders by the named columns; the commit protocol makes a half-written run invisible."""
    df.write.mode("overwrite").partitionBy(*parts).json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("append").option("header", True).option("sep", sep).csv(path)


def catalogue(df: DataFrame, path: str, force: bool = False) -> None:
    """Write a catalogue unless it exists, or over it with ``force``."""
    df.write.mode("overwrite" if force else "ignore").json(path)


def yaml_text(rows: list[dict]) -> str:
    """A catalogue {"interviews": [...]} as YAML; without a YAML library as JSON, which is YAML too."""
    try:
        import yaml
    except ImportError:
        return json.dumps({"interviews": rows}, ensure_ascii=False, indent=1)
    return yaml.safe_dump({"interviews": rows}, allow_unicode=True, sort_keys=True)


def yaml_catalogue(df: DataFrame, path: str, force: bool = False, each: int = 1000) -> None:
    """Catalogue rows as YAML documents of at most ``each`` interviews, unless they exist or with ``force``."""
    part = df.withColumn("_part", F.floor(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20)) * F.lit(max(1, -(-df.count() // each))) / (1 << 20)))
    rows = part.groupBy("_part").agg(F.collect_list(F.to_json(F.struct(*df.columns))).alias("r"))

    def write(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([yaml_text([json.loads(x) for x in r]) for r in b.column("r").to_pylist()])], names=["value"])

    rows.select("r").mapInArrow(write, "value string").write.mode("overwrite" if force else "ignore").option("maxRecordsPerFile", 1).text(path)


def replace(df: DataFrame, path: str) -> None:
    """Parquet written beside ``path`` and moved into its place when it is whole; a reader never meets half of it."""
    spark = df.sparkSession
    new = f"{path}.new"
    df.write.mode("overwrite").parquet(new)
    fs, target = _file(spark, path)
    fs.delete(target, True)
    if not fs.rename(_file(spark, new)[1], target):
        raise OSError(f"{new} cannot be moved to {path}")


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cached(spark: SparkSession, root: str, parameters: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, kept under ``root`` by the first eight hex digits of its parameters' md5."""
    key = hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:8]
    fs, done = _file(spark, f"{root}/{key}/_SUCCESS")
    if not fs.exists(done):
        build().write.mode("overwrite").parquet(f"{root}/{key}")
    return spark.read.parquet(f"{root}/{key}")


def append_history(df: DataFrame, path: str) -> None:
    """Loss history: tab-separated rows epoch, train, val, one run's rows a file."""
    df.select("epoch", "train", "val").write.mode("append").option("sep", "\t").csv(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("epoch int, train double, val double").option("sep", "\t").csv(path)


def leads(df: DataFrame, path: str, ident: str, signal: str, rate: float = 100.0) -> None:
    """CSV a lead with a time axis: signal is an array of leads, each an array of samples."""
    rows = df.select(ident, F.posexplode(signal).alias("lead", "s")).select(ident, "lead", F.posexplode("s").alias("i", "mv"))
    rows.select(ident, "lead", (F.col("i") / rate).alias("seconds"), "mv").write.mode("overwrite").option("header", True).partitionBy("lead").csv(path)


def shards(df: DataFrame, path: str, rows_each: int) -> None:
    """Parquet files of at most ``rows_each`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_each).parquet(path)


def pending(df: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the output does not hold yet."""
    return df.join(done.select(*key).distinct(), key, "left_anti")


def resume(spark: SparkSession, df: DataFrame, path: str, key: list[str], work: Callable[[DataFrame], DataFrame]) -> int:
    """Work on the rows not yet in the parquet output and append them; the number of rows appended."""
    try:
        done = spark.read.parquet(path)
        todo = pending(df, done, key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = df
    todo = todo.persist()
    n = todo.count()
    if n:
        work(todo).write.mode("append").parquet(path)
    todo.unpersist()
    return n
