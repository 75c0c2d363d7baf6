"""Reader of the multivariate time-series archive format (.ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ts(spark: SparkSession, path: str, target: bool = True) -> DataFrame:
    """case, dims (array of series, '?' is null), target of the data lines; '#' and '@' lines are header.

    Dimensions are parted by ':', values by ','; values written (time,value) lose the time. Cases
    whose number of dimensions differs from the first case's raise an error.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.col("_metadata.file_path").alias("file"))
    lines = lines.filter((F.col("v") != "") & ~F.col("v").startswith("#") & ~F.col("v").startswith("@"))
    parts = F.split(F.regexp_replace("v", r"\(\s*([^(),]*?)\s*,\s*([^(),]*?)\s*\)", "$2"), ":")
    dims = F.slice(parts, 1, F.size(parts) - 1) if target else parts
    number = lambda x: F.nullif(F.trim(x), F.lit("?")).try_cast("double")
    series = F.transform(dims, lambda d: F.when(F.trim(d) == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(d, ","), number)))
    rows = lines.select("file", series.alias("dims"), (F.trim(F.element_at(parts, -1)) if target else F.lit(None).cast("string")).alias("target"))
    k = rows.agg(F.min(F.size("dims")), F.max(F.size("dims"))).first()
    if k[0] != k[1]:
        raise ValueError(f"cases have between {k[0]} and {k[1]} dimensions")
    return rows


def header(spark: SparkSession, path: str) -> dict[str, str]:
    """The '@' tags of a file with their values, lower-case names."""
    rows = spark.read.text(path).filter(F.trim("value").startswith("@")).collect()
    out = {}
    for r in rows:
        name, _, value = r[0].strip()[1:].partition(" ")
        out[name.lower()] = value.strip()
    return out


def stacked(df: DataFrame) -> DataFrame:
    """Long rows case, dim, i, value of read_ts; case numbers are stable within the file's order of ids."""
    rows = df.withColumn("case", F.monotonically_increasing_id())
    return rows.select("case", "target", F.posexplode("dims").alias("dim", "s")).select("case", "target", "dim", F.posexplode("s").alias("i", "value"))


def equal_stack(df: DataFrame) -> DataFrame:
    """Rows of read_ts with a flag: ok where every dimension has the first case's first length (a case a row)."""
    length = df.select(F.size(F.col("dims")[0])).first()
    n = length[0] if length else 0
    return df.withColumn("ok", F.forall("dims", lambda s: F.size(s) == n))
