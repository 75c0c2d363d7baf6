"""Shared helpers: table access, lineage cuts and the id spellings of this data model."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors see.

    Where it is unset, as in tests on one machine, a temporary one that ends with the process; a
    cluster without it is an error, since its executors could not read each other's files.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        folder = _OWN[context.applicationId] = tempfile.mkdtemp(prefix="larkline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _OWN[context.applicationId]


_OWN: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def interview_type(c: Column | str) -> Column:
    """The three interview types from their raw spellings, else null.

    ``bind`` anywhere is bindung; a leading ``pers`` or ``st`` is personal;
    a leading ``wun`` or ``wf`` anywhere is wunder.
    """
    x = F.lower(F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[\s ]+", " ")))
    return (
        F.when(x.contains("bind"), F.lit("bindung"))
        .when(x.startswith("pers") | x.startswith("st"), F.lit("personal"))
        .when(x.startswith("wun") | x.contains("wf"), F.lit("wunder"))
    )


def patient_key(c: Column | str) -> Column:
    """``VP`` and seven digits from any spelling; placeholders become null."""
    x = F.upper(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^\p{L}\p{N}]", ""))
    return F.nullif(F.regexp_extract(x, r"^(VP\d{7})$", 1), F.lit(""))


def therapist_key(c: Column | str) -> Column:
    """A letter, a digit and three letters, upper case; a leading ``Th`` mark is decoration."""
    x = F.upper(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^\p{L}\p{N}]", ""))
    return F.nullif(F.regexp_extract(x, r"^(?:TH)?([A-Z]\d[A-Z]{3})$", 1), F.lit(""))


def split_name(c: Column | str) -> Column:
    """train, val or test from any spelling, else null."""
    x = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^\p{L}]", ""))
    return (
        F.when(x.isin("train", "training"), F.lit("train"))
        .when(x.isin("val", "valid", "validation", "dev"), F.lit("val"))
        .when(x.isin("test", "testing"), F.lit("test"))
    )


def source_name(c: Column | str) -> Column:
    """Lower-case source with underscores for blanks and hyphens; blank is null."""
    x = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[\s ]+|[\s ]+$", ""))
    return F.nullif(F.regexp_replace(x, r"[\s _-]+", "_"), F.lit(""))


def finite(c: Column | str) -> Column:
    """Null for NaN and infinities, else the number as double."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def scratch(spark: SparkSession) -> str:
    """A new folder name in the session's shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"
