"""Speaker turns: merging neighbours, shares, role by duration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkline.operators.clean import strip


def merge_speakers(df: DataFrame, key: str, order: list, speaker: str, start: str, end: str, text: str) -> DataFrame:
    """Neighbouring segments of one speaker become one turn; blank texts are skipped and part nothing.

    Speakers are compared trimmed and in lower case. Start is the first segment's, end the last
    one's, texts are joined by a blank. Columns: key, turn_index, speaker, start, end, segments, text.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.filter(strip(text) != "").withColumn("_s", F.lower(strip(speaker)))
    rows = rows.withColumns({"_new": F.coalesce((~F.lag("_s").over(w).eqNullSafe(F.col("_s"))).cast("int"), F.lit(1)), "_i": F.row_number().over(w)})
    first = F.lag("_i").over(w).isNull()
    rows = rows.withColumn("_new", F.when(first, 1).otherwise(F.col("_new"))).withColumn("turn_index", F.sum("_new").over(w) - 1)
    parts = F.sort_array(F.collect_list(F.struct(F.col("_i").alias("i"), strip(text).alias("t"))))
    return rows.groupBy(key, "turn_index", F.col("_s").alias("speaker")).agg(
        F.min_by(start, "_i").alias("start"), F.max_by(end, "_i").alias("end"), F.count("*").alias("segments"), F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text")
    )


def speaker_shares(df: DataFrame, key: str, speaker: str, least: float = 0.1) -> DataFrame:
    """Segments of client and therapist, and whether one has less than the share ``least``; none is no imbalance."""
    who = F.lower(strip(speaker))
    got = df.groupBy(key).agg(*[F.sum((who == s).cast("long")).alias(s) for s in ("client", "therapist")]).na.fill(0)
    total = F.col("client") + F.col("therapist")
    return got.withColumn("imbalanced", (total > 0) & (F.least("client", "therapist") < least * total))


def longest_speaker(df: DataFrame, key: str, speaker: str, seconds) -> DataFrame:
    """The speaker with most speaking time is the client; ties take the larger name."""
    per = df.groupBy(key, speaker).agg(F.sum(seconds).alias("seconds"))
    return per.groupBy(key).agg(F.max_by(speaker, F.struct(F.round("seconds", 6), F.col(speaker))).alias("client"))
