"""Projections, filters and cleaning expressions of session data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim of all white space; Spark's trim takes blanks only."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select([c for c in wanted if c in df.columns])


def columns_like(df: DataFrame, *parts: str) -> list[str]:
    """Columns whose lower-case name holds every part."""
    return [c for c in df.columns if all(p.lower() in c.lower() for p in parts)]


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop the named columns that exist."""
    return df.drop(*[n for n in names if n in df.columns])


def number(c: Column | str) -> Column:
    """Double where the text is one, else null."""
    return col(c).try_cast("double")


def finite_or_null(c: Column | str) -> Column:
    """Null for null, NaN, infinities, the texts of these and what is no number."""
    x = number(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def coerce_ms(c: Column | str, default: int = 0) -> Column:
    """Whole milliseconds: numbers are truncated, digit texts read, anything else the default; never negative."""
    x = finite_or_null(c)
    return F.greatest(F.coalesce(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)), F.lit(default)), F.lit(0)).cast("long")


def ordered(start: Column | str, end: Column | str) -> tuple[Column, Column]:
    """Start and end, swapped where the end comes first."""
    return F.least(col(start), col(end)), F.greatest(col(start), col(end))


def tracked(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Frames with success 1 and enough confidence."""
    return df.filter((F.col("success") == 1) & (F.col("confidence") >= threshold))


def excluding(df: DataFrame, name: Column | str, excluded: DataFrame, prefix: str = "") -> DataFrame:
    """Rows whose name, lower case and without the prefix, is not listed (first column of ``excluded``)."""
    key = F.regexp_replace(F.lower(strip(name)), f"^{prefix}", "") if prefix else F.lower(strip(name))
    listed = excluded.select(F.lower(strip(excluded.columns[0])).alias("_x")).distinct()
    return df.withColumn("_key", key).join(listed, F.col("_key") == F.col("_x"), "left_anti").drop("_key")


def groups_with(df: DataFrame, key: list[str], condition: Column) -> DataFrame:
    """Rows of the groups for which the aggregate condition holds; one shuffle on the key."""
    return df.join(df.groupBy(*key).agg(condition.alias("_ok")).filter("_ok").select(*key), key, "left_semi")


def blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def first_filled(*names: str) -> Column:
    """First of the columns whose text is not blank."""
    return F.coalesce(*[F.when(~blank(n), F.col(n)) for n in names])


def invalid_rows(df: DataFrame, required: list[str]) -> DataFrame:
    """Quarantine: rows with a blank required field and the names of these."""
    bad = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in required]))
    return df.withColumn("missing", F.array_join(bad, ",")).filter(F.col("missing") != "")


def all_finite(series: Column | str) -> Column:
    """An array that holds at least one number and only finite ones."""
    ok = F.forall(col(series), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(col(series)) > 0) & ok, F.lit(False))


def remap(c: Column | str, names: dict, default: Column | None = None) -> Column:
    """Literal remap of codes; others become the default or stay null."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    got = F.try_element_at(table, col(c))
    return got if default is None else F.coalesce(got, default)


def discrepancy(difference: Column | str, limit: float = 6.0) -> Column:
    """'equally empathic' within the limit on either side, else 'discrepancy'; null stays null."""
    d = col(difference)
    return F.when(d.between(-limit, limit), "equally empathic").when(d.isNotNull(), "discrepancy")


def quantile_bin(c: Column | str, edges: tuple, names: tuple[str, ...] = ("poor", "reasonable", "good", "very_good")) -> Column:
    """Name of the first edge that is not exceeded."""
    x = col(c)
    out = F.when(x.isNotNull(), F.lit(names[-1]))
    for edge, name in reversed(list(zip(edges, names, strict=False))):
        out = F.when(x <= edge, name).otherwise(out)
    return out


def completion(answers: list[Column]) -> Column:
    """Completed, In Progress or Not Started by the answered questions."""
    n = reduce(lambda a, b: a + b, [(~blank(a)).cast("int") for a in answers])
    return F.when(n == len(answers), "Completed").when(n > 0, "In Progress").otherwise("Not Started")


def usable_text(c: Column | str) -> Column:
    """Not blank and no error message."""
    return ~blank(c) & ~F.lower(strip(c)).startswith("error:")


def matching(df: DataFrame, **criteria: list) -> DataFrame:
    """Rows within every non-empty list of values; an empty list is no filter."""
    for name, values in criteria.items():
        if values:
            df = df.filter(F.col(name).isin(*values))
    return df


def swap_labels(df: DataFrame, key: Column | str, listed: list[str], speaker: str = "speaker_id") -> DataFrame:
    """Client and therapist swapped in the listed sessions only."""
    other = remap(speaker, {"client": "therapist", "therapist": "client"}, F.col(speaker))
    return df.withColumn(speaker, F.when(col(key).isin(*listed), other).otherwise(F.col(speaker)))


def starts_with_speaker(df: DataFrame, key: str, order: str, speaker: str, who: str = "client") -> DataFrame:
    """Keys whose first row is spoken by ``who``."""
    first = df.groupBy(key).agg(F.min_by(speaker, order).alias("first_speaker"))
    return first.filter(F.col("first_speaker") == who)


def first_by_key(m: Column | str, prefix: str, suffix: str) -> Column:
    """Value of the first map entry, by key, with the prefix and suffix."""
    hits = F.array_sort(F.map_entries(F.map_filter(col(m), lambda k, _: k.startswith(prefix) & k.endswith(suffix))))
    return F.try_element_at(hits, F.lit(1))["value"]


def stray_headers(df: DataFrame, name: str) -> DataFrame:
    """Drop repeated header rows, whose cell holds the column's own name."""
    return df.filter(F.col(name).isNull() | (F.col(name) != name))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
