"""Array, number and map expressions: serialising, parsing, vectors, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkline.operators.clean import col


def digits(series: Column | str, precision: int = 3, separator: str = ", ", minus: str = "-", spaced: bool = True) -> Column:
    """Numbers as separated digits, truncated to ``precision`` decimals and scaled; a separator after each; NaN and null as 'NaN'."""

    def one(x: Column) -> Column:
        n = F.floor(F.abs(x) * (10**precision) + 1e-9).cast("long").cast("string")
        n = F.array_join(F.split(n, ""), " ") if spaced else n
        return F.when(x.isNull() | F.isnan(x), "NaN").otherwise(F.concat(F.when(x < 0, minus).otherwise(""), F.trim(n)))

    return F.concat(F.array_join(F.transform(col(series), one), separator), F.lit(separator))


def undigits(text: Column | str, precision: int = 3, separator: str = ",") -> Column:
    """Inverse of digits, at the middle of the truncated step."""

    def one(t: Column) -> Column:
        t = F.regexp_replace(t, r"\s+", "")
        n = F.regexp_replace(t, "^-", "").try_cast("double")
        x = (n + 0.5) / (10**precision)
        return F.when(t.startswith("-"), -x).otherwise(x)

    parts = F.filter(F.split(col(text), separator), lambda t: F.trim(t) != "")
    return F.transform(parts, one)


def two_decimals(series: Column | str) -> Column:
    """Numbers with two decimals, the point dropped, quoted and joined by commas."""
    return F.array_join(F.transform(col(series), lambda x: F.concat(F.lit('"'), F.replace(F.format_string("%.2f", x), F.lit("."), F.lit("")), F.lit('"'))), ",")


def parse_series(c: Column | str, nested: bool = False) -> Column:
    """Array of numbers from its JSON text; null where it is none. ``nested`` takes the first inner list."""
    return F.from_json(col(c), "array<array<double>>")[0] if nested else F.from_json(col(c), "array<double>")


def first_int(c: Column | str) -> Column:
    """The integer in a text such as '[123]'."""
    return F.nullif(F.regexp_extract(col(c), r"(-?\d+)", 1), F.lit("")).try_cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(0.0)))[0]


def softmax(a: Column) -> Column:
    """exp(x - max) over its sum, for each element."""
    e = F.transform(F.array(F.array_max(a)), lambda m: F.transform(a, lambda v: F.exp(v - m)))[0]
    return F.transform(F.array(F.aggregate(e, F.lit(0.0), lambda s, v: s + v)), lambda t: F.transform(e, lambda v: v / t))[0]


def mean_line(m: Column) -> Column:
    """name=0.123 of a map's entries, by name, joined by blanks."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.3f", e["value"]))), " ")


def patch_count(n: Column, patch: int) -> Column:
    return F.ceil(n / patch)


def gib(n: Column | str) -> Column:
    """Bytes as GiB; -1 stays."""
    return F.when(col(n) == -1, -1.0).otherwise(col(n) / 1073741824)


def cache_key(*parts: Column) -> Column:
    """First eight hex digits of the md5 of the parts."""
    return F.left(F.md5(F.concat_ws("|", *parts)), F.lit(8))
