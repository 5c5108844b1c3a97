"""Column helpers that keep unknown values unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_PER_DAY = 86_400_000


def day_of(ms: Column) -> Column:
    """UTC day of an epoch-millisecond column, as yyyy-MM-dd; independent of the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(MS_PER_DAY)).cast("int")).cast("string")


def iso_second(ms: Column) -> Column:
    """Epoch milliseconds as yyyy-MM-ddTHH:mm:ssZ."""
    second = F.pmod(F.floor(ms / 1000), F.lit(86_400)).cast("int")
    part = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.when(ms.isNotNull(), F.concat(day_of(ms), F.lit("T"), part(second / 3600), F.lit(":"), part(second % 3600 / 60), F.lit(":"), part(second % 60), F.lit("Z")))


def total(column: str | Column) -> Column:
    """Sum that is null where nothing is known."""
    return F.sum(column)


def counted(condition: Column) -> Column:
    return F.count_if(condition)


def total_where(condition: Column, value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(F.when(condition, value))


def names(column: str) -> Column:
    """Distinct values in order, joined by commas; null without any."""
    joined = F.array_join(F.array_sort(F.collect_set(column)), ",")
    return F.when(F.count(column) > 0, joined)


def rate(part: Column, whole: Column) -> Column:
    """part / whole as double; null for a whole of 0 or unknown."""
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")


def json_list(text: Column) -> Column:
    """Elements of a JSON array of strings; null for malformed text."""
    return F.from_json(text, "array<string>")
