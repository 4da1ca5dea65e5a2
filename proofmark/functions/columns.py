"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A top-level column, also when its name holds dots or backticks."""
    return F.col(quoted(name))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; NULL when the denominator is 0."""
    return numerator.cast("double") / F.nullif(denominator, F.lit(0))


def null_to_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def to_number(value: Column) -> Column:
    """Number as double; text that is no number, and NaN, become NULL."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def equals_all(filters: Mapping[str, str]) -> Column:
    """AND of column = value; true without filters."""
    return reduce(
        lambda left, right: left & right,
        [col(name) == F.lit(value) for name, value in filters.items()],
        F.lit(True),
    )


def previous_month(month: int) -> int:
    return 12 if month == 1 else month - 1


def month_window(year: int, current: int) -> tuple[date, date]:
    """Half-open range from the start of the previous month to the end of ``current``."""
    start = date(year - 1, 12, 1) if current == 1 else date(year, current - 1, 1)
    end = date(year + 1, 1, 1) if current == 12 else date(year, current + 1, 1)
    return start, end


def in_two_months(when: Column, year: int | None, current: int) -> Column:
    """The previous and the current month of ``year``, or of every year when unknown.

    The known-year form compares with date literals, which reach the Parquet scan.
    """
    if year is None:
        return F.month(when).isin(previous_month(current), current)
    start, end = month_window(year, current)
    return (when >= F.lit(start)) & (when < F.lit(end))


def iso_text(value: Column, kind: T.DataType) -> Column:
    """ISO text of a date or timestamp, with microseconds only where there are any."""
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(value, ".SSSSSS")
    return F.when(fraction == ".000000", whole).otherwise(F.concat(whole, fraction))


def json_safe(field: T.StructField) -> Column:
    """A column as the types JSON can carry: ISO text, double, lower-case hex."""
    value, kind = col(field.name), field.dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = iso_text(value, kind)
    elif isinstance(kind, T.DecimalType):
        value = value.cast("double")
    elif isinstance(kind, T.BinaryType):
        value = F.lower(F.hex(value))
    return value.alias(field.name)


def general_number(value: Column) -> Column:
    """Text of a number with six significant digits and without trailing zeros."""
    number = value.cast("double")
    parts = F.split(F.format_string("%.5e", number), "e")
    exponent = F.get(parts, F.lit(1)).cast("int")
    rounded = F.format_string("%.9f", F.format_string("%.5e", number).cast("double"))
    plain = F.regexp_replace(rounded, r"\.?0+$", "")
    scientific = F.concat(
        F.regexp_replace(F.get(parts, F.lit(0)), r"\.?0+$", ""), F.lit("e"), F.get(parts, F.lit(1))
    )
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    shown = F.when((exponent >= -4) & (exponent < 6), plain).otherwise(scientific)
    return F.when(number == 0, "0").when(finite, shown).otherwise(F.lower(number.cast("string")))
