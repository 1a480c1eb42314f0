"""Calendars: one row per day between two dates, given or taken from a column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep._columns import c, require

FIELDS = ("date", "year", "month_number", "month_name", "weekday_number", "weekday_name", "week", "weekend_flag")


def _moved(day: Column, amount: int | None, unit: str | None, sign: int) -> Column:
    if not amount or unit is None:
        return day
    if unit in ("days", "weeks"):
        return F.date_add(day, F.lit(sign * amount * (7 if unit == "weeks" else 1)))
    if unit in ("months", "years"):
        return F.add_months(day, F.lit(sign * amount * (12 if unit == "years" else 1)))
    raise ValueError("offset unit must be days, weeks, months or years")


def _days(ends: DataFrame, fields: Iterable[str]) -> DataFrame:
    """``ends`` has one row with _from and _to."""
    fields = list(fields)
    wrong = [f for f in fields if f not in FIELDS]
    if wrong or not fields:
        raise ValueError(f"calendar fields must be of {FIELDS}; wrong: {wrong}")
    checked = F.when(
        F.col("_from") > F.col("_to"), F.raise_error(F.lit("the calendar starts after its end"))
    ).otherwise(F.col("_from"))
    days = ends.where("_from is not null and _to is not null")
    days = days.select(F.explode(F.sequence(checked, F.col("_to"), F.expr("interval 1 day"))).alias("day"))
    values = {
        "date": F.col("day").alias("calendar_date"),
        "year": F.year("day").alias("year"),
        "month_number": F.month("day").alias("month_number"),
        "month_name": F.date_format("day", "MMMM").alias("month_name"),
        "weekday_number": (F.weekday("day") + 1).alias("weekday_number"),
        "weekday_name": F.date_format("day", "EEEE").alias("weekday_name"),
        "week": F.weekofyear("day").alias("week"),
        "weekend_flag": (F.weekday("day") >= 5).alias("is_weekend"),
    }
    # The columns come in the fixed order of FIELDS.
    calendar = days.select(*[values[f] for f in FIELDS if f in fields])
    return calendar if "date" in fields else calendar.distinct()


def generate_calendar(
    spark: SparkSession,
    from_date: str | None = None,
    to_date: str | None = None,
    back: tuple[int, str] | None = None,
    ahead: tuple[int, str] | None = None,
    fields: Iterable[str] = FIELDS,
) -> DataFrame:
    """A calendar from ``from_date`` (default today) minus ``back`` to ``to_date`` (default today) plus ``ahead``.

    Offsets are (number, days | weeks | months | years). Without the field ``date`` the rows are distinct.
    """
    start = F.to_date(F.lit(from_date)) if from_date else F.current_date()
    end = F.to_date(F.lit(to_date)) if to_date else F.current_date()
    ends = spark.range(1).select(
        _moved(start, *(back or (0, None)), -1).alias("_from"), _moved(end, *(ahead or (0, None)), 1).alias("_to")
    )
    return _days(ends, fields)


def dynamic_calendar(
    df: DataFrame,
    from_column: str | None = None,
    to_column: str | None = None,
    from_date: str | None = None,
    to_date: str | None = None,
    back: tuple[int, str] | None = None,
    ahead: tuple[int, str] | None = None,
    fields: Iterable[str] = FIELDS,
) -> DataFrame:
    """A calendar between the least ``from_column`` and the greatest ``to_column`` of a table (or fixed ends, or today)."""
    require(df, [n for n in (from_column, to_column) if n])

    def end(fixed: str | None, column: str | None, pick) -> Column:
        if fixed:
            return F.max(F.to_date(F.lit(fixed)))
        return pick(c(column)).cast("date") if column else F.max(F.current_date())

    ends = df.agg(end(from_date, from_column, F.min).alias("_a"), end(to_date, to_column, F.max).alias("_b"))
    ends = ends.select(
        _moved(F.col("_a"), *(back or (0, None)), -1).alias("_from"), _moved(F.col("_b"), *(ahead or (0, None)), 1).alias("_to")
    )
    return _days(ends, fields)
