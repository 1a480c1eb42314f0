"""Type conversion and conversion between text and dates."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import c, require
from sparkprep.functions.patterns import DATE_FORMATS, locale_tag, skips_weekday, spark_pattern

_MODES = ("raise", "warn_keep", "warn_coerce", "keep", "coerce")
_TEXT = ("str", "string", "object", "category")
_SIGNED = {"8": "tinyint", "16": "smallint", "32": "int", "64": "bigint"}
_UNSIGNED = {"8": "smallint", "16": "int", "32": "bigint", "64": "decimal(20,0)"}


def _converted(df: DataFrame, column: str, target: str) -> Column:
    """The value in the target type, or null where it cannot be converted."""
    cell, is_text = c(column), isinstance(df.schema[column].dataType, T.StringType)
    name = target.replace("[pyarrow]", "")
    whole = re.fullmatch(r"(u?)int(8|16|32|64)", name.lower())
    if whole:
        unsigned, bits = whole.groups()
        kind = (_UNSIGNED if unsigned else _SIGNED)[bits]
        strict = name != name.lower() or target != name  # the nullable types do not cut off a fraction
        # Spark cuts a fraction off when it casts a number, and refuses one in a text.
        exact = cell.try_cast("decimal(38,18)") if is_text else cell
        value = exact.try_cast(kind)
        if is_text:
            value = F.coalesce(cell.try_cast(kind), value, cell.try_cast("double").try_cast(kind))
        if strict:
            number = cell.try_cast("double")
            value = F.when(number == F.floor(number), value)
        if unsigned:
            top = 2 ** int(bits) - 1
            value = F.when((value >= 0) & (value <= F.lit(str(top)).cast("decimal(20,0)")), value)
        return value
    if name in ("numeric", "float64", "Float64", "double"):
        return cell.try_cast("double")
    if name in ("float16", "float32", "Float32", "float"):
        return cell.try_cast("float")
    if name in _TEXT:
        return cell.try_cast("string")
    if name in ("bool", "boolean"):
        return cell.try_cast("boolean")
    if name == "date":
        return cell.try_cast("date")
    time = re.fullmatch(r"(?:datetime|datetime(?:64|32)\[(ns|us|ms|s)\]|pa\.timestamp\[(ns|us|ms|s)\])", name)
    if time:
        unit = {"ms": "millisecond", "s": "second"}.get(time.group(1) or time.group(2))
        value = cell.try_cast("timestamp_ntz")
        return F.date_trunc(unit, value).cast("timestamp_ntz") if unit else value
    if name == "timedelta[ns]":
        return cell.try_cast("interval day to second")
    raise ValueError(f"unknown target type {target!r}")


def convert_types(
    df: DataFrame,
    columns: Iterable[str],
    target: str,
    on_fail: str = "warn_keep",
    keep_original: bool = False,
    prefix: str = "",
    suffix: str = "",
) -> DataFrame:
    """Convert columns to a type named as in data frames (int64, UInt8, float32, string, date, datetime64[ms], bool...).

    ``on_fail``: raise; keep (the whole column stays as it was); coerce (what does not convert becomes null); warn_keep
    and warn_coerce also warn. ``keep_original`` writes to ``<prefix><column><suffix>``. raise and coerce need no pass
    over the data; keep and the warnings count the failures of all columns in one aggregate.
    """
    names, on_fail = require(df, columns), on_fail.lower()
    if on_fail not in _MODES:
        raise ValueError(f"on_fail must be one of {_MODES}, not {on_fail!r}")
    values = {n: _converted(df, n, target) for n in names}
    failed = {n: c(n).isNotNull() & v.isNull() for n, v in values.items()}
    kept = set()
    if on_fail not in ("raise", "coerce") and names:
        counts = df.agg(*[F.count_if(failed[n]).alias(f"_{i}") for i, n in enumerate(names)]).first()
        bad = {n: counts[i] for i, n in enumerate(names) if counts[i]}
        if on_fail.startswith("warn") and bad:
            warnings.warn(f"values that do not convert to {target}, per column: {bad}", RuntimeWarning, stacklevel=2)
        kept = set(bad) if on_fail.endswith("keep") else set()
    out = {}
    for n in names:
        value = c(n) if n in kept else values[n]
        if on_fail == "raise":
            message = F.concat(F.lit(f"column {n!r} does not convert to {target}: "), c(n).cast("string"))
            value = F.when(failed[n], F.raise_error(message)).otherwise(value)
        out[f"{prefix}{n}{suffix}" if keep_original else n] = value
    return df.withColumns(out) if out else df


def text_to_datetime(
    df: DataFrame,
    column: str,
    fmt: str = "auto",
    new_column: str | None = None,
    locale: str | None = None,
    on_error: str = "raise",
) -> DataFrame:
    """Read text as a timestamp by a strptime format, or by the first of the known formats that fits (``auto``).

    ``locale`` such as fr_FR is the language of month names. ``on_error``: raise or null.
    """
    require(df, [column])
    if on_error not in ("raise", "null"):
        raise ValueError("on_error must be 'raise' or 'null'")
    text = c(column).cast("string")
    if fmt == "auto":
        # The standard notation first, with or without time; then the listed formats in their order.
        tries = [text.try_cast("timestamp_ntz"), *[_read(text, f, locale) for f in DATE_FORMATS]]
        value = F.coalesce(*tries)
    else:
        value = _read(text, fmt, locale)
    if on_error == "raise":
        message = F.concat(F.lit(f"column {column!r} is not a date of format {fmt}: "), text)
        value = F.when(text.isNotNull() & value.isNull(), F.raise_error(message)).otherwise(value)
    return df.withColumn(new_column or column, value)


def _read(text: Column, fmt: str, locale: str | None) -> Column:
    if skips_weekday(fmt):
        # Without the weekday the text must not fit another format by accident, so it has to be there.
        text = F.when(text.rlike(r"^\p{L}+\.?,? "), F.regexp_replace(text, r"^\p{L}+\.?,? +", ""))
    pattern, tag = spark_pattern(fmt, reading=True), locale_tag(locale)
    if tag is None:
        return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
    # Only the CSV functions of Spark know languages; a separator that no text holds makes it a one-column record.
    options = {"timestampFormat": pattern, "locale": tag, "sep": "\u0001", "mode": "PERMISSIVE"}
    return F.from_csv(text, "v timestamp", options)["v"].cast("timestamp_ntz")


def datetime_to_text(
    df: DataFrame, column: str, fmt: str, new_column: str | None = None, locale: str | None = None
) -> DataFrame:
    """Write a date or timestamp as text by a strptime format; ``locale`` is the language of names."""
    require(df, [column])
    pattern, tag = spark_pattern(fmt, reading=False), locale_tag(locale)
    if tag is None:
        return df.withColumn(new_column or column, F.date_format(c(column), pattern))
    options = {"timestampFormat": pattern, "locale": tag, "sep": "\u0001", "quote": "\u0002", "escape": "\u0002"}
    text = F.when(c(column).isNotNull(), F.to_csv(F.struct(c(column).cast("timestamp").alias("v")), options))
    return df.withColumn(new_column or column, text)
