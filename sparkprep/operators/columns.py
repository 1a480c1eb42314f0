"""Column shaping: select, rename, reorder, concatenate, formulas."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import NUMERIC, as_list, c, quoted, require


def select_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Keep ``columns``, in that order."""
    names = require(df, columns)
    if not names:
        raise ValueError("select_columns needs at least one column")
    return df.select(*[c(n) for n in names])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by an old -> new mapping."""
    require(df, mapping)
    return _renamed(df, [mapping.get(n, n) for n in df.columns])


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"renaming gives the same name more than once: {doubled}")
    return df.toDF(*names)


def rename_dynamic(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    case: str = "none",
    special_chars: str = "none",
    replace_char: str = "_",
    strip_prefix: str = "",
    add_prefix: str = "",
    strip_suffix: str = "",
    add_suffix: str = "",
) -> DataFrame:
    """Rename by rule, in this order: case, special characters, prefix off / on, suffix off / on.

    ``case``: none, lower, upper, camel_lower, camel_upper, snake. ``special_chars``: none, replace.
    """
    cases = {
        "none": lambda s: s,
        "lower": str.lower,
        "upper": str.upper,
        "camel_lower": _camel,
        "camel_upper": lambda s: _camel(s)[:1].upper() + _camel(s)[1:],
        "snake": lambda s: "_".join(_alphanumeric_runs(s)).lower(),
    }
    if case not in cases:
        raise ValueError(f"case must be one of {sorted(cases)}, not {case!r}")
    if special_chars not in ("none", "replace"):
        raise ValueError("special_chars must be 'none' or 'replace'")
    chosen = set(df.columns if columns is None else require(df, columns))

    def new_name(name: str) -> str:
        name = cases[case](name)
        if special_chars == "replace" and case != "snake":
            name = re.sub("[^0-9a-zA-Z]+", lambda _: replace_char, name)
        name = add_prefix + name.removeprefix(strip_prefix)
        return name.removesuffix(strip_suffix) + add_suffix

    return _renamed(df, [new_name(n) if n in chosen else n for n in df.columns])


def _alphanumeric_runs(name: str) -> list[str]:
    return re.findall("[0-9A-Za-z]+", name)


def _camel(name: str) -> str:
    """Runs of letters and digits put together; every run but the first begins with a capital. Other names stay."""
    joined = ""
    for run in map(str.lower, _alphanumeric_runs(name)):
        joined += run if not joined else run[0].upper() + run[1:]
    return joined or name


def rename(df: DataFrame, mode: str = "manual", **options) -> DataFrame:
    """``mode='manual'`` takes ``mapping``; ``mode='dynamic'`` takes the options of rename_dynamic."""
    if mode == "manual":
        return rename_columns(df, **options)
    if mode == "dynamic":
        return rename_dynamic(df, **options)
    raise ValueError(f"rename mode must be 'manual' or 'dynamic', not {mode!r}")


_FAMILIES = [
    (T.BooleanType,),
    NUMERIC,
    (T.DateType, T.TimestampType, T.TimestampNTZType),
    (T.DayTimeIntervalType, T.YearMonthIntervalType),
    (),  # categories are strings in Spark; the place is kept so that the order of families reads as documented
    (T.StringType,),
]


def _family(data_type: T.DataType) -> int:
    return next((i for i, types in enumerate(_FAMILIES) if isinstance(data_type, types)), len(_FAMILIES))


def position_columns(df: DataFrame, rules: Iterable[str]) -> DataFrame:
    """Reorder columns by rules applied one after the other (each sort keeps ties in place).

    Rules: by_name, by_name_natural, by_type, by_type_family (boolean, numeric, date and time, interval, string, other),
    reverse_position.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def natural(name: str):
        return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.split(r"(\d+)", name) if p]

    keys = {
        "by_name": lambda n: n,
        "by_name_natural": natural,
        "by_type": lambda n: types[n].simpleString(),
        "by_type_family": lambda n: _family(types[n]),
    }
    names = list(df.columns)
    for rule in as_list(rules):
        if rule == "reverse_position":
            names.reverse()
        elif rule in keys:
            names.sort(key=keys[rule])
        else:
            raise ValueError(f"unknown position rule {rule!r}")
    return df.select(*[c(n) for n in names])


def concat_columns(
    df: DataFrame,
    columns: Iterable[str],
    new_column: str,
    separator: str | list[str] | None = None,
    ascii_codes: list[int] | None = None,
) -> DataFrame:
    """Join the texts of ``columns`` (null counts as '') with a separator given as text parts or ASCII codes 0-127."""
    names = require(df, columns)
    if not names:
        raise ValueError("concat_columns needs at least one column")
    if ascii_codes:
        wrong = [code for code in ascii_codes if not 0 <= code <= 127]
        if wrong:
            raise ValueError(f"not ASCII codes (0 to 127): {wrong}")
        joiner = "".join(chr(code) for code in ascii_codes)
    elif separator:
        joiner = "".join(as_list(separator))
    else:
        raise ValueError("concat_columns needs a separator or ascii_codes")
    # concat_ws leaves nulls out together with their separator, so they are made '' first.
    texts = [F.coalesce(c(n).cast("string"), F.lit("")) for n in names]
    return df.withColumn(new_column, F.concat_ws(joiner, *texts))


def formula(df: DataFrame, formulas: Iterable[tuple[str | list[str], str | Column | Callable]]) -> DataFrame:
    """Set columns from formulas, one after the other.

    One column: the formula sees the row - SQL text or a Column. Several columns: the formula is applied to each of
    them, with ``$value`` standing for the cell - SQL text, or a function Column -> Column (also made by pandas_udf).
    """
    for targets, rule in formulas:
        targets = as_list(targets)
        if len(targets) == 1 and not (isinstance(rule, str) and "$value" in rule):
            value = F.expr(rule) if isinstance(rule, str) else rule(c(targets[0])) if callable(rule) else rule
            df = df.withColumn(targets[0], value)
            continue
        require(df, targets)
        if isinstance(rule, str):
            cells = {t: F.expr(rule.replace("$value", quoted(t))) for t in targets}
        else:
            cells = {t: rule(c(t)) for t in targets}
        df = df.withColumns(cells)
    return df
