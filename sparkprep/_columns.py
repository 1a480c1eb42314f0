"""Column-name helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def as_list(value) -> list:
    """None -> [], a single value -> [value], any other iterable -> list."""
    if value is None:
        return []
    if isinstance(value, (str, Column)):
        return [value]
    return list(value)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or spaces."""
    return F.col(quoted(name))


def require(df: DataFrame, names: Iterable[str], what: str = "column") -> list[str]:
    names = as_list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} not in the table: {missing}; it has {df.columns}")
    return names


def free_name(base: str, taken: Iterable[str]) -> str:
    """``base``, or ``base1``, ``base2``... when it is taken."""
    taken = set(taken)
    if base not in taken:
        return base
    i = 1
    while f"{base}{i}" in taken:
        i += 1
    return f"{base}{i}"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def order_columns(df: DataFrame, order_by, flip: bool = False) -> list[Column]:
    """Sort keys from names, ``(name, "asc"|"desc")`` pairs or ready Columns. Nulls go last; ``flip`` is the reverse."""
    keys = []
    for item in as_list(order_by):
        if isinstance(item, Column):
            if flip:
                raise ValueError("a Column cannot be reversed: give order_by as names or (name, direction) pairs")
            keys.append(item)
            continue
        name, direction = (item, "asc") if isinstance(item, str) else item
        require(df, [name], "order_by column")
        if direction not in ("asc", "desc"):
            raise ValueError(f"sort direction of {name!r} must be 'asc' or 'desc', not {direction!r}")
        if flip:
            keys.append(c(name).desc_nulls_first() if direction == "asc" else c(name).asc_nulls_first())
        else:
            keys.append(c(name).asc_nulls_last() if direction == "asc" else c(name).desc_nulls_last())
    if not keys:
        raise ValueError("this operator depends on row order: order_by is required")
    return keys


def same_row(left: Iterable[Column], right: Iterable[Column]) -> Column:
    """Null-safe equality of two lists of columns."""
    test = None
    for a, b in zip(left, right):
        test = a.eqNullSafe(b) if test is None else test & a.eqNullSafe(b)
    return F.lit(True) if test is None else test
