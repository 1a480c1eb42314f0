"""Pivot, unpivot, and splitting text to columns or rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep._columns import NUMERIC, c, require


def pivot(
    df: DataFrame,
    index: str | Iterable[str],
    columns: str | Iterable[str],
    values: str | Iterable[str],
    function: str = "none",
    fill=None,
    drop_all_null: bool = True,
    pivot_values: list | None = None,
) -> DataFrame:
    """Turn the values of ``columns`` into columns.

    ``function``: none (a second row for one cell is an error), sum, mean, min, max. Several pivot columns are joined
    with ``_``; with several value columns the result is named ``<value>_<pivot>``. ``pivot_values`` names the wanted
    values; otherwise one aggregate lists them. ``fill`` replaces nulls (0 by default when aggregating).
    ``drop_all_null`` leaves out rows and columns of mean, min and max that have no value at all.
    """
    index, columns, values = require(df, index), require(df, columns), require(df, values)
    if not (index and columns and values):
        raise ValueError("pivot needs index, columns and values")
    functions = {"none": F.first, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    if function not in functions:
        raise ValueError(f"pivot function must be one of {sorted(functions)}")
    key = c(columns[0]) if len(columns) == 1 else F.concat_ws("_", *[c(n).cast("string") for n in columns])
    rows = df.select(*[c(n) for n in index], key.alias("_pivot"), *[c(v).alias(f"_v{i}") for i, v in enumerate(values)])
    rows = rows.where(F.col("_pivot").isNotNull())
    numbers = range(len(values))
    drop = drop_all_null and function in ("mean", "min", "max")
    if drop:
        rows = rows.where(F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), True) for i in numbers], F.lit(False)))
    if function == "none":
        cells = rows.groupBy(*[c(n) for n in index], "_pivot").agg(F.count(F.lit(1)).alias("_n"))
        if not cells.where(F.col("_n") > 1).limit(1).isEmpty():
            raise ValueError("pivot without a function: some index and column values occur more than once")
    empty: set[tuple[str, int]] = set()
    if pivot_values is None or drop:
        found = _pivot_counts(rows, pivot_values, len(values))
        pivot_values = [r["_pivot"] for r in found] if pivot_values is None else pivot_values
        if drop:
            filled = {(r["_pivot"], i) for r in found for i in numbers if r[f"_n{i}"]}
            empty = {(v, i) for v in pivot_values for i in numbers} - filled
    # The aliases make unique names, whatever the values look like; with one aggregate Spark leaves its alias out.
    aggregates = [functions[function](f"_v{i}").alias(f"_v{i}") for i in numbers]
    table = rows.groupBy(*[c(n) for n in index]).pivot("_pivot", pivot_values).agg(*aggregates)
    made = [(v, i) for v in pivot_values for i in numbers]
    kept = [c(n) for n in index]
    fill = 0 if fill is None and function != "none" else fill
    for (value, i), spark_name in zip(made, table.columns[len(index):]):
        if (value, i) in empty:
            continue
        cell = c(spark_name)
        if fill is not None:
            cell = F.coalesce(cell, F.lit(fill).cast(table.schema[spark_name].dataType))
        text = "true" if value is True else "false" if value is False else str(value)
        kept.append(cell.alias(text if len(values) == 1 else f"{values[i]}_{text}"))
    return table.select(*kept)


def _pivot_counts(rows: DataFrame, pivot_values: list | None, n_values: int) -> list:
    """The pivot values in order, with the number of values in each value column; they become columns, so they are few."""
    counts = rows.groupBy("_pivot").agg(*[F.count(f"_v{i}").alias(f"_n{i}") for i in range(n_values)])
    if pivot_values is not None:
        return counts.where(F.col("_pivot").isin(pivot_values)).collect()
    most = int(rows.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = counts.orderBy("_pivot").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"the pivot columns have more than {most} values; raise spark.sql.pivotMaxValues or name them")
    return found


def unpivot(
    df: DataFrame,
    id_columns: Iterable[str] | None = None,
    value_columns: Iterable[str] | None = None,
    variable_name: str = "Column",
    value_name: str = "Value",
    value_type: str = "none",
) -> DataFrame:
    """Columns to rows: one row per id row and value column, null values kept.

    ``value_type``: none (columns of different types become text), string (null becomes "None") or numeric (what is
    no number becomes null).
    """
    ids = require(df, id_columns)
    names = require(df, value_columns) or [n for n in df.columns if n not in ids]
    if not names:
        raise ValueError("unpivot needs at least one value column")
    if value_type not in ("none", "string", "numeric"):
        raise ValueError("value_type must be 'none', 'string' or 'numeric'")
    types = {df.schema[n].dataType for n in names}
    cells = {n: c(n) for n in names}
    if value_type == "string":
        cells = {n: F.coalesce(c(n).cast("string"), F.lit("None")) for n in names}
    elif value_type == "numeric":
        cells = {n: c(n).cast("string").try_cast("double") for n in names}
        for n in names:
            if isinstance(df.schema[n].dataType, NUMERIC):
                cells[n] = c(n).cast("double")
    elif len(types) > 1 and all(isinstance(t, NUMERIC) for t in types):
        cells = {n: c(n).cast("double") for n in names}
    elif len(types) > 1:
        cells = {n: c(n).cast("string") for n in names}
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), cell.alias("v")) for n, cell in cells.items()])
    long = df.select(*[c(n) for n in ids], F.explode(pairs).alias("_kv"))
    return long.select(*[c(n) for n in ids], F.col("_kv.k").alias(variable_name), F.col("_kv.v").alias(value_name))


def _pattern(delimiter: str, regex: bool) -> str:
    if not delimiter:
        raise ValueError("a delimiter is required")
    # \Q..\E takes the delimiter literally.
    return delimiter if regex else "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split_to_columns(
    df: DataFrame, column: str, delimiter: str, n: int | None = None, regex: bool = False, keep_original: bool = False
) -> DataFrame:
    """Split text into ``<column>_0``, ``<column>_1``... Without ``n`` one aggregate finds the greatest number of parts."""
    require(df, [column])
    parts = F.split(c(column).cast("string"), _pattern(delimiter, regex))
    if not n:
        n = df.agg(F.max(F.size(parts))).first()[0] or 0
        n = max(n, 0)
    # get() gives null beyond the end, where [] would raise.
    wide = df.select("*", *[F.get(parts, F.lit(i)).alias(f"{column}_{i}") for i in range(n)])
    return wide if keep_original else wide.drop(column)


def split_to_rows(
    df: DataFrame,
    column: str,
    delimiter: str,
    new_column: str | None = None,
    regex: bool = False,
    keep_original: bool = False,
    result_type: str = "none",
) -> DataFrame:
    """Split text into one row per part; a null stays one row. ``result_type``: none, string, auto (numbers if all are)."""
    require(df, [column])
    if result_type not in ("none", "string", "auto"):
        raise ValueError("result_type must be 'none', 'string' or 'auto'")
    new_column = new_column or column
    parts = F.explode_outer(F.split(c(column).cast("string"), _pattern(delimiter, regex)))
    others = [n for n in df.columns if n != new_column and (keep_original or n != column)]
    long = df.select(*[c(n) for n in others], parts.alias(new_column))
    if result_type == "auto":
        bad = c(new_column).isNotNull() & F.trim(c(new_column)).try_cast("double").isNull()
        if long.where(bad).limit(1).isEmpty():
            long = long.withColumn(new_column, F.trim(c(new_column)).cast("double"))
    return long
