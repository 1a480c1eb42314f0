"""Group-by aggregation, chart tables, JSON payloads and Markdown tables per group."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import as_list, c, order_columns, require
from sparkprep.operators.ordering import exact_quantiles

FUNCTIONS = ("min", "max", "sum", "mean", "count", "nunique", "first", "last", "median", "std", "var", "prod")


def aggregate(
    df: DataFrame,
    by: Iterable[str] | None,
    operations: Iterable[tuple[str, str]],
    order_by=None,
    keep_null_keys: bool = False,
    names: Iterable[str] | None = None,
) -> DataFrame:
    """Group by 0..n columns and aggregate (column, function) pairs; results are named ``<column>_<function>``.

    Rows with a null key are left out unless ``keep_null_keys``. Nulls are ignored; the sum of nothing is 0 and the
    product 1. first / last are the first and last values that are not null in ``order_by``. Everything except the
    median is one partial-then-final aggregate; the median is exact (see ordering.exact_quantiles).
    """
    by = require(df, by)
    operations = list(operations)
    require(df, [col for col, _ in operations])
    wrong = [f for _, f in operations if f not in FUNCTIONS]
    if wrong or not operations:
        raise ValueError(f"aggregate needs (column, function) pairs with functions of {FUNCTIONS}; wrong: {wrong}")
    outputs = list(names) if names else [re.sub("[^a-zA-Z0-9_]", "_", f"{col}_{f}") for col, f in operations]
    doubled = {n for n in outputs + by if (outputs + by).count(n) > 1}
    if doubled:
        raise ValueError(f"output names occur twice: {sorted(doubled)}")
    if by and not keep_null_keys:
        df = df.where(reduce(Column.__and__, [c(b).isNotNull() for b in by]))
    order = require(df, order_by, "order_by column")
    plain = [(o, col, f) for o, (col, f) in zip(outputs, operations) if f != "median"]
    medians = [(o, col) for o, (col, f) in zip(outputs, operations) if f == "median"]
    exprs = [_expression(col, f, order).alias(o) for o, col, f in plain]
    keys = [c(b) for b in by]
    if not medians:
        return df.groupBy(*keys).agg(*exprs)
    exprs = exprs or [F.count(F.lit(1)).alias("_rows")]
    base = df.groupBy(*keys).agg(*exprs)
    columns = list(dict.fromkeys(col for _, col in medians))
    found = exact_quantiles(df, by, columns, [0.5])
    middle = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("field") == col, F.col("quantiles")[0])).alias(f"_median{i}") for i, col in enumerate(columns)]
    )
    middle = middle.toDF(*[f"_k{i}" for i in range(len(by))], *middle.columns[len(by):])
    if by:
        on = reduce(Column.__and__, [c(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)])
        joined = base.join(middle, on, "left")
    else:
        joined = base.crossJoin(F.broadcast(middle))  # one row each
    values = {o: F.col(f"_median{columns.index(col)}").alias(o) for o, col in medians}
    return joined.select(*keys, *[values.get(o, c(o)) for o in outputs])


def _expression(column: str, function: str, order: list[str]) -> Column:
    cell = c(column)
    if function == "sum":
        return F.coalesce(F.sum(cell), F.lit(0))
    if function == "prod":
        return F.coalesce(F.product(cell), F.lit(1.0))
    if function in ("first", "last"):
        if not order:
            raise ValueError(f"{function} depends on row order: order_by is required")
        # Nulls in the order columns come last, as in every sort here; the value itself settles ties.
        place = F.struct(*[part for k in order for part in (c(k).isNull(), c(k))], cell)
        return (F.min_by if function == "first" else F.max_by)(cell, F.when(cell.isNotNull(), place))
    simple = {
        "min": F.min, "max": F.max, "mean": F.avg, "count": F.count, "nunique": F.count_distinct,
        "std": F.stddev_samp, "var": F.var_samp,
    }
    return simple[function](cell)


def chart_table(
    df: DataFrame,
    by: str | Iterable[str] | None = None,
    aggregations: dict[str, str | list[str]] | None = None,
    color: tuple[str, str | None] | None = None,
    sort: tuple[str, str | None] | None = None,
    descending: bool = False,
    order_by=None,
) -> DataFrame:
    """The table behind a chart: group by ``by`` with columns named ``<Function> of <column>``; null groups are kept.

    ``color`` and ``sort`` are (column, function or None): with a function they join the aggregations, a colour column
    without one joins the groups. The result is sorted by the sort column. first and last need
    ``order_by``. No aggregation at all returns the input.
    """
    keys = require(df, by)
    wanted: list[tuple[str, str]] = []

    def want(column: str, function: str) -> str:
        if (column, function) not in wanted:
            wanted.append((column, function))
        return f"{function.capitalize()} of {column}"

    for column, functions in (aggregations or {}).items():
        for function in as_list(functions):
            want(column, function)
    sort_column = None
    if sort:
        sort_column = want(*sort) if sort[1] else sort[0]
    if color:
        if color[1]:
            want(*color)
        elif color[0] not in keys:
            keys = keys + require(df, [color[0]])
    if not wanted:
        return df
    names = [f"{f.capitalize()} of {column}" for column, f in wanted]
    table = aggregate(df, keys, wanted, order_by=order_by, keep_null_keys=True, names=names)
    if sort_column is None:
        return table
    require(table, [sort_column], "sort column")
    return table.orderBy(*order_columns(table, [(sort_column, "desc" if descending else "asc")]))


def _listed(df: DataFrame, by: list[str], row: Column, order_by) -> tuple[DataFrame, Column]:
    """Collect ``row`` per group, in order. The list becomes one cell of the result, so it must fit in a cell."""
    order = require(df, order_by, "order_by column")
    if not order:
        raise ValueError("the rows inside a cell have an order: order_by is required")
    place = [part.alias(f"k{i}") for i, part in enumerate(p for k in order for p in (c(k).isNull(), c(k)))]
    rows = F.array_sort(F.collect_list(F.struct(*place, row.alias("row"))))
    return df.groupBy(*[c(b) for b in by]).agg(rows.alias("_rows")), F.transform(F.col("_rows"), lambda r: r["row"])


def create_json(
    df: DataFrame,
    columns: Iterable[str],
    by: Iterable[str] | None = None,
    order_by=None,
    name: str = "json_payload",
    object_when_single: bool = False,
) -> DataFrame:
    """One JSON array per key group (or one for the whole table) of the chosen columns, nulls written as null.

    Each row is turned into text before the shuffle. ``object_when_single``: a group of one row becomes an object.
    """
    columns, by = require(df, columns), require(df, by)
    if not columns:
        raise ValueError("create_json needs at least one column")
    row = F.to_json(F.struct(*[c(n) for n in columns]), {"ignoreNullFields": "false"})
    grouped, rows = _listed(df, by, row, order_by or columns)
    text = F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]"))
    if object_when_single:
        text = F.when(F.size(rows) == 1, rows[0]).otherwise(text)
    return grouped.select(*[c(b) for b in by], text.alias(name))


def markdown_table(
    df: DataFrame,
    columns: Iterable[str],
    by: Iterable[str] | None = None,
    order_by=None,
    name: str = "markdown_table",
    round_digits: int | None = None,
) -> DataFrame:
    """One Markdown pipe table of the chosen columns per group (or one for the whole table)."""
    columns, by = require(df, columns), require(df, by)
    if not columns:
        raise ValueError("markdown_table needs at least one column")
    cells = []
    for n in columns:
        cell = c(n)
        if round_digits is not None and isinstance(df.schema[n].dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            cell = F.round(cell, round_digits)
        cells.append(F.coalesce(cell.cast("string"), F.lit("")))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    grouped, rows = _listed(df, by, row, order_by or columns)
    head = "| " + " | ".join(columns) + " |\n|" + "|".join("---" for _ in columns) + "|"
    text = F.array_join(F.concat(F.array(F.lit(head)), rows), "\n")
    return grouped.select(*[c(b) for b in by], text.alias(name))
