"""Row operators: filter, switch, sort, row id, deduplicate, sample, concatenate."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import c, free_name, order_columns, require
from sparkprep.operators.ordering import number_rows, row_hash

# Spark limits groups on the map side (before the shuffle) up to this rank: spark.sql.optimizer.windowGroupLimitThreshold
_GROUP_LIMIT = 1000
# A top-n of this size is merged by one task from n rows of each partition.
_TOP_ROWS = 1000


def condition(df: DataFrame, column: str, op: str, value=None, as_text: bool = False) -> Column:
    """The predicate of the basic filter. ``contains`` takes a regular expression, and no row matches it on null."""
    require(df, [column])
    cell = c(column)
    is_text = isinstance(df.schema[column].dataType, T.StringType)
    compare = {
        "==": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__,
        "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__,
    }
    if op in compare:
        if as_text or is_text:
            return compare[op](cell.cast("string"), F.lit(str(value)))
        return compare[op](cell, F.lit(value))
    if op in ("contains", "not contains", "startswith", "endswith"):
        if not (is_text or as_text):
            raise ValueError(f"{op} needs a text column; {column!r} is {df.schema[column].dataType.simpleString()}")
        text = cell.cast("string")
        if op == "startswith":
            return F.coalesce(text.startswith(str(value)), F.lit(False))
        if op == "endswith":
            return F.coalesce(text.endswith(str(value)), F.lit(False))
        found = F.coalesce(text.rlike(str(value)), F.lit(False))
        return found if op == "contains" else ~found
    if op == "notnull":
        return cell.isNotNull()
    if op == "isnull":
        return cell.isNull()
    if op == "notempty":
        return cell.cast("string") != ""
    if op == "isempty":
        return cell.cast("string") == ""
    raise ValueError(f"unknown filter condition {op!r}")


def filter_rows(df: DataFrame, column: str = None, op: str = None, value=None, as_text=False, expr=None) -> DataFrame:
    """Rows meeting a basic condition (column, op, value) or a free SQL expression ``expr``."""
    if expr is not None:
        return df.where(expr if isinstance(expr, Column) else F.expr(expr))
    return df.where(condition(df, column, op, value, as_text))


def switch_rows(df: DataFrame, column: str = None, op: str = None, value=None, as_text=False, expr=None):
    """(rows that meet the condition, all other rows - nulls too). Without a condition everything is in the second."""
    if expr is not None:
        test = expr if isinstance(expr, Column) else F.expr(expr)
    elif column:
        test = condition(df, column, op, value, as_text)
    else:
        test = F.lit(False)
    test = F.coalesce(test, F.lit(False))
    return df.where(test), df.where(~test)


def sort_rows(df: DataFrame, order_by, limit: int | None = None) -> DataFrame:
    """Sort by several columns, each up or down, nulls last either way; ``limit`` makes it a top-k."""
    ordered = df.orderBy(*order_columns(df, order_by))
    return ordered if limit is None else ordered.limit(limit)


def row_id(
    df: DataFrame, order_by, name: str = "ID", start: int = 1, type: str = "int64", position: str = "last"
) -> DataFrame:
    """Number the rows from ``start`` in the order of ``order_by``, as int64 or float64, as first or last column."""
    if type not in ("int64", "float64"):
        raise ValueError("row_id type must be 'int64' or 'float64'")
    if position not in ("first", "last"):
        raise ValueError("row_id position must be 'first' or 'last'")
    others = [n for n in df.columns if n != name]
    at = free_name("_position", df.columns)
    numbered = number_rows(df, order_columns(df, order_by), at)
    ids = (c(at) + F.lit(start - 1)).cast("bigint" if type == "int64" else "double").alias(name)
    rest = [c(n) for n in others]
    return numbered.select(ids, *rest) if position == "first" else numbered.select(*rest, ids)


def deduplicate(df: DataFrame, subset: Iterable[str] | None = None, keep: str | bool = "first", order_by=None) -> DataFrame:
    """One row per value of ``subset`` (default: all columns): the first or last in ``order_by``, or none of several.

    Without ``order_by`` which row is kept does not matter to the caller. First/last cut each group to one row before
    the shuffle, and keep='none' is one aggregate, so a hot key moves one row per task.
    """
    keys = require(df, subset) or df.columns
    keep = "none" if keep in (False, "False", "none") else keep
    if keep == "none":
        times, kept = free_name("_times", df.columns), free_name("_row", df.columns)
        rest = [n for n in df.columns if n not in keys]
        row = F.first(F.struct(*[c(n) for n in rest] or [F.lit(0)])).alias(kept)
        single = df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias(times), row).where(c(times) == 1)
        return single.select(*[c(n) if n in keys else c(kept)[n].alias(n) for n in df.columns])
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first', 'last' or 'none'")
    if set(keys) == set(df.columns):
        return df.dropDuplicates(keys)
    if order_by is None:
        if keep == "last":
            raise ValueError("keep='last' needs order_by: rows have no order of their own")
        return df.dropDuplicates(keys)
    return _first_of_group(df, keys, [*order_columns(df, order_by, flip=keep == "last"), row_hash(df)], 1)


def _first_of_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rank = free_name("_rank", df.columns)
    within = Window.partitionBy(*[c(k) for k in keys]).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(within)).where(c(rank) <= n).drop(rank)


def sample_rows(
    df: DataFrame,
    n: int | None = None,
    percent: float | None = None,
    mode: str = "random",
    by: Iterable[str] | None = None,
    order_by=None,
    seed: int = 42,
) -> DataFrame:
    """A fixed number or a percentage (rounded down) of rows, of the table or of each group: random, first or last.

    ``random`` orders rows by a seeded hash, so a seed always gives the same rows; first and last need ``order_by``.
    """
    if (n is None) == (percent is None):
        raise ValueError("sample_rows needs either n or percent")
    if n is not None and n < 0:
        raise ValueError("n must be >= 0")
    if percent is not None and not 0 <= percent <= 100:
        raise ValueError("percent must be between 0 and 100")
    if mode not in ("random", "first", "last"):
        raise ValueError("mode must be 'random', 'first' or 'last'")
    by = require(df, by)
    if mode == "random":
        ranked = df.withColumn("_hash", row_hash(df, seed))
        order = [F.col("_hash").asc()]
    else:
        ranked, order = df, order_columns(df, order_by, flip=mode == "last")
    if not by:
        if percent is not None:
            n = int(df.count() * (percent / 100))
        if mode == "random":
            return _smallest_hashes(ranked, n).drop("_hash")
        if n <= _TOP_ROWS:
            return ranked.orderBy(*order, row_hash(df)).limit(n)
        return number_rows(ranked, order, "_position").where(F.col("_position") <= n).drop("_position")
    if n is not None and n <= _GROUP_LIMIT:
        return _first_of_group(ranked, by, [*order, row_hash(df)], n).drop("_hash")
    numbered = number_rows(ranked, order, "_position", by=by)
    if n is not None:
        return numbered.where(F.col("_position") <= n).drop("_position", "_hash")
    sizes = df.groupBy(*[c(b).alias(f"_by{i}") for i, b in enumerate(by)]).agg(F.count(F.lit(1)).alias("_size"))
    on = reduce(Column.__and__, [c(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)])
    share = (F.col("_size") * F.lit(percent / 100)).cast("bigint")
    return numbered.join(sizes, on).where(F.col("_position") <= share).select(*[c(x) for x in df.columns])


def _smallest_hashes(df: DataFrame, n: int) -> DataFrame:
    """The n rows with the smallest ``_hash``.

    The rows are counted by the top 16 bits of the hash (65,536 counts at most). All rows below the bucket that holds
    the n-th are taken by a filter; only that one bucket has to be put in order.
    """
    if n <= 0:
        return df.limit(0)
    bucket = F.shiftright("_hash", 48)
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = counts.withColumn("_through", F.sum("_n").over(so_far)).where(F.col("_through") >= n).orderBy("_bucket").first()
    if edge is None:
        return df
    inside = df.where(bucket < edge["_bucket"])
    at_edge = df.where(bucket == edge["_bucket"])
    missing = n - (edge["_through"] - edge["_n"])
    if missing == edge["_n"]:
        return df.where(bucket <= edge["_bucket"])
    if missing <= _TOP_ROWS:
        return inside.unionByName(at_edge.orderBy("_hash").limit(missing))
    chosen = number_rows(at_edge, [F.col("_hash").asc()], "_position").where(F.col("_position") <= missing)
    return inside.unionByName(chosen.drop("_position"))


def concat_rows(*frames: DataFrame, sort: bool = False) -> DataFrame:
    """Stack tables; columns are matched by name, absent ones become null. ``sort`` orders the columns by name."""
    if not frames:
        raise ValueError("concat_rows needs at least one table")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.select(*[c(n) for n in sorted(stacked.columns)]) if sort else stacked


def concat_side_by_side(*frames: DataFrame, order_by: list) -> DataFrame:
    """Put tables next to each other by row position. ``order_by`` gives the order of each table, one entry per table.

    Shorter tables are filled up with nulls. A column name seen before gets a number.
    """
    if len(frames) < 2 or len(order_by) != len(frames):
        raise ValueError("concat_side_by_side needs two or more tables and one order_by entry for each")
    taken, parts = [], []
    for frame, order in zip(frames, order_by):
        named = []
        for name in frame.columns:
            named.append(free_name(name, taken))
            taken.append(named[-1])
        at = "_position"
        parts.append(number_rows(frame, order_columns(frame, order), at).toDF(*named, at))
    joined = reduce(lambda a, b: a.join(b, "_position", "full_outer"), parts)
    return joined.select(*[c(n) for n in taken])
