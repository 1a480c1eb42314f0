"""Compare two tables: rows, counts, fields, metadata and metrics."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import NUMERIC, as_list, c, free_name, order_columns, require
from sparkprep.operators.joins import join_datasets
from sparkprep.operators.ordering import number_rows

PARTS = 65_536
MODES = ("data", "count_data", "field_data", "differing_fields", "metadata", "metadata+metrics")
_ROW = "_row_index_for_compare"
# The time units a rounding may name, and their length in microseconds.
_UNITS = {
    "us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000,
}


def compare(
    left: DataFrame,
    right: DataFrame,
    mode: str = "data",
    keys: Iterable[str] | None = None,
    column_mismatch: str = "intersect",
    round_float: int | None = None,
    round_time: str | None = None,
    ignore: Iterable[str] | None = None,
    check_counts: bool = True,
    row_order: list | None = None,
    with_position: bool = True,
) -> DataFrame:
    """Differences between two tables.

    data: rows on one side only (row_differs) or with unequal counts (count_differs, one row per side).
    count_data: the number of those rows, ``diff_count``. field_data: per key and differing field the value and its
    origin; a null has no row, so a key that one side lacks shows only the fields that are filled on the other.
    differing_fields: per field the number of keys. metadata: columns and types (and positions).
    metadata+metrics: also counts, distinct counts, min and max.
    ``column_mismatch``: intersect compares common columns, strict raises on others. ``round_float`` digits and
    ``round_time`` (us, ms, s, min, h, D) apply before comparing. ``row_order`` = [left order_by, right order_by] makes
    the row position part of the data.
    """
    if mode not in MODES:
        raise ValueError(f"compare mode must be one of {MODES}, not {mode!r}")
    dropped = as_list(ignore)
    left = left.drop(*[n for n in dropped if n in left.columns])
    right = right.drop(*[n for n in dropped if n in right.columns])
    if mode == "metadata":
        return _data(_metadata(left, with_position), _metadata(right, with_position), True)
    if mode == "metadata+metrics":
        return _data(_metrics(left, with_position), _metrics(right, with_position), True)
    if row_order is not None:
        left = number_rows(left, order_columns(left, row_order[0]), _ROW)
        right = number_rows(right, order_columns(right, row_order[1]), _ROW)
    left, right = _common(left, right, column_mismatch)
    left, right = (_rounded(side, round_float, round_time) for side in (left, right))
    if mode == "data":
        return _data(*_differing_parts(left, right), check_counts)
    if mode == "count_data":
        return _data(*_differing_parts(left, right), check_counts).agg(F.count(F.lit(1)).alias("diff_count"))
    named = require(left, keys, "key column")
    fields = _fields(*(_differing_parts(left, right, named) if named else (left, right)), named)
    if mode == "field_data":
        return fields
    key_columns = [c(k) for k in as_list(keys)]
    return fields.groupBy("Field").agg(F.count_distinct(F.struct(*key_columns)).alias("CountDistinctKeys"))


def _common(left: DataFrame, right: DataFrame, column_mismatch: str) -> tuple[DataFrame, DataFrame]:
    only_left = [n for n in left.columns if n not in right.columns]
    only_right = [n for n in right.columns if n not in left.columns]
    if column_mismatch not in ("intersect", "strict"):
        raise ValueError("column_mismatch must be 'intersect' or 'strict'")
    if column_mismatch == "strict" and (only_left or only_right):
        raise ValueError(f"columns differ: only left {only_left}, only right {only_right}")
    names = [n for n in left.columns if n in right.columns]
    if not names:
        raise ValueError("the tables have no column in common")
    return left.select(*[c(n) for n in names]), right.select(*[c(n) for n in names])


def _rounded(df: DataFrame, digits: int | None, unit: str | None) -> DataFrame:
    if unit is not None and unit not in _UNITS:
        raise ValueError(f"round_time must be one of {list(_UNITS)}")
    changes = {}
    for f in df.schema.fields:
        if digits is not None and isinstance(f.dataType, NUMERIC):
            # Half to even, like the rounding of floats elsewhere in Python.
            changes[f.name] = F.bround(c(f.name), digits)
        elif unit is not None and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            micros = F.unix_micros(c(f.name).cast("timestamp"))
            rounded = F.bround(micros / F.lit(_UNITS[unit])).cast("bigint") * F.lit(_UNITS[unit])
            changes[f.name] = F.timestamp_micros(rounded).cast(f.dataType)
    return df.withColumns(changes) if changes else df


def _digest(df: DataFrame, names: list[str], seed: int) -> Column:
    """A 64-bit hash of some columns; a null adds nothing to it, so which are null is hashed too."""
    return F.xxhash64(F.lit(seed), *[c(n) for n in names], F.concat(*[c(n).isNull().cast("string") for n in names]))


def _differing_parts(left: DataFrame, right: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides without the parts that hold the same rows on both.

    A part is all rows with one hash of the keys (of the whole row, without keys), modulo ``PARTS``. Its digest adds up 128 bits
    of hash over its rows, whatever their order, on the map side first: equal tables are told so by ``PARTS`` short rows from
    each task, and of nearly equal ones only the rows of a few parts go through the shuffle. With keys, a part in which a key
    repeats is never left out, as its rows meet others of the key.
    """
    names = left.columns
    if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in [*left.schema.fields, *right.schema.fields]):
        return left, right
    part = free_name("_part", names)

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn(part, F.pmod(_digest(df, keys or names, 1), F.lit(PARTS)))

    def digests(df: DataFrame, sign: int) -> DataFrame:
        hashes = [_digest(df, names, seed) for seed in (2, 3)]
        halves = [half for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
        return marked(df).select(F.col(part).alias("_open"), F.lit(sign).cast("long").alias("_d0"), *[(half * sign).alias(f"_d{i}") for i, half in enumerate(halves, 1)])

    # One side counts up and the other down: a part with the same rows on both comes to nothing.
    sums = digests(left, 1).unionByName(digests(right, -1)).groupBy("_open").agg(*[F.sum(f"_d{i}").alias(f"_d{i}") for i in range(5)])
    differ = sums.where(reduce(Column.__or__, [F.col(f"_d{i}") != 0 for i in range(5)])).select("_open")
    for side in (left, right) if keys else ():
        again = marked(side).groupBy(part, _digest(side, keys, 4).alias("_key")).count().where("count > 1")
        differ = differ.unionByName(again.select(F.col(part).alias("_open")))
    differ = F.broadcast(differ.distinct())  # PARTS rows at most
    return tuple(marked(side).join(differ, F.col(part) == F.col("_open"), "left_semi").drop(part) for side in (left, right))


def _data(left: DataFrame, right: DataFrame, check_counts: bool) -> DataFrame:
    """One union and one aggregate with two conditional counts: copies of a row meet on the map side already."""
    names = left.columns
    origin = free_name("origin_data", names)
    count = free_name("row_count", [*names, origin])
    kind = free_name("difference_type", [*names, origin, count])
    total = free_name("total_count_diff", [*names, origin, count, kind])
    both = left.withColumn("_left", F.lit(1)).unionByName(right.withColumn("_left", F.lit(0)))
    counted = both.groupBy(*[c(n) for n in names]).agg(
        F.count(F.when(F.col("_left") == 1, 1)).alias("_l"), F.count(F.when(F.col("_left") == 0, 1)).alias("_r")
    )
    one_sided = (F.col("_l") == 0) | (F.col("_r") == 0)
    wanted = F.col("_l") != F.col("_r") if check_counts else one_sided
    sides = F.array(
        F.struct(F.lit("left").alias("o"), F.col("_l").alias("n")), F.struct(F.lit("right").alias("o"), F.col("_r").alias("n"))
    )
    rows = counted.where(wanted).select("*", F.explode(sides).alias("_side")).where(F.col("_side.n") > 0)
    return rows.select(
        *[c(n) for n in names],
        F.col("_side.o").alias(origin),
        F.col("_side.n").alias(count),
        F.when(one_sided, F.lit("row_differs")).otherwise(F.lit("count_differs")).alias(kind),
        F.abs(F.col("_l") - F.col("_r")).alias(total),
    )


def _fields(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        raise ValueError("field_data and differing_fields need keys")
    fields = [n for n in left.columns if n not in keys]
    if not fields:  # nothing beside the keys can differ
        none = [F.lit(None).cast("string").alias(n) for n in ("Field", "Value", "Origin")]
        return left.select(*[c(k) for k in keys], *none).where(F.lit(False))
    joined = join_datasets(
        left.select(*[c(k) for k in keys], F.struct(*[c(f) for f in fields]).alias("_left_row")),
        right.select(*[c(k) for k in keys], F.struct(*[c(f) for f in fields]).alias("_right_row")),
        on=keys, how="outer", same_name="coalesce", null_keys="match",
    )
    cells = []
    for f in fields:
        a, b = F.col("_left_row")[f], F.col("_right_row")[f]
        for side, value in (("left", a), ("right", b)):
            shown = F.when(~a.eqNullSafe(b), value.cast("string"))
            cells.append(F.struct(F.lit(f).alias("Field"), shown.alias("Value"), F.lit(side).alias("Origin")))
    long = joined.select(*[c(k) for k in keys], F.explode(F.array(*cells)).alias("_c"))
    long = long.where(F.col("_c.Value").isNotNull())
    return long.select(*[c(k) for k in keys], "_c.Field", "_c.Value", "_c.Origin")


def _metadata(df: DataFrame, with_position: bool) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields)]
    table = df.sparkSession.createDataFrame(rows, "column string, type string, index int")
    return table if with_position else table.drop("index")


def _metrics(df: DataFrame, with_position: bool) -> DataFrame:
    """One aggregate per table, unfolded to (column, index, key, value) rows of text."""
    stats, cells = [], []
    for i, f in enumerate(df.schema.fields):
        cell = c(f.name)
        parts = {"count": F.count(cell), "count_distinct": F.count_distinct(cell)}
        if isinstance(f.dataType, (*NUMERIC, T.TimestampType, T.TimestampNTZType, T.DateType)):
            parts |= {"min": F.min(cell), "max": F.max(cell)}
        stats += [expr.cast("string").alias(f"_{k}{i}") for k, expr in parts.items()]
        values = {"type": F.lit(f.dataType.simpleString())} | {k: F.col(f"_{k}{i}") for k in parts}
        for key, value in values.items():
            cells.append(
                F.struct(
                    F.lit(f.name).alias("column"), F.lit(str(i)).alias("index"), F.lit(key).alias("key"),
                    value.alias("value"),
                )
            )
    table = df.agg(*stats).select(F.explode(F.array(*cells)).alias("_m")).select("_m.*")
    return table if with_position else table.drop("index")
