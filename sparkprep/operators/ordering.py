"""Row order at scale: numbering, running totals and carrying values over rows of a global or grouped order.

A plain window with ``partitionBy(group)`` puts a whole group into one task, and one without ``partitionBy`` puts the
whole table there. Here the rows are sorted by (group, order) over all partitions and written once; each sorted
partition is a *slice*. Windows then run inside a slice only, and what earlier slices contribute to the first group of
a slice (a count, a sum, the last value) is carried over in a table with one row per slice. A hot group simply spans
many slices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import as_list, c, order_columns, require, same_row
from sparkprep.session import cut

SLICE, SEAT = "_slice", "_seat"
_TIE, _COPY, _FIRST, _LAST = "_tie", "_copy", "_first_group", "_last_group"
# monotonically_increasing_id() holds the partition number above its low 33 bits.
_SEAT_BITS = 33


def row_hash(df: DataFrame, seed: int = 42) -> Column:
    """A 64-bit hash of the whole row; equal rows have equal hashes."""
    hashed = [c(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(F.lit(seed), *hashed)


def sorted_slices(df: DataFrame, order: list[Column], by: list[str] = (), distinct_order: bool = False) -> DataFrame:
    """``df`` in the order (by, order), written once, with its slice number and a seat number that rises over all rows.

    Ties are broken by a hash of the row and then, so that even copies of one row spread over slices, by the position
    of the copy within its input partition after a local sort (which a re-run task reproduces).
    ``distinct_order=True`` promises that (by, order) has no ties and saves that step.
    """
    keys = [c(b).asc_nulls_first() for b in by] + list(order)
    if not distinct_order:
        df = df.withColumn(_TIE, row_hash(df))
        keys = keys + [F.col(_TIE)]
        df = df.sortWithinPartitions(*keys).withColumn(_COPY, F.monotonically_increasing_id())
        keys = keys + [F.col(_COPY)]
    seated = df.orderBy(*keys).withColumn(SEAT, F.monotonically_increasing_id()).drop(_TIE, _COPY)
    return cut(seated.withColumn(SLICE, F.shiftright(SEAT, _SEAT_BITS).cast("int")), "slices")


def _offsets(slices: DataFrame) -> DataFrame:
    """Rows before each slice. One row per slice, so the window and the broadcast below are bounded by the partitions."""
    sizes = slices.groupBy(SLICE).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def _carried(
    slices: DataFrame, by: list[str], parts: dict[str, Column], run: Callable[[Column, Window], Column]
) -> DataFrame:
    """Per slice: its first group and what earlier slices bring into that group. One row per slice.

    ``parts`` are aggregates of one group inside one slice; ``run`` continues them over slices of the same group.
    """
    pieces = slices.groupBy(SLICE, *[c(b) for b in by]).agg(
        F.min(SEAT).alias("_at"), *[expr.alias(name) for name, expr in parts.items()]
    )
    group = F.struct(*[c(b) for b in by])
    ends = pieces.groupBy(SLICE).agg(
        F.min_by(group, F.col("_at")).alias(_FIRST),
        F.max_by(F.struct(group.alias("g"), *[c(n) for n in parts]), F.col("_at")).alias("_end"),
    )
    ends = ends.select(SLICE, _FIRST, F.col("_end.g").alias(_LAST), *[F.col(f"_end.{n}").alias(n) for n in parts])
    same_group = Window.partitionBy(_LAST).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    through = ends.select(SLICE, _FIRST, _LAST, *[run(c(n), same_group).alias(n) for n in parts])
    previous = Window.orderBy(SLICE)
    continues = F.lag(_LAST).over(previous).eqNullSafe(F.col(_FIRST))
    return through.select(
        SLICE, _FIRST, *[F.when(continues, F.lag(c(n)).over(previous)).alias(f"_carry_{n}") for n in parts]
    )


def _is_one(slices: DataFrame) -> bool:
    """Whether all rows went into one slice (Spark joins small partitions); then nothing is carried."""
    last = slices.agg(F.max(SLICE)).first()[0]
    return not last


def running_totals(
    df: DataFrame, by: list[str], order_by, totals: dict[str, str], distinct_order: bool = False
) -> DataFrame:
    """Add, per ``totals`` entry ``new: value``, the sum of ``value`` over the earlier rows of the group (0 at first)."""
    by = require(df, by)
    slices = sorted_slices(df, order_columns(df, order_by), by, distinct_order)
    earlier = Window.partitionBy(SLICE, *[c(b) for b in by]).orderBy(SEAT).rowsBetween(Window.unboundedPreceding, -1)
    local = slices.select("*", *[_or_zero(F.sum(c(v)).over(earlier)).alias(n) for n, v in totals.items()])
    if _is_one(slices):
        return local.drop(SLICE, SEAT)
    carried = _carried(
        slices, by, {n: F.sum(c(v)) for n, v in totals.items()}, lambda value, window: F.sum(value).over(window)
    )
    joined = local.join(F.broadcast(carried), SLICE)
    return joined.select(
        *[c(name) for name in df.columns],
        *[(c(n) + _or_zero(F.when(_continued(by), c(f"_carry_{n}")))).alias(n) for n in totals],
    )


def _continued(by: list[str]) -> Column:
    """True for rows of the group that an earlier slice began."""
    return F.struct(*[c(b) for b in by]).eqNullSafe(F.col(_FIRST))


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def number_rows(
    df: DataFrame, order: list[Column], name: str, by: list[str] = (), distinct_order: bool = False
) -> DataFrame:
    """Add ``name`` = 1, 2, 3... in the given order, over the whole table or within each group of ``by``."""
    columns = [c(n) for n in df.columns]
    by = list(by)
    slices = sorted_slices(df, order, by, distinct_order)
    if not by:
        # The seat in the slice is the number, but for the rows of earlier slices: no window over the rows.
        placed = slices.join(F.broadcast(_offsets(slices)), SLICE)
        seat_in_slice = F.col(SEAT) - F.shiftleft(F.col(SLICE).cast("bigint"), _SEAT_BITS)
        return placed.select(*columns, (F.col("_start") + seat_in_slice + 1).alias(name))
    here = Window.partitionBy(SLICE, *[c(b) for b in by]).orderBy(SEAT)
    local = slices.select("*", F.row_number().over(here).cast("bigint").alias("_here"))
    if _is_one(slices):
        return local.select(*columns, F.col("_here").alias(name))
    carried = _carried(slices, by, {"_n": F.count(F.lit(1))}, lambda value, window: F.sum(value).over(window))
    joined = local.join(F.broadcast(carried), SLICE)
    return joined.select(*columns, (F.col("_here") + _or_zero(F.when(_continued(by), F.col("_carry__n")))).alias(name))


def carry_forward(df: DataFrame, columns: list[str], order: list[Column], by: list[str] = ()) -> DataFrame:
    """Replace nulls in ``columns`` by the last earlier value that is not null, in the given order (per group)."""
    by, names = list(by), df.columns
    if not by:
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    slices = sorted_slices(df, order, by)
    here = Window.partitionBy(SLICE, *[c(b) for b in by]).orderBy(SEAT)
    here = here.rowsBetween(Window.unboundedPreceding, 0)
    last = {n: F.last(c(n), ignorenulls=True).over(here) for n in columns}
    local = slices.select(
        SLICE, *[last.get(n, c(n)).alias(n) for n in names], *[c(b).alias(f"_by_{b}") for b in by]
    )
    if _is_one(slices):
        return local.select(*[c(n) for n in names])
    parts = {n: F.max_by(c(n), F.when(c(n).isNotNull(), F.col(SEAT))) for n in columns}
    carried = _carried(slices, by, parts, lambda value, window: F.last(value, ignorenulls=True).over(window))
    joined = local.join(F.broadcast(carried), SLICE)
    filled = {n: F.coalesce(c(n), F.when(_continued([f"_by_{b}" for b in by]), c(f"_carry_{n}"))) for n in columns}
    return joined.select(*[filled.get(n, c(n)).alias(n) for n in names])


_STEPS = 4096


def _rough(value: Column) -> Column:
    """A number that never falls as ``value`` rises, one for each power of two: some 4,200 in all."""
    power = F.floor(F.log2(F.abs(value))) + 1100
    sign = F.when(value > 0, power).otherwise(-power)
    far = F.when(F.isnan(value), 5000).when(value == float("inf"), 4000).when(value == float("-inf"), -4000).when(value == 0, 0)
    return far.otherwise(sign).cast("int")


def exact_quantiles(
    df: DataFrame, by: list[str], columns: list[str], probabilities: list[float]
) -> DataFrame:
    """Exact quantiles (linear interpolation) of numeric ``columns`` per group of ``by``.

    Returns by + ``field`` + ``quantiles`` (array of double, in the order of ``probabilities``). Nothing is sorted: values are
    counted by powers of two, on the map side first, and of each range that holds a wanted position the values are counted
    again in ``_STEPS`` equal steps between the least and the greatest of them, until a range is one value. A round looks at
    fewer values than the one before, and shuffles a bounded number of counts per group and task.
    """
    by = as_list(by)
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), (c(n).cast("double") + F.lit(0.0)).alias("_v")) for n in columns]))
    stacked = df.select(*[c(b) for b in by], cells.alias("_fv")).select(*[c(b) for b in by], "_fv.field", "_fv._v")
    values = cut(stacked.where(F.col("_v").isNotNull()), "values")
    keys = [*by, "field"]
    spread = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    own = [c(k) for k in keys]

    # The positions on both sides of each quantile, and the range of values that holds them.
    counted = values.groupBy(*own, _rough(F.col("_v")).alias("_step")).agg(*spread)
    group = Window.partitionBy(*own)
    counted = counted.withColumn("_before", _before(group)).withColumn("_size", F.sum("_n").over(group))
    at = [(F.col("_size") - 1) * F.lit(float(p)) for p in probabilities]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in at])))
    kept = [*own, "_size", "_rank", "_low", "_high", "_before"]
    todo = cut(counted.select("*", F.explode(ranks).alias("_rank")).where(_inside()).select(*kept), "ranges")
    one = F.col("_low").eqNullSafe(F.col("_high"))
    while not todo.where(~one).isEmpty():
        wide = todo.where(~one)
        named = [c(k).alias(f"_k{i}") for i, k in enumerate(keys)]
        on = same_row(own, [F.col(f"_k{i}") for i in range(len(keys))])
        ranges = wide.select(*named, F.col("_low").alias("_from"), F.col("_high").alias("_to"), F.col("_before").alias("_earlier")).distinct()
        near = values.join(ranges, on & F.col("_v").between(F.col("_from"), F.col("_to")))
        step = F.floor((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from")) * _STEPS)
        counted = near.groupBy(*own, "_from", "_earlier", F.least(step, F.lit(_STEPS - 1)).alias("_step")).agg(*spread)
        counted = counted.withColumn("_before", F.col("_earlier") + _before(Window.partitionBy(*own, "_from")))
        counted = counted.select(*named, "_from", "_n", "_low", "_high", "_before")
        found = wide.select(*own, "_size", "_rank", F.col("_low").alias("_was")).join(counted, on & (F.col("_was") == F.col("_from"))).where(_inside())
        todo = cut(todo.where(one).unionByName(found.select(*kept)), "ranges")
    picks = []
    for i, x in enumerate(at):
        for side, rank in (("lo", F.floor(x)), ("hi", F.ceil(x))):
            picks.append(F.max(F.when(F.col("_rank") == rank, F.col("_low"))).alias(f"_{side}{i}"))
        picks.append(F.max(x - F.floor(x)).alias(f"_part{i}"))
    found = todo.groupBy(*own).agg(*picks)
    sides = [(F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_part{i}")) for i in range(len(probabilities))]
    quantiles = [F.when(lo == hi, lo).otherwise(lo + (hi - lo) * part) for lo, hi, part in sides]
    return found.select(*own, F.array(*quantiles).alias("quantiles"))


def _before(group) -> Column:
    """Rows in the earlier steps of the group; a group has a bounded number of steps."""
    return _or_zero(F.sum("_n").over(group.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)))


def _inside() -> Column:
    return (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
