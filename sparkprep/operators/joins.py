"""Joins: equality, theta, range, anti and cross, with same-name strategies and a many-to-many check."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import NUMERIC, as_list, c, require, same_row
from sparkprep.operators.hot_keys import join_by_pairs
from sparkprep.operators.theta import OPS as _OPS
from sparkprep.operators.theta import theta_inner, theta_unmatched

HOW = ("inner", "left", "right", "outer", "cross", "anti-left", "anti-right")
_MIRROR = {"=": "=", ">": "<", "<": ">", ">=": "<=", "<=": ">="}


def join_datasets(
    left: DataFrame,
    right: DataFrame,
    on: str | Iterable[str] | None = None,
    how: str = "left",
    left_on: Iterable[str] | None = None,
    right_on: Iterable[str] | None = None,
    conditions: Iterable[tuple[str, str, str]] | None = None,
    same_name: str = "suffix_right",
    null_keys: str = "differ",
    if_many_to_many: str = "ignore",
    hint: str | None = None,
    split_hot_keys: bool | None = None,
    bin_width: float | None = None,
) -> DataFrame:
    """Join two tables.

    ``on`` / ``left_on`` + ``right_on`` give equality keys, ``conditions`` gives and-ed (left, op, right) triples with
    op ``= > < >= <=``. ``how``: inner, left, right, outer, cross, anti-left, anti-right; anti joins return one side.
    ``same_name``: suffix_right, suffix_both or coalesce for columns both sides have. ``null_keys='match'`` lets null
    keys meet. ``if_many_to_many``: ignore, warn or raise when neither side is unique on its keys. ``hint`` is a Spark
    join hint for the right side. ``bin_width`` turns a point-in-interval condition into an equality join on bins; it
    counts units of a number, days of a date or seconds of a timestamp, and is best near the usual interval length. Other
    inequalities without an equality meet in pairs of bounded blocks (``theta``), unless a hint asks for Spark's own join.

    Hot keys: Spark splits them at run time in inner joins (both sides) and on the kept side of left and right joins,
    but never in a full outer join. ``split_hot_keys`` writes an outer join as inner join + unmatched rows (found
    against the distinct keys of the other side), which can be split on both sides. By default only ``outer`` is
    written so; set it to True for a left or right join whose other side has hot keys.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}, not {how!r}")
    if same_name not in ("suffix_right", "suffix_both", "coalesce"):
        raise ValueError(f"unknown same_name strategy {same_name!r}")
    if null_keys not in ("differ", "match"):
        raise ValueError("null_keys must be 'differ' or 'match'")
    pairs = _pairs(left, right, on, left_on, right_on, conditions)
    if how == "cross":
        pairs = []
    elif not pairs:
        raise ValueError("at least one join condition is required")
    if if_many_to_many != "ignore" and how != "cross":
        _check_many_to_many(left, right, pairs, if_many_to_many)
    # Both sides get names of their own, so that conditions are never ambiguous (self joins too).
    lefts = {n: f"_l{i}" for i, n in enumerate(left.columns)}
    rights = {n: f"_r{i}" for i, n in enumerate(right.columns)}
    sides = _Sides(left.toDF(*lefts.values()), right.toDF(*rights.values()), hint)
    conds = [(lefts[a], op, rights[b]) for a, op, b in pairs]
    equal = [(a, b) for a, op, b in conds if op == "="]
    unequal = [(a, op, b) for a, op, b in conds if op != "="]
    match = null_keys == "match"
    if bin_width is None and not equal and len(unequal) == 2:
        bin_width = _usual_length(sides, unequal)

    if how == "anti-left":
        kept = _anti(sides.left, sides.right, equal, unequal, match, bin_width)
        return kept.select(*[c(lefts[n]).alias(n) for n in left.columns])
    if how == "anti-right":
        mirrored = [(b, _MIRROR[op], a) for a, op, b in unequal]
        kept = _anti(sides.right, sides.left, [(b, a) for a, b in equal], mirrored, match, bin_width)
        return kept.select(*[c(rights[n]).alias(n) for n in right.columns])
    if how == "cross":
        joined = sides.left.crossJoin(sides.hinted())
    elif bin_width is not None:
        joined = _interval_join(sides, equal, unequal, how, match, bin_width)
    else:
        test = _test(equal, unequal, match)
        split = how == "outer" if split_hot_keys is None else split_hot_keys
        if unequal and not equal and not hint:
            joined = _theta_join(sides, unequal, how)
        elif how == "outer" and equal and unequal:
            joined = _outer_with_inequality(sides, equal, unequal, match)
        elif how == "inner" and equal and unequal:
            joined = join_by_pairs(sides.left, sides.right, equal, _test([], unequal, match), match, sides.hint)
        elif how == "inner" or not split or unequal:
            joined = sides.left.join(sides.hinted(), test, {"outer": "full_outer"}.get(how, how))
        else:
            joined = _split_outer(sides, equal, how, match)
    return joined.select(*_outputs(left, right, lefts, rights, same_name))


class _Sides:
    def __init__(self, left: DataFrame, right: DataFrame, hint: str | None):
        self.left, self.right, self.hint = left, right, hint

    def hinted(self) -> DataFrame:
        return self.right.hint(self.hint) if self.hint else self.right


def _pairs(left, right, on, left_on, right_on, conditions) -> list[tuple[str, str, str]]:
    lefts, rights = as_list(left_on), as_list(right_on)
    if len(lefts) != len(rights):
        raise ValueError("left_on and right_on must have the same length")
    pairs = [(k, "=", k) for k in as_list(on)] + [(a, "=", b) for a, b in zip(lefts, rights)]
    pairs += [tuple(item) for item in conditions or ()]
    require(left, [a for a, _, _ in pairs], "left join column")
    require(right, [b for _, _, b in pairs], "right join column")
    wrong = [op for _, op, _ in pairs if op not in _OPS]
    if wrong:
        raise ValueError(f"unknown join operator {wrong}; known are {list(_OPS)}")
    return pairs


def _test(equal, unequal, match: bool) -> Column:
    tests = [c(a).eqNullSafe(c(b)) if match else c(a) == c(b) for a, b in equal]
    tests += [_OPS[op](c(a), c(b)) for a, op, b in unequal]
    return reduce(Column.__and__, tests)


def _outputs(left, right, lefts, rights, same_name) -> list[Column]:
    both = set(left.columns) & set(right.columns)
    out = []
    for n in left.columns:
        if n in both and same_name == "coalesce":
            out.append(F.coalesce(c(lefts[n]), c(rights[n])).alias(n))
        else:
            out.append(c(lefts[n]).alias(f"{n}_left" if n in both and same_name == "suffix_both" else n))
    for n in right.columns:
        if n not in both:
            out.append(c(rights[n]).alias(n))
        elif same_name != "coalesce":
            out.append(c(rights[n]).alias(f"{n}_right"))
    return out


def _distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys under other names: a hot key is one row per task before the shuffle."""
    return df.select(*[c(k) for k in keys]).distinct().toDF(*[f"_k{i}" for i in range(len(keys))])


def _unmatched(df: DataFrame, keys: list[str], other: DataFrame, other_keys: list[str], match: bool) -> DataFrame:
    distinct = _distinct_keys(other, other_keys)
    pairs = [(k, f"_k{i}") for i, k in enumerate(keys)]
    return df.join(distinct, _test(pairs, [], match), "left_anti")


def _split_outer(sides: _Sides, equal, how: str, match: bool) -> DataFrame:
    lkeys, rkeys = [a for a, _ in equal], [b for _, b in equal]
    joined = sides.left.join(sides.hinted(), _test(equal, [], match), "inner")
    if how in ("left", "outer"):
        joined = joined.unionByName(
            _unmatched(sides.left, lkeys, sides.right, rkeys, match), allowMissingColumns=True
        )
    if how in ("right", "outer"):
        joined = joined.unionByName(
            _unmatched(sides.right, rkeys, sides.left, lkeys, match), allowMissingColumns=True
        )
    return joined


def _outer_with_inequality(sides: _Sides, equal, unequal, match: bool) -> DataFrame:
    """A full outer join cannot be split at hot keys: inner join, and the rows of each side without a partner."""
    mirrored = [(b, _MIRROR[op], a) for a, op, b in unequal]
    joined = join_by_pairs(sides.left, sides.right, equal, _test([], unequal, match), match, sides.hint)
    lefts = _anti(sides.left, sides.right, equal, unequal, match, None)
    rights = _anti(sides.right, sides.left, [(b, a) for a, b in equal], mirrored, match, None)
    return joined.unionByName(lefts, allowMissingColumns=True).unionByName(rights, allowMissingColumns=True)


def _theta_join(sides: _Sides, unequal, how: str) -> DataFrame:
    """Inequalities alone: partners by pairs of bounded blocks, and the rows of each side without one."""
    joined = theta_inner(sides.left, sides.right, unequal)
    if how in ("left", "outer"):
        joined = joined.unionByName(theta_unmatched(sides.left, sides.right, unequal), allowMissingColumns=True)
    if how in ("right", "outer"):
        mirrored = [(b, _MIRROR[op], a) for a, op, b in unequal]
        joined = joined.unionByName(theta_unmatched(sides.right, sides.left, mirrored), allowMissingColumns=True)
    return joined


def _anti(df: DataFrame, other: DataFrame, equal, unequal, match: bool, bin_width) -> DataFrame:
    """Rows of ``df`` without a partner in ``other``; conditions are written (column of df, op, column of other)."""
    keys, other_keys = [a for a, _ in equal], [b for _, b in equal]
    if not unequal:
        return _unmatched(df, keys, other, other_keys, match)
    if not equal and bin_width is None:
        return theta_unmatched(df, other, unequal)
    if len(unequal) == 1:
        # "some partner is smaller (greater)" needs only the smallest (greatest) partner of each key.
        a, op, b = unequal[0]
        extreme = (F.min if op in (">", ">=") else F.max)(c(b)).alias("_edge")
        edges = other.groupBy(*[c(k).alias(f"_k{i}") for i, k in enumerate(other_keys)]).agg(extreme)
        pairs = [(k, f"_k{i}") for i, k in enumerate(keys)]
        return df.join(edges, _test(pairs, [(a, op, "_edge")], match), "left_anti")
    if bin_width is not None:
        kind, point, low, high = _interval(unequal)
        if kind == "point_left":
            bins = _Bins(df, other, point, low, high, bin_width)
            return bins.unmatched_points(_test(equal, unequal, match))
        bins = _Bins(other, df, point, low, high, bin_width)
        return bins.unmatched_intervals(_test(equal, unequal, match), other_keys)
    return df.join(other, _test(equal, unequal, match), "left_anti")


def _without_matched(df: DataFrame, matched: DataFrame) -> DataFrame:
    """``df`` minus the rows in ``matched``. Whether a row matches depends on its values only, so copies go together."""
    seen = matched.select(*[c(n) for n in df.columns]).distinct().toDF(*[f"_m{i}" for i in range(len(df.columns))])
    on = same_row([c(n) for n in df.columns], [F.col(f"_m{i}") for i in range(len(df.columns))])
    return df.join(seen, on, "left_anti")


def _interval(unequal) -> tuple[str, str, str, str]:
    """Read ``low <= point <= high``: two inequalities that share one column, the point."""
    if len(unequal) == 2:
        (a1, op1, b1), (a2, op2, b2) = unequal
        up, down = (">", ">="), ("<", "<=")
        if a1 == a2 and ((op1 in up and op2 in down) or (op1 in down and op2 in up)):
            return ("point_left", a1, b1, b2) if op1 in up else ("point_left", a1, b2, b1)
        if b1 == b2 and ((op1 in up and op2 in down) or (op1 in down and op2 in up)):
            return ("point_right", b1, a2, a1) if op1 in up else ("point_right", b1, a1, a2)
    raise ValueError("bin_width needs two inequalities that put one column between two columns of the other side")


def _usual_length(sides: _Sides, unequal) -> float | None:
    """The mean length of the intervals that two inequalities make, or None where they make none that can be measured."""
    try:
        kind, point, low, high = _interval(unequal)
    except ValueError:
        return None
    points, intervals = (sides.left, sides.right) if kind == "point_left" else (sides.right, sides.left)
    measured = (*NUMERIC, T.DateType, T.TimestampType, T.TimestampNTZType)
    if not all(isinstance(df.schema[n].dataType, measured) for df, n in ((points, point), (intervals, low), (intervals, high))):
        return None
    length = _number(intervals, high) - _number(intervals, low)
    mean = intervals.where(length > 0).agg(F.avg(length)).first()[0]
    return mean if mean is not None and 0 < mean < float("inf") else 1.0


def _number(df: DataFrame, name: str) -> Column:
    """The column as a number: as it is, days of a date, or seconds of a timestamp."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(c(name)).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # A time without zone is read as an instant the same way on both sides, only to number the bins.
        return F.unix_micros(c(name).cast("timestamp")) / 1_000_000
    return c(name).cast("double")


class _Bins:
    """Points and intervals with the bins they meet in.

    An interval covers at most some 65 bins: longer ones use bins 64, 64 * 64... times as wide, so no interval makes
    many rows whatever its length. A point has one bin for each of the widths in use, which are few (each is 64 times
    the one before) and are listed by one aggregate over the intervals.
    """

    FACTOR = 64
    CELLS = 64  # of a bin

    def __init__(self, points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: float):
        if width <= 0:
            raise ValueError("bin_width must be positive")
        self.points, self.intervals, self.point = points, intervals, point
        # An interval that ends before it starts can match nothing.
        real = intervals.where(c(low) <= c(high))
        start, end = _number(intervals, low), _number(intervals, high)
        bins = (end - start) / F.lit(float(width))
        level = F.when(bins <= self.FACTOR, F.lit(0)).otherwise(F.ceil(F.log(float(self.FACTOR), bins)) - 1).cast("int")

        def bin_of(number: Column, level: Column, parts: int = 1) -> Column:
            return F.floor(number / (F.lit(float(width) / parts) * F.pow(F.lit(float(self.FACTOR)), level)))

        short = F.isnan(start) | F.isnan(end) | (bin_of(start, level, self.CELLS) == bin_of(end, level, self.CELLS))
        kinds = real.select(level.alias("level"), short.alias("short")).distinct().collect()
        self.levels = sorted({r.level for r in kinds}) or [0]
        self.any_short = any(r.short for r in kinds)
        leveled = real.select("*", level.alias("_ilevel"), short.alias("_short"))
        covered = F.sequence(bin_of(start, F.col("_ilevel")), bin_of(end, F.col("_ilevel")))
        self.all_ranges = leveled.select("*", F.explode(covered).alias("_ibin"))
        at = _number(points, point)
        if len(self.levels) == 1:
            # All bins are as wide: a point has one, and each interval around it covers that bin.
            here = F.lit(self.levels[0])
            self.spots, self.keys = points.select("*", bin_of(at, here).alias("_bin")), [("_bin", "_ibin")]
            self.cell = bin_of(at, here, self.CELLS)
        else:
            spots = F.array(*[F.struct(F.lit(x).alias("level"), bin_of(at, F.lit(x)).alias("bin")) for x in self.levels])
            self.spots = points.select("*", F.explode(spots).alias("_at")).select(
                *[c(n) for n in points.columns], F.col("_at.level").alias("_level"), F.col("_at.bin").alias("_bin")
            )
            self.keys = [("_level", "_ilevel"), ("_bin", "_ibin")]
            self.cell = bin_of(at, F.col("_level"), self.CELLS)
        self.ranges = self.all_ranges.select(*[c(n) for n in intervals.columns], *[b for _, b in self.keys])
        self.real_point = at.isNotNull() & ~F.isnan(at)

    def _on(self, test: Column) -> Column:
        return reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in self.keys], test)

    def pairs(self, equal: list[tuple[str, str]], unequal: Column, match: bool, keep_points: bool = False) -> DataFrame:
        """Points with the intervals around them; ``equal`` are (column of the points, column of the intervals).

        ``keep_points``: with the points that have none; for bins of one width.
        """
        met = join_by_pairs(self.spots, self.ranges, [*self.keys, *equal], unequal, match, how="left" if keep_points else "inner")
        return met.drop(*[n for pair in self.keys for n in pair])

    def unmatched_points(self, test: Column) -> DataFrame:
        if len(self.levels) == 1:
            return self.spots.join(self.ranges, self._on(test), "left_anti").drop("_bin")
        return _without_matched(self.points, self.spots.join(self.ranges, self._on(test), "left_semi"))

    def unmatched_intervals(self, test: Column, equal: list[str]) -> DataFrame:
        """Intervals without a point; ``equal`` are columns of the points that ``test`` compares for equality.

        The least and the greatest point of each cell (of each combination of ``equal``) settle all intervals that begin and
        end in different cells: of the cell of the start the greatest is inside if any point is, of that of the end the least,
        of a cell between them all. Only intervals within one cell look at all points.
        """
        here = [*[c(n) for n in equal], *[F.col(a) for a, _ in self.keys]]
        ends = self.spots.where(self.real_point).groupBy(*here, self.cell.alias("_cell")).agg(
            F.min(c(self.point)).alias("_least"), F.max(c(self.point)).alias("_most"))
        few = ends.select(*[x for x in here], F.explode(F.array("_least", "_most")).alias(self.point))
        own = [*[c(n) for n in self.intervals.columns], *[b for _, b in self.keys]]
        matched = self.all_ranges.where(~F.col("_short")).select(*own).join(few, self._on(test), "left_semi")
        if self.any_short:
            matched = matched.unionByName(self.all_ranges.where("_short").select(*own).join(self.spots, self._on(test), "left_semi"))
        return _without_matched(self.intervals, matched)


def _interval_join(sides: _Sides, equal, unequal, how: str, match: bool, width: float) -> DataFrame:
    kind, point, low, high = _interval(unequal)
    points, intervals = (sides.left, sides.right) if kind == "point_left" else (sides.right, sides.left)
    test = _test(equal, unequal, match)
    bins = _Bins(points, intervals, point, low, high, width)
    keys = equal if kind == "point_left" else [(b, a) for a, b in equal]
    keep_points = how == "outer" or how == ("left" if kind == "point_left" else "right")
    one = len(bins.levels) == 1
    joined = bins.pairs(keys, _test([], unequal, match), match, keep_points and one)
    if keep_points and not one:
        joined = joined.unionByName(bins.unmatched_points(test), allowMissingColumns=True)
    if how == "outer" or how == ("right" if kind == "point_left" else "left"):
        joined = joined.unionByName(bins.unmatched_intervals(test, [a for a, _ in keys]), allowMissingColumns=True)
    return joined


def _repeats(df: DataFrame, keys: list[str]) -> bool:
    counts = df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    return not counts.where(F.col("_n") > 1).limit(1).isEmpty()


def _check_many_to_many(left, right, pairs, action: str) -> None:
    if action not in ("warn", "raise"):
        raise ValueError("if_many_to_many must be 'ignore', 'warn' or 'raise'")
    if _repeats(left, [a for a, _, _ in pairs]) and _repeats(right, [b for _, _, b in pairs]):
        message = "neither side is unique on its join keys: rows will multiply"
        if action == "raise":
            raise ValueError(message)
        warnings.warn(message, stacklevel=3)
