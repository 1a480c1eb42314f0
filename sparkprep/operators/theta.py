"""Joins on inequalities alone, without comparing all rows with all rows in one place.

Each side is cut at values of its first two compared columns, taken from a sample, into blocks of some ``BLOCK_ROWS`` rows; where many
rows have one value, a block is cut further by a hash of the row. Two blocks can hold partners only if their least and greatest
values allow it. The rows then meet by equality of the pair of blocks, so that every key has two bounded groups.

A row is copied to each block that it may meet. With blocks of one size the copies would grow with the product of the two tables, and
so would the shuffle; so neighbouring blocks are united while there are more than ``MOST_COPIES`` copies of a row (and more than
``TASK_ROWS`` in all) and still a pair of blocks for each shuffle partition. Nothing but the cuts and the bounds of the blocks is
written.

Which rows have a partner needs no pairs of rows. With two conditions the other side is cut at values of its first column: of all
blocks before that of a row the best value of the second column decides, and only the rows that this leaves open meet the rows of
one block.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep._columns import c
from sparkprep.operators.hot_keys import MOST_COPIES, MOST_SENT, TASK_ROWS, tasks_for
from sparkprep.operators.ordering import row_hash
from sparkprep.session import cut

BLOCK_ROWS = 4096
MOST_BLOCKS = 1024  # of a side
MOST_PARTS = 256  # by one column
SAMPLED = 100  # rows for each cut
OPS = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__, "=": Column.__eq__}
Conditions = list[tuple[str, str, str]]


def _holds(conditions: Conditions) -> Column:
    return reduce(Column.__and__, [OPS[op](c(a), c(b)) for a, op, b in conditions])


def _zero(column: str) -> Column:
    """A key that is 0 in every row, and that the optimizer does not know to be constant."""
    return F.pmod(F.xxhash64(c(column)), F.lit(1))


def _filled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(Column.__and__, [c(n).isNotNull() for n in columns]))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_SENT else df


def _stride(parts: int) -> int:
    return math.isqrt(parts) + 1


def _cuts(filled: DataFrame, columns: list[str], parts: int, count: int) -> DataFrame:
    """One row with the key ``_e`` and for each column the values (``_cuts0``...) that part its rows into ``parts`` of about one size.

    ``_far0``... are every ``_stride``-th of them.
    """
    lists = [F.sort_array(F.collect_list(c(n))) for n in columns]
    some = filled.sample(min(1.0, SAMPLED * parts / max(1, count)), 7).agg(*[x.alias(f"_cuts{i}") for i, x in enumerate(lists)])

    def each(values: str, step) -> Column:
        return F.filter(F.col(values), lambda x, i: (i > 0) & (F.pmod(i, step) == 0))

    names = [f"_cuts{i}" for i in range(len(columns))]
    some = some.select(*[each(n, F.greatest(F.lit(1), F.ceil(F.size(n) / parts))).alias(n) for n in names])
    far = [F.filter(F.col(n), lambda x, i: F.pmod(i + 1, F.lit(_stride(parts))) == 0).alias(f"_far{i}") for i, n in enumerate(names)]
    return cut(some.select(F.lit(0).cast("long").alias("_e"), *names, *far), "cuts")


def _placed(df: DataFrame, columns: list[str], cuts: DataFrame, places: list[str], parts: int) -> DataFrame:
    """``df`` with the number of the part that each column's value is in, which rises with the value."""
    stride = _stride(parts)

    def after(values: Column, column: str) -> Column:
        return F.size(F.filter(values, lambda x: x <= c(column)))

    joined = df.withColumn("_z", _zero(columns[0])).join(F.broadcast(cuts), F.col("_z") == F.col("_e"))
    own = [c(n) for n in df.columns]
    joined = joined.select("*", *[(after(F.col(f"_far{i}"), n) * stride).alias(f"_from{i}") for i, n in enumerate(columns)])
    at = [F.col(f"_from{i}") + after(F.slice(f"_cuts{i}", F.col(f"_from{i}") + 1, F.lit(stride)), n) for i, n in enumerate(columns)]
    return joined.select(*own, *[x.cast("long").alias(to) for x, to in zip(at, places)])


class _Side:
    """The rows of one side without nulls, in fine blocks that are united step by step."""

    def __init__(self, filled: DataFrame, columns: list[str], block: str, count: int):
        self.block, self.own, self.columns, by = block, filled.columns, columns, columns[:2]
        self.rows = max(BLOCK_ROWS, -(-count // MOST_BLOCKS))
        blocks = max(1, -(-count // self.rows))
        parts = blocks if len(by) == 1 else math.isqrt(blocks - 1) + 1
        self.places = [f"{block}{i}" for i in range(len(by))]
        self.placed = _placed(filled, by, _cuts(filled, by, parts, count), self.places, parts)
        self.most = parts.bit_length() * len(by)
        ends = [f(c(n)).alias(f"{end}{n}") for n in columns for end, f in (("_low", F.min), ("_high", F.max))]
        self.fine = cut(self.placed.groupBy(*self.places).agg(F.count(F.lit(1)).alias(f"{block}n"), *ends), "bounds")

    def _place(self, step: int) -> Column:
        """The number of the block after so many steps, each of which halves the parts of one column; its low 21 bits are free."""
        shifts = [(step + i) // len(self.places) for i in reversed(range(len(self.places)))]
        return reduce(lambda x, y: F.shiftleft(x, 21) + y, [F.shiftright(p, k) for p, k in zip(self.places, shifts)] + [F.lit(0).cast("long")])

    def bounds(self, step: int) -> DataFrame:
        """One row per block: its number, its rows, into how many pieces it is cut, the least and greatest value of each column."""
        n, ends = f"{self.block}n", [f(c(f"{e}{x}")).alias(f"{e}{x}") for x in self.columns for e, f in (("_low", F.min), ("_high", F.max))]
        united = self.fine.groupBy(self._place(step).alias(self.block)).agg(F.sum(n).alias(n), *ends)
        # Many rows of one value cannot be told apart by cuts.
        return united.withColumn(f"{self.block}p", F.ceil(F.col(n) / (2 * self.rows << step)))

    def seated(self, step: int) -> DataFrame:
        """The rows with the number of their block, or of their piece of it."""
        sizes = self.bounds(step).select(F.col(self.block).alias("_at"), F.col(f"{self.block}p").alias("_pieces"))
        number = self._place(step) + F.pmod(row_hash(self.placed.select(*[c(n) for n in self.own])), F.col("_pieces"))
        joined = self.placed.join(F.broadcast(sizes), self._place(step) == F.col("_at"))
        return joined.select(*[c(n) for n in self.own], number.alias(self.block))


class Blocks:
    """Both sides in blocks, and the pairs of blocks that may hold partners (columns ``_lb``, ``_rb``)."""

    def __init__(self, left: DataFrame, right: DataFrame, conditions: Conditions):
        self.test = _holds(conditions)
        lefts, rights = (list(dict.fromkeys(x)) for x in zip(*[(a, b) for a, _, b in conditions]))
        left, right = _filled(left, lefts), _filled(right, rights)
        n, m = left.count(), right.count()
        self.pairs = None
        if max(n, m) <= BLOCK_ROWS:
            self.left, self.right = left.withColumn("_lb", _zero(lefts[0])), right.withColumn("_rb", _zero(rights[0]))
            return
        a, b = _Side(left, lefts, "_lb", n), _Side(right, rights, "_rb", m)
        # A pair may match where its most favourable values do.
        up = {">": True, ">=": True, "<": False, "<=": False}
        may = [(f"{'_high' if up[op] else '_low'}{x}", op, f"{'_low' if up[op] else '_high'}{y}") for x, op, y in conditions]

        def found(step: int) -> DataFrame:
            tables = a.bounds(step).withColumn("_z", _zero("_lb")), b.bounds(step).withColumn("_y", _zero("_rb"))
            return tables[0].join(tables[1], (F.col("_z") == F.col("_y")) & _holds(may))

        copied = F.sum(F.col("_lbn") * F.col("_rbp") + F.col("_rbn") * F.col("_lbp"))
        sums = [F.sum(F.col("_lbp") * F.col("_rbp")), copied, F.sum(F.col("_lbn").cast("double") * F.col("_rbn"))]
        partitions, chosen, sizes = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0, None
        for step in range(max(a.most, b.most) + 1):
            now = [x or 0 for x in found(step).agg(*sums).first()]
            if sizes and now[0] < min(partitions, first):
                break
            chosen, sizes, first = step, now, first if sizes else now[0]
            if now[1] <= max(MOST_COPIES * (n + m), TASK_ROWS):
                break
        self.count = sizes[0]
        self.tasks = max(1, min(self.count, tasks_for(int(sizes[2]))), -(-sizes[1] // TASK_ROWS))
        pieces = [F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{x}p") - 1)).alias(f"{x}i") for x in ("_lb", "_rb")]
        each = found(chosen).select("_lb", "_rb", "_rbp", pieces[0]).select("_lb", "_rb", "_lbi", pieces[1])
        self.pairs = cut(each.select((F.col("_lb") + F.col("_lbi")).alias("_lb"), (F.col("_rb") + F.col("_rbi")).alias("_rb")), "tiles")
        self.left, self.right = a.seated(chosen), b.seated(chosen)

    def meet(self, how: str = "inner") -> DataFrame:
        """Partners (``inner``), or the left rows with one (``left_semi``, once per pair of blocks)."""
        if self.pairs is None:
            return self.left.join(self.right, (F.col("_lb") == F.col("_rb")) & self.test, how).drop("_lb", "_rb")
        # As many tasks as there is to compare: by its bytes Spark would put very many pairs of blocks into one.
        others = _sent(self.pairs.select("_lb", F.col("_rb").alias("_of")), self.count)
        left = self.left.join(others, "_lb").repartition(self.tasks, "_lb", "_of")
        others = _sent(self.pairs.select("_rb", F.col("_lb").alias("_with")), self.count)
        right = self.right.join(others, "_rb").repartition(self.tasks, "_with", "_rb")
        return left.join(right, (F.col("_lb") == F.col("_with")) & (F.col("_of") == F.col("_rb")) & self.test, how).drop("_lb", "_rb", "_of", "_with")


def theta_inner(left: DataFrame, right: DataFrame, conditions: Conditions) -> DataFrame:
    """All pairs of rows for which every (left column, op, right column) holds. The sides share no column name."""
    return Blocks(left, right, conditions).meet()


def theta_unmatched(df: DataFrame, other: DataFrame, conditions: Conditions) -> DataFrame:
    """The rows of ``df`` without a partner; rows with a null in a compared column have none."""
    if len(conditions) == 1:
        # "some partner is smaller (greater)" needs only the smallest (greatest) one: a table of one row.
        a, op, b = conditions[0]
        edge = other.agg((F.min if op in (">", ">=") else F.max)(c(b)).alias("_edge")).select("_edge", _zero("_edge").alias("_e"))
        keyed = df.withColumn("_z", _zero(a))
        return keyed.join(F.broadcast(edge), (F.col("_z") == F.col("_e")) & OPS[op](c(a), c("_edge")), "left_anti").drop("_z")
    if len(conditions) == 2:
        return _unmatched_by_two(df, other, *conditions)
    mine, theirs = (list(dict.fromkeys(x)) for x in zip(*[(a, b) for a, _, b in conditions]))
    blocks = Blocks(df.select(*[c(n) for n in mine]).distinct(), other.select(*[c(n) for n in theirs]).distinct(), conditions)
    named = blocks.meet("left_semi").distinct().select(*[c(n).alias(f"_m{i}") for i, n in enumerate(mine)])
    return df.join(named, reduce(Column.__and__, [c(n) == F.col(f"_m{i}") for i, n in enumerate(mine)]), "left_anti")


def _unmatched_by_two(df: DataFrame, other: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str]) -> DataFrame:
    (a, op, b), (a2, op2, b2) = first, second
    best = F.min if op2 in (">", ">=") else F.max
    # Of rows with one value in the first column, only the best in the second counts.
    others = _filled(other, [b, b2]).select(c(b).alias("_b"), c(b2).alias("_b2"))
    count = others.count()
    parts = max(1, min(MOST_PARTS, -(-count // BLOCK_ROWS)))
    cuts = _cuts(others, ["_b"], parts, count)
    others = _placed(others, ["_b"], cuts, ["_there"], parts)
    # Rows of earlier (later) parts are smaller (greater) in the first column than any row of this one. Nearly as few rows as cuts.
    before = Window.orderBy("_part" if op in (">", ">=") else F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bests = cuts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.size("_cuts0").cast("long"))).alias("_part")).join(
        others.groupBy("_there").agg(best("_b2").alias("_own")), F.col("_part") == F.col("_there"), "left")
    bests = cut(bests.select("_part", "_own", best("_own").over(before).alias("_before")), "bests")
    placed = _placed(df, [a], cuts, ["_here"], parts).join(F.broadcast(bests), F.col("_here") == F.col("_part"))
    sure, may = (c(a).isNotNull() & F.coalesce(OPS[op2](c(a2), F.col(x)), F.lit(False)) for x in ("_before", "_own"))
    own = [c(n) for n in df.columns]
    alone = placed.where(~sure & ~may).select(*own)
    some = others.groupBy("_there", "_b").agg(best("_b2").alias("_b2"))
    # By the number that came with the bests: by the other one Spark would move this join, with all rows, before that one.
    near = (F.col("_part") == F.col("_there")) & OPS[op](c(a), F.col("_b")) & OPS[op2](c(a2), F.col("_b2"))
    return alone.unionByName(placed.where(~sure & may).join(some, near, "left_anti").select(*own))
