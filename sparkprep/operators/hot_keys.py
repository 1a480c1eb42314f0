"""Inner and left joins by equality and a further test, where few keys make most pairs of rows.

Spark sizes and splits the tasks of a join by the bytes that go in. Where each key has many rows on both sides, what has to be
compared (and comes out) grows with the product of the two counts, and a few megabytes can be hours of one task's work. So
the pairs of each key are counted first. Keys with more than ``HOT_PAIRS`` are cut into blocks of about ``BLOCK_ROWS`` rows on each
side, each pair of blocks is a key of its own, and there are as many tasks as the number of pairs asks for. All other keys
together have at most a fixed multiple of the rows in pairs and are left to Spark.

A row is copied to each block of the other side. With blocks of one size the copies would grow with the square of the rows, and so
would the shuffle; so the blocks double, up to ``MOST_DOUBLINGS`` times, while there are more than ``MOST_COPIES`` copies of a row (and
more than ``TASK_ROWS`` in all) and still a pair of blocks for each shuffle partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import c
from sparkprep.session import cut

HOT_PAIRS = 1 << 16  # of a key
BLOCK_ROWS = 8192
TASK_PAIRS = 1 << 25
TASK_ROWS = 1 << 20
MOST_TASKS = 20_000
MOST_COPIES = 1.25  # of a row, in the mean
MOST_DOUBLINGS = 7
MOST_SENT = 1 << 16  # hot keys that are sent to all tasks


def tasks_for(pairs: int) -> int:
    """The number of tasks for so many pairs of rows."""
    return max(1, min(MOST_TASKS, -(-pairs // TASK_PAIRS)))


def _same(pairs: list[tuple[str, str]], match: bool) -> Column:
    return reduce(Column.__and__, [c(a).eqNullSafe(c(b)) if match else c(a) == c(b) for a, b in pairs])


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _one_kind(left: DataFrame, right: DataFrame, equal: list[tuple[str, str]]) -> bool:
    """Whether equal keys are equal values: a key converted to meet others may equal several of them."""
    kinds = [(left.schema[a].dataType, right.schema[b].dataType) for a, b in equal]
    return all(x == y or (isinstance(x, _WHOLE) and isinstance(y, _WHOLE)) for x, y in kinds)


def _seat(df: DataFrame) -> Column:
    """A hash of the row, of all columns that can be hashed."""
    kinds = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return F.xxhash64(F.lit(7), *[c(n) for n, kind in kinds if "map<" not in kind and "variant" not in kind])


def _hot_keys(left: DataFrame, right: DataFrame, equal: list[tuple[str, str]], match: bool) -> DataFrame:
    """The hot keys as both sides write them (``_a0``..., ``_b0``...), a number, their rows on each side and their pairs."""
    lefts = left.groupBy(*[c(a).alias(f"_a{i}") for i, (a, _) in enumerate(equal)]).agg(F.count(F.lit(1)).alias("_ln"))
    rights = right.groupBy(*[c(b).alias(f"_b{i}") for i, (_, b) in enumerate(equal)]).agg(F.count(F.lit(1)).alias("_rn"))
    both = lefts.join(rights, _same([(f"_a{i}", f"_b{i}") for i in range(len(equal))], match))
    pairs = F.col("_ln").cast("double") * F.col("_rn")
    hot = both.where(pairs > HOT_PAIRS).select("*", pairs.alias("_pairs"))
    return cut(hot.withColumn("_hot", F.monotonically_increasing_id()), "hot-keys")


def fitting(counts: list[tuple[float, float]], rows: float, partitions: int) -> int:
    """How often blocks double: ``counts`` are (rows with their copies, pairs of blocks) of each size, the smallest first."""
    best = 0
    for i, (copied, cells) in enumerate(counts):
        if i and cells < min(partitions, counts[0][1]):
            break
        best = i
        if copied <= max(MOST_COPIES * rows, TASK_ROWS):
            break
    return best


def join_by_pairs(
    left: DataFrame, right: DataFrame, equal: list[tuple[str, str]], rest: Column, match: bool = False, hint: str | None = None,
    how: str = "inner",
) -> DataFrame:
    """The join of two sides without a common column name, on equal keys (nulls meet if ``match``) and ``rest``.

    ``how="left"`` keeps the left rows without a partner; a left row then has one copy only, and the right side of a key one block.
    """
    def plain(some: DataFrame, others: DataFrame) -> DataFrame:
        return some.join(others.hint(hint) if hint else others, _same(equal, match) & rest, how)

    if not _one_kind(left, right, equal):
        return plain(left, right)
    hot = _hot_keys(left, right, equal, match)

    def blocks(count: str, size: int) -> Column:
        return F.lit(1) if how == "left" and count == "_rn" else F.ceil(F.col(count) / size).cast("int")

    sizes = [BLOCK_ROWS << i for i in range(MOST_DOUBLINGS + 1)]
    counts = [x for size in sizes for x in (
        F.sum(F.col("_ln") * blocks("_rn", size) + F.col("_rn") * blocks("_ln", size)), F.sum(blocks("_ln", size).cast("double") * blocks("_rn", size)))]
    keys, pairs, rows, *counts = hot.agg(F.count(F.lit(1)), F.sum("_pairs"), F.sum(F.col("_ln") + F.col("_rn")), *counts).first()
    if pairs is None or pairs <= TASK_PAIRS:
        return plain(left, right)
    counts = list(zip(counts[::2], counts[1::2]))
    doubled = fitting(counts, rows, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size, (copied, cells) = sizes[doubled], counts[doubled]
    n = max(min(tasks_for(int(pairs)), int(cells)), min(MOST_TASKS, -(-int(copied) // TASK_ROWS)))
    on_each = [blocks("_ln", size), blocks("_rn", size)]
    lefts = hot.select(*[f"_a{i}" for i in range(len(equal))], "_hot", *[x.alias(to) for x, to in zip(on_each, ("_lblocks", "_rblocks"))])
    rights = hot.select(*[f"_b{i}" for i in range(len(equal))], F.col("_hot").alias("_of"), *[x.alias(to) for x, to in zip(on_each, ("_ls", "_rs"))])
    if keys <= MOST_SENT:
        lefts, rights = F.broadcast(lefts), F.broadcast(rights)
    on_left = _same([(a, f"_a{i}") for i, (a, _) in enumerate(equal)], match)
    on_right = _same([(b, f"_b{i}") for i, (_, b) in enumerate(equal)], match)
    # A row goes to one block of its own side and meets every block of the other one.
    at_left, at_right = (F.pmod(_seat(side), c(blocks)).cast("int")
                         for side, blocks in ((left, "_lblocks"), (right, "_rs")))
    lows = left.join(lefts, on_left).select(
        *[c(x) for x in left.columns], "_hot", at_left.alias("_lb"), F.explode(F.sequence(F.lit(0), F.col("_rblocks") - 1)).alias("_rb"))
    highs = right.join(rights, on_right).select(
        *[c(x) for x in right.columns], "_of", at_right.alias("_mine"), F.explode(F.sequence(F.lit(0), F.col("_ls") - 1)).alias("_theirs"))
    lows, highs = lows.repartition(n, "_hot", "_lb", "_rb"), highs.repartition(n, "_of", "_theirs", "_mine")
    at = (F.col("_hot") == F.col("_of")) & (F.col("_lb") == F.col("_theirs")) & (F.col("_rb") == F.col("_mine"))
    met = lows.join(highs, at & rest, how).drop("_hot", "_lb", "_rb", "_of", "_theirs", "_mine")
    return met.unionByName(plain(left.join(lefts, on_left, "left_anti"), right.join(rights, on_right, "left_anti")))
