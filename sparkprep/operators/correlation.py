"""Correlation matrices: Pearson, Spearman and Kendall (tau-b), with pairs of values that are both present."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep._columns import NUMERIC, c, free_name, numeric_columns, require
from sparkprep.operators.ordering import running_totals
from sparkprep.session import cut

_EXACT = "decimal(38,0)"


def _value(name: str) -> Column:
    """The column as double, with NaN as missing."""
    return F.nanvl(c(name).cast("double"), F.lit(None).cast("double"))


def correlation_matrix(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    method: str = "pearson",
    min_periods: int = 1,
    index_name: str = "index",
) -> DataFrame:
    """One row and one column per numeric column (or chosen column), null where fewer than ``min_periods`` pairs exist."""
    names = require(df, columns) or numeric_columns(df)
    other = [n for n in names if not isinstance(df.schema[n].dataType, NUMERIC)]
    if other or not names:
        raise ValueError(f"correlation needs numeric columns; not numeric: {other}")
    pairs = list(combinations(names, 2))
    methods = {"pearson": _pearson, "spearman": _spearman, "kendall": _kendall}
    if method not in methods:
        raise ValueError(f"method must be one of {sorted(methods)}")
    # The diagonal pairs a column with itself: 1 if it varies, null if it does not.
    found = _diagonal(df, names)
    if pairs:
        found = found.unionByName(methods[method](df, pairs))
    r = F.when(F.col("n") >= max(min_periods, 1), F.col("r"))
    # Both halves of the matrix from one row per pair, so that nothing is computed twice.
    one, other = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    cells = F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, other))
    both = found.select(F.explode(cells).alias("_c"), r.alias("r")).select("_c.a", "_c.b", "r")
    index = free_name(index_name, names)
    matrix = both.groupBy(F.col("a").alias(index)).agg(*[F.max(F.when(F.col("b") == n, F.col("r"))).alias(n) for n in names])
    position = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    return matrix.orderBy(position[c(index)])


def _diagonal(df: DataFrame, names: list[str]) -> DataFrame:
    stats = []
    for i, n in enumerate(names):
        stats += [F.count(_value(n)).alias(f"_n{i}"), (F.max(_value(n)) > F.min(_value(n))).alias(f"_d{i}")]
    cells = [
        F.struct(
            F.lit(n).alias("a"), F.lit(n).alias("b"), F.col(f"_n{i}").alias("n"),
            F.when(F.col(f"_d{i}"), F.lit(1.0)).alias("r"),
        )
        for i, n in enumerate(names)
    ]
    return df.agg(*stats).select(F.explode(F.array(*cells)).alias("_p")).select("_p.*")


def _pearson(df: DataFrame, pairs) -> DataFrame:
    """All pairs in two passes: centers and ranges of the columns, then products of whole blocks of rows."""
    names = list(dict.fromkeys(n for pair in pairs for n in pair))
    stats = [f(_value(n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("mean", _finite_mean), ("low", F.min), ("high", F.max), ("n", F.count))]
    found = df.agg(F.count(F.lit(1)).alias("rows"), *stats).first()  # one row
    centers = [found[f"mean{i}"] or 0.0 for i in range(len(names))]
    whole = [found[f"n{i}"] == found["rows"] for i in range(len(names))]
    varies = [whole[i] and found[f"low{i}"] != found[f"high{i}"] for i in range(len(names))]
    return _products(df, pairs, names, centers, whole, varies)


def _finite_mean(value: Column) -> Column:
    return F.avg(F.when(F.abs(value) < float("inf"), value))


def _products(df: DataFrame, pairs, names: list[str], centers: list[float], whole: list[bool], varies: list[bool]) -> DataFrame:
    """Correlations from masked cross-products: each batch of rows is a matrix, and a task gives one row per pair of columns.

    Products are taken about ``centers``; where a pair's own rows lie far from these and most digits would be lost, the batch
    goes through that pair again about its own means. Batches and tasks are merged by counts, means and sums about the means.
    ``whole`` columns miss no value, and ``varies`` says whether such a column has two values at all; for the others each pair
    looks at its own rows.
    """
    at = {n: i for i, n in enumerate(names)}
    left, right = [np.array(x) for x in zip(*[(at[a], at[b]) for a, b in pairs])]
    center = np.array(centers)
    open_ = [p for p, (i, j) in enumerate(zip(left, right)) if not (whole[i] and whole[j])]
    fields = ["n", "x", "y", "xx", "yy", "xy", "odd"]

    def batch_sums(values: np.ndarray, ends: dict) -> np.ndarray:
        present, finite = ~np.isnan(values), np.isfinite(values)
        x, m = np.where(finite, values - center, 0.0), present.astype(float)
        odd = (present & ~finite).astype(float).T @ m
        n, sums, squares, cross = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
        size, sx, sy, xx, yy = n[left, right], sums[left, right], sums[right, left], squares[left, right], squares[right, left]
        some = np.maximum(size, 1)
        out = np.stack([size, center[left] + sx / some, center[right] + sy / some, xx - sx * sx / some, yy - sy * sy / some, cross[left, right] - sx * sy / some, (odd + odd.T)[left, right]])
        lost = set(np.flatnonzero((size > 0) & ((out[3] < 1e-6 * xx) | (out[4] < 1e-6 * yy))).tolist())
        for p in {*open_, *lost}:
            both = present[:, left[p]] & present[:, right[p]]
            if not both.any():
                continue
            u, v = values[both, left[p]], values[both, right[p]]
            if p in ends:
                e = ends[p]
                ends[p] = [min(e[0], u.min()), max(e[1], u.max()), min(e[2], v.min()), max(e[3], v.max())]
            if p in lost and np.isfinite(u).all() and np.isfinite(v).all():
                du, dv = u - u.mean(), v - v.mean()
                out[1:6, p] = u.mean(), v.mean(), du @ du, dv @ dv, du @ dv
        return out

    def multiply(batches):
        total, ends = np.zeros((len(fields), len(pairs))), {p: [np.inf, -np.inf, np.inf, -np.inf] for p in open_}
        for b in batches:
            if not b.num_rows:
                continue
            new = batch_sums(np.stack([col.to_numpy(zero_copy_only=False).astype(float) for col in b.columns], axis=1), ends)
            n = total[0] + new[0]
            share = np.divide(new[0], n, out=np.zeros(len(n)), where=n > 0)
            dx, dy, weight = new[1] - total[1], new[2] - total[2], total[0] * share
            total = np.stack([n, total[1] + dx * share, total[2] + dy * share, total[3] + new[3] + dx * dx * weight,
                              total[4] + new[4] + dy * dy * weight, total[5] + new[5] + dx * dy * weight, total[6] + new[6]])
        limits = np.array([ends.get(p, [0.0, 0.0, 0.0, 0.0]) for p in range(len(pairs))]).T
        columns = [pa.array(np.arange(len(pairs)), pa.int32()), *[pa.array(t) for t in total], *[pa.array(t) for t in limits]]
        yield pa.RecordBatch.from_arrays(columns, ["p", *fields, "x0", "x1", "y0", "y1"])

    schema = "p int, " + ", ".join(f"{f} double" for f in [*fields, "x0", "x1", "y0", "y1"])
    made = cut(df.select(*[_value(n).alias(f"v{i}") for i, n in enumerate(names)]).mapInArrow(multiply, schema).where("n > 0"), "products")
    size = F.sum("n")
    middle = made.groupBy(F.col("p").alias("_p")).agg((F.sum(F.col("n") * F.col("x")) / size).alias("_x"), (F.sum(F.col("n") * F.col("y")) / size).alias("_y"))
    placed = made.join(F.broadcast(middle), F.col("p") == F.col("_p"))  # one row per pair of columns
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    summed = placed.groupBy("p").agg(
        size.alias("n"), F.sum(F.col("xx") + F.col("n") * dx * dx).alias("xx"), F.sum(F.col("yy") + F.col("n") * dy * dy).alias("yy"),
        F.sum(F.col("xy") + F.col("n") * dx * dy).alias("xy"), F.sum("odd").alias("odd"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    two = [F.lit(bool(varies[i] and varies[j])) if whole[i] and whole[j] else (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) for i, j in zip(left, right)]
    xx, yy = F.greatest("xx", F.lit(0.0)), F.greatest("yy", F.lit(0.0))
    r = F.try_divide(F.col("xy"), F.sqrt(xx) * F.sqrt(yy))
    # A constant column has no correlation; an infinite value leaves none that is a number.
    r = F.when(F.array(*two)[F.col("p")], F.when(F.col("odd") > 0, F.lit(float("nan"))).otherwise(r))
    return summed.select(*_names(pairs), F.col("n").cast("long").alias("n"), r.alias("r"))


def _names(pairs) -> list[Column]:
    """The names of pair ``p``."""
    return [F.array(*[F.lit(pair[side]) for pair in pairs])[F.col("p")].alias("ab"[side]) for side in (0, 1)]


def _pair_counts(df: DataFrame, pairs) -> DataFrame:
    """p, x, y, n: how often each pair of values occurs in pair of columns ``p``, counted on the map side first.

    The number of the pair stands for its two names, to keep the many rows short and quick to compare.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(p).alias("p"), _value(a).alias("x"), _value(b).alias("y")
            )
            for p, (a, b) in enumerate(pairs)
        ]
    )
    long = df.select(F.explode(cells).alias("_p")).select("_p.*").where("x is not null and y is not null")
    return cut(long.groupBy("p", "x", "y").agg(F.count(F.lit(1)).alias("n")), "pairs")


def _ranked(counts: DataFrame) -> DataFrame:
    """rank_x and rank_y: average ranks of the values, in their pair of columns."""
    for value in ("x", "y"):
        marginal = counts.groupBy("p", value).agg(F.sum("n").alias("_t"))
        ranks = running_totals(marginal, ["p"], [value], {"_before": "_t"}, distinct_order=True).select(
            F.col("p").alias("_p"), F.col(value).alias("_value"),
            (F.col("_before") + (F.col("_t") + 1) / 2).alias(f"rank_{value}"),
        )
        on = (F.col("p") == F.col("_p")) & (F.col(value) == F.col("_value"))
        # As many ranks as values: too many to broadcast on the word of a compressed file size.
        counts = counts.join(ranks.hint("shuffle_hash"), on).drop("_p", "_value")
    return counts


def _spearman(df: DataFrame, pairs) -> DataFrame:
    """Pearson over average ranks. Columns without a missing value are ranked once; pairs with one are ranked among the
    rows where both values are present."""
    names = list(dict.fromkeys(n for pair in pairs for n in pair))
    present = df.agg(F.count(F.lit(1)), *[F.count(_value(n)) for n in names]).first()
    whole = {n for i, n in enumerate(names, 1) if present[i] == present[0]}
    complete = [pair for pair in pairs if set(pair) <= whole]
    others = [pair for pair in pairs if pair not in complete]
    if not complete:
        return _spearman_of_pairs(df, others)
    found = _spearman_of_complete(df, complete)
    return found.unionByName(_spearman_of_pairs(df, others)) if others else found


def _spearman_of_complete(df: DataFrame, pairs) -> DataFrame:
    """Each value is replaced by its rank in its column; rows times columns are moved, not rows times pairs."""
    names = list(dict.fromkeys(n for pair in pairs for n in pair))
    # The number of a row only has to be the same on both ways to it, so it is written with the values.
    rows = cut(
        df.select(F.monotonically_increasing_id().alias("row"), *[_value(n).alias(f"v{i}") for i, n in enumerate(names)]),
        "rows",
    )
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"v{i}").alias("v")) for i in range(len(names))])
    long = rows.select("row", F.explode(cells).alias("_c")).select("row", "_c.k", "_c.v")
    counted = cut(long.groupBy("k", "v").agg(F.count(F.lit(1)).alias("_t")), "values")
    ranks = running_totals(counted, ["k"], ["v"], {"_before": "_t"}, distinct_order=True)
    ranks = ranks.select("k", "v", (F.col("_before") + (F.col("_t") + 1) / 2).alias("rank"))
    ranked = long.join(ranks.hint("shuffle_hash"), ["k", "v"])
    wide = ranked.groupBy("row").agg(*[F.max(F.when(F.col("k") == i, F.col("rank"))).alias(n) for i, n in enumerate(names)])
    # Ranks have a known center, and a column of one value has that rank in every row.
    many = counted.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("_t").alias("rows")).collect()  # one row per column
    sizes = {r["k"]: r for r in many}
    varies = [i in sizes and sizes[i]["n"] > 1 for i in range(len(names))]
    middle = (many[0]["rows"] + 1) / 2 if many else 0.0
    return _products(wide, pairs, names, [middle] * len(names), [True] * len(names), varies)


def _spearman_of_pairs(df: DataFrame, pairs) -> DataFrame:
    """The ranks of each pair of columns."""
    counts = _pair_counts(df, pairs)
    sizes = counts.groupBy(F.col("p").alias("_p")).agg(F.sum("n").alias("_size"))  # one row per pair of columns
    counts = _ranked(counts)
    # Ranks relative to the middle rank (n + 1) / 2, so that the sums keep their precision.
    placed = counts.join(F.broadcast(sizes), F.col("p") == F.col("_p"))
    middle = (F.col("_size") + 1) / 2
    dx, dy = F.col("rank_x") - middle, F.col("rank_y") - middle
    sums = placed.groupBy("p").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * dx * dy).alias("_xy"),
        F.sum(F.col("n") * dx * dx).alias("_xx"),
        F.sum(F.col("n") * dy * dy).alias("_yy"),
    )
    spread = F.col("_xx") * F.col("_yy")
    return sums.select(*_names(pairs), "n", F.when(spread > 0, F.col("_xy") / F.sqrt(spread)).alias("r"))


def _kendall(df: DataFrame, pairs) -> DataFrame:
    """tau-b without listing pairs of rows.

    The y values are numbered 0, 1, 2... Two numbers differ first at some bit, and above it they agree. So at each
    bit the rows fall into groups by the bits above, and in a group, in the order of x, a row with the bit set is
    concordant with the earlier rows that have it clear, and the other way round discordant. That is one running
    total over (bit, group) for all bits together: rows times the number of bits, never rows times rows.
    """
    counts = _pair_counts(df, pairs)
    marginal = counts.groupBy("p", "y").agg(F.sum("n").alias("_t"), F.lit(1).alias("_one"))
    numbered = running_totals(marginal, ["p"], ["y"], {"_rank": "_one"}, distinct_order=True)
    numbered = numbered.select(
        F.col("p").alias("_p"), F.col("y").alias("_y"), F.col("_rank").cast("bigint")
    )
    on = (F.col("p") == F.col("_p")) & (F.col("y") == F.col("_y"))
    ranked = cut(counts.join(numbered, on).select("p", "x", "y", "n", "_rank"), "ranks")
    top = ranked.agg(F.max("_rank")).first()[0] or 0
    bits = max(int(top).bit_length(), 1)
    spread = ranked.select("p", "x", "n", "_rank", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("_bit"))
    is_set = F.expr("shiftright(_rank, _bit) & 1") == 1
    grouped = spread.groupBy("p", "_bit", F.expr("shiftright(_rank, _bit + 1)").alias("_above"), "x").agg(
        F.sum(F.when(is_set, F.col("n")).otherwise(0)).alias("_ones"),
        F.sum(F.when(is_set, 0).otherwise(F.col("n"))).alias("_zeros"),
    )
    totals = {"_ones_before": "_ones", "_zeros_before": "_zeros"}
    running = running_totals(grouped, ["p", "_bit", "_above"], ["x"], totals, distinct_order=True)

    def product(left: str, right: str):
        return F.sum((F.col(left).cast("decimal(19,0)") * F.col(right).cast("decimal(18,0)")).cast(_EXACT)).cast(_EXACT)

    agreement = running.groupBy("p").agg(
        product("_ones", "_zeros_before").alias("_concordant"), product("_zeros", "_ones_before").alias("_discordant")
    )

    def ties(frame: DataFrame, keys: list[str], name: str) -> DataFrame:
        t = F.col("_t").cast("decimal(19,0)")
        same = frame.groupBy("p", *keys).agg(F.sum("n").alias("_t"))
        return same.groupBy("p").agg((F.sum((t * (t - 1)).cast(_EXACT)) / 2).cast("double").alias(name))

    result = agreement
    for keys, name in (([], "_pairs"), (["x"], "_ties_x"), (["y"], "_ties_y")):
        result = result.join(F.broadcast(ties(ranked, keys, name)), "p")  # one row per pair of columns
    sizes = ranked.groupBy("p").agg(F.sum("n").alias("n"))
    result = result.join(F.broadcast(sizes), "p")
    room = (F.col("_pairs") - F.col("_ties_x")) * (F.col("_pairs") - F.col("_ties_y"))
    excess = (F.col("_concordant") - F.col("_discordant")).cast("double")
    return result.select(*_names(pairs), "n", F.when(room > 0, excess / F.sqrt(room)).alias("r"))
