"""Parent/child edges to the paths of every node."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import c, require
from sparkprep.session import cut

_CYCLE = "[CYCLE DETECTED]"


def hierarchy_paths(
    df: DataFrame,
    parent: str,
    child: str,
    separator: str = " > ",
    aggregations: Iterable[tuple[str, str]] | None = None,
) -> DataFrame:
    """Every path from a root to each node, with its head node and length; a parent without parents has a row too.

    A node with several parents has several paths. A path that would meet one of its nodes again starts with
    ``<node><separator>[CYCLE DETECTED]``. ``aggregations`` are (field, sum | max | min | mean | count) over the rows of
    the edges on the path, named ``<field>_<function>``.

    Paths grow by doubling: all pieces of one length are joined with the pieces that begin at their top, so the number of
    rounds is the logarithm of the longest path; each round is written before the next one reads it. A piece carries what
    the aggregations need of each of its edges.
    """
    require(df, [parent, child])
    wanted = [(f, fn, re.sub("[^a-zA-Z0-9_]", "_", f"{f}_{fn}")) for f, fn in aggregations or ()]
    require(df, [f for f, _, _ in wanted], "aggregated column")
    wrong = [fn for _, fn, _ in wanted if fn not in ("sum", "max", "min", "mean", "count")]
    if wrong:
        raise ValueError(f"unknown path aggregation {wrong}")
    fields = list(dict.fromkeys(f for f, _, _ in wanted))

    # One row per edge, with what the aggregations need of it.
    asked = {"sum": ("s",), "count": ("n",), "min": ("lo",), "max": ("hi",), "mean": ("s", "n")}
    kept = {i: {k for g, fn, _ in wanted if g == f for k in asked[fn]} for i, f in enumerate(fields)}
    made = {"s": F.sum, "n": F.count, "lo": F.min, "hi": F.max}
    stats = [made[k](c(f)).alias(f"{k}{i}") for i, f in enumerate(fields) for k in made if k in kept[i]]
    stats = stats or [F.count(F.lit(1)).alias("rows")]
    edges = df.where(c(child).isNotNull()).groupBy(c(child).alias("kid"), c(parent).alias("up")).agg(*stats)
    edges = cut(edges if fields else edges.drop("rows"), "edges")
    totals = [f"{k}{i}" for i in range(len(fields)) for k in made if k in kept[i]]

    nodes = edges.select("kid").distinct()
    kinds = {f.name: f.dataType for f in edges.schema.fields}
    # node: where a piece begins; seen: its nodes, the lowest first; at: its top, from which it goes on, null when it is complete;
    # loop: the node it would meet again; and of each edge, from the lowest on, the values to be aggregated.
    first = edges.select(
        F.col("kid").alias("node"), F.array("kid").alias("seen"), F.col("up"), (F.col("up") == F.col("kid")).alias("_self"),
        *[F.array(F.col(t)).alias(t) for t in totals])
    ends = F.col("up").isNull() | F.col("_self")
    none = {t: F.array().cast(T.ArrayType(kinds[t])) for t in totals}
    pieces = first.select(
        "node", F.when(ends, F.col("seen")).otherwise(F.concat("seen", F.array("up"))).alias("seen"), F.when(~ends, F.col("up")).alias("at"),
        F.when(F.col("_self"), F.col("up")).alias("loop"), *[F.when(ends, none[t]).otherwise(F.col(t)).alias(t) for t in totals])
    # A parent that has no edge upwards ends the piece.
    tops = edges.select("up").distinct().join(nodes, F.col("up") == F.col("kid"), "left_anti").select(F.col("up").alias("_top"))
    pieces = pieces.join(tops, F.col("at") == F.col("_top"), "left").withColumn("at", F.when(F.col("_top").isNull(), F.col("at"))).drop("_top")
    pieces = cut(pieces, "paths")
    finished = [pieces.where("at is null")]
    growing = pieces.where("at is not null")
    while not growing.isEmpty():
        above = pieces.select(
            F.col("node").alias("_from"), F.slice("seen", 2, F.size("seen")).alias("_seen"), F.col("at").alias("_at"), F.col("loop").alias("_loop"),
            *[F.col(t).alias(f"_{t}") for t in totals])
        joined = growing.join(above, F.col("at") == F.col("_from"))
        # Where the upper piece first meets a node of the lower one, the path ends with that node.
        meets = F.get(F.array_compact(F.transform("_seen", lambda x, i: F.when(F.array_contains("seen", x), i))), F.lit(0))
        joined = joined.withColumn("_meets", F.when(F.arrays_overlap("seen", "_seen"), meets))
        reach = F.coalesce("_meets", F.size("_seen"))
        closed = F.col("_meets").isNotNull()
        grown = joined.select(
            "node", F.concat("seen", F.slice("_seen", F.lit(1), reach)).alias("seen"), F.when(~closed, F.col("_at")).alias("at"),
            F.when(closed, F.get("_seen", F.col("_meets"))).otherwise(F.col("_loop")).alias("loop"),
            *[F.concat(F.col(t), F.slice(F.col(f"_{t}"), F.lit(1), reach)).alias(t) for t in totals], closed.alias("_closed"))
        pieces = cut(grown, "paths")
        # Upper pieces that part only behind the meeting make one path.
        met = pieces.where("_closed").dropDuplicates(["node", "seen", "loop"])
        pieces = pieces.where("not _closed").unionByName(met).drop("_closed")
        finished.append(pieces.where("at is null"))
        growing = pieces.where("at is not null")
        if not growing.isEmpty():
            # The upper pieces of the next round: those of this length, and the complete ones that are shorter.
            pieces = reduce(DataFrame.unionByName, [*finished[:-1], pieces])
    whole = reduce(DataFrame.unionByName, finished)

    def folded(t: str) -> Column:
        add = {"s": lambda a, x: F.when(a.isNull(), x).when(x.isNull(), a).otherwise(a + x), "l": F.least, "h": F.greatest}
        merge = add["s" if t[0] in "sn" else t[0]]
        return F.aggregate(t, F.lit(None).cast(kinds[t]), lambda a, x: merge(a, x).cast(kinds[t]))

    texts = F.transform(F.reverse("seen"), lambda x: x.cast("string"))
    marked = F.concat(F.array(F.concat(F.col("loop").cast("string"), F.lit(f"{separator}{_CYCLE}"))), texts)
    start = [F.lit(None).cast(kinds[t]).alias(t) for t in totals]
    paths = whole.select("node", F.when(F.col("loop").isNotNull(), marked).otherwise(texts).alias("path"), *[folded(t).alias(t) for t in totals])

    # Parents that are nobody's child.
    roots = edges.select(F.col("up").alias("node")).where("node is not null").distinct()
    roots = roots.join(nodes, F.col("node") == F.col("kid"), "left_anti")
    roots = roots.select("node", F.array(F.col("node").cast("string")).alias("path"), *start)
    paths = paths.unionByName(roots)

    outputs = []
    for f, fn, name in wanted:
        i = fields.index(f)
        value = {
            "sum": lambda: F.coalesce(F.col(f"s{i}"), F.lit(0)), "count": lambda: F.coalesce(F.col(f"n{i}"), F.lit(0)),
            "min": lambda: F.col(f"lo{i}"), "max": lambda: F.col(f"hi{i}"),
            "mean": lambda: F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}")),
        }[fn]()
        outputs.append(value.alias(name))
    return paths.select(
        F.col("node").alias(child),
        F.array_join("path", separator).alias("hierarchy_path"),
        F.col("path")[0].alias("head_node"),
        F.size("path").alias("path_length"),
        *outputs,
    )
