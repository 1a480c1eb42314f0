"""Data profiling: summary statistics, value frequencies, unique keys, schema and preview."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import NUMERIC, c, require
from sparkprep.operators.ordering import exact_quantiles, running_totals
from sparkprep.session import cut

_STATS = [
    "type", "count", "unique", "most freq value", "max freq", "least freq value", "min", "max", "mean", "std",
    "avg_length", "min_length", "max_length", "shortest", "longest", "25%", "50%", "75%",
]


def _value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """field_name, field_value (as text), frequency - one pass and one partial aggregate for all columns, nulls kept."""
    cells = F.array(
        *[F.struct(F.lit(n).alias("field_name"), c(n).cast("string").alias("field_value")) for n in columns]
    )
    long = df.select(F.explode(cells).alias("_cell")).select("_cell.field_name", "_cell.field_value")
    return long.groupBy("field_name", "field_value").agg(F.count(F.lit(1)).alias("frequency"))


def summary(df: DataFrame, columns: str | Iterable[str] = "all", layout: str = "rows") -> DataFrame:
    """One row of statistics per column (or, with ``layout='columns'``, one row per statistic).

    ``columns``: all, numerical, categorical (text) or a list of names. Ties for the most and least frequent value and
    for the shortest and longest text go to the smallest value. Quartiles are exact.
    """
    if layout not in ("rows", "columns"):
        raise ValueError("layout must be 'rows' or 'columns'")
    if columns == "all":
        names = df.columns
    elif columns == "numerical":
        names = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    elif columns == "categorical":
        names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    else:
        names = require(df, columns)
    if not names:
        raise ValueError("summary has no columns to describe")
    df = df.select(*[c(n) for n in names])
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [n for n in names if isinstance(types[n], NUMERIC)]

    # One wide aggregate over the table; its single row is unfolded into one row per column.
    aggregates, unfolded = [], []
    for i, n in enumerate(names):
        cell, text = c(n), c(n).cast("string")
        parts = {"count": F.count(cell), "min": F.min(cell).cast("string"), "max": F.max(cell).cast("string")}
        if n in numeric:
            parts |= {"mean": F.avg(cell.cast("double")), "std": F.stddev_samp(cell.cast("double"))}
        if isinstance(types[n], T.StringType):
            size = F.char_length(text).cast("bigint")
            parts |= {
                "avg_length": F.avg(size), "min_length": F.min(size), "max_length": F.max(size),
                "shortest": F.min_by(text, F.when(text.isNotNull(), F.struct(size, text))),
                "longest": F.min_by(text, F.when(text.isNotNull(), F.struct(-size, text))),
            }
        aggregates += [expr.alias(f"_{key}{i}") for key, expr in parts.items()]
        row = [F.lit(n).alias("field_name"), F.lit(types[n].simpleString()).alias("type")]
        for key, kind in _STAT_TYPES.items():
            row.append((c(f"_{key}{i}") if key in parts else F.lit(None)).cast(kind).alias(key))
        unfolded.append(F.struct(*row))
    wide = df.agg(*aggregates)
    base = wide.select(F.explode(F.array(*unfolded)).alias("_s")).select("_s.*")

    counts = _value_counts(df, names).where(F.col("field_value").isNotNull())
    modes = counts.groupBy("field_name").agg(
        F.count(F.lit(1)).alias("unique"),
        F.min_by("field_value", F.struct(-F.col("frequency"), F.col("field_value"))).alias("most freq value"),
        F.max("frequency").alias("max freq"),
        F.min_by("field_value", F.struct(F.col("frequency"), F.col("field_value"))).alias("least freq value"),
    )
    result = base.join(F.broadcast(modes), "field_name", "left")  # one row per column of the table
    if numeric:
        quartiles = exact_quantiles(df, [], numeric, [0.25, 0.5, 0.75]).withColumnRenamed("field", "field_name")
        result = result.join(F.broadcast(quartiles), "field_name", "left")
    else:
        result = result.withColumn("quantiles", F.lit(None).cast("array<double>"))
    picks = {"25%": F.col("quantiles")[0], "50%": F.col("quantiles")[1], "75%": F.col("quantiles")[2]}
    filled = {"unique": F.coalesce(c("unique"), F.lit(0)), "max freq": F.coalesce(c("max freq"), F.lit(0))}
    result = result.select("field_name", *[(picks | filled).get(s, c(s)).alias(s) for s in _STATS])
    if layout == "rows":
        return result
    # As many rows as the table has columns, so the transposition is a small aggregate.
    stats = F.array(*[F.struct(F.lit(s).alias("stat"), c(s).cast("string").alias("value")) for s in _STATS])
    long = result.select("field_name", F.explode(stats).alias("_x")).select("field_name", "_x.stat", "_x.value")
    return long.groupBy("stat").agg(
        *[F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n in names]
    )


_STAT_TYPES = {
    "count": "bigint", "min": "string", "max": "string", "mean": "double", "std": "double", "avg_length": "double",
    "min_length": "bigint", "max_length": "bigint", "shortest": "string", "longest": "string",
}


def frequencies(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Per column and value (nulls too): frequency, percent and both cumulated by falling frequency, then value."""
    names = require(df, columns) or df.columns
    counts = cut(_value_counts(df, names), "frequencies")
    ordered = [("frequency", "desc"), "field_value"]
    running = running_totals(counts, ["field_name"], ordered, {"_before": "frequency"}, distinct_order=True)
    # Each field has one value per row of the table, so the total of one field is the total of all; it is one row.
    total = counts.where(F.col("field_name") == names[0]).agg(F.sum("frequency").alias("_total"))
    through = F.col("_before") + F.col("frequency")
    return running.crossJoin(F.broadcast(total)).select(
        "field_name",
        "field_value",
        "frequency",
        (F.col("frequency") / F.col("_total") * 100.0).alias("percent"),
        through.alias("cumulative_frequency"),
        (through / F.col("_total") * 100.0).alias("cumulative_percent"),
    )


def unique_keys(df: DataFrame, columns: Iterable[str] | None = None, max_fields: int = 1) -> DataFrame:
    """All combinations of up to ``max_fields`` columns (0 = no limit) whose values identify the rows; nulls are equal.

    Returns number_of_fields and field_combination (array). Two exact rules save work: a combination that holds a
    unique one is unique, and one whose columns have too few distinct values between them cannot be. The others of one
    size are looked at together: (combination, 64-bit hash of its values) is counted, first for the 1/64 of the hashes with a
    certain remainder, then for all, and a hash that repeats is looked up by the values themselves.
    """
    names = require(df, columns) or df.columns
    largest = max_fields if max_fields > 0 else len(names)
    spark = df.sparkSession
    schema = "number_of_fields int, field_combination array<string>"

    def distinct(combos: list[tuple[str, ...]], extra: list[Column] = ()) -> Row:
        # A struct counts null as a value.
        counted = [F.count_distinct(F.struct(*[c(n) for n in combo])).alias(f"_{i}") for i, combo in enumerate(combos)]
        return df.agg(*counted, *extra).first()

    def hashed(combo: tuple[str, ...]) -> Column:
        # A null adds nothing to a hash, so which values are null is hashed too.
        return F.xxhash64(*[c(n) for n in combo], F.concat(*[c(n).isNull().cast("string") for n in combo]))

    def without_repeats(combos: list[tuple[str, ...]], share: int) -> list[tuple[str, ...]]:
        """The combinations without a value that repeats, among the values with one of ``share`` hashes."""
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), hashed(combo).alias("h")) for i, combo in enumerate(combos)]))
        counts = df.select(cells.alias("_c")).select("_c.i", "_c.h").where(F.pmod("h", F.lit(share)) == 0).groupBy("i", "h").count()
        again = {r["i"]: r["h"] for r in counts.where("count > 1").groupBy("i").agg(F.min("h").alias("h")).collect()}  # one row per combination
        if not again:
            return combos
        # The values behind one repeated hash of each combination, counted themselves.
        hits = [
            F.when(hashed(combos[i]) == h, F.struct(F.lit(i).alias("i"), F.to_json(F.struct(*[c(n) for n in combos[i]]), {"ignoreNullFields": "false"}).alias("v")))
            for i, h in again.items()
        ]
        behind = df.select(F.explode(F.array_compact(F.array(*hits))).alias("_c")).select("_c.i", "_c.v").groupBy("i", "v").count()
        most = {r["i"]: r["n"] for r in behind.groupBy("i").agg(F.max("count").alias("n")).collect()}
        # Different values with one hash tell nothing: that combination is counted by its values.
        unsure = [combos[i] for i in again if most[i] == 1]
        counted = distinct(unsure, [F.count(F.lit(1)).alias("_rows")]) if unsure else None
        unsure = [combo for i, combo in enumerate(unsure) if counted[i] == counted["_rows"]]
        return [combo for i, combo in enumerate(combos) if i not in again or combo in unsure]

    singles = [(n,) for n in names]
    counts = distinct(singles, [F.count(F.lit(1)).alias("_rows")])
    rows = counts["_rows"]
    values = {n: counts[i] for i, n in enumerate(names)}
    unique = [combo for i, combo in enumerate(singles) if counts[i] == rows]
    found = list(unique)
    for size in range(2, largest + 1):
        open_combos, level = [], []
        for combo in combinations(names, size):
            reach = 1
            for n in combo:
                reach *= values[n]
            if any(set(u) <= set(combo) for u in unique):
                level.append(combo)
            elif reach >= rows:
                open_combos.append(combo)
        for share in (64, 1):
            open_combos = without_repeats(open_combos, share) if open_combos else []
        unique += open_combos
        level += open_combos
        found += sorted(level, key=lambda combo: [names.index(n) for n in combo])
    return spark.createDataFrame([(len(combo), list(combo)) for combo in found], schema)


def schema_table(df: DataFrame) -> DataFrame:
    """Name, type, nullability and position of each column."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column string, type string, nullable boolean, position int")


def preview(df: DataFrame, n: int = 10, fmt: str = "rows"):
    """The first ``n`` rows, for a console: a list of Rows, CSV text or a text table."""
    rows = df.limit(n).collect()
    if fmt == "rows":
        return rows
    if fmt not in ("csv", "text"):
        raise ValueError("fmt must be 'rows', 'csv' or 'text'")
    table = [df.columns, *[["" if v is None else str(v) for v in row] for row in rows]]
    if fmt == "csv":
        def cell(text: str) -> str:
            return '"' + text.replace('"', '""') + '"' if any(ch in text for ch in ',"\n\r') else text

        return "\n".join(",".join(cell(t) for t in line) for line in table)
    widths = [max(len(line[i]) for line in table) for i in range(len(df.columns))]
    return "\n".join("  ".join(t.ljust(w) for t, w in zip(line, widths)).rstrip() for line in table)
