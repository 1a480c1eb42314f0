"""File sinks, and payload columns for deliveries made by the user's own function."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import NUMERIC, as_list, c, require

_MODES = {"write": "overwrite", "exclusive": "errorifexists", "append": "append"}


def _mode(mode: str) -> str:
    if mode not in _MODES:
        raise ValueError(f"mode must be one of {sorted(_MODES)}, not {mode!r}")
    return _MODES[mode]


def write_csv(
    df: DataFrame, path: str, separator: str = ",", mode: str = "write", quoting: str = "minimal", header: bool = True, **options
) -> None:
    """A folder of CSV files. ``mode``: write (replace), exclusive (must not exist), append. ``quoting``: minimal, all,
    nonnumeric (every cell that is no number) or none."""
    if quoting not in ("minimal", "all", "nonnumeric", "none"):
        raise ValueError("quoting must be minimal, all, nonnumeric or none")
    if quoting == "nonnumeric":
        # The cells are quoted here, and the writer is told not to quote. The header follows as the first line.
        def cell(text: Column) -> Column:
            return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))

        cells = []
        for f in df.schema.fields:
            text = F.coalesce(c(f.name).cast("string"), F.lit(""))
            cells.append(text if isinstance(f.dataType, NUMERIC) else cell(text))
        names = ['"' + n.replace('"', '""') + '"' for n in df.columns]
        lines = df.select(F.concat_ws(separator, *cells).alias(separator.join(names)))
        writer = lines.write.mode(_mode(mode)).option("sep", "\u0001").option("quote", "\u0000")
        writer.option("header", str(header).lower()).option("escape", "\u0000").options(**options).csv(path)
        return
    writer = df.write.mode(_mode(mode)).option("sep", separator).option("header", str(header).lower()).option("escape", '"')
    if quoting == "all":
        writer = writer.option("quoteAll", "true")
    elif quoting == "none":
        writer = writer.option("quote", "\u0000")
    writer.options(**options).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "write", orient: str | None = None, index: str | None = None, **options) -> None:
    """A folder of JSON files. Null fields are written, so that all columns come back.

    By default one record stands on each line. With ``orient`` (records, columns, index, split, table) each part is one whole
    document of that layout, and all parts list the same columns; ``read_json(..., orient, lines=False)`` reads them back. ``index``
    names the column with the row labels of columns, index and split; without it rows are labelled by numbers that no two
    parts share (split: by none). ``columns`` turns a part around in memory, so keep its parts at a task's size.
    """
    if orient is not None and not df.columns:
        raise ValueError("a JSON document needs columns")
    if orient is None:
        df.write.mode(_mode(mode)).options(**{"ignoreNullFields": "false"} | options).json(path)
        return
    if orient not in ("records", "columns", "index", "split", "table"):
        raise ValueError(f"unknown JSON orient {orient!r}")
    if index is not None:
        require(df, [index], "index column")
    names = [n for n in df.columns if n != index or orient in ("records", "table")]
    label = c(index).cast("string") if index else F.monotonically_increasing_id().cast("string")
    cells = {"columns": [_json_text(c(n)) for n in names], "split": [F.concat(F.lit("["), F.concat_ws(",", *[_json_text(c(n)) for n in names]), F.lit("]"))]}
    whole = [F.to_json(F.struct(*[c(n) for n in names]), {"ignoreNullFields": "false"})]
    texts = df.select(_json_text(F.coalesce(label, F.lit("null"))).alias("label"), *[x.alias(f"v{i}") for i, x in enumerate(cells.get(orient, whole))])
    heads = {
        "records": ("[", "]"), "index": ("{", "}"), "columns": ("{", "}"), "split": (f'{{"columns":{json.dumps(names)},"data":[', "]"),
        "table": (f'{{"schema":{{"fields":{json.dumps([{"name": f.name, "type": _json_kind(f.dataType)} for f in df.schema.fields])}}},"data":[', "]}"),
    }
    begin, end = heads[orient]
    with_labels = index is not None

    def lines(texts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"value": texts}, schema=pa.schema([("value", pa.string())]))

    def document(batches):
        first, labels, columns = True, [], [[] for _ in names]
        for b in batches:
            if not b.num_rows:
                continue
            if orient == "columns":
                for kept, values in zip(columns, b.columns[1:]):
                    kept.append(pc.binary_join_element_wise(b.column(0), values, ":"))
                continue
            rows = pc.binary_join_element_wise(b.column(0), b.column(1), ":") if orient == "index" else b.column(1)
            if orient == "split" and with_labels:
                labels.append(b.column(0))
            rows = rows.to_pylist()
            yield lines([(begin if first and not i else ",") + text for i, text in enumerate(rows)])
            first = False
        if orient == "columns" and columns and columns[0]:
            for i, (name, kept) in enumerate(zip(names, columns)):
                yield lines([(begin if not i else ",") + json.dumps(name) + ":{"])
                for j, values in enumerate(kept):
                    yield lines([("," if j or k else "") + text for k, text in enumerate(values.to_pylist())])
                yield lines(["}"])
            yield lines([end])
        if first:
            return
        if orient == "split":
            tail = ["}"] if not with_labels else [',"index":[', ",".join(x for part in labels for x in part.to_pylist()), "]}"]
            yield lines(["]" + tail[0], *tail[1:]])
        else:
            yield lines([end])

    lines_of = texts.mapInArrow(document, "value string")
    if df.isEmpty():  # one document without rows
        empty = {"columns": begin + ",".join(f"{json.dumps(n)}:{{}}" for n in names) + end, "split": begin + "]}"}.get(orient, begin + end)
        lines_of = df.sparkSession.createDataFrame([(empty,)], "value string").coalesce(1)
    lines_of.write.mode(_mode(mode)).options(**options).text(path)


def _json_text(value: Column) -> Column:
    """A value as it is written in JSON."""
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(6), F.length(text) - 6)


def _json_kind(kind: T.DataType) -> str:
    """The name of a type in the schema of a ``table`` document."""
    names = {T.BooleanType: "boolean", T.DateType: "datetime", T.TimestampType: "datetime", T.TimestampNTZType: "datetime"}
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return names.get(type(kind)) or ("integer" if isinstance(kind, whole) else "number" if isinstance(kind, NUMERIC) else "string")


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "write", partition_by=None) -> None:
    """A folder of Parquet files, compressed by snappy, gzip, brotli (needs its codec on the cluster) or none."""
    if compression not in ("snappy", "gzip", "brotli", "none"):
        raise ValueError("compression must be snappy, gzip, brotli or none")
    df.write.mode(_mode(mode)).option("compression", compression).parquet(path, partitionBy=as_list(partition_by) or None)


def write_xml(df: DataFrame, path: str, mode: str = "write", root_tag: str = "data", row_tag: str = "row") -> None:
    """A folder of XML files."""
    df.write.mode(_mode(mode)).option("rootTag", root_tag).option("rowTag", row_tag).xml(path)


_WRITERS = {"csv": write_csv, "json": write_json, "parquet": write_parquet, "xml": write_xml}


def write_file(df: DataFrame, path: str, fmt: str, **options) -> None:
    """Write by format to any path Spark can reach (also object storage)."""
    if fmt not in _WRITERS:
        raise ValueError(f"no writer for {fmt!r}; known are {sorted(_WRITERS)}")
    _WRITERS[fmt](df, path, **options)


def record_payload(
    df: DataFrame, template: str | None = None, columns: Iterable[str] | None = None, name: str = "payload", size: int | None = None
) -> DataFrame:
    """Request bodies: one per row, as an added column, from a template with ``{{column}}`` places or the row as JSON.

    With ``size`` a body is a JSON list of up to that many records instead, and the result has only ``name`` and ``records``, their
    number; a list holds rows of one task, so the last one of each is shorter. A whole table in one body is one cell, so it is
    left to a ``size`` at which that fits.
    """
    if template is None:
        row = F.struct(*[c(n) for n in require(df, columns) or df.columns])
        body = F.to_json(row, {"ignoreNullFields": "false"})
    else:
        parts = []
        for i, piece in enumerate(re.split(r"\{\{(\w+)\}\}", template)):
            if i % 2:
                require(df, [piece])
                parts.append(F.coalesce(c(piece).cast("string"), F.lit("")))
            elif piece:
                parts.append(F.lit(piece))
        body = F.concat(*parts)
    if size is None:
        return df.withColumn(name, body)
    if size < 1:
        raise ValueError("size must be at least 1")
    # The number of a row in its task stands in the low 33 bits.
    seat = F.monotonically_increasing_id()
    placed = df.select(body.alias("_body"), seat.alias("_seat"))
    task, within = F.shiftright("_seat", 33), F.floor(F.col("_seat").bitwiseAND(F.lit((1 << 33) - 1)) / size)
    lists = placed.groupBy(task.alias("_task"), within.alias("_list")).agg(F.sort_array(F.collect_list(F.struct("_seat", "_body"))).alias("_all"))
    return lists.select(F.concat(F.lit("["), F.array_join("_all._body", ","), F.lit("]")).alias(name), F.size("_all").alias("records"))


def deliver(df: DataFrame, send: Callable[[Iterable[Row]], None]) -> None:
    """Give each partition's rows to the user's function, on the executors."""
    df.foreachPartition(send)
