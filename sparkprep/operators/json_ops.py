"""JSON columns: explode, flatten, expand lists, validate."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import c, require
from sparkprep.operators.aggregate import create_json

__all__ = ["create_json", "explode_json", "flatten_json", "expand_json_list", "validate_json", "json_schema"]


def _ddl(variant_schema: str | None) -> str | None:
    """The type of a variant as SQL: objects are structs, mixed values are text, and decimals doubles."""
    if variant_schema is None or not variant_schema.startswith(("OBJECT", "ARRAY")):
        return None
    # Field names in backticks are left alone.
    pieces = re.split(r"(`(?:[^`]|``)*`)", variant_schema)
    for i in range(0, len(pieces), 2):
        piece = pieces[i].replace("OBJECT<", "STRUCT<")
        piece = re.sub(r"\bDECIMAL\(\d+, ?\d+\)", "DOUBLE", piece)
        pieces[i] = re.sub(r"(?<=[ <])(VOID|VARIANT)\b", "STRING", piece)
    return "".join(pieces)


# Closes the list that a text is checked in; no text holds it by chance.
_END = "\u0001end of text\u0001"


def _parsed(df: DataFrame, column: str) -> Column:
    """The column as a variant; text is parsed, and bad JSON gives null.

    Spark's parser stops after the first value and would take ``{} x``. So the text is read as the first of two items of
    a list: only when the list has those two items, the text was one whole value.
    """
    if not isinstance(df.schema[column].dataType, T.StringType):
        return F.to_variant_object(c(column))
    escaped = json.dumps(_END)
    both = F.try_parse_json(F.concat(F.lit("["), c(column), F.lit(f",{escaped}]")))
    is_whole = (F.try_variant_get(both, "$[1]", "string") == _END) & F.try_variant_get(both, "$[2]", "variant").isNull()
    return F.when(is_whole, F.try_variant_get(both, "$[0]", "variant"))


def json_schema(df: DataFrame, column: str) -> str | None:
    """The common type of a JSON column as SQL text, from one distributed aggregate; None when no object or list occurs."""
    require(df, [column])
    found = df.agg(F.schema_of_variant_agg(_parsed(df, column))).first()[0]
    return _ddl(found)


def explode_json(
    df: DataFrame,
    column: str,
    schema: str | None = None,
    item_type: str | None = None,
    prefix_parents: bool = True,
    prefix_top_level: bool = False,
    separator: str = ".",
    max_level: int | None = None,
    arrays_as_rows: bool = True,
    objects_as_columns: bool = True,
    keep_raw: bool = False,
) -> DataFrame:
    """JSON to columns and rows: objects become columns named by their path, arrays become rows.

    Rows with invalid JSON are left out; a null stays as one row. A list at the root gives one row per item, in column
    ``<column>_flatten`` if no item is an object. An empty list gives one row of nulls; lists next to each other give
    every combination once. ``schema`` (SQL type of an object) and ``item_type`` (type of the items of plain lists) save
    the aggregate that finds them and are needed on streams. ``prefix_parents`` names columns by the whole path;
    without it a later column replaces an earlier one of the same name.
    """
    require(df, [column])
    # Parsed once, in a column of its own. Bad JSON has no items, so its row goes without a filter.
    parsed = df.select("*", _parsed(df, column).alias("_json"))
    parsed = parsed.select("*", F.try_variant_get("_json", "$", "array<variant>").alias("_list"))
    no_item = F.array(F.lit(None).cast("variant"))
    items = (
        F.when(c(column).isNull(), no_item).when(F.col("_json").isNull(), F.array().cast("array<variant>"))
        .when(F.col("_list").isNull(), F.array("_json")).when(F.size("_list") == 0, no_item).otherwise(F.col("_list"))
    )

    def is_object(x: Column) -> Column:
        return F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))

    plain = F.when(F.col("_list").isNotNull(), ~F.exists("_list", is_object)).otherwise(F.lit(False))
    rows = parsed.select(*[c(n) for n in df.columns], plain.alias("_plain"), F.explode(items).alias("_item"))
    if schema is None and item_type is None:
        in_objects = F.when(~F.col("_plain"), F.col("_item"))
        seen = rows.agg(
            F.schema_of_variant_agg(in_objects), F.max("_plain"),
            F.schema_of_variant_agg(F.when(F.col("_plain"), F.col("_item"))),
        ).first()
        found = seen[0]
        if found == "VARIANT":  # objects next to values of other kinds
            found = rows.agg(F.schema_of_variant_agg(F.when(is_object(F.col("_item")), F.col("_item")))).first()[0]
        schema = _ddl(found)
        if seen[1]:
            item_type = _ddl(seen[2]) or {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean"}.get(
                seen[2], "double" if str(seen[2]).startswith("DECIMAL") else "string"
            )
    if schema is not None and not schema.upper().startswith("STRUCT"):
        raise ValueError(f"the schema of a JSON object must be a struct, not {schema}")
    others = [n for n in df.columns if n != column or keep_raw]
    made: dict[str, str] = {}  # output name -> working column
    work = rows
    if item_type is not None:
        work = work.withColumn("_i0", F.when(F.col("_plain"), F.try_variant_get("_item", "$", item_type)))
        made[f"{column}_flatten"] = "_i0"
    if schema is not None and objects_as_columns:
        # Null for items that are no objects.
        work = work.withColumn("_root", F.try_variant_get("_item", "$", schema))
        top = f"{column}{separator}" if prefix_top_level else ""
        work, columns = _spread(work, "_root", "", top, separator, prefix_parents, max_level, 1)
        made |= columns
    if arrays_as_rows:
        level = 1
        while True:
            lists = [n for n, w in made.items() if isinstance(work.schema[w].dataType, T.ArrayType)]
            for name in lists:
                cell = made.pop(name)
                work = work.withColumn(cell, F.explode_outer(c(cell)))
                if isinstance(work.schema[cell].dataType, T.StructType) and objects_as_columns:
                    work, columns = _spread(work, cell, name, "", separator, prefix_parents, max_level, level + 1)
                    made |= columns
                else:
                    made[name] = cell
            if not lists or (max_level is not None and level >= max_level):
                break
            level += 1
    return work.select(*[c(n) for n in others if n not in made], *[c(w).alias(n) for n, w in made.items()])


def _spread(work: DataFrame, cell: str, parent: str, top: str, separator: str, prefix: bool, max_level, level: int):
    """Add a working column for each field of the struct ``cell``, going into nested structs up to ``max_level``."""
    made: dict[str, str] = {}
    added: dict[str, Column] = {}

    def walk(value: Column, kind: T.StructType, parent: str, level: int) -> None:
        for field in kind.fields:
            name = f"{parent}{separator}{field.name}" if parent and prefix else field.name
            if level == 1:
                name = top + name
            inner = value.getField(field.name)
            if isinstance(field.dataType, T.StructType) and (max_level is None or level < max_level):
                walk(inner, field.dataType, name, level + 1)
            else:
                made[name] = f"{cell}_{len(added)}"
                added[made[name]] = inner

    walk(c(cell), work.schema[cell].dataType, parent, level)
    others = [c(n) for n in work.columns if n != cell]
    return work.select(*others, *[value.alias(n) for n, value in added.items()]), made


def flatten_json(
    df: DataFrame,
    column: str,
    separator: str = ".",
    max_level: int | None = None,
    keep_columns: bool = True,
    schema: str | None = None,
) -> DataFrame:
    """Objects to columns named by their path; lists stay lists. ``max_level`` 0 opens only the outermost object.

    With ``keep_columns`` the other columns (and the JSON itself) stay in front. JSON text needs ``schema`` (SQL type) or
    one aggregate that finds it; struct columns need neither.
    """
    require(df, [column])
    kind = df.schema[column].dataType
    if isinstance(kind, T.StructType):
        work = df.withColumn("_root", c(column))
    else:
        schema = schema or json_schema(df, column)
        if schema is None or not schema.upper().startswith("STRUCT"):
            raise ValueError(f"column {column!r} holds no JSON objects of one shape")
        work = df.withColumn("_root", F.try_variant_get(_parsed(df, column), "$", schema))
    limit = None if max_level is None else max_level + 1
    work, made = _spread(work, "_root", "", "", separator, True, limit, 1)
    kept = df.columns if keep_columns else []
    doubled = [n for n in made if n in kept]
    if doubled:
        raise ValueError(f"flattened columns already exist: {doubled}")
    return work.select(*[c(n) for n in kept], *[c(w).alias(n) for n, w in made.items()])


def expand_json_list(df: DataFrame, column: str, size: int | None = None, item_type: str = "string") -> DataFrame:
    """A list column (or JSON text with a list) to columns ``0`` .. ``n-1``; only those columns are returned.

    Without ``size`` one aggregate finds the longest list.
    """
    require(df, [column])
    cell = c(column)
    if not isinstance(df.schema[column].dataType, T.ArrayType):
        cell = F.try_variant_get(_parsed(df, column), "$", f"array<{item_type}>")
    if size is None:
        size = max(df.agg(F.max(F.size(cell))).first()[0] or 0, 0)
    return df.select(*[F.get(cell, F.lit(i)).alias(str(i)) for i in range(size)])


@F.pandas_udf(T.BooleanType())
def _loads(texts: pd.Series) -> pd.Series:
    def valid(text) -> bool:
        try:
            json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return False
        return True

    return texts.map(valid, na_action="ignore").fillna(False).astype(bool)


def validate_json(df: DataFrame, columns: Iterable[str], lenient: bool = False) -> DataFrame:
    """``is_<column>_valid_json``: false for null and for what is not text.

    Spark's parser decides inside the JVM. ``lenient=True`` gives what it rejects to Python's, which also takes NaN,
    Infinity and repeated keys.
    """
    out = {}
    for n in require(df, columns):
        if not isinstance(df.schema[n].dataType, T.StringType):
            out[f"is_{n}_valid_json"] = F.lit(False)
            continue
        strict = _parsed(df, n).isNotNull()
        doubtful = F.when(~strict, c(n))
        out[f"is_{n}_valid_json"] = (strict | _loads(doubtful)) if lenient else strict
    return df.withColumns(out)
