"""The user's own code: transforms on tables, on pandas batches and groups, and calls to a service."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkprep._columns import as_list, c, require
from sparkprep.session import cut


def python_input(spark: SparkSession, make: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """A table from the user's function."""
    return make(spark)


def python_transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The user's function from DataFrame to DataFrame."""
    return df.transform(fn)


def pandas_transform(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by: Iterable[str] | None = None
) -> DataFrame:
    """The user's pandas code, on batches of rows; with ``by`` on whole groups, which then must fit one task."""
    keys = require(df, by)
    if keys:
        return df.groupBy(*[c(k) for k in keys]).applyInPandas(fn, schema)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(batches, schema)


def python_output(df: DataFrame, fn: Callable[[DataFrame], None]) -> None:
    """Give the table to the user's function."""
    fn(df)


def enrich(
    df: DataFrame,
    fn: Callable,
    columns: Iterable[str],
    new_column: str,
    type: str = "string",
    setup: Callable[[], object] | None = None,
    retries: int = 2,
    wait: float = 0.5,
) -> DataFrame:
    """A new column from a call per row, such as a web service: ``fn(row)``, or ``fn(client, row)`` with ``setup`` making
    one client per task; ``row`` is a dict of ``columns``.

    Each distinct input is called once, failed calls are repeated with growing pauses, and the answers are written
    before they are joined back, so that re-reading the result does not call again.
    """
    names = require(df, columns)
    if not names:
        raise ValueError("enrich needs at least one column")
    inputs = df.select(*[c(n).alias(f"_in{i}") for i, n in enumerate(names)]).distinct()
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in inputs.schema.fields]

    kind = to_arrow_type(df.sparkSession.createDataFrame([], f"x {type}").schema[0].dataType)

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = setup() if setup else None

        def answer(values: tuple):
            row = dict(zip(names, values))
            for attempt in range(retries + 1):
                try:
                    return fn(client, row) if setup else fn(row)
                except Exception:
                    if attempt == retries:
                        raise
                    time.sleep(wait * 2**attempt)

        # Arrow values are Python's own: an int stays an int beside a null.
        for batch in batches:
            answers = pa.array([answer(values) for values in zip(*(column.to_pylist() for column in batch.columns))], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, answers], [*batch.schema.names, "_answer"])

    answers = cut(inputs.mapInArrow(calls, ", ".join([*fields, f"_answer {type}"])), "answers")
    on = reduce(Column.__and__, [c(n).eqNullSafe(F.col(f"_in{i}")) for i, n in enumerate(names)])
    kept = [c(n) for n in df.columns if n != new_column]
    return df.join(answers, on, "left").select(*kept, F.col("_answer").alias(new_column))


def sql_query(df: DataFrame | list[DataFrame], query: str) -> DataFrame:
    """One Spark SQL statement over ``input_df1`` (and ``input_df2``... when several tables are given)."""
    frames = [df] if isinstance(df, DataFrame) else as_list(df)
    spark = frames[0].sparkSession
    views = []
    try:
        for i, frame in enumerate(frames, 1):
            view = f"input_{uuid.uuid4().hex}"
            frame.createOrReplaceTempView(view)
            views.append(view)
            # Quoted texts and comments stay as they are written.
            skipped = r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|--[^\n]*"
            query = re.sub(rf"({skipped})|\binput_df{i}\b", lambda m, v=view: m[1] or v, query)
        return spark.sql(query)
    finally:
        # The result is analysed by now and no longer needs the names.
        for view in views:
            spark.catalog.dropTempView(view)
