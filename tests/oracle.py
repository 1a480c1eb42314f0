"""Compare the registered queries with their SQL in DuckDB: schema, number of rows and values, in any order."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect(folder: str = FOLDER):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
          "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE"}


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and the SQL result; empty when they agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = result.fetchall()
    ours = df.collect()
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    for f in df.schema.fields:
        kind = _KINDS.get(f.dataType.simpleString())
        if kind and kinds[f.name] != kind:
            found.append(f"type of {f.name}: {kind} and {kinds[f.name]}")
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} and {len(theirs)}")
    a, b = _sorted_rows(df.columns, ours), _sorted_rows(names, theirs)
    if repr(a) != repr(b):  # also tells -0.0 from 0.0
        for x, y in zip(a, b):
            if repr(x) != repr(y):
                found.append(f"values {x!r:.300} and {y!r:.300}")
                break
    return found
