"""JSON documents read by layout, and the types found for their cells."""

import json

import pytest

import sparkprep as sp
from sparkprep.sources import files


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_a_type_takes_few_casts(spark, monkeypatch):
    """One type per column and pass is tried on all values; before, all six were."""
    tried = []
    first = files.F.max

    monkeypatch.setattr(files.F, "max", lambda x: tried.append(str(x)) or first(x))
    monkeypatch.setattr(files.F, "count_if", lambda x: pytest.fail("all types are tried on all values"))
    df = spark.createDataFrame([("1", "x", "1.5", None, "7"), ("22", "1", "3", None, "5000000000")], "a string, b string, c string, d string, e string")
    got = files._inferred(df)
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "string", "double", "string", "bigint"]
    assert got.collect()[1] == (22, "1", 3.0, None, 5000000000)
    assert sum("TRY_CAST" in x.upper() or "CASE" in x.upper() for x in tried) <= 3


def test_type_ruled_out_between_the_ends(spark):
    """The least and the greatest value are whole numbers, one between them is not."""
    df = spark.createDataFrame([("1",), ("2.5",), ("3",)], "a string")
    assert files._inferred(df).schema.simpleString() == "struct<a:double>"
    df = spark.createDataFrame([("1",), ("2x",), ("3",)], "a string")
    assert files._inferred(df).schema.simpleString() == "struct<a:string>"


def test_long_key_with_a_comma(spark, tmp_path, rows_of):
    """More pieces between commas than a batch holds, in the name of a column and in cells."""
    name = "a," * 25_000
    doc = {"x": {"0": 1, "1": 2}, name: {"0": "p,q", "1": None}}
    path = _write(tmp_path / "d/1.json", json.dumps(doc))
    df = sp.read_json(spark, path, orient="columns", lines=False)
    assert df.columns == sorted(doc)
    assert rows_of(df.select("x", df[df.columns[0]])) == [(1, "p,q"), (2, None)]


def test_a_row_named_twice_is_refused(spark, tmp_path):
    path = _write(tmp_path / "d/1.json", '{"a": {"0": 1, "0": 2}}')
    with pytest.raises(Exception):
        sp.read_json(spark, path, orient="columns", lines=False).collect()
