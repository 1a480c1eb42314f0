"""Reads that keep every row, and values beside nulls."""

import pytest
from pyspark.sql import functions as F

import sparkprep as sp
from sparkprep.sources.files import read_json
from sparkprep.streaming import runs


def test_json_kinds_are_told_apart_by_file(spark, tmp_path, rows_of):
    (tmp_path / "a.json").write_text('{"a": 1, "b": null}\n\n{"a": 2, "b": "x"}\n{"a": 3, "b": "y"}\n')
    (tmp_path / "b.json").write_text('[\n  {"a": 4, "b": "z"},\n  {"a": 5}\n]\n')
    (tmp_path / "c.json").write_text('{\n "a": 6\n}\n')
    got = read_json(spark, str(tmp_path / "*.json"))
    assert rows_of(got.select("a", "b")) == sorted([(1, None), (2, "x"), (3, "y"), (4, "z"), (5, None), (6, None)], key=repr)
    assert dict(read_json(spark, str(tmp_path / "a.json"), dtype=False).dtypes)["a"] == "string"
    assert sp.read_file(spark, str(tmp_path / "a.json")).count() == 3


def test_enrich_keeps_ints_beside_nulls(spark, rows_of):
    df = spark.createDataFrame([(1, True), (None, None), (3, False)], "n int, flag boolean")
    got = sp.enrich(df, lambda row: repr((row["n"], row["flag"])), ["n", "flag"], "said")
    assert rows_of(got.select("said")) == sorted([("(1, True)",), ("(None, None)",), ("(3, False)",)], key=repr)


def test_last_needs_an_order_and_ties_are_settled(spark, rows_of):
    df = spark.createDataFrame([(1, 0, x) for x in "abcdef"], "k int, o int, v string")
    with pytest.raises(ValueError, match="order_by"):
        sp.deduplicate(df, ["k"], keep="last")
    one = rows_of(sp.deduplicate(df.repartition(1), ["k"], order_by=["o"]))
    assert one == rows_of(sp.deduplicate(df.repartition(5), ["k"], order_by=["o"]))


def test_compare_of_keys_only(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert sp.compare(df, df.limit(1), mode="field_data", keys=["k"]).count() == 0


def test_xpath_says_too_much(spark):
    with pytest.raises(ValueError, match="xpath"):
        sp.read_xml(spark, "x.xml", xpath="/a/b[@id>'1']")


def test_a_stream_that_is_not_done_raises(spark, tmp_path):
    spark.range(200).repartition(20).write.parquet(str(tmp_path / "in"))
    slow = runs.stream_files(spark, str(tmp_path / "in"), "id long", files_per_batch=1).where(F.java_method(F.lit("java.lang.Thread"), F.lit("activeCount")) > "")
    with pytest.raises(TimeoutError):
        runs.run_available(slow, timeout=1)


def test_case_rules(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Order  ID_no", "__x--Y__", "ÉÀ"])
    assert sp.rename_dynamic(df, ["Order  ID_no"], case="camel_lower").columns[0] == "orderIdNo"
    assert sp.rename_dynamic(df, ["__x--Y__"], case="snake").columns[1] == "x_y"
    assert sp.rename_dynamic(df, ["ÉÀ"], case="camel_upper").columns[2] == "ÉÀ"
