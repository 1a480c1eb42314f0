"""Joins whose few keys make most pairs of rows: the same rows as the plain join, over as many tasks as there are pairs."""

import pytest
from pyspark.sql import functions as F

import sparkprep as sp
from sparkprep.operators import hot_keys

LEFT = [(i % 3 if i % 7 else None, float(i * 37 % 50), i // 2) for i in range(60)] + [(9, 1.0, 100)]
RIGHT = [(i % 4 if i % 5 else None, float(i * 11 % 50), i // 3) for i in range(45)] + [(8, 1.0, 100)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("HOT_PAIRS", 40), ("BLOCK_ROWS", 4), ("TASK_PAIRS", 64)):
        monkeypatch.setattr(hot_keys, name, value)


def _sides(spark):
    return spark.createDataFrame(LEFT, "k int, x double, l long"), spark.createDataFrame(RIGHT, "m int, y double, r long")


def _key(row):
    return tuple((v is not None, v or 0) for v in row)


@pytest.mark.parametrize("null_keys", ["differ", "match"])
@pytest.mark.parametrize("how", ["inner", "outer"])
def test_equality_and_inequality(spark, small, how, null_keys):
    left, right = _sides(spark)
    joined = sp.join_datasets(left, right, how=how, conditions=[("k", "=", "m"), ("x", ">", "y")], null_keys=null_keys)
    meet = lambda a, b: (a[0] == b[0] and (a[0] is not None or null_keys == "match")) and a[1] > b[1]
    want = [(*a, *b) for a in LEFT for b in RIGHT if meet(a, b)]
    if how == "outer":
        want += [(*a, None, None, None) for a in LEFT if not any(meet(a, b) for b in RIGHT)]
        want += [(None, None, None, *b) for b in RIGHT if not any(meet(a, b) for a in LEFT)]
    assert sorted(map(tuple, joined.collect()), key=_key) == sorted(want, key=_key)


@pytest.mark.parametrize("how", ["inner", "left", "outer"])
def test_intervals(spark, small, how):
    points = spark.createDataFrame([(i, float(i * 13 % 40)) for i in range(80)] + [(99, None), (98, 900.0)], "p int, at double")
    spans = [(i, float(i % 30), float(i % 30 + 1 + i % 3 * 9)) for i in range(40)] + [(70, None, 5.0), (71, 500.0, 501.0)]
    intervals = spark.createDataFrame(spans, "s int, low double, high double")
    joined = sp.join_datasets(points, intervals, how=how, conditions=[("at", ">=", "low"), ("at", "<=", "high")], bin_width=10)
    plain = points.join(intervals, F.expr("at >= low and at <= high"), {"outer": "full_outer"}.get(how, how))
    assert sorted(map(tuple, joined.collect()), key=_key) == sorted(map(tuple, plain.collect()), key=_key)


def test_one_key_takes_many_tasks(spark, small):
    left = spark.range(64).select(F.lit(1).alias("k"), "id")
    right = spark.range(64).select(F.lit(1).alias("m"), F.col("id").alias("other"))
    joined = sp.join_datasets(left, right, how="inner", conditions=[("k", "=", "m"), ("id", ">", "other")])
    assert joined.select(F.spark_partition_id()).distinct().count() > 8
    assert joined.count() == 64 * 63 // 2


def test_converted_keys(spark, small):
    left = spark.createDataFrame([(x, i) for i in range(30) for x in ("1", "01")], "k string, a int")
    right = spark.createDataFrame([(1, i) for i in range(30)], "m int, b int")
    joined = sp.join_datasets(left, right, how="inner", conditions=[("k", "=", "m"), ("a", "<=", "b")])
    assert joined.count() == 2 * 30 * 31 // 2
