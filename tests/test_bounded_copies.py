"""Joins that meet in bins or blocks: copies of rows stay in proportion to the tables, and the rows are those of the plain join."""

import random

import pytest
from pyspark.sql import functions as F

import sparkprep as sp
from sparkprep import session
from sparkprep.operators import hot_keys, theta


@pytest.fixture
def dealt(spark, monkeypatch):
    """The number of rows of each side that was dealt out by a number of partitions."""
    kind, seen = type(spark.range(1)), []
    plain = kind.repartition

    def repartition(self, *args):
        seen.append(self.count())
        return plain(self, *args)

    monkeypatch.setattr(kind, "repartition", repartition)
    return seen


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _key(row):
    return tuple((v is not None, str(v)) for v in row)


def test_blocks_of_a_hot_key_grow(spark, monkeypatch, dealt):
    for name, value in (("HOT_PAIRS", 40), ("BLOCK_ROWS", 4), ("TASK_PAIRS", 64), ("TASK_ROWS", 1)):
        monkeypatch.setattr(hot_keys, name, value, raising=False)
    left = spark.range(64).select(F.lit(1).alias("k"), "id")
    right = spark.range(64).select(F.lit(1).alias("m"), F.col("id").alias("other"))
    joined = sp.join_datasets(left, right, how="inner", conditions=[("k", "=", "m"), ("id", ">", "other")])
    # 16 blocks a side would be 1,024 rows a side; 8 shuffle partitions need 9 pairs of blocks or more.
    assert dealt and sum(dealt) <= 8 * 64
    assert joined.count() == 64 * 63 // 2


def test_cold_rows_are_dealt_once(spark, monkeypatch):
    for name, value in (("HOT_PAIRS", 40), ("TASK_PAIRS", 64)):
        monkeypatch.setattr(hot_keys, name, value)
    left = spark.range(100).select(F.expr("if(id < 50, -1, id)").alias("k"), F.col("id").alias("a"))
    right = left.toDF("m", "b")
    joined = sp.join_datasets(left, right, how="inner", conditions=[("k", "=", "m"), ("a", ">=", "b")])
    assert joined.count() == 50 * 51 // 2 + 50
    # The rows of hot keys are left out of the rest on both sides.
    assert _optimized(joined).count("LeftAnti") == 2


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("how", ["left", "outer"])
def test_points_alone_need_no_join_of_their_own(spark, monkeypatch, how, split):
    if split:
        for name, value in (("HOT_PAIRS", 4), ("BLOCK_ROWS", 4), ("TASK_PAIRS", 16)):
            monkeypatch.setattr(hot_keys, name, value)
    points = spark.createDataFrame([(i, float(i * 13 % 40)) for i in range(80)] + [(99, None), (98, 900.0), (97, 900.0)], "p int, at double")
    spans = [(i, float(i % 30), float(i % 30 + 1 + i % 3)) for i in range(40)] + [(70, None, 5.0), (71, 500.0, 501.0), (72, 9.0, 8.0)]
    intervals = spark.createDataFrame(spans, "s int, low double, high double")
    inside = [("at", ">=", "low"), ("at", "<", "high")]
    for width in (None, 2, 10):
        joined = sp.join_datasets(points, intervals, how=how, conditions=inside, bin_width=width)
        plain = points.join(intervals, F.expr("at >= low and at < high"), {"outer": "full_outer"}.get(how, how))
        assert sorted(map(tuple, joined.collect()), key=_key) == sorted(map(tuple, plain.collect()), key=_key)
        if not split:
            # Only intervals without a point are found by an anti join.
            assert _optimized(joined).count("LeftAnti") == (how == "outer")


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
def test_intervals_without_points(spark, strict, keyed):
    r = random.Random(5)
    at = [r.choice([None, float("nan"), float(r.randint(-50, 50)), r.uniform(-50, 50)]) for _ in range(60)]
    points = spark.createDataFrame([(i, r.choice([None, 0, 1]), x) for i, x in enumerate(at)], "p int, k int, at double")
    spans = []
    for i in range(200):
        low, length = float(r.randint(-60, 60)) + r.choice([0.0, 0.25]), r.choice([0.0, 0.01, 0.3, 1.0, 5.0, 300.0])
        spans.append((i, r.choice([None, 0, 1]), r.choice([low, low, low, None]), low + length))
    intervals = spark.createDataFrame(spans, "s int, m int, low double, high double")
    up, down = (">", "<") if strict else (">=", "<=")
    conditions = [("at", up, "low"), ("at", down, "high")] + ([("k", "=", "m")] if keyed else [])
    test = F.expr(f"at {up} low and at {down} high" + " and k = m" * keyed)
    want = sorted(map(tuple, intervals.join(points, test, "left_anti").collect()), key=_key)
    for width in (0.05, 1, 20):
        alone = sp.join_datasets(points, intervals, how="anti-right", conditions=conditions, bin_width=width)
        assert sorted(map(tuple, alone.collect()), key=_key) == want


def test_inequalities_write_no_copy_of_a_table(spark, monkeypatch, dealt):
    monkeypatch.setattr(theta, "BLOCK_ROWS", 10)
    monkeypatch.setattr(theta, "TASK_ROWS", 1, raising=False)
    left = spark.range(2000).selectExpr("id as a", "id * 37 % 2000 as x").repartition(3)
    right = spark.range(400).selectExpr("id * 5 as b", "id * 91 % 400 * 5 as y").repartition(2)
    dealt.clear()
    before = len(session._written)
    joined = sp.join_datasets(left, right, how="outer", conditions=[("a", "<", "b"), ("x", ">", "y")])
    written = [spark.read.parquet(path).count() for path in session._written[before:]]
    assert max(written) < 400
    assert dealt and sum(dealt) <= 4 * 2400
    want = left.join(right, F.expr("a < b and x > y"), "full_outer")
    assert sorted(map(tuple, joined.collect()), key=_key) == sorted(map(tuple, want.collect()), key=_key)


def test_inequalities_with_one_value(spark, monkeypatch, rows_of):
    monkeypatch.setattr(theta, "BLOCK_ROWS", 10)
    left = spark.range(200).selectExpr("1 as a", "2 as x", "id")
    right = spark.range(150).selectExpr("if(id < 140, 2, 0) as b", "if(id < 140, 1, 5) as y", "id as other")
    conditions = [("a", "<", "b"), ("x", ">", "y")]
    assert sp.join_datasets(left, right, how="inner", conditions=conditions).count() == 200 * 140
    assert sp.join_datasets(left, right, how="anti-left", conditions=conditions).count() == 0
    assert sp.join_datasets(left, right, how="anti-right", conditions=conditions).count() == 10
