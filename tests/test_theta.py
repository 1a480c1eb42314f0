"""Joins on inequalities alone against plain loops, in one block and in many, and without plans over all pairs."""

import random

import pytest

import sparkprep as sp
from sparkprep.operators import theta

KINDS = ("inner", "left", "right", "outer", "anti-left", "anti-right")
HOLDS = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def plain(left, right, conditions, how):
    def partner(x, y):
        return all(x[a] is not None and y[b] is not None and HOLDS[op](x[a], y[b]) for a, op, b in conditions)

    pairs = [(x, y) for x in left for y in right if partner(x, y)]
    alone_left = [x for x in left if not any(partner(x, y) for y in right)]
    alone_right = [y for y in right if not any(partner(x, y) for x in left)]
    if how == "anti-left":
        return sorted(alone_left, key=repr)
    if how == "anti-right":
        return sorted(alone_right, key=repr)
    out = [(*x, *y) for x, y in pairs]
    out += [(*x, *[None] * 4) for x in alone_left] if how in ("left", "outer") else []
    out += [(*[None] * 4, *y) for y in alone_right] if how in ("right", "outer") else []
    return sorted(out, key=repr)


def tables(n, m, seed):
    r = random.Random(seed)

    def row(i):
        return (i, r.choice([None, *range(12)]), r.choice([None, *range(-5, 40)]), r.choice("abcdxyz"))

    hot = [(900, 5, 5, "c")] * 20  # repeated rows
    return [row(i) for i in range(n)] + hot, [row(i) for i in range(m)] + hot[:7]


CASES = [
    [(1, "<", 1)], [(1, ">=", 1)], [(3, ">", 3)], [(1, ">", 1), (2, "<", 2)], [(1, "<=", 2), (2, ">=", 1)],
    [(1, "<", 1), (2, "<=", 2), (3, ">", 3)], [(1, ">", 1), (1, ">", 2)],
]


@pytest.mark.parametrize(("case", "block", "kinds"), [
    *[(i, 4096, ("outer", "anti-left")) for i in range(len(CASES))], (1, 16, ("outer", "anti-right")), (3, 16, ("left", "right", "anti-left")),
    (5, 30, ("outer",)), (3, 5, ("inner",)),
])
def test_all_kinds(spark, rows_of, monkeypatch, case, block, kinds):
    monkeypatch.setattr(theta, "BLOCK_ROWS", block)
    left, right = tables(80, 60, case)
    a = spark.createDataFrame(left, "a0 int, a1 int, a2 int, a3 string").repartition(3)
    b = spark.createDataFrame(right, "b0 int, b1 int, b2 int, b3 string").repartition(3)
    conditions = [(f"a{i}", op, f"b{j}") for i, op, j in CASES[case]]
    for how in kinds:
        got = rows_of(sp.join_datasets(a, b, how=how, conditions=conditions))
        assert got == plain(left, right, CASES[case], how), how


def test_empty_sides(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    for how, n in (("inner", 0), ("left", 1), ("right", 0), ("outer", 1), ("anti-left", 1), ("anti-right", 0)):
        for conditions in ([("x", "<", "u")], [("x", "<", "u"), ("y", ">", "v")]):
            assert sp.join_datasets(a, a.where("false").toDF("u", "v"), how=how, conditions=conditions).count() == n


def test_nan_is_the_greatest(spark, rows_of):
    a = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    b = spark.createDataFrame([(float("nan"),), (0.5,)], "u double")
    assert rows_of(sp.join_datasets(a, b, how="inner", conditions=[("x", ">", "u")]).selectExpr("cast(x as string)", "u")) == [("1.0", 0.5), ("NaN", 0.5)]
    assert sp.join_datasets(a, b, how="anti-left", conditions=[("x", "<", "u")]).count() == 2


def test_no_plan_over_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(theta, "BLOCK_ROWS", 10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = spark.range(100).selectExpr("id as x", "id % 7 as y"), spark.range(50).selectExpr("id as u", "id % 5 as v")
        for how in ("outer", "anti-right"):
            for conditions in ([("x", "<", "u")], [("x", "<", "u"), ("y", ">", "v")]):
                plan = sp.join_datasets(a, b, how=how, conditions=conditions)._jdf.queryExecution().toString()
                assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
