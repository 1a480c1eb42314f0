"""Quantiles by refined ranges, correlation by blocks, keys by hashes, paths by doubling, comparison by digests."""

import math
import os
import random
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import sparkprep as sp
from sparkprep.operators import compare as comparing
from sparkprep.operators.ordering import exact_quantiles


def test_quantiles_of_any_spread(spark):
    r = random.Random(3)
    values = {
        "tiny": [r.uniform(-1, 1) * 10 ** r.randrange(-300, 300) for _ in range(400)], "same": [7.25] * 50, "near": [1 + i * 2**-52 for i in range(300)],
        "whole": [r.randrange(-20, 20) for _ in range(333)], "ends": [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324], "one": [-3.5],
    }
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("one", None), (None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = [0.0, 0.1, 0.5, 0.75, 1.0]
    found = {r["g"]: r["quantiles"] for r in exact_quantiles(df, ["g"], ["v"], wanted).collect()}
    assert set(found) == {*values, None}
    for k in ("tiny", "same", "near", "whole", "one"):
        assert found[k] == pytest.approx([float(np.quantile(values[k], p)) for p in wanted], rel=1e-12)
    assert found["ends"][0] == -math.inf and found["ends"][4] == math.inf and found["ends"][2] == 0


def test_quantiles_are_not_sorted(spark):
    plan = exact_quantiles(spark.range(1000).selectExpr("id % 3 as g", "id as v"), ["g"], ["v"], [0.5])._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_pearson_by_blocks(spark):
    r = np.random.default_rng(4)
    frame = pd.DataFrame({"a": r.normal(1e9, 1, 500), "b": r.normal(size=500), "k": 3.0})
    frame["c"] = frame.a * 0.5 + frame.b
    frame.loc[r.random(500) < 0.3, "c"] = None
    frame["d"] = np.where(frame.c.isna(), frame.b, 2.0)  # varies, but not where c is present
    frame["e"] = np.where(np.arange(500) == 7, np.inf, frame.b)
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, k double, c double, d double, e double").repartition(4)
    found = {row["index"]: row for row in sp.correlation_matrix(df).collect()}
    plain = frame.corr()
    for x, y in (("a", "b"), ("a", "c"), ("b", "c"), ("b", "d")):
        assert found[x][y] == pytest.approx(plain.loc[x, y], abs=1e-7)
    assert found["a"]["k"] is None and found["c"]["d"] is None and math.isnan(found["b"]["e"])


def test_unique_keys_by_hashes(spark):
    rows = [(i, i % 7, i % 11, None if i % 5 else i, f"x{i // 70}") for i in range(140)]
    df = spark.createDataFrame(rows, "id int, a int, b int, n int, s string").repartition(3)
    frame = pd.DataFrame(rows, columns=["id", "a", "b", "n", "s"])
    from itertools import combinations

    want = [list(combo) for size in (1, 2, 3) for combo in combinations(frame.columns, size) if not frame.duplicated(list(combo)).any()]
    assert [r["field_combination"] for r in sp.unique_keys(df, max_fields=3).collect()] == want


def plain_paths(edges):
    ups, out = {}, []
    for p, k, w in edges:
        if k is not None:
            ups.setdefault(k, {}).setdefault(p, []).append(w)

    def climb(node, at, seen, weights):
        for p, ws in ups.get(at, {None: []}).items():
            if p is None:
                out.append((node, ">".join(seen), weights))
            elif p in seen:
                out.append((node, ">".join([f"{p}>[CYCLE DETECTED]", *seen]), weights))
            else:
                climb(node, p, [p, *seen], weights + sum(ws))

    for node in {*ups, *(p for p, _, _ in edges if p is not None)}:
        climb(node, node, [node], 0)
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_hierarchies_by_doubling(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(12)}" if r.random() < 0.9 else None, f"n{r.randrange(12)}", r.randrange(9)) for _ in range(15)]
    edges += [(f"c{i}", f"c{i + 1}", 1) for i in range(40)]  # a chain, and with the next edge below it a loop at its top
    edges += [("c3", "c0", 2)] * (seed == 1) + [("n1", "n1", 1)]
    df = spark.createDataFrame(edges, "p string, k string, w int")
    found = sp.hierarchy_paths(df, "p", "k", ">", [("w", "sum")]).collect()
    assert sorted((x.k, x.hierarchy_path, x.w_sum) for x in found) == plain_paths(edges)


@pytest.mark.parametrize("parts", [1, 64])
def test_compare_by_digests(spark, rows_of, monkeypatch, parts):
    monkeypatch.setattr(comparing, "PARTS", parts)
    left = spark.createDataFrame([(i, i % 9, None if i % 4 else f"t{i}") for i in range(300)] + [(7, 7, "again"), (7, 7, "again")], "k int, a int, t string")
    right = left.where("k <> 20").withColumn("a", F.when(F.col("k") == 50, 99).otherwise(F.col("a"))).unionByName(left.where("k = 7 and t = 'again'"))
    data = rows_of(sp.compare(left, right))
    assert data == sorted([(20, 2, "t20", "left", 1, "row_differs", 1), (50, 5, None, "left", 1, "row_differs", 1), (50, 99, None, "right", 1, "row_differs", 1),
                           (7, 7, "again", "left", 2, "count_differs", 2), (7, 7, "again", "right", 4, "count_differs", 2)], key=repr)
    assert sp.compare(left, left).count() == 0 and sp.compare(left, right, "count_data").first()[0] == 5
    fields = rows_of(sp.compare(left, right, "field_data", keys=["k"]).distinct())
    assert {(k, f) for k, f, _, _ in fields} == {(20, "a"), (20, "t"), (50, "a"), (7, "t")}
    # Equal tables with a repeated key: its rows still meet each other.
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, t string")
    assert sp.compare(twice, twice, "field_data", keys=["k"]).count() == 4


def test_groups_that_take_no_part(spark):
    df = spark.createDataFrame([("a",), ("ab",), ("b",), (None,), ("xab a",)], "s string")
    got = [tuple(r)[1:] for r in sp.extract(df, "s", "(a)(b?)(c)?(?=( )|$)").collect()]
    assert got == [("a", "", None, None), ("a", "b", None, None), (None,) * 4, (None,) * 4, ("a", "b", None, " ")]
    assert sp.extract(df, "s", "(c)?", "one").first()["one_1"] is None and sp.extract(df, "s", "(c*)", "one").first()["one_1"] == ""
    assert sp.extract(df, "s", "(A)(B?) # a comment", "f", "IGNORECASE,VERBOSE").first()["f_2"] == ""


def test_entry_without_a_library(tmp_path):
    """A library that cannot be imported takes only the queries that need it."""
    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q) > 100, any(n.startswith('op1_') for n in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{root}"}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split()[:1] == ["True"] and done.stdout.split()[2] == "True"
