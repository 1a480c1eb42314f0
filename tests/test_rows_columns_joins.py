import pytest
from pyspark.sql import functions as F

import sparkprep as sp


def test_aggregate_null_rules(spark, rows_of):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 5.0), ("b", None)], "k string, v double")
    out = sp.aggregate(df, ["k"], [("v", "sum"), ("v", "prod"), ("v", "count"), ("v", "mean"), ("v", "median")])
    assert out.columns == ["k", "v_sum", "v_prod", "v_count", "v_mean", "v_median"]
    assert rows_of(out) == [("a", 1.0, 1.0, 1, 1.0, 1.0), ("b", 0.0, 1.0, 0, None, None)]
    kept = sp.aggregate(df, ["k"], [("v", "median")], keep_null_keys=True)
    assert rows_of(kept) == [("a", 1.0), ("b", None), (None, 5.0)]
    assert sp.aggregate(df.toDF("k", "a b"), None, [("a b", "max")]).columns == ["a_b_max"]
    with pytest.raises(ValueError, match="mode"):
        sp.aggregate(df, ["k"], [("v", "mode")])
    with pytest.raises(ValueError, match="order_by"):
        sp.aggregate(df, ["k"], [("v", "first")])


def test_first_last_skip_nulls(spark, rows_of):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, None)], "k string, o int, v string")
    assert rows_of(sp.aggregate(df, ["k"], [("v", "first"), ("v", "last")], order_by=["o"])) == [("a", "x", "y")]


def test_filters_on_nulls(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "cd")], "i int, s string")

    def kept(*args, **kw):
        return [r.i for r in sp.filter_rows(df, *args, **kw).orderBy("i").collect()]

    assert kept("s", "contains", "^a") == [1]
    assert kept("s", "not contains", "^a") == [2, 3, 4]
    assert kept("s", "startswith", "c") == [4] and kept("s", "endswith", "b") == [1]
    assert kept("s", "notnull") == [1, 3, 4] and kept("s", "isnull") == [2]
    assert kept("s", "notempty") == [1, 4] and kept("s", "isempty") == [3]
    assert kept("i", "==", "3", as_text=True) == [3] and kept("i", "!=", 3) == [1, 2, 4]
    assert kept(expr="i > 1 and s is not null") == [3, 4]
    true, false = sp.switch_rows(df, "s", "==", "ab")
    assert true.count() == 1 and sorted(r.i for r in false.collect()) == [2, 3, 4]
    true, false = sp.switch_rows(df)
    assert true.count() == 0 and false.count() == 4
    with pytest.raises(ValueError, match="text column"):
        sp.filter_rows(df, "i", "contains", "1")
    with pytest.raises(ValueError, match="nope"):
        sp.filter_rows(df, "nope", "==", 1)


def test_rename_and_position(spark):
    df = spark.createDataFrame([(1, "x", 2.0, True)], "`Order ID` int, `unit-price` string, col10 double, col2 boolean")
    assert sp.rename_dynamic(df, case="snake").columns == ["order_id", "unit_price", "col10", "col2"]
    assert sp.rename_dynamic(df, case="camel_lower").columns == ["orderId", "unitPrice", "col10", "col2"]
    assert sp.rename_dynamic(df, case="upper", special_chars="replace", replace_char="").columns[0] == "ORDERID"
    assert sp.rename_dynamic(df, ["col2"], strip_suffix="2", add_suffix="_b", add_prefix="p_").columns[-1] == "p_col_b"
    with pytest.raises(ValueError, match="more than once"):
        sp.rename_columns(df, {"col10": "col2"})
    assert sp.position_columns(df, ["by_name_natural"]).columns == ["col2", "col10", "Order ID", "unit-price"]
    assert sp.position_columns(df, ["by_name"]).columns == ["Order ID", "col10", "col2", "unit-price"]
    assert sp.position_columns(df, ["by_type_family"]).columns == ["col2", "Order ID", "col10", "unit-price"]
    assert sp.position_columns(df, ["by_type", "reverse_position"]).columns == ["unit-price", "Order ID", "col10", "col2"]
    with pytest.raises(ValueError):
        sp.position_columns(df, ["by_magic"])


def test_concat_columns(spark, rows_of):
    df = spark.createDataFrame([("a", None, 1)], "x string, y string, z int")
    assert sp.concat_columns(df, ["x", "y", "z"], "n", separator="-").first().n == "a--1"
    assert sp.concat_columns(df, ["x", "z"], "n", ascii_codes=[124, 32]).first().n == "a| 1"
    for bad in ({}, {"ascii_codes": [200]}):
        with pytest.raises(ValueError):
            sp.concat_columns(df, ["x"], "n", **bad)


def test_formula_kinds(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    out = sp.formula(df, [("c", "a + b"), (["a", "b"], "$value * 10"), (["a", "c"], lambda x: x + 1), ("d", F.lit("z"))])
    assert tuple(out.first()) == (11, 20, 4, "z")


@pytest.mark.parametrize("keep,expected", [("first", [(1, "a"), (2, "b")]), ("last", [(2, "b"), (3, "c")]), ("none", [(2, "b")])])
def test_deduplicate(spark, rows_of, keep, expected):
    df = spark.createDataFrame([(1, "a", "k"), (2, "b", None), (3, "c", "k")], "o int, v string, k string")
    assert rows_of(sp.deduplicate(df, ["k"], keep, ["o"]).select("o", "v")) == expected


def test_dedup_limits_groups_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id % 3 as k", "id as o")
    plan = sp.deduplicate(df, ["k"], "first", ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_concat(spark, rows_of):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "b int, a string")
    b = spark.createDataFrame([(3.5,)], "c double")
    out = sp.concat_rows(a, b, sort=True)
    assert out.columns == ["a", "b", "c"] and out.count() == 3
    side = sp.concat_side_by_side(a, a, b, order_by=["b", [("b", "desc")], "c"])
    assert side.columns == ["b", "a", "b1", "a1", "c"]
    assert rows_of(side) == [(1, "x", 2, "y", 3.5), (2, "y", 1, "x", None)]


LEFT = [(1, "a", 10), (2, "b", 20), (2, "c", 30), (None, "n", 40)]
RIGHT = [(2, "r", 1), (3, "s", 2), (None, "t", 3)]


@pytest.fixture
def sides(spark):
    return spark.createDataFrame(LEFT, "k int, v string, x int"), spark.createDataFrame(RIGHT, "k int, v string, y int")


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer", "anti-left", "anti-right"])
@pytest.mark.parametrize("null_keys", ["differ", "match"])
@pytest.mark.parametrize("split", [None, True, False])
def test_equi_joins(sides, rows_of, how, null_keys, split):
    left, right = sides
    out = sp.join_datasets(left, right, on="k", how=how, null_keys=null_keys, split_hot_keys=split)

    def meet(a, b):
        return a == b and (a is not None or null_keys == "match")

    pairs = [(a, b) for a in LEFT for b in RIGHT if meet(a[0], b[0])]
    lone_left = [a for a in LEFT if not any(meet(a[0], b[0]) for b in RIGHT)]
    lone_right = [b for b in RIGHT if not any(meet(a[0], b[0]) for a in LEFT)]
    expected = {
        "inner": [a + b for a, b in pairs],
        "left": [a + b for a, b in pairs] + [a + (None,) * 3 for a in lone_left],
        "right": [a + b for a, b in pairs] + [(None,) * 3 + b for b in lone_right],
        "outer": [a + b for a, b in pairs] + [a + (None,) * 3 for a in lone_left] + [(None,) * 3 + b for b in lone_right],
        "anti-left": lone_left,
        "anti-right": lone_right,
    }[how]
    assert rows_of(out) == sorted(expected, key=repr)
    if not how.startswith("anti"):
        assert out.columns == ["k", "v", "x", "k_right", "v_right", "y"]


OPS = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer", "anti-left", "anti-right"])
@pytest.mark.parametrize("conditions,width", [
    ([("k", "=", "k"), ("x", ">", "y")], None), ([("x", "<=", "y")], None), ([("x", ">=", "lo"), ("x", "<=", "hi")], None),
    ([("x", ">=", "lo"), ("x", "<", "hi")], 4), ([("x", ">=", "lo"), ("x", "<=", "hi")], 0.01), ([("k", "=", "k"), ("x", ">", "lo"), ("x", "<", "hi")], 3),
])
def test_theta_joins(spark, rows_of, how, conditions, width):
    lefts = [(i % 3 if i % 7 else None, i) for i in range(30)]
    rights = [(i % 4, i * 3, i * 3 - 2, i * 3 + (i % 5)) for i in range(-2, 14)] + [(1, None, 5, None), (0, 9, 40, 2)] * 2
    left = spark.createDataFrame(lefts, "k int, x int")
    right = spark.createDataFrame(rights, "k int, y int, lo int, hi int")
    out = sp.join_datasets(left, right, how=how, conditions=conditions, bin_width=width)
    lcol, rcol = {"k": 0, "x": 1}, {"k": 0, "y": 1, "lo": 2, "hi": 3}

    def meet(a, b):
        values = [(a[lcol[x]], op, b[rcol[y]]) for x, op, y in conditions]
        return all(x is not None and y is not None and OPS[op](x, y) for x, op, y in values)

    pairs = [a + b for a in lefts for b in rights if meet(a, b)]
    lone_left = [a for a in lefts if not any(meet(a, b) for b in rights)]
    lone_right = [b for b in rights if not any(meet(a, b) for a in lefts)]
    padded_left, padded_right = [a + (None,) * 4 for a in lone_left], [(None,) * 2 + b for b in lone_right]
    expected = {
        "inner": pairs, "left": pairs + padded_left, "right": pairs + padded_right,
        "outer": pairs + padded_left + padded_right, "anti-left": lone_left, "anti-right": lone_right,
    }[how]
    assert rows_of(out) == sorted(expected, key=repr)


def test_interval_join_on_times_and_from_the_left(spark, rows_of):
    points = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) as t from range(48)")
    spans = spark.createDataFrame([("2024-01-01 03:30:00", "2024-01-01 05:00:00"), ("2024-01-09 00:00:00", "2024-01-10 00:00:00")], "a string, b string")
    spans = spans.selectExpr("cast(a as timestamp_ntz) as a", "cast(b as timestamp_ntz) as b")
    out = sp.join_datasets(spans, points, how="left", conditions=[("a", "<=", "t"), ("b", ">=", "t")], bin_width=3600)
    assert sorted(str(r.t) for r in out.collect()) == ["2024-01-01 04:00:00", "2024-01-01 05:00:00", "None"]
    days = spans.selectExpr("cast(a as date) as a", "cast(b as date) as b")
    dates = spark.sql("select date_add(date'2024-01-08', cast(id as int)) as d from range(5)")
    assert sp.join_datasets(dates, days, how="inner", conditions=[("d", ">=", "a"), ("d", "<=", "b")], bin_width=7).count() == 2
    with pytest.raises(ValueError, match="bin_width"):
        sp.join_datasets(points, spans, how="inner", conditions=[("t", ">", "a")], bin_width=5)


def test_join_names_guard_and_errors(sides):
    left, right = sides
    both = sp.join_datasets(left, right, on="k", how="outer", same_name="suffix_both")
    assert both.columns == ["k_left", "v_left", "x", "k_right", "v_right", "y"]
    merged = sp.join_datasets(left, right, on="k", how="outer", same_name="coalesce")
    assert merged.columns == ["k", "v", "x", "y"] and merged.where("k = 3").first().v == "s"
    assert sp.join_datasets(left, left, how="cross").count() == 16
    twice = right.unionByName(right)
    with pytest.raises(ValueError, match="unique"):
        sp.join_datasets(left, twice, on="k", if_many_to_many="raise")
    with pytest.warns(UserWarning, match="unique"):
        sp.join_datasets(left, twice, on="k", if_many_to_many="warn")
    sp.join_datasets(left, right, on="k", if_many_to_many="raise")
    for bad in ({"how": "semi", "on": "k"}, {"how": "inner"}, {"on": "zzz"}, {"conditions": [("k", "~", "k")]}):
        with pytest.raises(ValueError):
            sp.join_datasets(left, right, **bad)


def test_compare_modes(spark, rows_of):
    left = spark.createDataFrame([(1, "a", 1.04), (1, "a", 1.04), (2, "b", 2.0), (3, None, 3.0)], "id int, s string, d double")
    right = spark.createDataFrame([(1.0, 1, "a"), (2.0, 2, "B"), (3.0, 3, None), (4.0, 4, "n")], "d double, id int, s string")
    out = sp.compare(left, right, round_float=1)
    assert rows_of(out) == sorted([
        (1, "a", 1.0, "left", 2, "count_differs", 1), (1, "a", 1.0, "right", 1, "count_differs", 1),
        (2, "b", 2.0, "left", 1, "row_differs", 1), (2, "B", 2.0, "right", 1, "row_differs", 1), (4, "n", 4.0, "right", 1, "row_differs", 1),
    ], key=repr)
    assert sp.compare(left, right, "count_data", round_float=1, check_counts=False).first().diff_count == 3
    fields = sp.compare(left, right, "field_data", keys=["id"], ignore=["d"])
    assert rows_of(fields) == [(2, "s", "B", "right"), (2, "s", "b", "left"), (4, "s", "n", "right")]
    assert rows_of(sp.compare(left, right, "differing_fields", keys=["id"], ignore=["d"])) == [("s", 2)]
    assert sp.compare(left, left.withColumn("origin_data", F.lit(1)), "data").columns[-4:] == [
        "origin_data", "row_count", "difference_type", "total_count_diff"]
    named = left.withColumn("origin_data", F.lit(1))
    assert "origin_data1" in sp.compare(named, named).columns
    assert rows_of(sp.compare(left, right, "metadata", with_position=False)) == []
    assert sp.compare(left, right, "metadata").count() == 6
    metrics = sp.compare(left, left.where("id < 3"), "metadata+metrics")
    assert ("id", "0", "max", "3", "left", 1, "row_differs", 1) in rows_of(metrics)
    with pytest.raises(ValueError, match="columns differ"):
        sp.compare(left, left.drop("s"), column_mismatch="strict")
    with pytest.raises(ValueError, match="keys"):
        sp.compare(left, right, "field_data")
    moved = sp.compare(left.select("s"), left.select("s"), row_order=["s", [("s", "desc")]])
    assert moved.count() > 0


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, o int, v double, j string")
    assert sp.aggregate(df, ["k"], [("v", "median"), ("v", "sum")]).count() == 0
    assert sp.deduplicate(df, ["k"], "none").count() == 0
    assert sp.sample_rows(df, n=3).count() == 0
    assert sp.frequencies(df).count() == 0
    assert sp.summary(df).count() == 4
    assert sp.correlation_matrix(df).columns == ["index", "o", "v"]
    assert sp.explode_json(df, "j").columns == ["k", "o", "v"]
    assert sp.split_to_columns(df, "k", ",").columns == ["o", "v", "j"]
    assert sp.hierarchy_paths(df, "k", "j").count() == 0
    assert sp.unique_keys(df).count() == 4
    assert sp.compare(df, df).count() == 0


def test_chart_first_and_last(spark, rows_of):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z")], "k string, o int, v string")
    out = sp.chart_table(df, "k", {"v": ["first", "last"]}, order_by=["o"])
    assert out.columns == ["k", "First of v", "Last of v"]
    assert rows_of(out) == [("a", "y", "x"), (None, "z", "z")]


def test_interval_join_without_width(spark, rows_of):
    points = spark.createDataFrame([(1, 5.0), (2, -3.0), (3, None)], "p int, x double")
    bands = spark.createDataFrame([(1, 0.0, 10.0), (2, -4.0, -2.0), (3, 7.0, 6.0), (4, None, 1.0)], "b int, low double, high double")
    joined = sp.join_datasets(points, bands, how="outer", conditions=[("x", ">=", "low"), ("x", "<=", "high")])
    assert sorted(rows_of(joined.select("p", "b")), key=str) == [(1, 1), (2, 2), (3, None), (None, 3), (None, 4)]
