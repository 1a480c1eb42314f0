import datetime as dt
import json
import warnings

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import sparkprep as sp
from sparkprep.functions.patterns import DATE_FORMATS, LOCALES, PATTERNS


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(1, "  Ab\tc1, \n"), (2, None), (3, "élan VITAL-2 x")], "i int, s string")


def _cleaned(df, **kw):
    return [r.s for r in sp.cleanse(df, ["s"], **kw).orderBy("i").collect()]


def test_cleanse_characters_and_cases(texts):
    assert _cleaned(texts, remove=["whitespace"])[0] == "Ab\tc1,"
    assert _cleaned(texts, remove=["tabs", "line breaks"])[0] == "  Abc1, "
    assert _cleaned(texts, remove=["allwhitespace", "numbers", "punctuation"]) == ["Abc", None, "élanVITALx"]
    assert _cleaned(texts, remove=["letters"])[2] == "é -2 "
    assert _cleaned(texts, case="swapcase")[2] == "ÉLAN vital-2 X"
    assert _cleaned(texts, case="camelcase")[2] == "ÉlanVital-2X"
    assert _cleaned(texts, case="snakecase")[2] == "élan_vital-2_x"
    assert _cleaned(texts, case="capitalize")[2] == "Élan vital-2 x"
    with pytest.raises(ValueError):
        sp.cleanse(texts, case="shout")


def test_cleanse_nulls(spark, rows_of):
    df = spark.createDataFrame([(1, None, None, "a"), (2, 4.0, None, None), (3, 8.0, None, "b")], "i int, d double, n int, s string")
    assert rows_of(sp.cleanse(df, fill="0")) == [(1, 0.0, 0, "a"), (2, 4.0, 0, "0"), (3, 8.0, 0, "b")]
    assert [r.d for r in sp.cleanse(df, ["d"], fill="median").orderBy("i").collect()] == [6.0, 4.0, 8.0]
    assert sp.cleanse(df, drop_null_columns="all").columns == ["i", "d", "s"]
    assert sp.cleanse(df, drop_null_columns="any").columns == ["i"]
    assert sp.cleanse(df, ["d", "s"], drop_null_rows="any").count() == 1
    assert sp.cleanse(df, ["n"], drop_null_rows="all").count() == 0
    with pytest.raises(ValueError, match="order_by"):
        sp.cleanse(df, ["d"], fill="ffill")


def test_extract(spark):
    df = spark.createDataFrame([("a@b.org",), ("x 10.0.0.1 y",), (None,), ("Ab12",)], "t string")
    assert [r.e_1 for r in sp.extract(df, "t", "Email", "e").collect()] == ["a@b.org", None, None, None]
    assert [r.e_1 for r in sp.extract(df, "t", "IPv4 Address", "e").collect()] == [None, "10.0.0.1", None, None]
    two = sp.extract(df, "t", r"^([a-z]+)(\d+)$", "e", flags="IGNORECASE")
    assert [(r.e_1, r.e_2) for r in two.collect()][3] == ("Ab", "12")
    assert sp.extract(df.toDF("e_1"), "e_1", "(a)", "e").columns == ["e_1", "e_1_extracted"]
    with pytest.raises(ValueError, match="group"):
        sp.extract(df, "t", "abc")
    with pytest.raises(ValueError, match="flags"):
        sp.extract(df, "t", "(a)", flags="LOCALE")


SAMPLES = {
    "Email": "me.you+x@mail-host.example", "Email - RFC 5322": "o'neil@example.org", "URL": "https://www.example.org/a?b=1",
    "IPv4 Address": "127.0.0.1", "IPv6 Address": "2001:0db8:0000:0000:0000:ff00:0042:8329", "Credit Card": "4111-1111 1111 1111",
    "SSN": "078-05-1120", "Percentage": "12.5%", "JSON String": '"a\\"b"', "ISBN": "978-0306406157",
    "Date (YYYY-MM-DD)": "2024-10-31", "Date (DD/MM/YYYY)": "31/10/2024", "Date (MM.DD.YY)": "10.31.24", "Date (MM-DD-YYYY)": "12-01-2024",
}


def test_all_patterns_compile_and_match(spark):
    assert len(PATTERNS) == 25
    df = spark.createDataFrame([(SAMPLES.get(n, "none"), n) for n in PATTERNS], "t string, n string")
    for name in PATTERNS:
        found = sp.extract(df.where(F.col("n") == name), "t", name, "e").first()
        if name in SAMPLES and name != "Percentage":
            assert found.e_1 is not None and SAMPLES[name].startswith(found.e_1.rstrip('"')), name


def test_convert_modes(spark):
    df = spark.createDataFrame([("1",), (" 2",), ("x",), (None,), ("3.5",)], "s string")

    def values(frame, column="s"):
        return [r[column] for r in frame.collect()]

    assert values(sp.convert_types(df, ["s"], "int64", "coerce")) == [1, 2, None, None, 3]
    assert values(sp.convert_types(df, ["s"], "Int64", "coerce")) == [1, 2, None, None, None]
    assert values(sp.convert_types(df, ["s"], "float64", "coerce")) == [1.0, 2.0, None, None, 3.5]
    assert values(sp.convert_types(df, ["s"], "int64", "keep")) == ["1", " 2", "x", None, "3.5"]
    kept = sp.convert_types(df, ["s"], "int64", "keep", keep_original=True, suffix="_n")
    assert kept.columns == ["s", "s_n"]
    with pytest.warns(RuntimeWarning, match="'s': 1"):
        sp.convert_types(df, ["s"], "int64", "warn_coerce")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        sp.convert_types(df.where("s <> 'x'"), ["s"], "int64", "warn_keep")
    with pytest.raises(PySparkException):
        sp.convert_types(df, ["s"], "int64", "raise").collect()
    with pytest.raises(ValueError):
        sp.convert_types(df, ["s"], "complex")
    numbers = spark.createDataFrame([(-1,), (255,), (256,)], "n int")
    assert values(sp.convert_types(numbers, ["n"], "uint8", "coerce"), "n") == [None, 255, None]
    assert values(sp.convert_types(numbers, ["n"], "int8[pyarrow]", "coerce"), "n") == [-1, None, None]
    assert values(sp.convert_types(numbers, ["n"], "UInt64", "coerce"), "n")[1:] == [255, 256]
    assert values(sp.convert_types(numbers, ["n"], "category", "raise"), "n") == ["-1", "255", "256"]
    times = spark.createDataFrame([("2024-05-06 07:08:09.123456",), ("no",)], "s string")
    assert values(sp.convert_types(times, ["s"], "datetime64[s]", "coerce")) == [dt.datetime(2024, 5, 6, 7, 8, 9), None]
    assert values(sp.convert_types(times, ["s"], "pa.timestamp[ms]", "coerce"))[0].microsecond == 123000
    assert values(sp.convert_types(times, ["s"], "date", "coerce"))[0] == dt.date(2024, 5, 6)
    spans = spark.createDataFrame([("1 02:00:00",)], "s string")
    assert values(sp.convert_types(spans, ["s"], "timedelta[ns]", "raise")) == [dt.timedelta(days=1, hours=2)]
    assert values(sp.convert_types(spark.createDataFrame([("true",)], "s string"), ["s"], "boolean", "raise")) == [True]


def test_dates_round_trip_in_all_formats(spark):
    df = spark.sql("select timestamp_ntz'2024-10-03 14:05:06' as t")
    for fmt in DATE_FORMATS:
        written = sp.datetime_to_text(df, "t", fmt, "s")
        assert written.first().s == dt.datetime(2024, 10, 3, 14, 5, 6).strftime(fmt), fmt
        back = sp.text_to_datetime(written, "s", fmt, "back").first().back
        assert back == dt.datetime.strptime(written.first().s, fmt), fmt
        assert sp.text_to_datetime(written, "s", "auto", "back").first().back is not None, fmt
    for locale in LOCALES:
        local = sp.datetime_to_text(df, "t", "%d %B %Y", "s", locale=locale)
        assert sp.text_to_datetime(local, "s", "%d %B %Y", "b", locale=locale).first().b == dt.datetime(2024, 10, 3), locale


def test_dates_errors(spark):
    df = spark.createDataFrame([("2024-13-01",)], "s string")
    assert sp.text_to_datetime(df, "s", "%Y-%m-%d", on_error="null").first().s is None
    with pytest.raises(PySparkException):
        sp.text_to_datetime(df, "s", "%Y-%m-%d").collect()
    with pytest.raises(ValueError, match="%Z"):
        sp.text_to_datetime(df, "s", "%Y %Z")


def test_split(spark, rows_of):
    df = spark.createDataFrame([(1, "a.b.c"), (2, None), (3, "x"), (4, "")], "i int, s string")
    assert sp.split_to_columns(df, "s", ".").columns == ["i", "s_0", "s_1", "s_2"]
    assert rows_of(sp.split_to_columns(df, "s", ".", n=2)) == [(1, "a", "b"), (2, None, None), (3, "x", None), (4, "", None)]
    assert rows_of(sp.split_to_rows(df, "s", ".")) == [(1, "a"), (1, "b"), (1, "c"), (2, None), (3, "x"), (4, "")]
    assert sp.split_to_rows(df, "s", "[.b]+", "p", regex=True, keep_original=True).where("i = 1").count() == 2
    numbers = spark.createDataFrame([("1, 2",), ("3",)], "s string")
    assert rows_of(sp.split_to_rows(numbers, "s", ",", result_type="auto")) == [(1.0,), (2.0,), (3.0,)]
    assert sp.split_to_rows(df, "s", ".", result_type="auto").schema["s"].dataType.simpleString() == "string"
    quoted = spark.createDataFrame([(r"a\Eb",)], "s string")
    assert [r.s for r in sp.split_to_rows(quoted, "s", r"\E").collect()] == ["a", "b"]


CUSTOMER = {
    "first_name": "José", "last_name": "Ünal", "is_alive": True, "age": 42,
    "object_address": {"street_address": "1 Main", "city": "Łódź", "postal_code": "00-1"},
    "array_phone_numbers": [
        {"type": "home", "number": "1", "update_date": "2024-01-01", "array_phone_users": ["a", "b"]},
        {"type": "work", "array_phone_users": []},
    ],
    "array_children": [], "spouse": None,
}


def test_explode_nested_json(spark):
    df = spark.createDataFrame([(1, json.dumps(CUSTOMER))], "id int, j string")
    out = sp.explode_json(df, "j")
    assert "object_address.city" in out.columns and "array_phone_numbers.type" in out.columns
    rows = sorted((r["array_phone_numbers.type"], r["array_phone_numbers.array_phone_users"], r["array_phone_numbers.number"]) for r in out.collect() if r["array_phone_numbers.type"] == "home")
    assert rows == [("home", "a", "1"), ("home", "b", "1")]
    assert out.count() == 3 and out.first()["object_address.city"] == "Łódź" and out.first()["age"] == 42
    shallow = sp.explode_json(df, "j", max_level=1, prefix_top_level=True, separator="_", keep_raw=True)
    assert shallow.columns[:2] == ["id", "j"] and "j_object_address" in shallow.columns
    plain = sp.explode_json(df, "j", prefix_parents=False, arrays_as_rows=False)
    assert "city" in plain.columns and plain.count() == 1


def test_explode_json_roots_and_bad_rows(spark, rows_of):
    rows = [(1, '{"a": 1}'), (2, "[1, 2]"), (3, "[]"), (4, "{bad"), (5, None), (6, '[{"a": 7}, 3]'), (7, '{"a": 8} tail'), (8, "null")]
    df = spark.createDataFrame(rows, "i int, j string")
    out = sp.explode_json(df, "j")
    assert out.columns == ["i", "j_flatten", "a"]
    assert rows_of(out) == sorted(
        [(1, None, 1), (2, 1, None), (2, 2, None), (3, None, None), (5, None, None), (6, None, 7), (6, None, None), (8, None, None)], key=repr)
    mixed = spark.createDataFrame([('{"a": 1}',), ('{"a": {"b": 2}}',)], "j string")
    assert rows_of(sp.explode_json(mixed, "j")) == [("1",), ('{"b":2}',)]
    siblings = spark.createDataFrame([('{"x": [1, 2], "y": ["p", "q"]}',)], "j string")
    assert rows_of(sp.explode_json(siblings, "j")) == [(1, "p"), (1, "q"), (2, "p"), (2, "q")]
    structs = df.limit(1).select(F.struct(F.lit(1).alias("a"), F.struct(F.lit("z").alias("c")).alias("b")).alias("s"))
    assert sp.explode_json(structs, "s").columns == ["a", "b.c"]


def test_flatten_expand_validate(spark, rows_of):
    df = spark.createDataFrame([(1, json.dumps(CUSTOMER))], "id int, j string")
    flat = sp.flatten_json(df, "j", separator="_")
    assert flat.columns[:2] == ["id", "j"] and "object_address_city" in flat.columns
    assert "object_address" in sp.flatten_json(df, "j", max_level=0).columns
    lists = spark.createDataFrame([([1, 2],), ([3],), (None,)], "l array<int>")
    assert rows_of(sp.expand_json_list(lists, "l")) == [(1, 2), (3, None), (None, None)]
    texts = ['{"a":1}', "[1", None, "3", '"x"', '{"a":1} x', "NaN", '{"a":1,"a":2}', "", "1,2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    strict = [r[-1] for r in sp.validate_json(docs, ["j"]).orderBy("i").collect()]
    assert strict == [True, False, False, True, True, False, False, False, False, False]
    lenient = [r[-1] for r in sp.validate_json(docs, ["j"], lenient=True).orderBy("i").collect()]
    assert lenient == [True, False, False, True, True, False, True, True, False, False]
    assert sp.validate_json(docs, ["i"]).first()[-1] is False


def test_create_json_and_markdown(spark, rows_of):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), (None, 3, "y")], "k string, n int, s string")
    out = {r.k: json.loads(r.json_payload) for r in sp.create_json(df, ["n", "s"], by=["k"], order_by=["n"]).collect()}
    assert out == {"a": [{"n": 1, "s": "x"}, {"n": 2, "s": None}], None: [{"n": 3, "s": "y"}]}
    single = sp.create_json(df, ["n"], by=["k"], object_when_single=True).where("k is null").first()
    assert single.json_payload == '{"n":3}'
    assert len(json.loads(sp.create_json(df, ["n"]).first().json_payload)) == 3
    table = sp.markdown_table(df, ["n", "s"], order_by=["n"], name="md").first().md
    assert table == "| n | s |\n|---|---|\n| 1 | x |\n| 2 |  |\n| 3 | y |"
    styled = sp.markdown_style(df, ["s"], ["Blockquote", "Inline Code"]).orderBy("n").first().s
    assert styled == "\r\n>`x`\r\n"
    assert [r[-1] for r in sp.validate_markdown(df, ["s"]).orderBy("n").collect()] == [True, False, True]
    assert sp.prompt_column(df, "Say", ["n", "s"]).orderBy("n").first().prompt == "Say: n: 1, s: x"


def test_hierarchy_cycles_and_parents(spark, rows_of):
    edges = [("r", "a", 1), ("r", "b", 2), ("a", "c", 3), ("b", "c", 4), ("c", "d", 5), ("d", "c", 6), (None, "e", 7), ("e", "f", 8), ("e", "f", 9)]
    df = spark.createDataFrame(edges, "p string, c string, w int")
    out = sp.hierarchy_paths(df, "p", "c", ">", [("w", "sum"), ("w", "mean")])
    paths = {}
    for r in out.collect():
        paths.setdefault(r.c, []).append((r.hierarchy_path, r.head_node, r.path_length, r.w_sum))
    assert paths["r"] == [("r", "r", 1, 0)] and paths["e"] == [("e", "e", 1, 0)]
    assert sorted(paths["c"]) == sorted([("r>a>c", "r", 3, 4), ("r>b>c", "r", 3, 6), ("c>[CYCLE DETECTED]>d>c", "c>[CYCLE DETECTED]", 3, 6)])
    assert ("r>a>c>d", "r", 4, 9) in paths["d"] and len(paths["d"]) == 3
    assert paths["f"] == [("e>f", "e", 2, 17)]
    assert out.where("c = 'f'").first().w_mean == 8.5


def test_summary_and_keys(spark):
    df = spark.createDataFrame([(1, "bb", None), (2, "a", 1.5), (2, "cc", 2.5)], "n int, s string, d double")
    rows = {r.field_name: r for r in sp.summary(df).collect()}
    assert rows["n"]["most freq value"] == "2" and rows["n"]["least freq value"] == "1" and rows["n"]["50%"] == 2.0
    assert rows["s"]["shortest"] == "a" and rows["s"]["longest"] == "bb" and rows["s"].avg_length == pytest.approx(5 / 3)
    assert rows["d"]["count"] == 2 and rows["d"].mean == 2.0 and rows["d"]["25%"] == 1.75
    assert {r.field_name for r in sp.summary(df, "numerical").collect()} == {"n", "d"}
    assert [r.field_name for r in sp.summary(df, "categorical").collect()] == ["s"]
    keys = [(r.number_of_fields, r.field_combination) for r in sp.unique_keys(df, max_fields=0).collect()]
    assert keys == [(1, ["s"]), (1, ["d"]), (2, ["n", "s"]), (2, ["n", "d"]), (2, ["s", "d"]), (3, ["n", "s", "d"])]
    assert sp.preview(df, 2, "csv").splitlines()[0] == "n,s,d" and len(sp.preview(df, 2)) == 2
    assert sp.preview(df.orderBy("n"), 1, "text") == "n  s   d\n1  bb"


def test_correlation_min_periods(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 7.0, 2.0), (4.0, None, 5.0)], "a double, b double, c double")
    m = {r["index"]: r for r in sp.correlation_matrix(df, min_periods=3).collect()}
    assert m["a"].a == 1.0 and m["b"].c is None and m["a"].c == pytest.approx(0.9608, abs=1e-4)
    constant = spark.createDataFrame([(1, 1), (1, 2)], "x int, y int")
    for method in ("pearson", "spearman", "kendall"):
        m = {r["index"]: r for r in sp.correlation_matrix(constant, method=method).collect()}
        assert m["x"].x is None and m["x"].y is None and m["y"].y == 1.0


def test_correlation_of_many_columns(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    frame = pd.DataFrame(rng.normal(1e6, 1.0, (400, 15)), columns=[f"c{i}" for i in range(15)])
    frame["c3"] = frame.c1 * 2 + rng.normal(0, 0.1, 400)
    frame["c4"] = 7.0
    frame = frame.mask(pd.DataFrame(rng.random(frame.shape) < 0.1, columns=frame.columns))
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{n} double" for n in frame)).repartition(4)
    wide = sp.correlation_matrix(df).toPandas().set_index("index").astype(float)
    expected = frame.corr()
    expected.loc["c4", :] = expected.loc[:, "c4"] = np.nan
    assert list(wide.columns) == list(frame.columns)
    assert np.allclose(wide.loc[frame.columns].to_numpy(), expected.to_numpy(), atol=1e-7, equal_nan=True)
    few = sp.correlation_matrix(df, [f"c{i}" for i in range(5)]).toPandas().set_index("index").astype(float)
    assert np.allclose(few.to_numpy(), expected.iloc[:5, :5].to_numpy(), atol=1e-7, equal_nan=True)
    assert np.isnan(sp.correlation_matrix(df, min_periods=390).toPandas().loc[0, "c2"])


def test_pivot_unpivot(spark, rows_of):
    df = spark.createDataFrame([("r1", "x", 1, 5.0), ("r1", "y", 2, 6.0), ("r2", "x", 3, None)], "i string, p string, n int, d double")
    assert rows_of(sp.pivot(df, "i", "p", "n")) == [("r1", 1, 2), ("r2", 3, None)]
    assert rows_of(sp.pivot(df, "i", "p", "n", fill=-1)) == [("r1", 1, 2), ("r2", 3, -1)]
    two = sp.pivot(df, "i", "p", ["n", "d"], "sum")
    assert two.columns == ["i", "n_x", "d_x", "n_y", "d_y"] and rows_of(two)[1] == ("r2", 3, 0.0, 0, 0.0)
    # pandas leaves out what has no value at all, except for sums, which are 0.
    assert rows_of(sp.pivot(df, "i", ["p", "n"], "d", "max")) == [("r1", 5.0, 6.0)]
    assert sp.pivot(df, "i", ["p", "n"], "d", "max").columns == ["i", "x_1", "y_2"]
    assert sp.pivot(df, "i", ["p", "n"], "d", "max", drop_all_null=False).columns == ["i", "x_1", "x_3", "y_2"]
    assert sp.pivot(df, "i", ["p", "n"], "d", "sum").columns == ["i", "x_1", "x_3", "y_2"]
    assert sp.pivot(df, "i", "p", "n", "mean", pivot_values=["x", "zz"]).columns == ["i", "x"]
    dotted = df.selectExpr("i", "concat(p, '.1') as p", "n")
    assert sp.pivot(dotted, "i", "p", "n", "sum").columns == ["i", "x.1", "y.1"]
    with pytest.raises(ValueError, match="more than once"):
        sp.pivot(df.unionByName(df), "i", "p", "n")
    mixed = sp.unpivot(df, ["i"], ["n", "p"])
    assert mixed.schema["Value"].dataType.simpleString() == "string" and mixed.count() == 6
    assert sp.unpivot(df, ["i", "p"], value_type="string").where("Value = 'None'").count() == 1
