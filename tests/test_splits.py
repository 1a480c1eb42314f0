"""Files cut into records over many small splits, against Python's own readers."""

import csv
import io
import json
import random

import pytest

import sparkprep as sp


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", size), spark.conf.set("spark.sql.files.openCostInBytes", 1))
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(path, text):
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def _cells(r, n):
    words = ["plain", "two words", 'say ""hi""'.replace('""', '"'), "line\nbreak", "many\n\n\nbreaks, and commas", '"', '""', "a,b", "x\r\ny", 'mid"quote', "é漢"]
    return [[str(i), r.choice(words), r.choice(words) * r.randrange(1, 4), str(r.random())] for i in range(n)]


@pytest.mark.parametrize(("size", "end"), [("1500b", "\n"), ("4k", "\r\n")])
def test_csv_with_breaks(spark, tmp_path, rows_of, small_splits, size, end):
    r = random.Random(7)
    want = []
    for f in range(2):
        rows = _cells(r, 120)
        want += rows
        out = io.StringIO()
        csv.writer(out, lineterminator=end).writerows([["id", "a", "b", "x"], *rows])
        _write(tmp_path / f"in/{f}.csv", "\n" * f + out.getvalue())
    small_splits(size)
    df = sp.read_csv(spark, str(tmp_path / "in"), multiLine=True)
    assert df.dtypes == [("id", "int"), ("a", "string"), ("b", "string"), ("x", "double")]
    assert rows_of(df) == sorted(((int(i), a, b, float(x)) for i, a, b, x in want), key=repr)
    bare = sp.read_csv(spark, str(tmp_path / "in/0.csv"), multiLine=True, header=False, skip_lines=1, schema="id int, a string, b string, x double")
    assert bare.count() == 120 and bare.agg({"id": "sum"}).first()[0] == 7140


def test_csv_quotes_that_are_none(spark, tmp_path, rows_of, small_splits):
    # A quote inside of an unquoted cell is a letter; text behind a closing quote belongs to the cell; escapes by backslash.
    small_splits("600b")
    path = _write(tmp_path / "q.csv", "a,b\n" + '5" pipe,x\n"one\ntwo",z\nlast,"3 ""\n"" 4"\n' * 50)
    assert rows_of(sp.read_csv(spark, path, multiLine=True)) == sorted([('5" pipe', "x"), ("last", '3 "\n" 4'), ("one\ntwo", "z")] * 50)
    escaped = _write(tmp_path / "e.csv", "a,b\n" + '"x\\"\ny",1\n"q\nr",2\n' * 60)
    assert rows_of(sp.read_csv(spark, escaped, multiLine=True, escape="\\")) == sorted([("q\nr", 2), ('x"\ny', 1)] * 60)


def test_csv_bad_records(spark, tmp_path, rows_of):
    path = _write(tmp_path / "bad.csv", 'a,b\n"1\n",2\nx,3,4\n5,"6\n7"\n')
    assert rows_of(sp.read_csv(spark, path, multiLine=True, on_bad_lines="skip")) == [("1\n", "2"), ("5", "6\n7")]
    with pytest.raises(Exception, match="alformed"):
        sp.read_csv(spark, path, multiLine=True).collect()
    _write(tmp_path / "two/1.csv", "a,b\n1,2\n")
    _write(tmp_path / "two/2.csv", "b,a\n1,2\n")
    with pytest.raises(ValueError, match="headers"):
        sp.read_csv(spark, str(tmp_path / "two"), multiLine=True)
    with pytest.raises(ValueError, match="no file"):
        sp.read_csv(spark, str(tmp_path / "none"), multiLine=True)


def _records(n):
    r = random.Random(n)
    texts = ["plain", 'say "hi"', "br}ace ]and[ {", "\\", 'back\\"slash\\\\', "co,mma: x", "", "é漢\n\t", "x" * 90]
    return [{"id": i, "s": r.choice([None, *texts]), "n": {"l": [1, {"d": r.choice(texts)}], "m": r.random()}, "t": r.choice(texts)} for i in range(n)]


LAYOUTS = {
    "records": lambda rows: rows,
    "index": lambda rows: {f'k"{i}': row for i, row in enumerate(rows)},
    "columns": lambda rows: {n: {str(i): row[n] for i, row in enumerate(rows)} for n in rows[0]},
    "split": lambda rows: {"columns": list(rows[0]), "index": [[i, "}"] for i in range(len(rows))], "data": [list(row.values()) for row in rows]},
    "table": lambda rows: {"schema": {"fields": [{"name": n} for n in rows[0]]}, "data": rows},
}


@pytest.mark.parametrize(("orient", "size", "indent"), [*[(o, "600b", None) for o in LAYOUTS], ("records", "1500b", 2), ("split", "1500b", 2)])
def test_json_documents(spark, tmp_path, rows_of, small_splits, orient, size, indent):
    small_splits(size)
    rows = _records(30)
    flat = [{"id": r["id"], "s": r["s"], "t": r["t"]} for r in rows] if orient in ("columns", "split") else rows
    for i, part in enumerate((flat[:20], flat[20:])):
        _write(tmp_path / f"d/{i}.json", "﻿" * i + json.dumps(LAYOUTS[orient](part), indent=indent, ensure_ascii=bool(indent)) + "\n" * i)
    df = sp.read_json(spark, str(tmp_path / "d"), orient=orient, lines=False)
    if orient in ("columns", "split"):
        assert rows_of(df.select("id", "s", "t")) == sorted((tuple(r.values()) for r in flat), key=repr)
    else:
        got = df.selectExpr("id", "s", "n.m", "to_json(n.l) as l", "t").collect() if orient != "records" else df.selectExpr("id", "s", "n.m", "cast(n.l as string) as l", "t").collect()
        assert sorted((r.id, r.s, r.m, r.t) for r in got if r.s is not None) == sorted((r["id"], r["s"], r["n"]["m"], r["t"]) for r in rows if r["s"] is not None)
        assert len(got) == 30


def test_json_single_and_empty(spark, tmp_path, rows_of, small_splits):
    small_splits("500b")
    one = _write(tmp_path / "one.json", '\n {"a": {"b": "} ]' + "{x}," * 400 + '"},\n "c": [1, 2]}\n')
    assert rows_of(sp.read_json(spark, one, lines=False).selectExpr("left(a.b, 3)", "length(a.b)", "c")) == [("} ]", 1603, [1, 2])]
    two = _write(tmp_path / "e/two.json", "[ ]")
    _write(tmp_path / "e/one.json", ' [{"a": 1} , {"a": 2}\n]')
    assert rows_of(sp.read_json(spark, str(tmp_path / "e"), lines=False)) == [(1,), (2,)]
    assert sp.read_json(spark, two, lines=False, schema="a int").count() == 0


@pytest.mark.parametrize("orient", list(LAYOUTS))
def test_json_documents_written(spark, tmp_path, rows_of, orient):
    df = spark.createDataFrame([(i, None if i % 3 else f'a"{i}\n', i / 2, f"r{i}") for i in range(9)], "id int, s string, x double, key string").repartition(3)
    sp.write_json(df, str(tmp_path / "d"), orient=orient, index="key")
    for part in (tmp_path / "d").glob("*.txt"):
        json.loads(part.read_text())  # each part is a document of its own
    back = sp.read_json(spark, str(tmp_path / "d"), orient=orient, lines=False)
    assert rows_of(back.select("id", "s", "x")) == rows_of(df.select("id", "s", "x"))
    sp.write_json(df.where("false"), str(tmp_path / "none"), orient=orient)
    assert [json.loads(p.read_text()) is not None for p in (tmp_path / "none").glob("*.txt")] == [True]


XML = """<?xml version="1.0"?>
<data><p id="1"><r><v>1</v></r><r><v>2</v></r></p>
<q><r><v>3</v></r></q><p id="2"><r><v>4</v><n>x</n></r><t>only text</t></p></data>"""


@pytest.mark.parametrize(("xpath", "want"), [
    ("/data/p/r", [1, 2, 4]), ("/data/q/r", [3]), ("//r", [1, 2, 3, 4]), ("r", [1, 2, 3, 4]), ("./p/r", [1, 2, 4]), ("/data/*/r", [1, 2, 3, 4]),
    ("/data/p[2]/r", [4]), ("/data/p/r[2]", [2]), ("/data/p[@id='1']/r[last()]", [2]), ('/data/p/r[n="x"]', [4]), ("/data/p[last()]/r[v='4']", [4]), ("//r[v=3]", [3]),
])
def test_xml_paths(spark, tmp_path, xpath, want):
    path = _write(tmp_path / "x.xml", XML)
    assert sorted(r.v for r in sp.read_xml(spark, path, xpath=xpath).collect()) == want


def test_xml_paths_by_schema_and_refused(spark, tmp_path, rows_of):
    path = _write(tmp_path / "x.xml", XML)
    assert rows_of(sp.read_xml(spark, path, xpath="/data/p[@id='2']/r", schema="v string, n string")) == [("4", "x")]
    assert rows_of(sp.read_xml(spark, path, xpath="/data/p/t")) == [("only text",)]
    for xpath in ("/data/none", "/data/p/@id", "/data/p[position()>1]", "/*/p", "//p/r", "r[1]", "../p"):
        with pytest.raises(ValueError):
            sp.read_xml(spark, path, xpath=xpath)
