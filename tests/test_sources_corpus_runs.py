import json
import os

import pytest
from pyspark.errors import PySparkException

import sparkprep as sp
from sparkprep.functions.chunking import pack, split_fixed, split_recursive, split_sentences, words
from sparkprep.functions.html_text import html_markdown, html_text
from sparkprep.sources import jdbc
from sparkprep.streaming import runs

ROWS = [(43659, "2011-05-31", True, "Black"), (43660, "2011-05-31", False, "Blue"), (43661, "2011-06-01", True, None)]
LINES = ["43659;2011-05-31;True;Black", "43660;2011-05-31;False;Blue", "43661;2011-06-01;True;"]


def _write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_reading(spark, tmp_path):
    junk = _write(tmp_path / "junk.csv", "﻿Report\nby me\nno data here\n\nid;day;flag;color\n" + "\n".join(LINES) + "\n")
    df = sp.read_csv(spark, junk, separator=";", skip_lines=3)
    assert df.columns == ["id", "day", "flag", "color"] and df.count() == 3 and df.schema["flag"].dataType.simpleString() == "boolean"
    bare = _write(tmp_path / "bare.csv", "\n".join(x.replace(";", ",") for x in LINES))
    named = sp.read_csv(spark, bare, header=False, names=["id", "day", "flag", "color"])
    assert named.count() == 3 and named.schema["id"].dataType.simpleString() == "int"
    assert sp.read_csv(spark, bare, header=False).columns == ["_c0", "_c1", "_c2", "_c3"]
    comma = _write(tmp_path / "comma.csv", "a;b\n1,5;x\n2,25;y\n")
    assert [r.a for r in sp.read_csv(spark, comma, separator="infer", decimal=",").collect()] == [1.5, 2.25]
    assert sp.read_csv(spark, comma, separator=";", limit=1).count() == 1
    both = sp.read_csv(spark, str(tmp_path / "*a*.csv"), header=False)
    assert both.count() >= 3
    quoted = _write(tmp_path / "q.csv", 'a,b\n"x ""y"", z",1\n')
    assert sp.read_csv(spark, quoted).first().a == 'x "y", z'
    with pytest.raises(ValueError, match="no file"):
        sp.read_csv(spark, str(tmp_path / "none*.csv"))


def test_csv_bad_lines(spark, tmp_path):
    path = _write(tmp_path / "bad.csv", "a,b\n1,2\nx,3\n4,5\n")
    schema = "a int, b int"
    assert sp.read_csv(spark, path, schema=schema, on_bad_lines="skip").count() == 2
    with pytest.warns(UserWarning, match="1 malformed"):
        sp.read_csv(spark, path, schema=schema, on_bad_lines="warn")
    with pytest.raises(Exception, match="(?i)malformed"):
        sp.read_csv(spark, path, schema=schema).collect()


def test_csv_skipped_lines(spark, tmp_path):
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    (tmp_path / "many").mkdir()
    for i in range(3):
        _write(tmp_path / f"many/{i}.csv", f'junk {i}\n,"\n\na,,c\n{i},"x, ""y""",7\n,,{i}\n')
    df = sp.read_csv(spark, str(tmp_path / "many"), skip_lines=2)
    assert df.columns == ["a", "_c1", "c"] and rows(df) == sorted([x for i in range(3) for x in ((i, 'x, "y"', 7), (None, None, i))], key=repr)
    bare = _write(tmp_path / "bare.csv", "junk\n1,,3\n4,5,6\n")
    assert rows(sp.read_csv(spark, bare, skip_lines=1, header=False)) == [(1, None, 3), (4, 5, 6)]
    bad = _write(tmp_path / "bad.csv", "junk\na,b\n1,2\n3,4,5\n6,7\n")
    assert rows(sp.read_csv(spark, bad, skip_lines=1, on_bad_lines="skip")) == [(1, 2), (6, 7)]
    with pytest.warns(UserWarning, match="1 malformed"):
        sp.read_csv(spark, bad, skip_lines=1, on_bad_lines="warn")
    with pytest.raises(Exception, match="(?i)malformed"):
        sp.read_csv(spark, bad, skip_lines=1).collect()
    broken = _write(tmp_path / "broken.csv", 'junk\na,b\n"x\ny",1\nz,2\n')
    assert rows(sp.read_csv(spark, broken, skip_lines=1, multiLine=True)) == [("x\ny", 1), ("z", 2)]
    assert rows(sp.read_csv(spark, broken, skip_lines=2, header=False, multiLine=True)) == [("x\ny", 1), ("z", 2)]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
        long = _write(tmp_path / "long.csv", "".join(f"junk {i}\n" for i in range(30)) + "\na;b\n" + "".join(f"{i};{2 * i}\n" for i in range(60)))
        assert rows(sp.read_csv(spark, long, separator="infer", skip_lines=30)) == sorted([(i, 2 * i) for i in range(60)], key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    (tmp_path / "mixed").mkdir()
    _write(tmp_path / "mixed/1.csv", "a,b\n1,2\n")
    _write(tmp_path / "mixed/2.csv", "a;b\n1;2\n")
    with pytest.raises(ValueError, match="different separators"):
        sp.read_csv(spark, str(tmp_path / "mixed"), separator="infer")
    with pytest.raises(ValueError, match="different headers"):
        sp.read_csv(spark, str(tmp_path / "mixed"), skip_lines=1, header=True)
    with pytest.raises(ValueError, match="no lines left"):
        sp.read_csv(spark, bare, skip_lines=9)


@pytest.mark.parametrize("orient,text", [
    ("records", [{"a": 1, "b": "x"}, {"a": 2, "b": None}]),
    ("columns", {"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": None}}),
    ("index", {"0": {"a": 1, "b": "x"}, "1": {"a": 2, "b": None}}),
    ("split", {"columns": ["a", "b"], "index": [0, 1], "data": [[1, "x"], [2, None]]}),
    ("table", {"schema": {}, "data": [{"a": 1, "b": "x"}, {"a": 2, "b": None}]}),
])
def test_json_orients(spark, tmp_path, rows_of, orient, text):
    path = _write(tmp_path / "d.json", json.dumps(text))
    assert rows_of(sp.read_json(spark, path, orient).select("a", "b")) == [(1, "x"), (2, None)]


def test_xml_and_dispatch(spark, tmp_path):
    row = "<_empty_><SupplierID>{0}</SupplierID><PostalCode>{1}</PostalCode></_empty_>"
    for i, keys in enumerate([(1, 2), (3,)]):
        body = "".join(row.format(k, "EC1 4SD" if k == 1 else "70117") for k in keys)
        _write(tmp_path / f"s_{i}.xml", f"<?xml version='1.0'?><Suppliers>{body}</Suppliers>")
    df = sp.read_xml(spark, str(tmp_path / "s_*.xml"), xpath="//_empty_")
    assert df.count() == 3 and df.schema["PostalCode"].dataType.simpleString() == "string"
    assert sp.read_file(spark, str(tmp_path / "s_0.xml"), row_tag="_empty_").count() == 2
    lines = _write(tmp_path / "x.jsonl", '{"a": 1}\n{"a": 2}\n')
    assert sp.read_file(spark, lines).count() == 2
    assert sp.read_file(spark, _write(tmp_path / "t.tsv", "a\tb\n1\t2\n")).columns == ["a", "b"]
    with pytest.raises(ValueError, match="no reader"):
        sp.read_file(spark, "x.xlsx")


def test_writers(spark, tmp_path, rows_of):
    df = spark.createDataFrame([(1, 'say "hi"', 2.5), (2, None, None)], "i int, s string, d double")
    for quoting in ("minimal", "all", "nonnumeric", "none"):
        path = str(tmp_path / quoting)
        sp.write_csv(df if quoting != "none" else df.where("i = 2"), path, quoting=quoting)
        lines = [x for f in os.listdir(path) if f.endswith(".csv") for x in open(f"{path}/{f}").read().splitlines()]
        body = [x for x in lines if "i" not in x.split(",")[0]]
        if quoting == "nonnumeric":
            assert sorted(body) == ['1,"say ""hi""",2.5', '2,"",'] and '"i","s","d"' in lines
        if quoting == "all":
            assert '"1","say ""hi""","2.5"' in body
    sp.write_csv(df, str(tmp_path / "all"), mode="append")
    with pytest.raises(PySparkException):
        sp.write_json(df, str(tmp_path / "all"), mode="exclusive")
    sp.write_parquet(df, str(tmp_path / "p"), compression="none", partition_by="i")
    assert sp.read_parquet(spark, str(tmp_path / "p")).count() == 2
    sp.write_file(df, str(tmp_path / "x"), "xml")
    assert sp.read_xml(spark, str(tmp_path / "x"), "row").count() == 2
    payload = sp.record_payload(df, columns=["i", "s"]).orderBy("i").first().payload
    assert json.loads(payload) == {"i": 1, "s": 'say "hi"'}
    for bad in ({"mode": "w"}, {"quoting": "some"}):
        with pytest.raises(ValueError):
            sp.write_csv(df, str(tmp_path / "z"), **bad)


def test_inline(spark, rows_of):
    assert rows_of(sp.inline(spark, "a,b\n1,x\n2,y", "csv")) == [(1, "x"), (2, "y")]
    assert sp.inline(spark, "a|b\n1|x", "csv", "|", "all_string").dtypes == [("a", "string"), ("b", "string")]
    assert rows_of(sp.inline(spark, '{"b": 1, "a": "q"}', "json")) == [(1, "q")]
    assert rows_of(sp.inline(spark, "[1, 2]", "json")) == [(1,), (2,)]
    assert sp.inline(spark, "some text").first().value == "some text"
    with pytest.raises(ValueError):
        sp.inline(spark, "  ")


def test_calendar(spark):
    days = sp.generate_calendar(spark, "2024-02-28", "2024-03-02")
    rows = days.orderBy("calendar_date").collect()
    assert len(rows) == 4 and rows[1].weekday_name == "Thursday" and rows[1].weekday_number == 4 and rows[1].week == 9
    assert [r.is_weekend for r in rows] == [False, False, False, True] and rows[0].month_name == "February"
    assert sp.generate_calendar(spark, "2024-03-31", "2024-03-31", back=(1, "months")).count() == 32
    assert sp.generate_calendar(spark, "2024-01-01", "2025-01-01", fields=["year"]).count() == 2
    assert sp.generate_calendar(spark, back=(1, "weeks"), ahead=(1, "days")).count() == 9
    with pytest.raises(PySparkException):
        sp.generate_calendar(spark, "2024-02-01", "2024-01-01").collect()
    with pytest.raises(ValueError):
        sp.generate_calendar(spark, fields=["moon"])


def test_jdbc_options():
    options = jdbc.jdbc_options(provider="postgres", host="h", database="d", user="u", password="p")
    assert options == {"url": "jdbc:postgresql://h:5432/d", "user": "u", "password": "p"}
    assert jdbc.jdbc_url("oracle", "h", "svc", 1600) == "jdbc:oracle:thin:@//h:1600/svc"
    part = {"partitionColumn": "id", "lowerBound": 0, "upperBound": 9, "numPartitions": 3}
    assert jdbc._reading(None, "select 1", part)["dbtable"] == "(select 1) q"
    for bad in (lambda: jdbc._reading("t", "q", None), lambda: jdbc._reading("t", None, {"lowerBound": 1}), lambda: jdbc.jdbc_options(host="h")):
        with pytest.raises(ValueError):
            bad()


def test_jdbc_mapping(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert jdbc.mapped(df, {"b": "name"}).columns == ["name"]
    with pytest.raises(ValueError):
        sp.write_jdbc(df, "t", if_exists="merge", url="jdbc:none")


def test_pack_against_brute_force():
    """Chunks in order: each fits, starts with the longest tail that may be repeated, and nothing is lost."""
    import random

    rnd = random.Random(4)
    for _ in range(200):
        pieces = ["x" * rnd.randint(1, 6) for _ in range(rnd.randint(1, 25))]
        pieces = [p + str(i) for i, p in enumerate(pieces)]
        size, overlap = rnd.randint(8, 25), rnd.randint(0, 7)
        chunks = pack(pieces, size, overlap, " ", len)
        assert all(len(ch) <= size or " " not in ch for ch in chunks)
        starts = []
        for chunk in chunks:
            parts = chunk.split(" ")
            at = pieces.index(parts[0])
            assert pieces[at : at + len(parts)] == parts
            starts.append((at, at + len(parts)))
        assert starts[0][0] == 0 and starts[-1][1] == len(pieces)
        for (a, b), (a2, b2) in zip(starts, starts[1:]):
            assert a < a2 <= b < b2
            kept = " ".join(pieces[a2:b])
            assert len(kept) <= overlap
            longer = pieces[a2 - 1 : b]  # one more piece would be too long or leave no room for the next one
            assert len(" ".join(longer)) > overlap or len(" ".join(longer + [pieces[b]])) > size
            assert len(" ".join(pieces[a : b + 1])) > size


def test_split_functions():
    assert split_fixed("a--b--c", "--", False, 4, 0, len) == ["a--b", "c"]
    assert split_fixed("one two three four", " ", False, 2, 1, words) == ["one two", "two three", "three four"]
    assert split_fixed("a1b22c", r"\d+", True, 3, 0, len) == ["a b", "c"]
    text = "Para one is here.\n\nPara two is a bit longer than one.\nAnd has lines.\n\nend"
    chunks = split_recursive(text, ["\n\n", "\n", " ", ""], False, 20, 0, len)
    assert all(len(x) <= 20 for x in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert split_recursive("abcdefgh", ["", ], False, 3, 1, len) == ["abc", "cde", "efg", "gh"]
    assert split_sentences('He said "no." Then? Yes!\n\nNew part') == ['He said "no."', "Then?", "Yes!", "New part"]


def test_chunk_operators(spark):
    long = "word " * 3000
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, long)], "id int, t string")
    out = sp.fixed_size_chunks(df, "t", 4, 1, separator="")
    assert [r.chunk for r in out.where("id = 1").orderBy("chunk_no").collect()] == ["abcd", "defg", "ghij"]
    assert [r.chunk for r in sp.fixed_size_chunks(df, "t", 4, 3, separator="").where("id = 1").collect()][-1] == "ghij"
    for fn in (sp.fixed_size_chunks, sp.recursive_chunks, sp.sentence_chunks):
        chunks = fn(df, "t", 100, 10).where("id = 4").collect()
        assert {r.id for r in fn(df, "t", 100).collect()} == {1, 4}
        assert sum(r.chunk.count("word") for r in chunks) >= 3000
    worded = sp.fixed_size_chunks(df, "t", 50, separator=" ", unit="word").where("id = 4")
    assert worded.count() == 60
    with pytest.raises(ValueError):
        sp.fixed_size_chunks(df, "t", 5, 5)
    docs = sp.to_documents(df, "t")
    assert docs.columns == ["page_content", "metadata"] and docs.where("page_content = ''").first().metadata == {"id": "2"}


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><h1>Big &amp; <i>fine</i></h1>
<div class="ad x"><p>buy</p></div><!-- note --><p>See <a href="http://x.org">http://x.org</a> and <a href="/y">more</a><br>now</p>
<ul><li>one</li><li>two <b>bold</b></li></ul><ol><li>first<li>second</ol><img src="i.png" alt="pic"></body></html>"""


def test_html(spark):
    text = html_text(PAGE, ["p", "li"], ["script"], ["ad"], True, False)
    assert text == "See http://x.org (http://x.org) and more (/y) now one two bold first second"
    assert "buy" in html_text(PAGE, ["div"], [], [], True, False)
    md = html_markdown(PAGE)
    assert md.startswith("# Big & *fine*") and "<http://x.org> and [more](/y)" in md and "* two **bold**" in md
    assert "1. first" in md and "![pic](i.png)" in md and "var a" not in md
    assert "[more]" not in html_markdown(PAGE, strip=["a"]) and "more" in html_markdown(PAGE, strip=["a"])
    only = html_markdown(PAGE, convert=["b"])
    assert "**bold**" in only and "# Big" not in only
    df = spark.createDataFrame([(1, PAGE), (2, None)], "i int, h string")
    assert [r.text is None for r in sp.parse_html(df, "h").orderBy("i").collect()] == [False, True]
    assert sp.html_to_markdown(df, "h").orderBy("i").first().markdown == md


def test_custom_code(spark, rows_of, tmp_path):
    df = spark.range(10).selectExpr("id", "id % 3 as k")
    sums = sp.pandas_transform(df, lambda g: g.groupby("k", as_index=False)["id"].sum(), "k bigint, id bigint", by=["k"])
    assert rows_of(sums) == [(0, 18), (1, 12), (2, 15)]
    log = tmp_path / "calls"

    def answer(client, row):
        with open(log, "a") as f:
            f.write("x")
        return f"{client}{row['k']}"

    out = sp.enrich(df, answer, ["k"], "a", setup=lambda: "c")
    assert out.count() == 10 and out.where("a = 'c1'").count() == 3
    assert log.read_text() == "xxx"  # one call per distinct input, none again on re-reading

    fails = tmp_path / "fails"

    def flaky(row):
        with open(fails, "a") as f:
            f.write("x")
        if len(fails.read_text()) < 3:
            raise RuntimeError("later")
        return "ok"

    one = spark.createDataFrame([("a",)], "k string")
    assert sp.enrich(one, flaky, ["k"], "r", retries=4, wait=0.01).first().r == "ok"
    assert sp.python_transform(df, lambda d: d.limit(1)).count() == 1
    assert sp.python_input(spark, lambda s: s.range(3)).count() == 3
    joined = sp.sql_query([df, df], "select count(*) as n from input_df1 a join input_df2 b on a.id = b.id")
    assert joined.first().n == 10 and not [t for t in spark.catalog.listTables() if t.name.startswith("input_")]


def test_pipeline_documents(spark, tmp_path):
    spec = {
        "nodes": [
            {"id": "a", "type": "inline", "data": {"text": "k,v\n1,x\n2,y\n3,z", "fmt": "csv"}},
            {"id": "s", "type": "switch_rows", "data": {"column": "k", "op": ">=", "value": "${least}"}},
            {"id": "w", "type": "write_csv", "data": {"path": str(tmp_path / "out")}},
            {"id": "q", "type": "sql_query", "data": {"query": "select max(k) as k from input_df1"}},
        ],
        "edges": [
            {"source": "a", "target": "s"}, {"source": "s", "target": "w", "sourceHandle": "true"},
            {"source": "s", "target": "q", "sourceHandle": "false"},
        ],
    }
    assert sp.run_pipeline(spark, json.dumps(spec), until="q", params={"least": 3}).first().k == 2
    assert not (tmp_path / "out").exists()
    made = sp.run_pipeline(spark, spec, params={"least": 2}, shared="write")
    assert set(made) == {"a", "s", "w", "q"} and sp.read_csv(spark, str(tmp_path / "out")).count() == 2
    circle = {"nodes": spec["nodes"], "edges": spec["edges"] + [{"source": "q", "target": "a"}, {"source": "s", "target": "s"}]}
    with pytest.raises(ValueError, match="circle"):
        sp.run_pipeline(spark, circle)
    for bad in ({"id": "b", "type": "nothing"}, {"id": "b", "type": "compare"}, {"id": "b", "type": "inline", "data": {"txt": 1}}):
        with pytest.raises(ValueError, match="'b'"):
            sp.run_pipeline(spark, {"nodes": [bad], "edges": []})


@pytest.fixture
def stream_folder(spark, tmp_path):
    df = spark.range(400).selectExpr(
        "id", "id % 7 as k", "concat('a:', id) as t", "timestamp_seconds(id * 60) as ts", "cast(id as double) / 3 as v")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), df


OPS_ON_STREAMS = [
    lambda d: sp.filter_rows(d, "k", ">", 2),
    lambda d: sp.switch_rows(d, "k", "==", 1)[1],
    lambda d: sp.formula(d, [("v", "v * 2")]),
    lambda d: sp.split_to_rows(d, "t", ":"),
    lambda d: sp.unpivot(d, ["id"], ["k", "v"]),
    lambda d: sp.extract(d, "t", r"(\d+)", "n"),
    lambda d: sp.concat_columns(d, ["k", "t"], "c", separator="/"),
    lambda d: sp.convert_types(d, ["t"], "int64", "coerce"),
    lambda d: sp.cleanse(d, ["t"], remove=["numbers"], case="upper"),
    lambda d: sp.markdown_style(d, ["t"], ["Bold"]),
    lambda d: sp.explode_json(sp.record_payload(d, '{"n": [{{id}}, 1]}').select("id", "payload"), "payload", schema="struct<n: array<bigint>>"),
    lambda d: sp.fixed_size_chunks(d.select("id", "t"), "t", 2, separator=""),
    lambda d: sp.rename_dynamic(d, case="upper"),
    lambda d: sp.validate_json(d, ["t"]),
    lambda d: sp.datetime_to_text(d, "ts", "%Y/%m/%d", "day"),
]


def test_streams_equal_batches(spark, stream_folder, rows_of):
    folder, df = stream_folder
    for op in OPS_ON_STREAMS:
        stream = runs.stream_files(spark, folder, df.schema, files_per_batch=2)
        out = spark.read.parquet(runs.run_available(op(stream)))
        assert rows_of(out) == rows_of(op(df))


def test_stream_static_join_dedup_batches_and_restart(spark, stream_folder, tmp_path, rows_of):
    folder, df = stream_folder
    names = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "k bigint, name string")

    def stream(n=None):
        return runs.stream_files(spark, folder, df.schema, files_per_batch=n)

    joined = sp.join_datasets(stream(), names, on="k", how="inner")
    assert spark.read.parquet(runs.run_available(joined)).count() == sp.join_datasets(df, names, on="k", how="inner").count()
    single = runs.deduplicate_stream(stream(1), ["k"], "ts", "10 days")
    assert rows_of(spark.read.parquet(runs.run_available(single)).select("k")) == [(i,) for i in range(7)]
    seen = []
    runs.run_batches(stream(1), lambda batch, number: seen.append(batch.count()))
    assert sum(seen) == 400 and len(seen) == 4
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        runs.run_available(stream(), out, check)
    assert spark.read.parquet(out).count() == 400
    df.limit(5).write.mode("append").parquet(folder)
    runs.run_available(stream(), out, check)
    assert spark.read.parquet(out).count() == 405
    hours = runs.aggregate_stream(stream(), ["k"], [("id", "count"), ("v", "mean")], "ts", "1 hour", "0 seconds")
    closed = spark.read.parquet(runs.run_available(hours))
    assert closed.columns == ["window_start", "window_end", "k", "id_count", "v_mean"] and closed.count() >= 5 * 7
    with pytest.raises(ValueError):
        runs.aggregate_stream(stream(), ["k"], [("id", "median")], "ts", "1 hour", "1 hour")
