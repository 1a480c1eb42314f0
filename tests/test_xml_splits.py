"""Elements at a path from the root, cut out of splits that begin anywhere."""

import pytest

import sparkprep as sp

DATA = """<?xml version="1.0"?><!DOCTYPE data [<!ELEMENT p ANY>]><!-- <data><p><v>no</v></p></data> -->
<data note='a > b "p>"'>""" + "".join(
    f"""<p id="{i} > 0" other='/p>'><v>{i}</v><!-- </p> > --><inner><p><v>-1</v></p></inner><w><![CDATA[<p> ]] > </data> {i}]]></w></p>
<q><p><v>-2</v></p></q><p k="{i}/"/>""" for i in range(8)) + "</data>\n"


@pytest.mark.parametrize("size", [97, 1 << 27])
def test_elements_of_all_splits(spark, tmp_path, size):
    (tmp_path / "x.xml").write_text(DATA)
    (tmp_path / "y.xml").write_text("<other><p><v>-3</v></p></other>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = sp.read_xml(spark, str(tmp_path), xpath="/data/p", schema="_id string, v long, w string, _k string").collect()
        deep = sp.read_xml(spark, str(tmp_path), xpath="/data/q/p", schema="v long").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    full = sorted((r.v, r["_id"], r.w) for r in rows if r.v is not None)
    assert full == [(i, f"{i} > 0", f"<p> ]] > </data> {i}") for i in range(8)]
    assert sorted(int(r["_k"][:-1]) for r in rows if r.v is None) == list(range(8))
    assert [r.v for r in deep] == [-2] * 8


def test_one_file_takes_many_tasks(spark, tmp_path):
    (tmp_path / "x.xml").write_text(DATA)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        from sparkprep.sources.splits import xml_elements

        assert xml_elements(spark, str(tmp_path), ["data", "p"]).select("of", "start").distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
