"""All registered queries against their SQL in DuckDB (or, without SQL, that they give rows) at the smallest scale."""

import inspect
import os

import duckdb
import pytest

import __spark_entry__ as entry
import catalog
import oracle
import sparkprep as sp

FOLDER = "/root/testdata/sf0.001"
# Chunks and pages go through code that SQL has no word for; their tests are by hand. Operators for training data have theirs.
WITHOUT_SQL = {"chunks_at_separator", "chunks_recursive", "chunks_of_sentences", "html_text", "html_to_markdown"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in entry.oracle_sql():
        assert oracle.differences(df, duck, entry.oracle_sql()[name]) == []
    else:
        assert name in WITHOUT_SQL or name in entry.queries().keys() - catalog.QUERIES.keys()
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_operator_is_registered_or_tested():
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    texts = "".join(
        open(os.path.join(folder, f)).read() for folder in (here, os.path.join(root, "catalog")) for f in os.listdir(folder) if f.endswith(".py")
    )
    functions = [n for n in sp.__all__ if inspect.isfunction(getattr(sp, n))]
    assert [n for n in functions if f"sp.{n}(" not in texts and n not in ("read_jdbc", "read_mongodb", "local_session", "deliver", "python_output", "json_schema", "drop_copies", "run_pipeline")] == []
    assert duckdb.__version__
