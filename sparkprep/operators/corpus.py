"""Document corpora: chunking and HTML over tables of texts.

The texts are cut by Arrow and pandas UDFs that see only the text column; Spark splits the table over tasks, and the other
columns never leave the JVM. Every text is processed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep._columns import c, require
from sparkprep.functions.chunking import pack, split_fixed, split_recursive, split_sentences, words
from sparkprep.functions.html_text import html_markdown, html_text


SLICE_ROWS = 64

# The white space that str.strip() takes off.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def to_documents(df: DataFrame, content: str) -> DataFrame:
    """page_content and metadata (all other columns as a map of text)."""
    require(df, [content])
    entries = [x for n in df.columns if n != content for x in (F.lit(n), c(n).cast("string"))]
    metadata = F.create_map(*entries) if entries else F.expr("cast(map() as map<string,string>)")
    return df.select(c(content).alias("page_content"), metadata.alias("metadata"))


def _checked(size: int, overlap: int, unit: str) -> Callable[[str], int]:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("chunk size must be positive and the overlap smaller than it")
    if unit not in ("char", "word"):
        raise ValueError("unit must be 'char' or 'word'")
    return len if unit == "char" else words


def _in_slices(texts: pa.Array, cut_text: Callable[[str], list[str]]) -> pa.Array:
    """The chunks of a batch. It stays as Arrow holds it; ``SLICE_ROWS`` of its texts are Python objects at a time."""
    kind = pa.list_(pa.string())
    made = [pa.array([], kind)]
    for at in range(0, len(texts), SLICE_ROWS):
        some = texts.slice(at, SLICE_ROWS).to_pylist()
        made.append(pa.array([cut_text(t) if t is not None else [] for t in some], kind))
    return pa.concat_arrays(made)


def _chunked(df: DataFrame, column: str, cut_text: Callable[[str], list[str]], name: str, number: str) -> DataFrame:
    chunks = F.arrow_udf(lambda texts: _in_slices(texts, cut_text), "array<string>")
    others = [c(n) for n in df.columns if n != column]
    return df.select(*others, F.posexplode(chunks(c(column).cast("string"))).alias(number, name))


def fixed_size_chunks(
    df: DataFrame, column: str, size: int, overlap: int = 0, separator: str = "\n\n", regex: bool = False,
    unit: str = "char", name: str = "chunk", number: str = "chunk_no",
) -> DataFrame:
    """Split at a separator and pack the parts to chunks of ``size`` characters or words, with overlap.

    With separator '' the chunks are plain character windows, which need no Python.
    """
    require(df, [column])
    length = _checked(size, overlap, unit)
    if separator == "" and unit == "char":
        return _windows(df, column, size, overlap, name, number)
    return _chunked(df, column, lambda t: split_fixed(t, separator, regex, size, overlap, length), name, number)


def _windows(df: DataFrame, column: str, size: int, overlap: int, name: str, number: str) -> DataFrame:
    step = size - overlap
    text = c(column).cast("string")
    # A window starts while there is text beyond the overlap with the one before.
    last = F.greatest(F.ceil((F.char_length(text) - overlap) / F.lit(step)) - 1, F.lit(0))
    starts = F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))
    chunks = F.transform(starts, lambda k: F.btrim(F.substr(text, (k * step + 1).cast("int"), F.lit(size)), F.lit(_BLANKS)))
    kept = F.filter(chunks, lambda x: x != "")
    others = [c(n) for n in df.columns if n != column]
    return df.select(*others, F.posexplode(kept).alias(number, name))


def recursive_chunks(
    df: DataFrame, column: str, size: int, overlap: int = 0, separators: Iterable[str] = ("\n\n", "\n", " ", ""),
    regex: bool = False, unit: str = "char", name: str = "chunk", number: str = "chunk_no",
) -> DataFrame:
    """Split at the first separator that occurs, and parts that are too long at the following ones; then pack."""
    require(df, [column])
    length, separators = _checked(size, overlap, unit), list(separators)
    return _chunked(df, column, lambda t: split_recursive(t, separators, regex, size, overlap, length), name, number)


def sentence_chunks(
    df: DataFrame, column: str, size: int, overlap: int = 0, joiner: str = "\n\n", name: str = "chunk", number: str = "chunk_no"
) -> DataFrame:
    """Pack whole sentences to chunks of ``size`` characters."""
    require(df, [column])
    _checked(size, overlap, "char")
    return _chunked(df, column, lambda t: pack(split_sentences(t), size, overlap, joiner, len), name, number)


def parse_html(
    df: DataFrame, column: str, tags: Iterable[str] = ("p", "li", "div", "a"), unwanted: Iterable[str] = ("script", "style"),
    remove_classes: Iterable[str] = (), remove_lines: bool = True, remove_comments: bool = False, name: str = "text",
) -> DataFrame:
    """The text of the chosen tags of HTML pages, without unwanted tags and classes."""
    require(df, [column])
    tags, unwanted, classes = list(tags), list(unwanted), list(remove_classes)

    @F.pandas_udf("string")
    def text_of(pages: pd.Series) -> pd.Series:
        return pages.map(
            lambda page: html_text(page, tags, unwanted, classes, remove_lines, not remove_comments), na_action="ignore"
        )

    return df.withColumn(name, text_of(c(column)))


def html_to_markdown(
    df: DataFrame, column: str, strip: Iterable[str] = (), convert: Iterable[str] | None = None, autolinks: bool = True,
    name: str = "markdown",
) -> DataFrame:
    """HTML pages as Markdown. Either name the tags to ``strip`` of their marks or the only ones to ``convert``."""
    require(df, [column])
    strip, convert = list(strip), None if convert is None else list(convert)
    if strip and convert is not None:
        raise ValueError("give either strip or convert")

    @F.pandas_udf("string")
    def markdown_of(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: html_markdown(page, strip, convert, autolinks), na_action="ignore")

    return df.withColumn(name, markdown_of(c(column)))
