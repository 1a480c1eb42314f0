"""File sources: CSV, JSON, Parquet, XML, by any path or glob Spark can read."""

from __future__ import annotations

import json
import re
import uuid
import warnings
from collections.abc import Iterable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import as_list, c
from sparkprep.session import _written, cut, shared_folder
from sparkprep.sources.splits import chunks, csv_records, json_elements, parsed, runs, xml_elements

_SEPARATORS = [",", ";", "\t", "|", " "]


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def _checked(read, path):
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise ValueError(f"no file found for {path!r}") from error
        raise


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    separator: str = ",",
    header: bool = True,
    names: Iterable[str] | None = None,
    schema: str | T.StructType | None = None,
    encoding: str = "UTF-8",
    decimal: str = ".",
    quote: str = '"',
    escape: str | None = None,
    on_bad_lines: str = "error",
    skip_lines: int = 0,
    limit: int | None = None,
    **options,
) -> DataFrame:
    """CSV, TSV and text files (also compressed; a glob reads all files that match; none is an error).

    ``separator='infer'`` picks the one that splits the first lines most evenly; files that differ in it are refused. ``names``
    renames the columns, in place of a header if there is none. Without ``schema`` the types are inferred, which reads the
    files once more. ``on_bad_lines``: error, warn, skip. ``skip_lines`` leaves out lines before the header of each file; what
    is left is copied to the shared folder and read like any CSV. With ``multiLine`` cells may hold line breaks inside of quotes:
    the records are cut out of all splits of a file in parallel (``splits``) and copied there too.
    ``decimal=','`` reads numbers with a decimal comma.
    """
    if on_bad_lines not in ("error", "warn", "skip"):
        raise ValueError("on_bad_lines must be 'error', 'warn' or 'skip'")
    source = path if isinstance(path, (str, list)) else str(path)
    if separator == "infer":
        separator = _guess_separator(spark, source, encoding, skip_lines, options)
    mode = "FAILFAST" if on_bad_lines == "error" else "PERMISSIVE"
    reader = spark.read.option("sep", separator).option("encoding", encoding).option("quote", quote).option("mode", mode)
    # Doubled quotes inside a quoted cell are one quote.
    reader = reader.option("escape", escape or quote).option("header", str(header).lower()).options(**options)
    whole = str(options.get("multiLine", "false")).lower() == "true"
    if whole:
        if options.get("lineSep", "\n") not in ("\n", "\r\n"):
            raise ValueError("with multiLine, records end in line breaks: lineSep must be \\n or \\r\\n")
        wanted = {**options, "encoding": encoding}
        records = _checked(lambda: csv_records(spark, source, separator, quote, escape or quote, skip_lines, options.get("comment"), wanted), path)
        if header:
            tops = records.where("mark = 'first'").groupBy("text").agg(F.min("of").alias("of"))
            if tops.limit(2).count() > 1:
                raise ValueError(f"files with different headers in {path!r}")
            top, records = tops.select("text"), records.where("mark is null")
            if schema is None:
                named = reader.option("inferSchema", "true") if decimal == "." else reader
                schema_of = parsed(named.option("header", "true"), top.unionByName(records.select("text")), "csv").schema
                reader = reader.schema(schema_of)
        reader = reader.option("header", "false")
    elif skip_lines:
        plain = spark.read.option("sep", separator).option("quote", quote).option("escape", escape or quote)
        source = _without_first_lines(spark, source, encoding, skip_lines, header, plain, {**options, "sep": separator})
        reader = reader.option("encoding", "UTF-8").option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    elif decimal == "." and not (whole and header):
        reader = reader.option("inferSchema", "true")

    def read(with_options: DataFrameReader) -> DataFrame:
        return parsed(with_options, records.select("text"), "csv") if whole else with_options.csv(source)

    df = _checked(lambda: read(reader), path)
    if on_bad_lines != "error":
        df = _good_lines(reader, read, df, on_bad_lines == "warn", source)
    if names:
        names = list(names)
        df = df.toDF(*names, *df.columns[len(names):])
    if decimal != "." and schema is None:
        df = _with_decimal(df, decimal)
    return _limited(df, limit)


def _numbered(spark: SparkSession, path, encoding: str, skip: int, options: dict) -> tuple[DataFrame, dict]:
    """Lines (value, file, start, n), and for each split (file, start) the first ``n`` behind the file's first ``skip`` lines
    (null where these are all of its lines).

    ``n`` counts on from line to line in a split of a file. One row per split comes to the driver.
    """
    reader = spark.read.option("encoding", encoding)
    reader = reader.options(**{k: v for k, v in options.items() if k in ("lineSep", "recursiveFileLookup", "pathGlobFilter")})
    lines = _checked(lambda: reader.text(path), path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    begins, left = {}, {}
    splits = lines.groupBy("file", "start").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("count")).collect()
    for r in sorted(splits):
        if r["high"] - r["low"] + 1 != r["count"]:
            raise ValueError(f"{r['file']} is named more than once")
        todo = left.get(r["file"], skip)
        begins[r["file"], r["start"]] = r["low"] + todo if todo < r["count"] else None
        left[r["file"]] = max(0, todo - r["count"])
    return lines, begins


def _behind(lines: DataFrame, begins: dict) -> DataFrame:
    """The lines from each split's given number on."""
    table = lines.sparkSession.createDataFrame([(*k, n) for k, n in begins.items()], "file string, start long, begin long")
    return lines.join(F.broadcast(table), ["file", "start"]).where("n >= begin")


def _splits_evenly(head: list[str]) -> str | None:
    """The separator that splits some lines most evenly, if any does."""
    def score(sep: str) -> tuple[bool, int]:
        counts = [line.count(sep) for line in head]
        return (min(counts) == max(counts) and counts[0] > 0, min(counts))

    best = max(_SEPARATORS, key=score) if head else None
    return best if best and score(best)[1] else None


def _guess_separator(spark: SparkSession, path, encoding: str, skip: int, options: dict) -> str:
    """The separator by the first lines, up to 20 that are not blank, of each file's first split; behind lines to skip, of the
    first splits with lines left. Each file gives its own guess, and one row per guess comes to the driver."""
    if skip:
        lines, begins = _numbered(spark, path, encoding, skip, options)
        tops: dict[str, list] = {}
        for (file, start), n in sorted((k, n) for k, n in begins.items() if n is not None):
            tops.setdefault(file, []).append((start, n))
        if not tops:
            return ","
        near = _behind(lines, {(f, start): n for f, kept in tops.items() for start, n in kept[:50]}).where(F.trim("value") != "")

        def look(lines_of_file: pd.DataFrame) -> pd.DataFrame:
            sep = _splits_evenly(lines_of_file.sort_values(["start", "n"]).value.tolist()[:20])
            return pd.DataFrame({"sep": [sep] if sep else []}, dtype=object)

        guesses = near.where(F.col("n") < F.col("begin") + 40).groupBy("file").applyInPandas(look, "sep string")
    else:
        lines = _checked(lambda: chunks(spark, path, options.get("lineSep", "\n"), {**options, "encoding": encoding}), path)

        def guess(batches):
            heads: dict[int, list[str]] = {}
            for (of, start), values in runs(batches):
                head = heads.setdefault(of, []) if not start else [""] * 20
                if len(head) < 20:
                    head += [v for v in values if v.strip()][: 20 - len(head)]
            for sep in filter(None, map(_splits_evenly, heads.values())):
                yield pa.RecordBatch.from_pydict({"sep": [sep]})

        guesses = lines.mapInArrow(guess, "sep string")
    found = sorted(r["sep"] for r in guesses.distinct().collect())
    if len(found) > 1:
        raise ValueError(f"files with different separators: {', '.join(map(repr, found))} in {path!r}")
    return found[0] if found else ","


def _without_first_lines(spark: SparkSession, path, encoding: str, skip: int, header: bool, reader: DataFrameReader, options: dict) -> str:
    """A folder of CSV files with a header: the lines of each file after its first ``skip``.

    Lines are written by the tasks that read them, each piece under the one header, so the CSV reader does the rest. Files must
    have the same header; without one, the first record of the first file gives the number of columns.
    """
    lines, begins = _numbered(spark, path, encoding, skip, options)
    comment = options.get("comment")
    filled = F.trim("value") != ""
    filled = filled & ~F.col("value").startswith(comment) if comment else filled
    tops = _behind(lines, begins).where(filled).groupBy("file").agg(F.min(F.struct("start", "n", "value")).alias("top")).collect() if begins else []
    if not tops:
        raise ValueError(f"no lines left in {path!r} after skipping {skip}")
    target = f"{shared_folder(spark)}/sparkprep-lines-{uuid.uuid4().hex}"
    separator = {k: v for k, v in options.items() if k == "lineSep"}
    if header and len({r["top"]["value"] for r in tops}) > 1:
        raise ValueError(f"files with different headers: {', '.join(sorted(r['file'] for r in tops))}")
    if header:
        first = tops[0]["top"]["value"]
        for r in tops:
            for at in [x for x in begins if x[0] == r["file"] and x[1] <= r["top"]["start"]]:
                begins[at] = r["top"]["n"] + 1 if at[1] == r["top"]["start"] else 2**63 - 1
    else:
        record = spark.sparkContext.parallelize([min(tops)["top"]["value"]], 1)
        first = options.get("sep", ",").join(reader.option("header", "false").csv(record).columns)

    def piece(batches):
        new = True
        for b in batches:
            if b.num_rows:
                yield from [pa.RecordBatch.from_pydict({"value": [first]})] * new
                yield b
                new = False

    _behind(lines, begins).select("value").mapInArrow(piece, "value string").write.options(**separator).text(target)
    _written.append(target)
    return target


def _inferred(df: DataFrame) -> DataFrame:
    """Text columns in the first type that fits all their values.

    Casts that fail are dear, so a type is ruled out by one value it does not fit: the least, the greatest, or one that an
    earlier type did not fit. Each pass over the table tries one type per column, the first that is left.
    """
    kinds = ("int", "bigint", "double", "boolean", "date", "timestamp_ntz")
    columns = [c(n) for n in df.columns]

    def fits(i: int, *values: str) -> list[Column]:
        return [reduce(lambda a, b: a & b, [F.col(x).isNull() | F.col(x).try_cast(k).isNotNull() for x in values]).alias(f"_{k}{i}") for k in kinds]

    ends = [x for i, n in enumerate(columns) for x in (F.count(n).alias(f"_n{i}"), F.min(n).alias(f"_l{i}"), F.max(n).alias(f"_h{i}"))]
    flags = [x for i in range(len(columns)) for x in (F.col(f"_n{i}"), *fits(i, f"_l{i}", f"_h{i}"))]
    seen = df.agg(*ends).select(*flags).first()
    left = [[k for k in kinds if seen[f"_{k}{i}"]] if seen[f"_n{i}"] else [] for i in range(len(columns))]
    unsure = [i for i, some in enumerate(left) if some]
    while unsure:
        bad = [F.max(F.when(columns[i].try_cast(left[i][0]).isNull(), columns[i])).alias(f"_b{i}") for i in unsure]
        seen = df.agg(*bad).select(*[x for i in unsure for x in (F.col(f"_b{i}").isNull().alias(f"_all{i}"), *fits(i, f"_b{i}"))]).first()
        unsure = [i for i in unsure if not seen[f"_all{i}"]]
        for i in unsure:
            left[i] = [k for k in left[i] if seen[f"_{k}{i}"]]
        unsure = [i for i in unsure if left[i]]
    return df.select(*[n.cast(some[0] if some else "string").alias(name) for n, some, name in zip(columns, left, df.columns)])


def _with_schema(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return df.select(*[c(old).cast(f.dataType).alias(f.name) for old, f in zip(df.columns, fields)])


def _with_decimal(df: DataFrame, mark: str) -> DataFrame:
    """Numbers with another decimal mark: a text column in which every value is such a number becomes double."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    numbers = {n: F.replace(c(n), F.lit(mark), F.lit(".")).try_cast("double") for n in texts}
    if not texts:
        return df
    bad = df.agg(*[F.count_if(c(n).isNotNull() & numbers[n].isNull()).alias(f"_{i}") for i, n in enumerate(texts)]).first()
    whole = {n: numbers[n] for i, n in enumerate(texts) if bad[i] == 0}
    return df.withColumns(whole) if whole else df


def _good_lines(reader: DataFrameReader, read, df: DataFrame, warn: bool, source) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("_corrupt_record", T.StringType())])
    checked = read(reader.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record"))
    # A query that needs few columns reads only those and would not notice bad lines by the others. The hash, true for
    # every row, makes every query read all of them, so that a line is bad or not whatever is asked.
    all_read = F.hash(*[c(n) for n in df.columns]) >= F.lit(-(2**31))
    if warn:
        bad = checked.where(all_read & F.col("_corrupt_record").isNotNull()).count()
        if bad:
            warnings.warn(f"{bad} malformed lines were left out of {source}", stacklevel=3)
    return checked.where(all_read & F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_json(
    spark: SparkSession,
    path: str | list[str],
    orient: str = "records",
    lines: bool | None = None,
    schema: str | T.StructType | None = None,
    limit: int | None = None,
    dtype: bool = True,
) -> DataFrame:
    """JSON files: ``lines=True`` for one record per line (splits over tasks), else by orientation: records (a list or
    one object), columns, index, split, table. A document, in UTF-8, is cut into its records or cells in all splits of its file (``splits``).

    ``lines=None`` looks at all lines of each file of records: where each line that is not blank begins with ``{`` and ends
    with ``}``, they are records by line, else the file is one document. A folder may hold both kinds. ``dtype=False``
    keeps values as text.
    """
    if orient not in ("records", "columns", "index", "split", "table"):
        raise ValueError(f"unknown JSON orient {orient!r}")
    if lines or orient == "records":
        def read(source, by_line: bool) -> DataFrame:
            reader = spark.read.option("primitivesAsString", str(not dtype).lower())
            reader = reader.schema(schema) if schema is not None else reader
            return reader.json(source) if by_line else parsed(reader, json_elements(spark, source, 1, True, {}).select("text"), "json")

        if lines is not None:
            return _limited(_checked(lambda: read(path, lines), path), limit)
        line = F.trim(F.regexp_replace("value", "^\ufeff", ""))
        by_line = line.startswith("{") & line.endswith("}")
        text = _checked(lambda: spark.read.text(path), path).select("value", F.col("_metadata.file_path").alias("file"))
        kinds = text.where(line != "").groupBy("file").agg(F.min(by_line).alias("by_line")).collect()  # one row per file
        parts = [read([r["file"] for r in kinds if r["by_line"] == kind], kind) for kind in (True, False) if any(r["by_line"] == kind for r in kinds)]
        if not parts:
            return _limited(_checked(lambda: read(path, True), path), limit)
        return _limited(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), limit)
    level = 1 if orient == "index" else 2
    elements = _checked(lambda: json_elements(spark, path, level, False, {}), path)
    return _limited(_oriented(elements, orient, schema), limit)


_ENTRY = r'(?s)^\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")\s*:(.*)$'  # a key and its value


def _oriented(elements: DataFrame, orient: str, schema) -> DataFrame:
    """Rows of a whole-document layout from its elements: each becomes a JSON object, then columns by the common type of all."""
    def plain(written: Column) -> Column:
        """A JSON value as text: strings without quotes, null as null."""
        return F.try_element_at(F.from_json(F.concat(F.lit("["), written, F.lit("]")), "array<string>"), F.lit(1))

    # The keys at depth 1 are few: each is read once, here.
    names = {} if orient == "index" else {r["mark"]: _plain_key(r["mark"]) for r in elements.select("mark").distinct().collect()}

    def under(name: str) -> DataFrame:
        return elements.where(F.col("mark").isin([m for m, n in names.items() if n == name]))

    if orient == "table":
        rows = under("data").select(F.parse_json("text").alias("row"))
    elif orient == "index":
        rows = elements.select(F.parse_json(F.regexp_extract("text", _ENTRY, 2)).alias("row"))
    elif orient == "columns":
        if None in names.values() or not names:
            raise ValueError("the JSON document holds no columns of cells by row")
        entry = F.map_entries(F.from_json(F.concat(F.lit("{"), F.col("text"), F.lit("}")), "map<string,string>"))
        at = F.coalesce(F.col("e.key"), plain(F.regexp_extract("text", _ENTRY, 1)))
        cells = elements.select("of", "mark", "text", F.get(entry, F.lit(0)).alias("e")).select("of", "mark", at.alias("at"), F.col("e.value").alias("value"))
        wanted = sorted(set(names.values()))
        # A column names a row once, so all its values but one are null.
        of = [F.col("mark").isin([m for m, n in names.items() if n == name]) for name in wanted]
        values = [F.max(F.when(mine, F.col("value"))).alias(f"v{i}") for i, mine in enumerate(of)]
        pivoted = cells.groupBy("of", "at").agg(*values, *[F.count_if(mine).alias(f"n{i}") for i, mine in enumerate(of)])
        twice = F.greatest(F.lit(0), *[F.col(f"n{i}") for i in range(len(wanted))]) > 1
        refused = F.raise_error(F.concat(F.lit("a JSON document names a row twice in one column: "), "at")).cast("string")
        return _typed_texts(pivoted.select(*[F.when(twice, refused).otherwise(F.col(f"v{i}")).alias(n) for i, n in enumerate(wanted)]), schema)
    else:
        # split: the names stand once in each file and come before or behind its rows.
        heads = under("columns").groupBy("of").agg(F.sort_array(F.collect_list(F.struct("start", "n", plain(F.col("text")).alias("name")))).alias("c"))
        heads = heads.select("of", F.col("c.name").alias("columns"))
        lists = [r[0] for r in heads.select("columns").distinct().collect()]
        data = under("data").select("of", F.from_json("text", "array<string>").alias("values"))
        if len(lists) == 1:
            data = data.withColumn("columns", F.array(*[F.lit(n) for n in lists[0]]))
        else:
            data = data.join(heads, "of")
        made = data.select(F.map_from_arrays("columns", "values").alias("m"))
        return _typed_texts(made.select(*[F.try_element_at("m", F.lit(n)).alias(n) for n in dict.fromkeys(n for names in lists for n in names)]), schema)
    found = rows.agg(F.schema_of_variant_agg("row")).first()[0]
    from sparkprep.operators.json_ops import _ddl

    kind = schema or _ddl(found)
    if kind is None:
        raise ValueError(f"the JSON document holds no rows of orient {orient}")
    return rows.select(F.variant_get("row", "$", kind).alias("r")).select("r.*")


def _plain_key(written: str | None) -> str | None:
    return None if written is None else json.loads(written, strict=False)


def _typed_texts(flat: DataFrame, schema: str | T.StructType | None) -> DataFrame:
    """Cells that arrived as text; they are written once, as their types are found before they are read."""
    if schema is not None:
        return _with_schema(flat, schema)
    return _inferred(cut(flat.toDF(*[f"c{i}" for i in range(len(flat.columns))]), "cells").toDF(*flat.columns))


def read_parquet(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """Parquet files, one or many."""
    return _limited(_checked(lambda: spark.read.parquet(*as_list(path)), path), limit)


_STEP = re.compile(r"""/([^/\[\]@()|]+|\*)((?:\[(?:[^\[\]"']|"[^"]*"|'[^']*')*\])*)""")
_PREDICATE = re.compile(r"""\[\s*(?:(\d+)|(last\(\))|(@?[\w.:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|(-?[\d.]+)))\s*\]""")


def _steps(xpath: str) -> list[tuple[str, list[tuple]]]:
    """The steps of a path: (element, predicates), a predicate being ("at", n) (-1: the last) or (field, value)."""
    refused = ValueError(f"xpath {xpath!r} selects more than elements by name, position, attribute or child can: give row_tag and filter the rows")
    at, out = 0, []
    while at < len(xpath):
        step = _STEP.match(xpath, at)
        if not step or "::" in step[1] or step[1] in (".", ".."):
            raise refused
        predicates, rest = [], step[2]
        while rest:
            found = _PREDICATE.match(rest)
            if not found or found[1] == "0":
                raise refused
            number, last, field, *values = found.groups()
            value = next((v for v in values if v is not None), None)
            predicates.append(("at", int(number) if number else -1) if number or last else (field.replace("@", "_", 1), value))
            rest = rest[found.end():]
        out.append((step[1].strip(), predicates))
        at = step.end()
    return out


def read_xml(
    spark: SparkSession, path: str | list[str], row_tag: str | None = None, xpath: str | None = None, schema=None, limit=None
) -> DataFrame:
    """XML files: one row per element ``row_tag``, or per element at ``xpath``.

    A path may be ``name`` or ``//name`` (at any depth, read in parallel like ``row_tag``) or go from the root, ``/data/p/r`` or
    ``./p/r``, with ``*`` and the predicates ``[2]``, ``[last()]``, ``[@id='x']`` and ``[child='x']`` at its steps. A path from the root
    of two names or more, with tests of fields at most at its end, is read in all splits of a file (in UTF-8); with ``*``, positions
    or tests before its end it reads each file as one row and descends in it; attributes have names with ``_`` in front, bare text is ``_VALUE``.
    """
    reader = spark.read
    if xpath and not row_tag:
        from_root = re.match(r"\.?/(?!/)", xpath)
        steps = _steps(xpath[1:] if xpath.startswith(".") else xpath if xpath.startswith("/") and from_root else "/" + xpath.lstrip("/"))
        if from_root:
            if xpath.startswith("."):
                steps = [(_root_tag(spark, path), []), *steps]
            if len(steps) > 1 and all(n != "*" for n, _ in steps) and not any(p for _, p in steps[:-1]) and all(f != "at" for f, _ in steps[-1][1]):
                return _limited(_elements_at(spark, path, steps, schema, xpath), limit)
            return _limited(_checked(lambda: _descended(reader, path, steps, schema, xpath), path), limit)
        if len(steps) > 1 or any(field == "at" for field, _ in steps[0][1]):
            raise ValueError(f"xpath {xpath!r}: steps and positions need a path from the root; or give row_tag and filter the rows")
        row_tag = steps[0][0]
    else:
        steps = [(row_tag, [])]
    if not row_tag or row_tag == "*":
        raise ValueError("read_xml needs row_tag, or an xpath that ends in an element name")
    reader = reader.option("rowTag", row_tag)
    reader = reader.schema(schema) if schema is not None else reader
    df = _checked(lambda: reader.xml(path), path)
    for field, value in steps[0][1]:
        df = df.where(c(field).cast("string") == value) if field in df.columns else df.where("false")
    return _limited(df, limit)


def _root_tag(spark: SparkSession, path) -> str:
    """The name of the root element, of any one of the files."""
    tag = F.regexp_extract("value", r"<([A-Za-z_][^\s/>]*)", 1)
    found = _checked(lambda: spark.read.text(path), path).select(tag.alias("tag")).where("tag <> ''").first()
    if not found:
        raise ValueError(f"no element found in {path!r}")
    return found["tag"]


def _elements_at(spark: SparkSession, path, steps: list, schema, xpath: str) -> DataFrame:
    """Rows of the elements at the end of ``steps``, cut out of all splits of the files; only the last step has tests."""
    texts = _checked(lambda: xml_elements(spark, path, [n for n, _ in steps]), path).select("text")
    reader = spark.read.option("rowTag", steps[-1][0])
    if schema is not None:
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        reader = reader.schema(_with_fields(kind, steps, steps[-1][0]))
    elif texts.isEmpty():
        raise ValueError(f"no element at {xpath!r} in {path!r}")
    df = parsed(reader, texts, "xml")
    return _kept(df.select(F.struct(*[c(n) for n in df.columns]).alias("e")), steps[-1][1]).select("e.*")


def _descended(reader: DataFrameReader, path, steps: list, schema, xpath: str) -> DataFrame:
    """Rows of the elements at the end of ``steps``, the first of which is the root."""
    if schema is not None:
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        for (name, _), (_, above) in zip(steps[:0:-1], steps[-2::-1]):
            inner = T.StructField(name, T.ArrayType(_with_fields(kind, steps, name)))
            kind = T.StructType([inner, *[T.StructField(f, T.StringType()) for f, _ in above if f != "at"]])
        reader = reader.schema(kind)
    root, predicates = steps[0]
    if root == "*":
        raise ValueError(f"xpath {xpath!r}: the root needs its name (or a path that begins with ./)")
    df = reader.option("rowTag", root).xml(path)
    df = df.select(F.struct(*[c(n) for n in df.columns]).alias("e"))
    frames = [_kept(df, predicates)]
    for name, predicates in steps[1:]:
        frames = [below for frame in frames for below in _children(frame, name, predicates)]
    if not frames:
        raise ValueError(f"no element at {xpath!r} in {path!r}")
    rows = [f.select("e.*") if isinstance(f.schema["e"].dataType, T.StructType) else f.select(F.col("e").alias("_VALUE")) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def _with_fields(kind: T.StructType, steps: list, name: str) -> T.StructType:
    """``kind`` with the fields that the predicates of the last step look at."""
    wanted = [f for f, _ in steps[-1][1] if f != "at" and f not in kind.names] if steps[-1][0] == name else []
    return T.StructType([*kind.fields, *[T.StructField(f, T.StringType()) for f in wanted]])


def _test(element: Column, *, kind: T.DataType, field: str, value: str) -> Column:
    if not isinstance(kind, T.StructType) or field not in kind.names:
        return F.lit(False)
    inner = kind[field].dataType
    found = element.getField(field)
    if isinstance(inner, T.ArrayType):
        return F.coalesce(F.array_contains(F.transform(found, lambda x: x.cast("string")), value), F.lit(False))
    if isinstance(inner, T.StructType):
        found = found.getField("_VALUE") if "_VALUE" in inner.names else F.lit(None)
    return F.coalesce(found.cast("string") == value, F.lit(False))


def _tester(kind: T.DataType, field: str, value: str):
    return lambda element: _test(element, kind=kind, field=field, value=value)


def _kept(df: DataFrame, predicates: list) -> DataFrame:
    for field, value in predicates:
        if field != "at":
            df = df.where(_test(F.col("e"), kind=df.schema["e"].dataType, field=field, value=value))
        elif value not in (1, -1):  # a document has one root
            df = df.where("false")
    return df


def _children(df: DataFrame, name: str, predicates: list) -> list[DataFrame]:
    """The child elements with that name (``*``: each kind of child in a table of its own), predicates applied in order."""
    kind = df.schema["e"].dataType
    if not isinstance(kind, T.StructType):
        return []
    names = [n for n in kind.names if not n.startswith("_")] if name == "*" else [name] if name in kind.names else []
    if name == "*" and any(f == "at" for f, _ in predicates) and len(names) > 1:
        raise ValueError("a position among children of several kinds is lost when XML is read: name the element")
    out = []
    for n in names:
        inner, found = kind[n].dataType, F.col("e").getField(n)
        if not isinstance(inner, T.ArrayType):
            found, inner = F.filter(F.array(found), lambda x: x.isNotNull()), T.ArrayType(inner)
        for field, value in predicates:
            if field == "at":
                found = F.slice(found, value, 1)
            else:
                found = F.filter(found, _tester(inner.elementType, field, value))
        out.append(df.select(F.explode(found).alias("e")))
    return out


_READERS = {"csv": read_csv, "tsv": read_csv, "txt": read_csv, "json": read_json, "parquet": read_parquet, "xml": read_xml}


def read_file(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read by format, or by the ending of the path. ``limit=n`` reads a sample."""
    kind = fmt or path.removesuffix(".gz").removesuffix(".bz2").removesuffix(".zst").rsplit(".", 1)[-1].lower()
    if kind in ("jsonl", "ndjson"):
        kind, options = "json", {"lines": True} | options
    if kind not in _READERS:
        raise ValueError(f"no reader for {kind!r}; known are {sorted(_READERS)}")
    if kind == "tsv":
        options = {"separator": "\t"} | options
    return _READERS[kind](spark, path, **options)


def inline(
    spark: SparkSession, text: str, fmt: str = "raw", separator: str = ",", type_mode: str = "infer"
) -> DataFrame:
    """A table written out in the pipeline: csv (with header), json (list, object or scalar) or raw text in ``value``.

    ``type_mode``: infer, all_string or none.
    """
    if type_mode not in ("infer", "all_string", "none"):
        raise ValueError("type_mode must be 'infer', 'all_string' or 'none'")
    text = text.strip()
    if not text:
        raise ValueError("no inline data given")
    if fmt == "raw":
        df = spark.createDataFrame([(text,)], "value string")
    elif fmt == "csv":
        lines = spark.sparkContext.parallelize(text.splitlines(), 1)
        df = spark.read.option("header", "true").option("sep", separator).option("inferSchema", "true").csv(lines)
    elif fmt == "json":
        value = json.loads(text)
        records = value if isinstance(value, list) else [value]
        records = [r if isinstance(r, dict) else {"value": r} for r in records]
        names = list(dict.fromkeys(n for r in records for n in r))
        lines = spark.sparkContext.parallelize([json.dumps(r) for r in records], 1)
        # Spark sorts inferred fields by name; the written order is kept.
        df = spark.read.json(lines).select(*[c(n) for n in names])
    else:
        raise ValueError("inline format must be 'csv', 'json' or 'raw'")
    return df.select(*[c(n).cast("string").alias(n) for n in df.columns]) if type_mode == "all_string" else df
