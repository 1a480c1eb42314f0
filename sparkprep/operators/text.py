"""Text: extraction by pattern, cleansing, Markdown styles, prompt texts."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep._columns import as_list, c, numeric_columns, order_columns, require
from sparkprep.functions.patterns import PATTERNS
from sparkprep.operators.ordering import carry_forward, exact_quantiles

_FLAGS = {"IGNORECASE": "i", "MULTILINE": "m", "DOTALL": "s", "VERBOSE": "x", "UNICODE": "U", "ASCII": ""}


def extract(
    df: DataFrame, column: str, pattern: str, name: str = "extract", flags: str | Iterable[str] = (), groups: int | None = None
) -> DataFrame:
    """The groups of the first match as ``<name>_1``, ``<name>_2``...; null where nothing matches or the group took no part.

    ``pattern`` is a name from functions.patterns.PATTERNS or a regular expression with at least one group. Characters
    are classed by Unicode unless the flag ASCII is given. Flags: IGNORECASE, MULTILINE, DOTALL, UNICODE, ASCII, VERBOSE.
    """
    require(df, [column])
    regex = PATTERNS.get(pattern, pattern)
    given = [f.strip().upper() for f in (flags.split(",") if isinstance(flags, str) else flags) if f.strip()]
    wrong = [f for f in given if f not in _FLAGS]
    if wrong:
        raise ValueError(f"unknown flags {wrong}; known are {sorted(_FLAGS)}")
    letters = {_FLAGS[f] for f in given} | ({"U"} if "ASCII" not in given else set())
    letters = "".join(sorted(letters))
    n = groups if groups is not None else re.compile(regex).groups
    if n < 1:
        raise ValueError("the pattern needs at least one capturing group")
    text = c(column).cast("string")
    flagged = f"(?{letters})" if letters else ""
    full = flagged + regex
    # regexp_extract gives '' for no match, for a group that took no part and for one that matched nothing. Behind the first
    # match, held fast, a reference to the group succeeds only if it took part.
    matched = text.rlike(full)
    found = {}
    for i in range(1, n + 1):
        value = F.regexp_extract(text, full, i)
        empty = F.when(text.rlike(f"{flagged}\\A(?>(?s:.*?)(?:{regex}\n))\\{i}" if "x" in letters else f"{flagged}\\A(?>(?s:.*?)(?:{regex}))\\{i}"), F.lit(""))
        found[f"{name}_{i}"] = F.when(matched, F.when(value != "", value).otherwise(empty))
    taken = set(df.columns)
    return df.withColumns({(k + "_extracted" if k in taken else k): v for k, v in found.items()})


# What each kind of unwanted characters stands for.
UNWANTED = {
    "whitespace": [r"^\s+|\s+$"],
    "tabs": [r"\t"],
    "line breaks": [r"\n", r"\r"],
    "allwhitespace": [r"\s+"],
    "letters": [r"[A-Za-z]+"],
    "numbers": [r"\d+"],
    "punctuation": [r"[^\w\s]+"],
}


def _title(text: Column) -> Column:
    words = F.split(text, r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(words, _capitalized), "")


def _capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


CASES = {
    "lower": F.lower,
    "upper": F.upper,
    "capitalize": _capitalized,
    "swapcase": lambda t: F.array_join(
        F.transform(F.split(t, ""), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), ""
    ),
    "camelcase": lambda t: F.replace(_title(t), F.lit(" "), F.lit("")),
    "snakecase": lambda t: F.lower(F.replace(t, F.lit(" "), F.lit("_"))),
}


def cleanse(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    fill: str | None = None,
    value=None,
    remove: Iterable[str] | None = None,
    case: str | None = None,
    drop_null_rows: str | None = None,
    drop_null_columns: str | None = None,
    order_by=None,
    by: Iterable[str] | None = None,
) -> DataFrame:
    """Clean the chosen columns (default: all), in this order: fill nulls, remove characters, case, drop null rows, drop
    null columns.

    ``fill``: blanks (text columns), 0, custom (with ``value``), median (numeric columns), ffill, bfill (in the order of
    ``order_by``, within ``by`` if given). ``remove``: kinds from UNWANTED. ``case``: lower, upper, capitalize, swapcase,
    camelcase, snakecase. ``drop_null_rows`` / ``drop_null_columns``: any or all. Null text stays null.
    """
    named = require(df, columns)
    if fill:
        df = _filled(df, named, fill, value, order_by, require(df, by))
    unwanted = [k.lower() for k in as_list(remove)]
    wrong = [k for k in unwanted if k not in UNWANTED]
    if wrong or (case and case not in CASES):
        raise ValueError(f"unknown cleansing option {wrong or case!r}")
    if unwanted or case:
        texts = named or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        changed = {}
        for n in texts:
            text = c(n).cast("string")
            for kind in unwanted:
                for regex in UNWANTED[kind]:
                    text = F.regexp_replace(text, f"(?U){regex}", "")
            changed[n] = CASES[case](text) if case else text
        if changed:
            df = df.withColumns(changed)
    for how in (drop_null_rows, drop_null_columns):
        if how not in (None, "any", "all"):
            raise ValueError("drop_null_rows and drop_null_columns take 'any' or 'all'")
    if drop_null_rows:
        df = df.dropna(drop_null_rows, subset=named or None)
    if drop_null_columns:
        checked = named or df.columns
        present = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c(n)).alias(f"_{i}") for i, n in enumerate(checked)])
        counts = present.first()
        limit = counts["_all"] if drop_null_columns == "any" else min(counts["_all"], 1)
        df = df.drop(*[n for i, n in enumerate(checked) if counts[f"_{i}"] < limit])
    return df


def _filled(df: DataFrame, named: list[str], fill: str, value, order_by, by: list[str]) -> DataFrame:
    names = named or [n for n in df.columns if n not in by]
    if fill in ("ffill", "bfill"):
        return carry_forward(df, names, order_columns(df, order_by, flip=fill == "bfill"), by)
    types = {f.name: f.dataType for f in df.schema.fields}
    if fill == "median":
        numeric = [n for n in numeric_columns(df) if n in names]
        if not numeric:
            return df
        found = {r["field"]: r["quantiles"][0] for r in exact_quantiles(df, [], numeric, [0.5]).collect()}
        return df.withColumns({n: F.coalesce(c(n).cast("double"), F.lit(found.get(n))) for n in numeric})
    constants = {"blanks": "", "0": 0, "custom": value}
    if fill not in constants:
        raise ValueError(f"unknown fill {fill!r}")
    constant = constants[fill]
    if constant is None:
        raise ValueError("fill='custom' needs a value")
    changed = {}
    for n in names:
        as_cell = F.lit(str(constant) if isinstance(types[n], T.StringType) else constant)
        if not isinstance(types[n], T.StringType):
            if isinstance(constant, str) and (n not in named or constant == ""):
                continue  # a text does not fit here
            as_cell = as_cell.cast(types[n])
        changed[n] = F.coalesce(c(n), as_cell)
    return df.withColumns(changed) if changed else df


# The marks of each Markdown style, left and right.
STYLES = {
    "Heading level 1": ("# ", ""),
    "Heading level 2": ("## ", ""),
    "Heading level 3": ("### ", ""),
    "Heading level 4": ("#### ", ""),
    "Heading level 5": ("##### ", ""),
    "Heading level 6": ("###### ", ""),
    "Blockquote": ("\r\n>", "\r\n"),
    "Bold": ("**", "**"),
    "Italic": ("_", "_"),
    "Strikethrough": ("~~", "~~"),
    "Inline Code": ("`", "`"),
}


def markdown_style(
    df: DataFrame, columns: Iterable[str], styles: Iterable[str], new_column: bool = False, prefix: str = "", suffix: str = ""
) -> DataFrame:
    """Wrap texts in Markdown marks, the first style outermost; in place or as ``<prefix><column><suffix>``. Null is ''."""
    names, styles = require(df, columns), as_list(styles)
    wrong = [s for s in styles if s not in STYLES]
    if wrong:
        raise ValueError(f"unknown Markdown styles {wrong}")
    left = "".join(STYLES[s][0] for s in styles)
    right = "".join(STYLES[s][1] for s in reversed(styles))
    styled = {
        (f"{prefix}{n}{suffix}" if new_column else n): F.concat(
            F.lit(left), F.coalesce(c(n).cast("string"), F.lit("")), F.lit(right)
        )
        for n in names
    }
    return df.withColumns(styled)


def validate_markdown(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``is_<column>_valid_markdown``: true for every text, as Markdown accepts any; false for null."""
    return df.withColumns({f"is_{n}_valid_markdown": c(n).isNotNull() for n in require(df, columns)})


def prompt_column(df: DataFrame, prompt: str, columns: Iterable[str], name: str = "prompt") -> DataFrame:
    """``<prompt>: col: value, col: value`` per row; a null value shows as ''."""
    parts = [F.concat(F.lit(f"{n}: "), F.coalesce(c(n).cast("string"), F.lit(""))) for n in require(df, columns)]
    return df.withColumn(name, F.concat(F.lit(f"{prompt}: "), F.concat_ws(", ", *parts)))
