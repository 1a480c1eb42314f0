"""Cut big files into records where a record may hold the line breaks, commas or brackets that part records elsewhere.

Spark reads a file in splits, each from one byte on, and a split cannot know alone whether it begins inside of a quoted cell
or how deep in a document. So it says what it does to either case (a small summary per split); the summaries of a file are
folded in order, which gives each split the state it begins in; then all splits are cut in parallel. A record that lies over
several splits leaves pieces at their borders, which are joined by the split where the record began.

The state of a split is a short text and goes to all tasks; there are as many as splits, and more than ``MOST_SPLITS`` are
refused (raise ``spark.sql.files.maxPartitionBytes``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.session import cut

MOST_SPLITS = 1_000_000
WHOLE, HEAD, TAIL = 0, 1, 2  # a record; the rest of one that began in an earlier split; the beginning of one


def chunks(spark: SparkSession, path, separator: str, options: dict) -> DataFrame:
    """(of, start, value): the pieces of each split between separators, in order; ``of`` is a hash of the file's path."""
    kept = {k: v for k, v in options.items() if k in ("encoding", "recursiveFileLookup", "pathGlobFilter", "modifiedBefore", "modifiedAfter")}
    lines = spark.read.options(**kept).option("lineSep", separator).text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("of"), F.col("_metadata.file_block_start").alias("start"), "value")


def runs(batches, arrow: bool = False) -> Iterator[tuple[tuple[int, int], list[str] | pa.Array]]:
    """Runs of rows of one split: ((of, start), values), a list or an Arrow array. A split may come in several runs, one behind the other."""
    for b in batches:
        of, start = np.asarray(b.column(0)), np.asarray(b.column(1))
        edges = np.flatnonzero((of[1:] != of[:-1]) | (start[1:] != start[:-1])) + 1
        for low, high in zip([0, *edges], [*edges, len(of)]):
            if high > low:
                values = b.column(2).slice(low, high - low)
                yield (int(of[low]), int(start[low])), values if arrow else values.to_pylist()


def begin_states(parts: DataFrame, summary: Callable, after: Callable, first: str, arrow: bool = False) -> dict[tuple[int, int], str]:
    """The state in which each split begins.

    ``summary(key)`` gives an object with ``feed(values)`` and ``said()`` (text); ``after(state, said)`` the state behind a
    split. States are texts; each file begins in ``first``. With ``arrow``, values come as Arrow arrays.
    """

    def look(batches):
        now, walker = None, None
        for key, values in runs(batches, arrow):
            if key != now:
                if walker:
                    yield pa.RecordBatch.from_pydict({"of": [now[0]], "start": [now[1]], "said": [walker.said()]})
                now, walker = key, summary(key)
            walker.feed(values)
        if walker:
            yield pa.RecordBatch.from_pydict({"of": [now[0]], "start": [now[1]], "said": [walker.said()]})

    def fold(table):
        state, out = first, []
        table = table.sort_values("start")
        for said in table["said"]:
            out.append(state)
            state = after(state, said)
        return table.assign(state=out)[["of", "start", "state"]]

    said = parts.mapInArrow(look, "of long, start long, said string")
    states = cut(said.groupBy("of").applyInPandas(fold, "of long, start long, state string"), "splits")  # one row per split
    count, splits = states.agg(F.count("*"), F.count_distinct("of", "start")).first()
    if count != splits:
        raise ValueError("a file is named more than once")
    if count > MOST_SPLITS:
        raise ValueError(f"{count} splits are too many to keep their states: raise spark.sql.files.maxPartitionBytes")
    return {(r["of"], r["start"]): r["state"] for r in states.collect()}


def cut_records(parts: DataFrame, states: dict, cutter: Callable, joint: str, arrow: bool = False) -> DataFrame:
    """(of, start, n, mark, text): the records. ``cutter(key, state)`` gives an object with ``feed(values)`` and ``end()``, both
    lists of (kind, mark, text); pieces of one record are joined with ``joint``. ``n`` counts the pieces of a split. With
    ``arrow``, values are Arrow arrays and both give three of these (kinds, marks, texts) or nothing."""
    shared = parts.sparkSession.sparkContext.broadcast(states)  # one short text per split

    def pieces(batches):
        now, walker, n = None, None, 0

        def rows(found):
            nonlocal n
            columns = found if arrow else [pa.array(x, kind) for x, kind in zip(zip(*found), (pa.int32(), pa.string(), pa.string()))]
            size = len(columns[0])
            n += size
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, now[0])), pa.array(np.full(size, now[1])), pa.array(np.arange(n - size, n)), *columns],
                ["of", "start", "n", "kind", "mark", "text"])

        for key, values in runs(batches, arrow):
            if key != now:
                if walker and (found := walker.end()):
                    yield rows(found)
                now, walker, n = key, cutter(key, shared.value[key]), 0
            if found := walker.feed(values):
                yield rows(found)
        if walker and (found := walker.end()):
            yield rows(found)

    made = cut(parts.mapInArrow(pieces, "of long, start long, n long, kind int, mark string, text string"), "records")
    border = made.where(F.col("kind") != WHOLE)
    earlier = Window.partitionBy("of").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, 0)
    began = F.last(F.when(F.col("kind") == TAIL, F.struct("start", "n", "mark")), ignorenulls=True).over(earlier)
    joined = border.select("*", began.alias("at")).groupBy("of", "at").agg(F.sort_array(F.collect_list(F.struct("start", "n", "text"))).alias("p"))
    joined = joined.select("of", "at.start", "at.n", "at.mark", F.array_join(F.col("p.text"), joint).alias("text"))
    return made.where(F.col("kind") == WHOLE).drop("kind").unionByName(joined)


# CSV: a state is whether a split begins inside of quotes.

class _Quotes:
    """Follows lines through quoted cells: a cell is quoted if a quote begins it, and ends at a quote that is not doubled (or escaped)."""

    def __init__(self, separator: str, quote: str, escape: str):
        self.separator, self.quote = separator, quote
        q, e = re.escape(quote), re.escape(escape)
        inner = f"[^{q}]*(?:{q}{q}[^{q}]*)*{q}(?!{q})" if escape == quote else f"[^{q}{e}]*(?:{e}.[^{q}{e}]*)*{q}"
        self.inner = re.compile(inner, re.DOTALL)

    def after(self, inside: bool, line: str) -> bool:
        if not inside and self.quote not in line:
            return False
        at = 0
        while True:
            if inside:
                closed = self.inner.match(line, at)
                if not closed:
                    return True
                at = line.find(self.separator, closed.end())
                if at < 0:
                    return False
                at += len(self.separator)
                inside = False
            if line.startswith(self.quote, at):
                at += len(self.quote)
                inside = True
                continue
            at = line.find(self.separator + self.quote, at)
            if at < 0:
                return False
            at += len(self.separator)


def csv_records(spark: SparkSession, path, separator: str, quote: str, escape: str, skip: int, comment: str | None, options: dict) -> DataFrame:
    """(of, start, n, mark, text): the records of CSV files, line breaks inside of quotes included, in parallel.

    ``mark`` is ``first`` for the first record of a file that is not blank or a comment. ``skip`` lines at the beginning of each
    file are left out; they must lie in its first split.
    """
    quotes = _Quotes(separator, quote, escape)

    def lines_of(key, seen, values):
        if key[1] == 0 and seen == 0 and values:
            values = [values[0].removeprefix("\ufeff"), *values[1:]]
        return values[max(0, skip - seen):] if key[1] == 0 else values

    class Summary:
        def __init__(self, key):
            self.key, self.seen, self.ends = key, 0, [False, True]

        def feed(self, values):
            lines = lines_of(self.key, self.seen, values)
            self.seen += len(values)
            for i in (0, 1):
                state = self.ends[i]
                for line in lines:
                    if state or quote in line:
                        state = quotes.after(state, line)
                self.ends[i] = state

        def said(self):
            return "".join("1" if x else "0" for x in self.ends) + "!" * (self.key[1] == 0 and self.seen < skip)

    class Cutter:
        def __init__(self, key, state):
            self.key, self.seen, self.inside = key, 0, state == "1"
            self.open, self.begun, self.fresh = [], not self.inside, key[1] == 0

        def mark(self, text):
            if self.fresh and text.strip() and not (comment and text.startswith(comment)):
                self.fresh = False
                return "first"
            return None

        def feed(self, values):
            out = []
            for line in lines_of(self.key, self.seen, values):
                if not self.inside and quote not in line:
                    text = line.removesuffix("\r")
                    out.append((WHOLE, self.mark(text) if self.fresh else None, text))
                    continue
                self.open.append(line)
                self.inside = quotes.after(self.inside, line)
                if not self.inside:
                    text = "\n".join(self.open).removesuffix("\r")
                    out.append((WHOLE if self.begun else HEAD, self.mark(text) if self.begun and self.fresh else None, text))
                    self.open, self.begun = [], True
            self.seen += len(values)
            return out

        def end(self):
            if not self.open:
                return []
            text = "\n".join(self.open)
            return [(TAIL if self.begun else HEAD, self.mark(text) if self.begun and self.fresh else None, text)]

    parts = chunks(spark, path, "\n", options)
    states = begin_states(parts, Summary, lambda state, said: "!" if "!" in state + said else said[int(state)], "0")
    if "!" in states.values():
        raise ValueError(f"{skip} lines to skip reach beyond the first split of a file: raise spark.sql.files.maxPartitionBytes")
    return cut_records(parts, states, Cutter, "\n")


# JSON: a state is whether a split begins inside of a string, how deep, what bracket began the document, and the last key at depth 1.

_OPEN, _SHUT, _COMMA, _QUOTE = 1, -1, 2, 3
_SIGNS = np.zeros(256, np.int8)
for _sign, _bytes in ((_OPEN, b"[{"), (_SHUT, b"]}"), (_COMMA, b","), (_QUOTE, b'"')):
    _SIGNS[list(_bytes)] = _sign


def _bytes_of(values: pa.Array, separator: str) -> np.ndarray:
    """The pieces, each with the separator behind it."""
    values.validate(full=True)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), separator)
    return np.frombuffer(whole[0].as_buffer().to_pybytes() + separator.encode(), np.uint8)


def _signs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the brackets, commas and quotes; escaped quotes are left out."""
    places = np.flatnonzero(_SIGNS[data])
    signs = _SIGNS[data[places]]
    quotes = np.flatnonzero(signs == _QUOTE)
    behind = quotes[data[places[quotes] - 1] == 92]  # behind a backslash (or at 0, behind the separator at the end)
    if len(behind):
        others = np.flatnonzero(data != 92)
        k = np.searchsorted(others, places[behind])
        last = np.where(k > 0, others[k - 1], -1)
        keep = np.ones(len(places), bool)
        keep[behind[(places[behind] - last) % 2 == 0]] = False
        places, signs = places[keep], signs[keep]
    return places, signs


class _Elements:
    """Cuts the elements at depth ``level`` (0: the whole document) out of a split that begins in a known state."""

    def __init__(self, key, state: str, level: int, separator: str):
        known = json.loads(state)
        self.separator, self.inside, self.depth, self.key = separator, known["in"], known["depth"], known["key"]
        self.level = 0 if known["flat"] and known["root"] == "{" else level
        self.first, self.flat = key[1] == 0, known["flat"]
        self.begun, self.parts, self.done = False, [], not self.first and self.depth <= 0
        self.key_part = None  # the beginning of a key whose end is still to come

    def look(self, values: pa.Array):
        """(bytes, places, signs, depths behind them) of the brackets and commas outside of strings, up to the document's end,
        and of level 2 the places and texts of the strings at depth 1, the first being the last one before."""
        data = _bytes_of(values, self.separator)
        if self.first:
            text = data.tobytes().decode().removeprefix("\ufeff").lstrip()
            self.first = not text
            if self.flat and text.startswith("{"):
                self.level, self.begun = 0, True
            data = np.frombuffer(text.encode(), np.uint8)
        places, signs = _signs(data)
        quote = signs == _QUOTE
        within = (np.cumsum(quote) + self.inside) % 2 == 1  # behind the sign
        depth = self.depth + np.cumsum(np.where(within | quote | (signs == _COMMA), 0, signs))
        over = np.flatnonzero((signs == _SHUT) & ~within & (depth == 0))
        if len(over):
            self.done = True
            places, signs, quote, within, depth = (x[: over[0] + 1] for x in (places, signs, quote, within, depth))
        keys_at, keys = [-1], [self.key]
        if self.level == 2:
            ends = np.flatnonzero(quote)
            if self.inside and self.key_part is not None:
                if len(ends):
                    keys_at.append(0)
                    keys.append((self.key_part + data[: places[ends[0]] + 1].tobytes()).decode())
                    self.key_part = None
                else:
                    self.key_part += data.tobytes()
            begins = ends[within[ends] & (depth[ends] == 1)]
            closed = np.searchsorted(ends, begins) + 1
            for i, j in zip(begins, closed):
                if j < len(ends):
                    keys_at.append(int(places[i]))
                    keys.append(data[places[i] : places[ends[j]] + 1].tobytes().decode())
                else:
                    self.key_part = data[places[i] :].tobytes()
            self.key = keys[-1]
        if len(places):
            self.inside, self.depth = int(within[-1]), int(depth[-1])
        plain = ~quote & ~within
        return data, places[plain], signs[plain], depth[plain], keys_at, keys

    def feed(self, values: pa.Array):
        if self.done:
            return None
        was = self.depth
        data, at, sign, depth, keys_at, keys = self.look(values)
        level, last = self.level, 0
        if level == 0:
            if not self.done:
                self.parts.append(data.tobytes())
                return None
            return self._found(np.array([0]), at[-1:] + 1, data, keys_at, keys)
        edge = np.flatnonzero(np.where(sign == _SHUT, depth + 1, depth) == level)
        begins, ends, emit = np.concatenate(([0], at[edge] + 1)), at[edge], sign[edge] != _OPEN
        if len(edge):
            last = int(begins[-1])
            if not emit[0]:
                self.begun, self.parts = True, []
        out = self._found(begins[:-1][emit], ends[emit], data, keys_at, keys) if emit.any() else None
        if not self.done and (self.depth if len(at) else was) >= level:
            self.parts.append(data[last:].tobytes())
        return out

    def _found(self, begins, ends, data, keys_at, keys):
        """Kinds, marks and texts of the stretches; the first one ends what earlier runs began."""
        kinds = np.full(len(ends), WHOLE, np.int32)
        kinds[0] = WHOLE if self.begun else HEAD
        head = b"".join([*self.parts, data[begins[0] : ends[0]].tobytes()])
        self.parts, self.begun = [], True
        edges = np.zeros(len(data) + 1, np.int8)
        edges[begins[1:]] += 1
        edges[ends[1:]] -= 1
        texts = head + data[np.cumsum(edges[:-1], dtype=np.int8).view(bool)].tobytes()
        offsets = np.cumsum(np.concatenate(([0, len(head)], ends[1:] - begins[1:])))
        texts = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(texts)).cast(pa.string())
        if self.level == 2:
            which = pa.array(np.searchsorted(np.array(keys_at), ends) - 1)
            marks = pa.array(keys, pa.string()).take(which)
        else:
            marks = pa.nulls(len(ends), pa.string())
        return pa.array(kinds), marks, texts

    def end(self):
        if self.done or self.depth < self.level:
            return None
        kind, key = TAIL if self.begun else HEAD, self.key if self.level == 2 else None
        return pa.array([kind], pa.int32()), pa.array([key], pa.string()), pa.array([b"".join(self.parts).decode()], pa.string())


def json_elements(spark: SparkSession, path, level: int, flat: bool, options: dict) -> DataFrame:
    """(of, start, n, mark, text): the elements at depth ``level`` of the JSON documents, one document per file.

    Elements at depth 2 have the key they lie under (as written, in quotes) in ``mark``. ``flat``: a document that is an object
    is one element, not a list of its entries. Text behind the document's end is not looked at.
    """
    separator = "," if level == 2 else "}"

    class Summary:
        def __init__(self, key):
            self.first, self.ends, self.root = key[1] == 0, [(False, 0), (True, 0)], None

        def feed(self, values):
            data = _bytes_of(values, separator)
            if self.first and not self.root:
                head = data.tobytes().decode().removeprefix("\ufeff").lstrip()
                self.root = head[:1] or None
            _, signs = _signs(data)
            within = np.cumsum(signs == _QUOTE) % 2
            bracket = np.abs(signs) == 1
            # What lies outside of strings if the data begins there lies inside otherwise, and the other way round.
            more = [int(signs[bracket & (within == i)].sum()) for i in (0, 1)]
            odd = bool(len(within) and within[-1])
            self.ends = [(inside != odd, depth + more[inside]) for inside, depth in self.ends]

        def said(self):
            return json.dumps([self.ends, self.root])

    def after(state, said):
        known, (ends, root) = json.loads(state), json.loads(said)
        inside, more = ends[known["in"]]
        return json.dumps(known | {"in": int(inside), "depth": known["depth"] + more, "root": known["root"] or root})

    parts = chunks(spark, path, separator, options)
    states = begin_states(parts, Summary, after, json.dumps({"in": 0, "depth": 0, "root": None, "key": None, "flat": flat}), True)
    if level == 2:
        class Keys(_Elements):
            def __init__(self, key):
                super().__init__(key, states[key], level, separator)

            def feed(self, values):
                if not self.done:
                    self.look(values)

            def said(self):
                return json.dumps(self.key)

        keys = begin_states(parts, Keys, lambda state, said: said if said != "null" else state, "null", True)
        states = {k: json.dumps(json.loads(s) | {"key": json.loads(keys[k])}) for k, s in states.items()}
    found = cut_records(parts, states, lambda key, state: _Elements(key, state, level, separator), "", True)
    return found.where(F.col("text").rlike(r"\S"))


# XML: a state is the markup a split begins inside of, as a beginning that may be put before the split's text, and the open elements.

_MARKUP = re.compile(
    r"""</[^>]*>|<!--.*?(?:-->|(?P<comment>\Z))|<!\[CDATA\[.*?(?:\]\]>|(?P<cdata>\Z))|<\?.*?(?:\?>|(?P<order>\Z))"""
    r"""|<![A-Z](?:[^\[>]*\[.*?\]\s*>|[^\[>]*>|(?P<doctype>.*\Z))"""
    r"""|<(?P<name>[^\s/>!?"'<=]+)[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*(?:>|(?P<quoted>"[^"]*\Z|'[^']*\Z))""", re.DOTALL)
_BEGUN = {"comment": "<!--", "cdata": "<![CDATA[", "order": "<?", "doctype": "<!D["}
_ENDS = {"<!--": "-->", "<![CDATA[": "]]>", "<?": "?>"}
_ANY = "\x01"  # the name of a start tag that an earlier split began
_STARTS = ["", *_BEGUN.values(), f'<{_ANY} a="', f"<{_ANY} a='"]


def _still(begun: str, text: str) -> bool:
    """Whether markup that began before ``text`` goes on behind it."""
    return begun in _ENDS and _ENDS[begun] not in text


def _goes_on(m: re.Match) -> str:
    """What the markup, if the text ends inside of it, begins with in the next text."""
    return f"<{m['name']} a={m['quoted'][0]}" if m["quoted"] else _BEGUN.get(m.lastgroup, "")


class _XmlElements:
    """Cuts the elements whose names from the root are ``names`` out of a split that begins in a known state."""

    def __init__(self, state: str, names: list[str]):
        known = json.loads(state)
        self.names, self.level, self.begin, self.stack = names, len(names) - 1, known["in"], known["open"]
        tag = [self.begin[1:-4]] if self.begin[-1:] in ("'", '"') else []
        self.open, self.begun, self.parts = [*self.stack, *tag][: len(names)] == names, False, []

    def feed(self, values: list[str]):
        text, out, at, stack = self.begin + ">".join(values) + ">", [], len(self.begin), self.stack
        if _still(self.begin, text[at:]):
            if self.open:
                self.parts.append(text[at:])
            return out
        self.begin = ""
        for m in _MARKUP.finditer(text):
            name = m["name"]
            if name:
                if not self.open and len(stack) == self.level and name == self.names[-1] and stack == self.names[:-1]:
                    self.open, self.begun, self.parts, at = True, True, [], m.start()
                if not m["quoted"] and text[m.end() - 2] != "/":
                    stack.append(name)
                    continue
            elif text[m.start() + 1] == "/":
                if stack:
                    stack.pop()
            elif m.lastgroup not in _BEGUN:
                continue
            if m.lastgroup in _BEGUN or m["quoted"]:
                self.begin = _goes_on(m)
            elif self.open and len(stack) == self.level:
                out.append((WHOLE if self.begun else HEAD, None, "".join([*self.parts, text[at : m.end()]])))
                self.open, self.parts = False, []
        if self.open:
            self.parts.append(text[at:])
        return out

    def end(self):
        return [(TAIL if self.begun else HEAD, None, "".join(self.parts))] if self.open else []


def xml_elements(spark: SparkSession, path, names: list[str]) -> DataFrame:
    """(of, start, n, mark, text): the elements of XML documents, one document per file, whose names from the root are ``names``."""

    class Summary:
        def __init__(self, key):
            self.ends = [(begun, 0, []) for begun in _STARTS]  # inside of what, elements closed, elements opened

        def feed(self, values):
            text, seen = ">".join(values) + ">", {}
            for begun in {e[0] for e in self.ends}:
                closed, opened, inside = 0, [], begun
                if not _still(begun, text):
                    inside = ""
                    for m in _MARKUP.finditer(begun + text):
                        if m.lastgroup in _BEGUN or m["quoted"]:
                            inside = _goes_on(m)
                        elif m["name"]:
                            if m.string[m.end() - 2] != "/":
                                opened.append(m["name"])
                        elif m.string[m.start() + 1] == "/":
                            if opened:
                                opened.pop()
                            else:
                                closed += 1
                seen[begun] = inside, closed, opened
            self.ends = [self._then(*end, *seen[end[0]]) for end in self.ends]

        @staticmethod
        def _then(_, closed, opened, inside, more, names):
            left = max(0, len(opened) - more)
            return inside, closed + max(0, more - len(opened)), opened[:left] + names

        def said(self):
            return json.dumps(self.ends)

    def after(state, said):
        known = json.loads(state)
        begun, tag = known["in"], _ANY
        if begun[-1:] in ("'", '"'):
            tag, begun = begun[1:-4], f"<{_ANY} a={begun[-1]}"
        inside, closed, opened = json.loads(said)[_STARTS.index(begun)]
        still = known["open"][: max(0, len(known["open"]) - closed)]
        return json.dumps({"in": inside.replace(_ANY, tag), "open": still + [tag if n == _ANY else n for n in opened]})

    parts = chunks(spark, path, ">", {})
    states = begin_states(parts, Summary, after, json.dumps({"in": "", "open": []}))
    return cut_records(parts, states, lambda key, state: _XmlElements(state, names), "")


def parsed(reader, texts: DataFrame, kind: str) -> DataFrame:
    """Texts of one column, read by Spark's own CSV or JSON reader."""
    spark = texts.sparkSession
    strings = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(getattr(reader._jreader, kind)(strings), spark)
