"""Personal data: overlapping candidate spans, scored by boosted trees, chosen by a calibrated threshold.

Generators find candidates of six kinds in each text. Four kinds (email, ip, card, phone) are a base that is always
redacted when it passes its own check; two wider ones (bare numbers, long mixed strings) and the failed matches of the
base kinds are redacted only when the trees say so.

The trees see format and context: kind, length, share of digits, the characters on both sides, whether an assignment
stands before, and the check's outcome. The label to learn from is weak: the check for the base kinds, a cue word in the
24 characters before for the wider kinds, which the trees do not see. All features are small codes, so all candidates of
all texts fall into a bounded number of cells (at most ``6 * 5 * 4 * 4 * 4 * 2 * 3 * 2``, whatever the size of the data);
Spark counts labels per cell in one aggregation, and gradient boosting works on the cells' counts. The finished trees are
CASE expressions, evaluated inside each row: no candidate is shuffled and no row is matched by its id.

Patterns are written so that no regular expression repeats a group: such loops overflow the stack on very long matches. Long
texts are looked at in segments that end where no pattern can go on, with the characters before them as context, so that
the time grows with the length of a text and the matches come out as from the whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, the base patterns, the cues. A loose dot or gap stands where a domain or a card ends.
KINDS = ["email", "ip", "card", "phone", "number", "secret"]
_LOOSE_DOT = r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])"
_LOOSE_GAP = r"(?<![0-9])[ -]|[ -](?![0-9])"
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?=\.)[A-Za-z0-9.-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_DIGITS = r"[0-9][0-9 -]*+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_NUMBER = r"(?<![0-9A-Za-z+.-])[0-9(][0-9() .-]{7,}[0-9]"
_SECRET = r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+"
_CUE_SECRET = r"(?i)(token|secret|passw|api.?key|bearer)"
_CUE_NUMBER = r"(?i)(phone|tel[.: ]|fax|call|mobile)"
_FEATURES = ["kind", "length", "digits", "left", "right", "assigned", "check"]

SEGMENT = 4000  # characters, at least, but for the last one
_BEFORE = 24
# A segment ends behind a character that no pattern holds, or behind a blank that is not amid digits and their marks.
_CUT = rf"(?s).{{{SEGMENT},}}?(?:[^A-Za-z0-9._%+()/=@ -]|(?<![0-9 ().-]) | (?![0-9 ().-]))|.+"

CANDIDATE = "array<struct<kind:int,start:int,end:int,match:string>>"


def _none() -> Column:
    return F.array().cast(CANDIDATE)


def _spans(kind: int, text: Column, pattern: str, shown: Column | None = None) -> Column:
    """All matches with their places in code points; ``shown`` is the text to quote from where ``text`` was altered."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.transform(F.split(text, pattern, -1), F.length), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        quoted = x["m"] if shown is None else F.substring(shown, begin + 1, end - begin)
        item = F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), quoted.alias("match")))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], item)).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.try_to_number(d, F.lit("9")).cast("int") * (1 + i % 2))
    return F.aggregate(places, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(F.coalesce(d, F.lit(0)))) % 10 == 0


def _check(x: Column) -> Column:
    """Does a candidate of a base kind pass? Null for the wider kinds."""
    digits = _digits(x["match"])
    parts = F.transform(F.split(x["match"], r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: F.length(p).__lt__(3) | ((F.length(p) == 3) & (p <= "255")))
    return (
        F.when(x["kind"] == 1, F.lit(True)).when(x["kind"] == 2, small)
        .when(x["kind"] == 3, F.length(digits).between(16, 19) & _luhn(digits))
        .when(x["kind"] == 4, F.length(digits).between(8, 15))
    )


def _segments(text: Column) -> Column:
    """A text as array of struct(at, lead, text): where each segment begins, what stands before it, and the segment."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    pieces = F.when(F.length(text) <= SEGMENT, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(_CUT), F.lit(0)))
    begins = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
    leads = F.concat(F.array(F.lit("")), F.transform(pieces, lambda p: F.substring(p, -_BEFORE, _BEFORE)))
    placed = F.zip_with(begins, leads, lambda at, lead: F.struct(at.alias("at"), lead.alias("lead")))
    joined = F.zip_with(placed, pieces, lambda x, p: F.struct(x["at"].alias("at"), x["lead"].alias("lead"), p.alias("text")))
    return F.filter(joined, lambda x: x["text"].isNotNull())  # the last begin has no segment


def _candidates(text: Column) -> Column:
    """All candidates of one segment, by kind and then place."""
    digit, dotted, tight = text.rlike("[0-9]"), F.regexp_replace(text, _LOOSE_DOT, "%"), F.regexp_replace(text, _LOOSE_GAP, "x")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), _spans(1, dotted, _EMAIL, text)).otherwise(_none()),
        F.when(digit & text.rlike(_IP), _spans(2, text, _IP)).otherwise(_none()),
        F.when(digit & text.rlike("[0-9](?:[ -]?[0-9]){15}"), F.filter(
            _spans(3, tight, _DIGITS, text), lambda x: F.length(_digits(x["match"])) >= 13)).otherwise(_none()),
        F.when(F.contains(text, F.lit("+")) & text.rlike(_PHONE), _spans(4, text, _PHONE)).otherwise(_none()),
        F.when(digit & text.rlike(_NUMBER), F.filter(
            _spans(5, text, _NUMBER), lambda x: F.length(_digits(x["match"])).between(9, 15))).otherwise(_none()),
        F.when(digit & text.rlike(_SECRET), F.filter(
            _spans(6, text, _SECRET), lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]"))).otherwise(_none()),
    )


def _side(char: Column) -> Column:
    return F.when((char == "") | char.rlike(r"\s"), 0).when(char.rlike("[\"'`]"), 1).when(char.rlike("[A-Za-z0-9]"), 2).otherwise(3)


def _featured(segment: Column, x: Column) -> Column:
    context, moved = F.concat(segment["lead"], segment["text"]), F.length(segment["lead"]) + x["start"]
    before = F.when(moved == 0, "").otherwise(
        F.substring(context, F.greatest(moved - (_BEFORE - 1), F.lit(1)), F.least(moved, F.lit(_BEFORE))))
    length, digits, check = F.length(x["match"]), F.length(_digits(x["match"])), _check(x)
    codes = {
        "kind": x["kind"],
        "length": F.when(length < 12, 0).when(length < 16, 1).when(length < 20, 2).when(length < 41, 3).otherwise(4),
        "digits": F.least(F.floor(4 * digits / length), F.lit(3)).cast("int"),
        "left": _side(F.substring(before, -1, 1)),
        "right": _side(F.substring(segment["text"], x["end"] + 1, F.lit(1))),
        "assigned": before.rlike("[=:][ \"'`]*$").cast("int"),
        "check": F.when(check, 1).when(~check, 0).otherwise(2),
    }
    label = F.when(check.isNotNull(), check).when(x["kind"] == 5, before.rlike(_CUE_NUMBER)).otherwise(before.rlike(_CUE_SECRET))
    return F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
        F.coalesce(check, F.lit(False)).alias("base"), label.cast("int").alias("label"),
        F.struct(*[v.cast("int").alias(k) for k, v in codes.items()]).alias("f"),
    )


def _found(segment: Column) -> Column:
    """The candidates of a segment with their features, placed in the segment."""
    return F.transform(_candidates(segment["text"]), lambda x: _featured(segment, x))


def _placed(segment: Column, spans: Column) -> Column:
    """Spans of a segment as struct(kind, start, end), placed in the text."""
    return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), (x["start"] + segment["at"]).alias("start"), (x["end"] + segment["at"]).alias("end")))


_WIDER = (5, 6)


class Booster:
    """Boosted trees on counted cells: logistic loss, Newton leaves, and thresholds calibrated on cells held out.

    Each wider kind has a threshold of its own, and the base matches that failed their check have one together (0). Base
    matches that passed are kept anyway and count for none of them.
    """

    def __init__(self, rounds: int = 12, depth: int = 3, rate: float = 0.4, precision: float = 0.95):
        self.rounds, self.depth, self.rate, self.precision = rounds, depth, rate, precision
        self.start, self.trees, self.thresholds = 0.0, [], {}

    def fit(self, cells: list[tuple[tuple, bool, float, float]]) -> Booster:
        """``cells``: (features, held out, positives, rows)."""
        train = [(f, p, n) for f, held, p, n in cells if not held]
        total, positive = sum(n for _, _, n in train), sum(p for _, p, _ in train)
        if not total:
            return self
        self.start = math.log((positive + 0.5) / (total - positive + 0.5))
        scores = [self.start] * len(train)
        for _ in range(self.rounds):
            chance = [1 / (1 + math.exp(-s)) for s in scores]
            rows = [(f, p - n * c, n * c * (1 - c)) for (f, p, n), c in zip(train, chance)]
            tree = self._grow(rows, self.depth)
            self.trees.append(tree)
            scores = [s + self._leaf(tree, f) for s, (f, _, _) in zip(scores, train)]
        kind, check = _FEATURES.index("kind"), _FEATURES.index("check")
        for group in (0, *_WIDER):
            held = [(self.score(f), p, n) for f, out, p, n in cells if out and f[check] != 1 and group == (f[kind] if f[kind] in _WIDER else 0)]
            held.sort(key=lambda x: -x[0])
            good = seen = 0.0
            for i, (s, p, n) in enumerate(held):
                good, seen = good + p, seen + n
                if good >= self.precision * seen and (i + 1 == len(held) or held[i + 1][0] < s):
                    self.thresholds[group] = s
        return self

    def _grow(self, rows, depth):
        gain = lambda g, h: g * g / (h + 1.0)
        g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
        best = (1e-9, None, None)
        for k in range(len(_FEATURES)) if depth else ():
            for at in sorted({r[0][k] for r in rows})[1:]:
                left = [r for r in rows if r[0][k] < at]
                lg, lh = sum(r[1] for r in left), sum(r[2] for r in left)
                best = max(best, (gain(lg, lh) + gain(g - lg, h - lh) - gain(g, h), k, at), key=lambda x: x[0])
        _, k, at = best
        if k is None:
            return self.rate * g / (h + 1.0)
        return (k, at, self._grow([r for r in rows if r[0][k] < at], depth - 1), self._grow([r for r in rows if r[0][k] >= at], depth - 1))

    def _leaf(self, tree, f):
        while isinstance(tree, tuple):
            tree = tree[2] if f[tree[0]] < tree[1] else tree[3]
        return tree

    def score(self, f) -> float:
        return self.start + sum(self._leaf(t, f) for t in self.trees)

    def expression(self, f: Column) -> Column:
        def case(tree):
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(f[_FEATURES[tree[0]]] < tree[1], case(tree[2])).otherwise(case(tree[3]))

        total = F.lit(float(self.start))
        for tree in self.trees:
            total = total + case(tree)
        return total

    def chosen(self, f: Column) -> Column:
        if not self.thresholds:
            return F.lit(False)
        least = F.lit(None).cast("double")
        for group, s in self.thresholds.items():
            least = F.when(f["kind"] == group if group else ~f["kind"].isin(*_WIDER), F.lit(s - 1e-9)).otherwise(least)
        return F.coalesce(self.expression(f) >= least, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", **options) -> Booster:
    """Count the cells over all texts and boost on the counts; every fifth text by hash calibrates the thresholds."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select((F.pmod(F.xxhash64(text), F.lit(5)) == 0).alias("held"), F.flatten(F.transform(_segments(text), _found)).alias("c"))
    found = found.where(F.size("c") > 0).select("held", F.explode("c").alias("x"))
    cells = found.groupBy("held", *[F.col("x")["f"][k].alias(k) for k in _FEATURES]).agg(F.sum("x.label").alias("p"), F.count("*").alias("n"))
    return Booster(**options).fit(sorted((tuple(r[k] for k in _FEATURES), r["held"], float(r["p"]), float(r["n"])) for r in cells.collect()))


def detect(docs: DataFrame, text_col: str = "text", model: Booster | None = None) -> DataFrame:
    """``docs`` as one column ``row``, and ``base`` and ``spans``: arrays of struct(kind, start, end), by kind and start.

    Every row stays, repeated ones and null ids too; a null or empty text has no spans. The columns of ``docs`` travel in
    one struct, so their names never clash. Places are code points, the end is exclusive. ``spans`` holds all of ``base``.
    """
    model = model or train(docs, text_col)
    rows = docs.select(F.struct("*").alias("row"), F.transform(_segments(F.col(text_col)), lambda g: _kept(g, model)).alias("g"))
    base = F.transform("g", lambda g: _placed(g, F.filter(g["c"], lambda x: x["base"])))
    spans = F.transform("g", lambda g: _placed(g, g["c"]))
    return rows.select("row", F.array_sort(F.flatten(base)).alias("base"), F.array_sort(F.flatten(spans)).alias("spans"))


def _kept(segment: Column, model: Booster) -> Column:
    """The segment with the candidates that are to go: struct(at, text, c)."""
    kept = F.filter(_found(segment), lambda x: x["base"] | model.chosen(x["f"]))
    return F.struct(segment["at"].alias("at"), segment["text"].alias("text"), kept.alias("c"))


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", model: Booster | None = None) -> DataFrame:
    """``docs`` with each span of ``text_col`` replaced by its kind in angle brackets; overlapping spans go as one.

    Texts without spans, null ones among them, stay as they are.
    """
    model = model or train(docs, text_col)
    name = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.array().cast("array<struct<start:int,end:int,kind:int>>")

    def join(acc, x):
        last = F.element_at(acc, -1)
        one = lambda s, e, k: F.array(F.struct(s.alias("start"), e.alias("end"), k.alias("kind")))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > x["start"]), F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1), one(last["start"], F.greatest(last["end"], x["end"]), last["kind"]),
        )).otherwise(F.concat(acc, one(x["start"], x["end"], x["kind"])))

    def merged(segment):
        by_place = F.array_sort(F.transform(segment["c"], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
        return F.struct(segment["text"].alias("text"), F.aggregate(by_place, start, join).alias("m"))

    def rewritten(segment):
        text, spans = segment["text"], segment["m"]
        pieces = F.transform(spans, lambda x, i: F.concat(
            F.substring(text, F.when(i == 0, 1).otherwise(F.get(spans, i - 1)["end"] + 1), x["start"] - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])),
            F.element_at(name, x["kind"])))
        rest = F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text))
        return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))

    rows = docs.select(F.struct("*").alias("row"), F.transform(_segments(F.col(text_col)), lambda g: _kept(g, model)).alias("g"))
    rows = rows.select("row", F.transform("g", merged).alias("g"))
    text = F.col("row")[text_col]
    redacted = F.when(F.exists("g", lambda g: F.size(g["m"]) > 0), F.array_join(F.transform("g", rewritten), "")).otherwise(text)
    return rows.select(*[(redacted if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
