"""Toxicity by weak supervision: many voters, a generative model of their accuracies, a linear classifier on its labels.

1. Terms: from a bounded sample of labelled rows (``LABELLED_ROWS``), the words and word beginnings that stand far more
   often in toxic texts, once or at least twice, whichever tells more. They are dealt into lexicons; with four patterns
   (shouting, exclamations, odd characters, digits) each lexicon is a voter.
2. Label model: the votes of all texts are counted by pattern of votes (at most ``2 ** VOTERS`` counts). Expectation and
   maximisation estimate each voter's rate among toxic and clean texts; voters that agree beyond that are found by their
   conditional correlation and share their say.
3. Classifier: logistic regression on the terms and patterns, with the label model's posterior as soft labels, on a bounded
   sample of texts (``SAMPLE_ROWS``); its scale is fitted on the labelled sample.

Only texts are inputs of a score. Rows held out (see ``held_out``) give neither labels nor rows for the classifier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm.words import byte_sums, hashes_of, lower_ascii, mix, text_slices, word_places

LABELLED_ROWS = 10_000
SAMPLE_ROWS = 20_000
TERMS = 2_000
LEXICONS = 12
VOTERS = LEXICONS + 4
_SLICE = 500_000  # bytes of text a worker looks at together: its arrays take some 100 times that
_CUTS = (0, 4, 5, 6, 7, 8)  # whole words, and the first bytes of longer words


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _terms(data, starts, ends):
    """For each of ``_CUTS``: hashes of the words' beginnings, and which words are long enough to have one."""
    sums = byte_sums(data)
    for kind, size in enumerate(_CUTS):
        stop = np.minimum(ends, starts + size) if size else ends
        yield mix(hashes_of(sums, data, starts, stop) + np.uint64(kind + 1)), (ends - starts > size)


def _patterns(data, offsets):
    """Four dense features per text: shares of capitals, exclamation marks, other signs and digits, scaled to about 0..1."""
    share = np.zeros((4, len(offsets) - 1))
    sums, sizes = np.zeros(len(data) + 1, np.int64), np.maximum(np.diff(offsets), 1)
    for kind, marks in enumerate((
        (data >= 65) & (data <= 90), data == 33,
        ((data >= 35) & (data <= 38)) | (data == 42) | (data == 64), (data >= 48) & (data <= 57))):
        np.cumsum(marks, out=sums[1:])
        share[kind] = np.diff(sums[offsets]) / sizes
    return np.minimum(share.T * np.array([4, 50, 50, 10]), 1.0)


def _pairs(data, offsets):
    """Distinct (text number, term) of a slice, and whether the term stands there twice or more."""
    starts, ends, of_text = word_places(data, offsets)
    low = lower_ascii(data)
    text = np.searchsorted(of_text, np.arange(len(starts)), "right") - 1
    terms, texts = [], []
    for h, fits in _terms(low, starts, ends):
        terms.append(h[fits])
        texts.append(text[fits])
    terms, texts = np.concatenate(terms), np.concatenate(texts)
    order = np.lexsort((terms, texts))
    terms, texts = terms[order], texts[order]
    new = np.concatenate(([True], (terms[1:] != terms[:-1]) | (texts[1:] != texts[:-1]))) if len(terms) else np.zeros(0, bool)
    twice = np.diff(np.append(np.flatnonzero(new), len(new))) > 1
    return texts[new], terms[new], twice


def _known(data, offsets, terms: np.ndarray, need: np.ndarray):
    """Distinct (text number, place in the sorted ``terms``) of a slice, for terms that stand there ``need`` times."""
    starts, ends, of_text = word_places(data, offsets)
    low = lower_ascii(data)
    likely = np.zeros(1 << 20, bool)
    likely[terms & np.uint64((1 << 20) - 1)] = True
    found = []
    for h, fits in _terms(low, starts, ends):
        at = np.flatnonzero(likely[h & np.uint64((1 << 20) - 1)] & fits)
        place = np.minimum(np.searchsorted(terms, h[at]), max(len(terms) - 1, 0))
        ok = terms[place] == h[at] if len(terms) else np.zeros(len(at), bool)
        text = np.searchsorted(of_text, at[ok], "right") - 1
        found.append(text * max(len(terms), 1) + place[ok])
    found, times = np.unique(np.concatenate(found), return_counts=True)
    if len(found):
        found = found[times >= need[found % len(terms)]]
    return found // max(len(terms), 1), found % max(len(terms), 1)


class Toxicity:
    """What is learned: ``terms`` (sorted hashes), ``weights`` (terms, then patterns), ``bias``; the voters' model beside."""

    def __init__(self, terms, need, weights, bias, voters=None):
        self.terms, self.need, self.weights, self.bias, self.voters = terms, need, weights, bias, voters or {}

    def score_slice(self, data, offsets):
        n = len(offsets) - 1
        text, place = _known(data, offsets, self.terms, self.need)
        z = self.bias + _patterns(data, offsets) @ self.weights[len(self.terms) :]
        z += np.bincount(text, self.weights[place], n) if len(text) else 0.0
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _label_model(votes: np.ndarray, counts: np.ndarray, known: np.ndarray, labels: np.ndarray, rounds: int = 20):
    """EM on counted votes (0/1): rates among toxic and clean, the voters' say, and the posterior of each pattern of votes.

    It begins with the rates of the labelled votes (``known``, ``labels``), and keeps counting them with their labels.
    """
    n = votes.shape[1]
    prior = labels.mean()
    post, say = np.zeros(len(counts)), np.ones(n)
    for i in range(rounds + 1):
        use = counts * (i > 0)
        groups = ((use * post, labels), (use * (1 - post), 1 - labels))
        rates, agree = [], np.zeros((n, n))
        for w, k in groups:
            r = (votes.T @ w + known.T @ k + 0.5) / (w.sum() + k.sum() + 1)
            rates.append(r)
            d, e = votes - r, known - r
            cov = ((d * w[:, None]).T @ d + (e * k[:, None]).T @ e) / max(w.sum() + k.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            agree += 0.5 * np.maximum(cov / np.outer(sd, sd), 0)
        np.fill_diagonal(agree, 0)
        r1, r0 = rates
        say = 1 / (1 + np.where(agree > 0.1, agree, 0).sum(axis=1))
        useful = r1 > r0 * 1.05  # a voter that does not speak up more among toxic texts has no say
        ratio = np.where(votes > 0, np.log(r1 / r0), np.log((1 - r1) / (1 - r0)))
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + (ratio * say * useful).sum(axis=1), -30, 30)))
    return {"toxic_rate": r1, "clean_rate": r0, "say": say, "agree": agree}, post


def _logistic(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, terms: int, dims: int, steps: int = 300):
    """Ridge logistic regression on sparse terms and dense patterns, by gradient steps with momentum per weight."""
    text = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    place = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    dense = np.array([r[1] for r in rows]).reshape(len(rows), dims)
    w, b, m, v = np.zeros(terms + dims), 0.0, np.zeros(terms + dims + 1), np.zeros(terms + dims + 1)
    share = np.where(soft > 0.5, 0.5 / max((soft > 0.5).sum(), 1), 0.5 / max((soft <= 0.5).sum(), 1))
    for t in range(1, steps + 1):
        z = b + dense @ w[terms:] + np.bincount(text, w[place], len(rows))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft) * share
        grad = np.concatenate((np.bincount(place, err[text], terms), dense.T @ err, [err.sum()])) + 1e-5 * np.append(w, 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          labelled_rows: int = LABELLED_ROWS, sample_rows: int = SAMPLE_ROWS) -> Toxicity:
    """Learn from ``labels`` (id, label 0/1; null labels are skipped, of several the greatest counts) and all texts.

    Without a labelled toxic and a labelled clean text every score is 0.5 or less: nothing can be learned.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))) \
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(labelled_rows)
    rows = docs.select(F.col(id_col).alias("id"), text)
    # Copies of one text would make its own words seem telling.
    marked = rows.join(F.broadcast(marks), "id").groupBy("text").agg(F.max("y").alias("y"))

    def count(batches):
        for b in batches:
            y = np.asarray(b.column(1)).astype(np.int64)
            for first, _, data, offsets in text_slices(b.column(0), _SLICE):
                t, h, twice = _pairs(data, offsets)
                h, inverse = np.unique(h, return_inverse=True)
                sums = [np.bincount(inverse, w, len(h)) for w in (y[first + t], None, y[first + t] * twice, twice)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), *[pa.array(x.astype(np.float64)) for x in sums]], ["term", "n1", "n", "m1", "m"])

    total = marked.agg(F.count("*").alias("n"), F.sum("y").alias("n1")).first()
    n, n1 = total["n"], total["n1"] or 0
    if not n1 or n1 == n:
        return Toxicity(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(4), -3.0)

    def sure(ones: str, all_: str) -> Column:
        """How far a term's log odds are above 0, less two standard errors."""
        other = F.col(all_) - F.col(ones)
        odds = F.log((F.col(ones) + 0.5) / (n1 + 1)) - F.log((other + 0.5) / (n - n1 + 1))
        return F.when(F.col(ones) < 3, -9.0).otherwise(odds - 2 * F.sqrt(1 / (F.col(ones) + 0.5) + 1 / (other + 0.5)))

    table = marked.mapInArrow(count, "term long, n1 double, n double, m1 double, m double").groupBy("term").agg(
        *[F.sum(c).alias(c) for c in ("n1", "n", "m1", "m")])
    table = table.select("term", sure("n1", "n").alias("once"), sure("m1", "m").alias("twice"))
    chosen = table.where(F.greatest("once", "twice") > 0.7).orderBy(F.desc(F.greatest("once", "twice")), "term").limit(TERMS).collect()
    chosen.sort(key=lambda r: r["term"] % 2**64)
    terms = np.array([r["term"] for r in chosen], np.int64).view(np.uint64)
    need = np.array([2 if r["twice"] > r["once"] else 1 for r in chosen], np.int64)
    lexicon = (mix(terms) % np.uint64(LEXICONS)).astype(np.int64)

    def features(batches):
        for b in batches:
            for _, _, data, offsets in text_slices(b.column(0), _SLICE):
                m = len(offsets) - 1
                t, place = _known(data, offsets, terms, need)
                dense = _patterns(data, offsets)
                votes = np.zeros((m, VOTERS), bool)
                votes[t, lexicon[place]] = True
                votes[:, LEXICONS:] = dense > 0.5
                mask = votes @ (1 << np.arange(VOTERS))
                ends = np.searchsorted(t, np.arange(m + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mask), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32))),
                     pa.array(dense.tolist(), pa.list_(pa.float64()))], ["mask", "terms", "dense"])

    schema = "mask long, terms array<int>, dense array<double>"
    own = marked.mapInArrow(lambda batches: (
        pa.RecordBatch.from_arrays([*f.columns, y], ["mask", "terms", "dense", "y"])
        for b in batches for f, y in _beside(features, b)), schema + ", y int").collect()
    counted = rows.select("text").mapInArrow(features, schema).groupBy("mask").count().collect()
    masks = np.array([r["mask"] for r in counted], np.int64)
    spread = lambda m: ((m[:, None] >> np.arange(VOTERS)) & 1).astype(float)
    y = np.array([r["y"] for r in own], float)
    voters, post = _label_model(spread(masks), np.array([r["count"] for r in counted], float), spread(np.array([r["mask"] for r in own], np.int64)), y)
    posterior = dict(zip(masks.tolist(), post.tolist()))

    # Rows and terms of the classifier's sample are bounded by parameters; texts stay on the executors.
    share = min(1.0, sample_rows / max(sum(r["count"] for r in counted), 1))
    picked = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_003)) < int(share * 1_000_003) + 1
    sample = rows.where(picked & ~held_out(F.col("id"))).select("text").mapInArrow(features, schema)
    sample = sample.groupBy("mask", "terms", "dense").count().orderBy("mask", "terms", "dense").collect()
    dims = 4
    pack = lambda rs: [(np.array(r["terms"], np.int64), np.array(r["dense"])) for r in rs]
    soft = np.array([posterior.get(r["mask"], n1 / n) for r in sample])
    w, bias = _logistic(pack(sample), soft, len(terms), dims)
    z = np.array([bias + w[np.array(r["terms"], np.int64)].sum() + np.array(r["dense"]) @ w[len(terms) :] for r in own])
    a, c = _scale(z, y)
    return Toxicity(terms, need, w * a, bias * a + c, voters)


def _beside(features, batch):
    """The features of one batch, slice by slice, with the slice's labels."""
    at = 0
    for f in features([batch]):
        yield f, batch.column(1).slice(at, f.num_rows)
        at += f.num_rows


def _scale(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit the scores to the labels (Newton steps, kept positive)."""
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        g = np.array([((p - y) * z).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * c])
        s = p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        d = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, c = a - np.clip(d[0], -1, 1), c - np.clip(d[1], -1, 1)
    return max(float(a), 0.05), float(c)


def score_toxicity(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """``docs`` as one struct column ``row``, and ``score`` (0 to 1). Null and empty texts get the model's base score.

    Every row stays, repeated ones too; the columns travel in one struct, so their names never clash.
    """
    index = docs.columns.index(text_col)

    def score(batches):
        for b in batches:
            parts = [model.score_slice(data, offsets) for _, _, data, offsets in text_slices(pa.compute.struct_field(b.column(0), index).cast(pa.string()), _SLICE)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["row", "score"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())])
    return docs.select(F.struct("*").alias("row")).mapInArrow(score, schema)
