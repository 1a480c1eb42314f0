"""Token counts against the library, draws and phrases against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkprep.llm.importance import _bisect, crc32_of, feature_buckets, resample
from sparkprep.llm.token_counts import count_slice, count_tokens, load, merged_sizes
from sparkprep.llm.words import text_slices

PATH = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return load(open(PATH, encoding="utf-8").read())


def test_counts_are_the_librarys(tokenizer, vocabulary):
    r = random.Random(1)
    letters = "aaabbbtheinsgr'’stmdlve 0123ÀéİΣßﬁœﾊ한国語́  😀!?.,ABC\t\n\x85\x1c"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["a<|endoftext|>b <|startoftext|><|endoftext|>", "don't we'll 'tis x''s '' 's's", "", " ", "\0 ﻿"]
    texts += ["a" * n for n in (1, 2, 3, 127, 1000, 5001)] + ["ha" * 3000 + "h", "\U0001f602" * 3000, "ab" * 4000]
    # Long unbroken runs: every pair that is the lowest within reach.
    texts += ["".join(r.choice(s) for _ in range(3000)) for s in ("aab", "abcdefghijklmnopqrstuvwxyz", ["the", "ing", "an", "haha"]) for _ in range(5)]
    counted = [n for _, _, data, offsets in text_slices(pa.array(texts), 5000) for n in count_slice(vocabulary, data, offsets).tolist()]
    assert counted == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_merges_in_rounds(vocabulary):
    assert merged_sizes(vocabulary, np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
    assert merged_sizes(vocabulary, vocabulary.last[np.frombuffer(b"xy", np.uint8)], np.array([1, 0, 1])).tolist() == [1, 0, 1]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def test_count_tokens(spark, tokenizer):
    texts = [None, "", "  \n", "Hello, world's end", "Hello, world's end", "word " * 3000, ("lorem ipsum é " * 400_000)]
    rows = list(enumerate(texts)) + [(None, "x"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("id", F.lit(1))
    counted = count_tokens(df, PATH)
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(((i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows), key=repr)
    assert sorted(map(tuple, counted.collect()), key=repr) == want
    assert count_tokens(df.where("false"), PATH).collect() == []


def test_crc_of_many_words():
    r = random.Random(2)
    words = [bytes(r.randrange(128, 256) for _ in range(r.choice([1, 2, 7, 63, 64, 65, 300]))) for _ in range(200)]
    data, offsets = np.frombuffer(b" ".join(words), np.uint8), np.cumsum([0] + [len(w) + 1 for w in words])
    assert crc32_of(data, offsets[:-1], offsets[1:] - 1).tolist() == [zlib.crc32(w) for w in words]
    one, _, two, _ = feature_buckets(data, np.array([0, len(data)]), 10_000)
    assert one.tolist() == [zlib.crc32(w) % 10_000 for w in words]
    assert two.tolist() == [zlib.crc32(a + b" " + b) % 10_000 for a, b in zip(words, words[1:])]


def plain_draw(docs, target, percent, least):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def features(text):
        w = word.findall((text or "").translate(LOWER))
        return w, [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = [0] * 10_000, [0] * 10_000
    for x in (x for _, text in docs for x in features(text)[1]):
        s[x] += 1
    for x in (x for text in target for x in features(text)[1]):
        t[x] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + 10_000) / ((s[i] + 1) * (sum(t) + 10_000)))) for i in range(10_000)]
    rows = []
    for i, text in docs:
        words, f = features(text)
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)))
    pool = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): n + 1 for n, r in enumerate(pool[: percent * len(pool) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize("percent", [10, 100])
def test_resample(spark, percent):
    r = random.Random(percent)
    vocab = ["alpha", "Beta", "été", "x" * 80, "7", "don't", "漢字"]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(8)))) for i in range(300)]
    # Repeated rows have equal ids and scores; nulls, blanks and a very long word.
    docs += [(7, "alpha alpha beta beta")] * 40 + [(None, "alpha beta gamma delta")] * 3 + [(900, None), (901, ""), (902, "..."), (903, "z" * 3_000_000 + " y y y")]
    target = ["alpha beta", None, "été été"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(7)
    drawn = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, min_words=3)
    assert sorted(map(tuple, drawn.collect()), key=repr) == plain_draw(docs, target, percent, 3)


def test_resample_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert resample(df, df).collect() == []
    assert [r["rank"] for r in resample(spark.createDataFrame([(1, "a b")], df.schema), df, percent=100, min_words=1).collect()] == [1]


def test_bisection(spark):
    values = spark.createDataFrame([(x,) for x in [5, 5, 5, 1, -9, 70, 2**62]], "v long")
    assert _bisect(values, F.col("v"), -9, 2**62 + 1, 2) == (70, 1)
    assert _bisect(values, F.col("v"), -9, 2**62 + 1, 4) == (5, 2)
    assert _bisect(values, F.col("v"), -9, 2**62 + 1, 7) == (-9, 6)


def plain_paths(rows, most):
    """Counts of all phrases of each language by plain slicing."""
    found, sizes = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] = sizes.get(lang, 0) + len(words)
            for i in range(len(words)):
                for k in range(1, min(most, len(words) - i) + 1):
                    p = (lang, *words[i : i + k])
                    found[p] = found.get(p, 0) + 1
    return found, sizes


def plain_collocations(rows, most, least, top):
    f, sizes = plain_paths(rows, most)
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in candidates.items():
        inside = any(100 * b >= 80 * a for q, b in candidates.items() if len(q) > len(p) and q[0] == p[0]
                     and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q) - len(p) + 2)))
        if not inside:
            cuts = [(2_000_000 * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return sorted((lang, i + 1, w.decode(), -a, l, r, sizes[lang], -s) for lang, best in out.items() for i, (s, a, w, l, r) in enumerate(sorted(best)[:top]))


def phrase_rows():
    r = random.Random(5)
    vocab = ["the", "Of", "in", "new", "york", "city", "É", "x y", "'s", "(a)", *[f"w{i}" for i in range(60)]]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = [(r.choice(["en", "en", "fr", None]), "".join(w + r.choice([" ", " ", " ", "\t", ", ", ".", "\n", "; "]) for w in r.choices(vocab, weights, k=r.randrange(1, 120)))) for _ in range(150)]
    # One text many times over, nulls and blanks, a very long text, a language of its own name.
    return rows + [("en", "New York City is big, new york city IS big")] * 60 + [("en", None), (None, ""), ("und", "the of the of. the of"), ("de", " .,\n "), ("fr", "so la la " * 5000)]


@pytest.mark.parametrize(("shard", "held", "fold"), [(4_000_000, 4_000_000, 3_000_000), (700, 900, 300)])
def test_collocations(spark, monkeypatch, shard, held, fold):
    from sparkprep.llm import collocations as module

    for name, value in (("SHARD_PATHS", shard), ("RANGE_PATHS", held), ("FOLD_PATHS", fold), ("COMMON_WORDS", fold // 10)):
        monkeypatch.setattr(module, name, value)
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("score", F.lit("clash")).withColumn("h0", F.lit(1)).repartition(5)
    got = module.collocations(df, least=4, top=25)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 4, 4, 25)


def test_collocations_of_nothing(spark):
    from sparkprep.llm.collocations import collocations

    df = spark.createDataFrame([(None, None)], "lang string, text string")
    assert collocations(df).collect() == [] and collocations(df.where("false")).collect() == []


def test_transducers_add_up():
    from sparkprep.llm import collocations as module

    r = np.random.default_rng(3)
    total, blobs, common = {}, [], np.array([-2, 0, 3]) * 10**17
    for _ in range(4):
        paths = []
        for _ in range(3000):
            n = r.integers(1, 5)
            paths.append((int(r.integers(0, 2)), *(int(x) for x in r.integers(-3, 4, n) * 10**17), *[module.NONE] * (4 - n)))
        for p in paths:
            total[p] = total.get(p, 0) + 1
        langs, words, numbers = module._numbered([np.array(c) for c in zip(*paths)])
        paths, counts = module._summed(numbers, np.ones(3000, np.int64), len(langs), len(words))
        layers = module.build(paths, counts, np.searchsorted([0, 40, 900], np.arange(len(counts)), "right") - 1)
        # Fewer states than nodes: equal endings are one.
        assert len(layers[-1][0]) < len(np.unique(np.stack(paths[:4]), axis=1).T)
        blobs += [b for _, b in module.pieces(langs, words, layers, common)]
    langs, words, paths, counts = module.unite(blobs, 5, common)
    names = np.concatenate(([module.NONE], words))
    assert {(int(langs[p[0] - 1]), *[int(names[x]) for x in p[1:]]): int(n) for p, n in zip(zip(*paths), counts)} == total
