"""Substring, vector and shingle operators against brute force, with nulls, ties, repeated rows and clashing names."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkprep.llm.embedding_dedup import embedding_links
from sparkprep.llm.graph import components
from sparkprep.llm.jaccard_join import bitmap, brute_force_links, jaccard_components, keep_one_per_class, overlap_bound
from sparkprep.llm.substring_dedup import remove_repeats


def _find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def _least(n, links, names):
    parent = list(range(n))
    for a, b in links:
        parent[_find(parent, a)] = _find(parent, b)
    roots = [_find(parent, i) for i in range(n)]
    return [min(names[j] for j in range(n) if roots[j] == roots[i]) for i in range(n)]


def _repeats(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        covered = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                covered[k : k + window] = [True] * window
        out.append((i, len(w), sum(covered), b" ".join(x for x, c in zip(w, covered) if not c).decode()))
    return sorted(out, key=repr)


def test_repeats(spark, rows_of):
    rng, rows = random.Random(1), []
    letters = ["a", "b", "cc", "dé", "e\x85f"]
    for i in range(60):
        some = letters[: rng.choice([1, 2, 5])]
        rows.append((i, " ".join(rng.choice(some) for _ in range(rng.choice([0, 3, 12, 40, 200])))))
    rows += [(None, None), (5, rows[5][1]), (99, ""), (None, rows[7][1]), (100, "x" * 3000 + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("_hash", F.lit(1))
    for window, group_rows in ((3, 20_000), (10, 3), (35, 20_000)):
        assert rows_of(remove_repeats(df, window=window, group_rows=group_rows)) == _repeats(rows, window)
    assert remove_repeats(df.limit(0)).count() == 0


def test_components(spark, rows_of):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (21, 20), (30, 30), (None, 4)]
    got = rows_of(components(spark.createDataFrame(links, "a long, b long")))
    assert got == sorted([(x, 1) for x in (1, 2, 3, 7, 8, 9)] + [(20, 20), (21, 20)], key=repr)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=rng.choice([3, 8])).tolist(), int(rng.integers(3))) for i in range(200)]
    rows += [(401, None, 1), (402, [0.0] * 3, 1), (403, [1.0, None, 2.0], 1), (404, [float("nan"), 1.0, 2.0], 1), (405, [1.0, 2.0, 3.0], None),
             (406, [float("inf"), 1.0, 1.0], 1), (407, [], 1)] + [(500 + i, rows[5][1], rows[5][2]) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    good = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = []
    for i, (_, u, k) in enumerate(rows):
        for j, (_, v, m) in enumerate(rows[:i]):
            if k is not None and k == m and good(u) and good(v) and len(u) == len(v):
                if np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93:
                    links.append((i, j))
    degree = Counter(x for pair in links for x in pair)
    least = _least(len(rows), links, [r[0] for r in rows])
    expected = sorted((r[0], degree[i], least[i], r[0] == least[i]) for i, r in enumerate(rows))
    for tile in (2048, 7):
        assert sorted(tuple(r) for r in embedding_links(df, tile=tile).collect()) == expected
    assert embedding_links(df.limit(0)).count() == 0


def test_shingles(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["É", "ß"]
    shared = [rng.choice(words) for _ in range(30)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 30, 80]))] for _ in range(30)]
    rows = []
    for i in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, "  ".join(t + shared * (rng.random() < 0.5))))
    rows += [(300, None), (301, ""), (302, " \n"), (303, rows[3][1].replace("w", "W")), (304, "\xa0 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("clash"))
    least = _least(len(rows), brute_force_links([t for _, t in rows]), [i for i, _ in rows])
    got = sorted((r.doc_id, r.component_id) for r in jaccard_components(df).collect())
    assert got == sorted((i, c) for (i, _), c in zip(rows, least))
    kept = keep_one_per_class(df.union(df.limit(3)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least)) and kept.columns == df.columns
    assert jaccard_components(df.limit(0)).count() == 0


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(2)
    for n, m in ((5, 7), (100, 130), (40, 1000)):
        pool = rng.integers(0, 2**63, 1200, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 2 : n // 2 + m])
        bits = [np.frombuffer(bitmap(x), np.uint8) for x in (a, b)]
        assert overlap_bound(len(a), bits[0], len(b), bits[1]) >= len(np.intersect1d(a, b))


def test_long_bitmaps_are_half_as_long_and_still_bound():
    """A set of 400 took 2,048 bits before; folded or not, a bitmap never shows less overlap than there is."""
    assert [len(bitmap(np.arange(n, dtype=np.uint64) << np.uint64(20))) * 8 for n in (1, 16, 17, 256, 257, 400, 512, 513)] == [64, 64, 128, 1024, 1024, 1024, 1024, 2048]
    rng = np.random.default_rng(5)
    for n, common in ((40, 30), (300, 250), (400, 0), (600, 599), (520, 500)):
        pool = np.unique(rng.integers(0, 2**63, 3 * n, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(pool[n - common : 2 * n - common])
        bound = overlap_bound(n, np.frombuffer(bitmap(a), np.uint8), n, np.frombuffer(bitmap(b), np.uint8))
        assert common <= bound <= n
