"""Numbering, running totals, carrying values and quantiles, on slices (many partitions) against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import sparkprep as sp
from sparkprep.operators import ordering


@pytest.fixture(autouse=True)
def many_slices(spark):
    """Small tables would be put together into one slice."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _data(seed=1, n=600):
    """A third of all rows has one key, and a third of those are copies of one row."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rnd.choice(["a", "b", None, "zz"])
        rows.append((key, 7 if i % 9 == 0 else rnd.randint(0, 40), None if rnd.random() < 0.4 else rnd.randint(1, 5)))
    return rows


SCHEMA = "k string, o int, v int"


def _null_first(value):
    return (value is not None, value if value is not None else 0)


def test_row_id_covers_all_numbers(spark):
    df = spark.createDataFrame(_data(), SCHEMA).repartition(6)
    out = sp.row_id(df, ["o"], start=0).collect()
    assert sorted(r.ID for r in out) == list(range(600))
    by_id = sorted(out, key=lambda r: r.ID)
    assert [r.o for r in by_id] == sorted(r.o for r in out)


def test_row_id_types_positions_and_errors(spark):
    df = spark.range(5)
    first = sp.row_id(df, ["id"], name="n", type="float64", position="first", start=3)
    assert first.columns == ["n", "id"] and first.schema["n"].dataType.simpleString() == "double"
    assert [(r.n, r.id) for r in first.orderBy("id").collect()] == [(3.0, 0), (4.0, 1), (5.0, 2), (6.0, 3), (7.0, 4)]
    with pytest.raises(ValueError, match="order_by"):
        sp.row_id(df, None)
    assert sp.row_id(df.limit(0), ["id"]).count() == 0


def test_copies_spread_over_slices(spark):
    """Copies of one row must not end up in one partition."""
    df = spark.range(20000, numPartitions=8).select(F.lit(1).alias("x"), F.lit("same").alias("t"))
    slices = ordering.sorted_slices(df, [F.col("x").asc()])
    sizes = [r["count"] for r in slices.groupBy(ordering.SLICE).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 12000 and sum(sizes) == 20000


def test_grouped_numbers(spark):
    df = spark.createDataFrame(_data(), SCHEMA).repartition(6)
    out = ordering.number_rows(df, [F.col("o").asc()], "n", by=["k"]).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.k, []).append((r.n, r.o))
    assert sum(map(len, groups.values())) == 600
    for values in groups.values():
        values.sort()
        assert [n for n, _ in values] == list(range(1, len(values) + 1))
        assert [o for _, o in values] == sorted(o for _, o in values)


def test_running_totals(spark):
    rows = [(k, o, n) for k in ("hot", "b", None) for o, n in zip(range(90 if k == "hot" else 7), range(1, 100))]
    df = spark.createDataFrame(rows, "k string, o int, n int").repartition(5)
    out = ordering.running_totals(df, ["k"], ["o"], {"before": "n"}, distinct_order=True).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.before == sum(n for k, o, n in rows if k == r.k and o < r.o)


@pytest.mark.parametrize("direction", ["ffill", "bfill"])
@pytest.mark.parametrize("by", [None, ["k"]])
def test_carry(spark, direction, by):
    rows = [(r[0], i, r[2]) for i, r in enumerate(_data(3, 200))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = {r.o: r.v for r in sp.cleanse(df, ["v"], fill=direction, order_by=["o"], by=by).collect()}
    expected, last = {}, {}
    for k, o, v in rows if direction == "ffill" else rows[::-1]:
        group = k if by else "all"
        if v is not None:
            last[group] = v
        expected[o] = last.get(group)
    assert out == expected


def test_exact_quantiles(spark):
    import numpy as np

    rnd = random.Random(5)
    rows = [(k, rnd.choice([1.0, 2.5, 2.5, rnd.random() * 9]), None if rnd.random() < 0.2 else float(rnd.randint(0, 9)))
            for k in ("x", "y", None) for _ in range(120 if k == "x" else 9)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for r in ordering.exact_quantiles(df, ["k"], ["a", "b"], probs).collect():
        values = [row[1 if r.field == "a" else 2] for row in rows if row[0] == r.k]
        wanted = np.quantile([v for v in values if v is not None], probs)
        assert r.quantiles == pytest.approx(list(wanted))


def test_frequencies_spearman_kendall_median_on_slices(spark):
    pd = pytest.importorskip("pandas")
    rnd = random.Random(8)
    rows = [(rnd.randint(0, 6), rnd.choice([None, 1.5, 2.5, rnd.random()]), rnd.randint(0, 3)) for _ in range(150)]
    df = spark.createDataFrame(rows, "a int, b double, c int").repartition(5)
    frame = pd.DataFrame(rows, columns=["a", "b", "c"]).astype(float)
    spearman = sp.correlation_matrix(df, method="spearman").toPandas().set_index("index")
    ranked = pd.DataFrame(
        {x: {y: _rank_corr(frame[x], frame[y]) for y in frame} for x in frame}
    )
    assert spearman.astype(float).to_numpy() == pytest.approx(ranked.loc[spearman.index, spearman.columns].to_numpy())
    kendall = sp.correlation_matrix(df, method="kendall").toPandas().set_index("index")
    for x in ("a", "b", "c"):
        for y in ("a", "b", "c"):
            assert kendall.loc[x, y] == pytest.approx(_tau(frame[x], frame[y]))
    counts = sp.frequencies(df, ["a", "b"]).collect()
    last = {}
    for r in counts:
        last[r.field_name] = max(last.get(r.field_name, 0), r.cumulative_frequency)
    assert last == {"a": 150, "b": 150}
    assert sp.aggregate(df, ["c"], [("a", "median")]).where("c = 1").first()[1] == frame[frame.c == 1].a.median()


def _rank_corr(x, y):
    both = x.notna() & y.notna()
    return x[both].rank().corr(y[both].rank())


def _tau(x, y):
    both = [(a, b) for a, b in zip(x, y) if a == a and b == b]
    sign = lambda d: (d > 0) - (d < 0)
    n = len(both)
    s = tx = ty = 0
    for i in range(n):
        for j in range(i):
            dx, dy = sign(both[i][0] - both[j][0]), sign(both[i][1] - both[j][1])
            s, tx, ty = s + dx * dy, tx + (dx == 0), ty + (dy == 0)
    pairs = n * (n - 1) / 2
    return s / ((pairs - tx) * (pairs - ty)) ** 0.5


def test_sample_random_is_exact_and_repeatable(spark):
    df = spark.range(5000, numPartitions=5).select((F.col("id") % 50).alias("x"))  # 100 copies of each row
    for n in (0, 1, 999, 2500, 4999, 5000, 9000):
        a, b = (sorted(r.x for r in sp.sample_rows(df, n=n).collect()) for _ in range(2))
        assert a == b and len(a) == min(n, 5000)
    assert sp.sample_rows(df, percent=33.33).count() == 1666
    assert sp.sample_rows(df, n=100, seed=1).exceptAll(sp.sample_rows(df, n=100, seed=2)).count() > 0


def test_sample_large_groups(spark):
    df = spark.range(6000, numPartitions=5).select(F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("k"), "id")
    out = sp.sample_rows(df, n=1500, mode="last", by=["k"], order_by=["id"])
    kept = {}
    for r in out.collect():
        kept.setdefault(r.k, []).append(r.id)
    assert sorted(kept["hot"]) == list(range(2500, 4000)) and sorted(kept["cold"]) == list(range(4500, 6000))
    shares = sp.sample_rows(df, percent=12.5, by=["k"]).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in shares} == {"hot": 500, "cold": 250}
    with pytest.raises(ValueError):
        sp.sample_rows(df, n=1, percent=2)
