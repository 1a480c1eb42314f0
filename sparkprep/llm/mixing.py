"""Mix sources to target weights: temperature on token shares, realised as block permutations within a budget.

Weights are ``share ** exponent``, normalised. The exponent is bisected, sixteen points to a round, to the smallest (the
flattest mix) that meets the target: an entropy (nats) not above the wanted one, or no source repeated more than
``max_repeats`` times. A source's budget is its weight times the whole budget, and is spent in blocks: each block is a
permutation of the source's rows by a hash of (seed, content), whole blocks first, and of the last one only the rows whose
running total fits. Running totals are taken over buckets of the hash, so that a source with most of the rows is cut by
many tasks; only the one bucket in which the budget ends is looked at row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkprep.session import cut

ROUNDS, POINTS = 10, 16
BUCKET_ROWS = 2_000
_WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def temperature_weights(totals: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None,
                        budget: float | None = None) -> tuple[float, float, float]:
    """The exponent, the sum of ``share ** exponent`` and the budget, from a table (source, tokens), one row per source.

    Sources without tokens take no part. Without ``budget`` it is such that the source repeated least is passed just once.
    """
    shares = totals.where("tokens > 0")
    whole = shares.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not whole["n"]:
        return 1.0, 1.0, 0.0
    share = F.col("tokens") / F.lit(float(whole["t"]))

    def look(exponents: list[float]) -> list:
        points = shares.select(share.alias("s"), F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a"))
        power = F.pow("s", "a")
        found = points.groupBy("a").agg(
            F.sum(power).alias("z"), F.sum(power * F.log("s")).alias("l"),
            F.max(F.pow("s", F.col("a") - 1)).alias("most"), F.min(F.pow("s", F.col("a") - 1)).alias("least")).collect()
        return sorted(found, key=lambda r: r["a"])

    def spend(r) -> float:
        return budget if budget is not None else whole["t"] * r["z"] / r["least"]

    def meets(r) -> bool:
        entropy = math.log(r["z"]) - r["a"] * r["l"] / r["z"]
        repeats = spend(r) * r["most"] / r["z"] / whole["t"]
        return (target_entropy is None or entropy <= target_entropy + 1e-12) and (max_repeats is None or repeats <= max_repeats * (1 + 1e-12))

    low, high = 0.0, 1.0 if target_entropy is None else 16.0
    best = look([low])[0]
    if not meets(best):
        best = look([high])[0]
        for _ in range(ROUNDS if meets(best) else 0):
            step = (high - low) / POINTS
            rows = look([low + step * i for i in range(1, POINTS)] + [high])
            best = next((r for r in rows if meets(r)), rows[-1])
            low, high = max(low, best["a"] - step), best["a"]
    return best["a"], best["z"], spend(best)


def mix_sources(docs: DataFrame, source_col: str = "source", text_col: str = "text", target_entropy: float | None = None,
                max_repeats: float | None = None, budget: float | None = None, seed: int = 0) -> DataFrame:
    """The mix: ``row`` (a struct of all columns of ``docs``), ``mix_weight``, ``mix_block`` and ``mix_order``.

    ``mix_block`` counts the passes from 0; sorting by ``mix_order`` (0 to 1) interleaves the sources at their weights. A
    row's size is its number of words. Null sources are one source; null and empty texts cost nothing and are repeated
    with their source; sources without any word are passed once. Equal rows are taken or left together. An empty table
    gives an empty mix. Columns of ``docs`` travel in one struct, so their names never clash.
    """
    place = lambda row: F.shiftrightunsigned(F.xxhash64(F.lit(seed), row), 11) / F.lit(float(2**53))
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row")[source_col].cast("string").alias("source"), place(F.col("row")).alias("u"))
    slim = cut(rows.select("source", "u", count_words(F.col("row")[text_col].cast("string")).alias("tokens")), "mix")
    totals = cut(slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "shares")
    exponent, z, spent = temperature_weights(totals, target_entropy, max_repeats, budget)
    whole = totals.agg(F.sum("tokens")).first()[0] or 0

    plan = totals.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(whole or 1)), F.lit(exponent)) / z).otherwise(0.0))
    plan = plan.withColumn("passes", F.when(F.col("tokens") > 0, F.col("weight") * spent / F.col("tokens")).otherwise(1.0))
    # A pass that lacks only a rounding error is a whole one.
    plan = plan.withColumn("full", F.floor(F.col("passes") + 1e-9))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), (F.col("passes") - F.col("full")) * F.col("tokens")))
    plan = plan.withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS))

    p = plan.where("rest > 0").select(F.col("source").alias("of"), "rest", "buckets")
    placed = slim.join(p, F.col("source").eqNullSafe(F.col("of"))).select("source", "u", "tokens", "rest", F.floor(F.col("u") * F.col("buckets")).alias("bucket"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("held"), F.first("rest").alias("rest"))
    sums = sums.withColumn("before", F.sum("held").over(Window.partitionBy("source").orderBy("bucket")) - F.col("held"))
    ends = sums.where("before <= rest and before + held > rest").select(F.col("source").alias("of"), F.col("bucket").alias("at"), "before")
    last = placed.join(ends, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).select("source", "u", "tokens", "rest", "before")
    last = last.withColumn("total", F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("u")))
    # Without a row that fits in the last bucket, the cut is at its lower edge: all rows before it have smaller hashes.
    edge = last.groupBy("source").agg(F.max(F.when(F.col("total") <= F.col("rest"), F.col("u"))).alias("fits"), F.min("u").alias("lowest"))
    edge = edge.select(F.col("source").alias("of"), F.coalesce("fits", F.col("lowest") - F.lit(2.0**-53)).alias("edge"))
    plan = cut(plan.join(edge, plan["source"].eqNullSafe(edge["of"]), "left").select("source", "weight", "passes", "full", F.coalesce("edge", F.lit(-1.0)).alias("edge")), "plan")

    q = plan.withColumnRenamed("source", "of")
    taken = rows.join(q, rows["source"].eqNullSafe(q["of"]))
    blocks = F.col("full") + (F.col("u") <= F.col("edge")).cast("int")
    taken = taken.where(blocks > 0).select("row", "weight", "passes", "u", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("mix_block"))
    order = F.xxhash64(F.lit(seed + 1), F.col("mix_block"), F.col("u"))
    return taken.select("row", F.col("weight").alias("mix_weight"), "mix_block", F.least(
        (F.col("mix_block") + F.shiftrightunsigned(order, 11) / F.lit(float(2**53))) / F.col("passes"), F.lit(1.0)).alias("mix_order"))
