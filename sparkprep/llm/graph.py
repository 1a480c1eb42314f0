"""Connected components of a table of links, by stars that grow and shrink in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.session import cut


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long): the component is its smallest node.

    Each round links every node's greater neighbours to the least one, then every node's smaller neighbours to the least of
    these, until nothing changes; the number of links never grows. Rounds are cut in the shared folder. A hub's links are
    aggregated on the map side, and the joins back are inner joins that adaptive execution splits. Nulls are left out.
    """
    e = links.where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Here every u is greater than its v.
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(own, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(own.select("u", F.col("m").alias("v"))).distinct(), label)
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
