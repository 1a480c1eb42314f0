"""Pieces of paths carry only what the asked aggregations need."""

import sparkprep as sp
from sparkprep.operators import hierarchy


def test_pieces_carry_what_is_asked(spark, monkeypatch):
    seen = []
    plain = hierarchy.cut
    monkeypatch.setattr(hierarchy, "cut", lambda df, label="step": seen.append(set(df.columns)) or plain(df, label))
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 4), ("b", "d", None)], "up string, kid string, w int")
    paths = sp.hierarchy_paths(edges, "up", "kid", aggregations=[("w", "mean")])
    assert sorted((r.kid, r.hierarchy_path, r.w_mean) for r in paths.collect() if r.kid != "a") == [
        ("b", "a > b", 2.0), ("c", "a > b > c", 3.0), ("d", "a > b > d", 2.0)]
    assert all({"s0", "n0"} <= columns and not {"lo0", "hi0"} & columns for columns in seen)
