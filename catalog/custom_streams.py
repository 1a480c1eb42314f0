"""The user's own code, pipelines as documents, streams, and the flagship query."""

import pandas as pd
from pyspark.sql import functions as F

import sparkprep as sp
from catalog.registry import query
from sparkprep.streaming import runs


@query("""select c_mktsegment, round(sum(o_totalprice), 2) as o_totalprice_sum, round(avg(o_totalprice), 4) as o_totalprice_mean,
          count(o_orderkey) as o_orderkey_count, count(distinct o_custkey) as o_custkey_nunique
          from orders join customer on o_custkey = c_custkey where o_totalprice > 50000 group by 1 order by 1""")
def revenue_by_segment(t):
    orders = sp.filter_rows(t.orders, "o_totalprice", ">", 50000)
    joined = sp.join_datasets(orders, t.customer, how="inner", left_on=["o_custkey"], right_on=["c_custkey"])
    totals = sp.aggregate(
        joined, ["c_mktsegment"],
        [("o_totalprice", "sum"), ("o_totalprice", "mean"), ("o_orderkey", "count"), ("o_custkey", "nunique")],
    )
    totals = totals.withColumns({"o_totalprice_sum": F.round("o_totalprice_sum", 2), "o_totalprice_mean": F.round("o_totalprice_mean", 4)})
    return sp.sort_rows(totals, ["c_mktsegment"])


@query("select event_id, upper(event_type) as kind, value * 2 as twice from events")
def pandas_batches(t):
    def double(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_id": frame.event_id, "kind": frame.event_type.str.upper(), "twice": frame.value * 2})

    return sp.pandas_transform(t.events, double, "event_id bigint, kind string, twice double")


@query("select user_id, count(*) as events, round(max(value) - min(value), 6) as spread from events group by 1")
def pandas_groups(t):
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": frame.user_id[:1], "events": len(frame), "spread": round(frame.value.max() - frame.value.min(), 6)})

    return sp.pandas_transform(t.events, one, "user_id bigint, events bigint, spread double", by=["user_id"])


@query("select o_orderkey, o_totalprice * 2 + 1 as o_totalprice from orders")
def formula_function(t):
    @F.pandas_udf("double")
    def scaled(values: pd.Series) -> pd.Series:
        return values * 2 + 1

    return sp.formula(t.orders.select("o_orderkey", "o_totalprice"), [("o_totalprice", scaled)])


@query("select o_orderkey, o_orderpriority, reverse(o_orderpriority) as answer from orders")
def enrich_distinct_inputs(t):
    return sp.enrich(
        t.orders.select("o_orderkey", "o_orderpriority"), lambda row: row["o_orderpriority"][::-1], ["o_orderpriority"], "answer"
    )


_DOCUMENT = {
    "nodes": [
        {"id": "orders", "type": "read_file", "data": {"path": "${folder}/orders.parquet"}},
        {"id": "customers", "type": "read_file", "data": {"path": "${folder}/customer.parquet"}},
        {"id": "note", "type": "annotation", "data": {}},
        {"id": "big", "type": "switch_rows", "data": {"column": "o_totalprice", "op": ">", "value": "${limit}"}},
        {"id": "joined", "type": "join_datasets", "data": {"how": "inner", "left_on": ["o_custkey"], "right_on": ["c_custkey"]}},
        {"id": "small", "type": "filter_rows", "data": {"column": "o_orderkey", "op": "notnull"}},
        {"id": "big_count", "type": "aggregate", "data": {"by": ["c_mktsegment"], "operations": [["o_orderkey", "count"]]}},
        {"id": "small_count", "type": "aggregate", "data": {"by": ["o_orderstatus"], "operations": [["o_orderkey", "count"]]}},
        {"id": "named", "type": "rename_columns", "data": {"mapping": {"c_mktsegment": "label"}}},
        {"id": "named_small", "type": "rename_columns", "data": {"mapping": {"o_orderstatus": "label"}}},
        {"id": "all", "type": "concat_rows", "data": {}},
    ],
    "edges": [
        {"source": "orders", "target": "big"},
        {"source": "customers", "target": "joined", "targetHandle": "in2"},
        {"source": "big", "sourceHandle": "true", "target": "joined", "targetHandle": "in1"},
        {"source": "big", "sourceHandle": "false", "target": "small"},
        {"source": "joined", "target": "big_count"},
        {"source": "small", "target": "small_count"},
        {"source": "big_count", "target": "named"},
        {"source": "small_count", "target": "named_small"},
        {"source": "named", "target": "all", "targetHandle": "in1"},
        {"source": "named_small", "target": "all", "targetHandle": "in2"},
    ],
}


@query("""select c_mktsegment as label, count(*) as o_orderkey_count from orders join customer on o_custkey = c_custkey where o_totalprice > 400000
          group by 1 union all select o_orderstatus, count(*) from orders where not o_totalprice > 400000 group by 1""")
def document_of_nodes(t):
    return sp.run_pipeline(t.spark, {"pipelines": [{"flow": _DOCUMENT}]}, until="all", params={"folder": t.folder, "limit": 400000})


def _event_stream(t):
    return runs.stream_files(t.spark, t.folder, t.events.schema, glob="events.parquet")


def _prepared(events):
    """Stateless operators only; the same code runs on tables and on streams."""
    kept, _ = sp.switch_rows(events, "event_type", "!=", "error")
    split = sp.split_to_rows(sp.filter_rows(kept, "value", ">", 1.5), "props", ":", "piece")
    return sp.unpivot(split, ["event_id", "event_type", "piece"], ["user_id", "value"], "measure", "amount")


@query("""select event_id, event_type, piece, unnest(['user_id', 'value']) as measure, unnest([cast(user_id as double), value]) as amount from
          (select *, unnest(string_split(props, ':')) as piece from events where event_type <> 'error' and value > 1.5)""")
def stream_stateless(t):
    return t.spark.read.parquet(runs.run_available(_prepared(_event_stream(t))))


@query("""select window_start, window_end, event_type, n as event_id_count, v as value_max from
          (select time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, event_type,
           count(*) as n, max(value) as v from events group by 1, 2, 3)""")
def stream_windows(t):
    """All windows, those still open at the end of the input too."""
    counts = runs.aggregate_stream(
        _event_stream(t), ["event_type"], [("event_id", "count"), ("value", "max")], "ts", "1 hour", "2 hours"
    )
    return runs.run_updates(counts, ["window_start", "window_end", "event_type"])


@query("select user_id, event_type, count(distinct ts) as moments from events group by all")
def stream_deduplicate(t):
    """Each moment of a user and a kind once; one file is one batch, so no key is forgotten before its copies."""
    once = runs.deduplicate_stream(_event_stream(t).select("user_id", "event_type", "ts"), ["user_id", "event_type", "ts"], "ts", "1 hour")
    rows = t.spark.read.parquet(runs.run_available(once))
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("moments"))
