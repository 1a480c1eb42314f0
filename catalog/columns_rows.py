"""Column shaping, filters, sorts, samples, stacking."""

from pyspark.sql import functions as F

import sparkprep as sp
from catalog.registry import query


def _with_null_status(t):
    """orders with nulls in o_orderstatus; the given tables hold none."""
    return t.orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F")))


_NULL_STATUS = "(select * replace (nullif(o_orderstatus, 'F') as o_orderstatus) from orders)"


@query("select l_shipdate, l_orderkey, l_quantity from lineitem")
def select_columns(t):
    return sp.select_columns(t.lineitem, ["l_shipdate", "l_orderkey", "l_quantity"])


@query("select c_custkey as customer_id, c_name as name, c_nationkey, c_acctbal, c_mktsegment as segment from customer")
def rename_manual(t):
    return sp.rename(t.customer, "manual", mapping={"c_custkey": "customer_id", "c_name": "name", "c_mktsegment": "segment"})


@query("""select p_partkey as "colPartkey_x", p_name as "colName_x", p_brand as "colBrand_x", p_type, p_size, p_retailprice
          from part""")
def rename_dynamic(t):
    chosen = ["p_partkey", "p_name", "p_brand"]
    return sp.rename_dynamic(t.part, chosen, case="camel_upper", strip_prefix="P", add_prefix="col", add_suffix="_x")


@query("""select p_retailprice, p_size, p_type, p_name, p_brand, p_partkey from part""")
def position_columns(t):
    return sp.position_columns(t.part, ["by_name_natural", "reverse_position", "by_type_family"])


@query("select * from orders where o_totalprice >= 250000")
def filter_number(t):
    return sp.filter_rows(t.orders, "o_totalprice", ">=", 250000)


@query(f"select * from {_NULL_STATUS} where o_orderstatus <> 'O'")
def filter_not_equal_drops_nulls(t):
    return sp.filter_rows(_with_null_status(t), "o_orderstatus", "!=", "O")


@query("select * from part where regexp_matches(p_name, '^(red|blue) .*t$')")
def filter_contains_regex(t):
    return sp.filter_rows(t.part, "p_name", "contains", "^(red|blue) .*t$")


@query(f"select * from {_NULL_STATUS} where not coalesce(regexp_matches(o_orderstatus, 'O'), false)")
def filter_not_contains_keeps_nulls(t):
    return sp.filter_rows(_with_null_status(t), "o_orderstatus", "not contains", "O")


@query("select * from orders where starts_with(o_orderpriority, '1-')")
def filter_startswith(t):
    return sp.filter_rows(t.orders, "o_orderpriority", "startswith", "1-")


@query("select * from part where ends_with(p_name, 'widget')")
def filter_endswith(t):
    return sp.filter_rows(t.part, "p_name", "endswith", "widget")


@query(f"select * from {_NULL_STATUS} where o_orderstatus is not null")
def filter_notnull(t):
    return sp.filter_rows(_with_null_status(t), "o_orderstatus", "notnull")


@query(f"select * from {_NULL_STATUS} where o_orderstatus is null")
def filter_isnull(t):
    return sp.filter_rows(_with_null_status(t), "o_orderstatus", "isnull")


_BLANKED = "(select event_id, case event_type when 'error' then '' when 'view' then null else event_type end as kind from events)"


def _blanked(t):
    kind = F.when(F.col("event_type") == "error", "").when(F.col("event_type") != "view", F.col("event_type"))
    return t.events.select("event_id", kind.alias("kind"))


@query(f"select * from {_BLANKED} where kind <> ''")
def filter_notempty(t):
    return sp.filter_rows(_blanked(t), "kind", "notempty")


@query(f"select * from {_BLANKED} where kind = ''")
def filter_isempty(t):
    return sp.filter_rows(_blanked(t), "kind", "isempty")


@query("select * from events where cast(user_id as varchar) = '7'")
def filter_as_text(t):
    return sp.filter_rows(t.events, "user_id", "==", "7", as_text=True)


@query("select * from lineitem where l_discount between 0.05 and 0.07 and l_quantity < 24 and l_shipdate >= timestamp '1997-01-01'")
def filter_expression(t):
    return sp.filter_rows(
        t.lineitem, expr="l_discount between 0.05D and 0.07D and l_quantity < 24 and l_shipdate >= timestamp_ntz'1997-01-01'"
    )


@query(f"select * from {_NULL_STATUS} where o_orderstatus = 'O'")
def switch_true(t):
    return sp.switch_rows(_with_null_status(t), "o_orderstatus", "==", "O")[0]


@query(f"select * from {_NULL_STATUS} where o_orderstatus is null or o_orderstatus <> 'O'")
def switch_false_keeps_nulls(t):
    return sp.switch_rows(_with_null_status(t), "o_orderstatus", "==", "O")[1]


@query("""select cast(row_number() over (order by ts, event_id) + 99 as bigint) as row_no, event_id, ts, user_id, event_type,
          value, props from events""")
def row_id(t):
    return sp.row_id(t.events, ["ts", "event_id"], name="row_no", start=100, position="first")


@query("select *, concat(p_brand, ' | ', p_type, ' | ', cast(p_size as varchar)) as label from part")
def concat_columns(t):
    return sp.concat_columns(t.part, ["p_brand", "p_type", "p_size"], "label", separator=[" |", " "])


@query(f"""select o_orderkey, concat(coalesce(o_orderstatus, ''), chr(45), chr(62), o_orderpriority) as tag
           from {_NULL_STATUS}""")
def concat_columns_ascii_null(t):
    joined = sp.concat_columns(_with_null_status(t), ["o_orderstatus", "o_orderpriority"], "tag", ascii_codes=[45, 62])
    return joined.select("o_orderkey", "tag")


_MIXED_TEXT = "(select o_orderkey, case when o_orderkey % 5 = 0 then 'x' || o_orderkey else cast(o_orderkey as varchar) end as code from orders)"


def _mixed_text(t):
    key = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", F.when(key % 5 == 0, F.concat(F.lit("x"), key)).otherwise(key.cast("string")).alias("code")
    )


@query(f"select o_orderkey, code, try_cast(code as bigint) as int_code from {_MIXED_TEXT}")
def convert_coerce(t):
    return sp.convert_types(_mixed_text(t), ["code"], "int64", on_fail="coerce", keep_original=True, prefix="int_")


@query(f"select o_orderkey, code from {_MIXED_TEXT}")
def convert_keep(t):
    return sp.convert_types(_mixed_text(t), ["code"], "int64", on_fail="keep")


@query("select l_orderkey, l_linenumber, cast(l_quantity as integer) as l_quantity, cast(l_shipdate as date) as l_shipdate from lineitem")
def convert_raise(t):
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return sp.convert_types(sp.convert_types(items, ["l_quantity"], "int32", "raise"), ["l_shipdate"], "date", "raise")


@query("""select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as revenue,
          l_quantity * 2 as l_quantity, l_tax * 2 as l_tax from lineitem""")
def formula(t):
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice", "l_discount")
    made = sp.formula(
        items, [("revenue", "round(l_extendedprice * (1 - l_discount), 4)"), (["l_quantity", "l_tax"], "$value * 2")]
    )
    return made.select("l_orderkey", "l_linenumber", "revenue", "l_quantity", "l_tax")


@query("select o_orderkey, o_totalprice, o_orderdate from orders order by o_totalprice desc, o_orderkey limit 100")
def sort_top(t):
    return sp.sort_rows(t.orders.select("o_orderkey", "o_totalprice", "o_orderdate"), [("o_totalprice", "desc"), "o_orderkey"], 100)


@query(f"select o_orderstatus, o_orderkey from {_NULL_STATUS} order by o_orderstatus desc nulls last, o_orderkey")
def sort_nulls_last(t):
    return sp.sort_rows(_with_null_status(t).select("o_orderstatus", "o_orderkey"), [("o_orderstatus", "desc"), "o_orderkey"])


@query("""select * exclude (rn) from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn
          from orders) where rn = 1""")
def deduplicate_first(t):
    return sp.deduplicate(t.orders, ["o_custkey"], "first", ["o_orderdate", "o_orderkey"])


@query("""select * exclude (rn) from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc)
          as rn from events) where rn = 1""")
def deduplicate_last(t):
    return sp.deduplicate(t.events, ["user_id", "event_type"], "last", ["ts", "event_id"])


@query("""select * exclude (n) from (select *, count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem)
          where n = 1""")
def deduplicate_none(t):
    return sp.deduplicate(t.lineitem, ["l_orderkey", "l_linenumber"], "none")


@query("select distinct o_custkey, o_orderpriority from orders")
def deduplicate_rows(t):
    return sp.deduplicate(t.orders.select("o_custkey", "o_orderpriority"))


@query("select * from events order by ts, event_id limit 500")
def sample_first(t):
    return sp.sample_rows(t.events, n=500, mode="first", order_by=["ts", "event_id"])


@query("""select * exclude (rn, n) from (select *, row_number() over (order by ts desc, event_id desc) as rn,
          count(*) over () as n from events) where rn <= cast(floor(n * 0.25) as bigint)""")
def sample_last_percent(t):
    return sp.sample_rows(t.events, percent=25, mode="last", order_by=["ts", "event_id"])


@query("""select * exclude (rn) from (select *, row_number() over (partition by c_nationkey, c_mktsegment order by c_acctbal desc,
          c_custkey) as rn from customer) where rn <= 3""")
def sample_first_by_group(t):
    return sp.sample_rows(
        t.customer, n=3, mode="first", by=["c_nationkey", "c_mktsegment"], order_by=[("c_acctbal", "desc"), "c_custkey"]
    )


@query("""select * exclude (rn, n) from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn,
          count(*) over (partition by event_type) as n from events) where rn <= cast(floor(n * 0.1) as bigint)""")
def sample_last_percent_by_group(t):
    return sp.sample_rows(t.events, percent=10, mode="last", by=["event_type"], order_by=["ts", "event_id"])


def _tied(n):
    return f"""select event_type, count(*) as rows from (select *, row_number() over (order by event_type) as rn from events)
               where rn <= {n} group by 1"""


def _tied_rows(t, n):
    """Which of the tied rows are taken follows from the rows alone: other partitions give the same."""
    first = sp.sample_rows(t.events, n=n, mode="first", order_by=["event_type"])
    again = sp.sample_rows(t.events.repartition(5, "value"), n=n, mode="first", order_by=["event_type"])
    both = first.join(again.select("event_id"), "event_id")
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query(_tied(500))
def sample_first_tied_few(t):
    return _tied_rows(t, 500)


@query(_tied(1500))
def sample_first_tied_many(t):
    return _tied_rows(t, 1500)


@query("select cast(count(*) * 0.2 as bigint) as rows, true as all_from_table from lineitem")
def sample_random_percent(t):
    """Which rows a seed gives differs between engines, so the number is checked, and that they are rows of the table."""
    sampled = sp.sample_rows(t.lineitem, percent=20)
    known = t.lineitem.groupBy(*t.lineitem.columns).agg(F.count(F.lit(1)).alias("have"))
    taken = sampled.groupBy(*sampled.columns).agg(F.count(F.lit(1)).alias("took"))
    both = taken.join(known, sampled.columns, "left")
    return both.agg(F.sum("took").alias("rows"), F.min(F.col("took") <= F.coalesce("have", F.lit(0))).alias("all_from_table"))


@query("""select event_type, least(count(*), 40) as rows from events group by event_type""")
def sample_random_by_group(t):
    sampled = sp.sample_rows(t.events, n=40, by=["event_type"])
    return sampled.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("""select c_custkey as key, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer
          union all select s_suppkey, s_name, s_acctbal, null from supplier""")
def concat_rows(t):
    customers = t.customer.selectExpr("c_custkey as key", "c_name as name", "c_acctbal as balance", "c_mktsegment as segment")
    return sp.concat_rows(customers, t.supplier.selectExpr("s_suppkey as key", "s_name as name", "s_acctbal as balance"))


@query("""select s_suppkey, s_name, c_custkey, c_name from
          (select s_suppkey, s_name, row_number() over (order by s_acctbal, s_suppkey) as rn from supplier) full outer join
          (select c_custkey, c_name, row_number() over (order by c_acctbal, c_custkey) as rn from customer) using (rn)""")
def concat_side_by_side(t):
    both = sp.concat_side_by_side(t.supplier, t.customer, order_by=[["s_acctbal", "s_suppkey"], ["c_acctbal", "c_custkey"]])
    return both.select("s_suppkey", "s_name", "c_custkey", "c_name")
