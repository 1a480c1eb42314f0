"""Joins and comparisons."""

from pyspark.sql import functions as F

import sparkprep as sp
from catalog.registry import query


@query("""select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_custkey, c_name, c_nationkey,
          c_acctbal, c_mktsegment from orders join customer on o_custkey = c_custkey""")
def join_inner(t):
    return sp.join_datasets(t.orders, t.customer, left_on=["o_custkey"], right_on=["c_custkey"], how="inner")


@query("""select n.n_nationkey, n.n_name, s.s_suppkey, s.s_name from nation n left join
          (select * from supplier where s_acctbal > 5000) s on n.n_nationkey = s.s_nationkey""")
def join_left(t):
    rich = sp.filter_rows(t.supplier, "s_acctbal", ">", 5000)
    joined = sp.join_datasets(t.nation, rich, left_on=["n_nationkey"], right_on=["s_nationkey"], split_hot_keys=True)
    return joined.select("n_nationkey", "n_name", "s_suppkey", "s_name")


@query("""select o.o_orderkey, c.c_custkey, c.c_name from (select * from orders where o_totalprice > 450000) o
          right join customer c on o.o_custkey = c.c_custkey""")
def join_right(t):
    big = sp.filter_rows(t.orders, "o_totalprice", ">", 450000)
    joined = sp.join_datasets(big, t.customer, left_on=["o_custkey"], right_on=["c_custkey"], how="right")
    return joined.select("o_orderkey", "c_custkey", "c_name")


_KEYED = """(select nullif(user_id, 7) as user_id, count(*) as n from events where event_type = '{}' group by 1)"""


def _per_user(t, kind):
    user = F.nullif("user_id", F.lit(7)).alias("user_id")
    return sp.filter_rows(t.events, "event_type", "==", kind).groupBy(user).agg(F.count(F.lit(1)).alias("n"))


@query(f"""select a.user_id, a.n, b.user_id as user_id_right, b.n as n_right from {_KEYED.format('click')} a
           full outer join {_KEYED.format('error')} b on a.user_id = b.user_id""")
def join_outer(t):
    return sp.join_datasets(_per_user(t, "click"), _per_user(t, "error"), on=["user_id"], how="outer")


@query(f"""select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.n, b.n) as n from {_KEYED.format('click')} a
           full outer join {_KEYED.format('error')} b on a.user_id is not distinct from b.user_id""")
def join_outer_null_keys_coalesce(t):
    return sp.join_datasets(
        _per_user(t, "click"), _per_user(t, "error"), on=["user_id"], how="outer", same_name="coalesce", null_keys="match"
    )


@query("""select a.l_orderkey as l_orderkey_left, a.n as n_left, b.l_orderkey as l_orderkey_right, b.n as n_right from
          (select l_orderkey, count(*) as n from lineitem group by 1) a join
          (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) b on a.l_orderkey = b.l_orderkey""")
def join_suffix_both(t):
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    returned = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return sp.join_datasets(counts, returned, on=["l_orderkey"], how="inner", same_name="suffix_both")


@query("select n_nationkey, n_name, n_regionkey, r_regionkey, r_name from nation cross join region")
def join_cross(t):
    return sp.join_datasets(t.nation, t.region, how="cross")


@query("select * from customer c where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def join_anti_left(t):
    big = sp.filter_rows(t.orders, "o_totalprice", ">", 300000)
    return sp.join_datasets(t.customer, big, left_on=["c_custkey"], right_on=["o_custkey"], how="anti-left")


@query("select * from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 50)")
def join_anti_right(t):
    parts = t.part.withColumn("many", F.lit(50))
    conditions = [("l_partkey", "=", "p_partkey"), ("l_quantity", ">=", "many")]
    return sp.join_datasets(t.lineitem, parts, conditions=conditions, how="anti-right").drop("many")


@query("""select c_custkey, s_suppkey, c_acctbal, s_acctbal from customer join supplier
          on c_nationkey = s_nationkey and c_acctbal > s_acctbal""")
def join_theta_inner(t):
    joined = sp.join_datasets(
        t.customer, t.supplier, how="inner",
        conditions=[("c_nationkey", "=", "s_nationkey"), ("c_acctbal", ">", "s_acctbal")],
    )
    return joined.select("c_custkey", "s_suppkey", "c_acctbal", "s_acctbal")


@query("""select c_custkey, s_suppkey from customer full outer join supplier on c_nationkey = s_nationkey and c_acctbal * 12 <= s_acctbal""")
def join_theta_outer(t):
    customers = t.customer.select("c_custkey", "c_nationkey", (F.col("c_acctbal") * 12).alias("scaled"))
    joined = sp.join_datasets(
        customers, t.supplier, how="outer", conditions=[("c_nationkey", "=", "s_nationkey"), ("scaled", "<=", "s_acctbal")]
    )
    return joined.select("c_custkey", "s_suppkey")


@query("""select c_custkey, c_acctbal from customer c where not exists
          (select 1 from supplier s where s.s_nationkey = c.c_nationkey and c.c_acctbal < s.s_acctbal)""")
def join_theta_anti_left(t):
    kept = sp.join_datasets(
        t.customer, t.supplier, how="anti-left",
        conditions=[("c_nationkey", "=", "s_nationkey"), ("c_acctbal", "<", "s_acctbal")],
    )
    return kept.select("c_custkey", "c_acctbal")


@query("select * from supplier s where not exists (select 1 from customer c where c.c_acctbal >= s.s_acctbal * 1.05)")
def join_theta_anti_right_range_only(t):
    scaled = t.supplier.withColumn("limit", F.col("s_acctbal") * 1.05)
    return sp.join_datasets(
        t.customer, scaled, how="anti-right", conditions=[("c_acctbal", ">=", "limit")]
    ).drop("limit")


_RANGE_ONLY = "customer {} supplier on c_acctbal > s_acctbal and c_custkey < s_suppkey"


@query(" union all ".join(
    [f"select '{how}' as how, c_custkey, s_suppkey from {_RANGE_ONLY.format(word)}"
     for how, word in (("inner", "join"), ("left", "left join"), ("right", "right join"), ("outer", "full join"))]
    + [f"select 'anti-left', c_custkey, null from {_RANGE_ONLY.format('anti join')}",
       "select 'anti-right', null, s_suppkey from supplier anti join customer on c_acctbal > s_acctbal and c_custkey < s_suppkey"]))
def join_range_only(t):
    customers, suppliers = t.customer.select("c_custkey", "c_acctbal"), t.supplier.select("s_suppkey", "s_acctbal")
    conditions = [("c_acctbal", ">", "s_acctbal"), ("c_custkey", "<", "s_suppkey")]
    kinds = [sp.join_datasets(customers, suppliers, how=how, conditions=conditions).withColumn("how", F.lit(how))
             for how in ("inner", "left", "right", "outer", "anti-left", "anti-right")]
    return sp.concat_rows(*kinds).select("how", "c_custkey", "s_suppkey")


_BANDS = "(select c_custkey, c_acctbal * 40 as low, c_acctbal * 40 + 200 as high from customer)"


def _bands(t):
    low = F.col("c_acctbal") * 40
    return t.customer.select("c_custkey", low.alias("low"), (low + 200).alias("high"))


_IN_BAND = [("o_totalprice", ">=", "low"), ("o_totalprice", "<=", "high")]


@query(f"""select o_orderkey, o_totalprice, c_custkey, low, high from orders join {_BANDS} b
           on o_totalprice >= low and o_totalprice <= high""")
def join_interval_inner(t):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    return sp.join_datasets(orders, _bands(t), how="inner", conditions=_IN_BAND, bin_width=500)


@query(f"""select o_orderkey, o_totalprice, c_custkey, low, high from orders full outer join {_BANDS} b
           on o_totalprice >= low and o_totalprice <= high""")
def join_interval_outer(t):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    return sp.join_datasets(orders, _bands(t), how="outer", conditions=_IN_BAND, bin_width=500)


@query(f"""select * from {_BANDS} b where not exists (select 1 from orders where o_totalprice >= low and o_totalprice <= high)""")
def join_interval_anti_right(t):
    return sp.join_datasets(t.orders, _bands(t), how="anti-right", conditions=_IN_BAND, bin_width=500)


_CHANGED = """(select o_orderkey, o_custkey, case when o_orderkey % 50 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice,
  case when o_orderkey % 70 = 0 then null else o_orderstatus end as o_orderstatus from orders where o_orderkey % 97 <> 0)"""
_PLAIN = "(select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders)"


def _two_versions(t):
    key = F.col("o_orderkey")
    left = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    right = left.where(key % 97 != 0).withColumns(
        {
            "o_totalprice": F.when(key % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
            "o_orderstatus": F.when(key % 70 != 0, F.col("o_orderstatus")),
        }
    )
    return left, right


_COUNTED = """select {cols}, sum(side) as l, sum(1 - side) as r from
  (select *, 1 as side from {left} union all by name select *, 0 as side from {right}) group by all"""
_DATA = """select {cols}, origin_data, cast(n as bigint) as row_count,
  case when l = 0 or r = 0 then 'row_differs' else 'count_differs' end as difference_type, cast(abs(l - r) as bigint) as total_count_diff
  from (select *, unnest(['left', 'right']) as origin_data, unnest([l, r]) as n from ({counted}) where l <> r) where n > 0"""


def _data_sql(cols, left, right):
    return _DATA.format(cols=cols, counted=_COUNTED.format(cols=cols, left=left, right=right))


@query(_data_sql("o_orderkey, o_custkey, o_totalprice, o_orderstatus", _PLAIN, _CHANGED))
def compare_data(t):
    return sp.compare(*_two_versions(t))


_DAYS = "(select o_custkey, o_orderpriority from orders)"
_MORE_DAYS = "(select o_custkey, o_orderpriority from orders union all select o_custkey, o_orderpriority from orders where o_orderkey % 9 = 0)"


@query(_data_sql("o_custkey, o_orderpriority", _DAYS, _MORE_DAYS))
def compare_data_counts(t):
    left = t.orders.select("o_custkey", "o_orderpriority")
    return sp.compare(left, left.unionByName(t.orders.where("o_orderkey % 9 = 0").select("o_custkey", "o_orderpriority")))


@query(f"select count(*) as diff_count from ({_data_sql('o_orderkey, o_custkey, o_totalprice, o_orderstatus', _PLAIN, _CHANGED)})")
def compare_count_data(t):
    return sp.compare(*_two_versions(t), mode="count_data")


_FIELDS = f"""select o_orderkey, field as "Field", value as "Value", origin as "Origin" from (
  select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, unnest(['o_custkey', 'o_custkey', 'o_orderstatus', 'o_orderstatus']) as field,
    unnest(['left', 'right', 'left', 'right']) as origin,
    unnest([case when a.o_custkey is distinct from b.o_custkey then cast(a.o_custkey as varchar) end,
            case when a.o_custkey is distinct from b.o_custkey then cast(b.o_custkey as varchar) end,
            case when a.o_orderstatus is distinct from b.o_orderstatus then a.o_orderstatus end,
            case when a.o_orderstatus is distinct from b.o_orderstatus then b.o_orderstatus end]) as value
  from {_PLAIN} a full outer join {_CHANGED} b on a.o_orderkey = b.o_orderkey) where value is not null"""


@query(_FIELDS)
def compare_field_data(t):
    return sp.compare(*_two_versions(t), mode="field_data", keys=["o_orderkey"], ignore=["o_totalprice"])


@query(f"""select "Field", count(distinct o_orderkey) as "CountDistinctKeys" from ({_FIELDS}) group by 1""")
def compare_differing_fields(t):
    return sp.compare(*_two_versions(t), mode="differing_fields", keys=["o_orderkey"], ignore=["o_totalprice"])


@query("""select v.* replace (row_count::bigint as row_count, total_count_diff::bigint as total_count_diff), c.filled from
    (values ('o_custkey', 'bigint', 1, 'left', 1, 'row_differs', 1), ('o_custkey', 'string', 1, 'right', 1, 'row_differs', 1),
     ('o_orderstatus', 'string', 3, 'left', 1, 'row_differs', 1))
      as v("column", type, "index", origin_data, row_count, difference_type, total_count_diff)
  join (select unnest(['o_custkey', 'o_orderstatus']) as col, unnest([count(o_custkey), count(o_orderstatus)]) as filled from orders) c
    on v."column" = c.col""")
def compare_metadata(t):
    """Columns and types that differ, with the number of values at stake."""
    left = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    right = left.drop("o_orderstatus").withColumn("o_custkey", F.col("o_custkey").cast("string"))
    differences = sp.compare(left, right, mode="metadata")
    filled = sp.summary(left).selectExpr("field_name", "`count` as filled")
    return sp.join_datasets(differences, filled, how="inner", left_on=["column"], right_on=["field_name"]).drop("field_name")


_METRICS = """select unnest(['o_orderkey', 'o_orderkey', 'o_orderkey', 'o_orderkey', 'o_orderkey', 'o_orderstatus', 'o_orderstatus', 'o_orderstatus']) as "column",
  unnest(['0', '0', '0', '0', '0', '1', '1', '1']) as "index",
  unnest(['type', 'count', 'count_distinct', 'min', 'max', 'type', 'count', 'count_distinct']) as key,
  unnest(['bigint', cast(count(o_orderkey) as varchar), cast(count(distinct o_orderkey) as varchar), cast(min(o_orderkey) as varchar),
    cast(max(o_orderkey) as varchar), 'string', cast(count(o_orderstatus) as varchar), cast(count(distinct o_orderstatus) as varchar)]) as value
  from {} """


@query(_data_sql('"column", "index", key, value', f"({_METRICS.format(_PLAIN)})", f"({_METRICS.format(_CHANGED)})"))
def compare_metadata_metrics(t):
    return sp.compare(*_two_versions(t), mode="metadata+metrics", ignore=["o_custkey", "o_totalprice"])


@query(_data_sql(
    "user_id, value, ts",
    "(select user_id, round_even(value, 0) as value, date_trunc('hour', ts + interval 30 minute) as ts from events)",
    "(select user_id, round_even(value + 0.3, 0) as value, date_trunc('hour', ts + interval 40 minute) as ts from events)",
))
def compare_rounded(t):
    left = t.events.select("user_id", "value", "ts")
    right = left.select("user_id", (F.col("value") + 0.3).alias("value"), F.expr("ts + interval 10 minutes").alias("ts"))
    return sp.compare(left, right, round_float=0, round_time="h")


@query(f"""select o_orderkey, c_custkey from orders left join {_BANDS} b on o_totalprice > low and o_totalprice < high""")
def join_interval_auto(t):
    """The width of the bins follows from the lengths of the intervals."""
    orders = t.orders.select("o_orderkey", "o_totalprice")
    inside = [("o_totalprice", ">", "low"), ("o_totalprice", "<", "high")]
    return sp.join_datasets(orders, _bands(t), how="left", conditions=inside).select("o_orderkey", "c_custkey")


@query("""select 'one side unique' as side, count(*) as rows from orders join customer on o_custkey = c_custkey
          union all select 'neither unique', null""")
def join_many_to_many_guard(t):
    """The check lets a join through whose one side is unique, and refuses one that would multiply rows."""
    joined = sp.join_datasets(t.orders, t.customer, how="inner", left_on=["o_custkey"], right_on=["c_custkey"], if_many_to_many="raise")
    try:
        sp.join_datasets(t.orders, t.events, how="inner", left_on=["o_custkey"], right_on=["user_id"], if_many_to_many="raise")
        refused = t.spark.range(0)
    except ValueError:
        refused = t.spark.range(1)
    lone = refused.select(F.lit("neither unique").alias("side"), F.lit(None).cast("long").alias("rows"))
    return joined.select(F.lit("one side unique").alias("side")).groupBy("side").agg(F.count(F.lit(1)).alias("rows")).unionByName(lone)
