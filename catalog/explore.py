"""Aggregation, reshaping, profiling, hierarchies."""

from pyspark.sql import functions as F

import sparkprep as sp
from catalog.registry import query


@query("""select l_returnflag, l_linestatus, min(l_quantity) as l_quantity_min, max(l_extendedprice) as l_extendedprice_max,
          round(sum(l_extendedprice), 2) as l_extendedprice_sum, round(avg(l_discount), 6) as l_discount_mean,
          count(l_orderkey) as l_orderkey_count, count(distinct l_suppkey) as l_suppkey_nunique,
          round(stddev_samp(l_quantity), 6) as l_quantity_std, round(var_samp(l_quantity), 6) as l_quantity_var
          from lineitem group by l_returnflag, l_linestatus""")
def aggregate_groups(t):
    result = sp.aggregate(
        t.lineitem, ["l_returnflag", "l_linestatus"],
        [("l_quantity", "min"), ("l_extendedprice", "max"), ("l_extendedprice", "sum"), ("l_discount", "mean"),
         ("l_orderkey", "count"), ("l_suppkey", "nunique"), ("l_quantity", "std"), ("l_quantity", "var")],
    )
    digits = {"l_extendedprice_sum": 2, "l_discount_mean": 6, "l_quantity_std": 6, "l_quantity_var": 6}
    return result.withColumns({n: F.round(n, d) for n, d in digits.items()})


@query("""select count(o_orderkey) as o_orderkey_count, min(o_orderdate) as o_orderdate_min, max(o_orderdate) as o_orderdate_max,
          count(distinct o_custkey) as o_custkey_nunique, median(o_totalprice) as o_totalprice_median from orders""")
def aggregate_table(t):
    return sp.aggregate(
        t.orders, [], [("o_orderkey", "count"), ("o_orderdate", "min"), ("o_orderdate", "max"), ("o_custkey", "nunique"),
                       ("o_totalprice", "median")],
    )


@query("""select l_returnflag, l_shipmonth, median(l_extendedprice) as l_extendedprice_median, median(l_quantity) as l_quantity_median,
          count(l_tax) as l_tax_count from (select *, month(l_shipdate) as l_shipmonth from lineitem) group by 1, 2""")
def aggregate_median(t):
    items = t.lineitem.withColumn("l_shipmonth", F.month("l_shipdate").cast("bigint"))
    return sp.aggregate(
        items, ["l_returnflag", "l_shipmonth"], [("l_extendedprice", "median"), ("l_quantity", "median"), ("l_tax", "count")]
    )


@query("""select event_type, user_id, first(value order by ts, event_id) as value_first, last(props order by ts, event_id) as props_last
          from events group by event_type, user_id""")
def aggregate_first_last(t):
    return sp.aggregate(t.events, ["event_type", "user_id"], [("value", "first"), ("props", "last")], order_by=["ts", "event_id"])


@query("""select l_orderkey, round(product(1 + l_tax), 8) as growth_prod from lineitem group by l_orderkey""")
def aggregate_product(t):
    grown = t.lineitem.select("l_orderkey", (1 + F.col("l_tax")).alias("growth"))
    return sp.aggregate(grown, ["l_orderkey"], [("growth", "prod")]).withColumn("growth_prod", F.round("growth_prod", 8))


_NULLS = "(select nullif(o_orderstatus, 'F') as status, nullif(o_orderstatus, 'P') as seen, o_totalprice as price from orders)"


def _nulls(t):
    status = F.col("o_orderstatus")
    return t.orders.select(
        F.nullif(status, F.lit("F")).alias("status"), F.nullif(status, F.lit("P")).alias("seen"), F.col("o_totalprice").alias("price")
    )


@query(f"select status, count(seen) as seen_count, round(sum(price), 2) as price_sum from {_NULLS} where status is not null group by 1")
def aggregate_drops_null_keys(t):
    result = sp.aggregate(_nulls(t), ["status"], [("seen", "count"), ("price", "sum")])
    return result.withColumn("price_sum", F.round("price_sum", 2))


@query(f"""select status, count(seen) as seen_count, coalesce(round(sum(case when seen is null then null else price end), 2), 0) as price_sum
           from {_NULLS} group by 1""")
def aggregate_keeps_null_keys(t):
    rows = _nulls(t).withColumn("price", F.when(F.col("seen").isNotNull(), F.col("price")))
    result = sp.aggregate(rows, ["status"], [("seen", "count"), ("price", "sum")], keep_null_keys=True)
    return result.withColumn("price_sum", F.round("price_sum", 2))


@query("""select c_mktsegment, r_name, round(sum(c_acctbal), 2) as "Sum of c_acctbal", count(c_custkey) as "Count of c_custkey"
          from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def chart_table(t):
    placed = sp.join_datasets(t.customer, t.nation, how="inner", left_on=["c_nationkey"], right_on=["n_nationkey"])
    placed = sp.join_datasets(placed, t.region, how="inner", left_on=["n_regionkey"], right_on=["r_regionkey"])
    chart = sp.chart_table(
        placed, "c_mktsegment", {"c_acctbal": "sum"}, color=("r_name", None), sort=("c_custkey", "count"), descending=True
    )
    return chart.withColumn("Sum of c_acctbal", F.round("Sum of c_acctbal", 2))


@query("""select o_orderpriority, coalesce(round(sum(o_totalprice) filter (o_orderstatus = 'F'), 2), 0) as "F",
          coalesce(round(sum(o_totalprice) filter (o_orderstatus = 'O'), 2), 0) as "O",
          coalesce(round(sum(o_totalprice) filter (o_orderstatus = 'P'), 2), 0) as "P" from orders group by 1""")
def pivot_sum(t):
    table = sp.pivot(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice", "sum")
    return table.withColumns({n: F.round(n, 2) for n in ("F", "O", "P")})


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("select p_brand, " + ", ".join(f"min({v}) filter (p_type = '{k}') as \"{v}_{k}\"" for k in _TYPES for v in ("p_size", "p_retailprice")) + " from part group by 1")
def pivot_min_two_values(t):
    kept = t.part
    table = sp.pivot(kept, ["p_brand"], ["p_type"], ["p_size", "p_retailprice"], "min", fill=-1, pivot_values=_TYPES)
    return table.withColumns({n: F.nullif(F.col(n), F.lit(-1).cast(table.schema[n].dataType)) for n in table.columns[1:]})


@query("""select n_regionkey, max(n_name) filter (i = 0) as "0", max(n_name) filter (i = 1) as "1", max(n_name) filter (i = 2) as "2",
          max(n_name) filter (i = 3) as "3", max(n_name) filter (i = 4) as "4" from (select *, row_number() over (partition by n_regionkey
          order by n_nationkey) - 1 as i from nation) group by 1""")
def pivot_plain(t):
    placed = sp.sample_rows(t.nation, n=1000, mode="first", by=["n_regionkey"], order_by=["n_nationkey"])
    ranks = placed.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("names"))
    cells = ranks.select("n_regionkey", F.posexplode("names").alias("i", "n")).select("n_regionkey", "i", "n.n_name")
    return sp.pivot(cells, "n_regionkey", "i", "n_name", "none", pivot_values=list(range(5)))


@query("""select l_orderkey, l_linenumber, unnest(['l_quantity', 'l_tax', 'l_discount']) as measure,
          unnest([l_quantity, l_tax, l_discount]) as amount from lineitem""")
def unpivot(t):
    return sp.unpivot(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax", "l_discount"], "measure", "amount")


@query("""select o_orderkey, unnest(['o_custkey', 'status']) as "Column", unnest([cast(o_custkey as varchar), coalesce(nullif(o_orderstatus,
          'F'), 'None')]) as "Value" from orders""")
def unpivot_text(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return sp.unpivot(rows, ["o_orderkey"], value_type="string")


@query("""select event_id, unnest(['user_id', 'event_type', 'value']) as "Column", unnest([cast(user_id as double), null, value]) as "Value"
          from events""")
def unpivot_numeric(t):
    return sp.unpivot(t.events, ["event_id"], ["user_id", "event_type", "value"], value_type="numeric")


_SUMMARY_SQL = """
select field_name, type, count, "unique", "most freq value", "max freq", "least freq value", "min", "max", mean, std, avg_length,
  min_length, max_length, shortest, longest, "25%", "50%", "75%" from (
  select 'o_orderkey' as field_name, 'bigint' as type, count(o_orderkey) as count, count(distinct o_orderkey) as "unique",
    cast(min(o_orderkey) as varchar) as "min", cast(max(o_orderkey) as varchar) as "max", round(avg(o_orderkey), 6) as mean,
    round(stddev_samp(o_orderkey), 6) as std, cast(null as double) as avg_length, cast(null as bigint) as min_length,
    cast(null as bigint) as max_length, null as shortest, null as longest, quantile_cont(cast(o_orderkey as double), 0.25) as "25%",
    quantile_cont(cast(o_orderkey as double), 0.5) as "50%", quantile_cont(cast(o_orderkey as double), 0.75) as "75%" from orders
  union all select 'o_custkey', 'bigint', count(o_custkey), count(distinct o_custkey), cast(min(o_custkey) as varchar),
    cast(max(o_custkey) as varchar), round(avg(o_custkey), 6), round(stddev_samp(o_custkey), 6), null, null, null, null, null,
    quantile_cont(cast(o_custkey as double), 0.25), quantile_cont(cast(o_custkey as double), 0.5), quantile_cont(cast(o_custkey as double), 0.75) from orders
  union all select 'o_orderpriority', 'string', count(o_orderpriority), count(distinct o_orderpriority), min(o_orderpriority),
    max(o_orderpriority), null, null, round(avg(length(o_orderpriority)), 6), min(length(o_orderpriority)), max(length(o_orderpriority)),
    (select min(o_orderpriority) from orders where length(o_orderpriority) = (select min(length(o_orderpriority)) from orders)),
    (select min(o_orderpriority) from orders where length(o_orderpriority) = (select max(length(o_orderpriority)) from orders)),
    null, null, null from orders) join (
  select field_name, arg_min(v, {'n': -n, 'v': v}) as "most freq value", max(n) as "max freq", arg_min(v, {'n': n, 'v': v}) as "least freq value"
  from (select field_name, v, count(*) as n from (
    select unnest(['o_orderkey', 'o_custkey', 'o_orderpriority']) as field_name,
      unnest([cast(o_orderkey as varchar), cast(o_custkey as varchar), o_orderpriority]) as v from orders) group by 1, 2) group by 1)
  using (field_name)"""


def _rounded_summary(df):
    return df.withColumns({n: F.round(n, 6) for n in ("mean", "std", "avg_length")})


@query(_SUMMARY_SQL)
def summary(t):
    return _rounded_summary(sp.summary(t.orders, ["o_orderkey", "o_custkey", "o_orderpriority"]))


@query("""with n as (select user_id, count(*) as c from events group by 1), e as (select event_type as v, count(*) as c from events group by 1)
  select stat, user_id, event_type from (
    select unnest(['type', 'count', 'unique', 'most freq value', 'max freq', 'least freq value', 'min', 'max', 'mean', 'std', 'avg_length',
      'min_length', 'max_length', 'shortest', 'longest', '25%', '50%', '75%']) as stat,
    unnest(['bigint', cast(count(user_id) as varchar), cast(count(distinct user_id) as varchar),
      (select arg_min(cast(user_id as varchar), {'c': -c, 'v': cast(user_id as varchar)}) from n), (select cast(max(c) as varchar) from n),
      (select arg_min(cast(user_id as varchar), {'c': c, 'v': cast(user_id as varchar)}) from n),
      cast(min(user_id) as varchar), cast(max(user_id) as varchar), 'number', 'number', null, null, null, null, null,
      cast(quantile_cont(cast(user_id as double), 0.25) as varchar), cast(quantile_cont(cast(user_id as double), 0.5) as varchar),
      cast(quantile_cont(cast(user_id as double), 0.75) as varchar)]) as user_id,
    unnest(['string', cast(count(event_type) as varchar), cast(count(distinct event_type) as varchar),
      (select arg_min(v, {'c': -c, 'v': v}) from e), (select cast(max(c) as varchar) from e), (select arg_min(v, {'c': c, 'v': v}) from e),
      min(event_type), max(event_type), null, null, 'number', cast(min(length(event_type)) as varchar), cast(max(length(event_type)) as varchar),
      (select min(v) from e where length(v) = (select min(length(v)) from e)), (select min(v) from e where length(v) = (select max(length(v)) from e)),
      null, null, null]) as event_type from events)""")
def summary_as_columns(t):
    """Long fractions print differently in different engines, so their cells only show that a number is there."""
    table = sp.summary(t.events, ["user_id", "event_type"], layout="columns")
    long = F.col("stat").isin("mean", "std", "avg_length")
    return table.withColumns({n: F.when(long & F.col(n).isNotNull(), F.lit("number")).otherwise(F.col(n)) for n in ("user_id", "event_type")})


@query("""with v as (select unnest(['event_type', 'user', 'user_id']) as field_name, unnest([event_type, nullif(event_type, 'error'),
    cast(user_id as varchar)]) as field_value from events),
  f as (select field_name, field_value, count(*) as frequency, sum(count(*)) over (partition by field_name) as total from v group by 1, 2)
  select field_name, field_value, frequency, round(frequency / total * 100, 8) as percent,
    cast(sum(frequency) over w as bigint) as cumulative_frequency, round(sum(frequency) over w / total * 100, 8) as cumulative_percent
  from f window w as (partition by field_name order by frequency desc, field_value nulls last)""")
def frequencies(t):
    rows = t.events.select("event_type", "user_id", F.nullif("event_type", F.lit("error")).alias("user"))
    result = sp.frequencies(rows)
    return result.withColumns({n: F.round(n, 8) for n in ("percent", "cumulative_percent")})


@query("""with r as (select count(*) as n, count(distinct p_partkey) as k, count(distinct p_name) as a, count(distinct p_retailprice) as p,
    count(distinct (p_partkey, p_name)) as ka, count(distinct (p_partkey, p_retailprice)) as kp, count(distinct (p_name, p_retailprice)) as ap from part)
  select number_of_fields, fields as field_combination from r, (values (1, 'p_partkey'), (1, 'p_name'), (1, 'p_retailprice'), (2, 'p_partkey+p_name'),
    (2, 'p_partkey+p_retailprice'), (2, 'p_name+p_retailprice')) as v(number_of_fields, fields)
  where n = case fields when 'p_partkey' then k when 'p_name' then a when 'p_retailprice' then p when 'p_partkey+p_name' then ka
    when 'p_partkey+p_retailprice' then kp else ap end""")
def unique_keys(t):
    found = sp.unique_keys(t.part, ["p_partkey", "p_name", "p_retailprice"], max_fields=2)
    return found.withColumn("field_combination", F.array_join("field_combination", "+"))


@query("""with r as (select count(*) as n, count(distinct (l_orderkey, l_linenumber)) as a, count(distinct (l_orderkey, l_linenumber, l_partkey)) as b,
    count(distinct (l_orderkey, l_linenumber, l_suppkey)) as c, count(distinct (l_orderkey, l_partkey, l_suppkey)) as d,
    count(distinct (l_linenumber, l_partkey, l_suppkey)) as e, count(distinct (l_orderkey, l_partkey)) as f, count(distinct (l_orderkey, l_suppkey)) as g,
    count(distinct (l_linenumber, l_partkey)) as h, count(distinct (l_linenumber, l_suppkey)) as i, count(distinct (l_partkey, l_suppkey)) as j from lineitem)
  select k as number_of_fields, fields as field_combination from r, lateral (values (2, 'l_orderkey+l_linenumber', a), (2, 'l_orderkey+l_partkey', f),
    (2, 'l_orderkey+l_suppkey', g), (2, 'l_linenumber+l_partkey', h), (2, 'l_linenumber+l_suppkey', i), (2, 'l_partkey+l_suppkey', j),
    (3, 'l_orderkey+l_linenumber+l_partkey', b), (3, 'l_orderkey+l_linenumber+l_suppkey', c), (3, 'l_orderkey+l_partkey+l_suppkey', d),
    (3, 'l_linenumber+l_partkey+l_suppkey', e)) as v(k, fields, cnt) where cnt = n""")
def unique_keys_three(t):
    found = sp.unique_keys(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], max_fields=3)
    return found.withColumn("field_combination", F.array_join("field_combination", "+"))


def _rounded_matrix(matrix):
    return matrix.withColumns({n: F.round(n, 8) for n in matrix.columns[1:]})


def _matrix_sql(table, names, pair):
    """A matrix from a scalar SQL expression per pair of columns."""
    rows = []
    for a in names:
        cells = ", ".join(f"1.0::double as {b}" if a == b else f"round({pair(a, b)}, 8) as {b}" for b in names)
        rows.append(f"select '{a}' as \"index\", {cells}")
    return " union all ".join(rows)


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_matrix_sql("lineitem", _MEASURES, lambda a, b: f"(select corr({a}, {b}) from lineitem)"))
def correlation_pearson(t):
    return _rounded_matrix(sp.correlation_matrix(t.lineitem, _MEASURES))


_MANY = {
    **{f"q{i}": f"l_quantity * l_quantity / {i + 1} + l_linenumber * {i}" for i in range(7)},
    **{f"e{i}": f"case when l_linenumber <> {i + 1} then l_extendedprice / {i + 1} - l_discount * {i} end" for i in range(5)},
    "spike": "case when l_linenumber = 1 then 1e12 else l_tax end",
    "gap": "case when l_linenumber <> 1 then l_tax * 2 + l_discount end",
}


@query(_matrix_sql(
    "lineitem", list(_MANY),
    lambda a, b: f"(select corr(cast({_MANY[a]} as double), cast({_MANY[b]} as double)) from lineitem"
    f" where {_MANY[a]} is not null and {_MANY[b]} is not null)",
))
def correlation_many_columns(t):
    """Nulls, and a spike that is null in the partner: the pair is judged by its own rows."""
    rows = t.lineitem.select(*[F.expr(f"cast({text} as double)").alias(n) for n, text in _MANY.items()])
    return _rounded_matrix(sp.correlation_matrix(rows))


def _rank(name):
    return f"(rank() over (order by {name}) + (count(*) over (partition by {name}) - 1) / 2.0)"


_NULL_MEASURES = "(select l_quantity, nullif(l_linenumber, 3) as l_linenumber, l_extendedprice from lineitem)"


@query(_matrix_sql(
    "lineitem", ["l_quantity", "l_linenumber", "l_extendedprice"],
    lambda a, b: f"(select corr(x, y) from (select {_rank(a)} as x, {_rank(b)} as y from {_NULL_MEASURES} where {a} is not null and {b} is not null))",
))
def correlation_spearman(t):
    rows = t.lineitem.select("l_quantity", F.nullif("l_linenumber", F.lit(3)).alias("l_linenumber"), "l_extendedprice")
    return _rounded_matrix(sp.correlation_matrix(rows, method="spearman"))


@query(_matrix_sql(
    "lineitem", _MEASURES, lambda a, b: f"(select corr(x, y) from (select {_rank(a)} as x, {_rank(b)} as y from lineitem))",
))
def correlation_spearman_complete(t):
    return _rounded_matrix(sp.correlation_matrix(t.lineitem, _MEASURES, method="spearman"))


def _kendall_sql(a, b):
    sign = f"sign(cast(s.{a} as double) - cast(o.{a} as double)) * sign(cast(s.{b} as double) - cast(o.{b} as double))"
    ties = "(select sum(n * (n - 1) / 2) from (select count(*) as n from part group by {}))"
    pairs = "(select count(*) * (count(*) - 1) / 2 from part)"
    return (
        f"(select sum({sign}) / 2 from part s, part o) / sqrt(({pairs} - {ties.format(a)}) * ({pairs} - {ties.format(b)}))"
    )


@query(_matrix_sql("part", ["p_size", "p_retailprice", "p_partkey"], _kendall_sql))
def correlation_kendall(t):
    return _rounded_matrix(sp.correlation_matrix(t.part, ["p_size", "p_retailprice", "p_partkey"], method="kendall"))


_EDGES = """(select r_name as parent, n_name as child, cast(n_nationkey as bigint) as weight from nation join region on n_regionkey = r_regionkey
  union all select n_name, c_name, c_custkey from customer join nation on c_nationkey = n_nationkey
  union all select n_name, s_name, s_suppkey from supplier join nation on s_nationkey = n_nationkey)"""


@query(f"""with recursive e as {_EDGES}, p as (
    select distinct parent as child, parent as hierarchy_path, parent as head_node, 1 as path_length, cast(0 as bigint) as weight_sum,
      cast(null as bigint) as weight_max, cast(0 as bigint) as weight_count from e where parent not in (select child from e)
    union all select e.child, p.hierarchy_path || ' > ' || e.child, p.head_node, p.path_length + 1, p.weight_sum + e.weight,
      greatest(p.weight_max, e.weight), p.weight_count + 1 from p join e on e.parent = p.child)
  select * from p""")
def hierarchy_paths(t):
    placed = sp.join_datasets(t.nation, t.region, how="inner", left_on=["n_regionkey"], right_on=["r_regionkey"])
    nations = placed.selectExpr("r_name as parent", "n_name as child", "cast(n_nationkey as bigint) as weight")
    customers = sp.join_datasets(t.customer, t.nation, how="inner", left_on=["c_nationkey"], right_on=["n_nationkey"])
    suppliers = sp.join_datasets(t.supplier, t.nation, how="inner", left_on=["s_nationkey"], right_on=["n_nationkey"])
    edges = sp.concat_rows(
        nations,
        customers.selectExpr("n_name as parent", "c_name as child", "c_custkey as weight"),
        suppliers.selectExpr("n_name as parent", "s_name as child", "s_suppkey as weight"),
    )
    return sp.hierarchy_paths(edges, "parent", "child", aggregations=[("weight", "sum"), ("weight", "max"), ("weight", "count")])


@query("""select k as child, (select string_agg(i, ' > ' order by i) from range(k // 1000 * 1000, k + 1) r(i)) as hierarchy_path,
          cast(k // 1000 * 1000 as varchar) as head_node, cast(k % 1000 + 1 as integer) as path_length,
          (k * (k + 1) - (k // 1000 * 1000) * (k // 1000 * 1000 + 1)) // 2 as weight_sum from (select c_custkey as k from customer) c""")
def hierarchy_chain(t):
    """Chains of a thousand customers, each the child of the one before."""
    edges = t.customer.selectExpr("case when c_custkey % 1000 > 0 then c_custkey - 1 end as parent", "c_custkey as child", "c_custkey as weight")
    return sp.hierarchy_paths(edges, "parent", "child", aggregations=[("weight", "sum")])


@query("""select v.*, c.filled, c.different from (values ('o_orderkey', 'bigint', true, 0), ('o_custkey', 'bigint', true, 1),
    ('o_orderstatus', 'string', true, 2), ('o_totalprice', 'double', true, 3), ('o_orderdate', 'timestamp_ntz', true, 4),
    ('o_orderpriority', 'string', true, 5)) as v("column", type, nullable, position) join (
  select unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) as col,
    unnest([count(o_orderkey), count(o_custkey), count(o_orderstatus), count(o_totalprice), count(o_orderdate), count(o_orderpriority)]) as filled,
    unnest([count(distinct o_orderkey), count(distinct o_custkey), count(distinct o_orderstatus), count(distinct o_totalprice),
      count(distinct o_orderdate), count(distinct o_orderpriority)]) as different from orders) c on v."column" = c.col""")
def schema_table(t):
    """The schema with how far its columns are filled."""
    filled = sp.summary(t.orders).selectExpr("field_name", "`count` as filled", "`unique` as different")
    joined = sp.join_datasets(sp.schema_table(t.orders), filled, how="inner", left_on=["column"], right_on=["field_name"])
    return joined.drop("field_name")
