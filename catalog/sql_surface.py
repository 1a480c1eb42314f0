"""SQL text over a table: one query per family."""

import sparkprep as sp
from catalog.registry import query


def _sql(name, table, spark_sql, duck_sql=None):
    def run(t):
        return sp.sql_query(getattr(t, table), spark_sql)

    run.__name__ = name
    query((duck_sql or spark_sql).replace("input_df1", table))(run)


_sql("sql_window", "events", """
select event_id, cast(rank() over (partition by user_id order by value desc) as bigint) as place,
  cast(ntile(4) over (partition by user_id order by ts, event_id) as bigint) as quarter,
  lag(value, 1) over (partition by user_id order by ts, event_id) as previous_value,
  round(avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 6) as moving
from input_df1""")

_sql("sql_set_operations", "lineitem", """
(select l_orderkey from input_df1 where l_quantity > 25 intersect select l_orderkey from input_df1 where l_returnflag = 'R')
union all (select l_orderkey from input_df1 where l_linenumber = 1 except select l_orderkey from input_df1 where l_linenumber = 2)""")

_sql("sql_set_operations_all", "orders", """
(select o_custkey from input_df1 where o_totalprice > 100000 intersect all select o_custkey from input_df1 where o_orderstatus = 'O')
union all (select o_custkey from input_df1 except all select o_custkey from input_df1 where o_orderstatus = 'F')""")

_sql("sql_cube", "lineitem", """
select l_returnflag, l_linestatus, cast(grouping(l_returnflag) as bigint) as g, count(*) as n, sum(l_quantity) as q
from input_df1 group by cube (l_returnflag, l_linestatus)""")

_sql("sql_rollup", "orders", """
select o_orderstatus, o_orderpriority, count(*) as n, max(o_totalprice) as top from input_df1 group by rollup (o_orderstatus, o_orderpriority)""")

_sql("sql_grouping_sets", "events", """
select event_type, user_id, count(*) as n from input_df1 group by grouping sets ((event_type), (user_id), ())""")

_sql("sql_cte_subquery", "orders", """
with spent as (select o_custkey, sum(o_totalprice) as total, count(*) as n from input_df1 group by o_custkey)
select o_custkey, n, round(total, 2) as total from spent where total > (select avg(total) * 1.5 from spent)""")

_sql("sql_semi_anti", "orders", """
select o_orderkey from input_df1 o where exists (select 1 from input_df1 x where x.o_custkey = o.o_custkey and x.o_orderdate > o.o_orderdate
  and x.o_orderstatus = 'P') and not exists (select 1 from input_df1 y where y.o_custkey = o.o_custkey and y.o_totalprice > 490000)""")

_sql("sql_quoted_names", "customer", """
select c_custkey, 'input_df1' as named, concat('it''s ', 'input_df1') as b from input_df1""", """
select c_custkey, 'input' || '_df1' as named, concat('it''s ', 'input' || '_df1') as b from input_df1""")

_sql("sql_strings", "customer", """
select c_custkey, upper(substr(c_name, 1, 4)) as a, replace(c_name, '#', '-') as b, lpad(cast(c_nationkey as varchar(10)), 4, '0') as d,
  length(c_mktsegment) as n, instr(c_name, '#') as at, concat(lower(c_mktsegment), '/', c_nationkey) as e from input_df1""", """
select c_custkey, upper(substr(c_name, 1, 4)) as a, replace(c_name, '#', '-') as b, lpad(cast(c_nationkey as varchar), 4, '0') as d,
  cast(length(c_mktsegment) as integer) as n, cast(instr(c_name, '#') as integer) as at, concat(lower(c_mktsegment), '/', c_nationkey) as e from input_df1""")

_sql("sql_dates", "orders", """
select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, weekofyear(o_orderdate) as w, cast(date_trunc('month', o_orderdate) as date) as m,
  cast(last_day(o_orderdate) as date) as l, datediff(date'2002-01-01', cast(o_orderdate as date)) as d from input_df1""", """
select o_orderkey, cast(year(o_orderdate) as integer) as y, cast(quarter(o_orderdate) as integer) as q, cast(weekofyear(o_orderdate) as integer) as w,
  cast(date_trunc('month', o_orderdate) as date) as m, last_day(o_orderdate) as l,
  cast(date_diff('day', cast(o_orderdate as date), date '2002-01-01') as integer) as d from input_df1""")

_sql("sql_math", "part", """
select p_partkey, round(sqrt(p_retailprice), 6) as s, round(ln(p_retailprice), 6) as l, abs(p_size - 25) as a, mod(p_partkey, 7) as m,
  cast(floor(p_retailprice / 7) as bigint) as f, greatest(p_size, 20) as g from input_df1""")

_sql("sql_arrays", "conversations", """
select conv_id, array_join(array_sort(array_distinct(collect_list(role))), ',') as roles, cast(size(collect_list(turn)) as bigint) as turns,
  aggregate(collect_list(turn), 0L, (a, x) -> a + x) as total from input_df1 group by conv_id""", """
select conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') as roles, len(list(turn)) as turns,
  cast(list_sum(list(turn)) as bigint) as total from input_df1 group by conv_id""")

_sql("sql_maps", "documents", """
select lang, source, docs from (select lang, explode(map_from_entries(collect_list(struct(source, n)))) as (source, docs)
  from (select lang, source, count(*) as n from input_df1 group by lang, source) group by lang)""", """
select lang, source, count(*) as docs from input_df1 group by lang, source""")
