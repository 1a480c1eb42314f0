"""Files, calendars, text, dates, JSON, Markdown, document corpora."""

from pyspark.sql import functions as F

import sparkprep as sp
from catalog.registry import query

_ORDERS = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate from orders"
_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query(_ORDERS)
def csv_write_read(t):
    path = t.new_path()
    sp.write_csv(_orders(t), path, separator=";", quoting="all")
    return sp.read_csv(t.spark, path, separator=";", schema=_SCHEMA)


@query("select p_partkey, p_name, p_retailprice from part")
def csv_write_read_nonnumeric_infer(t):
    path = t.new_path()
    sp.write_csv(t.part.select("p_partkey", "p_name", "p_retailprice"), path, separator="|", quoting="nonnumeric")
    read = sp.read_csv(t.spark, path, separator="infer")
    return read.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("select o_orderkey, cast(null as varchar) as nothing, case when o_orderstatus <> 'F' then o_orderstatus end as status, o_totalprice from orders")
def csv_skip_lines_round_trip(t):
    """Several files with two lines before the header; empty cells, a name with the separator, a column of nulls only."""
    path = t.new_path()
    cells = F.concat_ws(";", F.col("o_orderkey").cast("string"), F.lit(""), F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("")), F.col("o_totalprice").cast("string"))
    for half in (0, 1):
        rows = t.orders.where(F.col("o_orderkey") % 2 == half).select(F.lit(3).alias("n"), cells.alias("value"))
        top = t.spark.createDataFrame([(0, "a report; of orders"), (1, '"'), (2, 'o_orderkey;"no;thing";status;o_totalprice')], "n int, value string")
        top.unionByName(rows).coalesce(1).sortWithinPartitions("n").select("value").write.text(f"{path}/half={half}")
    read = sp.read_csv(t.spark, f"{path}/*", separator=";", skip_lines=2)
    return read.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("`no;thing`").alias("nothing"), "status", "o_totalprice")


@query(_ORDERS)
def json_write_read(t):
    path = t.new_path()
    sp.write_json(_orders(t), path)
    return sp.read_json(t.spark, path, lines=True, schema=_SCHEMA)


@query("select o_orderkey, cast(null as varchar) as nothing, case when o_orderstatus <> 'F' then o_orderstatus end as status from orders")
def json_file_round_trip(t):
    """Several files, default options, a column of nulls only: every row and column comes back."""
    path = f"{t.new_path()}.json"
    orders = t.orders.select("o_orderkey", F.lit(None).cast("string").alias("nothing"), F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    sp.write_file(orders.repartition(4), path, "json")
    return sp.read_file(t.spark, path)


@query("select doc_id, text, lang, source, n_chars from documents")
def csv_breaks_round_trip(t):
    """Texts with line breaks and quotes, read by records that are cut out of all splits."""
    path = t.new_path()
    sp.write_csv(t.documents, path, quoting="all", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return sp.read_csv(t.spark, path, multiLine=True, schema="doc_id bigint, text string, lang string, source string, n_chars bigint")


_DOCUMENT_ROWS = "select o_orderkey, o_totalprice, case when o_orderstatus <> 'F' then o_orderpriority || ' {\"' || o_orderstatus end as note from orders"


def _json_document(orient):
    """Whole JSON documents, one in each part, with brackets and quotes inside of strings."""
    def round_trip(t):
        path = t.new_path()
        note = F.when(F.col("o_orderstatus") != "F", F.concat("o_orderpriority", F.lit(' {"'), "o_orderstatus"))
        orders = t.orders.select("o_orderkey", "o_totalprice", note.alias("note"))
        sp.write_json(orders, path, orient=orient)
        read = sp.read_json(t.spark, path, orient=orient, lines=False)
        return read.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("o_totalprice"), "note")

    round_trip.__name__ = f"json_document_{orient}"
    return round_trip


for _orient in ("records", "columns", "index", "split", "table"):
    query(_DOCUMENT_ROWS)(_json_document(_orient))


@query("select c_custkey as id, n_name as nation, c_acctbal as balance from customer join nation on c_nationkey = n_nationkey")
def xml_rows_by_path(t):
    """Rows by a path from the root; elements of the same name elsewhere are not taken."""
    path = t.new_path()
    placed = sp.join_datasets(t.customer, t.nation, how="inner", left_on=["c_nationkey"], right_on=["n_nationkey"])
    rows = placed.groupBy("n_name").agg(
        F.struct(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("n_name").alias("nation"), F.col("c_acctbal").alias("balance"))).alias("row")).alias("good"),
        F.struct(F.collect_list(F.struct((-F.col("c_custkey")).alias("id"))).alias("row")).alias("bad"))
    sp.write_xml(rows.select("good", "bad"), path, row_tag="nation")
    return sp.read_xml(t.spark, path, xpath="/data/nation/good/row", schema="id bigint, nation string, balance double")


@query("select 250 as n, 11 as n_columns")
def sampled_read(t):
    """A sample of a file for a first look: so many rows, with all columns, and each of them a row of the table."""
    path = t.new_path()
    sp.write_csv(t.lineitem, path)
    sample = sp.read_file(t.spark, path, "csv", limit=250)
    keys = t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line")).distinct()
    known = sample.join(keys, (F.col("l_orderkey") == F.col("key")) & (F.col("l_linenumber") == F.col("line")), "left_semi")
    return known.agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("n_columns", F.lit(len(sample.columns)))


@query(_ORDERS)
def parquet_write_read(t):
    path = t.new_path()
    sp.write_parquet(_orders(t), path, compression="gzip")
    return sp.read_file(t.spark, path, "parquet")


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def xml_write_read(t):
    path = t.new_path()
    sp.write_xml(t.customer, path, row_tag="customer")
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return sp.read_xml(t.spark, path, xpath="/data/customer", schema=schema)


@query("""select o_orderpriority, w.weight, count(*) as orders from orders left join (values ('1-URGENT', 5), ('2-HIGH', 3), ('3-MEDIUM', 1))
          as w(priority, weight) on o_orderpriority = w.priority group by 1, 2""")
def inline_csv_lookup(t):
    weights = sp.inline(t.spark, "priority,weight\n1-URGENT,5\n2-HIGH,3\n3-MEDIUM,1\n", "csv")
    joined = sp.join_datasets(t.orders, weights, how="left", left_on=["o_orderpriority"], right_on=["priority"])
    return joined.groupBy("o_orderpriority", "weight").agg(F.count(F.lit(1)).alias("orders"))


@query("""select c_mktsegment, l.label, l.rank from customer left join (values ('BUILDING', 'b', 1), ('MACHINERY', 'm', null)) as l(segment, label, rank)
          on c_mktsegment = l.segment""")
def inline_json_lookup(t):
    labels = sp.inline(t.spark, '[{"segment": "BUILDING", "label": "b", "rank": 1}, {"segment": "MACHINERY", "label": "m"}]', "json")
    labels = labels.withColumn("rank", F.col("rank").cast("int"))
    joined = sp.join_datasets(t.customer, labels, left_on=["c_mktsegment"], right_on=["segment"])
    return joined.select("c_mktsegment", "label", "rank")


_CALENDAR = """cast(d as date) as calendar_date, cast(year(d) as integer) as "year", cast(month(d) as integer) as month_number,
  monthname(d) as month_name, cast(isodow(d) as integer) as weekday_number, dayname(d) as weekday_name, cast(weekofyear(d) as integer) as week,
  isodow(d) >= 6 as is_weekend"""


@query(f"""select c.*, coalesce(n, 0) as orders from (select {_CALENDAR} from range(timestamp '1999-12-25', timestamp '2000-03-02', interval 1 day) r(d)) c
           full join (select cast(o_orderdate as date) as od, count(*) as n from orders group by 1) o on calendar_date = od""")
def calendar_with_orders(t):
    calendar = sp.generate_calendar(t.spark, "2000-01-01", "2000-02-01", back=(1, "weeks"), ahead=(1, "months"))
    per_day = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("od")).agg(F.count(F.lit(1)).alias("n"))
    joined = sp.join_datasets(calendar, per_day, how="outer", left_on=["calendar_date"], right_on=["od"])
    return joined.withColumn("orders", F.coalesce("n", F.lit(0))).drop("od", "n")


@query(f"""select {_CALENDAR} from (select unnest(range(min(o_orderdate) - interval 1 month, max(o_orderdate) + interval 1 day + interval 3 day,
           interval 1 day)) as d from orders)""")
def calendar_of_orders(t):
    return sp.dynamic_calendar(t.orders, "o_orderdate", "o_orderdate", back=(1, "months"), ahead=(3, "days"))


@query("""select distinct cast(year(d) as integer) as "year", cast(month(d) as integer) as month_number from
          (select unnest(range(min(l_shipdate), max(l_shipdate) + interval 1 day, interval 1 day)) as d from lineitem)""")
def calendar_months(t):
    return sp.dynamic_calendar(t.lineitem, "l_shipdate", "l_shipdate", fields=["year", "month_number"])


@query("""select p_partkey, split_part(p_name, ' ', 1) as p_name_0, split_part(p_name, ' ', 2) as p_name_1 from part""")
def split_to_columns(t):
    return sp.split_to_columns(t.part.select("p_partkey", "p_name"), "p_name", " ")


@query("""select o_orderkey, o_orderpriority, split_part(o_orderpriority, '-', 1) as o_orderpriority_0 from orders""")
def split_to_columns_first(t):
    return sp.split_to_columns(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-", n=1, keep_original=True)


@query("""select page_id, unnest(string_split_regex(url, '[/.]+')) as piece from pages""")
def split_to_rows_regex(t):
    return sp.split_to_rows(t.pages.select("page_id", "url"), "url", "[/.]+", "piece", regex=True)


@query("""select doc_id, unnest(string_split(text, '. ')) as sentence from documents""")
def split_to_rows(t):
    return sp.split_to_rows(t.documents.select("doc_id", "text"), "text", ". ", "sentence")


@query("""select page_id, url, nullif(regexp_extract(url, '^(https?)://([^/]+)/(en|fr|de|es)/', 1), '') as u_1,
          nullif(regexp_extract(url, '^(https?)://([^/]+)/(en|fr|de|es)/', 2), '') as u_2,
          nullif(regexp_extract(url, '^(https?)://([^/]+)/(en|fr|de|es)/', 3), '') as u_3 from pages""")
def extract_groups(t):
    return sp.extract(t.pages.select("page_id", "url"), "url", "^(https?)://([^/]+)/(EN|FR|DE|ES)/", "u", flags="IGNORECASE")


@query(r"""select doc_id, nullif(regexp_extract(text, '(\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b)', 1), '') as ip_1 from documents""")
def extract_ip_address(t):
    return sp.extract(t.documents, "text", "IPv4 Address", "ip", flags="ASCII").select("doc_id", "ip_1")


@query(r"""select page_id, nullif(regexp_extract(html, '(https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{2,256}\.[a-z]{2,6}\b(?:[-a-zA-Z0-9@:%_\+.~#?&/=]*))', 1), '')
  as link_1, nullif(regexp_extract(url, '(https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{2,256}\.[a-z]{2,6}\b(?:[-a-zA-Z0-9@:%_\+.~#?&/=]*))', 1), '') as url_1 from pages""")
def extract_url(t):
    pages = sp.extract(t.pages, "html", "URL", "link", flags="ASCII")
    return sp.extract(pages, "url", "URL", "url", flags="ASCII").select("page_id", "link_1", "url_1")


@query("""select o_orderkey, strftime(o_orderdate, '%A, %B %d, %Y') as written, strftime(o_orderdate, '%d/%m/%Y %H:%M') as short,
          date_trunc('minute', o_orderdate) as back, date_trunc('day', o_orderdate) as day from orders""")
def dates_to_text_and_back(t):
    dates = sp.datetime_to_text(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "%A, %B %d, %Y", "written")
    dates = sp.datetime_to_text(dates, "o_orderdate", "%d/%m/%Y %H:%M", "short")
    dates = sp.text_to_datetime(dates, "short", "%d/%m/%Y %H:%M", "back")
    return sp.text_to_datetime(dates, "written", "%A, %B %d, %Y", "day").drop("o_orderdate")


@query("""select o_orderkey, case when o_orderkey % 4 = 3 then null else date_trunc('day', o_orderdate) end as found from orders""")
def dates_auto(t):
    """Texts in three formats, and one that is no date."""
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "dd MMMM yyyy"))
        .when(kind == 2, F.date_format(day, "MMM dd, yyyy")).otherwise("no date")
    )
    texts = t.orders.select("o_orderkey", text.alias("written"))
    return sp.text_to_datetime(texts, "written", "auto", "found", on_error="null").drop("written")


@query("""select o_orderkey, o_orderdate as back from orders""")
def dates_french_and_back(t):
    texts = sp.datetime_to_text(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "%d %B %Y", "written", locale="fr_FR.UTF-8")
    return sp.text_to_datetime(texts, "written", "%d %B %Y", "back", locale="fr_FR.UTF-8").drop("o_orderdate", "written")


_GAPS = "(select event_id, ts, event_type, case when event_id % 3 = 0 then value end as value, nullif(event_type, 'click') as kind from events)"


def _gaps(t):
    return t.events.select(
        "event_id", "ts", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"),
        F.nullif("event_type", F.lit("click")).alias("kind"),
    )


@query(f"select event_id, ts, event_type, value, coalesce(kind, '') as kind from {_GAPS}")
def cleanse_fill_blanks(t):
    return sp.cleanse(_gaps(t), fill="blanks")


@query(f"select event_id, ts, event_type, coalesce(value, -1) as value, coalesce(kind, '-1') as kind from {_GAPS}")
def cleanse_fill_custom(t):
    return sp.cleanse(_gaps(t), ["value", "kind"], fill="custom", value=-1)


@query(f"select event_id, ts, event_type, coalesce(value, (select median(value) from {_GAPS})) as value, kind from {_GAPS}")
def cleanse_fill_median(t):
    return sp.cleanse(_gaps(t), ["value"], fill="median")


@query(f"""select event_id, ts, event_type, last_value(value ignore nulls) over w as value, last_value(kind ignore nulls) over w as kind from {_GAPS}
           window w as (order by ts, event_id rows unbounded preceding)""")
def cleanse_fill_forward(t):
    return sp.cleanse(_gaps(t), ["value", "kind"], fill="ffill", order_by=["ts", "event_id"])


@query(f"""select event_id, ts, event_type, first_value(value ignore nulls) over (partition by event_type order by ts, event_id
           rows between current row and unbounded following) as value, kind from {_GAPS}""")
def cleanse_fill_backward_by_group(t):
    return sp.cleanse(_gaps(t), ["value"], fill="bfill", order_by=["ts", "event_id"], by=["event_type"])


@query(r"""select doc_id, upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, 'ß', 'SS'), '^\s+|\s+$', '', 'g'), '\n', '', 'g'), '\r', '', 'g'),
          '[0-9]+', '', 'g')) as text from documents""")
def cleanse_characters(t):
    return sp.cleanse(t.documents.select("doc_id", "text"), ["text"], remove=["whitespace", "line breaks", "numbers"], case="upper")


@query(r"""select c_custkey, lower(replace(regexp_replace(c_name, '[^\w\s]+', '', 'g'), ' ', '_')) as c_name,
          upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as c_mktsegment from customer""")
def cleanse_cases(t):
    names = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return sp.cleanse(sp.cleanse(names, ["c_name"], remove=["punctuation"], case="snakecase"), ["c_mktsegment"], case="capitalize")


@query(f"select event_id, value, kind from {_GAPS} where value is not null and kind is not null")
def cleanse_drop_rows(t):
    return sp.cleanse(_gaps(t), ["value", "kind"], drop_null_rows="any").select("event_id", "value", "kind")


@query(f"select event_id, ts, event_type from {_GAPS}")
def cleanse_drop_columns(t):
    return sp.cleanse(_gaps(t).withColumn("nothing", F.lit(None).cast("int")), drop_null_columns="any")


@query("""select event_id, event_type, cast(json_extract(props, '$.k') as bigint) as k from events""")
def json_explode_objects(t):
    return sp.explode_json(t.events.select("event_id", "event_type", "props"), "props")


@query("""select conv_id, turn as "payload.turn", role as "payload.role", text as "payload.text" from conversations""")
def json_create_and_explode(t):
    payload = sp.create_json(t.conversations, ["turn", "role", "text"], by=["conv_id"], order_by=["turn"], name="payload")
    return sp.explode_json(payload, "payload", prefix_top_level=True)


@query("""select conv_id, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' order by turn) || ']' as json_payload
          from conversations group by 1""")
def json_create_grouped(t):
    return sp.create_json(t.conversations, ["turn", "role"], by=["conv_id"], order_by=["turn"])


@query("""select n_regionkey, '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' order by n_nationkey) || ']'
          as nations from nation group by 1""")
def json_create_nations(t):
    return sp.create_json(t.nation, ["n_nationkey", "n_name"], by=["n_regionkey"], order_by=["n_nationkey"], name="nations")



@query("""select o_orderkey as "order.key", o_custkey as "order.who.customer", o_orderpriority as priority from orders""")
def json_flatten(t):
    nested = F.struct(
        F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_custkey").alias("customer")).alias("who")).alias("order"),
        F.col("o_orderpriority").alias("priority"),
    )
    return sp.flatten_json(t.orders.select(F.to_json(nested).alias("doc")), "doc", keep_columns=False)


@query("""select split_part(p_name, ' ', 1) as "0", split_part(p_name, ' ', 2) as "1" from part""")
def json_expand_list(t):
    return sp.expand_json_list(t.part.select(F.to_json(F.split("p_name", " ")).alias("words")), "words")


@query("""select event_id, case when event_id % 4 = 0 then props || '}' when event_id % 4 = 1 then null else props end as doc,
          event_id % 4 > 1 as is_doc_valid_json from events""")
def json_validate(t):
    kind = F.col("event_id") % 4
    docs = F.when(kind == 0, F.concat("props", F.lit("}"))).when(kind != 1, F.col("props"))
    return sp.validate_json(t.events.select("event_id", docs.alias("doc")), ["doc"])


@query("""select p_partkey, '## **' || p_name || '**' as p_name from part""")
def markdown_style(t):
    return sp.markdown_style(t.part.select("p_partkey", "p_name"), ["p_name"], ["Heading level 2", "Bold"])


@query("""select o_orderkey, status, '_~~' || coalesce(status, '') || '~~_' as md_status from
          (select o_orderkey, nullif(o_orderstatus, 'F') as status from orders)""")
def markdown_style_new_column(t):
    rows = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return sp.markdown_style(rows, ["status"], ["Italic", "Strikethrough"], new_column=True, prefix="md_")


@query("""select o_orderkey, status, status is not null as is_status_valid_markdown from
          (select o_orderkey, nullif(o_orderstatus, 'F') as status from orders)""")
def markdown_validate(t):
    return sp.validate_markdown(t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status")), ["status"])


@query("""select n_regionkey, '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) ||
          string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) order by n_nationkey) as markdown_table from nation group by 1""")
def markdown_table(t):
    return sp.markdown_table(t.nation, ["n_nationkey", "n_name"], by=["n_regionkey"], order_by=["n_nationkey"])


@query("""select p_partkey, 'Describe the part: p_name: ' || p_name || ', p_size: ' || p_size as prompt from part""")
def prompt_texts(t):
    return sp.prompt_column(t.part, "Describe the part", ["p_name", "p_size"]).select("p_partkey", "prompt")


@query("""select text as page_content, lang, source, cast(doc_id as varchar) as id from documents""")
def documents_made(t):
    made = sp.to_documents(t.documents, "text")
    return made.select("page_content", *[F.col("metadata")[k].alias(a) for k, a in (("lang", "lang"), ("source", "source"), ("doc_id", "id"))])


@query(r"""select doc_id, regexp_replace(substr(text, k * 400 + 1, 500), '^\s+|\s+$', '', 'g') as chunk from
          (select doc_id, text, unnest(range(0, cast(greatest(ceil((length(text) - 100) / 400.0), 1) as bigint))) as k from documents)
          where regexp_replace(substr(text, k * 400 + 1, 500), '^\s+|\s+$', '', 'g') <> ''""")
def chunks_of_characters(t):
    return sp.fixed_size_chunks(t.documents, "text", 500, 100, separator="").select("doc_id", "chunk")


@query(r"""select doc_id, array_to_string(words[k * 50 + 1 : k * 50 + 60], ' ') as chunk, k as chunk_no from
          (select doc_id, words, unnest(range(0, cast(greatest(ceil((len(words) - 10) / 50.0), 1) as bigint))) as k from
           (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as words from documents) where len(words) > 0)""")
def chunks_of_words(t):
    chunks = sp.fixed_size_chunks(t.documents.select("doc_id", "text"), "text", 60, 10, separator=r"\s+", regex=True, unit="word")
    return chunks.withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


def _content(chunks, size):
    """Per document all text of its chunks without white space, as a hash, and whether every chunk kept to the size."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: x["chunk"]), "")
    content = F.md5(F.regexp_replace(texts, r"(?U)\s", ""))
    return chunks.groupBy("doc_id").agg(content.alias("content"), (F.max(F.char_length("chunk")) <= size).alias("fits"))


_CONTENT = r"""select doc_id, md5(regexp_replace(text, '\s', '', 'g')) as content, true as fits from documents
  where regexp_replace(text, '\s', '', 'g') <> ''"""


@query(_CONTENT)
def chunks_recursive_keep_all_text(t):
    return _content(sp.recursive_chunks(t.documents.select("doc_id", "text"), "text", 800), 800)


@query(_CONTENT)
def chunks_at_separator_keep_all_text(t):
    return _content(sp.fixed_size_chunks(t.documents.select("doc_id", "text"), "text", 700, separator=" "), 700)


@query(_CONTENT.replace("true as fits", "true as any_size"))
def chunks_of_sentences_keep_all_text(t):
    """A sentence longer than the size is a chunk of its own, so the size is not checked here."""
    content = _content(sp.sentence_chunks(t.documents.select("doc_id", "text"), "text", 1000), 2**31)
    return content.withColumnRenamed("fits", "any_size")


@query("""select page_id, array_to_string(list_transform(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1),
          lambda x: trim(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'))), ' ') as heading,
          array_to_string(list_transform(list_zip(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2),
            regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)), lambda x: x[1] || ' (' || x[2] || ')'), ' ') as links from pages""")
def html_headings_and_links(t):
    pages = sp.parse_html(t.pages, "html", tags=["h1"], name="heading")
    return sp.parse_html(pages, "html", tags=["li"], name="links").select("page_id", "heading", "links")


@query()
def chunks_at_separator(t):
    return sp.fixed_size_chunks(t.documents.select("doc_id", "text"), "text", 60, 10, separator=" ", unit="word")


@query()
def chunks_recursive(t):
    return sp.recursive_chunks(t.documents.select("doc_id", "text"), "text", 800, 80)


@query()
def chunks_of_sentences(t):
    return sp.sentence_chunks(t.documents.select("doc_id", "text"), "text", 1000, 100)


@query()
def html_text(t):
    return sp.parse_html(t.pages, "html", tags=["p", "li", "h1"], remove_classes=["ad"]).select("page_id", "text")


@query()
def html_to_markdown(t):
    return sp.html_to_markdown(t.pages, "html").select("page_id", "markdown")


@query("""select o_orderkey, '{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '"}' as payload from orders""")
def request_payloads(t):
    made = sp.record_payload(t.orders, '{"key":{{o_orderkey}},"priority":"{{o_orderpriority}}"}')
    return made.select("o_orderkey", "payload")


@query("select o_orderkey, o_orderpriority, true as full_lists from orders")
def payload_lists(t):
    """Bodies of up to 100 records each; every order is in one of them."""
    lists = sp.record_payload(t.orders, '{"key": {{o_orderkey}}, "priority": "{{o_orderpriority}}"}', size=100)
    records = F.explode(F.from_json("payload", "array<struct<key: bigint, priority: string>>")).alias("r")
    read = lists.select("records", (F.col("records") <= 100).alias("full_lists"), records)
    return read.select(F.col("r.key").alias("o_orderkey"), F.col("r.priority").alias("o_orderpriority"), "full_lists")
