"""Joins of every kind, latest rows, intervals, options, duplicates, upserts and interactive search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import aggregates as A
from corvane.operators.dedupe import duplicate_pairs, find_duplicates, merge_fill
from corvane.operators.filters import any_like, contains_all, contains_any, filled, in_list, number_range
from corvane.operators.rows import gaps, keep_first, latest, latest_values, merge_intervals, top
from corvane.plans.boolean_search import predicate
from corvane.queries.registry import query
from corvane.sources.writers import insert_ignore, upsert


@query("customer", "orders", sql="SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def pending_anti(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return customer.join(orders.select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("orders", "lineitem", sql="""
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')""")
def exists_or_not_exists(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    # one grouped pass gives both flags
    f = lineitem.groupBy("l_orderkey").agg(F.max(F.col("l_returnflag") == "R").alias("r"), F.max(F.col("l_linestatus") == "O").alias("o"))
    out = orders.select("o_orderkey").join(f, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.filter(F.coalesce("r", F.lit(False)) | ~F.coalesce("o", F.lit(False))).select("o_orderkey")


@query("orders", "lineitem", sql="SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS has_large FROM orders")
def existence_flag(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    has = lineitem.filter("l_quantity > 45").select("l_orderkey").distinct()
    return orders.join(has, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("l_orderkey").isNotNull().alias("has_large"))


@query("customer", "orders", sql="""
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS total, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS open_orders,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer""")
def correlated_counts(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return A.counts_by_key(customer.select("c_custkey"), orders, "c_custkey", "o_custkey", total=F.count(F.lit(1)), open_orders=F.count_if(F.col("o_orderstatus") == "O"), urgent=F.count_if(F.col("o_orderpriority") == "1-URGENT"))


@query("customer", "orders", sql="""
SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(p, '') AS priorities FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def nested_profile(customer: DataFrame, orders: DataFrame) -> DataFrame:
    g = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("p"))
    out = customer.join(g, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", A.or_zero(F.col("n")).alias("n_orders"), F.coalesce("p", F.lit("")).alias("priorities"))


@query("lineitem", sql="""
SELECT l_orderkey AS job, string_agg(DISTINCT cast(l_partkey AS varchar), ',' ORDER BY cast(l_partkey AS varchar)) FILTER (WHERE l_returnflag = 'A') AS required,
  string_agg(DISTINCT cast(l_partkey AS varchar), ',' ORDER BY cast(l_partkey AS varchar)) FILTER (WHERE l_returnflag = 'N') AS preferred FROM lineitem GROUP BY 1""")
def required_and_preferred(lineitem: DataFrame) -> DataFrame:
    pick = lambda f: F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_partkey").cast("string")))), ","), F.lit(""))
    return lineitem.groupBy(F.col("l_orderkey").alias("job")).agg(pick("A").alias("required"), pick("N").alias("preferred"))


@query("events", sql="""
SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_key(events: DataFrame) -> DataFrame:
    return latest_values(events, ["user_id"], "ts", "event_id", ["event_type"]).select("user_id", "event_id", "event_type", "ts")


@query("customer", "orders", sql="""
SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o ON o_custkey = c_custkey AND rn = 1""")
def lateral_latest(customer: DataFrame, orders: DataFrame) -> DataFrame:
    last = latest(orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("customer", "nation", "region", sql="""
SELECT c_custkey, coalesce(n_name, 'Unknown') AS nation, coalesce(r_name, 'Unknown') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3""")
def left_with_default(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    out = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region.filter("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", F.coalesce("n_name", F.lit("Unknown")).alias("nation"), F.coalesce("r_name", F.lit("Unknown")).alias("region"))


@query("lineitem", "orders", "customer", "supplier", sql="""
SELECT l_orderkey, l_linenumber, c_name AS client, s_name AS recruiter FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
WHERE l_shipdate >= timestamp '1998-06-01' AND (s_suppkey = 3 OR c_custkey % 7 = 0)""")
def upcoming(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    j = lineitem.filter(F.col("l_shipdate") >= F.expr("timestamp_ntz '1998-06-01'")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.filter((F.col("l_suppkey") == 3) | (F.col("o_custkey") % 7 == 0))
    j = j.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select("l_orderkey", "l_linenumber", F.col("c_name").alias("client"), F.col("s_name").alias("recruiter"))


@query("lineitem", "supplier", sql="""
SELECT l.l_orderkey, l.l_linenumber, a.s_name AS by_name, b.s_name AS next_name FROM lineitem l LEFT JOIN supplier a ON a.s_suppkey = l.l_suppkey LEFT JOIN supplier b ON b.s_suppkey = l.l_suppkey + 1 WHERE l.l_returnflag = 'R'""")
def two_roles(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    a, b = supplier.select(F.col("s_suppkey").alias("a"), F.col("s_name").alias("by_name")), supplier.select((F.col("s_suppkey") - 1).alias("b"), F.col("s_name").alias("next_name"))
    rows = lineitem.filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_suppkey")
    return rows.join(a, F.col("l_suppkey") == F.col("a"), "left").join(b, F.col("l_suppkey") == F.col("b"), "left").select("l_orderkey", "l_linenumber", "by_name", "next_name")


@query("customer", sql="SELECT DISTINCT c_mktsegment AS option FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> ''")
def distinct_options(customer: DataFrame) -> DataFrame:
    return customer.filter(filled("c_mktsegment")).select(F.col("c_mktsegment").alias("option")).distinct()


@query("customer", "orders", sql="SELECT c_mktsegment AS option FROM customer UNION SELECT unnest([o_orderpriority, o_orderstatus]) FROM orders")
def union_options(customer: DataFrame, orders: DataFrame) -> DataFrame:
    both = orders.select(F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("option")).distinct()
    return customer.select(F.col("c_mktsegment").alias("option")).distinct().union(both).distinct()


_MERGED = """
WITH d AS (SELECT DISTINCT l_suppkey, l_shipdate::date AS s, (l_shipdate + to_days(cast(floor(l_quantity / 10) AS int)))::date AS e FROM lineitem),
f AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w THEN 1 ELSE 0 END AS new FROM d WINDOW w AS (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM f),
m AS (SELECT l_suppkey, i, min(s) AS s, max(e) AS e FROM g GROUP BY 1, 2)"""


def _jobs(lineitem: DataFrame) -> DataFrame:
    start = F.to_date("l_shipdate")
    return lineitem.select("l_suppkey", start.alias("s"), F.date_add(start, F.floor(F.col("l_quantity") / 10).cast("int")).alias("e"))


@query("lineitem", sql=_MERGED + " SELECT l_suppkey, s, e FROM m")
def interval_merge(lineitem: DataFrame) -> DataFrame:
    return merge_intervals(_jobs(lineitem), ["l_suppkey"], "s", "e")


@query("lineitem", sql=_MERGED + " SELECT l_suppkey, round(sum(date_diff('day', s, e)) / 365.25, 1) AS years FROM m GROUP BY 1")
def experience_years(lineitem: DataFrame) -> DataFrame:
    merged = merge_intervals(_jobs(lineitem), ["l_suppkey"], "s", "e")
    return merged.groupBy("l_suppkey").agg(F.round(F.sum(F.datediff("e", "s")) / 365.25, 1).alias("years"))


@query("events", sql="""
SELECT user_id, event_id, gap_days::int AS gap_days FROM (SELECT user_id, event_id, date_diff('day', lag(ts::date) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts::date) AS gap_days FROM events) WHERE gap_days > 3""")
def gap_detection(events: DataFrame) -> DataFrame:
    rows = events.withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.withColumn("gap_days", F.datediff("day", F.lag("day").over(w))).filter("gap_days > 3").select("user_id", "event_id", "gap_days")


@query("orders", sql="""
SELECT o_custkey, o_orderkey, date_diff('day', lag(o_orderdate::date) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::date, o_orderkey), o_orderdate::date)::int AS gap_days FROM orders""")
def order_gaps(orders: DataFrame) -> DataFrame:
    rows = orders.withColumn("d", F.to_date("o_orderdate"))
    return gaps(rows, ["o_custkey"], "d", "d", "o_orderkey").select("o_custkey", "o_orderkey", "gap_days")


@query("customer", "orders", sql="""
SELECT c_custkey, last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY 1) ON c_custkey = o_custkey ORDER BY last_order DESC NULLS LAST, c_custkey LIMIT 25""")
def nulls_last_sort(customer: DataFrame, orders: DataFrame) -> DataFrame:
    last = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    return top(customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last_order"), 25, F.desc_nulls_last("last_order"), F.col("c_custkey"))


BOOLEAN = '(moron OR trash) AND the NOT "of the"'


@query("documents", sql="""
SELECT doc_id, lang FROM documents WHERE ((text ILIKE '%moron%' OR text ILIKE '%trash%') AND text ILIKE '%the%') AND NOT text ILIKE '%of the%'""")
def boolean_search(documents: DataFrame) -> DataFrame:
    return documents.filter(predicate(BOOLEAN, "text")).select("doc_id", "lang")


@query("documents", sql="""
SELECT doc_id FROM documents WHERE (text ILIKE '%token%' OR source ILIKE '%token%') AND (text ILIKE '%er%' OR source ILIKE '%er%') AND n_chars >= 200 AND n_chars <= 20000 AND lower(lang) IN ('en', 'de')
  AND (text ILIKE '%the%' OR text ILIKE '%die%') ORDER BY n_chars DESC, doc_id LIMIT 20""")
def filter_search(documents: DataFrame) -> DataFrame:
    hard = in_list("lang", "EN, de") & number_range("n_chars", 200, 20000) & contains_all(["token", "er"], ["text", "source"]) & any_like("text", ["the", "die"])
    return top(documents.filter(hard).select("doc_id", "n_chars"), 20, F.desc("n_chars"), F.col("doc_id")).select("doc_id")


@query("part", sql="SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%5%' OR p_type ILIKE '%5%' OR p_brand ILIKE '%5%'")
def substring_search(part: DataFrame) -> DataFrame:
    return part.filter(contains_any("5", ["p_name", "p_type", "p_brand"])).select("p_partkey", "p_name")


@query("documents", sql="""
SELECT doc_id, text_key FROM (SELECT doc_id, md5(lower(trim(text))) AS text_key, row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedupe_keep_first(documents: DataFrame) -> DataFrame:
    # only ids and digests are shuffled
    rows = documents.select("doc_id", F.md5(F.lower(F.trim("text"))).alias("text_key"))
    return rows.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text_key")


@query("documents", sql="""
SELECT first_id, doc_id AS id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id FROM documents) WHERE doc_id <> first_id""")
def duplicate_documents(documents: DataFrame) -> DataFrame:
    return duplicate_pairs(documents, "doc_id", F.md5("text"))


_CASCADE = """
WITH e AS (SELECT c_custkey, lower(c_name) AS k1, right(regexp_replace(c_name, '[^0-9]', '', 'g'), 4) AS k2, c_mktsegment || cast(c_nationkey AS varchar) AS k3 FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT c_custkey, lower(c_name) AS k1, right(regexp_replace(c_name, '[^0-9]', '', 'g'), 4) AS k2, c_mktsegment || cast(c_nationkey AS varchar) AS k3 FROM customer WHERE c_custkey % 2 = 1),
m AS (SELECT n.c_custkey AS new_id, 0 AS r, e.c_custkey AS old_id, 'name' AS reason FROM n JOIN e USING (k1) UNION ALL SELECT n.c_custkey, 1, e.c_custkey, 'number' FROM n JOIN e USING (k2) UNION ALL SELECT n.c_custkey, 2, e.c_custkey, 'segment and nation' FROM n JOIN e USING (k3))
SELECT new_id, old_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY r, old_id) AS rn FROM m) WHERE rn = 1"""


@query("customer", sql=_CASCADE)
def duplicate_cascade(customer: DataFrame) -> DataFrame:
    old, new = customer.filter("c_custkey % 2 = 0").withColumnRenamed("c_custkey", "old_id"), customer.filter("c_custkey % 2 = 1").withColumnRenamed("c_custkey", "new_id")
    name, digits = F.lower("c_name"), F.right(F.regexp_replace("c_name", "[^0-9]", ""), F.lit(4))
    place = F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))
    return find_duplicates(new, old, "new_id", "old_id", [("name", name, name), ("number", digits, digits), ("segment and nation", place, place)])


@query("events", sql="""
SELECT user_id, arg_min(event_type, ts_id) FILTER (WHERE event_type IN ('purchase', 'signup')) AS goal, arg_min(value, ts_id) FILTER (WHERE value > 50) AS large
FROM (SELECT *, epoch_us(ts)::hugeint * 100000000 + event_id AS ts_id FROM events) GROUP BY 1""")
def merge_fill_first(events: DataFrame) -> DataFrame:
    rows = events.select("user_id", "ts", "event_id", F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type")).alias("goal"), F.when(F.col("value") > 50, F.col("value")).alias("large"))
    return merge_fill(rows, "user_id", [F.col("ts"), F.col("event_id")], ["goal", "large"])


@query("customer", "supplier", sql="""
SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier""")
def upsert_rows(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    return upsert(customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), ["k"])


@query("customer", "supplier", sql="""
SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def insert_ignore_rows(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    return insert_ignore(supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), ["k"])


@query("part", sql="""
SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1""")
def best_per_section(part: DataFrame) -> DataFrame:
    return keep_first(part, [F.col("p_brand")], F.desc("p_retailprice"), F.col("p_partkey")).select("p_brand", "p_partkey", "p_retailprice")
