"""Counts, revenue, rates and funnels. Placements are orders, clients customers, recruiters suppliers,
submissions line items, and job logs events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import aggregates as A
from corvane.operators.filters import date_range, scope
from corvane.operators.rows import page, page_info, top
from corvane.queries.registry import query

DBL = "double"


@query("orders", "customer", sql="""
SELECT c_custkey AS client_id, c_name AS company_name, c_mktsegment AS industry, count(*) AS placements,
  cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS total_revenue,
  floor(cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) / count(*) * 100 + 0.5::double) / 100 AS avg_billing,
  min(o_totalprice) AS min_billing, max(o_totalprice) AS max_billing, count(DISTINCT o_orderpriority) AS categories
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate >= timestamp '1995-01-01' AND o_orderdate <= timestamp '1996-12-31' GROUP BY 1, 2, 3""")
def client_performance(orders: DataFrame, customer: DataFrame) -> DataFrame:
    # facts shrink to one row a client before they meet the dimension
    by = orders.filter(date_range("o_orderdate", "1995-01-01", "1996-12-31", "1998-08-02")).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("placements"), A.money("o_totalprice").cast(DBL).alias("total_revenue"),
        F.min("o_totalprice").alias("min_billing"), F.max("o_totalprice").alias("max_billing"), F.countDistinct("o_orderpriority").alias("categories"),
    )
    out = by.join(customer.select("c_custkey", "c_name", "c_mktsegment"), by["o_custkey"] == F.col("c_custkey"))
    avg = A.half_up(F.col("total_revenue") / F.col("placements"), 2)
    return out.select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("industry"), "placements", "total_revenue", avg.alias("avg_billing"), "min_billing", "max_billing", "categories")


@query("orders", sql="""
SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS revenue, count(DISTINCT o_custkey) AS clients
FROM orders GROUP BY 1""")
def monthly_revenue(orders: DataFrame) -> DataFrame:
    return A.by_period(orders, "o_orderdate", "yyyy-MM", n=F.count(F.lit(1)), revenue=A.money("o_totalprice").cast(DBL), clients=F.countDistinct("o_custkey"))


@query("orders", sql="""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS period, count(*) AS placements, count(DISTINCT o_custkey) AS clients, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS revenue
FROM orders WHERE o_orderdate >= timestamp '1997-01-01' AND o_orderdate <= timestamp '1997-06-30' GROUP BY 1""")
def daily_placements(orders: DataFrame) -> DataFrame:
    rows = orders.filter(date_range("o_orderdate", "1997-01-01", "1997-06-30", "1998-08-02"))
    return A.by_period(rows, "o_orderdate", "yyyy-MM-dd", placements=F.count(F.lit(1)), clients=F.countDistinct("o_custkey"), revenue=A.money("o_totalprice").cast(DBL))


@query("orders", sql="""
SELECT coalesce(cast(sum(cast(o_totalprice AS decimal(18,2))) AS double), 0) AS total_revenue, count(*) AS placements, coalesce(min(o_totalprice), 0) AS smallest, coalesce(max(o_totalprice), 0) AS largest,
  coalesce(floor(cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) / nullif(count(*), 0) * 100 + 0.5::double) / 100, 0) AS average, count(DISTINCT o_custkey) AS clients
FROM orders""")
def revenue_summary(orders: DataFrame) -> DataFrame:
    total, n = A.money("o_totalprice").cast(DBL), F.count(F.lit(1))
    zero = F.lit(0.0)
    return orders.agg(
        F.coalesce(total, zero).alias("total_revenue"), n.alias("placements"), F.coalesce(F.min("o_totalprice"), zero).alias("smallest"), F.coalesce(F.max("o_totalprice"), zero).alias("largest"),
        F.coalesce(A.half_up(total / F.nullif(n, F.lit(0)), 2), zero).alias("average"), F.countDistinct("o_custkey").alias("clients"),
    )


@query("events", sql="""
SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS successful, count(*) FILTER (WHERE event_type = 'error') AS failed,
  coalesce(round(count(*) FILTER (WHERE event_type = 'purchase') * 100.0::double / nullif(count(*), 0), 2), 0) AS success_rate,
  coalesce(round(avg(value) FILTER (WHERE event_type = 'purchase'), 2), 0) AS avg_value
FROM events""")
def status_stats(events: DataFrame) -> DataFrame:
    return A.status_stats(events, "event_type", "purchase", "error", "value")


@query("events", sql="""
SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS success_count, count(*) FILTER (WHERE event_type = 'error') AS failure_count
FROM events WHERE ts >= timestamp '2024-01-31' - INTERVAL 14 DAY GROUP BY 1""")
def upload_trends(events: DataFrame) -> DataFrame:
    rows = events.filter(date_range("ts", None, None, "2024-01-31", 14))
    return A.by_period(rows, "ts", "yyyy-MM-dd", n=F.count(F.lit(1)), success_count=F.count_if(F.col("event_type") == "purchase"), failure_count=F.count_if(F.col("event_type") == "error"))


@query("events", sql="""
SELECT user_id, count(*) AS n, round(avg(epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6, 3) AS avg_seconds
FROM events GROUP BY 1""")
def mean_age_by_user(events: DataFrame) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(micros) / 1e6, 3).alias("avg_seconds"))


@query("lineitem", "part", sql="""
SELECT p_brand AS skill, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY 1 ORDER BY n DESC, skill LIMIT 10""")
def top_skills(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    # count by part first: the join then meets one row a part
    by = lineitem.filter("l_returnflag <> 'R'").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("c"))
    n = by.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("skill")).agg(F.sum("c").alias("n"))
    return top(n, 10, F.desc("n"), F.col("skill"))


@query("events", sql="""
SELECT stage, users, events FROM (
  SELECT 1 AS o, 'signup' AS stage, count(DISTINCT user_id) FILTER (WHERE event_type = 'signup') AS users, count(*) FILTER (WHERE event_type = 'signup') AS events FROM events
  UNION ALL SELECT 2, 'view', count(DISTINCT user_id) FILTER (WHERE event_type = 'view'), count(*) FILTER (WHERE event_type = 'view') FROM events
  UNION ALL SELECT 3, 'click', count(DISTINCT user_id) FILTER (WHERE event_type = 'click'), count(*) FILTER (WHERE event_type = 'click') FROM events
  UNION ALL SELECT 4, 'purchase', count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase'), count(*) FILTER (WHERE event_type = 'purchase') FROM events)""")
def funnel_counts(events: DataFrame) -> DataFrame:
    stages = ["signup", "view", "click", "purchase"]
    # one pass over the log; stages without events come from the literal list
    got = events.filter(F.col("event_type").isin(stages)).groupBy("event_type").agg(F.countDistinct("user_id").alias("u"), F.count(F.lit(1)).alias("e"))
    names = got.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    return names.join(got, names["stage"] == got["event_type"], "left").select("stage", A.or_zero(F.col("u")).alias("users"), A.or_zero(F.col("e")).alias("events"))


@query("orders", sql="""
SELECT o_orderpriority AS stage, count(*) AS n, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def open_opportunities(orders: DataFrame) -> DataFrame:
    out = orders.filter("o_orderstatus = 'O'").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count(F.lit(1)).alias("n"), A.money("o_totalprice").cast(DBL).alias("value"))
    order = F.when(F.col("stage").startswith("1"), 1).when(F.col("stage").startswith("2"), 2).otherwise(3)
    return out.orderBy(order, "stage")


_KPI = """
WITH subs AS (SELECT l_suppkey, count(*) AS submissions, count(DISTINCT l_orderkey) AS jobs, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_orderkey END) AS accepted,
  count(*) FILTER (WHERE l_returnflag = 'R') AS rejected, count(*) FILTER (WHERE l_linestatus = 'O') AS open_items FROM lineitem GROUP BY 1)
SELECT s_suppkey AS recruiter, s_nationkey AS team, coalesce(submissions, 0) AS submissions, coalesce(jobs, 0) AS jobs, coalesce(accepted, 0) AS accepted,
  coalesce(rejected, 0) AS rejected, coalesce(open_items, 0) AS open_items, round(coalesce(accepted, 0) * 100.0::double / nullif(coalesce(jobs, 0), 0), 2) AS accept_rate
FROM supplier LEFT JOIN subs ON s_suppkey = l_suppkey"""


@query("supplier", "lineitem", sql=_KPI)
def team_kpis(supplier: DataFrame, lineitem: DataFrame) -> DataFrame:
    got = A.counts_by_key(
        supplier.select(F.col("s_suppkey").alias("recruiter"), F.col("s_nationkey").alias("team")), lineitem, "recruiter", "l_suppkey",
        submissions=F.count(F.lit(1)), jobs=F.countDistinct("l_orderkey"), accepted=F.countDistinct(F.when(F.col("l_returnflag") == "A", F.col("l_orderkey"))),
        rejected=F.count_if(F.col("l_returnflag") == "R"), open_items=F.count_if(F.col("l_linestatus") == "O"),
    )
    return got.withColumn("accept_rate", A.pct(F.col("accepted"), F.col("jobs")))


@query("orders", sql="""
SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS revenue
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def team_totals(orders: DataFrame) -> DataFrame:
    r = orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), A.money("o_totalprice").cast(DBL).alias("revenue"))
    return r.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "revenue")


@query("lineitem", sql="""
SELECT strftime(l_shipdate, '%Y-%m-%d') AS period, count(*) AS submissions, count(*) FILTER (WHERE l_returnflag = 'A') AS accepted,
  round(count(*) FILTER (WHERE l_returnflag = 'A') * 100.0::double / nullif(count(*), 0), 2) AS success_rate FROM lineitem GROUP BY 1""")
def success_rate_daily(lineitem: DataFrame) -> DataFrame:
    ok, n = F.count_if(F.col("l_returnflag") == "A"), F.count(F.lit(1))
    return A.by_period(lineitem, "l_shipdate", "yyyy-MM-dd", submissions=n, accepted=ok, success_rate=A.pct(ok, n))


@query("lineitem", "supplier", sql="""
SELECT s_suppkey AS recruiter, s_name AS name, count(*) AS submissions, count(*) FILTER (WHERE l_returnflag = 'A') AS accepted,
  round(count(*) FILTER (WHERE l_returnflag = 'A') * 100.0::double / nullif(count(*), 0), 2) AS success_rate
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def success_rate_by_recruiter(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    by = lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("submissions"), F.count_if(F.col("l_returnflag") == "A").alias("accepted"))
    out = by.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return out.select(F.col("s_suppkey").alias("recruiter"), F.col("s_name").alias("name"), "submissions", "accepted", A.pct(F.col("accepted"), F.col("submissions")).alias("success_rate"))


@query("events", sql="SELECT user_id, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2")
def pivot_activity(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", F.col("event_type").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("events", sql="""
SELECT sum(n)::bigint AS total, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts FROM (SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1)""")
def activity_map(events: DataFrame) -> DataFrame:
    m = A.histogram_map(events, "event_type")
    return m.select("total", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("counts"))


@query("events", sql="""
SELECT k AS json_key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1 ORDER BY n DESC, json_key LIMIT 3""")
def json_key_counts(events: DataFrame) -> DataFrame:
    return top(A.json_key_counts(events, "props"), 3, F.desc("n"), F.col("json_key"))


@query("events", sql="""
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL) AS corrected,
  round(CASE WHEN count(*) > 0 THEN (count(*) - count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL))::double / count(*) ELSE 1 END, 4) AS section_score
FROM events GROUP BY 1""")
def section_scores(events: DataFrame) -> DataFrame:
    n, bad = F.count(F.lit(1)), F.count_if(F.get_json_object("props", "$.k").isNotNull())
    return events.groupBy("event_type").agg(n.alias("n"), bad.alias("corrected"), F.round((n - bad) / n, 4).alias("section_score"))


@query("orders", "customer", "nation", sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2)""")
def scoped_semi(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    mine = customer.join(nation.filter("n_regionkey = 2"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey")
    return orders.join(mine, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@query("lineitem", "supplier", sql="""
SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3 OR s_suppkey = 3)""")
def team_scope(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    return scope(lineitem, "lead", 3, "l_suppkey", supplier, "s_suppkey", "s_nationkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("orders", sql="SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_offset(orders: DataFrame) -> DataFrame:
    return page(orders.select("o_orderkey", "o_custkey", "o_orderdate"), 3, 20, F.desc("o_orderdate"), F.col("o_orderkey"))


@query("orders", sql="SELECT count(*) AS total, cast(ceil(count(*) / 20.0) AS bigint) AS total_pages FROM orders")
def page_totals(orders: DataFrame) -> DataFrame:
    return page_info(orders, 20)


@query("orders", sql="""
SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100) ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def page_then_rank(orders: DataFrame) -> DataFrame:
    newest = top(orders, 100, F.desc("o_orderdate"), F.col("o_orderkey"))
    return top(newest.select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("orders", sql="""
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT period, count(*) AS new_clients FROM m WHERE rn = 1 GROUP BY 1""")
def new_clients(orders: DataFrame) -> DataFrame:
    first = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("d"))
    return A.by_period(first, "d", "yyyy-MM", new_clients=F.count(F.lit(1)))


@query("orders", "lineitem", sql="""
SELECT o_orderkey AS job, o_orderstatus AS status, count(l_orderkey) AS filled, 4 AS openings, count(l_orderkey) >= 4 AS complete
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'A' GROUP BY 1, 2""")
def openings_filled(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    got = A.counts_by_key(orders.select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status")), lineitem.filter("l_returnflag = 'A'"), "job", "l_orderkey", filled=F.count(F.lit(1)))
    return got.select("job", "status", "filled", F.lit(4).alias("openings"), (F.col("filled") >= 4).alias("complete"))


@query("customer", "orders", sql="""
SELECT c_custkey, CASE WHEN n = 0 THEN 'prospect' WHEN o > 0 THEN 'active' ELSE 'closed' END AS stage, CASE WHEN n = 0 THEN 0 WHEN o > 0 THEN 50 ELSE 100 END AS progress
FROM (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def workflow_stage(customer: DataFrame, orders: DataFrame) -> DataFrame:
    got = A.counts_by_key(customer.select("c_custkey"), orders, "c_custkey", "o_custkey", n=F.count(F.lit(1)), o=F.count_if(F.col("o_orderstatus") == "O"))
    step = lambda a, b, c: F.when(F.col("n") == 0, a).when(F.col("o") > 0, b).otherwise(c)
    return got.select("c_custkey", step("prospect", "active", "closed").alias("stage"), step(0, 50, 100).alias("progress"))


@query("orders", sql="""
SELECT o_orderpriority AS client_manager, count(*) AS jobs, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_jobs,
  cast(sum(cast(o_totalprice AS decimal(18,2))) FILTER (WHERE o_orderstatus = 'F') AS double) AS revenue, (rank() OVER (ORDER BY count(*) DESC))::int AS place FROM orders GROUP BY 1""")
def manager_summary(orders: DataFrame) -> DataFrame:
    g = orders.groupBy(F.col("o_orderpriority").alias("client_manager")).agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.count_if(F.col("o_orderstatus") == "O").alias("open_jobs"),
        A.money(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).cast(DBL).alias("revenue"),
    )
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("jobs"))))  # one row a manager
