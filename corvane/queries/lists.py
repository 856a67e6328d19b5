"""Boards and views over clients, submissions, reviews, jobs and activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.queries.registry import query

NOW = "1998-08-02"


def now() -> Column:
    return F.expr(f"timestamp_ntz '{NOW}'")


def when_count(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


@query("customer", "orders", "nation", sql=f"""
SELECT c_custkey, c_name, n_name AS manager, coalesce(total, 0) AS jobs, coalesce(open_jobs, 0) AS open_jobs, coalesce(filled, 0) AS filled, coalesce(revenue, 0) AS revenue, last_job,
  last_job IS NULL OR last_job < timestamp '{NOW}' - INTERVAL 90 DAY AS follow_up
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_jobs, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled,
  cast(sum(cast(o_totalprice AS decimal(18,2))) FILTER (WHERE o_orderstatus = 'F') AS double) AS revenue, max(o_orderdate) AS last_job FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def client_board(customer: DataFrame, orders: DataFrame, nation: DataFrame) -> DataFrame:
    """Clients with their jobs by state, what filled ones brought, and whether someone should call."""
    paid = F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)"))).cast("double")
    jobs = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("jobs"), when_count(F.col("o_orderstatus") == "O", "open_jobs"), when_count(F.col("o_orderstatus") == "F", "filled"), paid.alias("revenue"), F.max("o_orderdate").alias("last_job"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(jobs, F.col("c_custkey") == F.col("o_custkey"), "left")
    due = F.col("last_job").isNull() | (F.col("last_job") < now() - F.expr("INTERVAL 90 DAYS"))
    return rows.select("c_custkey", "c_name", F.col("n_name").alias("manager"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("jobs", "open_jobs", "filled")], F.coalesce("revenue", F.lit(0.0)).alias("revenue"), "last_job", due.alias("follow_up"))


@query("customer", "orders", sql=f"""
WITH f AS (SELECT o_custkey, min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) FILTER (WHERE o_orderdate >= date_trunc('month', timestamp '{NOW}')) AS here,
  count(*) FILTER (WHERE o_orderdate >= date_trunc('month', timestamp '{NOW}') - INTERVAL 1 MONTH AND o_orderdate < date_trunc('month', timestamp '{NOW}')) AS before FROM orders GROUP BY 1)
SELECT c_nationkey AS manager, count(*) AS clients, count(*) FILTER (WHERE here > 0) AS active_now, count(*) FILTER (WHERE before > 0) AS active_before, count(*) FILTER (WHERE first >= date_trunc('year', timestamp '{NOW}')) AS new_this_year, count(*) FILTER (WHERE o_custkey IS NULL) AS never
FROM customer LEFT JOIN f ON o_custkey = c_custkey GROUP BY 1""")
def manager_summary(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """What each manager's clients do this month, did in the last, and how many are new or silent."""
    month, d = F.date_trunc("month", now()), F.col("o_orderdate")
    of = orders.groupBy("o_custkey").agg(F.min(d).alias("first"), when_count(d >= month, "here"), when_count((d >= month - F.expr("INTERVAL 1 MONTH")) & (d < month), "before"))
    rows = customer.select("c_custkey", F.col("c_nationkey").alias("manager")).join(of, F.col("c_custkey") == F.col("o_custkey"), "left")
    counts = [when_count(F.col("here") > 0, "active_now"), when_count(F.col("before") > 0, "active_before"), when_count(F.col("first") >= F.date_trunc("year", now()), "new_this_year"), when_count(F.col("o_custkey").isNull(), "never")]
    return rows.groupBy("manager").agg(F.count(F.lit(1)).alias("clients"), *counts)


@query("lineitem", "orders", "customer", "supplier", sql=f"""
WITH seen AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A')
SELECT l_orderkey, l_linenumber, c_name AS client, coalesce(s_name, 'Unassigned') AS recruiter, CASE l_returnflag WHEN 'N' THEN 'pending' WHEN 'A' THEN 'approved' ELSE 'rejected' END AS state, s.l_partkey IS NOT NULL AS reviewed_elsewhere,
  CASE WHEN l_returnflag = 'N' THEN floor(epoch(timestamp '{NOW}' - l_shipdate) / 86400)::bigint END AS days_waiting
FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 10 > 0 LEFT JOIN seen s ON s.l_partkey = l.l_partkey WHERE c_nationkey IN (1, 2, 3)""")
def submission_board(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Submissions to the clients of three managers: state, recruiter, whether the candidate was approved anywhere, days without an answer."""
    seen = lineitem.filter("l_returnflag = 'A'").select("l_partkey").distinct().withColumn("seen", F.lit(True))
    mine = orders.join(customer.filter(F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    staff = supplier.filter("s_suppkey % 10 > 0").select("s_suppkey", "s_name")
    rows = lineitem.join(mine, F.col("l_orderkey") == F.col("o_orderkey")).join(staff, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(seen, "l_partkey", "left")
    flag = F.col("l_returnflag")
    state = F.when(flag == "N", "pending").when(flag == "A", "approved").otherwise("rejected")
    days = F.floor((F.unix_micros(now().cast("timestamp")) - F.unix_micros(F.col("l_shipdate").cast("timestamp"))) / F.lit(86_400_000_000))
    return rows.select("l_orderkey", "l_linenumber", F.col("c_name").alias("client"), F.coalesce("s_name", F.lit("Unassigned")).alias("recruiter"), state.alias("state"), F.coalesce("seen", F.lit(False)).alias("reviewed_elsewhere"), F.when(flag == "N", days).alias("days_waiting"))


@query("lineitem", sql="""
SELECT l_shipdate::date AS day, l_returnflag AS state, count(*) AS submissions, count(DISTINCT l_partkey) AS candidates, count(DISTINCT l_orderkey) AS jobs, count(DISTINCT l_suppkey) AS recruiters FROM lineitem GROUP BY 1, 2""")
def submission_stats(lineitem: DataFrame) -> DataFrame:
    distinct = [F.count_distinct(c).alias(n) for c, n in (("l_partkey", "candidates"), ("l_orderkey", "jobs"), ("l_suppkey", "recruiters"))]
    return lineitem.groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("state")).agg(F.count(F.lit(1)).alias("submissions"), *distinct)


@query("lineitem", sql="""
WITH r AS (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM lineitem)
SELECT l_suppkey AS reviewer, count(*) AS reviews, count(DISTINCT l_partkey) AS candidates, round(avg(l_discount * 10)::double, 4) AS rating, count(*) FILTER (WHERE l_returnflag = 'A') AS approved,
  round(100.0::double * count(*) FILTER (WHERE l_returnflag = 'A') / count(*), 2) AS approval_rate, max(l_shipdate) AS last_at, arg_max(l_returnflag, (l_shipdate, id)) AS last_state FROM r GROUP BY 1""")
def review_stats(lineitem: DataFrame) -> DataFrame:
    """Reviewers with ratings, approvals and their latest decision."""
    last = F.max(F.struct("l_shipdate", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag"))
    yes = F.count_if(F.col("l_returnflag") == "A")
    out = lineitem.groupBy(F.col("l_suppkey").alias("reviewer")).agg(F.count(F.lit(1)).alias("reviews"), F.count_distinct("l_partkey").alias("candidates"), F.round(F.avg(F.col("l_discount") * 10), 4).alias("rating"), yes.alias("approved"), F.round(yes * 100.0 / F.count(F.lit(1)), 2).alias("approval_rate"), last.alias("m"))
    return out.select("reviewer", "reviews", "candidates", "rating", "approved", "approval_rate", F.col("m.l_shipdate").alias("last_at"), F.col("m.l_returnflag").alias("last_state"))


@query("events", "customer", "supplier", sql="""
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'Placed with ' || coalesce(c_name, 'nobody') WHEN 'error' THEN 'Failed at ' || coalesce(s_name, 'nowhere') ELSE upper(event_type[1]) || event_type[2:] END AS said,
  count(*) OVER (PARTITION BY ts::date, event_type) AS same_day FROM events LEFT JOIN customer ON event_type = 'purchase' AND c_custkey = user_id LEFT JOIN supplier ON event_type = 'error' AND s_suppkey = user_id""")
def activity_feed(events: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Activity as text, each kind with a name from its own table, and how often its kind came that day."""
    kind = F.col("event_type")
    names = events.join(customer, (kind == "purchase") & (F.col("c_custkey") == F.col("user_id")), "left").join(supplier, (kind == "error") & (F.col("s_suppkey") == F.col("user_id")), "left")
    said = F.when(kind == "purchase", F.concat(F.lit("Placed with "), F.coalesce("c_name", F.lit("nobody")))).when(kind == "error", F.concat(F.lit("Failed at "), F.coalesce("s_name", F.lit("nowhere")))).otherwise(F.concat(F.upper(F.left(kind, F.lit(1))), F.substring(kind, 2, 100)))
    day = events.groupBy(F.to_date("ts").alias("day"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("same_day"))
    return names.select("event_id", said.alias("said"), F.to_date("ts").alias("day"), kind.alias("kind")).join(day, ["day", "kind"]).select("event_id", "said", "same_day")


@query("orders", "lineitem", sql="""
WITH s AS (SELECT l_orderkey, count(*) AS submitted, count(*) FILTER (WHERE l_returnflag <> 'N') AS interviewed, count(*) FILTER (WHERE l_returnflag = 'A') AS offered, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS joined FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderpriority AS priority, coalesce(submitted, 0) AS submitted, coalesce(interviewed, 0) AS interviewed, coalesce(offered, 0) AS offered, coalesce(joined, 0) AS joined, greatest(0, o_orderkey % 4 + 1 - coalesce(joined, 0)) AS left_open,
  CASE WHEN coalesce(submitted, 0) = 0 THEN 'sourcing' WHEN interviewed = 0 THEN 'screening' WHEN offered = 0 THEN 'interviews' WHEN joined < o_orderkey % 4 + 1 THEN 'offers' ELSE 'closed' END AS stage FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def pipeline_board(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Jobs by how far their submissions came, with the openings that are left."""
    flag = F.col("l_returnflag")
    s = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("submitted"), when_count(flag != "N", "interviewed"), when_count(flag == "A", "offered"), when_count((flag == "A") & (F.col("l_linestatus") == "F"), "joined"))
    rows = orders.join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left").fillna(0, ["submitted", "interviewed", "offered", "joined"])
    openings = F.col("o_orderkey") % 4 + 1
    stage = F.when(F.col("submitted") == 0, "sourcing").when(F.col("interviewed") == 0, "screening").when(F.col("offered") == 0, "interviews").when(F.col("joined") < openings, "offers").otherwise("closed")
    return rows.select("o_orderkey", F.col("o_orderpriority").alias("priority"), "submitted", "interviewed", "offered", "joined", F.greatest(F.lit(0).cast("long"), openings - F.col("joined")).alias("left_open"), stage.alias("stage"))
