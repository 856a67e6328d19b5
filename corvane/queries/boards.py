"""Reports of boards and lists: predicates, nested JSON, summaries, logs, dues, stages, searches with scores, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import lists as L
from corvane.functions import strings as S
from corvane.operators import filters as W
from corvane.operators import matching as M
from corvane.operators.dedupe import move_children
from corvane.operators.rows import page, seed_pairs
from corvane.plans.boolean_search import predicate
from corvane.plans.filter_search import Filters, filter_search
from corvane.queries.registry import query
from corvane.sources.writers import import_candidates, json_rows

NTZ = "timestamp_ntz"


@query("lineitem", sql="SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') AND l_linestatus NOT IN ('F')")
def not_in_list(lineitem: DataFrame) -> DataFrame:
    return lineitem.filter(W.not_in("l_returnflag", ["A", "R"]) & W.not_in("l_linestatus", ["F"])).select("l_orderkey", "l_linenumber")


@query("customer", sql="SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey % 4 END AS tenant FROM customer) WHERE tenant = 2 OR tenant IS NULL")
def tenant_rows(customer: DataFrame) -> DataFrame:
    rows = customer.withColumn("tenant", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey") % 4))
    return rows.filter(W.of_tenant("tenant", 2, shared=True)).select("c_custkey")


@query("orders", sql="""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'joined' WHEN o_orderkey % 3 = 0 THEN 'accepted' WHEN o_orderstatus = 'F' THEN 'extended' ELSE 'pending' END AS state FROM orders""")
def offer_states(orders: DataFrame) -> DataFrame:
    d = F.col("o_orderdate")
    rows = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", d).alias("extended_at"), F.when(F.col("o_orderkey") % 3 == 0, d).alias("accepted_at"), F.when(F.col("o_orderkey") % 5 == 0, d).alias("joined_at"))
    return rows.select("o_orderkey", W.state_of([("extended", "extended_at"), ("accepted", "accepted_at"), ("joined", "joined_at")], "pending").alias("state"))


@query("customer", sql="""
SELECT c_custkey FROM customer WHERE (c_custkey % 3 = 0 OR c_name ILIKE '%sql%' OR c_mktsegment ILIKE '%build%') AND c_custkey % 5 <> 0 AND c_acctbal >= 0""")
def live_with_skills(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    rows = customer.withColumn("skills", F.when(k % 3 == 0, F.array(F.lit("Build"), F.lit("go")))).withColumn("body", F.concat_ws(" ", "c_name", "c_mktsegment")).withColumn("status", F.when(k % 5 == 0, "deleted").when(k % 5 == 1, "open"))
    return rows.filter(W.has_skills("skills", "body", ["build"]) & W.not_deleted("status") & W.number_range("c_acctbal", 0)).select("c_custkey")


@query("lineitem", sql="""
SELECT a.l_orderkey, a.l_suppkey, a.n, b.returned FROM (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) a
LEFT JOIN (SELECT l_orderkey, l_suppkey, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey""")
def composite_key_left(lineitem: DataFrame) -> DataFrame:
    keys = ["l_orderkey", "l_suppkey"]
    every = lineitem.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    returned = lineitem.filter("l_returnflag = 'R'").groupBy(*keys).agg(F.count(F.lit(1)).alias("returned"))
    return every.join(returned, keys, "left")


@query("region", "nation", sql="SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation WHERE NOT EXISTS (SELECT 1 FROM nation x WHERE x.n_regionkey = r_regionkey AND x.n_nationkey = nation.n_nationkey)")
def seed_links(region: DataFrame, nation: DataFrame) -> DataFrame:
    present = nation.select(F.col("n_regionkey").cast("long").alias("r_regionkey"), F.col("n_nationkey").cast("long").alias("n_nationkey"))
    both = (region.select(F.col("r_regionkey").cast("long").alias("r_regionkey")), nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey")))
    return seed_pairs(*both, present)


@query("events", sql="SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def activity_by_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("customer", "orders", "lineitem", sql="""
SELECT c_custkey, coalesce(jobs, '[]') AS jobs FROM customer LEFT JOIN (
  SELECT o_custkey, to_json(list(struct_pack(id := o_orderkey, status := o_orderstatus, items := coalesce(n, 0)) ORDER BY o_orderkey))::varchar AS jobs
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey""")
def client_profiles(customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Clients with their jobs as a JSON array of objects, each with its own count."""
    n = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    jobs = orders.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    item = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.coalesce("n", F.lit(0)).alias("items"))
    by = jobs.groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("jobs"))
    return customer.join(by, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("jobs", F.lit("[]")).alias("jobs"))


@query("orders", "lineitem", "supplier", sql="""
WITH a AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), j AS (SELECT l_suppkey, count(*) AS jobs_count FROM a GROUP BY 1)
SELECT o_orderkey, count(DISTINCT a.l_suppkey) AS recruiters, count(DISTINCT CASE WHEN s_nationkey % 3 = 0 THEN a.l_suppkey END) AS of_my_team,
  coalesce(to_json(list(struct_pack(id := s_suppkey, name := lower(s_name), jobs_count := jobs_count) ORDER BY s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL))::varchar, '[]') AS assigned
FROM orders LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = a.l_suppkey LEFT JOIN j ON j.l_suppkey = a.l_suppkey GROUP BY 1""")
def team_requirements(orders: DataFrame, lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    links = lineitem.select("l_orderkey", "l_suppkey").distinct()
    people = links.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("jobs_count")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    item = F.struct(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("name"), "jobs_count")
    rows = links.join(people.drop("l_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    by = rows.groupBy("l_orderkey").agg(F.count("l_suppkey").alias("recruiters"), F.count_if(F.col("s_nationkey") % 3 == 0).alias("of_my_team"), F.array_sort(F.collect_list(F.when(F.col("s_suppkey").isNotNull(), item))).alias("l"))
    out = orders.join(by, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("o_orderkey", zero("recruiters"), zero("of_my_team"), F.coalesce(F.to_json("l"), F.lit("[]")).alias("assigned"))


@query("customer", "orders", "lineitem", "supplier", sql="""
SELECT 'clients' AS metric, count(*)::double AS value FROM customer UNION ALL SELECT 'active clients', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'open jobs', count(*) FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'placements', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'revenue', cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'submissions', count(*) FROM lineitem
UNION ALL SELECT 'interviews ahead', count(*) FROM lineitem WHERE l_shipdate >= timestamp '1998-06-01' UNION ALL SELECT 'recruiters', count(*) FROM supplier""")
def dashboard_summary(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """One pass over each table; every number becomes a row ``metric, value``."""
    is_open, filled = F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"
    one = F.count(F.lit(1))
    parts = [
        customer.agg(one.alias("clients")),
        orders.agg(F.countDistinct(F.when(is_open, F.col("o_custkey"))).alias("active clients"), F.count_if(is_open).alias("open jobs"), F.count_if(filled).alias("placements"), F.sum(F.when(filled, F.col("o_totalprice").cast("decimal(18,2)"))).alias("revenue")),
        lineitem.agg(one.alias("submissions"), F.count_if(F.col("l_shipdate") >= F.expr(f"{NTZ} '1998-06-01'")).alias("interviews ahead")),
        supplier.agg(one.alias("recruiters")),
    ]
    rows = [p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in p.columns]))) for p in parts]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("events", "customer", sql="""
SELECT event_id, ts, event_type, c_name AS actor FROM events LEFT JOIN customer ON c_custkey = user_id WHERE ts BETWEEN timestamp '2024-01-01' AND timestamp '2024-01-20' AND event_type IN ('error', 'purchase') ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20""")
def audit_log(events: DataFrame, customer: DataFrame) -> DataFrame:
    """A page of the log; names are joined to the page's rows only."""
    rows = events.filter(W.date_range("ts", "2024-01-01", "2024-01-20", "2024-02-01") & F.col("event_type").isin("error", "purchase"))
    own = page(rows.select("event_id", "ts", "event_type", "user_id"), 2, 20, F.desc("ts"), F.col("event_id"))
    return own.join(customer.select("c_custkey", F.col("c_name").alias("actor")), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "ts", "event_type", "actor")


@query("orders", "customer", "supplier", sql="""
SELECT o_orderkey, c_name AS client, s_name AS contact, due FROM (SELECT *, CASE WHEN o_orderstatus <> 'F' THEN o_orderdate + INTERVAL 10 DAY END AS due FROM orders) JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = o_orderkey % 40
WHERE due IS NOT NULL AND due <= timestamp '1998-07-01' AND o_custkey % 3 = 1 ORDER BY due, o_orderkey LIMIT 50""")
def follow_ups_due(orders: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    due = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate") + F.expr("interval 10 days"))
    rows = orders.withColumn("due", due).filter((F.col("due") <= F.expr(f"{NTZ} '1998-07-01'")) & (F.col("o_custkey") % 3 == 1))
    first = rows.orderBy("due", "o_orderkey").limit(50)
    named = first.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("o_orderkey") % 40 == F.col("s_suppkey"), "left")
    return named.select("o_orderkey", F.col("c_name").alias("client"), F.col("s_name").alias("contact"), "due")


@query("customer", "orders", sql="""
WITH c AS (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, coalesce(max(o_totalprice), 0) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, CASE WHEN NOT n > 0 THEN 'first order' WHEN NOT n > 5 THEN 'regular' WHEN NOT top > 300000 THEN 'large order' WHEN NOT o = 0 THEN 'settled' ELSE 'done' END AS stage,
  CASE WHEN NOT n > 0 THEN 0 WHEN NOT n > 5 THEN 25 WHEN NOT top > 300000 THEN 50 WHEN NOT o = 0 THEN 75 ELSE 100 END AS progress FROM c""")
def ordered_stages(customer: DataFrame, orders: DataFrame) -> DataFrame:
    by = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.max("o_totalprice").alias("top"))
    c = customer.join(by, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["n", "o", "top"])
    stage, progress = L.first_unmet([("first order", F.col("n") > 0), ("regular", F.col("n") > 5), ("large order", F.col("top") > 300000), ("settled", F.col("o") == 0)], "done")
    return c.select("c_custkey", stage.alias("stage"), progress.alias("progress"))


@query("customer", "nation", sql="""
SELECT c_custkey, score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair' ELSE 'Poor' END AS label FROM (
  SELECT c_custkey, round(100 * 0.5::double + least(100, y * 100.0::double / 4) * 0.2::double + 100 * 0.1::double + CASE WHEN b THEN 100 ELSE 50 END * 0.1::double + CASE WHEN m THEN 100 ELSE 75 END * 0.05::double + 100 * 0.05::double, 1) AS score
  FROM (SELECT c_custkey, c_custkey % 12 AS y, c_mktsegment = 'BUILDING' AS b, c_custkey % 2 = 0 AS m, c_nationkey FROM customer) JOIN nation ON c_nationkey = n_nationkey WHERE y >= 4 AND y <= 9 AND n_nationkey IN (1, 3, 5, 7) AND c_custkey % 11 <> 0)
ORDER BY score DESC, c_custkey LIMIT 10""")
def scored_search(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Search by filters in two stages: hard predicates, then scores of what is left."""
    k = F.col("c_custkey")
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("id"), F.lit("Senior Data Engineer").alias("title"), F.array(F.lit("sql"), F.lit("spark")).alias("skills"), (k % 12).alias("years"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("location"),
        F.when(k % 2 == 0, "Master of Arts").otherwise("Bachelor").alias("degree"), F.concat(F.lit("sql "), F.when(F.col("c_mktsegment") == "BUILDING", "and spark").otherwise("alone")).alias("text"), F.when(k % 11 == 0, "deleted").alias("status"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    f = Filters(role="data engineer", skills=["sql", "spark"], min_years=4, max_years=9, locations=["n1", "n3", "N5", "n7"], degree="master")
    return filter_search(people, f, 1, 10).select(F.col("id").alias("c_custkey"), "score", "label")


@query("documents", sql="""
SELECT doc_id FROM documents WHERE (text ILIKE '%moron%' OR text ILIKE '%der%') AND NOT text ILIKE '%trash%' AND n_chars <= 5000 AND lang IN ('en', 'de') ORDER BY n_chars DESC, doc_id LIMIT 15 OFFSET 15""")
def boolean_page(documents: DataFrame) -> DataFrame:
    """The boolean language joined to base filters, order and page."""
    found = documents.filter(predicate("(moron OR der) NOT trash", "text") & W.number_range("n_chars", None, 5000) & W.in_list("lang", "en,de"))
    return page(found.select("doc_id", "n_chars"), 2, 15, F.desc("n_chars"), F.col("doc_id")).select("doc_id")


@query("part", sql="""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 100.0 ELSE 30.0 END::double AS role, CASE p_partkey % 3 WHEN 0 THEN 40.0 WHEN 1 THEN 50.0 ELSE 100.0 END::double AS project, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.5 END::double AS required, 1.0::double AS preferred,
  'sql' AS matching, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'go' END AS missing FROM part""")
def sub_scores(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    title = F.when(k % 2 == 0, "Data Engineer").otherwise("Data Clerk")
    body = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, "sql alone").otherwise("SQL and go")
    have, want = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("sql"), F.lit("go"))).otherwise(F.array(F.lit("sql"))), F.array(F.lit("sql"), F.lit("go"))
    req, pref = M.skill_parts(have, want, F.array().cast("array<string>"))
    why = M.explain_skills(have, F.when(F.col("p_size") % 2 == 0, F.array(F.lit("sql"))).otherwise(want))
    return part.select("p_partkey", M.role_score(title, "data engineer").alias("role"), M.project_score(body, ["sql", "go"]).alias("project"), req.alias("required"), pref.alias("preferred"), F.array_join(why["matching"], ",").alias("matching"), F.array_join(why["missing"], ",").alias("missing"))


_IMPORT = """
SELECT c_custkey, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'Team' || c_nationkey || '@x.org' ELSE ' c' || c_custkey || '@X.org' END AS email, CASE WHEN c_custkey % 2 = 0 THEN '555' END AS phone, CASE WHEN c_custkey % 3 = 0 THEN 'sql; go;' ELSE '' END AS skills FROM customer"""


@query("customer", sql=f"""
WITH r AS ({_IMPORT}), k AS (SELECT *, lower(trim(email)) AS mail FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY mail ORDER BY c_custkey) AS rn FROM k)
SELECT c_custkey, round(0.4 + CASE WHEN mail <> '' THEN 0.15 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN skills <> '' THEN 0.2 ELSE 0 END, 2)::double AS confidence, CASE WHEN skills <> '' THEN 'sql,go' ELSE '' END AS skills
FROM f WHERE coalesce(mail, '') = '' OR (rn = 1 AND mail <> 'team7@x.org')""")
def import_rows(customer: DataFrame) -> DataFrame:
    """Rows without an e-mail all enter; of equal e-mails the first, unless it is known."""
    k = F.col("c_custkey")
    email = F.when(k % 4 == 0, "").when(k % 4 == 2, F.concat(F.lit("Team"), F.col("c_nationkey").cast("string"), F.lit("@x.org"))).when(k % 4 == 3, F.concat(F.lit(" c"), k.cast("string"), F.lit("@X.org")))
    rows = customer.select("c_custkey", F.col("c_name").alias("name"), email.alias("email"), F.when(k % 2 == 0, "555").alias("phone"), F.when(k % 3 == 0, "sql; go;").otherwise("").alias("skills"))
    known = customer.sparkSession.createDataFrame([("team7@x.org",)], "m string").select(F.md5("m").alias("email_key"))
    return import_candidates(rows, known).select("c_custkey", "confidence", F.array_join("skills", ",").alias("skills"))


@query("region", sql="""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS value FROM region""")
def json_objects(region: DataFrame) -> DataFrame:
    return json_rows(region.select("r_regionkey", "r_name"))


@query("nation", sql="SELECT n_nationkey, 'https://www.google.com/search?q=site%3Ax.org+%22' || replace(n_name, ' ', '+') || '%22' AS address FROM nation")
def xray_searches(nation: DataFrame) -> DataFrame:
    return nation.select("n_nationkey", S.xray_url("x.org", F.concat(F.lit('"'), "n_name", F.lit('"'))).alias("address"))


@query("customer", sql="""
WITH c AS (SELECT c_custkey, c_custkey % 6 AS k, c_custkey AS i, lower(c_mktsegment) AS s, c_nationkey AS n FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN 'linkedin.com/in/c-' || i WHEN 1 THEN 'linkedin.com/in/' || s || '-' || n || ',linkedin.com/in/c-' || i WHEN 5 THEN NULL ELSE '' END AS linkedin,
  CASE k WHEN 0 THEN 'github.com/c' || i WHEN 2 THEN 'github.com/' || s WHEN 5 THEN NULL ELSE '' END AS github,
  CASE k WHEN 0 THEN 'https://site.org/p' || i WHEN 3 THEN 'https://' || s || '.org/a' || n || ',https://x.net/' || i WHEN 5 THEN NULL ELSE '' END AS sites,
  CASE k WHEN 0 THEN 'Rome, NY' WHEN 4 THEN 'Oslo, TX' WHEN 5 THEN NULL ELSE '' END AS place,
  CASE k WHEN 0 THEN '2020-01-02' WHEN 3 THEN (1990 + n) || '-0' || (n % 9 + 1) || '-15,2021-12-31' WHEN 5 THEN NULL ELSE '' END AS dates,
  CASE k WHEN 0 THEN i % 30 + 5 WHEN 1 THEN n + 1 WHEN 4 THEN CASE WHEN i % 90 BETWEEN 1 AND 60 THEN i % 90 END END::int AS years FROM c""")
def contact_extract(customer: DataFrame) -> DataFrame:
    """What texts say of persons: several hits, one, none, and null texts."""
    k, i, n, s = F.col("c_custkey") % 6, F.col("c_custkey").cast("string"), F.col("c_nationkey"), F.lower("c_mktsegment")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    said = (
        F.when(k == 0, text("See https://linkedin.com/in/c-", i, " and https://github.com/c", i, ", or https://site.org/p", i, ". Lives in Rome, NY since 2020-01-02. 3 years, later ", F.col("c_custkey") % 30 + 5, "+ years."))
        .when(k == 1, text("linkedin.com/in/", s, "-", n, " or linkedin.com/in/c-", i, ", again linkedin.com/in/c-", i, " for ", n + 1, " years"))
        .when(k == 2, text("code at github.com/", s, ", no more")).when(k == 3, text("https://", s, ".org/a", n, ": https://x.net/", i, "? on ", n + 1990, "-0", n % 9 + 1, "-15 and 2021-12-31"))
        .when(k == 4, text("From Oslo, TX, with ", F.col("c_custkey") % 90, " years"))
    )
    out = customer.select("c_custkey", said.alias("t"))
    every = lambda p: F.array_join(S.extract_all(F.col("t"), p), ",")
    return out.select("c_custkey", every(S.LINKEDIN).alias("linkedin"), every(S.GITHUB).alias("github"), F.array_join(S.websites(F.col("t")), ",").alias("sites"), every(S.CITY_STATE).alias("place"), every(S.DATE).alias("dates"), S.years_of_experience(F.col("t")).alias("years"))


@query("customer", sql="""
WITH c AS (SELECT *, c_custkey % 4 AS k, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS seg FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN 'Work Of ' || seg || chr(10) || '- built things and ran them' || chr(10) || '- it''s "done", café ' || c_custkey WHEN 1 THEN 'plain ' || lower(c_mktsegment) || ' goes on, and on' || chr(10) || 'Ends ' || c_nationkey
  WHEN 2 THEN seg || chr(10) || '- a ' || c_nationkey || chr(10) || '- b' END AS body FROM c""")
def text_repair(customer: DataFrame) -> DataFrame:
    """Misread signs, lists, lines that go on and titles in capitals; texts with none of these, and null ones."""
    k, seg, i, n = F.col("c_custkey") % 4, F.col("c_mktsegment"), F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    first = F.concat(F.lit("WORK OF "), seg, F.lit("  \n\u2022 built things and\nran  them\n\u25cf itâ€™s \u201cdone\u201d, cafÃ© "), i, F.lit(" \n"))
    t = F.when(k == 0, first).when(k == 1, F.concat(F.lit("plain "), F.lower(seg), F.lit(" goes on,\nand   on\nEnds "), n)).when(k == 2, F.concat(seg, F.lit("\n\u2022 a "), n, F.lit("\n\u25cf b  ")))
    return customer.select("c_custkey", S.repair_text(t).alias("body"))


@query("lineitem", sql="""
WITH c AS (SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_orderkey % 10 = 3 AS moved, CASE WHEN l_orderkey % 10 = 3 THEN l_orderkey - 1 ELSE l_orderkey END AS parent FROM lineitem)
SELECT parent AS l_orderkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY parent, l_suppkey ORDER BY moved, l_linenumber * 1000000 + l_partkey) AS rn FROM c) WHERE NOT moved OR rn = 1""")
def children_moved(lineitem: DataFrame) -> DataFrame:
    """Orders ending in 3 are duplicates of those before them; their lines move unless the supplier is there already."""
    pairs = lineitem.filter("l_orderkey % 10 = 3").select((F.col("l_orderkey") - 1).alias("first_id"), F.col("l_orderkey").alias("id")).distinct()
    rows = lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("o"))
    return move_children(rows, "l_orderkey", pairs, ["l_suppkey"], "o").drop("o")


@query("orders", "customer", "nation", sql="""
SELECT n_name AS team, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS closures, count(DISTINCT o_custkey) AS clients, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def team_closures(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    rows = orders.filter("o_orderstatus = 'F'").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    by = rows.groupBy("o_custkey", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"))  # before the joins
    team = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("team"))
    out = by.join(team, F.col("o_custkey") == F.col("c_custkey")).groupBy("team", "period")
    return out.agg(F.sum("n").alias("closures"), F.count(F.lit(1)).alias("clients"), F.sum("p").cast("double").alias("revenue"))


@query("lineitem", sql="""
SELECT l_returnflag, count(DISTINCT l_orderkey) AS jobs, count(DISTINCT l_suppkey) AS recruiters, count(DISTINCT l_partkey) AS skills, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_orderkey END) AS large, count(*) AS n FROM lineitem GROUP BY 1""")
def several_distincts(lineitem: DataFrame) -> DataFrame:
    d = F.countDistinct
    return lineitem.groupBy("l_returnflag").agg(d("l_orderkey").alias("jobs"), d("l_suppkey").alias("recruiters"), d("l_partkey").alias("skills"), d(F.when(F.col("l_quantity") > 25, F.col("l_orderkey"))).alias("large"), F.count(F.lit(1)).alias("n"))


@query("orders", "customer", "lineitem", sql="""
WITH p AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25)
SELECT o_orderkey AS job, c_name AS client, count(l_orderkey) AS submissions, count(*) FILTER (WHERE l_returnflag = 'A') AS accepted, count(DISTINCT l_suppkey) AS recruiters,
  CASE WHEN NOT count(l_orderkey) > 0 THEN 'open' WHEN NOT count(*) FILTER (WHERE l_returnflag = 'A') > 0 THEN 'submitted' WHEN o_orderstatus <> 'F' THEN 'accepted' ELSE 'filled' END AS stage
FROM p JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, c_name, o_orderstatus""")
def dashboard_jobs(orders: DataFrame, customer: DataFrame, lineitem: DataFrame) -> DataFrame:
    """A page of jobs with the counts of these jobs only."""
    jobs = page(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), 2, 25, F.desc("o_orderdate"), F.col("o_orderkey"))
    own = lineitem.join(F.broadcast(jobs.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")  # 25 rows
    by = own.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("submissions"), F.count_if(F.col("l_returnflag") == "A").alias("accepted"), F.countDistinct("l_suppkey").alias("recruiters"))
    out = jobs.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(by, F.col("o_orderkey") == F.col("l_orderkey"), "left").na.fill(0, ["submissions", "accepted", "recruiters"])
    stage, _ = L.first_unmet([("open", F.col("submissions") > 0), ("submitted", F.col("accepted") > 0), ("accepted", F.col("o_orderstatus") == "F")], "filled")
    return out.select(F.col("o_orderkey").alias("job"), F.col("c_name").alias("client"), "submissions", "accepted", "recruiters", stage.alias("stage"))


@query("customer", "nation", "orders", sql="""
SELECT c_custkey, c_name AS company, n_name AS country, open_jobs, last_job FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_jobs, max(o_orderdate) AS last_job FROM orders GROUP BY 1) ON o_custkey = c_custkey
WHERE (c_name ILIKE '%1%' OR n_name ILIKE '%1%') AND c_acctbal BETWEEN 0 AND 8000 ORDER BY last_job DESC NULLS LAST, c_custkey LIMIT 20""")
def company_list(customer: DataFrame, nation: DataFrame, orders: DataFrame) -> DataFrame:
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).filter(W.contains_any("1", ["c_name", "n_name"]) & W.number_range("c_acctbal", 0, 8000))
    by = orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_jobs"), F.max("o_orderdate").alias("last_job"))
    out = rows.join(by, F.col("c_custkey") == F.col("o_custkey"), "left").orderBy(F.desc_nulls_last("last_job"), "c_custkey").limit(20)
    return out.select("c_custkey", F.col("c_name").alias("company"), F.col("n_name").alias("country"), "open_jobs", "last_job")
