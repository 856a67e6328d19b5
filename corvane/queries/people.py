"""Records of people and jobs: names against lists, histories and job texts, lists and JSON, feedback and tasks.

The example tables hold no resumes, so their columns are put into texts of the usual shapes; the SQL says what must come
out again from the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import dates as D
from corvane.functions import lists as L
from corvane.functions import strings as S
from corvane.operators import histories as H
from corvane.operators import people as P
from corvane.operators import records as R
from corvane.operators import resumes as T
from corvane.operators import schooling as E
from corvane.operators import tagging as G
from corvane.operators.rows import spread
from corvane.queries.registry import query

NOW = "1998-08-02"
text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
joined = lambda c: F.array_join(c, ",")


@query("nation", sql="""
WITH q AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'X' || n_name[2:] ELSE n_name || 's' END AS name FROM nation)
SELECT name, match, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, match) AS rn FROM (
  SELECT q.name, n.n_name AS match, 1 - levenshtein(lower(q.name), lower(n.n_name)) / greatest(length(q.name), length(n.n_name))::double AS score FROM q CROSS JOIN nation n)) WHERE rn = 1 AND score >= 0.7""")
def levenshtein_match(nation: DataFrame) -> DataFrame:
    typed = nation.select(F.when(F.col("n_nationkey") % 2 == 0, text("X", F.substring("n_name", 2, 100))).otherwise(text(F.col("n_name"), "s")).alias("name"))
    return P.fuzzy_match(typed, "name", nation, "n_name", 0.7).select("name", "match", F.round("score", 6).alias("score"))


_TYPED = """
SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN '  ' WHEN 1 THEN 'Java' WHEN 2 THEN ')' WHEN 3 THEN 'abc' WHEN 4 THEN n_name WHEN 5 THEN n_name || 's' WHEN 6 THEN 'big ' || lower(c_mktsegment) || ' ltd'
  WHEN 7 THEN 'Zzyx Qwvk' WHEN 8 THEN 'Zzyxq' ELSE 'zzyx qwvk no' END AS name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _typed(customer: DataFrame, nation: DataFrame) -> DataFrame:
    k, n = F.col("c_custkey") % 10, F.col("n_name")
    case = F.when(k == 0, "  ").when(k == 1, "Java").when(k == 2, ")").when(k == 3, "abc").when(k == 4, n).when(k == 5, text(n, "s")).when(k == 6, text("big ", F.lower("c_mktsegment"), " ltd"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", case.when(k == 7, "Zzyx Qwvk").when(k == 8, "Zzyxq").otherwise("zzyx qwvk no").alias("name"))


@query("customer", "nation", sql=f"""
WITH t AS ({_TYPED}), f AS (SELECT *, 1 - 1 / (length(n_name) + 1)::double AS near FROM t)
SELECT c_custkey, k NOT IN (0, 1, 2, 3, 9) AND (k <> 5 OR true) AS valid, CASE WHEN k IN (0, 1, 2, 3, 9) THEN '' WHEN k = 5 AND near >= 0.85 THEN n_name ELSE name END AS corrected,
  CASE k WHEN 4 THEN 1.0 WHEN 5 THEN CASE WHEN near >= 0.85 THEN round(near, 6) ELSE 0.6 END WHEN 6 THEN 0.7 WHEN 7 THEN 0.6 WHEN 8 THEN 0.6 ELSE 0 END::double AS confidence,
  CASE k WHEN 0 THEN 'empty' WHEN 1 THEN 'banned_word' WHEN 2 THEN 'invalid_format' WHEN 3 THEN 'fragment' WHEN 4 THEN 'exact_match' WHEN 5 THEN CASE WHEN near >= 0.85 THEN 'fuzzy_match' WHEN contains(n_name, ' ') THEN 'multi_word_capitalized' ELSE 'single_word_capitalized' END
    WHEN 6 THEN 'heuristic_match' WHEN 7 THEN 'multi_word_capitalized' WHEN 8 THEN 'single_word_capitalized' ELSE 'no_match' END AS reason
FROM (SELECT *, c_custkey % 10 AS k FROM f)""")
def company_check(customer: DataFrame, nation: DataFrame) -> DataFrame:
    out = P.check_entities(_typed(customer, nation), "name", nation, "n_name", "company", ["java", "python"])
    return out.select("c_custkey", "valid", "corrected", F.round("confidence", 6).alias("confidence"), "reason")


_ROLES = """
t AS (SELECT n, row_number() OVER (ORDER BY n) AS place, n || ' maker' AS syn, 's_' || replace(n, ' ', '_') AS skill FROM (SELECT DISTINCT p_name AS n FROM part WHERE p_size < 40)),
a AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'Senior  ' || p_name WHEN 2 THEN p_name || ' Maker' WHEN 3 THEN string_split(p_name, ' ')[-1] ELSE 'x' || p_name END AS role FROM part),
k AS (SELECT role, trim(regexp_replace(lower(role), '\\s+', ' ', 'g')) AS r FROM a)"""


@query("part", sql=f"""
WITH {_ROLES},
m AS (SELECT role, skill, CASE WHEN r = n THEN 1 WHEN r = syn THEN 2 ELSE 3 END AS step, place FROM k JOIN t ON r = n OR r = syn OR contains(' ' || r || ' ', ' ' || n || ' ') OR contains(' ' || n || ' ', ' ' || r || ' '))
SELECT k.role, coalesce(arg_min(skill, (step, place)) || ',all', '') AS skills FROM k LEFT JOIN m USING (role) GROUP BY k.role""")
def role_lookup(part: DataFrame) -> DataFrame:
    """Roles named after parts, with other words, other case and a part of their words, looked up in a table of parts."""
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    names = part.filter("p_size < 40").select("p_name").distinct()
    table = names.select(
        F.row_number().over(Window.orderBy("p_name")).alias("place"), F.col("p_name").alias("role"), F.array(text(name, " maker")).alias("synonyms"),
        F.array(text("s_", F.replace(name, F.lit(" "), F.lit("_")))).alias("required"), F.array(F.lit("all")).alias("preferred"),
    )
    asked = F.when(k == 0, F.upper(name)).when(k == 1, text("Senior  ", name)).when(k == 2, text(name, " Maker")).when(k == 3, F.element_at(F.split(name, " "), -1)).otherwise(text("x", name))
    return P.role_skills(part.select(asked.alias("role")), "role", table).select("role", joined("skills").alias("skills"))


@query("orders", sql="""
WITH v AS (SELECT o_orderstatus, lower(t) AS k, t, count(*) AS n FROM (SELECT o_orderstatus, CASE o_custkey % 5 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN lower(o_orderpriority) ELSE left(o_orderpriority, 3) || lower(o_orderpriority[4:]) END AS t FROM orders) GROUP BY ALL)
SELECT o_orderstatus, t AS item FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, k ORDER BY n DESC, t) AS rn FROM v) WHERE rn = 1""")
def commonest_spelling(orders: DataFrame) -> DataFrame:
    p, k = F.col("o_orderpriority"), F.col("o_custkey") % 5
    item = F.when(k == 0, F.upper(p)).when(k == 1, F.lower(p)).otherwise(F.concat(F.left(p, F.lit(3)), F.lower(F.substring(p, 4, 100))))
    return P.commonest_spelling(orders.select("o_orderstatus", item.alias("item")), ["o_orderstatus"], "item")


#: Titles and firms that histories are made of, and the shapes in which a record is written.
_TITLES, _FIRMS = ["Senior Analyst", "Software Engineer", "Clerk", "Team Lead"], ["Acme {} Ltd", "Nova {} Systems", "Harbour {}"]


def _record(k: Column, title: Column, firm: Column, a: Column, b: Column) -> Column:
    """One record in the shape numbered ``k``; dates are given to the month, in shape 4 to the year, and in 2 and 5 they are open."""
    m = lambda c, f: F.date_format(c, f)
    return (
        F.when(k == 0, text(title, " | ", firm, " | ", m(a, "MMM yyyy"), " - ", m(b, "MMM yyyy"), "\n"))
        .when(k == 1, text(title, "\n", firm, "\n", m(a, "MMM. yyyy"), " – ", m(b, "MMM. yyyy"), "\n- kept ", F.month(a), " books\n• wrote\n"))
        .when(k == 2, text(firm, "\n", m(a, "MM/yyyy"), " to till date\n", title, "\n* sold ", F.year(a), "\n"))
        .when(k == 3, text(m(a, "MMM''yy"), " - ", m(b, "MMMM yyyy"), "\n", title, " at ", firm, "\nled the work of the house there.\n"))
        .when(k == 4, text(title, " @ ", firm, "  ", m(a, "yyyy"), " - ", m(b, "yyyy"), "\nEnvironment: paper and pen\n"))
        .otherwise(text("Company: ", firm, "\nRole: ", title, "\nDuration: since ", m(a, "yyyy-MM"), "\nResponsibilities:\n- ran ", F.month(a), "\n"))
    )


def _history(orders: DataFrame) -> DataFrame:
    """Texts of one to three records in mixed shapes, with other sections, blank lines and dates that are none; some without, some null."""
    n, d = F.col("o_orderkey"), F.col("o_orderdate")
    c = F.col("o_custkey")
    title = lambda i: F.element_at(F.array(*map(F.lit, _TITLES)), ((c + i) % 4 + 1).cast("int"))
    firm = lambda i: F.element_at(F.array(*[text(f.split("{}")[0], c + i, f.split("{}")[1]) for f in _FIRMS]), ((c + i) % 3 + 1).cast("int"))
    part = lambda i: _record((c + n * i) % 6, title(i), firm(i), F.add_months(d, -40 - 30 * i), F.add_months(d, -15 - 30 * i))
    more = F.when(n % 3 > 0, part(1)).otherwise("")
    last = F.when(n % 3 == 2, text("\n\n", part(2))).otherwise("")
    full = text("Work Experience\n", part(0), more, last, "Education\nSome College, 2001 - 2004\n")
    said = F.when(c % 11 == 0, F.lit(None)).when(c % 11 == 1, text("Worked as a master of ceremonies in 1999, then left.\n\nLikes ", title(0), "s")).otherwise(full)
    return orders.select("o_orderkey", said.alias("text"))


_SHAPES = """
WITH r AS (SELECT o_orderkey, i, o_custkey, (o_custkey + o_orderkey * i) % 6 AS k, o_orderdate - to_months((40 + 30 * i)::int) AS a, o_orderdate - to_months((15 + 30 * i)::int) AS b
  FROM orders, range(3) t(i) WHERE o_custkey % 11 > 1 AND i <= o_orderkey % 3)
SELECT o_orderkey, (i + 1)::int AS nth, ['Senior Analyst', 'Software Engineer', 'Clerk', 'Team Lead'][(o_custkey + i) % 4 + 1] AS title,
  ['Acme ' || (o_custkey + i) || ' Ltd', 'Nova ' || (o_custkey + i) || ' Systems', 'Harbour ' || (o_custkey + i)][(o_custkey + i) % 3 + 1] AS company,
  date_trunc(CASE WHEN k = 4 THEN 'year' ELSE 'month' END, a)::date AS start,
  CASE WHEN k IN (2, 5) THEN date '{now}' WHEN k = 4 THEN date_trunc('year', b)::date ELSE date_trunc('month', b)::date END AS "end", k IN (2, 5) AS current,
  CASE k WHEN 0 THEN '' WHEN 1 THEN 'kept ' || month(a) || ' books/wrote' WHEN 2 THEN 'sold ' || year(a) WHEN 3 THEN 'led the work of the house there.' WHEN 4 THEN 'Environment: paper and pen' ELSE 'Responsibilities:/ran ' || month(a) END AS details
FROM r"""


@query("orders", sql=_SHAPES.format(now=NOW))
def experience_records(orders: DataFrame) -> DataFrame:
    out = H.experience_records(_history(spread(orders)), "o_orderkey", "text", NOW)
    return out.select("o_orderkey", "nth", "title", "company", "start", "end", "current", F.array_join("details", "/").alias("details"))


def _schooling(customer: DataFrame) -> DataFrame:
    """Two degrees in several layouts beside prose, other sections and dates that belong to none; some texts without, some null."""
    k, field = F.col("c_custkey"), F.initcap(F.col("c_mktsegment"))
    year = 1990 + F.col("c_nationkey")
    grade = F.round(F.pmod(F.floor(F.abs("c_acctbal")), F.lit(40)) / 10.0, 1)
    first = (
        F.when(k % 4 == 0, text("Bachelor of Science in ", field, ", University of Nation ", F.col("c_nationkey"), ", ", year, " - ", year + 4, ", GPA 3.", k % 10, "\n"))
        .when(k % 4 == 1, text("B.Tech (", field, ")\nIIT Nation ", F.col("c_nationkey"), "\n", year, "-", year + 4, "\nCGPA: ", grade + 5, "/10\n"))
        .when(k % 4 == 2, text("Nation ", F.col("c_nationkey"), " College\nB.Sc in ", field, " | ", year + 3, "\nPercentage: 6", k % 10, ".5%\n"))
        .otherwise(text("• Bachelor of Arts - ", "Academy of Nation ", F.col("c_nationkey"), " (", year, " - ", year + 3, ")\n"))
    )
    second = F.when(k % 3 == 0, F.lit("Master of Arts in History | Some College | 2016 | gpa: 3.5")).when(k % 3 == 1, F.lit("Diploma\nEvening School of Trade")).otherwise(F.lit("read books in 2001"))
    full = text("Education\nWorked as a master of ceremonies at a hotel in 1987.\n", first, "nothing here\n", second, "\n\n\nmember since 2011")
    return customer.select("c_custkey", F.when(k % 13 == 0, F.lit(None)).when(k % 13 == 1, F.lit("An associate of mine will be at the college in 1999.")).otherwise(full).alias("text"))


_DEGREES = """
SELECT c_custkey, (CASE k % 4 WHEN 0 THEN 'Bachelor of Science' WHEN 1 THEN 'B.Tech' WHEN 2 THEN 'B.Sc' ELSE 'Bachelor of Arts' END) AS degree, CASE WHEN k % 4 < 3 THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS field,
  CASE k % 4 WHEN 0 THEN 'University of Nation ' || n WHEN 1 THEN 'IIT Nation ' || n WHEN 2 THEN 'Nation ' || n || ' College' ELSE 'Academy of Nation ' || n END AS institution,
  CASE WHEN k % 4 <> 2 THEN 1990 + n END AS start_year, 1990 + n + CASE k % 4 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 4 END AS end_year,
  CASE k % 4 WHEN 0 THEN 3 + (k % 10) / 10.0::double WHEN 1 THEN round((floor(abs(c_acctbal))::bigint % 40) / 10.0::double, 1) + 5 WHEN 2 THEN 60 + k % 10 + 0.5::double END AS gpa,
  CASE k % 4 WHEN 0 THEN 4 WHEN 1 THEN 10 WHEN 2 THEN 100 END::double AS scale, 1 AS nth
FROM (SELECT *, c_custkey AS k, c_nationkey AS n FROM customer) WHERE k % 13 > 1
UNION ALL SELECT c_custkey, 'Master of Arts', 'History', 'Some College', NULL, 2016, 3.5, 4, 2 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 13 > 1
UNION ALL SELECT c_custkey, 'Diploma', NULL, 'Evening School of Trade', NULL, NULL, NULL, NULL, 2 FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 13 > 1"""


def _degrees(customer: DataFrame) -> DataFrame:
    return E.education_records(_schooling(spread(customer)), "c_custkey", "text")


@query("customer", sql=f"SELECT * FROM ({_DEGREES})")
def education_records(customer: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("c_custkey").orderBy("place"))
    return _degrees(customer).withColumn("nth", nth).withColumn("gpa", F.round("gpa", 2)).drop("place")


@query("customer", sql=f"SELECT c_custkey, degree FROM ({_DEGREES}) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY CASE left(degree, 1) WHEN 'M' THEN 4 WHEN 'B' THEN 3 ELSE 2 END DESC, nth) = 1")
def highest_degree(customer: DataFrame) -> DataFrame:
    return P.highest_degree(_degrees(customer), "c_custkey", "place", "degree").select("c_custkey", "degree")


@query("customer", sql=f"""
SELECT c_custkey, count(*) AS total_degrees, arg_min(degree, (CASE left(degree, 1) WHEN 'M' THEN 1 WHEN 'B' THEN 2 ELSE 3 END, nth)) AS highest_degree, string_agg(DISTINCT institution, ',' ORDER BY institution) AS institutions,
  coalesce(string_agg(DISTINCT field, ',' ORDER BY field), '') AS fields, round(avg(gpa), 2) AS average_gpa, coalesce(greatest(max(end_year), max(start_year)) - least(min(start_year), min(end_year)), 0) AS span_years FROM ({_DEGREES}) GROUP BY c_custkey""")
def education_summary(customer: DataFrame) -> DataFrame:
    out = P.education_summary(_degrees(customer), "c_custkey")
    return out.withColumn("institutions", joined("institutions")).withColumn("fields", joined("fields"))


@query("lineitem", sql=f"""
WITH d AS (SELECT DISTINCT l_suppkey, l_shipdate::date AS s, (l_shipdate + to_days(cast(l_quantity * 3 AS int)))::date AS e FROM lineitem),
f AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w THEN 1 ELSE 0 END AS new FROM d WINDOW w AS (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM f), m AS (SELECT l_suppkey, i, min(s) AS s, max(e) AS e FROM g GROUP BY 1, 2)
SELECT * FROM (SELECT l_suppkey, round(sum((year(e) - year(s)) * 12 + month(e) - month(s)) / 12.0::double)::int AS summed, round(date_diff('day', min(s), date '{NOW}') / 365.25::double, 1) AS since_first
  FROM (SELECT l_suppkey, l_shipdate::date AS s, (l_shipdate + to_days(cast(l_quantity * 3 AS int)))::date AS e FROM lineitem) GROUP BY 1)
JOIN (SELECT l_suppkey, round(sum(date_diff('day', s, e)) / 365.25::double, 1) AS merged FROM m GROUP BY 1) USING (l_suppkey)""")
def experience_variants(lineitem: DataFrame) -> DataFrame:
    start = F.to_date("l_shipdate")
    jobs = lineitem.select("l_suppkey", start.alias("s"), F.date_add(start, (F.col("l_quantity") * 3).cast("int")).alias("e"))
    return P.experience_variants(jobs, "l_suppkey", "s", "e", NOW)


@query("orders", sql="""
WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_custkey % 75 AS n, (o_custkey % 9) / 2.0::double AS h FROM orders),
s AS (SELECT *, CASE k WHEN 0 THEN CASE WHEN n BETWEEN 1 AND 60 THEN n END WHEN 1 THEN CASE WHEN h > 0 THEN h END WHEN 2 THEN CASE WHEN n BETWEEN 1 AND 60 THEN n ELSE CASE WHEN h > 0 THEN h END END WHEN 3 THEN n % 12 + 1 WHEN 4 THEN n % 30 + 2 END::double AS stated FROM o)
SELECT o_orderkey, stated, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 2.5 END, stated)::double AS best FROM s""")
def stated_experience(orders: DataFrame) -> DataFrame:
    """Years said in several ways, some too many, some of something else, some not at all."""
    k, n, h = F.col("o_orderkey") % 7, F.col("o_custkey") % 75, (F.col("o_custkey") % 9) / 2.0
    says = (
        F.when(k == 0, text("has ", n, "+ years of experience")).when(k == 1, text("Over ", h, " yrs in trade")).when(k == 2, text(n, " years of work. Experience of\t", h, " years")).when(k == 3, text("total ~ ", n % 12 + 1, "years, aged 40 years"))
        .when(k == 4, text("They bring a combined ", n % 30 + 2, " years.")).when(k == 5, text("born ", n, " years ago"))
    )
    y = P.stated_years(says)
    return orders.select("o_orderkey", y.alias("stated"), P.best_years(F.when(F.col("o_orderkey") % 2 == 0, 2.5), y).alias("best"))


@query("events", sql="""
SELECT count(*) AS total_records, count(*) FILTER (WHERE event_type = 'error') AS low_confidence_cases, count(*) FILTER (WHERE event_type = 'purchase') AS user_corrections, count(*) FILTER (WHERE event_type = 'error' AND value > 5) AS reviewed_cases,
  count(*) FILTER (WHERE event_type = 'purchase' AND user_id % 2 = 0) AS processed_corrections, count(*) FILTER (WHERE event_type = 'error' AND NOT value > 5) AS pending_review, count(*) FILTER (WHERE event_type = 'purchase' AND user_id % 2 = 1) AS pending_processing FROM events""")
def feedback_statistics(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "low_confidence").when(F.col("event_type") == "purchase", "user_correction").otherwise("other")
    return P.feedback_statistics(events.select(kind.alias("type"), (F.col("value") > 5).alias("reviewed"), (F.col("user_id") % 2 == 0).alias("processed")))


@query("conversations", sql="SELECT conv_id, turn, turn % 3 = 0 AND turn % 2 = 0 AS valid FROM conversations")
def valid_tasks(conversations: DataFrame) -> DataFrame:
    t = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, "  ")
    labels = F.when(F.col("turn") % 2 == 0, F.array("role"))
    return conversations.select("conv_id", "turn", P.valid_task(t, labels).alias("valid"))


@query("part", sql="""
SELECT p_partkey, 'Senior ' || p_brand || ' Engineer' AS title, 'Maker ' || p_size AS company, 'Town ' || p_partkey % 9 AS location, 'senior' AS seniority, CASE WHEN p_partkey % 2 = 0 THEN 'contract' ELSE 'full_time' END AS employment,
  '$' || (p_size + 50) || ',000' AS salary_from, '$' || (p_size + 90) || ',000' AS salary_to, p_size % 9 + 1 AS min_years, CASE WHEN p_partkey % 3 = 0 THEN p_size % 9 + 4 END AS max_years, 'bachelor' AS degree, 'sql,c++' AS required, 'spark' AS preferred, 'keep ' || lower(p_type) || ' lines;test' AS duties FROM part""")
def job_parse(part: DataFrame) -> DataFrame:
    years = F.when(F.col("p_partkey") % 3 == 0, text(F.col("p_size") % 9 + 1, "-", F.col("p_size") % 9 + 4, " years")).otherwise(text(F.col("p_size") % 9 + 1, "+ years"))
    kind = F.when(F.col("p_partkey") % 2 == 0, "contract").otherwise("full-time")
    t = text("Job title: Senior ", F.col("p_brand"), " Engineer\nCompany: Maker ", F.col("p_size"), "\nLocation: Town ", F.col("p_partkey") % 9, "\nA ", kind, " post, $", F.col("p_size") + 50, ",000 - $", F.col("p_size") + 90, ",000. Needs ", years, " and a bachelor degree; SQL, C++.\n- keep ", F.lower("p_type"), " lines\n- test\nNice to have: Spark and SQL")
    out = P.parse_job(spread(part).select("p_partkey", t.alias("t")), "p_partkey", "t", ["sql", "c++", "spark", "rust"])
    return out.withColumns({"required": joined("required"), "preferred": joined("preferred"), "duties": F.array_join("duties", ";")})


@query("events", sql="""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || ',x' WHEN 1 THEN event_type WHEN 4 THEN '["broken' ELSE '' END AS items, event_id % 5 = 0 AS holds_x, json_extract_string(props, '$.k') AS k, lower(concat_ws(' ', event_type, CASE WHEN event_id % 5 = 0 THEN event_type || ' x' END)) AS blob FROM events""")
def lenient_json(events: DataFrame) -> DataFrame:
    m, e = F.col("event_id") % 5, F.col("event_type")
    raw = F.when(m == 0, text('["', e, '", "x"]')).when(m == 1, e).when(m == 2, " ").when(m == 4, '["broken')
    blob = L.blob(e, F.lit(" "), F.when(m == 0, L.words(L.json_list(raw))))
    return events.select("event_id", joined(L.json_list(raw)).alias("items"), L.json_holds(raw, ["x"]).alias("holds_x"), L.first_path(F.col("props"), "$.none", "$.a.b", "$.k").alias("k"), blob.alias("blob"))


@query("orders", sql="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'python core,big sql warehouse,misc,a much longer thing' ELSE 'python core,big sql warehouse,misc,O and a much longer thing' END AS important,
  CASE WHEN o_orderstatus = 'F' THEN 'a much longer thing,big sql warehouse,python core,misc' ELSE 'O and a much longer thing,big sql warehouse,python core,misc' END AS longest FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def list_orders(orders: DataFrame) -> DataFrame:
    rows = orders.filter(F.col("o_orderstatus").isin("F", "O"))
    last = F.when(F.col("o_orderstatus") == "F", "a much longer thing").otherwise(text(F.col("o_orderstatus"), " and a much longer thing"))
    items = F.array(last, F.lit("misc"), F.lit("big sql warehouse"), F.lit("python core"))
    return rows.select("o_orderkey", joined(L.by_importance(items, ["python"], ["sql"], ["cobol"])).alias("important"), joined(L.longest_first(items)).alias("longest"))


@query("part", sql="""
SELECT p_partkey, lower(p_name) AS squeezed, 'host/' || p_partkey AS url, CASE WHEN p_partkey % 3 = 0 THEN 'javascript' ELSE 'go ' || p_partkey END AS canonical, p_partkey % 3 = 0 AS has_js, p_partkey % 2 = 0 AS same_role, p_partkey % 5 = 0 AS disposable, 'x' || p_partkey || '@real.org' AS mails,
  CASE p_partkey % 4 WHEN 0 THEN 'junior' WHEN 1 THEN 'senior' WHEN 2 THEN 'executive' ELSE 'mid' END AS level, '%senior data engineer%,%data engineer%' AS patterns FROM part""")
def text_keys(part: DataFrame) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_name")
    skill = F.when(k % 3 == 0, "  JS ").otherwise(text("Go  ", k))
    role = F.when(k % 2 == 0, "Sr. Software Developer").otherwise("Tester")
    html = text("<a>x", k, "@real.org</a> logo@2x.png y@example.com X", k, "@REAL.org")
    title = F.when(k % 4 == 0, "Junior Clerk").when(k % 4 == 1, "Sr Clerk").when(k % 4 == 2, "Director").otherwise("Clerk")
    return part.select(
        "p_partkey", S.squeeze(text("  ", F.replace(n, F.lit(" "), F.lit(" \t ")), " ")).alias("squeezed"), S.url_key(text(" HOST/", k, "/ ")).alias("url"), S.canonical(skill, {"js": "javascript"}).alias("canonical"),
        S.has_term(skill, [["js", "javascript"]])[0].alias("has_js"), S.role_match(role, F.lit("software engineer")).alias("same_role"), S.disposable(text("a@", F.when(k % 5 == 0, "Temp.io").otherwise("b.org")), ["temp.io"]).alias("disposable"),
        joined(S.real_emails(html)).alias("mails"), S.seniority(title).alias("level"), F.lit(",".join(S.role_patterns("Senior Data Engineer"))).alias("patterns"),
    )


@query("orders", sql=f"""
SELECT o_orderkey, date_trunc('month', o_orderdate)::date AS s, CASE WHEN o_orderkey % 2 = 0 THEN date '{NOW}' ELSE make_date(1998, 1, 1) END AS e, floor(n / 365.25)::int || ' years ' || floor((n - floor(n / 365.25) * 365.25) / 30.436875)::int || ' months ' || floor(n - floor(n / 365.25) * 365.25 - floor((n - floor(n / 365.25) * 365.25) / 30.436875) * 30.436875)::int || ' days' AS span
FROM (SELECT *, (o_orderkey * 37 % 4000)::double AS n FROM orders)""")
def date_ranges(orders: DataFrame) -> DataFrame:
    said = text(F.date_format("o_orderdate", "MMM yyyy"), " - ", F.when(F.col("o_orderkey") % 2 == 0, "Present").otherwise("1998"))
    r = D.range_of(said, NOW)
    return orders.select("o_orderkey", r["start"].alias("s"), r["end"].alias("e"), D.span_text(F.col("o_orderkey") * 37 % 4000).alias("span"))


@query("orders", sql="""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderdate::date WHEN 4 THEN make_date(year(o_orderdate), 1, 1) WHEN 5 THEN date '1998-08-02' ELSE date_trunc('month', o_orderdate)::date END AS parsed FROM orders""")
def date_parse(orders: DataFrame) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    said = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MM/yyyy")).when(k == 2, F.date_format(d, "MMM yyyy")).when(k == 3, F.date_format(d, "MMMM yyyy")).when(k == 4, F.date_format(d, "yyyy")).otherwise("till date")
    return orders.select("o_orderkey", D.parse(said, NOW).alias("parsed"))


@query("conversations", sql="""
SELECT conv_id, turn, 'header' AS section, 'Name ' || role AS text FROM conversations
UNION ALL SELECT conv_id, turn, 'skills', CASE WHEN turn % 3 = 0 THEN 'sql' || chr(10) || 'go ' || turn ELSE 'go ' || turn END FROM conversations
UNION ALL SELECT conv_id, turn, 'experience', 'Clerk ' || conv_id FROM conversations WHERE turn % 3 < 2""")
def resume_sections(conversations: DataFrame) -> DataFrame:
    """Headings plain, with an edit and decorated; a section that repeats, one that is missing, in three shapes."""
    k = F.col("turn") % 3
    first, work = F.when(k == 0, "\nTechnical Skills:\nsql\n").otherwise("\n"), F.when(k < 2, text("\n** Work Histroy **\nClerk ", F.col("conv_id"))).otherwise("")
    rows = conversations.select(F.struct("conv_id", "turn").alias("k"), text("Name ", F.col("role"), first, work, "\nSkills\ngo ", F.col("turn")).alias("t"))
    return T.split_sections(rows, "k", "t").select("k.conv_id", "k.turn", "section", "text")


@query("part", sql="""
WITH l AS (SELECT p_partkey, p_partkey % 6 AS k, CASE p_partkey % 6 WHEN 0 THEN upper(p_name) || ':' WHEN 1 THEN array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], ' ') WHEN 2 THEN p_name || ' and ' || p_name || ' lie there.'
  WHEN 3 THEN 'Skills: ' || p_name || ',' WHEN 4 THEN upper(p_name) || ' OF ' || p_type || ' AND MORE' ELSE p_name END AS line FROM part),
n AS (SELECT *, len(string_split(line, ' ')) AS w FROM l)
SELECT p_partkey, round(greatest(0, least(1, CASE WHEN w <= 3 THEN 0.3 WHEN w <= 6 THEN 0.15 ELSE 0 END + CASE k WHEN 0 THEN 0.3 WHEN 4 THEN 0.3 WHEN 1 THEN 0.15 ELSE 0 END + CASE WHEN k = 0 THEN 0.2 ELSE 0 END
  + CASE WHEN k = 3 THEN 0.2 ELSE 0 END - CASE WHEN k IN (2, 3) THEN 0.3 ELSE 0 END)), 2)::double AS score FROM n""")
def heading_score(part: DataFrame) -> DataFrame:
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    line = F.when(k == 0, text(F.upper(n), ":")).when(k == 1, F.initcap(n)).when(k == 2, text(n, " and ", n, " lie there.")).when(k == 3, text("Skills: ", n, ",")).when(k == 4, text(F.upper(n), " OF ", F.col("p_type"), " AND MORE")).otherwise(n)
    return part.select("p_partkey", T.header_score(line).alias("score"))


@query("conversations", sql=r"""
WITH t AS (SELECT conv_id, turn, role, list_filter(regexp_extract_all(text, '\S+'), lambda x: true) AS w FROM conversations),
o AS (SELECT conv_id, turn, role, unnest(w) AS token, unnest(range(len(w))) AS p FROM t),
s AS (SELECT *, sum(length(token) + 1) OVER (PARTITION BY conv_id, turn ORDER BY p) - length(token) - 1 AS a FROM o),
h AS (SELECT *, CASE WHEN a < 25 AND a + length(token) > 4 THEN 'ROLE' WHEN a < 61 AND a + length(token) > 30 + turn THEN 'DATE' END AS kind FROM s),
g AS (SELECT *, lag(kind) OVER (PARTITION BY conv_id, turn ORDER BY p) AS before, lower(regexp_replace(token, '[.,;:]+$', '')) AS bare FROM h)
SELECT conv_id, turn, string_agg(CASE WHEN kind IS NULL THEN 'O' WHEN kind = before THEN 'I-' || kind ELSE 'B-' || kind END, ',' ORDER BY p) AS tags,
  string_agg(CASE WHEN regexp_matches(bare, '^(19|20)[0-9]{2}$') THEN 'B-DATE' WHEN bare IN ('the', 'die', 'que') THEN 'B-ROLE' WHEN bare IN ('in', 'en') THEN 'B-LOCATION' ELSE 'O' END, ',' ORDER BY p) AS weak FROM g GROUP BY 1, 2""")
def span_tags(conversations: DataFrame) -> DataFrame:
    """Whole texts' tokens tagged by two spans, the second of which moves with the turn, and by single words."""
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    flat = conversations.select("conv_id", "turn", F.array_join(words, " ").alias("t"))
    rows = T.tokens_with_offsets(flat.select(F.struct("conv_id", "turn").alias("k"), "t"), "k", "t")
    tokens = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "token"))).alias("t"))
    span = lambda a, b, kind: F.struct(a.cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(kind).alias("type"))
    spans = F.array(span(F.lit(4), 25, "ROLE"), span(30 + F.col("k.turn"), 61, "DATE"))
    weak = F.transform("t.token", lambda w: T.weak_tags(w, ["the", "die", "que"], ["in", "en"]))
    return tokens.select("k.conv_id", "k.turn", joined(G.tag_spans(F.col("t"), spans)).alias("tags"), joined(weak).alias("weak"))


_ENTS = "(SELECT lower(p_brand) AS text, CASE WHEN p_size % 2 = 0 THEN 'ORG' ELSE 'ROLE' END AS type FROM part UNION ALL SELECT p_size::varchar, 'DATE' FROM part WHERE p_size < 20)"


def _ents(part: DataFrame) -> DataFrame:
    a = part.select(F.col("p_brand").alias("text"), F.when(F.col("p_size") % 2 == 0, "ORG").otherwise("ROLE").alias("type"))
    return a.union(part.filter("p_size < 20").select(F.col("p_size").cast("string"), F.lit("DATE")))


@query("part", sql=f"SELECT text, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM {_ENTS} GROUP BY 1 HAVING count(DISTINCT type) > 1")
def ambiguous_entities(part: DataFrame) -> DataFrame:
    return G.ambiguous(_ents(part)).withColumn("types", joined("types"))


@query("part", sql=f"SELECT text, count(*) AS n FROM {_ENTS} WHERE length(text) = 1 OR regexp_full_match(text, '[0-9]+') GROUP BY 1")
def suspicious_entities(part: DataFrame) -> DataFrame:
    return G.suspicious(_ents(part)).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("part", sql=f"SELECT max(n) AS largest, min(n) AS smallest, round(max(n) / min(n)::double, 2) AS ratio, max(n) > 3 * min(n) AS uneven FROM (SELECT type, count(*) AS n FROM {_ENTS} GROUP BY 1)")
def uneven_classes(part: DataFrame) -> DataFrame:
    return G.uneven(_ents(part).withColumn("label", text("B-", F.col("type"))), "label", 3)


@query("lineitem", sql="""
SELECT l_orderkey, CASE WHEN a BETWEEN 2 AND 9 AND r <= 1 THEN 'experience' WHEN a <= 1 AND r BETWEEN 1 AND 9 THEN 'skills' WHEN a BETWEEN 2 AND 9 OR r <= 1 THEN 'experience' ELSE 'skills' END AS section
FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)""")
def section_fit(lineitem: DataFrame) -> DataFrame:
    prints = lineitem.sparkSession.createDataFrame([("experience", "A", 2, 9), ("experience", "R", 0, 1), ("skills", "A", 0, 1), ("skills", "R", 1, 9)], "section string, type string, low int, high int")
    counts = lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return T.section_fit(counts, "l_orderkey", prints).select("l_orderkey", "section")


@query("part", sql="""
SELECT p_partkey, 'sql' AS skills, p_size % 9 AS low, (p_size % 9 + 2)::int AS high, 'master' AS degree, p_partkey % 2 = 0 AS certified FROM part""")
def job_extract(part: DataFrame) -> DataFrame:
    t = text("Wanted: SQL, ", F.col("p_size") % 9, " to ", F.col("p_size") % 9 + 2, " years, Master degree", F.when(F.col("p_partkey") % 2 == 0, ", certified").otherwise(""))
    return T.extract_job(part.select("p_partkey", t.alias("t")), "p_partkey", "t", ["sql", "spark"]).withColumn("skills", joined("skills"))


@query("customer", sql="""
SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'model ' || c_custkey ELSE c_name END AS picked, CASE WHEN length(c_mktsegment) > length(c_name) THEN c_mktsegment ELSE c_name END AS longer, 'Sql,go,' || lower(c_mktsegment) AS skills, c_mktsegment || ',x' AS projects,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Ann Lee' END AS name, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE '+1 555 000 1111' END AS phone, 'sql' AS kept, 'invalid name' AS warning FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'model ' || c_custkey ELSE c_name END, CASE WHEN length(c_mktsegment) > length(c_name) THEN c_mktsegment ELSE c_name END, 'Sql,go,' || lower(c_mktsegment), c_mktsegment || ',x',
  'Ann Lee', CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE '+1 555 000 1111' END, 'sql', CASE WHEN c_custkey % 4 = 1 THEN 'invalid phone' ELSE '' END FROM customer WHERE c_custkey % 4 <> 0""")
def merge_and_validate(customer: DataFrame) -> DataFrame:
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    given, number = F.when(k % 4 == 0, "ann@lee").otherwise(" Ann Lee "), F.when(k % 4 == 1, "123").otherwise("+1 555 000 1111")
    name, phone = R.valid_name(given), R.valid_phone(number)
    skills = R.union_ignore_case(F.array(F.lit("Sql"), F.lit("go")), F.array(F.lit("SQL"), F.lower(seg)))
    return customer.select(
        "c_custkey", R.confident(F.col("c_name"), text("model ", k), F.col("c_acctbal"), 5000).alias("picked"), R.longer(F.col("c_name"), seg).alias("longer"), joined(skills).alias("skills"),
        joined(F.array_union(F.array(seg, seg), F.array(F.lit("x"), seg))).alias("projects"), name.alias("name"), phone.alias("phone"), joined(R.valid_skills(F.array(F.lit("sql"), F.lit("a"), F.lit("http://x"), F.lit("b@c.de")))).alias("kept"),
        joined(R.warnings([("name", given, name), ("phone", number, phone)])).alias("warning"),
    )
