"""Job descriptions in prose, saved searches as jobs, certificates and places, telephone numbers of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import strings as S
from corvane.operators import matching as M
from corvane.operators import postings as P
from corvane.operators.rows import spread
from corvane.queries.registry import query

text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _postings(part: DataFrame) -> DataFrame:
    """Job descriptions in five layouts, with pay in several units and periods, and some that say nothing."""
    k, size = F.col("p_partkey"), F.col("p_size")
    thing = F.initcap(F.element_at(F.split("p_name", " "), -1))
    level = F.element_at(F.array(*map(F.lit, ["Senior ", "Junior ", "Lead ", "", "Director "])), (size % 5 + 1).cast("int"))
    job = text(level, thing, " Engineer")
    firm = text("Maker ", size)
    pay = (
        F.when(k % 7 == 0, text("$", size + 60, "k - $", size + 90, "k per year")).when(k % 7 == 1, text("€", size + 20, " per hour")).when(k % 7 == 2, text(size + 5, "-", size + 12, " LPA"))
        .when(k % 7 == 3, text("GBP ", size + 3, ",500 per month")).when(k % 7 == 4, text("$", size + 100, ",000 to $", size + 50, ",000")).otherwise("a fair wage of 2 kinds")
    )
    asks = F.when(k % 3 == 0, text(size % 6 + 1, "-", size % 6 + 4, " years of work")).when(k % 3 == 1, text(size % 9 + 1, "+ years asked")).otherwise("some practice")
    tail = text(". ", pay, ". ", asks, ".\n- make ", F.col("p_type"), " things\n* sell them\n", F.when(k % 4 == 0, "Remote, contract.").when(k % 4 == 1, "Hybrid work, part-time.").otherwise("Come in."))
    place = text("Town", k % 9)
    said = (
        F.when(k % 5 == 0, text("Job title: ", job, "\nCompany: ", firm, "\nLocation: ", place, "\nAbout us", tail))
        .when(k % 5 == 1, text(job, "\nWe are small", ". Come and work at ", firm, " soon. Our office in ", place, tail))
        .when(k % 5 == 2, text("Hello there.\n", firm, " is looking for a ", job, " based in ", place, tail))
        .when(k % 5 == 3, text("A note.\n", job, " (m/f)\nJoin us", tail))
        .otherwise(text("Nothing much is said here", tail))
    )
    return part.select("p_partkey", F.when(k % 17 == 16, F.lit(None)).otherwise(said).alias("t"))


@query("part", sql="""
WITH p AS (SELECT *, p_partkey AS k, p_size AS s, ['Senior ', 'Junior ', 'Lead ', '', 'Director '][p_size % 5 + 1] AS l, string_split(p_name, ' ')[-1] AS w FROM part),
q AS (SELECT *, l || upper(w[1]) || lower(w[2:]) || ' Engineer' AS job FROM p WHERE k % 17 <> 16),
m AS (SELECT *, CASE k % 7 WHEN 0 THEN (s + 60) * 1000 WHEN 1 THEN s + 20 WHEN 2 THEN (s + 5) * 100000 WHEN 3 THEN (s + 3) * 1000 + 500 WHEN 4 THEN (s + 50) * 1000 END::double AS low,
  CASE k % 7 WHEN 0 THEN (s + 90) * 1000 WHEN 1 THEN s + 20 WHEN 2 THEN (s + 12) * 100000 WHEN 3 THEN (s + 3) * 1000 + 500 WHEN 4 THEN (s + 100) * 1000 END::double AS high,
  CASE k % 3 WHEN 0 THEN s % 6 + 1 WHEN 1 THEN s % 9 + 1 END AS asked FROM q)
SELECT p_partkey, CASE WHEN k % 5 < 4 THEN job END AS title, CASE WHEN k % 5 < 3 THEN 'Maker ' || s END AS company, CASE WHEN k % 5 < 3 THEN 'Town' || k % 9 END AS location,
  CASE WHEN k % 5 < 4 AND l <> '' THEN ['senior', 'junior', 'lead', '', 'executive'][s % 5 + 1] WHEN asked >= 8 THEN 'lead' WHEN asked >= 5 THEN 'senior' WHEN asked >= 2 THEN 'mid' WHEN asked IS NOT NULL THEN 'junior' ELSE 'mid' END AS level,
  CASE k % 4 WHEN 0 THEN 'contract' WHEN 1 THEN 'part_time' ELSE 'full_time' END AS employment, CASE k % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' ELSE 'onsite' END AS remote,
  low, high, CASE k % 7 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'INR' WHEN 3 THEN 'GBP' WHEN 4 THEN 'USD' END AS currency, high * CASE k % 7 WHEN 1 THEN 2080 WHEN 3 THEN 12 ELSE 1 END AS year_high, asked::int AS min_years, 'make ' || p_type || ' things/sell them' AS duties FROM m
UNION ALL SELECT p_partkey, NULL, NULL, NULL, 'mid', 'full_time', 'onsite', NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 17 = 16""")
def posting_prose(part: DataFrame) -> DataFrame:
    out = P.read_postings(_postings(spread(part)), "p_partkey", "t")
    return out.select("p_partkey", "title", "company", "location", "level", "employment", "remote", "pay.low", "pay.high", "pay.currency", "pay.year_high", F.col("years.low").alias("min_years"), F.array_join("duties", "/").alias("duties"))


@query("customer", sql="""
SELECT c_custkey, lower(c_mktsegment) || ' engineer' AS title, CASE c_custkey % 3 WHEN 0 THEN 'sql,c_' || c_nationkey WHEN 1 THEN 'go,spark' ELSE '' END AS skills, CASE WHEN c_custkey % 4 < 3 THEN c_nationkey % 7 END::int AS low,
  CASE WHEN c_custkey % 4 = 0 THEN c_nationkey % 7 + 3 END::int AS high, CASE WHEN c_custkey % 5 = 0 THEN 'master' END AS degree, CASE c_custkey % 2 WHEN 0 THEN 'Rome, Town ' || c_nationkey ELSE '' END AS location FROM customer""")
def searched_postings(customer: DataFrame) -> DataFrame:
    """Saved searches, one a customer, as the jobs that they stand for."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    none = F.array().cast("array<string>")
    searches = customer.select(
        "c_custkey", F.concat(F.lower("c_mktsegment"), F.lit(" engineer")).alias("role"), F.when(k % 3 == 0, F.array(F.lit("SQL"), text("C_", n))).when(k % 3 == 1, F.array(F.lit("Go"), F.lit("Spark"))).otherwise(none).alias("skills"),
        F.when(k % 4 < 3, (n % 7).cast("double")).alias("min_years"), F.when(k % 4 == 0, (n % 7 + 3).cast("double")).alias("max_years"), F.when(k % 2 == 0, F.array(F.lit("Rome"), text("Town ", n))).alias("locations"), F.when(k % 5 == 0, "Master").otherwise("").alias("degree"),
    )
    out = P.searched_postings(searches, "c_custkey", ["sql", "spark", "go"])
    return out.select("c_custkey", "title", F.array_join("skills", ",").alias("skills"), "low", "high", "degree", "location")


@query("customer", "nation", sql="""
WITH r AS (SELECT c_custkey, c_custkey % 4 AS k, lower(n_name) AS n, lower(c_mktsegment) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, CASE k WHEN 3 THEN 100 ELSE least(100, round(100 * ((contains('knows ' || s || ' and boats', s)::int + (k = 1)::int) + ((k = 2)::int + contains('knows ' || s || ' and boats', 'oats')::int * 0)) / 2.0)) END::double AS certificates,
  CASE WHEN k = 3 THEN 100 WHEN k = 2 THEN 0 WHEN contains(n, 'an') OR contains('an', n) THEN 100 ELSE 0 END::double AS place FROM r""")
def wanted_scores(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Certificates (the segment and 'diving') and places ('an') against what a customer's row says."""
    k = F.col("c_custkey") % 4
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.concat(F.lit("Knows "), F.lower("c_mktsegment"), F.lit(" and boats"))
    held = F.when(k == 1, F.array(F.concat(F.lit("Master of "), "c_mktsegment"))).when(k == 2, F.array(F.lit("DIVING I")))
    wanted: Column = F.when(k == 3, F.array().cast("array<string>")).otherwise(F.array(F.col("c_mktsegment"), F.lit("diving")))
    place = F.when(k == 2, F.lit(None)).otherwise(F.col("n_name"))
    return rows.select("c_custkey", M.certification_score(said, held, wanted).alias("certificates"), M.location_score(place, F.when(k != 3, F.array(F.lit("AN")))).alias("place"))


@query("pages", sql=r"""
SELECT page_id, '+1 (555) ' || lpad((page_id % 1000)::varchar, 3, '0') || '-' || lpad((page_id * 7 % 10000)::varchar, 4, '0') || ',+49 301 ' || lpad((page_id % 1000)::varchar, 3, '0') || ' 4567' AS phones FROM pages""")
def page_phones(pages: DataFrame) -> DataFrame:
    """Telephone numbers put into whole pages beside digits that are none."""
    three, four = F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0"), F.lpad((F.col("page_id") * 7 % 10000).cast("string"), 4, "0")
    extra = F.concat(F.lit("<p>Call +1 (555) "), three, F.lit("-"), four, F.lit(" or +49 301 "), three, F.lit(" 4567, not 0000000000, 2020-01-02 or 12345678901234567890</p> again +1 (555) "), three, F.lit("-"), four)
    return pages.select("page_id", F.array_join(F.array_distinct(S.real_phones(F.concat(F.regexp_replace("html", "[0-9]", "x"), extra))), ",").alias("phones"))
