"""Job descriptions in prose: title, company, place, pay, years, level and duties, with or without labels; and postings made from searches.

Everything is read by patterns on the JVM, each text part bound once.  What a label says goes first; without one the title is the first
short line that names a job, or what someone 'is looking for'; the company who is looking; the level the one with most evidence, where
the title counts three times, and without any the years asked for decide.  Pay becomes numbers: thousands and lakhs are multiplied
out, and ``year`` amounts are those of the stated period (hour x 2080, day x 260, month x 12).

Defined cases: null and empty texts give nulls and the level 'mid'; a range turned round is put right; of several amounts the first that has a
currency, a unit or a period counts; very long texts are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.lists import bound
from corvane.operators.people import EMPLOYMENT, JOB_SIGNS
from corvane.operators.resumes import experience_asked, skills_in

_JOB = "|".join([*JOB_SIGNS, "scientist", "researcher", "teacher", "accountant", "recruiter", "writer", "editor", "clerk", "nurse", "driver"])
#: Words that tell a level, highest first; ties go to the higher.
LEVELS = [
    ("executive", r"chief|\bc[etof]o\b|vice president|\bvp\b|director|head of"), ("lead", r"\blead\b|principal|staff engineer|architect|team lead"), ("senior", r"\bsenior\b|\bsr\b\.?|expert|seasoned"),
    ("mid", r"mid[- ]?level|intermediate"), ("junior", r"\bjunior\b|\bjr\b\.?|entry[- ]level|graduate|fresher"), ("intern", r"\bintern(?:ship)?\b|trainee"),
]
_N = r"[0-9][0-9,]*(?:\.[0-9]+)?"
_UNIT = r"(?:\s?(?:k\b|lpa\b|lakhs?\b|lacs?\b|m(?:illion)?\b))"
_CODE = r"(?:[$€£₹]|\b(?:usd|eur|gbp|inr|rs)\b\.?)"
_PERIOD = r"(?:\s*(?:/|per|an?|p\.?)\s*(?:hour|hr|day|month|mo|year|yr|annum|a\.?)\b)"
PAY = rf"(?i)(?:{_CODE}\s*{_N}{_UNIT}?(?:\s*(?:-|–|to)\s*{_CODE}?\s*{_N}{_UNIT}?)?{_PERIOD}?|{_N}(?:\s*(?:-|–|to)\s*{_N})?(?:{_UNIT}{_PERIOD}?|{_PERIOD}))"
_FACTOR = {"hour": 2080.0, "day": 260.0, "month": 12.0, "year": 1.0}


def pay_of(text: Column) -> Column:
    """``struct(low, high, currency, period, year_low, year_high)`` of the first stated pay; nulls without one."""

    def number(raw: Column) -> Column:
        return F.regexp_replace(raw, ",", "").try_cast("double")

    def unit(t: Column) -> Column:
        return F.when(t.rlike(r"\bk\b|[0-9]k\b"), 1e3).when(t.rlike(r"lpa\b|lakhs?\b|lacs?\b"), 1e5).when(t.rlike(r"[0-9]\s?m(?:illion)?\b"), 1e6).otherwise(1.0)

    def read(t: Column) -> Column:
        amounts = F.transform(F.regexp_extract_all(t, F.lit(_N), F.lit(0)), number)
        currency = F.when(t.rlike(r"\$|usd"), "USD").when(t.rlike("€|eur"), "EUR").when(t.rlike("£|gbp"), "GBP").when(t.rlike(r"₹|inr|\brs\b|lpa|lakh|lac"), "INR")
        period = F.when(t.rlike(r"hour|\bhr\b"), "hour").when(t.rlike(r"\bday\b"), "day").when(t.rlike(r"month|\bmo\b"), "month").otherwise("year")

        def ends(a: Column) -> Column:
            times = reduce(lambda out, p: F.when(period == p[0], p[1]).otherwise(out), _FACTOR.items(), F.lit(1.0))
            low, high = F.array_min(a) * unit(t), F.array_max(a) * unit(t)
            return F.struct(low.alias("low"), high.alias("high"), currency.alias("currency"), period.alias("period"), (low * times).alias("year_low"), (high * times).alias("year_high"))

        return F.when(t != "", bound(F.slice(amounts, F.lit(1), F.lit(2)), ends))

    return bound(F.lower(F.regexp_extract(text, PAY, 0)), read)


def level_of(title: Column, text: Column, years: Column) -> Column:
    """The level with most evidence in title (three times) and text; without any by the years asked for."""
    low, head = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    scores = F.array(*[F.struct((F.regexp_count(head, F.lit(p)) * 3 + F.regexp_count(low, F.lit(p))).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, p) in enumerate(LEVELS)])
    by_years = F.when(years >= 8, "lead").when(years >= 5, "senior").when(years >= 2, "mid").when(years.isNotNull(), "junior").otherwise("mid")
    return bound(F.array_max(scores), lambda best: F.when(best["n"] > 0, best["name"]).otherwise(by_years))


def read_postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, title, company, location, level, employment, remote, pay, years, duties`` of each job description."""
    c = F.col(text)
    low = F.lower(c)
    labelled = lambda p: F.nullif(F.trim(F.regexp_extract(c, rf"(?im)^\W*(?:{p})\s*[:=-]\s*([^\n]+)$", 1)), F.lit(""))
    lines = F.slice(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1), F.lit(3))
    headline = F.get(F.filter(lines, lambda x: (F.size(F.split(x, " +")) <= 8) & ~x.rlike(r"[.:!?]$|:\s") & F.lower(x).rlike(rf"\b(?:{_JOB})\b")), F.lit(0))
    sought = F.regexp_extract(c, rf"(?:(?i:looking for|seeking|hiring|in search of)) (?i:an? )((?:[\w+#/-]+ ){{0,4}}(?i:{_JOB}))\b", 1)
    title = F.coalesce(labelled("job title|title|position|role"), F.regexp_replace(headline, r"\s*[|(–-]\s.*$|\s*\(.*$", ""), F.nullif(F.trim(sought), F.lit("")))
    name = r"((?:[A-Z][\w&.'-]*)(?: (?:[A-Z][\w&'-]*|[0-9]+))*)"
    company = F.coalesce(labelled("company|employer|organi[sz]ation"), F.nullif(F.regexp_extract(c, rf"{name} (?:is (?:looking|hiring|seeking|in search)|seeks|hires)\b", 1), F.lit("")), F.nullif(F.regexp_extract(c, rf"\b(?:at|join|with) {name}", 1), F.lit("")))
    location = F.coalesce(labelled("location|place|city|based in"), F.nullif(F.regexp_extract(c, r"\b(?:based in|located in|office in|onsite in) ([A-Z][\w-]*(?:,? [A-Z][\w-]*)*)", 1), F.lit("")))
    kind = F.coalesce(*[F.when(low.rlike(p), n) for n, p in EMPLOYMENT], F.lit("full_time"))
    remote = F.when(low.rlike(r"\bhybrid\b"), "hybrid").when(low.rlike(r"\bremote\b|work from home"), "remote").otherwise("onsite")
    duties = F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^ *[-•*] +(.+)$"), F.lit(1)), lambda x: F.trim(x))
    rows = df.select(key, c.alias("_text"), title.alias("title"), company.alias("company"), location.alias("location"), kind.alias("employment"), remote.alias("remote"), pay_of(c).alias("pay"), experience_asked(c).alias("years"), duties.alias("duties"))
    out = rows.withColumn("level", level_of(F.col("title"), F.col("_text"), F.col("years.low")))
    return out.select(key, "title", "company", "location", "level", "employment", "remote", "pay", "years", "duties")


def searched_postings(searches: DataFrame, key: str, known_skills: list[str]) -> DataFrame:
    """``key, text, title, skills, low, high, degree, location`` of the jobs that saved searches stand for: each search is written as a
    job, read like any job, and what the search itself says is put over it.

    ``searches(key, role, skills array, min_years, max_years, locations array, degree)``; nulls and empty lists say nothing.
    """
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    years = F.when(F.col("max_years").isNotNull(), F.concat(number("min_years"), F.lit("-"), number("max_years"), F.lit(" years"))).otherwise(F.concat(number("min_years"), F.lit("+ years")))
    listed = lambda c, head: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", ")))
    text = F.concat_ws(". ", F.nullif(F.trim("role"), F.lit("")), listed("skills", "Skills: "), F.when(F.col("min_years").isNotNull(), years), F.nullif(F.trim("degree"), F.lit("")), listed("locations", "Location: "))
    rows = searches.withColumn("text", text).withColumn("read", experience_asked(F.col("text"))).withColumn("named", skills_in(F.col("text"), known_skills))
    own = F.transform("skills", lambda s: F.lower(s))
    return rows.select(
        key, "text", F.col("role").alias("title"), F.when(F.size("skills") > 0, F.array_union(own, "named")).otherwise(F.col("named")).alias("skills"),
        F.coalesce(F.col("min_years").cast("int"), F.col("read.low")).alias("low"), F.coalesce(F.col("max_years").cast("int"), F.col("read.high")).alias("high"),
        F.nullif(F.lower(F.trim("degree")), F.lit("")).alias("degree"), F.coalesce(F.array_join("locations", ", "), F.lit("")).alias("location"),
    )
