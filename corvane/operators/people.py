"""Records of people: fuzzy names, entity checks, roles and their skills, histories read from text, education, experience, feedback."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.lists import bound
from corvane.functions.scoring import DEGREES
from corvane.functions.strings import similarity, squeeze
from corvane.operators.rows import keep_first, merge_intervals


def fuzzy_match(names: DataFrame, name: str, known: DataFrame, known_name: str, least: float = 0.85) -> DataFrame:
    """``name, match, score``: for each name the known one with the highest similarity, if that reaches ``least``.

    No pair that reaches ``least`` is missed, and names meet by equality of parts only: a known name of length n that is within
    d edits, cut into d + 1 parts, holds one of them unchanged, shifted by d places at most.  Case and white space are squeezed.
    Ties go to the smaller known name.
    """
    edits = lambda n: F.floor((1 - least) * F.floor(n / F.lit(least) + 1e-9) + 1e-9).cast("int")
    cut = lambda n, parts, i: F.floor(i * n / parts).cast("int")
    a = names.select(name).filter(F.trim(name) != "").distinct().withColumn("_q", squeeze(F.col(name)))
    b = known.select(F.col(known_name).alias("match")).filter(F.trim("match") != "").distinct().withColumn("_k", squeeze(F.col("match")))
    b = b.withColumn("_n", F.length("_k")).withColumn("_parts", edits(F.col("_n")) + 1)
    b = b.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("_lo", cut(F.col("_n"), F.col("_parts"), F.col("_i")))
    b = b.withColumn("_part", F.substring("_k", F.col("_lo") + 1, cut(F.col("_n"), F.col("_parts"), F.col("_i") + 1) - F.col("_lo"))).select("match", "_k", "_n", "_i", "_part")
    q = F.length("_q")
    a = a.withColumn("_n", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(q * least - 1e-9)).cast("int"), F.floor(q / F.lit(least) + 1e-9).cast("int"))))
    a = a.withColumn("_d", edits(F.col("_n"))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_d")))).withColumn("_lo", cut(F.col("_n"), F.col("_d") + 1, F.col("_i")))
    a = a.withColumn("_size", cut(F.col("_n"), F.col("_d") + 1, F.col("_i") + 1) - F.col("_lo"))
    first, last = F.greatest(F.lit(0), F.col("_lo") - F.col("_d")), F.least(q - F.col("_size"), F.col("_lo") + F.col("_d"))
    a = a.filter(first <= last).withColumn("_at", F.explode(F.sequence(first, last))).withColumn("_part", F.substring("_q", F.col("_at") + 1, F.col("_size")))
    pairs = a.select(name, "_q", "_n", "_i", "_part").join(b, ["_n", "_i", "_part"]).select(name, "_q", "match", "_k").distinct()
    scored = pairs.withColumn("score", similarity(F.col("_q"), F.col("_k"))).filter(F.col("score") >= least)
    return keep_first(scored, [F.col(name)], F.desc("score"), F.col("match")).select(name, "match", "score")


#: Words that make a name look like a company, and a title like a job.
COMPANY_SIGNS = ("ltd", "llc", "inc", "corp", "pvt", "limited", "technologies", "solutions", "systems", "services", "consulting", "group")
JOB_SIGNS = (
    "developer", "engineer", "manager", "architect", "analyst", "designer", "consultant", "specialist", "lead", "senior", "junior", "director", "coordinator",
    "administrator", "intern", "trainee", "programmer", "technician", "principal", "vp", "president", "ceo", "cto", "founder", "head", "chief", "officer", "leader",
    "executive", "associate", "assistant", "expert",
)


def check_entities(rows: DataFrame, name: str, known: DataFrame, known_name: str, kind: str = "company", banned: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``valid, corrected, confidence, reason``: banned words and shapes go first, then exact, fuzzy and likely names stay.

    ``kind`` is company or role; companies match at a similarity of 0.85, roles of 0.90.
    """
    company = kind == "company"
    t = F.trim(F.col(name))
    n_words = F.size(F.split(t, r"\s+"))
    given = rows.withColumn("_t", t)
    exact = known.select(F.col(known_name).alias("_t")).distinct().withColumn("_exact", F.lit(True))
    near = fuzzy_match(given.select("_t"), "_t", known, known_name, 0.85 if company else 0.90).withColumnRenamed("match", "_near").withColumnRenamed("score", "_score")
    both = given.join(exact, "_t", "left").join(near, "_t", "left")
    capital = F.substring(t, 1, 1).rlike(r"\p{Lu}")
    signs = reduce(Column.__or__, [F.lower(t).contains(w) for w in (COMPANY_SIGNS if company else JOB_SIGNS)])
    shapes = ["(", ")", "[", "]", ",", ".", "-", "_"] + ([] if company else ["S", "Data"])
    fragment = (n_words == 1) & (t == F.lower(t)) & t.rlike(r"\p{L}") & (F.length(t) < 5) if company else F.lit(False)
    reason = (
        F.when(t.isNull() | (t == ""), "empty").when(squeeze(t).isin([b.lower() for b in banned]), "banned_word").when((F.length(t) < 2) | t.isin(shapes), "invalid_format")
        .when(fragment, "fragment").when(F.col("_exact"), "exact_match").when(F.col("_near").isNotNull(), "fuzzy_match").when(signs, "heuristic_match")
        .when((n_words >= 2) & capital, "multi_word_capitalized").when((n_words == 1) & capital & F.lit(company), "single_word_capitalized").otherwise("no_match")
    )
    r = F.col("reason")
    sure = F.when(r == "exact_match", 1.0).when(r == "fuzzy_match", F.col("_score")).when(r == "heuristic_match", 0.7).when(r.endswith("_capitalized"), 0.6).otherwise(0.0)
    out = both.withColumn("reason", reason).withColumn("confidence", sure).withColumn("valid", F.col("confidence") > 0)
    kept = F.when(r == "fuzzy_match", F.col("_near")).when(F.col("valid"), t).otherwise("")
    return out.withColumn("corrected", kept).select(*rows.columns, "valid", "corrected", "confidence", "reason")


def _word_runs(name: Column) -> Column:
    """Every run of whole words of a name, each once."""
    return bound(F.split(name, " "), lambda w: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))))


def role_skills(roles: DataFrame, role: str, table: DataFrame) -> DataFrame:
    """``role, skills``: those of the entry of that name, else of the first entry with it among its synonyms, else of the first whose
    name holds it or is held by it in whole words; none without an entry.

    ``table(place, role, synonyms, required, preferred)`` is in order of ``place``.  Names meet by equality of their runs of words, so a
    table of any size is joined by its keys.
    """
    asked = roles.select(F.col(role).alias("_asked"), squeeze(F.col(role)).alias("_r")).filter("_r <> ''").distinct()
    t = table.select("place", squeeze(F.col("role")).alias("_name"), F.transform("synonyms", lambda x: squeeze(x)).alias("_syn"), F.concat("required", "preferred").alias("skills"))
    keys = t.select("place", "skills", F.explode(F.concat(F.array(F.struct(F.lit(1).alias("_step"), F.col("_name").alias("_r"))), F.transform("_syn", lambda x: F.struct(F.lit(2).alias("_step"), x.alias("_r"))))).alias("k"))
    whole = keys.select("place", "skills", "k.*").join(asked, "_r")
    held = asked.select("_asked", F.explode(_word_runs(F.col("_r"))).alias("_name")).join(t, "_name")
    holds = t.filter("_name <> ''").select("place", "skills", F.explode(_word_runs(F.col("_name"))).alias("_r")).join(asked, "_r")
    found = whole.select("_asked", "_step", "place", "skills")
    for partly in (held, holds):
        found = found.unionByName(partly.select("_asked", F.lit(3).alias("_step"), "place", "skills"))
    best = found.groupBy("_asked").agg(F.min_by("skills", F.struct("_step", "place")).alias("skills"))
    out = roles.select(role).distinct().join(best, F.col(role) == F.col("_asked"), "left")
    return out.select(role, F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))


def commonest_spelling(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """``keys, item``: of items equal but for case the spelling that comes most often (the smaller one in a tie)."""
    t = F.trim(F.col(item))
    n = df.filter(t != "").groupBy(*keys, F.lower(t).alias("_k"), t.alias(item)).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys, "_k").agg(F.min(F.struct((-F.col("_n")).alias("n"), item)).alias("_m")).select(*keys, F.col(f"_m.{item}").alias(item))


def degree_rank(c: Column) -> Column:
    """Level of the first keyword of the list that the degree holds, or that it abbreviates ('B.Tech', 'MSc'); 0 without one."""
    level = dict(DEGREES)
    short = [F.when(c.rlike(rf"^{letter}\.?\s?(?:Tech|Sc|Eng|Com|Phil|Ed|Arch|Des|CA|BA|S|A|E)\b"), level[name]) for letter, name in (("M", "master"), ("B", "bachelor"))]
    return F.coalesce(*[F.when(F.lower(c).contains(k), v) for k, v in DEGREES], *short, F.lit(0))


def highest_degree(df: DataFrame, key: str, place: str, degree: str) -> DataFrame:
    """The record of each key with the highest degree, the first of equals."""
    return keep_first(df, [F.col(key)], F.desc(degree_rank(F.col(degree))), F.col(place))


def education_summary(df: DataFrame, key: str) -> DataFrame:
    """Of education records: how many, the highest degree, institutions and fields, the mean grade and the years spanned."""
    years = F.array(F.max("end_year"), F.max("start_year"), F.min("start_year"), F.min("end_year"))
    out = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_degrees"), F.min(F.struct((-degree_rank(F.col("degree"))).alias("r"), "place", "degree")).alias("m"),
        F.array_sort(F.collect_set("institution")).alias("institutions"), F.array_sort(F.collect_set("field")).alias("fields"),
        F.round(F.avg("gpa"), 2).alias("average_gpa"), (F.coalesce(F.array_max(years) - F.array_min(years), F.lit(0))).alias("span_years"),
    )
    return out.select(key, "total_degrees", F.col("m.degree").alias("highest_degree"), "institutions", "fields", "average_gpa", "span_years")


_YEARS = r"[0-9]+(?:\.[0-9]+)?\s*\+?\s*(?:years?|yrs?)\b"
#: A number of years counts when its clause says what for, before or behind it.
_SAID = rf"(?:\b(?:exp(?:erience)?|total|combined|over|more than|around|about|approx(?:imately)?\.?)\b|~)[^.;\n0-9]{{0,30}}?{_YEARS}|{_YEARS}[^.;\n0-9]{{0,30}}?\b(?:exp(?:erience)?|work\w*|total|combined)\b"


def stated_years(text: Column) -> Column:
    """The first number of years that a text says of work and that is over 0 and up to 60, one digit."""
    said = F.transform(F.regexp_extract_all(F.lower(text), F.lit(_SAID), F.lit(0)), lambda s: F.regexp_extract(s, r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double"))
    return F.round(F.get(F.filter(said, lambda y: (y > 0) & (y <= 60)), F.lit(0)), 1)


def experience_variants(df: DataFrame, key: str, start: str, end: str, now: str) -> DataFrame:
    """``key, summed, since_first, merged``: years as the sum of months, from the first start until now, and without counting overlaps twice."""
    months = F.greatest(F.lit(0), (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start))
    day = F.lit(now).cast("date")
    plain = df.groupBy(key).agg(F.round(F.sum(months) / 12).cast("int").alias("summed"), F.round(F.datediff(day, F.min(start)) / 365.25, 1).alias("since_first"))
    spans = merge_intervals(df, [key], start, end).groupBy(key).agg(F.round(F.sum(F.datediff(end, start)) / 365.25, 1).alias("merged"))
    return plain.join(spans, key, "left")


def best_years(calculated: Column, stated: Column) -> Column:
    """Calculated years where there are some, else stated ones over 0."""
    return F.coalesce(calculated, F.when(stated > 0, stated))


def feedback_statistics(df: DataFrame, kind: str = "type", reviewed: str = "reviewed", processed: str = "processed") -> DataFrame:
    """Counts over stored feedback: cases of low confidence and corrections, those dealt with and those that wait."""
    low, fixed = F.col(kind) == "low_confidence", F.col(kind) == "user_correction"
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = df.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(low).alias("low_confidence_cases"), F.count_if(fixed).alias("user_corrections"),
        F.count_if(low & yes(reviewed)).alias("reviewed_cases"), F.count_if(fixed & yes(processed)).alias("processed_corrections"),
    )
    return out.withColumn("pending_review", F.col("low_confidence_cases") - F.col("reviewed_cases")).withColumn("pending_processing", F.col("user_corrections") - F.col("processed_corrections"))


def valid_task(text: Column, labels: Column) -> Column:
    """A labelling task is valid with a text that is not blank and a list of labels, which may be empty."""
    return F.coalesce(F.trim(text) != "", F.lit(False)) & labels.isNotNull()


#: What names a kind of employment and a level, in the order in which they are tried.
EMPLOYMENT = [("full_time", "full[- ]?time|permanent"), ("part_time", "part[- ]?time"), ("contract", "contract|freelance"), ("internship", r"intern(?:ship)?\b"), ("temporary", "temporary|temp\\b")]
LEVELS = [("executive", "chief|director|vice president|head of"), ("lead", r"\blead\b|principal|staff|architect"), ("senior", r"senior|\bsr\b"), ("junior", r"junior|\bjr\b|entry[- ]level|graduate"), ("intern", r"\bintern\b|trainee")]
SALARY = r"([$€£][0-9][0-9,]*[kK]?) *(?:-|–|to) *([$€£]?[0-9][0-9,]*[kK]?)"


def parse_job(df: DataFrame, key: str, text: str, skills: Sequence[str]) -> DataFrame:
    """What a job description says: title, company, location, seniority, employment, salary, years, degree, skills required and
    preferred (those behind a word such as 'preferred' or 'nice to have'), and duties (lines that begin as a list)."""
    from corvane.operators.resumes import experience_asked, skills_in

    c, low = F.col(text), F.lower(F.col(text))
    first = lambda pairs, other: F.coalesce(*[F.when(low.rlike(p), n) for n, p in pairs], F.lit(other))
    labelled = lambda p: F.nullif(F.trim(F.regexp_extract(c, rf"(?im)^(?:{p}) *: *(.+)$", 1)), F.lit(""))
    nice = r"(?is)\b(?:preferred|nice to have|bonus|desirable)\b.*$"
    wanted, extra = skills_in(F.regexp_replace(c, nice, ""), skills), skills_in(F.regexp_extract(c, nice, 0), skills)
    duties = F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^ *[-•*] +(.+)$"), F.lit(1)), lambda x: F.trim(x))
    pay = lambda i: F.nullif(F.regexp_extract(c, SALARY, i), F.lit(""))
    e = experience_asked(c)
    return df.select(
        key, labelled("job title|title|position|role").alias("title"), labelled("company|employer").alias("company"), labelled("location|place").alias("location"),
        first(LEVELS, "mid").alias("seniority"), first(EMPLOYMENT, "full_time").alias("employment"), pay(1).alias("salary_from"), pay(2).alias("salary_to"),
        e["low"].alias("min_years"), e["high"].alias("max_years"), F.coalesce(*[F.when(low.contains(d), d) for d, _ in DEGREES]).alias("degree"),
        wanted.alias("required"), F.array_except(extra, wanted).alias("preferred"), duties.alias("duties"),
    )
