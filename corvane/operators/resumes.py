"""Text of resumes and job descriptions: sections, skills, experience, education, sentences, positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.lists import bound
from corvane.operators.rows import small

#: Words that head a section.
HEADINGS = [
    ("summary", "summary|profile|objective|about"), ("experience", "experience|employment|work history"), ("education", "education|academic|qualifications"),
    ("skills", "skills|technologies|competencies"), ("projects", "projects"), ("certifications", "certifications|certificates|licenses"),
]


def heading(line: Column) -> Column:
    """The section that a short line of few words names, long names also with an edit in six letters; null for other lines."""

    def read(t: Column) -> Column:
        short = (F.length(t) > 0) & (F.length(t) <= 40) & (F.size(F.split(t, " +")) <= 4)
        plain = [F.when(t.rlike(f"^(professional |work |technical |key |personal )?({p})\\b"), n) for n, p in HEADINGS]
        near = [F.when(F.levenshtein(t, F.lit(w)) * 6 <= F.greatest(F.length(t), F.lit(len(w))), n) for n, p in HEADINGS for w in p.split("|") if len(w) > 6]
        return F.when(short, F.coalesce(*plain, *near))

    return bound(F.lower(F.trim(F.regexp_replace(line, "[:\\-_*#]+", " "))), read)


def split_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, section, text``: lines under each heading, in order; those before the first are the header. Sections that repeat are joined."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("h", heading(F.col("line")))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("section", F.coalesce(F.last("h", True).over(w), F.lit("header"))).filter(F.col("h").isNull() & (F.trim("line") != ""))
    body = rows.groupBy(key, "section").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return body.select(key, "section", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def skills_in(text: Column, skills: Sequence[str]) -> Column:
    """Skills that the text names as whole words, in the given order."""
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9+#.]+", " "), F.lit(" "))
    names = F.array(*[F.lit(s) for s in skills])
    # the text is squeezed once, not once a skill
    return bound(F.regexp_replace(t, "\\. ", " "), lambda t: F.filter(names, lambda s: F.contains(t, F.concat(F.lit(" "), F.lower(s), F.lit(" ")))))


def without_skills(text: Column, skills: Sequence[str]) -> Column:
    """The text that is left when skill names are taken out."""
    words = sorted(skills, key=len, reverse=True)
    pattern = "(?i)(?<![A-Za-z0-9+#])(" + "|".join(f"\\Q{w}\\E" for w in words) + ")(?![A-Za-z0-9+#])"
    return F.trim(F.regexp_replace(F.regexp_replace(text, pattern, " "), " +", " "))


def experience_asked(text: Column) -> Column:
    """``struct(low, high)``: '3-5 years' is 3 to 5, '5+ years' 5 and up, '2 years' 1 to 2; nulls without one."""
    t = F.lower(text)
    num = lambda p, g: F.regexp_extract(t, p, g).try_cast("int")
    span, plus, one = "([0-9]{1,2}) ?(?:-|–|to) ?([0-9]{1,2}) ?\\+? ?years?", "([0-9]{1,2}) ?\\+ ?years?", "([0-9]{1,2}) ?years?"
    low = F.when(t.rlike(span), num(span, 1)).when(t.rlike(plus), num(plus, 1)).when(t.rlike(one), F.greatest(F.lit(0), num(one, 1) - 1))
    high = F.when(t.rlike(span), num(span, 2)).when(t.rlike(plus), F.lit(None).cast("int")).when(t.rlike(one), num(one, 1))
    return F.struct(low.alias("low"), high.alias("high"))


def extract_job(df: DataFrame, key: str, text: str, skills: Sequence[str]) -> DataFrame:
    """``key, skills, low, high, degree, certified``: what a job description asks for."""
    from corvane.functions.scoring import DEGREES

    low = F.lower(text)
    degree = F.coalesce(*[F.when(low.contains(d), d) for d, _ in DEGREES])
    out = df.select(key, skills_in(F.col(text), skills).alias("skills"), experience_asked(F.col(text)).alias("e"), degree.alias("degree"), low.rlike("certif").alias("certified"))
    return out.select(key, "skills", "e.low", "e.high", "degree", "certified")


def header_score(line: Column) -> Column:
    """How much a line looks like a heading, 0 to 1."""

    def read(t: Column) -> Column:
        words = F.size(F.split(t, " +"))
        s = F.when(words <= 3, 0.3).when(words <= 6, 0.15).otherwise(0.0) + F.when((t == F.upper(t)) & t.rlike("[A-Z]"), 0.3).when(t == F.initcap(t), 0.15).otherwise(0.0)
        s = s + F.when(t.endswith(":"), 0.2).otherwise(0.0) + F.when(heading(t).isNotNull(), 0.2).otherwise(0.0) - F.when(t.rlike("[.,;]$"), 0.3).otherwise(0.0)
        return F.round(F.when(F.length(t) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))), 2)

    return bound(F.trim(line), read)


def tokens_with_offsets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, token, start, end``: words split by white space with character offsets."""
    parts = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit("(\\s*)(\\S+)"), F.lit(0))).alias("pos", "raw"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.withColumn("end", F.sum(F.length("raw")).over(w)).withColumn("token", F.regexp_replace("raw", "^\\s+", ""))
    return out.select(key, "pos", "token", (F.col("end") - F.length("token")).alias("start"), "end")


def positions(text: Column, value: Column) -> Column:
    """Every start (from 0) of ``value`` in ``text``, not overlapping; empty for an empty value."""
    literal = F.regexp_replace(value, r"([^\p{L}\p{N}\s])", r"\\$1")
    pieces = F.transform(F.split(text, literal, -1), F.length)
    # one running sum over the pieces between hits
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda acc, n: F.struct((acc["at"] + n + F.length(value)).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + n)).alias("starts"))
    starts = F.aggregate(pieces, none, step)["starts"]
    return F.when((F.length(value) > 0) & (F.size(pieces) > 1), F.slice(starts, F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))


def sentences(text: Column, longest: int = 200, shortest: int = 3) -> Column:
    """Sentences of at least ``shortest`` characters; those over ``longest`` are cut at commas and semicolons."""
    s = F.transform(F.split(text, "(?<=[.!?])\\s+|\\n+"), lambda x: F.trim(x))  # F.trim alone would take the index as its characters
    s = F.flatten(F.transform(s, lambda x: F.when(F.length(x) > longest, F.split(x, "[,;] +")).otherwise(F.array(x))))
    return F.filter(s, lambda x: F.length(x) >= shortest)


def categories(df: DataFrame, name: str, keywords: DataFrame, default: str = "other") -> DataFrame:
    """``name, category``: keyword points (2 for a whole word, 1 within a word) by category; ties go to the longest keyword, then by name.

    Each name is split into words and their parts, none longer than the longest keyword, are matched by equality, so that names
    meet only keywords they hold.
    """
    names = df.select(name).distinct()
    longest = keywords.agg(F.coalesce(F.max(F.length("keyword")), F.lit(1))).first()[0]
    words = names.select(name, F.explode(F.split(F.lower(name), "[^a-z0-9]+")).alias("w")).filter("w <> ''")
    parts = words.select(name, "w", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("w") - i + 1)), lambda n: F.substring(F.col("w"), i, n))))).alias("keyword")).distinct()
    hits = parts.join(keywords, "keyword").groupBy(name, "keyword", "category").agg(F.max(F.when(F.col("w") == F.col("keyword"), 2).otherwise(1)).alias("points"))
    by = hits.groupBy(name, "category").agg(F.sum("points").alias("points"), F.max(F.length("keyword")).alias("longest"))
    best = by.groupBy(name).agg(F.min(F.struct((-F.col("points")).alias("p"), (-F.col("longest")).alias("l"), "category")).alias("m"))
    return names.join(best, name, "left").select(name, F.coalesce("m.category", F.lit(default)).alias("category"))


def section_fit(counts: DataFrame, key: str, prints: DataFrame) -> DataFrame:
    """``key, section, violations`` of the section whose ranges of entity counts are broken least (by name in a tie).

    ``counts(key, type, n)``; ``prints(section, type, low, high)`` is a fixed table with a row for each section and type.  A key that
    lacks a type breaks the ranges that do not begin at 0; these are counted once a section, so a key meets its own types' rows only.
    """
    broken = lambda n: ((n < F.col("low")) | (n > F.col("high"))).cast("int")
    empty = prints.groupBy("section").agg(F.sum(broken(F.lit(0))).alias("none"))
    more = prints.select("section", "type", "low", "high")
    # every row meets all sections, then its type's ranges: both tables are small and go to the rows, which stay where they are
    met = counts.select(key, "type", "n").join(small(empty)).join(small(more), ["section", "type"], "left")
    own = F.coalesce(broken(F.col("n")) - broken(F.lit(0)), F.lit(0))
    bad = met.groupBy(key, "section").agg((F.max("none") + F.sum(own)).alias("v"))
    return bad.groupBy(key).agg(F.min(F.struct("v", "section")).alias("m")).select(key, F.col("m.section").alias("section"), F.col("m.v").alias("violations"))


def taxonomy_merge(tables: Sequence[DataFrame], name: str, domain: str, default: str = "general") -> DataFrame:
    """One row per name (case-blind), the first table's spelling, with its domain or the default."""
    rows = None
    for i, t in enumerate(tables):
        part = t.select(F.trim(name).alias(name), F.coalesce(F.nullif(F.trim(domain), F.lit("")), F.lit(default)).alias(domain), F.lit(i).alias("o"))
        rows = part if rows is None else rows.union(part)
    best = rows.filter(F.col(name) != "").groupBy(F.lower(name).alias("k")).agg(F.min(F.struct("o", name, domain)).alias("m"))
    return best.select(F.col(f"m.{name}").alias(name), F.col(f"m.{domain}").alias(domain))


def weak_tags(token: Column, titles: Sequence[str], places: Sequence[str]) -> Column:
    """A tag by pattern or dictionary: dates, degrees, roles and places; else O."""
    t = F.lower(F.regexp_replace(token, "[.,;:]+$", ""))
    return (
        F.when(t.rlike("^(19|20)[0-9]{2}$"), "B-DATE").when(t.rlike("^(b\\.?tech|m\\.?tech|bsc|msc|mba|phd|bachelor|master)$"), "B-DEGREE")
        .when(t.isin(list(titles)), "B-ROLE").when(t.isin(list(places)), "B-LOCATION").otherwise("O")
    )
