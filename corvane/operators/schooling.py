"""Education read from text: degrees with field, school, years and grade, on one line or on several.

Lines are cut into parts; a part is a degree if it begins with one, so 'a master of ceremonies' is none.  One fold over the lines fills
the open record with what it lacks and opens the next one at a degree, or at a school where the open one is whole, so that the order
within a record does not matter.  All on the JVM, within the row.

Grades are given as they stand with their scale: the one that is written ('8.4/10'), 100 for percentages, else the least of 4, 5, 10
and 100 that holds them.

Defined cases: null and empty texts have no records; a record needs a degree; years come from a span or stand alone (the end); two blank
lines end a record; lines over 160 characters are prose and say nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.lists import bound

DEGREE = (
    r"^(?:(?i:ph\.?\s?d\b|doctor(?:ate)?\b|master(?:'?s)?\b|bachelor(?:'?s)?\b|associate(?:'?s)?\s+(?:degree|of|in)\b|(?:post ?graduate |advanced )?diploma\b|high school\b|secondary school\b|certificate in\b)"
    r"|(?:[BM]\.?\s?(?:Tech|Sc|Eng|Com|Phil|Ed|Arch|Des|CA|BA|B\.A|S|A|E)\.?(?![A-Za-z])|MBA\b|MBBS\b|LL\.?[BM]\b))"
)
SCHOOL = r"(?i)\b(?:universit\w*|college|institut\w*|academy|polytechnic|school of|[a-z]+ school$|iit|nit|mit)\b"
GRADE = r"(?i)\b(?:c?gpa|grade|score|marks|percentage)\b\s*[:=-]?\s*([0-9]{1,3}(?:\.[0-9]+)?)\s*(?:/\s*([0-9]{1,3}(?:\.[0-9]+)?))?"
_YEAR = r"\b((?:19|20)[0-9]{2})\b"
_RECORD = "struct<place:int,degree:string,field:string,institution:string,start_year:int,end_year:int,grade:double,scale:double>"


def _read(line: Column) -> Column:
    """``struct`` of what a line gives: degree, field, institution, start_year, end_year, grade, scale; nulls for what it does not."""

    def of(t: Column) -> Column:
        bits = F.filter(F.transform(F.split(t, r"\s*[|,\t;]\s*|\s+[-–—]\s+(?![0-9])|\s+at\s+|\s+from\s+"), lambda b: F.trim(F.regexp_replace(b, r"^[\s•*+-]+", ""))), lambda b: b != "")
        return bound(bits, lambda bits: parts(t, bits))

    def parts(t: Column, bits: Column) -> Column:
        title = F.get(F.filter(bits, lambda b: b.rlike(DEGREE)), F.lit(0))
        school = F.get(F.filter(bits, lambda b: b.rlike(SCHOOL) & ~b.rlike(DEGREE)), F.lit(0))
        years = F.transform(F.regexp_extract_all(t, F.lit(_YEAR), F.lit(1)), lambda y: y.cast("int"))
        mark = F.regexp_extract(t, GRADE, 1).try_cast("double")
        percent = F.regexp_extract(t, r"\b([0-9]{1,3}(?:\.[0-9]+)?)\s*%", 1).try_cast("double")
        grade = F.coalesce(mark, percent)
        least = F.when(grade <= 4, 4.0).when(grade <= 5, 5.0).when(grade <= 10, 10.0).when(grade <= 100, 100.0)
        scale = F.coalesce(F.regexp_extract(t, GRADE, 2).try_cast("double"), F.when(mark.isNull() & percent.isNotNull(), 100.0), least)

        def named(title: Column) -> Column:
            bare = F.trim(F.regexp_replace(F.regexp_replace(title, r"\s*\(.*$|\s+(?:19|20)[0-9]{2}.*$", ""), r"(?i)\s+in\s+.*$", ""))
            area = F.coalesce(F.nullif(F.regexp_extract(title, r"(?i)\bin\s+([^(0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract(title, r"\(([^)0-9]+)\)", 1), F.lit("")))
            return F.struct(bare.alias("degree"), F.trim(area).alias("field"))

        def made(d: Column, ys: Column) -> Column:
            clean = F.trim(F.regexp_replace(school, r"[(\s]*(?:19|20)[0-9]{2}.*$", ""))
            return F.struct(
                d["degree"].alias("degree"), d["field"].alias("field"), F.nullif(clean, F.lit("")).alias("institution"), F.when(F.size(ys) > 1, F.array_min(ys)).alias("start_year"),
                F.array_max(ys).alias("end_year"), F.when(grade <= scale, grade).alias("grade"), F.when(grade <= scale, scale).alias("scale"),
            )

        return bound(named(title), lambda d: bound(years, lambda ys: made(d, ys)))

    return bound(F.trim(line), of)


def _empty() -> Column:
    fields = ", ".join(f"'{f.split(':')[0]}', cast(null as {f.split(':')[1]})" for f in _RECORD[7:-1].split(","))
    return F.expr(f"named_struct({fields})")


def _closed(acc: Column) -> Column:
    return F.when(acc["cur"]["degree"].isNotNull(), F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])


def _step(acc: Column, x: Column) -> Column:
    cur, r = acc["cur"], x["r"]
    names = ["degree", "field", "institution", "start_year", "end_year", "grade", "scale"]

    def filled(base: Column) -> Column:
        return F.struct(F.coalesce(base["place"], x["place"]).alias("place"), *[F.coalesce(base[n], r[n]).alias(n) for n in names])

    def state(done: Column, now: Column, blanks: Column) -> Column:
        return F.struct(done.alias("done"), now.alias("cur"), blanks.alias("blanks"))

    new = (r["degree"].isNotNull() & cur["degree"].isNotNull()) | (r["institution"].isNotNull() & cur["institution"].isNotNull() & cur["degree"].isNotNull())
    said = r["degree"].isNotNull() | r["institution"].isNotNull() | ((r["end_year"].isNotNull() | r["grade"].isNotNull()) & cur["place"].isNotNull())
    zero = F.lit(0)
    return (
        F.when(x["blank"], F.when(acc["blanks"] >= 1, state(_closed(acc), _empty(), zero)).otherwise(state(acc["done"], cur, acc["blanks"] + 1)))
        .when(~said, state(acc["done"], cur, zero))
        .when(new, state(_closed(acc), filled(_empty()), zero))
        .otherwise(state(acc["done"], filled(cur), zero))
    )


def records_in(text: Column) -> Column:
    def read(line: Column, i: Column) -> Column:
        # prose says nothing, nor does a line without a word or number that could
        none = F.struct(*[F.expr(f"cast(null as {k})").alias(n) for n, k in (f.split(":") for f in _RECORD[7:-1].split(",")[1:])])
        return F.struct(i.alias("place"), (F.trim(line) == "").alias("blank"), F.when((F.length(line) <= 160) & ~line.rlike(r"[a-z]{3,}\.\s*$"), _read(line)).otherwise(none).alias("r"))

    start = F.struct(F.expr(f"cast(array() as array<{_RECORD}>)").alias("done"), _empty().alias("cur"), F.lit(0).alias("blanks"))
    return F.aggregate(F.transform(F.split(text, "\n"), read), start, _step, _closed)


def education_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, place, degree, field, institution, start_year, end_year, gpa, scale`` of each degree; ``place`` is its record's first line."""
    return df.select(key, F.inline(records_in(F.col(text)))).withColumnRenamed("grade", "gpa")
