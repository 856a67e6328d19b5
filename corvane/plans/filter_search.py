"""Search by filters in two stages of one plan: hard predicates at the scan, then a score per remaining row.

``Filters`` also stands for the job that the score measures against, so no job row is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import scoring as C
from corvane.operators import matching as M
from corvane.operators.filters import contains_any, has_skills, not_deleted, number_range
from corvane.operators.resumes import extract_job
from corvane.operators.rows import page


@dataclass
class Filters:
    role: str = ""
    skills: Sequence[str] = field(default_factory=tuple)
    min_years: float | None = None
    max_years: float | None = None
    locations: Sequence[str] = field(default_factory=tuple)
    degree: str = ""

    def job_text(self) -> str:
        """The filters as the text of a job."""
        years = "" if self.min_years is None else f"{self.min_years:g}" + (f"-{self.max_years:g}" if self.max_years is not None else "+") + " years"
        return ". ".join(x for x in (self.role, "Skills: " + ", ".join(self.skills) if self.skills else "", years, self.degree, ", ".join(self.locations)) if x)


def virtual_job(spark: SparkSession, f: Filters, known_skills: Sequence[str]) -> DataFrame:
    """The job that the filters stand for: read from their text like any job, with what the filters say themselves put over it."""
    row = extract_job(spark.createDataFrame([(1, f.job_text())], "id int, text string"), "id", "text", known_skills)
    own = F.array(*[F.lit(s.lower()) for s in f.skills]) if f.skills else F.col("skills")
    number = lambda v, c: F.lit(int(v)) if v is not None else F.col(c)
    return row.select(F.lit(f.role).alias("title"), own.alias("skills"), number(f.min_years, "low").alias("low"), number(f.max_years, "high").alias("high"), F.coalesce("degree", F.lit(f.degree.lower() or None)).alias("degree"), F.lit(", ".join(f.locations)).alias("location"))


def hard(f: Filters) -> Column:
    """What a row must meet: not deleted, role words in title or text, all skills, years, one of the places."""
    out = not_deleted("status") & number_range("years", f.min_years, f.max_years)
    for word in f.role.lower().split():
        out = out & contains_any(word, ["title", "text"])
    if f.skills:
        out = out & has_skills("skills", "text", f.skills)
    return out & F.lower("location").isin([x.lower() for x in f.locations]) if f.locations else out


def scored(rows: DataFrame, f: Filters) -> DataFrame:
    """``rows`` with ``score`` and ``label``."""
    want = F.array(*[F.lit(s.lower()) for s in f.skills]) if f.skills else F.array().cast("array<string>")
    skill = C.overlap(F.transform("skills", F.lower), want) * 100
    role = M.role_score(F.col("title"), f.role) if f.role else F.lit(100.0)
    education = C.education_gap(F.col("degree"), F.lit(f.degree)) if f.degree else F.lit(100.0)
    s = C.ats(skill, C.experience_pro_rata(F.col("years"), F.lit(f.min_years or 0)), role, M.project_score(F.col("text"), f.skills), education, F.lit(100.0))
    return rows.withColumn("score", s).withColumn("label", C.ats_label(F.col("score")))


def filter_search(candidates: DataFrame, f: Filters, number: int = 1, size: int = 20, page_first: bool = False) -> DataFrame:
    """A page of candidates (id, title, skills, years, location, degree, text, status, created_at), best first.

    ``page_first`` takes the newest page and ranks only that; otherwise all matches are ranked and then paged.
    """
    found = candidates.filter(hard(f))
    if page_first:
        return scored(page(found, number, size, F.desc_nulls_last("created_at"), F.col("id")), f).orderBy(F.desc("score"), "id")
    return page(scored(found, f), number, size, F.desc("score"), F.col("id"))
