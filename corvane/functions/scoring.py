"""Scores of candidates against jobs, of records and of companies, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(score: Column, *steps: tuple[float, str], other: str) -> Column:
    """Name of the first step that the score reaches."""
    out = None
    for low, name in steps:
        out = F.when(score >= low, name) if out is None else out.when(score >= low, name)
    return out.otherwise(other)


def ats_label(s: Column) -> Column:
    return label(s, (90, "Excellent"), (75, "Good"), (60, "Fair"), other="Poor")


def cached_label(s: Column) -> Column:
    return label(s, (80, "Strong Match"), (70, "Good Match"), (60, "Fair Match"), other="Weak Match")


def engine_label(s: Column) -> Column:
    return label(s, (80, "Strong Match"), (65, "Good Match"), (50, "Partial Match"), other="Not Recommended")


def overlap(have: Column, want: Column) -> Column:
    """Share of wanted items that are had; 1 when none is wanted."""
    n = F.size(want)
    return F.when(n > 0, F.size(F.array_intersect(have, want)) / n).otherwise(F.lit(1.0))


def ats(skill: Column, experience: Column, role: Column, project: Column, education: Column, certification: Column) -> Column:
    """Weighted total of six parts of 0 to 100, one digit."""
    total = skill * 0.50 + experience * 0.20 + role * 0.10 + project * 0.10 + education * 0.05 + certification * 0.05
    return F.round(total, 1)


def experience_pro_rata(years: Column, wanted: Column) -> Column:
    return F.when(F.coalesce(wanted, F.lit(0)) <= 0, 100.0).otherwise(F.least(F.lit(100.0), F.coalesce(years, F.lit(0)) * 100.0 / wanted))


def experience_band(years: Column, low: Column, high: Column) -> Column:
    """20 off for each year short (not under 20), 5 off for each year beyond (not under 75), else 100."""
    return (
        F.when(years < low, F.greatest(F.lit(20.0), 100 - (low - years) * 20.0))
        .when(high.isNotNull() & (years > high), F.greatest(F.lit(75.0), 100 - (years - high) * 5.0))
        .otherwise(F.lit(100.0))
    )


#: Levels of degrees by contained keyword, highest first.
DEGREES = [("phd", 5), ("doctor", 5), ("master", 4), ("mba", 4), ("bachelor", 3), ("associate", 2), ("diploma", 2), ("high school", 1)]


def degree_level(c: Column) -> Column:
    """Level by contained keyword; null for none."""
    return F.coalesce(*[F.when(F.lower(c).contains(k), v) for k, v in DEGREES])


def education_gap(have: Column, want: Column) -> Column:
    """25 off for each level short (not under 25); 50 where either is unknown."""
    gap = F.greatest(F.lit(0), degree_level(want) - degree_level(have))
    known = degree_level(want).isNotNull() & degree_level(have).isNotNull()
    return F.when(known, F.greatest(F.lit(25.0), 100 - gap * 25.0)).otherwise(F.lit(50.0))


def engine(required: Column, preferred: Column, has_preferred: Column, experience: Column, education: Column) -> Column:
    """Half skills (7 to 3 for required against preferred, which count half when none is asked), 30 % experience, 20 % education; two digits."""
    skills = required * 0.7 + F.when(has_preferred, preferred).otherwise(0.5) * 0.3
    return F.round(skills * 100 * 0.5 + experience * 0.3 + education * 0.2, 2)


def hiring_jobs_points(n: Column) -> Column:
    return F.when(n <= 0, 0).when(n <= 2, 10).when(n <= 5, 18).otherwise(25)


def hiring(site: Column, profile: Column, jobs: Column, contact: Column, recent: Column) -> Column:
    """20 for a careers page, 20 for a profile, points for open jobs, 10 for a contact, up to 25 for recent ones."""
    share = F.when(jobs > 0, recent / jobs).otherwise(0.0)
    return F.when(site, 20).otherwise(0) + F.when(profile, 20).otherwise(0) + hiring_jobs_points(jobs) + F.when(contact, 10).otherwise(0) + F.round(share * 25).cast("int")


def hiring_label(s: Column) -> Column:
    return label(s, (80, "Hot"), (50, "Warm"), (25, "Cool"), other="Cold")


#: Weights of a record's parts; they sum to 1.
PARTS = [("name", 0.15), ("contact", 0.10), ("skills", 0.20), ("experience", 0.25), ("education", 0.20), ("summary", 0.10)]


def confidence(**parts: Column) -> Column:
    """Weighted mean of part scores of 0 to 1, three digits."""
    total = F.lit(0.0)
    for name, w in PARTS:
        total = total + parts[name] * w
    return F.round(total, 3)


def confidence_level(c: Column) -> Column:
    return label(c, (0.85, "very_high"), (0.70, "high"), (0.60, "medium"), (0.40, "low"), other="very_low")


def completeness(*filled: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for cond, w in filled:
        out = out + F.when(cond, w).otherwise(0.0)
    return F.round(out, 2)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
