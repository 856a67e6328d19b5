"""What is lost between a text and what was rebuilt from it: words, sections, structure, and one score over all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.dates import DATE
from corvane.functions.lists import extraction_quality
from corvane.functions.strings import EMAIL, squeeze
from corvane.functions.udfs import likeness

#: Words whose loss does not count, and names of sections that are looked for.
COMMON = (
    "the", "and", "for", "with", "this", "that", "from", "have", "has", "had", "was", "were", "been", "are", "will", "would", "could", "should", "may", "might", "can", "must", "shall",
)
SECTIONS = (
    "experience", "education", "skills", "summary", "objective", "projects", "certifications", "awards", "publications", "professional experience", "work experience", "employment history",
    "academic background", "qualifications", "technical skills",
)

#: Signs of structure: (name, pattern, how many more the original may have): lines that begin as a list, empty or tabbed cells, dates, addresses, numbers in groups.
SIGNS = [("bullets", r"(?m)^[ \t]*[-–•*+►▸▶→▪◦][ \t]", 5), ("tables", r"\t\t+|\|\|+", 0), ("dates", f"(?i){DATE}", 2), ("addresses", EMAIL, 0), ("phones", r"\+?\(?[0-9]{2,4}\)?(?:[ -][0-9]{2,4}){2,4}", 0)]


def words_lost(original: Column, rebuilt: Column) -> Column:
    """Words (runs of letters, of any alphabet) of three letters or more of the original that the rebuilt text lacks, without common ones, longest first, then by name."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"\p{L}{3,}"), F.lit(0)))
    lost = F.array_except(words(original), F.concat(words(rebuilt), F.array(*map(F.lit, COMMON))))
    return F.transform(F.array_sort(F.transform(lost, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])


def sections_lost(original: Column, found: Column, names: Sequence[str] = SECTIONS) -> Column:
    """Section names that the original holds and no found section's name does."""
    asked = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower(original), n))
    return F.filter(asked, lambda n: ~F.exists(found, lambda f: F.contains(F.lower(f), n)))


def structure_lost(original: Column, rebuilt: Column) -> Column:
    """Names of what the rebuilt text has too little of: bullets, tables, dates, addresses, phones, lines (under half)."""
    # a text without a sign's characters is not searched for it
    barren = lambda t, name: ~t.contains("@") if name == "addresses" else ~t.rlike("[0-9]") if name in ("dates", "phones") else F.lit(False)
    n = lambda t, p, name: F.when(barren(t, name), 0).otherwise(F.regexp_count(t, F.lit(p)))
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    found = [F.when(n(original, p, name) > n(rebuilt, p, name) + more, F.lit(name)) for name, p, more in SIGNS]
    return F.array_compact(F.array(*found, F.when(breaks(original) > 2 * breaks(rebuilt), F.lit("lines"))))


def compare(df: DataFrame, key: str, original: str, rebuilt: str, found: str) -> DataFrame:
    """``key, likeness, words, sections, structure, quality`` of two texts (null counts as empty) and the names of found sections."""
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in (original, rebuilt))
    names = F.coalesce(F.col(found), F.array().cast("array<string>"))
    out = df.select(key, likeness(squeeze(a), squeeze(b)).alias("likeness"), words_lost(a, b).alias("words"), sections_lost(a, names).alias("sections"), structure_lost(a, b).alias("structure"))
    return out.withColumn("quality", extraction_quality(F.col("likeness"), F.size("words"), F.size("sections"), F.size("structure")))
