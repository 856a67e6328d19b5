"""Sections of a text as a contest of ways to tell them: by pattern, by likeness, by layout, and by content.

Every line may open a section, with the confidence of the surest way that says so.  Lines that content alone tells open one only
behind an empty line and only where no surer section is open, so that boundaries stay in order.  Of the spans that claim a section
the surest ones are its text, in order; less sure ones are left out, as another way has found it better.

All is done within the row on arrays of lines, on the JVM and without a shuffle.

Defined cases: null and empty texts have no sections; text before the first boundary is the section 'header'; a heading without text gives
none; lines are kept as they are, without white space at their ends; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.dates import SPAN
from corvane.functions.lists import bound
from corvane.operators.resumes import HEADINGS, header_score

#: How sure each way is.
WAYS = {"pattern": 0.95, "fuzzy": 0.8, "layout": 0.6, "content": 0.4}
HEADER = ("header", "position", 0.5)
_NAMES = [(n, f"{p}|history" if n == "experience" else p) for n, p in HEADINGS]
_LEAD = r"^\W*(?:(?:professional|work|technical|key|personal|relevant|my|core|career|other|academic|employment)\s+)*"
_TAIL = r"(?:\s+(?:history|experience|summary|skills|background|details|profile|and training))*\W*$"
_DEGREE = r"(?i)\b(?:ph\.?d|master of|bachelor of|m\.?sc|b\.?sc|b\.?tech|m\.?tech|mba|diploma)\b"
_CONTACT = r"[\w.+-]+@[\w-]+\.[a-z]{2,}|\+?[0-9][0-9 ()-]{7,}[0-9]"


def _claim(section: Column | str, way: str) -> Column:
    name = F.lit(section) if isinstance(section, str) else section
    return F.struct(name.alias("section"), F.lit(way).alias("way"), F.lit(WAYS[way]).alias("sure"))


def claim_of(line: Column, before: Column) -> Column:
    """``struct(section, way, sure)`` of the surest way in which a line opens a section; null where none does."""

    def read(t: Column) -> Column:
        low = F.lower(t)
        words = F.regexp_replace(F.trim(F.regexp_replace(low, r"[^\p{L}]+", " ")), " +", " ")
        short = (F.length(t) >= 3) & (F.length(t) <= 50) & (F.size(F.split(t, r"\s+")) <= 5) & ~t.rlike(r":\s*.{11,}$")
        pattern = [F.when(low.rlike(f"{_LEAD}(?:{p}){_TAIL}"), _claim(n, "pattern")) for n, p in _NAMES]
        fuzzy = [F.when(F.levenshtein(words, F.lit(w)) * 6 <= F.greatest(F.length(words), F.lit(len(w))), _claim(n, "fuzzy")) for n, p in HEADINGS for w in p.split("|") if len(w) > 6]
        layout = [F.when(low.rlike(rf"\b(?:{p})\b") & (header_score(t) >= 0.5), _claim(n, "layout")) for n, p in _NAMES]
        listed = (F.size(F.split(t, r"\s*[,;|]\s*")) >= 4) & ~t.rlike(r"[.!?]$") & (F.length(t) / F.size(F.split(t, r"[,;|]")) <= 25)
        content = (
            F.when(t.rlike(_DEGREE), _claim("education", "content"))
            .when(t.rlike(r"(?:19|20)[0-9]{2}|['’][0-9]{2}") & t.rlike(SPAN), _claim("experience", "content"))
            .when(t.rlike(_CONTACT), _claim("contact", "content"))
            .when(listed, _claim("skills", "content"))
        )
        return F.coalesce(F.when(short, F.coalesce(*pattern, *fuzzy, *layout)), F.when(before == "", content))

    return bound(line, read)


def sections_of(text: Column) -> Column:
    """The sections of a text: ``array<struct<section, way, sure, text>>`` in order of their first line."""
    claim = "struct<section:string,way:string,sure:double,at:int>"

    def spans(lines: Column) -> Column:
        def at(i: Column, c: Column) -> Column:
            return F.when(c.isNotNull(), F.struct(c["section"].alias("section"), c["way"].alias("way"), c["sure"].alias("sure"), i.alias("at")))

        before = lambda i: F.when(i == 0, "").otherwise(F.get(lines, i - 1))
        claims = F.filter(F.transform(lines, lambda line, i: bound(claim_of(line, before(i)), lambda c: at(i, c))), lambda c: c.isNotNull())
        first = F.array(F.struct(F.lit(HEADER[0]).alias("section"), F.lit(HEADER[1]).alias("way"), F.lit(HEADER[2]).alias("sure"), F.lit(-1).alias("at")))

        def keep(acc: Column, c: Column) -> Column:
            last = F.element_at(acc, -1)
            weak = (c["way"] == "content") & ((last["sure"] > HEADER[2]) | (last["section"] == c["section"]))
            return F.when(weak, acc).otherwise(F.concat(acc, F.array(c)))

        kept = F.aggregate(claims, first.cast(f"array<{claim}>"), keep)

        def cut_out(heads: Column) -> Column:
            def span(h: Column, i: Column) -> Column:
                start = h["at"] + F.when(h["way"] == "content", 0).otherwise(1)
                end = F.when(i + 1 < F.size(heads), F.get(heads, i + 1)["at"]).otherwise(F.size(lines))
                body = F.trim(F.array_join(F.filter(F.slice(lines, start + 1, F.greatest(F.lit(0), end - start)), lambda x: x != ""), "\n"))
                return F.struct(h["section"].alias("section"), h["way"].alias("way"), h["sure"].alias("sure"), body.alias("text"))

            return F.filter(F.transform(heads, span), lambda s: s["text"] != "")

        return bound(kept, cut_out)

    def contest(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda s: s["section"]))

        def best(name: Column) -> Column:
            def joined(own: Column) -> Column:
                sure = F.array_max(F.transform(own, lambda s: s["sure"]))
                top = F.filter(own, lambda s: s["sure"] == sure)
                return F.struct(name.alias("section"), F.get(top, F.lit(0))["way"].alias("way"), sure.alias("sure"), F.array_join(F.transform(top, lambda s: s["text"]), "\n").alias("text"))

            return bound(F.filter(found, lambda s: s["section"] == name), joined)

        return F.transform(names, best)

    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    return bound(bound(lines, spans), contest)


def best_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, section, way, sure, text``: each section of each text by the surest way that found it."""
    return df.select(key, F.inline(sections_of(F.col(text))))
