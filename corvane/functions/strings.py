"""String functions over columns: normal forms, extraction, matching keys, scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns shared with the SQL oracles; only syntax that Java and RE2 read alike.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9() .-]{7,}[0-9]"
URL = r"https?://[A-Za-z0-9./?=_%&#:-]+"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
YEARS = r"([0-9]{1,2})\+? *years"
LINKEDIN = r"linkedin\.com/in/[A-Za-z0-9_-]+"
GITHUB = r"github\.com/[A-Za-z0-9_-]+"
CITY_STATE = r"[A-Z][a-z]+, [A-Z]{2}"


def squeeze(c: Column) -> Column:
    """Lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\r\n\f]+", " "))


def phone_key(c: Column) -> Column:
    """The last ten digits; null under seven digits."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) >= 7, F.right(digits, F.lit(10)))


def url_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "/$", "")


def local_part(c: Column) -> Column:
    return F.split_part(c, F.lit("@"), F.lit(1))


def search_text(*columns: Column) -> Column:
    """Filled values joined by a space."""
    return F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in columns])


def title_action(c: Column) -> Column:
    """snake_case as words with capitals."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def extract_all(c: Column, pattern: str) -> Column:
    """All matches, distinct, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def websites(c: Column) -> Column:
    """Addresses of a text that are no profiles on LinkedIn or GitHub, without closing punctuation."""
    found = F.transform(F.regexp_extract_all(c, F.lit(URL), F.lit(0)), lambda x: F.regexp_replace(x, "[.:?]+$", ""))
    return F.array_distinct(F.filter(found, lambda x: ~x.contains("linkedin.com") & ~x.contains("github.com")))


def years_of_experience(c: Column) -> Column:
    """The largest stated number of years up to 60; null without one."""
    found = F.transform(F.regexp_extract_all(F.lower(c), F.lit(YEARS), F.lit(1)), lambda x: x.cast("int"))
    return F.array_max(F.filter(found, lambda x: (x > 0) & (x <= 60)))


def disposable(email: Column, domains: Sequence[str]) -> Column:
    return F.lower(F.split_part(email, F.lit("@"), F.lit(2))).isin(list(domains))


def real_emails(html: Column, fakes: Sequence[str] = ("example.", "sentry", "wixpress"), files: Sequence[str] = (".png", ".jpg", ".gif", ".svg", ".webp")) -> Column:
    """Addresses of a page without placeholders and file names."""
    low = F.transform(extract_all(html, EMAIL), F.lower)
    bad = lambda x: reduce(Column.__or__, [x.contains(f) for f in fakes] + [x.endswith(f) for f in files])
    return F.array_distinct(F.filter(low, lambda x: ~bad(x)))


#: A telephone number: ten digits or more in one, or groups of two to four, in brackets or not, with a sign or space between; the first may be a country's.
GROUPED_PHONE = r"\+?(?:[0-9]{10,15}|\(?[0-9]{1,4}\)?(?:(?:[ .-]|(?<=\)))\(?[0-9]{2,4}\)?){2,5})"


def real_phones(html: Column) -> Column:
    """Telephone numbers of a page as written, each once: of 10 to 15 digits, not of one digit alone, nor part of a longer number."""
    found = F.regexp_extract_all(html, F.lit(rf"(?<![0-9.+-]){GROUPED_PHONE}(?![0-9]|[.-][0-9])"), F.lit(0))
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    return F.array_distinct(F.filter(found, lambda x: F.length(digits(x)).between(10, 15) & ~digits(x).rlike(r"^([0-9])\1+$")))


def density(c: Column, pattern: str) -> Column:
    """Matches per 1000 characters, 4 digits; 0 for empty text."""
    n = F.size(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)))
    return F.when(F.length(c) > 0, F.round(n * F.lit(1000.0) / F.length(c), 4)).otherwise(F.lit(0.0))


def url_confidence(url: Column) -> Column:
    """How much a URL looks like a careers page: 100, 80, 70, 50 or 30."""
    u = F.lower(url)
    return (
        F.when(u.rlike("/(careers|jobs)/?$"), 100).when(u.rlike("/(careers|jobs)/"), 80).when(u.rlike("(careers|jobs)\\."), 70).when(u.contains("career") | u.contains("job"), 50).otherwise(30)
    )


#: Hosts by which applicant-tracking providers are told apart.
PROVIDERS = [("greenhouse", "greenhouse.io"), ("lever", "lever.co"), ("workday", "myworkdayjobs.com"), ("ashby", "ashbyhq.com"), ("smartrecruiters", "smartrecruiters.com"), ("icims", "icims.com")]


def provider(url: Column, html: Column) -> Column:
    """Name of the first provider whose host the URL or page holds; 'unknown' without one."""
    both = F.lower(F.concat_ws(" ", url, html))
    return F.coalesce(*[F.when(both.contains(host), name) for name, host in PROVIDERS], F.lit("unknown"))


#: Role acronyms, and words that only tell seniority.
ACRONYMS = [("sde", "software engineer"), ("swe", "software engineer"), ("qa", "quality assurance"), ("ba", "business analyst"), ("pm", "project manager"), ("dba", "database administrator"), ("hr", "human resources"), ("ml", "machine learning")]
SENIORITY = ["junior", "senior", "lead", "principal", "staff", "sr", "jr", "intern", "trainee", "chief", "head"]


def role_key(c: Column) -> Column:
    """A role in lower case with acronyms spelt out, seniority dropped and developers as engineers."""
    r = F.concat(F.lit(" "), squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9+#. ]", " ")), F.lit(" "))
    for a, full in ACRONYMS:
        r = F.replace(r, F.lit(f" {a} "), F.lit(f" {full} "))
    for w in SENIORITY:
        r = F.replace(r, F.lit(f" {w} "), F.lit(" "))
    r = F.replace(r, F.lit(" developer "), F.lit(" engineer "))
    return squeeze(r)


def role_match(a: Column, b: Column) -> Column:
    """Equal keys, or one is a run of whole words of the other; single words must be equal."""
    x, y = role_key(a), role_key(b)
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    multi = lambda c: c.contains(" ")
    return (x == y) | (multi(x) & pad(y).contains(pad(x))) | (multi(y) & pad(x).contains(pad(y)))


def role_patterns(role: str) -> list[str]:
    """LIKE patterns of a role: the whole and, beyond two words, its core of the last two."""
    words = role.lower().split()
    return list(dict.fromkeys([f"%{' '.join(words)}%", *([f"%{' '.join(words[-2:])}%"] if len(words) > 2 else [])]))


def has_term(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """For each group of synonyms whether the normalised text holds one of them."""
    t = F.concat(F.lit(" "), squeeze(F.regexp_replace(F.lower(text), r"[^a-z0-9+#.\- ]", " ")), F.lit(" "))
    return F.array(*[reduce(Column.__or__, [t.contains(f" {s} ") for s in g]) for g in groups])


def canonical(c: Column, synonyms: dict[str, str]) -> Column:
    """The canonical name of a squeezed term, itself without an entry."""
    pairs = [F.lit(x) for kv in synonyms.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), squeeze(c)), squeeze(c))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def autocomplete_score(name: Column, typed: str) -> Column:
    """100 equal, 80 and more for a beginning, 60 and more within, up to 50 for a subsequence, else 0."""
    n, q = F.lower(name), typed.lower()
    share = F.lit(float(len(q))) / F.length(n)
    step = lambda acc, ch: F.when(
        (acc < len(q)) & (ch == F.substring(F.lit(q), acc + 1, F.lit(1))), acc + 1
    ).otherwise(acc)
    got = F.aggregate(F.split(n, ""), F.lit(0), step)
    return (
        F.when(n == q, 100.0).when(n.startswith(q), 80 + F.round(share * 19, 2)).when(n.contains(q), 60 + F.round(share * 19, 2)).when(got == len(q), F.round(share * 50, 2)).otherwise(0.0)
    )


def seniority(title: Column) -> Column:
    """Level by keyword; the first that holds wins."""
    t = F.lower(title)
    return (
        F.when(t.rlike("intern|trainee|apprentice"), "entry").when(t.rlike("junior|jr|associate"), "junior").when(t.rlike("chief|director|head|vp"), "executive")
        .when(t.rlike("lead|principal|staff|architect"), "lead").when(t.rlike("senior|sr"), "senior").otherwise("mid")
    )


def first_best(scores: Sequence[tuple[str, Column]], default: str) -> Column:
    """Name of the largest positive score; the first of equals wins."""
    best = F.greatest(*[c for _, c in scores]) if len(scores) > 1 else scores[0][1]
    return F.when(best <= 0, default).otherwise(F.coalesce(*[F.when(c == best, n) for n, c in scores]))


def clean_text(c: Column) -> Column:
    """Bullets to dashes, words split by a hyphen at a line's end joined, odd quotes and spaces made plain, blank lines to one."""
    # a pattern runs only over texts that hold what it rewrites
    where = lambda x, marks, new: F.when(reduce(Column.__or__, [x.contains(m) for m in marks]), new).otherwise(x)
    odd = F.translate(c, "•●▪■◦\u2018\u2019\u201c\u201d\t", "-----''\"\" ")
    t = F.transform(F.array(odd), lambda x: where(x, ["-\n"], F.regexp_replace(x, "([a-z])-\n([a-z])", "$1$2")))
    t = F.transform(t, lambda x: where(x, ["  "], F.regexp_replace(x, " {2,}", " ")))
    t = F.transform(t, lambda x: where(x, [" \n", "\n "], F.regexp_replace(x, " ?\n ?", "\n")))
    t = F.transform(t, lambda x: where(x, ["\n\n\n"], F.regexp_replace(x, "\n{3,}", "\n\n")))
    return F.trim(t[0])


#: UTF-8 read as Windows-1252, and what was meant.
MISREAD = [("â€™", "'"), ("â€˜", "'"), ("â€œ", '"'), ("â€\u009d", '"'), ("â€“", "-"), ("â€”", "-"), ("â€¢", "-"), ("Ã©", "é"), ("Ã¨", "è"), ("Ã¼", "ü"), ("Ã¶", "ö"), ("Ã¤", "ä"), ("Ã±", "ñ"), ("Â ", " ")]


def repair_text(c: Column) -> Column:
    """``clean_text`` for pages of resumes: misread characters are put right, lines that go on are joined, short lines in capitals
    become titles."""
    t = c
    for wrong, right in MISREAD:
        t = F.replace(t, F.lit(wrong), F.lit(right))
    t = F.when(c.contains("â€") | c.contains("Ã") | c.contains("Â"), t).otherwise(c)
    t = F.regexp_replace(clean_text(t), "([a-z,])\n([a-z])", "$1 $2")
    title = lambda x: F.when((F.length(x) <= 40) & (x == F.upper(x)) & x.rlike("[A-Z]{2}"), F.initcap(x)).otherwise(x)
    return F.trim(F.array_join(F.transform(F.split(t, "\n"), title), "\n"), F.lit(" \n"))


def xray_url(site: str, terms: Column) -> Column:
    """A search address restricted to one site."""
    return F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(F.concat(F.lit(f"site:{site} "), terms)))
