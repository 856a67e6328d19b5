"""Work histories: the lines of a text folded into records of title, company, dates and details.

Each line is classed (blank, section heading, detail, head) and its span of dates, label and parts are taken from it once.  One
fold over the array of lines then opens, fills and closes records, on the JVM and without a shuffle, so that the order in which a text
gives title, company and dates, on one line or on several, does not matter:

- a span of dates goes to the open record unless that has dates or details already, else it opens the next one;
- a head line fills the open record while it lacks that part, and opens the next one when details, both parts or a hard boundary
  came before, or when a line of dates follows, at most one head line between;
- bullets, sentences and lines such as 'Environment: ...' are details of the open record; two blank lines or a section heading end it, and
  lines under the heading of another section are left out.

Defined cases: null and empty texts have no records; a record needs dates, or a title or label with details; an open end without a word for the
present stays null; equal records repeat as the text repeats them.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.dates import DATE, SPAN, ends_of
from corvane.functions.lists import bound_as
from corvane.operators.people import COMPANY_SIGNS, JOB_SIGNS
from corvane.operators.resumes import HEADINGS


def _any_of(words: Iterable[str]) -> str:
    """A pattern of any of the words, whole, with those of one first letter together: most places of a text are passed by at a glance."""
    by = {c: "|".join(sorted(w[1:] for w in words if w[0] == c)) for c in sorted({w[0] for w in words})}
    return rf"(?=[{''.join(by)}])\b(?:{'|'.join(f'{c}(?:{rest})' for c, rest in by.items())})"


_FIRM = sorted({*COMPANY_SIGNS, "co", "corporation", "labs", "software", "enterprises", "partners", "holdings", "gmbh", "bank", "university"})
_JOB = sorted({*JOB_SIGNS, "scientist", "researcher", "teacher", "accountant", "recruiter", "writer", "editor", "clerk"})
_EITHER = rf"{_any_of({*_FIRM, *_JOB})}\b"
_FIRM_LAST, _FIRM_IN, _JOB_IN = rf"{_any_of(_FIRM)}\.?$", rf"{_any_of(_FIRM)}\b", rf"{_any_of(_JOB)}\b"
_LABELS = {"company": "company(?: name)?|client|employer|organi[sz]ation|worked for", "title": "(?:job )?title|role|designation|position", "dates": "duration|period|dates?|tenure", "place": "location|place|city"}
_BEFORE, _BEHIND = r"(?i)^\W*(?:professional |work |technical |key |personal |relevant |employment )*(?:", r")(?: (?:history|experience|summary|skills|background|details))?\W*$"
_OTHER = _BEFORE + "|".join(p for n, p in HEADINGS if n != "experience") + _BEHIND
_ANY_HEADING = _BEFORE + "|".join([*(p for _, p in HEADINGS), "history"]) + _BEHIND
_BULLET = r"^\s*[-–•*+►▸▶→▪◦]\s+"
#: Glances that spare most lines a costly pattern: what a line with a bullet begins with, what a date, a separator of parts holds.
_FIRST = "-–•*+►▸▶→▪◦\t\n\x0b\f"
_DATED = ("19", "20", "'", "’")
_SEPARATED = r"[|·\t\x0b\f@,–—-]| (?: |at )"

_SEPARATOR = r"\s*(?:\||·|\t|@|,)\s*|\s+(?:at|[-–—])\s+|\s{2,}"
_EDGE = " \t\n\x0b\f\r(,;:|–—-"

#: What a part of a head line names, as bits: by its label a title or a company, by its words a title or a firm, or nothing known.
TITLE, TITLED, COMPANY, FIRM, PLAIN = 1, 2, 4, 8, 16
_PARTS = "array<struct<t:string,k:int>>"
_CLASS = f"struct<kind:string,text:string,label:string,heads:{_PARTS},holds:int,ends:struct<start:date,end:date,current:boolean>>"
_RECORD = f"struct<place:int,heads:{_PARTS},holds:int,start:date,end:date,current:boolean,dated:boolean,early:boolean,details:array<string>>"
_STATE = f"struct<done:array<{_RECORD}>,cur:{_RECORD},blanks:int,off:boolean>"


def _kind_of(part: Column) -> Column:
    """What a part of a head line names, by its last word first: a firm, a title, or neither."""
    words = lambda p, last: F.when(last.isin(_FIRM), FIRM).when(last.isin(_JOB), TITLED).otherwise(searched(p))
    searched = lambda p: F.when(~p.rlike(_EITHER), PLAIN).when(p.rlike(_FIRM_LAST), FIRM).when(p.rlike(_JOB_IN), TITLED).otherwise(FIRM)
    return bound_as("int", F.lower(part), lambda p: bound_as("int", F.substring_index(p, " ", -1), lambda last: words(p, last)))


def _class_of(kind: Column, text: Column, label: Column | None = None, heads: Column | None = None, ends: Column | None = None) -> Column:
    null = lambda c, type_: F.lit(None).cast(type_) if c is None else c
    holds = F.lit(0) if heads is None else F.aggregate(heads, F.lit(0), lambda n, h: n.bitwiseOR(h["k"]))
    heads = F.expr(f"cast(array() as {_PARTS})") if heads is None else heads
    return F.struct(kind.alias("kind"), text.alias("text"), null(label, "string").alias("label"), heads.alias("heads"), holds.alias("holds"), null(ends, "struct<start:date,end:date,current:boolean>").alias("ends"))


def _classed(line: Column, now: str) -> Column:
    """``struct(kind, text, label, heads, holds, ends)`` of a line; ``holds`` has the bits of all its parts."""

    def parts(t: Column, label: Column) -> Column:
        cut = F.when(t.rlike(_SEPARATED), F.split(F.regexp_replace(t, _SEPARATOR, "\t"), "\t")).otherwise(F.array(t))
        bits = F.filter(F.transform(cut, lambda x: F.rtrim(F.ltrim(x, F.lit(_EDGE + ")")), F.lit(_EDGE))), lambda x: x.rlike(r"\w"))
        labelled = F.array(F.struct(F.trim(t).alias("t"), F.when(label == "title", TITLE).otherwise(COMPANY).alias("k")))
        return (
            F.when(label.isNull(), F.transform(bits, lambda b: F.struct(b.alias("t"), _kind_of(b).alias("k"))))
            .when(label.isin("company", "title") & (F.trim(t) != ""), labelled)
            .otherwise(F.array().cast(_PARTS))
        )

    def read(t: Column) -> Column:
        label = F.when(t.contains(":"), F.coalesce(*[F.when(t.rlike(rf"(?i)^(?:{p})\s*:"), name) for name, p in _LABELS.items()]))
        kind = (
            F.when(t == "", "blank").when(F.lit(_FIRST).contains(F.left(t, F.lit(1))) & line.rlike(_BULLET), "detail")
            .when((F.length(t) <= 60) & t.rlike(_ANY_HEADING), F.when(t.rlike(_OTHER), "other").otherwise("heading"))
        )
        plain = lambda kind: _class_of(kind, F.when(kind == "detail", F.regexp_replace(t, _BULLET, "")).otherwise(t))
        return bound_as(_CLASS, kind, lambda kind: F.when(kind.isNotNull(), plain(kind)).otherwise(bound_as(_CLASS, label, lambda label: labelled(t, label))))

    def labelled(t: Column, label: Column) -> Column:
        bare = F.when(label.isNotNull(), F.regexp_replace(t, r"^[^:]*:\s*", "")).otherwise(t)
        # a date alone on its line is a start
        dated = lambda bare: bound_as("string", F.regexp_extract(bare, SPAN, 0), lambda s: F.when(s != "", s).when(bare.rlike(rf"(?i)^\(?{DATE}\)?$"), bare).otherwise(""))
        span = lambda bare: F.when((F.length(t) <= 160) & reduce(Column.__or__, [t.contains(d) for d in _DATED]) & t.rlike(r"(?:19|20)[0-9]{2}|['’][0-9]{2}"), dated(bare)).otherwise("")
        return bound_as(_CLASS, bare, lambda bare: bound_as(_CLASS, span(bare), lambda span: spanned(t, label, bare, span)))

    def spanned(t: Column, label: Column, bare: Column, span: Column) -> Column:
        left = F.replace(bare, span, F.lit(" "))
        rest = F.when(left.contains("(") | left.contains("["), F.regexp_replace(left, r"\(\s*\)|[(\[]\s*$", "")).otherwise(left)
        plain = (t.between("A", "Z") | t.rlike(r"^[\p{Lu}0-9(]")) & ~(t.contains(":") & t.rlike(r"^[\p{L} ]{3,25}:"))
        stopped = t.contains(".") & t.rlike(r"[a-z]{3,}\.$") & ~t.rlike(rf"(?i){_any_of(_FIRM)}\.$")
        head = (F.length(t) <= 100) & (label.isNotNull() | plain) & ~((F.length(t) > 28) & t.rlike("^(?:[^ ]+ +){14}")) & ~stopped
        rest = F.when(span == "", bare).otherwise(rest)
        made = bound_as(_CLASS, bound_as(_PARTS, rest, lambda rest: parts(rest, label)), lambda heads: _class_of(F.lit("head"), t, label, heads, F.when(span != "", ends_of(span, now))))
        return F.when((span != "") | head, made).otherwise(_class_of(F.lit("detail"), t))

    return bound_as(_CLASS, F.trim(F.replace(F.replace(line, F.lit("\r"), F.lit(" ")), F.lit("\u00a0"), F.lit(" "))), read)


def _none() -> Column:
    return F.expr(f"named_struct('place', cast(null as int), 'heads', cast(array() as {_PARTS}), 'holds', 0, 'start', cast(null as date), 'end', cast(null as date), 'current', false, 'dated', false, 'early', false, 'details', cast(array() as array<string>))")


def _has(x: Column, kinds: int) -> Column:
    """Whether a line or a record holds parts of one of the kinds."""
    return x["holds"].bitwiseAND(F.lit(kinds)) != 0


def _joined(a: Column, b: Column) -> Column:
    """Both arrays as one; most often one of them is empty."""
    return F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).otherwise(F.concat(a, b))


def _closed(acc: Column) -> Column:
    """The records with the open one, if that is one."""
    cur = acc["cur"]
    counts = cur["dated"] | ((F.size(cur["details"]) > 0) & _has(cur, TITLE | TITLED | COMPANY))
    return F.when(counts, _joined(acc["done"], F.array(cur))).otherwise(acc["done"])


def _action(acc: Column, x: Column, near: Column) -> Column:
    """What a line does: new (record), fill, add (detail), end, blank, skip; ``near`` says whether a line of dates follows."""
    cur = acc["cur"]
    detailed, n = F.size(cur["details"]) > 0, F.size(cur["heads"])
    sign = _has(x, TITLE | TITLED | COMPANY | FIRM) | near
    titled = _has(x, TITLE | TITLED)
    fits = F.when(_has(cur, TITLE | TITLED), ~titled).otherwise(titled | _has(cur, FIRM | COMPANY))
    again = ((x["label"] == "company") & _has(cur, COMPANY)) | ((x["label"] == "title") & _has(cur, TITLE))
    spanned = F.when(cur["dated"] | detailed, "new").when((F.size(x["heads"]) >= 2) & (n > 0) & x["label"].isNull(), "new").otherwise("fill")
    undated = F.when(detailed, "new").otherwise("fill")
    dated = (
        F.when(detailed, F.when(sign, "new").otherwise("add"))
        .when((n < 2) & (cur["early"] | (fits & ~near)), "fill")
        .otherwise(F.when(sign, "new").otherwise("add"))
    )
    labelled = F.when(again, "new").when(~detailed, F.when(~cur["dated"] | cur["early"] | _has(cur, TITLE | COMPANY), "fill").otherwise("new"))
    plain = F.when(cur["dated"], dated).otherwise(undated)
    head = F.when(x["ends"].isNotNull(), spanned).when(x["holds"] == 0, "skip").when(x["label"].isNotNull(), F.coalesce(labelled, plain)).otherwise(plain)
    opened = cur["dated"] | (n > 0)
    return (
        F.when(x["kind"] == "blank", F.when(acc["blanks"] >= 1, "end").otherwise("blank"))
        .when(x["kind"].isin("heading", "other"), "end")
        .when(acc["off"], "skip")
        .when(x["kind"] == "detail", F.when(opened, "add").otherwise("skip"))
        .otherwise(head)
    )


def _step(acc: Column, x: Column, place: Column, near: Column) -> Column:
    def state(done: Column, cur: Column, blanks: Column, off: Column = acc["off"]) -> Column:
        return F.struct(done.alias("done"), cur.alias("cur"), blanks.alias("blanks"), off.alias("off"))

    def filled(cur: Column) -> Column:
        e = x["ends"]
        same = [F.coalesce(cur["place"], place).alias("place"), _joined(cur["heads"], x["heads"]).alias("heads"), cur["holds"].bitwiseOR(x["holds"]).alias("holds")]
        early = (F.size(cur["heads"]) == 0) & (F.size(x["heads"]) == 0)
        dated = F.struct(*same, *[e[c].alias(c) for c in ("start", "end", "current")], F.lit(True).alias("dated"), early.alias("early"), cur["details"].alias("details"))
        return F.when(e.isNotNull(), dated).otherwise(F.struct(*same, *[cur[c].alias(c) for c in ("start", "end", "current", "dated", "early", "details")]))

    def added(cur: Column) -> Column:
        return F.struct(*[cur[c].alias(c) for c in ("place", "heads", "holds", "start", "end", "current", "dated", "early")], _joined(cur["details"], F.array(x["text"])).alias("details"))

    def act(a: Column) -> Column:
        zero = F.lit(0)
        return (
            F.when(a == "add", state(acc["done"], added(acc["cur"]), zero))
            .when(a == "fill", state(acc["done"], filled(acc["cur"]), zero))
            .when(a == "new", state(_closed(acc), filled(_none()), zero))
            .when(a == "end", state(_closed(acc), _none(), zero, F.when(x["kind"] == "blank", acc["off"]).otherwise(x["kind"] == "other")))
            .when(a == "blank", state(acc["done"], acc["cur"], acc["blanks"] + 1))
            .otherwise(state(acc["done"], acc["cur"], zero))
        )

    return bound_as(_STATE, _action(acc, x, near), act)


def records_in(text: Column, now: str) -> Column:
    """The records of a text as an array, in order."""
    start = F.expr(f"named_struct('done', cast(array() as array<{_RECORD}>), 'cur', cast(null as {_RECORD}), 'blanks', 0, 'off', false)").withField("cur", _none())

    def folded(lines: Column) -> Column:
        bare = lambda h: h["ends"].isNotNull() & (F.size(h["heads"]) < 2)

        def step(acc: Column, i: Column) -> Column:
            y, z = F.get(lines, i + 1), F.get(lines, i + 2)
            near = F.coalesce(bare(y) | ((y["kind"] == "head") & y["ends"].isNull() & bare(z)), F.lit(False))
            return bound_as(_STATE, F.get(lines, i), lambda x: _step(acc, x, i, near))

        return F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), start, step, _closed)

    return bound_as(f"array<{_RECORD}>", F.transform(F.split(text, "\n"), lambda line: _classed(line, now)), folded)


def experience_records(df: DataFrame, key: str, text: str, now: str) -> DataFrame:
    """``key, place, nth, title, company, start, end, current, details``: the work records of each text; ``place`` is the record's first line,
    ``nth`` its number in the text from 1."""
    rows = df.select(key, F.posexplode(F.when(F.col(text).isNotNull(), records_in(F.col(text), now))).alias("at", "r"))

    def nth(kind: int, i: int) -> Column:
        return F.when(_has(F.col("r"), kind), F.get(F.filter("r.heads", lambda h: h["k"] == kind), F.lit(i))["t"])

    titled, firm = F.coalesce(nth(TITLE, 0), nth(TITLED, 0)), F.coalesce(nth(COMPANY, 0), nth(FIRM, 0))
    title = F.coalesce(titled, nth(PLAIN, 0))
    company = F.coalesce(firm, F.when(_has(F.col("r"), TITLE | TITLED), nth(PLAIN, 0)).otherwise(nth(PLAIN, 1)))
    return rows.select(key, "r.place", (F.col("at") + 1).alias("nth"), title.alias("title"), company.alias("company"), "r.start", "r.end", "r.current", "r.details")
