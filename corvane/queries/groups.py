"""Groups of duplicates over chains, sections by contest, and losses between texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import clusters as C
from corvane.operators import losses as Q
from corvane.operators import sections as S
from corvane.operators import survivorship as V
from corvane.operators import weak_labels as L
from corvane.operators import windows as W
from corvane.operators.rows import spread
from corvane.queries.extracts import phrases
from corvane.queries.registry import query
from corvane.streaming import jobs as J

_KEYS = """
k AS (SELECT c_custkey AS id, 'b' || c_nationkey || ':' || (cast(round(abs(c_acctbal) * 100) AS bigint) % 997) AS key FROM customer
  UNION ALL SELECT c_custkey, 's' || c_mktsegment || ':' || (cast(floor(abs(c_acctbal)) AS bigint) % 2999) FROM customer WHERE c_custkey % 7 > 0
  UNION ALL SELECT c_custkey, 'n' || right(c_name, 2) || c_mktsegment || c_nationkey FROM customer),
e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y USING (key) WHERE x.id <> y.id),
r(id, other) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
g AS (SELECT id, min(other) AS group_id FROM r GROUP BY id)"""


def _keys() -> list[Column]:
    cents, units = F.round(F.abs("c_acctbal") * 100).cast("long"), F.floor(F.abs("c_acctbal")).cast("long")
    return [
        F.concat_ws(":", "c_nationkey", (cents % 997).cast("string")),
        F.when(F.col("c_custkey") % 7 > 0, F.concat_ws(":", "c_mktsegment", (units % 2999).cast("string"))),
        F.concat(F.right("c_name", F.lit(2)), "c_mktsegment", F.col("c_nationkey").cast("string")),
    ]


@query("customer", sql=f"WITH RECURSIVE {_KEYS} SELECT id AS c_custkey, group_id FROM g")
def duplicate_groups(customer: DataFrame) -> DataFrame:
    """Customers linked by balance within a nation, by balance within a segment, or by number, and over chains of these."""
    return C.duplicate_groups(customer, "c_custkey", _keys())


@query("customer", "orders", sql=f"""
WITH RECURSIVE {_KEYS},
f AS (SELECT group_id, arg_min(id, (-c_acctbal, id)) AS survivor, count(*) AS members, arg_min(c_name, (-c_acctbal, id)) FILTER (WHERE c_custkey % 3 > 0) AS name FROM g JOIN customer ON id = c_custkey GROUP BY 1),
o AS (SELECT survivor, o_orderkey, o_custkey <> survivor AS moved, row_number() OVER (PARTITION BY survivor, o_orderdate ORDER BY o_custkey <> survivor, o_orderkey) AS rn FROM orders JOIN g ON o_custkey = id JOIN f USING (group_id)),
n AS (SELECT survivor, count(*) FILTER (WHERE NOT moved OR rn = 1) AS kept, count(*) FILTER (WHERE moved AND rn = 1) AS moved FROM o GROUP BY 1)
SELECT survivor AS c_custkey, members, name, coalesce(kept, 0) AS orders, coalesce(moved, 0) AS moved FROM f LEFT JOIN n USING (survivor)""")
def merged_customers(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """One record a group, the richest, with the first filled name; orders of the others move to it, one a day."""
    groups = C.duplicate_groups(customer, "c_custkey", _keys())
    order = [-F.col("c_acctbal")]
    rows = customer.withColumn("name", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")))
    out = C.merged(rows, "c_custkey", groups, order, ["name"])
    heads = C.survivors(customer, "c_custkey", groups, order)
    own = orders.select("o_orderkey", "o_orderdate", "o_custkey", F.col("o_custkey").alias("was"))
    n = C.adopted(own, "o_custkey", groups, heads, ["o_orderdate"], "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("was") != F.col("o_custkey")).alias("moved"))
    return out.join(n, "c_custkey", "left").fillna(0, ["orders", "moved"])


#: Headings as they are written, by number, and what they stand for; the last is none.
_HEADS = ["WORK EXPERIENCE", "Employmnt:", "** Professional History **", "OUR EXPERIENCE", ""]


def _resume(documents: DataFrame) -> DataFrame:
    """Texts with sections headed in several ways or told by content alone; what they hold comes from the documents."""
    k, n = F.col("doc_id"), F.col("n_chars")
    word = F.regexp_extract(F.concat(F.coalesce("text", F.lit("")), F.lit(" none")), r"([a-z]{3,12})", 1)
    job = F.concat(F.lit("Clerk at "), F.initcap(word), F.lit("\nJan 2001 - Mar "), (F.lit(2002) + n % 9).cast("string"), F.lit("\n- kept "), n.cast("string"), F.lit(" books"))
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (k % 5 + 1).cast("int"))
    work = F.when(head == "", F.concat(F.lit("\n"), F.regexp_replace(job, "^Clerk[^\n]*\n", ""))).otherwise(F.concat(head, F.lit("\n"), job))
    school = F.when(k % 3 == 0, F.concat(F.lit("Educaton\nBachelor of "), word)).when(k % 3 == 1, F.concat(F.lit("\nMaster of "), word, F.lit(" 1999"))).otherwise(F.concat(F.lit("ACADEMIC\nB.Sc "), word, F.lit("\n\nDiploma in "), word))
    skills = F.when(k % 2 == 0, F.concat(F.lit("Key Skills\ngo, sql, "), word)).otherwise(F.concat(F.lit("\ngo, sql, c, "), word))
    full = F.concat(F.lit("Name "), k.cast("string"), F.lit("\nLikes "), word, F.lit(".\n"), work, F.lit("\n"), school, F.lit("\n"), skills, F.when(k % 4 == 0, F.concat(F.lit("\nTechnical Skills:\nnone but "), word)).otherwise(""))
    return documents.select("doc_id", F.when(k % 50 == 49, F.lit(None)).otherwise(full).alias("t"))


@query("documents", sql="""
WITH d AS (SELECT doc_id AS k, n_chars AS n, regexp_extract(coalesce(text, '') || ' none', '([a-z]{3,12})', 1) AS w, chr(10) AS nl FROM documents WHERE doc_id % 50 <> 49)
SELECT k AS doc_id, 'header' AS section, 'position' AS way, 'Name ' || k || nl || 'Likes ' || w || '.' AS text FROM d
UNION ALL SELECT k, 'experience', ['pattern', 'fuzzy', 'pattern', 'layout', 'content'][k % 5 + 1],
  CASE WHEN k % 5 = 4 THEN '' ELSE 'Clerk at ' || upper(w[1]) || w[2:] || nl END || 'Jan 2001 - Mar ' || (2002 + n % 9) || nl || '- kept ' || n || ' books'
    || CASE WHEN k % 5 < 4 AND k % 3 = 1 THEN nl || 'Master of ' || w || ' 1999' ELSE '' END || CASE WHEN k % 5 < 4 AND k % 3 = 1 AND k % 2 = 1 THEN nl || 'go, sql, c, ' || w ELSE '' END FROM d
UNION ALL SELECT k, 'education', CASE k % 3 WHEN 0 THEN 'fuzzy' WHEN 1 THEN 'content' ELSE 'pattern' END,
  CASE k % 3 WHEN 0 THEN 'Bachelor of ' || w WHEN 1 THEN 'Master of ' || w || ' 1999' ELSE 'B.Sc ' || w || nl || 'Diploma in ' || w END || CASE WHEN k % 2 = 1 AND k % 3 <> 1 THEN nl || 'go, sql, c, ' || w ELSE '' END
  FROM d WHERE k % 3 <> 1 OR k % 5 = 4
UNION ALL SELECT k, 'skills', CASE WHEN k % 2 = 0 THEN 'pattern' ELSE 'content' END,
  CASE WHEN k % 2 = 0 THEN 'go, sql, ' || w ELSE 'go, sql, c, ' || w END || CASE WHEN k % 4 = 0 THEN nl || 'none but ' || w ELSE '' END FROM d WHERE k % 2 = 0 OR (k % 5 = 4 AND k % 3 = 1)""")
def section_contest(documents: DataFrame) -> DataFrame:
    return S.best_sections(_resume(spread(documents)), "doc_id", "t").select("doc_id", "section", "way", "text")


def _rebuilt(documents: DataFrame) -> DataFrame:
    """Each document beside itself without lines that hold a digit, with one space for white space and no list marks."""
    t = F.regexp_replace(F.regexp_replace("text", r"(?m)^.*[0-9].*$", ""), r"[\s•*+-]+", " ")
    return documents.select("doc_id", "text", t.alias("rebuilt"), F.array(F.lit("Education"), F.initcap("lang")).alias("found"))


@query("documents", sql=r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS a, coalesce(regexp_replace(regexp_replace(text, '(?m)^.*[0-9].*$', '', 'g'), '[\t\n\f\r \x0b•*+-]+', ' ', 'g'), '') AS b FROM documents),
w AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(a), '\p{L}{3,}')) AS x FROM d EXCEPT SELECT doc_id, unnest(regexp_extract_all(lower(b), '\p{L}{3,}')) FROM d)
  WHERE x NOT IN ('the', 'and', 'for', 'with', 'this', 'that', 'from', 'have', 'has', 'had', 'was', 'were', 'been', 'are', 'will', 'would', 'could', 'should', 'may', 'might', 'can', 'must', 'shall') GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::int AS n_words, CASE WHEN contains(lower(a), 'skills') THEN 1 ELSE 0 END::int AS n_skills, len(regexp_extract_all(a, '(?m)^[ \t]*[-–•*+►▸▶→▪◦][ \t]')) > len(regexp_extract_all(b, '(?m)^[ \t]*[-–•*+►▸▶→▪◦][ \t]')) + 5 AS bullets,
  len(regexp_extract_all(a, '\+?\(?[0-9]{2,4}\)?(?:[ -][0-9]{2,4}){2,4}')) > len(regexp_extract_all(b, '\+?\(?[0-9]{2,4}\)?(?:[ -][0-9]{2,4}){2,4}')) AS phones, length(a) - length(replace(a, chr(10), '')) > 0 AS lines FROM d LEFT JOIN w USING (doc_id)""")
def text_losses(documents: DataFrame) -> DataFrame:
    d = _rebuilt(spread(documents))
    a, b = F.coalesce("text", F.lit("")), F.coalesce("rebuilt", F.lit(""))
    lost = F.array_contains
    out = d.select("doc_id", Q.words_lost(a, b).alias("w"), Q.sections_lost(a, F.col("found")).alias("s"), Q.structure_lost(a, b).alias("x"))
    return out.select("doc_id", F.size("w").alias("n_words"), lost("s", "skills").cast("int").alias("n_skills"), lost("x", "bullets").alias("bullets"), lost("x", "phones").alias("phones"), lost("x", "lines").alias("lines"))


@query("documents")
def extraction_quality(documents: DataFrame) -> DataFrame:
    """Likeness and quality of each document against what was rebuilt from it; tested against a plain table of common subsequences."""
    out = Q.compare(_rebuilt(spread(documents)), "doc_id", "text", "rebuilt", "found")
    return out.select("doc_id", F.round("likeness", 6).alias("likeness"), F.round("quality", 6).alias("quality"))


@query("events")
def job_attempts(events: DataFrame) -> DataFrame:
    """Each user as a job: views queue it, errors fail an attempt, purchases end it; tested against a plain reading and as a stream."""
    rows = J.replay(J.job_events(events, {"view": "queued", "error": "failed", "purchase": "done"}), "2100-01-01")
    return rows.groupBy("job", "status").agg(F.count(F.lit(1)).alias("n"), F.max("attempts").alias("attempts"), F.max("at").alias("last_at"))


_FIELDS = """
v AS (SELECT l_orderkey AS key, 's' || l_linenumber AS source, 'mode' AS field, CASE WHEN l_partkey % 7 = 0 THEN ' ' ELSE CASE WHEN l_suppkey % 2 = 0 THEN upper(l_linestatus) ELSE lower(l_linestatus) END END AS value, l_discount * 10 AS score FROM lineitem
  UNION ALL SELECT l_orderkey, 's' || l_linenumber, 'ship', strftime(l_shipdate, '%Y-%m-%d'), l_discount * 10 FROM lineitem
  UNION ALL SELECT l_orderkey, 's' || l_linenumber, 'flag', l_returnflag || repeat('x', (l_partkey % 5)::int), l_discount * 10 FROM lineitem
  UNION ALL SELECT l_orderkey, 's' || l_linenumber, 'tags', l_returnflag || ';' || lower(l_returnflag) || '; ' || l_linestatus, 0 FROM lineitem)"""


@query("lineitem", sql=f"""
WITH {_FIELDS},
u AS (SELECT DISTINCT key, source, field, trim(value) AS value, score FROM v WHERE trim(value) <> ''),
n AS (SELECT key, field, lower(value) AS f, count(DISTINCT source) AS votes FROM u GROUP BY ALL),
r AS (SELECT u.key, u.field, value, source, f, row_number() OVER (PARTITION BY u.key, u.field ORDER BY
    CASE WHEN field = 'ship' AND NOT score >= 0.5 THEN 1 ELSE 0 END, CASE field WHEN 'mode' THEN -votes WHEN 'flag' THEN -length(value) ELSE 0 END,
    CASE WHEN field = 'ship' AND source = 's3' THEN 1 WHEN field = 'ship' AND source = 's1' THEN 2 ELSE 99 END, source, value) AS rn FROM (SELECT *, lower(value) AS f FROM u) u JOIN n USING (key, field, f) WHERE field <> 'tags'),
o AS (SELECT key, field, any_value(value) FILTER (WHERE rn = 1) AS value, any_value(source) FILTER (WHERE rn = 1) AS source, count(DISTINCT f) > 1 AS conflict FROM r GROUP BY ALL),
i AS (SELECT key, source, trim(unnest(string_split(value, ';'))) AS item, unnest(range(len(string_split(value, ';')))) AS p FROM u WHERE field = 'tags'),
j AS (SELECT key, lower(item) AS f, min((source, p, item)) AS m FROM i GROUP BY ALL)
SELECT key AS l_orderkey, field, value, source, conflict FROM o
UNION ALL SELECT j.key, 'tags', string_agg(m[3], ';' ORDER BY m), any_value(s), false FROM j JOIN (SELECT key, string_agg(DISTINCT source, ',' ORDER BY source) AS s FROM i GROUP BY 1) t ON t.key = j.key GROUP BY j.key""")
def merged_by_policy(lineitem: DataFrame) -> DataFrame:
    """An order's lines as sources of its fields, merged by the rules of a policy table."""
    source = F.concat(F.lit("s"), F.col("l_linenumber").cast("string"))
    part, flag = F.col("l_partkey"), F.col("l_returnflag")
    mode = F.when(part % 7 == 0, " ").when(F.col("l_suppkey") % 2 == 0, F.upper("l_linestatus")).otherwise(F.lower("l_linestatus"))
    fields = {"mode": mode, "ship": F.date_format("l_shipdate", "yyyy-MM-dd"), "flag": F.concat(flag, F.repeat(F.lit("x"), (part % 5).cast("int"))), "tags": F.concat(flag, F.lit(";"), F.lower(flag), F.lit("; "), "l_linestatus")}
    cells = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value"), (F.lit(0.0) if f == "tags" else F.col("l_discount") * 10).alias("score")) for f, c in fields.items()])
    values = lineitem.select(F.col("l_orderkey").alias("key"), source.alias("source"), F.inline(cells))
    policy = lineitem.sparkSession.createDataFrame(
        [("mode", "common", None, None), ("ship", "confident", ["s3", "s1"], 0.5), ("flag", "longest", None, None), ("tags", "union", None, None)], "field string, rule string, sources array<string>, least double"
    )
    return V.merge_by_policy(values, policy).withColumnRenamed("key", "l_orderkey")


@query("documents", sql="""
WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, n, unnest(range(0, greatest(n, 1), 350)) AS s FROM t WHERE n > 0)
SELECT doc_id, n AS n_tokens, count(*)::int AS n_windows, max(least(s + 400, n))::int AS last_end FROM w WHERE s = 0 OR s - 350 + 400 < n GROUP BY 1, 2""")
def token_windows(documents: DataFrame) -> DataFrame:
    d = documents.filter(F.col("text").isNotNull()).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("n"))
    out = d.select("doc_id", F.col("n").cast("long").alias("n_tokens"), W.windows(F.col("n"), 400, 350).alias("w")).filter(F.size("w") > 0)
    return out.select("doc_id", "n_tokens", F.size("w").alias("n_windows"), F.array_max("w.end").alias("last_end"))


@query("conversations", sql=r"""
WITH t AS (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '\S+')) AS token, unnest(range(len(regexp_extract_all(text, '\S+')))) AS p FROM conversations),
g AS (SELECT *, CASE WHEN regexp_matches(token, '^[A-ZÀ-Þ]') THEN 'N' END AS kind, lag(regexp_matches(token, '^[A-ZÀ-Þ]')) OVER (PARTITION BY conv_id, turn ORDER BY p) AS before FROM t)
SELECT conv_id, turn, count(*) AS n_tokens, count(*) FILTER (WHERE kind = 'N' AND NOT coalesce(before, false)) AS n_begin, count(*) FILTER (WHERE kind = 'N' AND before) AS n_inside FROM g GROUP BY 1, 2""")
def window_tags(conversations: DataFrame) -> DataFrame:
    """Runs of capitalised words tagged in overlapping windows of eight words, each blind to what lies outside it, and made one again."""
    words = conversations.select(F.struct("conv_id", "turn").alias("key"), F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("t"))
    cut = words.select("key", "t", F.inline(W.windows(F.size("t"), 8, 5)))

    def tag(i: Column) -> Column:
        named = lambda j: F.get(F.col("t"), j).rlike("^[A-ZÀ-Þ]")
        inside = (i > F.col("start")) & F.coalesce(named(i - 1), F.lit(False))
        return F.struct(i.alias("pos"), F.when(~named(i), "O").when(inside, "I-N").otherwise("B-N").alias("tag"))

    answers = cut.select("key", "start", "end", F.inline(F.transform(F.sequence(F.col("start"), F.col("end") - 1), tag)))
    out = W.reconcile(answers, "key")
    return out.groupBy("key.conv_id", "key.turn").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("tag") == "B-N").alias("n_begin"), F.count_if(F.col("tag") == "I-N").alias("n_inside"))


def _labelled_terms(benchmark: DataFrame) -> DataFrame:
    """A dictionary with labels: the benchmark's runs of two words, and its long words, which weigh less."""
    terms = phrases(benchmark).filter(F.size(F.split("term", " ")) <= 2)
    two = F.size(F.split("term", " ")) == 2
    return terms.select("term", F.when(two, "PHRASE").otherwise("WORD").alias("label"), F.when(two, 2).otherwise(1).alias("priority"))


@query("documents", "benchmark")
def weak_labels(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Tags of several tokens from a dictionary table and patterns, overlaps settled by weight; tested against every choice of spans."""
    patterns = [("NAME", r"\b[A-ZÀ-Þ]\w+(?: [A-ZÀ-Þ]\w+)+", 2), ("DATE", r"\b(?:19|20)[0-9]{2}\b", 5, "19", "20"), ("MAIL", r"[\w.+-]+@[\w-]+\.[a-z]{2,}", 5, "@")]
    spans = L.settled(L.weak_spans(documents, "doc_id", "text", _labelled_terms(benchmark), patterns), "doc_id")
    tags = L.tags(documents, "doc_id", "text", spans).select("doc_id", "tags", F.array_remove("tags", "O").alias("marked"))
    n = lambda kind: F.size(F.filter("marked", lambda t: t == kind)).alias(kind.replace("-", "_").lower())
    return tags.select("doc_id", F.size("tags").alias("n_tokens"), *[n(k) for k in ("B-PHRASE", "I-PHRASE", "B-WORD", "B-NAME", "I-NAME", "B-DATE", "B-MAIL")], F.md5(F.array_join("tags", ",")).alias("tags_md5"))
