"""Text and web pages: extraction, cleaning, quality, roles, keys, chunks, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import strings as S
from corvane.operators import records as R
from corvane.operators.rows import chunks
from corvane.queries.registry import query

_EM = S.EMAIL


def _joined(c):
    return F.array_join(F.array_sort(c), ",")


@query("documents", sql=f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{_EM}'))), ',') AS emails FROM documents WHERE len(regexp_extract_all(text, '{_EM}')) > 0""")
def email_extract(documents: DataFrame) -> DataFrame:
    # the cheap test for an @ goes first and spares most texts the pattern
    return documents.filter(F.col("text").contains("@")).select("doc_id", _joined(S.extract_all(F.col("text"), S.EMAIL)).alias("emails")).filter("emails <> ''")


@query("documents", sql=f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{S.PHONE}'))), ',') AS phones FROM documents WHERE len(regexp_extract_all(text, '{S.PHONE}')) > 0""")
def phone_extract(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", _joined(S.extract_all(F.col("text"), S.PHONE)).alias("phones")).filter("phones <> ''")


@query("pages", sql=f"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '{S.URL}'))), ',') AS urls FROM pages")
def url_extract(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", _joined(S.extract_all(F.col("html"), S.URL)).alias("urls"))


@query("pages", sql="""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>[^<]*</script>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS body FROM pages""")
def page_text(pages: DataFrame) -> DataFrame:
    t = F.regexp_replace(F.regexp_replace("html", "<script[^>]*>[^<]*</script>", " "), "<[^>]*>", " ")
    return pages.select("page_id", F.trim(F.regexp_replace(t, "[ \t\r\n]+", " ")).alias("body"))


@query("documents", sql="""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[•●▪■◦]', '-', 'g'), '[‘’]', '''', 'g'), '[“”]', '"', 'g'), '([a-z])-\\n([a-z])', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS text_md5 FROM documents""")
def text_clean(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.md5(S.clean_text(F.col("text"))).alias("text_md5"))


@query("documents", sql="""
SELECT doc_id, n AS n_words, round(least(1.0::double, n / 200.0::double) * 0.4 + u::double / n * 0.3 + CASE WHEN text LIKE '%' || chr(10) || '%' THEN 0.3 ELSE 0.1 END, 4) AS quality
FROM (SELECT doc_id, text, len(w) AS n, len(list_distinct(w)) AS u FROM (SELECT doc_id, text, regexp_split_to_array(lower(text), '[ \\n]+') AS w FROM documents))""")
def text_quality(documents: DataFrame) -> DataFrame:
    d = documents.select("doc_id", "text", F.split(F.lower("text"), "[ \n]+").alias("w"))
    n, u = F.size("w"), F.size(F.array_distinct("w"))
    q = F.least(F.lit(1.0), n / 200.0) * 0.4 + u / n * 0.3 + F.when(F.col("text").contains("\n"), 0.3).otherwise(0.1)
    return d.select("doc_id", n.cast("long").alias("n_words"), F.round(q, 4).alias("quality"))


@query("pages", sql="SELECT page_id, round(len(regexp_extract_all(lower(html), 'the|href')) * 1000.0::double / length(html), 4) AS density FROM pages")
def keyword_density(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", S.density(F.col("html"), "the|href").alias("density"))


@query("pages", sql="""
SELECT page_id, CASE WHEN regexp_matches(lower(url), '/(careers|jobs)/?$') THEN 100 WHEN regexp_matches(lower(url), '/(careers|jobs)/') THEN 80 WHEN regexp_matches(lower(url), '(careers|jobs)\\.') THEN 70
  WHEN lower(url) LIKE '%career%' OR lower(url) LIKE '%job%' THEN 50 ELSE 30 END AS confidence FROM pages""")
def url_confidence(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", S.url_confidence(F.col("url")).alias("confidence"))


_HOSTS = ["", "boards.GREENHOUSE.io", "jobs.lever.co", "x.myworkdayjobs.com", "ashbyhq.com", "smartrecruiters.com", "careers.icims.com"]


@query("pages", sql=f"""
WITH p AS (SELECT page_id, lower(url || ' ' || html || ' ' || {_HOSTS!r}[page_id % 7 + 1]) AS t FROM pages)
SELECT page_id, CASE WHEN contains(t, 'greenhouse.io') THEN 'greenhouse' WHEN contains(t, 'lever.co') THEN 'lever' WHEN contains(t, 'myworkdayjobs.com') THEN 'workday' WHEN contains(t, 'ashbyhq.com') THEN 'ashby'
  WHEN contains(t, 'smartrecruiters.com') THEN 'smartrecruiters' WHEN contains(t, 'icims.com') THEN 'icims' ELSE 'unknown' END AS provider FROM p""")
def provider_detect(pages: DataFrame) -> DataFrame:
    """Pages that link to one of the hosts by turns."""
    link = F.element_at(F.array(*map(F.lit, _HOSTS)), (F.col("page_id") % 7 + 1).cast("int"))
    return pages.select("page_id", S.provider(F.col("url"), F.concat("html", F.lit(" "), link)).alias("provider"))


@query("pages", sql="SELECT split_part(split_part(regexp_replace(url, '^https?://', ''), '/', 1), ':', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def hosts(pages: DataFrame) -> DataFrame:
    host = F.split_part(F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))
    return pages.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"))


def _role_sql(c: str) -> str:
    r = f"' ' || trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9+#. ]', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')) || ' '"
    for a, full in S.ACRONYMS:
        r = f"replace({r}, ' {a} ', ' {full} ')"
    for w in S.SENIORITY:
        r = f"replace({r}, ' {w} ', ' ')"
    return f"trim(regexp_replace(replace({r}, ' developer ', ' engineer '), '[ \\t\\r\\n\\f]+', ' ', 'g'))"


@query("part", sql=f"SELECT p_partkey, {_role_sql("'Senior ' || p_name || ' Developer'")} AS role FROM part")
def role_normalise(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", S.role_key(F.concat(F.lit("Senior "), "p_name", F.lit(" Developer"))).alias("role"))


@query("part", sql="SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%promo%' THEN 'promo' WHEN lower(p_type) LIKE '%standard%' THEN 'standard' ELSE 'other' END AS category FROM part")
def keyword_category(part: DataFrame) -> DataFrame:
    has = lambda w: F.lower("p_type").contains(w).cast("int")
    return part.select("p_partkey", S.first_best([("promo", has("promo")), ("standard", has("standard"))], "other").alias("category"))


@query("customer", sql="SELECT c_custkey, right(regexp_replace(c_name, '[^0-9]', '', 'g'), 10) AS phone_key, split_part(lower(c_name) || '@mail.example', '@', 1) AS user_name, c_name || ' ' || c_mktsegment AS search_text FROM customer WHERE length(regexp_replace(c_name, '[^0-9]', '', 'g')) >= 7")
def contact_keys(customer: DataFrame) -> DataFrame:
    mail = F.concat(F.lower("c_name"), F.lit("@mail.example"))
    out = customer.select("c_custkey", S.phone_key(F.col("c_name")).alias("phone_key"), S.local_part(mail).alias("user_name"), S.search_text(F.col("c_name"), F.col("c_mktsegment")).alias("search_text"))
    return out.filter("phone_key is not null")


@query("documents", sql="""
SELECT doc_id, len(w) AS n_tokens, n AS n_chunks, md5(array_to_string([array_to_string(w[i * 350 + 1 : i * 350 + 400], ' ') FOR i IN range(n)], '|')) AS all_md5
FROM (SELECT doc_id, w, CASE WHEN len(w) <= 400 THEN 1 ELSE cast(ceil((len(w) - 400) / 350.0) AS int) + 1 END AS n FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\n]+') AS w FROM documents))""")
def chunk_overlap(documents: DataFrame) -> DataFrame:
    d = documents.select("doc_id", F.split("text", "[ \n]+").alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(c := chunks(F.col("w"), 400, 350)).alias("n_chunks"), F.md5(F.array_join(F.transform(c, lambda x: F.array_join(x, " ")), "|")).alias("all_md5"))


@query("conversations", sql=f"""
SELECT conv_id, turn, CASE WHEN regexp_full_match(m, '{_EM}') THEN lower(m) END AS email, CASE WHEN n BETWEEN 0 AND 60 THEN n END AS years,
  concat_ws(',', CASE WHEN NOT regexp_full_match(m, '{_EM}') THEN 'invalid email' END, CASE WHEN n NOT BETWEEN 0 AND 60 THEN 'invalid years' END) AS warnings
FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN role || '@mail.example.com' ELSE role || '@' END AS m, length(text) % 90 - 10 AS n FROM conversations)""")
def validate_fix(conversations: DataFrame) -> DataFrame:
    given = conversations.select("conv_id", "turn", F.concat("role", F.when(F.col("turn") % 2 == 0, "@mail.example.com").otherwise("@")).alias("m"), (F.length("text") % 90 - 10).cast("long").alias("n"))
    email, years = R.valid_email(F.col("m")), R.valid_years(F.col("n"))
    return given.select("conv_id", "turn", email.alias("email"), years.alias("years"), F.array_join(R.warnings([("email", F.col("m"), email), ("years", F.col("n"), years)]), ",").alias("warnings"))


@query("documents", sql="""
SELECT doc_id, coalesce(nullif(trim(lang), ''), source) AS merged, concat_ws(',', CASE WHEN lower(lang) <> lower(source) THEN 'lang' END, CASE WHEN lower(source) <> lower('src0') THEN 'source' END) AS conflicts FROM documents""")
def merge_and_conflicts(documents: DataFrame) -> DataFrame:
    c = R.conflicts([("lang", F.col("lang"), F.col("source")), ("source", F.col("source"), F.lit("src0"))])
    return documents.select("doc_id", R.first_filled(F.col("lang"), F.col("source")).alias("merged"), F.array_join(c, ",").alias("conflicts"))


@query("events", sql="""
SELECT event_type, upper(event_type[1]) || lower(event_type[2:]) AS title, count(*) AS n FROM events GROUP BY 1, 2""")
def action_titles(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", S.title_action(F.col("event_type")).alias("title")).agg(F.count(F.lit(1)).alias("n"))
