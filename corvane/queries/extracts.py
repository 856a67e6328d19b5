"""What is read out of free text, and matches by vector: sections, sentences, positions, categories, assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import dates as D
from corvane.functions import strings as S
from corvane.functions.lists import bound
from corvane.operators import dictionary as V
from corvane.operators import matching as M
from corvane.operators import resumes as R
from corvane.operators.rows import spread
from corvane.queries.registry import query


@query("part", sql="""
SELECT p_partkey, score FROM (SELECT p_partkey, CASE WHEN n = 'blu' THEN 100.0 WHEN starts_with(n, 'blu') THEN 80 + round(3.0::double / length(n) * 19, 2) WHEN contains(n, 'blu') THEN 60 + round(3.0::double / length(n) * 19, 2)
  WHEN regexp_matches(n, 'b.*l.*u') THEN round(3.0::double / length(n) * 50, 2) ELSE 0 END::double AS score FROM (SELECT p_partkey, lower(p_name) AS n FROM part)) WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 10""")
def autocomplete(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", S.autocomplete_score(F.col("p_name"), "blu").alias("score")).filter("score > 0").orderBy(F.desc("score"), "p_partkey").limit(10)


@query("orders", sql="""
SELECT o_orderkey, date_trunc('month', o_orderdate)::date AS month_start, last_day(o_orderdate) AS month_end, date_trunc('day', o_orderdate)::timestamp AS day_start,
  greatest(0, (1998 - year(o_orderdate)) * 12 + 8 - month(o_orderdate))::int AS months_to_now, cast(floor(epoch(timestamp '1998-08-02' - o_orderdate) / 86400) AS bigint) AS days_to_now FROM orders""")
def date_parts(orders: DataFrame) -> DataFrame:
    d = F.col("o_orderdate")
    return orders.select("o_orderkey", F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_end"), F.date_trunc("day", d).cast("timestamp_ntz").alias("day_start"), D.months(d, F.lit("1998-08-02").cast("date")).alias("months_to_now"), D.days_before(d, "1998-08-02").alias("days_to_now"))


@query("documents", sql="""
WITH a AS (SELECT doc_id, flatten([CASE WHEN length(trim(y)) > 200 THEN regexp_split_to_array(trim(y), '[,;] +') ELSE [trim(y)] END FOR y IN regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')]) AS s FROM documents),
b AS (SELECT doc_id, [x FOR x IN s IF length(x) >= 3] AS s FROM a)
SELECT doc_id, len(s) AS n_sentences, list_max(list_transform(s, lambda x: length(x)))::int AS longest, md5(array_to_string(s, '|')) AS all_md5 FROM b""")
def sentence_chunks(documents: DataFrame) -> DataFrame:
    s = documents.select("doc_id", R.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).alias("longest"), F.md5(F.array_join("s", "|")).alias("all_md5"))


@query("documents", sql="""
SELECT doc_id, n AS n_hits, strpos(text, 'token') - 1 AS first_at FROM (SELECT doc_id, text, (length(text) - length(replace(text, 'token', ''))) // 5 AS n FROM documents) WHERE n > 0""")
def value_positions(documents: DataFrame) -> DataFrame:
    p = documents.filter(F.col("text").contains("token")).select("doc_id", R.positions(F.col("text"), F.lit("token")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n_hits"), F.col("p")[0].cast("long").alias("first_at"))


@query("conversations", sql="""
WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\\S+')) AS token FROM conversations)
SELECT conv_id, turn, count(*) AS n_tokens, sum(length(token))::bigint AS chars FROM t GROUP BY 1, 2""")
def token_offsets(conversations: DataFrame) -> DataFrame:
    rows = R.tokens_with_offsets(conversations.select(F.struct("conv_id", "turn").alias("k"), "text"), "k", "text")
    return rows.groupBy("k.conv_id", "k.turn").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query("documents", sql="""
SELECT doc_id, concat_ws(',', CASE WHEN t LIKE '% the %' THEN 'the' END, CASE WHEN t LIKE '% die %' THEN 'die' END, CASE WHEN t LIKE '% token %' THEN 'token' END) AS skills
FROM (SELECT doc_id, regexp_replace(' ' || regexp_replace(lower(text), '[^a-z0-9+#.]+', ' ', 'g') || ' ', '\\. ', ' ', 'g') AS t FROM documents)""")
def skills_named(documents: DataFrame) -> DataFrame:
    return spread(documents).select("doc_id", F.array_join(R.skills_in(F.col("text"), ["the", "die", "token"]), ",").alias("skills"))


def phrases(benchmark: DataFrame) -> DataFrame:
    """A dictionary table: every word run of two or three words in the benchmark's texts, and its words of nine letters or more."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    runs = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    every = bound(words, lambda w: F.concat(runs(w, 2), runs(w, 3), F.filter(w, lambda x: F.length(x) >= 9)))
    return benchmark.select(F.explode(every).alias("term")).distinct()


@query("documents", "benchmark")
def dictionary_terms(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Thousands of terms over whole texts; tested against a plain reading of the rules."""
    out = V.matched_and_rest(documents, "doc_id", "text", phrases(benchmark), "term")
    return out.select("doc_id", "n_matches", F.size("terms").alias("n_terms"), F.md5("remainder").alias("remainder_md5"))


@query("part", sql="""
SELECT p_name, CASE WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])bolt([^a-z0-9]|$)') THEN 'fastener' WHEN contains(lower(p_name), 'giz') THEN 'toy' ELSE 'other' END AS category FROM (SELECT DISTINCT p_name FROM part)""")
def keyword_points(part: DataFrame) -> DataFrame:
    words = part.sparkSession.createDataFrame([("bolt", "fastener"), ("giz", "toy"), ("bolts", "storage")], "keyword string, category string")
    return R.categories(part, "p_name", words)


@query("nation", "region", sql="""
SELECT name, domain FROM (SELECT n_name AS name, 'nation' AS domain FROM nation UNION ALL SELECT r_name, 'general' FROM region WHERE lower(r_name) NOT IN (SELECT lower(n_name) FROM nation))""")
def taxonomy_union(nation: DataFrame, region: DataFrame) -> DataFrame:
    return R.taxonomy_merge([nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("domain")), region.select(F.col("r_name").alias("name"), F.lit("").alias("domain"))], "name", "domain")


@query("events", sql="SELECT event_type, sum(cast(json_extract_string(props, '$.k') AS bigint))::bigint AS total, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1")
def map_distribution(events: DataFrame) -> DataFrame:
    rows = events.select("event_type", F.explode_outer(F.from_json("props", "map<string,bigint>")).alias("k", "v")).filter("k = 'k'")
    return rows.groupBy("event_type").agg(F.sum("v").alias("total"), F.count("v").alias("n"))


_COS = "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v))"


@query("embeddings", sql=f"""
WITH e AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings)
SELECT vec_id, other, sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS rn FROM (
  SELECT a.vec_id, b.vec_id AS other, round({_COS}, 9) AS sim FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 50 = 0)) WHERE rn <= 5""")
def similar_within_label(embeddings: DataFrame) -> DataFrame:
    """The five most similar rows of the same label for every row whose id is divisible by 50, against all rows."""
    return M.nearest_within(embeddings.filter("vec_id % 50 = 0"), embeddings, "vec_id", "label", "embedding", 5)


@query("lineitem", "embeddings", sql=f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::double[] AS v FROM embeddings), n AS (SELECT count(*) AS n FROM e),
l AS (SELECT DISTINCT l_orderkey AS job, l_linenumber % 2 = 1 AS want, lpad((l_partkey % n)::varchar, 6, '0') AS skill, l_partkey % n AS vec_id FROM lineitem, n),
p AS (SELECT x.job, x.skill AS wanted, y.skill AS had, CASE WHEN x.skill = y.skill THEN 1.0::double ELSE round({_COS}, 9) END AS sim FROM l x JOIN l y ON x.job = y.job AND x.want AND NOT y.want JOIN e a ON a.vec_id = y.vec_id JOIN e b ON b.vec_id = x.vec_id),
q AS (SELECT * FROM p WHERE sim > 0.05), s AS (SELECT job, wanted, row_number() OVER (PARTITION BY job ORDER BY wanted) AS k FROM (SELECT DISTINCT job, wanted FROM q)),
g AS (
  SELECT job, 0::bigint AS k, []::varchar[] AS taken, NULL::varchar AS wanted, NULL::varchar AS had, NULL::double AS sim FROM (SELECT DISTINCT job FROM q)
  UNION ALL
  SELECT job, k, CASE WHEN had IS NULL THEN taken ELSE list_append(taken, had) END, wanted, had, sim FROM (
    SELECT g.job, g.k + 1 AS k, g.taken, s.wanted, q.had, q.sim, row_number() OVER (PARTITION BY g.job ORDER BY q.sim DESC NULLS LAST, q.had) AS rn
    FROM g JOIN s ON s.job = g.job AND s.k = g.k + 1 LEFT JOIN q ON q.job = g.job AND q.wanted = s.wanted AND NOT list_contains(g.taken, q.had)) WHERE rn = 1)
SELECT job, wanted, had, sim FROM g WHERE had IS NOT NULL""")
def greedy_assignment(lineitem: DataFrame, embeddings: DataFrame) -> DataFrame:
    """An order is an application: the parts of its odd lines are wanted, those of its even lines are had; parts have vectors."""
    n = embeddings.count()
    parts = lineitem.select(F.col("l_orderkey").alias("job"), (F.col("l_linenumber") % 2 == 1).alias("w"), F.lpad((F.col("l_partkey") % n).cast("string"), 6, "0").alias("skill")).distinct()
    vectors = embeddings.select(F.lpad(F.col("vec_id").cast("string"), 6, "0").alias("skill"), F.col("embedding").alias("vector"))
    have = parts.filter("not w").select(F.col("job").alias("candidate"), "job", "skill")
    pairs = M.similar_skills(have, parts.filter("w").select("job", "skill"), vectors, least=0.05)
    return M.assign(pairs.withColumn("sim", F.round("sim", 9))).select("job", "wanted", "had", "sim")
