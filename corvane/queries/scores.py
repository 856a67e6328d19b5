"""Scores: candidate against job, company hiring, record confidence, vectors, evaluation measures, token tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import scoring as C
from corvane.operators import aggregates as A
from corvane.operators import tagging as T
from corvane.queries.registry import query

WORDS = "regexp_split_to_array(lower(text), '[^a-z]+')"


def _words(c: str = "text"):
    return F.split(F.lower(c), "[^a-z]+")


@query("lineitem", sql="""
WITH h AS (SELECT l_orderkey AS o_orderkey, list_distinct(list(l_partkey % 20)) AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey, len(list_intersect(s, [1, 3, 5, 7, 9]))::int AS matching, (5 - len(list_intersect(s, [1, 3, 5, 7, 9])))::int AS missing, (len(s) - len(list_intersect(s, [1, 3, 5, 7, 9])))::int AS extra FROM h""")
def skill_set_diff(lineitem: DataFrame) -> DataFrame:
    want = F.array(*[F.lit(x).cast("long") for x in (1, 3, 5, 7, 9)])
    have = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_partkey") % 20).alias("s"))
    return have.select("o_orderkey", *[F.size(x).alias(n) for n, x in (("matching", F.array_intersect("s", want)), ("missing", F.array_except(want, "s")), ("extra", F.array_except("s", want)))])


@query("documents", sql=f"""
WITH w AS (SELECT doc_id, n_chars, lang, list_distinct({WORDS}) AS ws FROM documents),
p AS (SELECT doc_id, len(list_intersect(ws, ['the', 'and', 'of', 'to'])) / 4.0::double * 100 AS skill, least(100, (n_chars // 500) * 100.0::double / 5) AS experience,
  CASE WHEN lang = 'en' THEN 100 ELSE 60 END AS role, CASE WHEN n_chars > 1000 THEN 50 ELSE 40 END AS project FROM w)
SELECT doc_id, round(skill * 0.5 + experience * 0.2 + role * 0.1 + project * 0.1 + 50 * 0.05 + 100 * 0.05, 1) AS score,
  CASE WHEN round(skill * 0.5 + experience * 0.2 + role * 0.1 + project * 0.1 + 50 * 0.05 + 100 * 0.05, 1) >= 90 THEN 'Excellent' WHEN round(skill * 0.5 + experience * 0.2 + role * 0.1 + project * 0.1 + 50 * 0.05 + 100 * 0.05, 1) >= 75 THEN 'Good'
   WHEN round(skill * 0.5 + experience * 0.2 + role * 0.1 + project * 0.1 + 50 * 0.05 + 100 * 0.05, 1) >= 60 THEN 'Fair' ELSE 'Poor' END AS label FROM p""")
def ats_score(documents: DataFrame) -> DataFrame:
    skill = C.overlap(F.array_distinct(_words()), F.array(*map(F.lit, ("the", "and", "of", "to")))) * 100
    s = C.ats(skill, C.experience_pro_rata(F.floor(F.col("n_chars") / 500), F.lit(5)), F.when(F.col("lang") == "en", 100).otherwise(60), F.when(F.col("n_chars") > 1000, 50).otherwise(40), F.lit(50), F.lit(100))
    return documents.select("doc_id", s.alias("score")).withColumn("label", C.ats_label(F.col("score")))


@query("customer", "orders", sql="""
WITH c AS (SELECT c_custkey, c_mktsegment, coalesce(y, 0) AS y FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS y FROM orders GROUP BY 1) ON o_custkey = c_custkey),
p AS (SELECT c_custkey, CASE WHEN y < 8 THEN greatest(20.0, 100 - (8 - y) * 20.0) WHEN y > 14 THEN greatest(75.0, 100 - (y - 14) * 5.0) ELSE 100.0 END::double AS experience,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 100 WHEN c_mktsegment = 'FURNITURE' THEN 75 ELSE 50 END::double AS education, CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0.5 END::double AS req FROM c),
s AS (SELECT c_custkey, round((req * 0.7::double + CASE WHEN c_custkey % 4 = 0 THEN 0.25 ELSE 0.5 END::double * 0.3::double) * 100 * 0.5::double + experience * 0.3::double + education * 0.2::double, 2) AS score FROM p)
SELECT c_custkey, score, CASE WHEN score >= 80 THEN 'Strong Match' WHEN score >= 65 THEN 'Good Match' WHEN score >= 50 THEN 'Partial Match' ELSE 'Not Recommended' END AS label FROM s""")
def match_engine_score(customer: DataFrame, orders: DataFrame) -> DataFrame:
    c = A.counts_by_key(customer.select("c_custkey", "c_mktsegment"), orders, "c_custkey", "o_custkey", y=F.count(F.lit(1)))
    edu = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "master").when(F.col("c_mktsegment") == "FURNITURE", "bachelor")
    req = F.when(F.col("c_custkey") % 3 == 0, 1.0).otherwise(0.5)
    s = C.engine(req, F.lit(0.25), F.col("c_custkey") % 4 == 0, C.experience_band(F.col("y"), F.lit(8), F.lit(14)), C.education_gap(edu, F.lit("master")))
    return c.select("c_custkey", s.alias("score")).withColumn("label", C.engine_label(F.col("score")))


@query("customer", "orders", sql="""
WITH j AS (SELECT o_custkey, count(*) AS jobs, count(*) FILTER (WHERE o_orderdate >= timestamp '1998-01-01') AS recent FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
s AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 20 ELSE 0 END + CASE WHEN c_nationkey < 12 THEN 20 ELSE 0 END + CASE WHEN coalesce(jobs, 0) <= 0 THEN 0 WHEN jobs <= 2 THEN 10 WHEN jobs <= 5 THEN 18 ELSE 25 END
  + CASE WHEN c_mktsegment <> 'BUILDING' THEN 10 ELSE 0 END + coalesce(round(recent::double / jobs * 25), 0)::int AS score FROM customer LEFT JOIN j ON o_custkey = c_custkey)
SELECT c_custkey, score, CASE WHEN score >= 80 THEN 'Hot' WHEN score >= 50 THEN 'Warm' WHEN score >= 25 THEN 'Cool' ELSE 'Cold' END AS label FROM s""")
def hiring_score(customer: DataFrame, orders: DataFrame) -> DataFrame:
    c = A.counts_by_key(customer, orders.filter("o_orderstatus = 'O'"), "c_custkey", "o_custkey", jobs=F.count(F.lit(1)), recent=F.count_if(F.col("o_orderdate") >= F.expr("timestamp_ntz '1998-01-01'")))
    s = C.hiring(F.col("c_acctbal") > 0, F.col("c_nationkey") < 12, F.col("jobs"), F.col("c_mktsegment") != "BUILDING", F.col("recent"))
    return c.select("c_custkey", s.alias("score")).withColumn("label", C.hiring_label(F.col("score")))


_CONF = """round(CASE WHEN length(source) > 0 THEN 0.15 ELSE 0 END::double + CASE WHEN text LIKE '%@%' THEN 0.1 ELSE 0 END::double + least(1, n_chars / 2000.0::double) * 0.2::double
  + CASE WHEN n_chars > 500 THEN 0.25 ELSE 0.125 END::double + CASE WHEN lang = 'en' THEN 0.2 ELSE 0.1 END::double + CASE WHEN text LIKE '%.%' THEN 0.1 ELSE 0 END::double, 3)"""


@query("documents", sql=f"""
SELECT doc_id, conf, CASE WHEN conf >= 0.85 THEN 'very_high' WHEN conf >= 0.7 THEN 'high' WHEN conf >= 0.6 THEN 'medium' WHEN conf >= 0.4 THEN 'low' ELSE 'very_low' END AS level,
  round(CASE WHEN length(source) > 0 THEN 0.5 ELSE 0 END + CASE WHEN text LIKE '%@%' THEN 0.3 ELSE 0 END + CASE WHEN n_chars > 500 THEN 0.2 ELSE 0 END, 2)::double AS completeness
FROM (SELECT *, {_CONF} AS conf FROM documents)""")
def confidence_score(documents: DataFrame) -> DataFrame:
    has = lambda c, a, b: F.when(c, a).otherwise(b)
    long, mail, named = F.col("n_chars") > 500, F.col("text").contains("@"), F.length("source") > 0
    c = C.confidence(name=has(named, 1.0, 0.0), contact=has(mail, 1.0, 0.0), skills=F.least(F.lit(1.0), F.col("n_chars") / 2000.0), experience=has(long, 1.0, 0.5), education=has(F.col("lang") == "en", 1.0, 0.5), summary=has(F.col("text").contains("."), 1.0, 0.0))
    out = documents.select("doc_id", c.alias("conf"), C.completeness((named, 0.5), (mail, 0.3), (long, 0.2)).alias("completeness"))
    return out.withColumn("level", C.confidence_level(F.col("conf")))


@query("embeddings", sql="""
SELECT vec_id, round(list_dot_product(embedding::double[], (SELECT embedding::double[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10""")
def similarity_topk(embeddings: DataFrame) -> DataFrame:
    # one fixed query vector: a single row is joined in, and each task keeps its own ten best
    q = embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    out = embeddings.filter("vec_id <> 0").join(F.broadcast(q)).select("vec_id", F.round(C.dot(F.col("embedding"), F.col("q")), 6).alias("score"))
    return out.orderBy(F.desc("score"), "vec_id").limit(10)


@query("embeddings", sql="SELECT label, count(*) AS n, round(avg(list_dot_product(embedding::double[], embedding::double[])), 6) AS mean_square FROM embeddings GROUP BY 1")
def vector_norms(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(C.dot(F.col("embedding"), F.col("embedding"))), 6).alias("mean_square"))


_SETS = f"""
WITH w AS (SELECT d.doc_id, lang, list_distinct([x FOR x IN {WORDS} IF length(x) > 2]) AS a FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT doc_id, lang, len(list_intersect(a, ['the', 'and', 'die', 'der', 'les', 'des', 'los', 'las']))::int AS tp, (len(a) - len(list_intersect(a, ['the', 'and', 'die', 'der', 'les', 'des', 'los', 'las'])))::int AS fp,
  (8 - len(list_intersect(a, ['the', 'and', 'die', 'der', 'les', 'des', 'los', 'las'])))::int AS fn FROM w),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::double ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::double ELSE 0 END AS recall FROM s),
r AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"""


def _set_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.join(labels.select("doc_id"), "doc_id").select("doc_id", "lang", F.array_distinct(F.filter(_words(), lambda x: F.length(x) > 2)).alias("a"))
    truth = F.array(*map(F.lit, ("the", "and", "die", "der", "les", "des", "los", "las")))
    return docs.select("doc_id", "lang", *[c.alias(n) for n, c in A.set_scores(F.col("a"), truth).items()])


@query("documents", "labels", sql=_SETS + " SELECT doc_id, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r")
def set_f1(documents: DataFrame, labels: DataFrame) -> DataFrame:
    s = _set_scores(documents, labels)
    return s.select("doc_id", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("documents", "labels", sql=_SETS + """
SELECT lang, tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / nullif(p + q, 0), 6) AS f1
FROM (SELECT lang, sum(tp)::bigint AS tp, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn, sum(tp) / sum(tp + fp)::double AS p, sum(tp) / sum(tp + fn)::double AS q FROM r GROUP BY 1)""")
def prf_micro(documents: DataFrame, labels: DataFrame) -> DataFrame:
    m = A.micro(_set_scores(documents, labels), ["lang"])
    return m.select("lang", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("documents", "labels", sql=_SETS + " SELECT lang, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM r GROUP BY 1")
def prf_macro(documents: DataFrame, labels: DataFrame) -> DataFrame:
    m = A.macro(_set_scores(documents, labels), ["lang"])
    return m.select("lang", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("events", sql="""
SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1""")
def majority_label(events: DataFrame) -> DataFrame:
    return A.majority(events, ["user_id"], "event_type")


_TAGGED = """
WITH t AS (SELECT conv_id * 100 + turn AS sent, unnest(w) AS token, (generate_subscripts(w, 1) - 1)::int AS pos FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[ \\n]+') AS w FROM conversations)),
g AS (SELECT sent, pos, token, CASE WHEN length(token) % 4 = 0 THEN 'B-ROLE' WHEN length(token) % 4 = 1 THEN 'I-ROLE' WHEN length(token) % 9 = 2 THEN 'I-SKILL' ELSE 'O' END AS label FROM t)"""


def _tagged(conversations: DataFrame) -> DataFrame:
    rows = conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("sent"), F.posexplode(F.split("text", "[ \n]+")).alias("pos", "token"))
    n = F.length("token")
    return rows.withColumn("label", F.when(n % 4 == 0, "B-ROLE").when(n % 4 == 1, "I-ROLE").when(n % 9 == 2, "I-SKILL").otherwise("O"))


@query("conversations", sql=_TAGGED + """,
s AS (SELECT *, coalesce(last_value(CASE WHEN label LIKE 'B-%' THEN label[3:] WHEN label = 'O' THEN 'O' END IGNORE NULLS) OVER (PARTITION BY sent ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'O') AS state FROM g)
SELECT sent, pos, token, label FROM s WHERE label LIKE 'I-%' AND state <> label[3:]""")
def bio_consistency(conversations: DataFrame) -> DataFrame:
    return T.inconsistent(_tagged(conversations), "sent", "pos", "label").select("sent", "pos", "token", "label")


@query("conversations", sql=_TAGGED + """,
r AS (SELECT *, sum(CASE WHEN label LIKE 'B-%' OR label = 'O' OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY sent ORDER BY pos) AS run FROM (SELECT *, lag(label) OVER (PARTITION BY sent ORDER BY pos) AS prev FROM g)),
f AS (SELECT sent, run, arg_min(label, pos) AS first, min(pos) AS start FROM r WHERE label <> 'O' GROUP BY 1, 2)
SELECT f.sent, start, first[3:] AS type, string_agg(token, ' ' ORDER BY pos) AS text, count(*)::int AS n_tokens FROM f JOIN r ON f.sent = r.sent AND f.run = r.run AND r.label[3:] = first[3:] AND r.label <> 'O' WHERE first LIKE 'B-%' GROUP BY 1, 2, 3""")
def entity_spans(conversations: DataFrame) -> DataFrame:
    return T.entities(_tagged(conversations), "sent", "pos", "token", "label")


@query("conversations", sql=_TAGGED + """
SELECT regexp_replace(label, '^[BI]-', '') AS type, count(*) AS n, round(count(*) * 100.0::double / (SELECT count(*) FROM g), 2) AS pct FROM g GROUP BY 1""")
def class_balance(conversations: DataFrame) -> DataFrame:
    return T.balance(_tagged(conversations), "label")


@query("documents", sql="SELECT CASE WHEN ('0x' || left(md5('42:' || doc_id), 8))::bigint % 5 >= 4 THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(n_chars)::bigint AS chars FROM documents GROUP BY 1")
def train_test_split(documents: DataFrame) -> DataFrame:
    return T.split(documents.select("doc_id", "n_chars"), F.col("doc_id"), 5, 1).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("labels", "documents", sql="""
SELECT lang, count(*) AS documents, count(l.doc_id) AS labelled, count(*) FILTER (WHERE quality = 1) AS approved, round(count(*) FILTER (WHERE quality = 1) * 100.0::double / nullif(count(l.doc_id), 0), 2) AS approval_rate
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def labeling_statistics(labels: DataFrame, documents: DataFrame) -> DataFrame:
    j = documents.select("doc_id", "lang").join(labels.select(F.col("doc_id").alias("k"), "quality"), F.col("doc_id") == F.col("k"), "left")
    n, ok = F.count("k"), F.count_if(F.col("quality") == 1)
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), n.alias("labelled"), ok.alias("approved"), A.pct(ok, n).alias("approval_rate"))


@query("labels", "documents", sql="SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 20")
def labeling_queue(labels: DataFrame, documents: DataFrame) -> DataFrame:
    return documents.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(20)


@query("orders", sql="""
SELECT o_orderpriority, o_orderkey, o_totalprice, (rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC))::int AS place FROM orders WHERE o_orderstatus = 'P'""")
def rank_by_score(orders: DataFrame) -> DataFrame:
    rows = orders.filter("o_orderstatus = 'P'").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return rows.withColumn("place", F.rank().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"))))
