"""Event counts by time, sessions and latest states as tables, and rows as sinks leave them: deleted, expired, in lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.udfs import reading_order
from corvane.operators.resumes import tokens_with_offsets
from corvane.queries.registry import query
from corvane.sources import writers as K
from corvane.streaming import events as S


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("events", sql="SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_events(events: DataFrame) -> DataFrame:
    """What the stream of daily counts comes to over the whole table."""
    return S.daily_counts(_timed(events))


@query("events", sql="""
WITH w AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, timestamp '1970-01-01') - INTERVAL 6 HOUR * i AS start FROM events, range(4) t(i))
SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def sliding_events(events: DataFrame) -> DataFrame:
    return S.sliding_counts(_timed(events)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("events", sql="""
WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, i""")
def user_sessions(events: DataFrame) -> DataFrame:
    out = S.sessions(_timed(events))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("events", sql="""
SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def user_state(events: DataFrame) -> DataFrame:
    """What the stateful stream of latest events holds once all events have come."""
    return S.latest_per_key(_timed(events)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("customer", sql="""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'deleted' ELSE c_mktsegment END AS status, CASE WHEN c_acctbal < 0 THEN timestamp '1998-08-02' END AS deleted_at FROM customer""")
def soft_deleted(customer: DataFrame) -> DataFrame:
    rows = customer.select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("status"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    return K.soft_delete(rows, F.col("c_acctbal") < 0, F.expr("timestamp_ntz '1998-08-02'")).drop("c_acctbal")


@query("part", "lineitem", sql="""
SELECT p_partkey, p_name, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= timestamp '1998-06-01') AS is_active FROM part""")
def expired_parts(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    seen = lineitem.filter(F.col("l_shipdate") >= F.expr("timestamp_ntz '1998-06-01'")).select(F.col("l_partkey").alias("p_partkey"))
    return K.expire_not_seen(part.select("p_partkey", "p_name"), seen, "p_partkey")


@query("conversations", sql=r"""
WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\S+')) AS token, unnest(range(len(regexp_extract_all(text, '\S+')))) AS p FROM conversations)
SELECT conv_id, turn, md5(string_agg(token || chr(9) || CASE WHEN regexp_matches(token, '^[A-ZÀ-Þ]') THEN 'B-NAME' ELSE 'O' END, chr(10) ORDER BY p) || chr(10)) AS lines FROM t GROUP BY 1, 2""")
def conll_sentences(conversations: DataFrame) -> DataFrame:
    """Each turn in the lines that the token file writer puts out."""
    rows = tokens_with_offsets(conversations.select(F.struct("conv_id", "turn").alias("k"), "text"), "k", "text")
    label = F.when(F.col("token").rlike("^[A-ZÀ-Þ]"), "B-NAME").otherwise("O")
    return K.conll_lines(rows.withColumn("label", label), "k", "pos", "token", "label").select("k.conv_id", "k.turn", F.md5("value").alias("lines"))


@query("conversations", sql="""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'left a ' || turn || chr(10) || 'left b' || chr(10) || 'left ' || role || chr(10) || 'right one' || chr(10) || 'right two' || chr(10) || 'right ' || conv_id ELSE 'plain ' || role || chr(10) || 'lines    here' END AS text FROM conversations""")
def column_order(conversations: DataFrame) -> DataFrame:
    """Pages set in two columns, and others, in the order in which they are read."""
    pad = lambda c: F.rpad(c, 30, " ")
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    two = F.concat(pad(F.concat(F.lit("left a "), turn)), F.lit("right one\n"), pad(F.lit("left b")), F.lit("right two\n"), pad(F.concat(F.lit("left "), F.col("role"))), F.lit("right "), conv)
    page = F.when(F.col("turn") % 2 == 0, two).otherwise(F.concat(F.lit("plain "), F.col("role"), F.lit("\nlines    here")))
    return conversations.select("conv_id", "turn", reading_order(page).alias("text"))
