"""Integrity checks, set operations, balanced samples and audit chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chains, statistics
from .registry import query, table


@query("""
    SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS empty_text, count(*) FILTER (WHERE doc_id IS NULL) AS no_id, count(*) FILTER (WHERE lang IS NULL) AS no_lang FROM documents""")
def integrity_schema(spark, sf):
    n = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
    d = table(spark, sf, "documents", "doc_id", "text", "lang")
    return d.agg(F.count("*").alias("n"), n(F.col("text").isNull() | (F.trim("text") == ""), "empty_text"), n(F.col("doc_id").isNull(), "no_id"), n(F.col("lang").isNull(), "no_lang"))


@query("SELECT count(*) AS groups, sum(c - 1) AS extra FROM (SELECT count(*) AS c FROM documents GROUP BY text HAVING count(*) > 1)")
def integrity_duplicates(spark, sf):
    g = table(spark, sf, "documents", "text").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("c")).where("c > 1")
    return g.agg(F.count("*").alias("groups"), F.sum(F.col("c") - 1).alias("extra"))


@query("SELECT count(*) AS shared FROM (SELECT text FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 5 <> 0)")
def integrity_split_disjointness(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").select(F.sha2("text", 256).alias("h"), (F.col("doc_id") % 5 == 0).alias("test"))
    return d.groupBy("h").agg(F.max("test").alias("a"), F.min("test").alias("b")).where("a and not b").agg(F.count("*").alias("shared"))


@query("""
    SELECT lang, source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY lang, source""")
def integrity_distribution(spark, sf):
    d = table(spark, sf, "documents", "lang", "source", "n_chars").groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
    return d.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 6))


@query("""
    WITH r AS (SELECT l.doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(l.doc_id AS VARCHAR)), l.doc_id) AS k FROM labels l),
    m AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM labels GROUP BY toxic)) SELECT doc_id, toxic FROM r, m WHERE k <= least""")
def integrity_balance(spark, sf):
    """As many rows of each class as the rarer one has: a sampling operator, by a hash of the id."""
    rows = table(spark, sf, "labels", "doc_id", "toxic")
    least = rows.groupBy("toxic").count().agg(F.min("count").alias("least"))
    return statistics.smallest_of_each(rows.withColumn("h", F.md5(F.col("doc_id").cast("string"))), "toxic", "h", "doc_id", least).select("doc_id", "toxic")


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id LIMIT 100")
def sources_seeded_sample(spark, sf):
    """A seeded sample of 100 rows, the same in any run: a sampling operator."""
    key = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7")))
    return table(spark, sf, "documents", "doc_id").orderBy(key, "doc_id").limit(100)


@query("""
    SELECT event_id, sha256(user_id || '|' || event_type || '|' || props) AS args_hash FROM events""")
def gate_args_hash(spark, sf):
    return table(spark, sf, "events", "event_id", "user_id", "event_type", "props").select("event_id", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props"), 256).alias("args_hash"))


#: Entries of a log's segment: links chain inside it, and its last link seals it into the next one's start.
SEGMENT = 64


@query(f"""
    WITH RECURSIVE l AS (SELECT user_id, event_id, sha256(event_id || '|' || event_type || '|' || props) AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events),
    c AS (SELECT user_id, event_id, k, sha256('start' || h) AS link FROM l WHERE k % {SEGMENT} = 0
      UNION ALL SELECT l.user_id, l.event_id, l.k, sha256(c.link || l.h) FROM c JOIN l ON l.user_id = c.user_id AND l.k = c.k + 1 AND l.k % {SEGMENT} <> 0),
    e AS (SELECT user_id, k // {SEGMENT} AS segment, arg_max(link, k) AS last FROM c GROUP BY ALL),
    s AS (SELECT user_id, segment, sha256('start' || last) AS seal FROM e WHERE segment = 0 UNION ALL SELECT e.user_id, e.segment, sha256(s.seal || e.last) FROM s JOIN e ON e.user_id = s.user_id AND e.segment = s.segment + 1)
    SELECT event_id, link, seal, event_id % 97 <> 0 AS verified FROM c JOIN s ON s.user_id = c.user_id AND s.segment = c.k // {SEGMENT}""")
def gate_audit_chain(spark, sf):
    """Each user's log as a hash chain; then every 97th entry's content is altered, and verification tells just those."""
    log = table(spark, sf, "events", "user_id", "event_id", "event_type", "props")
    content = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    chained = chains.chain(log.select("user_id", "event_id", content.alias("content")), "user_id", "event_id", "content", SEGMENT)
    stored = chained.withColumn("content", F.when(F.col("event_id") % 97 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")))
    return chains.verify(stored, "content").select("event_id", "link", "seal", "verified")
