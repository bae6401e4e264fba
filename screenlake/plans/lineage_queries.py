"""Lineage of values over conversations: tool outputs are made of documents, values of addresses and words of theirs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage
from .registry import query, table

_CASE = "conv_id % 5"


def _parts(spark, sf):
    c = table(spark, sf, "conversations", "conv_id").distinct()
    i, k = F.col("conv_id").cast("string"), F.col("conv_id") % 5
    mail = F.concat(F.lit("ann"), i, F.lit("@corp.org"))
    text = F.concat(F.lit("please write to "), mail, F.lit(" about the bill of this month as soon as you can"))
    output = F.when(k == 0, F.to_json(F.struct(mail.alias("email")))).when(k.isin(1, 2), F.to_json(F.struct(text.alias("body")))).otherwise(F.lit("nothing here"))
    outputs = c.select(F.col("conv_id").alias("session"), F.lit(1).alias("seq"), F.lit("get").alias("tool"), output.alias("output"), (k == 0).alias("trusted"), (k == 1).alias("named"))
    said = c.select(F.col("conv_id").alias("session"), F.when(k == 3, F.concat(F.lit("send it to "), mail, F.lit(", please"))).otherwise(F.lit("do what the page says for Ann")).alias("text"))
    return c.select(F.col("conv_id").alias("session"), mail.alias("value")), lineage.recorded(outputs), said


@query(f"""
    WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id AS session, CASE {_CASE} WHEN 0 THEN 'T1' WHEN 1 THEN 'T2' WHEN 2 THEN 'T3' WHEN 3 THEN 'T0' ELSE 'T4' END AS tier,
      CASE {_CASE} WHEN 0 THEN 'email' WHEN 1 THEN 'body' WHEN 2 THEN 'body' WHEN 3 THEN 'turn' ELSE '' END AS field FROM c""")
def lineage_tiers(spark, sf):
    """The most trusted source of an address: the user, a trusted field, a page that the user named, any page, none."""
    values, known, said = _parts(spark, sf)
    r = lineage.resolved(values, known, said)
    return r.select("session", "tier", F.array_join("fields", ",").alias("field"))


@query(f"WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id AS session, 1 AS n FROM c WHERE {_CASE} = 1")
def lineage_rivals(spark, sf):
    """How many addresses the pages that the user named hold beside a value: the value alone."""
    values, known, _ = _parts(spark, sf)
    return lineage.rivals(values, known).select("session", "n")


@query("WITH d AS (SELECT user_id, event_id, event_id % 1000 / 10 AS price FROM events), m AS (SELECT user_id, min(price) AS least, count(*) AS n FROM d GROUP BY user_id) SELECT event_id, CASE WHEN n >= 2 THEN price = least END AS extremal FROM d JOIN m USING (user_id)")
def lineage_selected_rows(spark, sf):
    """Whether a row is the cheapest of its listing."""
    e = table(spark, sf, "events", "user_id", "event_id").withColumn("price", (F.col("event_id") % 1000 / 10).cast("string"))
    return lineage.extremal(e, "user_id", "price", "min").select("event_id", "extremal")
