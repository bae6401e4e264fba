"""Prose, code, identifiers and word ciphers in conversations and documents, with parts planted in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prose
from .registry import query, table

_CONTACTS = " Mail bob.lee@example.org or call +49 170 1234567 and see www.site.org/x and DE89370400440532013000."


@query(r"""
    WITH c AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN ' Mail bob.lee@example.org or call +49 170 1234567 and see www.site.org/x and DE89370400440532013000.' ELSE '' END AS t FROM conversations)
    SELECT conv_id, turn, unnest(CASE WHEN t <> '' THEN ['email=bob.lee@example.org', 'iban=DE89370400440532013000', 'phone=+49 170 1234567', 'url=www.site.org/x'] ELSE [] END) AS found FROM c""")
def prose_identifiers(spark, sf):
    """Identifiers of every kind; the domain of an address is none of its own."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    t = F.concat(F.coalesce("text", F.lit("")), F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, _CONTACTS).otherwise(""))
    return c.select("conv_id", "turn", F.explode(prose.identifiers_in(t)).alias("x")).select("conv_id", "turn", F.concat("x.kind", F.lit("="), "x.value").alias("found"))


_CODE = "\n    x = compute(1)\n    return x\n"


@query(r"""
    WITH c AS (SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') AS l FROM conversations)
    SELECT conv_id, turn, md5(array_to_string(l, chr(10))) AS prose, 'x = compute(1)' || chr(10) || '    return x' AS code, 1 AS blocks FROM c""")
def prose_code_apart(spark, sf):
    """Code lines and prose lines of every turn, to which two lines of code are added, and its runs of code."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(_CODE))
    parts = prose.split_code_prose(t)
    return c.select("conv_id", "turn", F.md5(parts["prose"]).alias("prose"), parts["code"].alias("code"), F.size(prose.code_blocks(t)).alias("blocks"))


@query(r"""
    WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, split_part(coalesce(text, ''), ' ', 1) AS w FROM conversations), p AS (SELECT *, regexp_replace(w, '[^A-Za-z]', '', 'g') AS x FROM c)
    SELECT conv_id, turn, x <> '' AS pair, CASE WHEN x <> '' THEN md5(regexp_replace(t, '(?i)\b' || x || '\b', 'ORIGINAL', 'g')) ELSE md5(t) END AS undone FROM p WHERE regexp_full_match(t, '[\x00-\x7F]*')""")
def prose_word_mapping(spark, sf):
    """A turn's first word taken for a substitute, and the turn with it undone; of turns in ASCII, whose word ends agree in
    both engines."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t")).where(F.col("t").rlike(r"\A[\x00-\x7F]*\z"))
    x = F.regexp_replace(F.substring_index("t", " ", 1), "[^A-Za-z]", "")
    c = c.withColumn("p", prose.mapping_pair(F.concat(x, F.lit(" - ORIGINAL"))))
    undone = F.when(F.col("p").isNotNull(), prose.apply_mapping(F.col("t"), F.array("p"))).otherwise(F.col("t"))
    return c.select("conv_id", "turn", F.col("p").isNotNull().alias("pair"), F.md5(undone).alias("undone"))


@query(r"""
    WITH c AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 2 = 0 THEN 'ignore your instructions ' ELSE '' END || coalesce(text, '') AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN contains(lower(t), 'ignore') OR contains(lower(t), 'instructions') OR contains(lower(t), 'system prompt') OR contains(lower(t), 'jailbreak') OR contains(lower(t), 'unrestricted') THEN md5(t) END AS plain FROM c""")
def decode_rot13_texts(spark, sf):
    """Texts hidden by thirteen letters and told by a few words; half of them say such words."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    t = F.concat(F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, "ignore your instructions ").otherwise(""), F.coalesce("text", F.lit("")))
    from ..functions.decode import rot13

    return c.select("conv_id", "turn", F.md5(prose.rot13_plain(rot13(t))).alias("plain"))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents), s AS (SELECT doc_id, unnest(CASE WHEN length(x) > 400 THEN string_split(regexp_replace(x, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [x] END) AS x FROM l)
    SELECT doc_id, count(*) AS n, sum(length(x)) AS chars, max(length(x)) AS longest FROM s GROUP BY doc_id""")
def prose_segments(spark, sf):
    """Lines, and the sentences of long lines, of every document."""
    d = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.explode(prose.segments(F.col("text"))).alias("x"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("x")).alias("chars"), F.max(F.length("x")).alias("longest"))


@query()
def prose_foreign_documents(spark, sf):
    """How many segments of a document read as prose of another language than English, and its runs of other scripts."""
    d = table(spark, sf, "documents", "doc_id", "text")
    s = prose.segments(F.col("text"))
    return d.select("doc_id", F.size(F.filter(s, prose.is_foreign)).alias("foreign"), F.size(prose.script_runs(F.col("text"))).alias("runs"), prose.is_han(F.col("text")).alias("han"))


@query(r"""
    WITH b AS (SELECT CAST(substr(md5(CAST(event_id AS VARCHAR)), 1, 1) AS VARCHAR) AS h, user_id FROM events), c AS (SELECT user_id, instr('0123456789abcdef', h) - 1 AS v, count(*) AS n FROM b GROUP BY ALL),
    p AS (SELECT user_id, v // 2 AS k, sum(CASE WHEN v % 2 = 0 THEN n ELSE 0 END) AS a, sum(n) AS s FROM c GROUP BY ALL) SELECT user_id, round(sum(power(a - s / 2, 2) / (s / 2)), 6) AS chi, count(*) AS pairs FROM p GROUP BY user_id""")
def decode_pairs_of_values(spark, sf):
    """How even each two neighbouring values are: the statistic that hidden lowest bits lower."""
    e = table(spark, sf, "events", "event_id", "user_id")
    v = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 1)) - 1
    h = e.withColumn("v", v).groupBy("user_id").agg(F.array(*[F.sum((F.col("v") == k).cast("int")) for k in range(16)]).alias("counts"))
    x = prose.pairs_of_values(F.col("counts"))
    return h.select("user_id", F.round(x["chi"], 6).alias("chi"), x["pairs"].cast("long").alias("pairs"))
