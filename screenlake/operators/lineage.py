"""Lineage of values by trust tier: leaves of tool outputs, the most trusted source of a value, and what a user bound.

Tiers: T0 typed by the user, T1 a trusted tool's own field, T2 third-party text that the user pointed at, T3 other third-party
text, T4 unknown. Leaves meet values of their own session by an equi-join; the best tier is a minimum over the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prose import identifiers_in, looks_like_identifier
from ..functions.text import fold, fold_identifier
from .provenance import leaves

# Words from which a value is prose, fields that are content, and kinds of sensitive fields and texts.
PROSE_WORDS, SHORT = 10, 4
CONTENT_FIELDS = ("body", "content", "message", "text", "subject", "title", "description", "note", "notes", "comment", "summary")
SENSITIVE_FIELDS = (
    (r"(?i)password|passcode|\bpin\b|cvv|cvc|security.?code|verification.?code|otp|secret|api.?key|token", "credential"),
    (r"(?i)credit.?card|card.?number|card.?no", "credential"),
    (r"(?i)passport|id.?number|national.?id|ssn|social.?security|tax.?id|bank.?account|account.?number|date.?of.?birth|\bdob\b|driver.?s?.?licen", "personal"),
)
SENSITIVE_TEXTS = (
    r"(?i)(?:security|verification|confirmation|login|one[- ]time|2fa|access|reset)\s+code\b[^0-9\n]{0,40}?(\d{4,10})",
    r"(?i)\b(?:password|passcode|pin)\b(?:\s+(?:is|was)|:)\s*([^\s,;.]{4,})",
    r"\b(\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})\b",
)
# Superlatives of a request, by attribute and direction.
CRITERIA = (
    (r"\b(cheapest|least expensive|lowest[- ]priced?)\b", "price", "min"),
    (r"\b(most expensive|priciest|highest[- ]priced)\b", "price", "max"),
    (r"\b(highest[- ]rated|best[- ]rated|top[- ]rated|best[- ]reviewed)\b", "rating", "max"),
    (r"\b(lowest[- ]rated|worst[- ]rated)\b", "rating", "min"),
    (r"\b(newest|latest|most recent)\b", "date", "max"),
    (r"\b(oldest|earliest)\b", "date", "min"),
)
COMMITS = r"(^|_)(reserve|book|order|purchase|buy|subscribe|checkout)(_|$)"


def bounded_in(needle: Column, hay: Column) -> Column:
    """Whether a folded value stands in a folded text with no letter, digit or sign of an address against it."""
    pattern = F.concat(F.lit(r"(?<![\w@.\-])\Q"), F.replace(needle, F.lit(r"\E"), F.lit("")), F.lit(r"\E(?![\w@\-]|\.\w)"))
    return F.coalesce((needle != "") & hay.contains(needle) & F.rlike(hay, pattern), F.lit(False))


def user_named(params: Column, said: Column) -> Column:
    """Whether the user typed any of a read's arguments (a map) of three characters or more."""
    return F.exists(F.map_values(params), lambda v: (F.length(fold(v)) >= 3) & bounded_in(fold(v), fold(said)))


def recorded(outputs: DataFrame) -> DataFrame:
    """Leaves (session, seq, tier, tool, field, text, structural, direct) of tool outputs.

    outputs: (session, seq, tool, output as JSON, trusted, named). A trusted tool's short fields are T1 and structural, but
    its content fields and prose are third-party text; that is T2 where the user named the read, else T3. An output that is
    no JSON is one leaf without a field.
    """
    keys = ["session", "seq", "tool", "trusted", "named"]
    plain = outputs.where(F.try_parse_json("output").isNull() & F.col("output").isNotNull()).select(*keys, F.lit("").alias("path"), F.col("output").alias("value"))
    every = leaves(outputs, keys, "output").unionByName(plain).where("value is not null")
    field = F.lower(F.regexp_extract("path", r"([^.\[\]]*)(?:\[\d+\])*$", 1))
    prose = F.size(F.split(F.trim("value"), r"\s+")) >= PROSE_WORDS
    content = ~F.col("trusted") | field.isin(*CONTENT_FIELDS) | prose
    third = F.when(F.col("named"), "T2").otherwise("T3")
    return every.select("session", "seq", F.when(content, third).otherwise("T1").alias("tier"), "tool", field.alias("field"), fold(F.col("value")).alias("text"), (~content).alias("structural"), "named").where("text <> ''").withColumnRenamed("named", "direct")


def resolved(values: DataFrame, known: DataFrame, said: DataFrame) -> DataFrame:
    """values (session, value) with tier and fields: the most trusted source of each.

    said: (session, text) of the user. Numbers and short values match whole fields only; a value inside a trusted field
    counts as T3; identifiers match without spaces and hyphens.
    """
    v = values.select("session", "value").distinct().withColumn("v", fold(F.col("value"))).withColumn("vid", fold_identifier(F.col("value"))).withColumn("is_id", looks_like_identifier(F.col("value")))
    loose = (F.length("v") >= SHORT) & ~F.col("v").rlike(r"^[\d.,:\-/ ]+$")
    typed = v.join(said, "session").where(bounded_in(F.col("v"), fold(F.col("text"))) | (F.col("is_id") & fold_identifier(F.col("text")).contains(F.col("vid"))))
    typed = typed.select("session", "value", F.lit("T0").alias("tier"), F.lit("turn").alias("field"))
    m = v.join(known, "session")
    whole = (F.col("text") == F.col("v")) | (F.col("is_id") & (fold_identifier(F.col("text")) == F.col("vid")))
    inside = (F.col("is_id") & fold_identifier(F.col("text")).contains(F.col("vid"))) | (loose & bounded_in(F.col("v"), F.col("text")))
    found = m.where(whole | inside).select("session", "value", F.when(whole | ~F.col("structural"), F.col("tier")).otherwise("T3").alias("tier"), "field")
    every = typed.unionByName(found)
    best = every.groupBy("session", "value").agg(F.min("tier").alias("tier"))
    fields = every.join(best, ["session", "value", "tier"]).groupBy("session", "value", "tier").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    none = F.array().cast("array<string>")
    return values.join(fields, ["session", "value"], "left").withColumn("tier", F.coalesce("tier", F.lit("T4"))).withColumn("fields", F.coalesce("fields", none))


def anchored(values: DataFrame, known: DataFrame, anchors: DataFrame) -> DataFrame:
    """Values (session, value) that stand in a T2 text which also holds something that the user typed (session, anchor)."""
    t2 = known.where("tier = 'T2' and not structural").select("session", "seq", "text")
    typed = t2.join(anchors, "session").where((F.length(fold(F.col("anchor"))) >= 3) & bounded_in(fold(F.col("anchor")), F.col("text"))).select("session", "seq", "text").distinct()
    v = values.select("session", "value").distinct()
    return v.join(typed, "session").where(bounded_in(fold(F.col("value")), F.col("text"))).select("session", "value").distinct()


def rivals(values: DataFrame, known: DataFrame) -> DataFrame:
    """(session, value, n): different identifiers of the value's kind in the T2 texts that hold it."""
    v = values.select("session", "value").distinct().withColumn("kind", F.get(identifiers_in(F.col("value")), F.lit(0))["kind"]).where("kind is not null")
    t = known.where("tier = 'T2' and not structural").select("session", F.col("text"), F.explode(identifiers_in(F.col("text"))).alias("x"))
    hits = v.join(t, "session").where((F.col("x.kind") == F.col("kind")) & F.col("text").contains(fold(F.col("value"))))
    return hits.groupBy("session", "value").agg(F.countDistinct(fold_identifier(F.col("x.value"))).alias("n"))


def sensitive(known: DataFrame) -> DataFrame:
    """(session, value, category) of values that a field's name, or the text around them, says are sensitive."""
    by_field = F.coalesce(*[F.when(F.col("field").rlike(p), F.lit(kind)) for p, kind in SENSITIVE_FIELDS])
    named = known.where("structural").select("session", F.col("text").alias("value"), by_field.alias("category")).where(F.col("category").isNotNull() & (F.length("value") >= SHORT))
    said = [F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in SENSITIVE_TEXTS]
    told = known.select("session", F.explode(F.concat(*said)).alias("value")).select("session", fold(F.col("value")).alias("value"), F.lit("credential").alias("category"))
    return named.unionByName(told).groupBy("session", "value").agg(F.min("category").alias("category"))


def action_family(tool: Column, kind: Column) -> Column:
    """COMMIT for tools that order or book, else the capability."""
    return F.when(F.lower(F.coalesce(tool, F.lit(""))).rlike(COMMITS), "COMMIT").otherwise(kind)


def criterion(said: Column) -> Column:
    """struct<attribute, direction> of a request's superlative; null without one, or with two different ones."""
    t = F.lower(F.coalesce(said, F.lit("")))
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(t.rlike(p), F.struct(F.lit(a).alias("attribute"), F.lit(d).alias("direction"))) for p, a, d in CRITERIA])))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def extremal(rows: DataFrame, batch: str, value: str, direction: str) -> DataFrame:
    """rows with extremal: whether a row's number is the largest (or smallest) of its listing; null in a listing of one."""
    w = Window.partitionBy(batch)
    x = F.col(value).try_cast("double")
    top = F.max(x).over(w) if direction == "max" else F.min(x).over(w)
    return rows.withColumn("extremal", F.when((F.count(x).over(w) >= 2) & x.isNotNull(), x == top))


def matches_literal(literals: Column, value: Column) -> Column:
    """Whether a value is one of the user's literals (folded, signs at the end aside), or a code of up to three letters that
    begins one or is made of its words' first letters."""
    norm = lambda c: F.regexp_replace(fold_identifier(c), r"[.!?,;:]+$", "")
    first = lambda x: F.array_join(F.transform(F.filter(F.split(fold(x), r"[\s\-_/]+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")
    v = norm(value)
    short = F.length(v).between(1, 3)
    code = lambda x: short & x.rlike(r"^[A-Za-z][A-Za-z \-_/]*$") & (F.startswith(norm(x), v) | (first(x) == v))
    return F.exists(literals, lambda x: (norm(x) == v) | code(x))


def matches_pattern(pattern: Column, value: Column) -> Column:
    """Whether a value fits a pattern in which {name} and * stand for some text."""
    parts = F.transform(F.split(pattern, r"\{[^{}]*\}|\*", -1), lambda p: F.concat(F.lit(r"\Q"), F.lower(p), F.lit(r"\E")))
    return F.rlike(fold(value), F.concat(F.lit("(?s)^"), F.array_join(parts, ".+?"), F.lit("$")))


def contract(rows: DataFrame) -> DataFrame:
    """(session, tool, max_calls, literals) of the well-formed parts (session, tool, calls, literals) of a contract: calls add
    up, literals come together; parts without a tool or with calls under one are dropped."""
    good = rows.where(F.col("tool").isNotNull() & (F.trim("tool") != "") & (F.coalesce("calls", F.lit(1)) >= 1))
    return good.groupBy("session", F.lower(F.trim("tool")).alias("tool")).agg(F.sum(F.coalesce("calls", F.lit(1))).alias("max_calls"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("literals", F.array().cast("array<string>")))))).alias("literals"))
