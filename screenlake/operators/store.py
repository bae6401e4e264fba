"""The store of third-party chunks: admission, routing, signatures, retrieval with validation, review and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import axis, signing

# Limits of admission and retention, similarities of retrieval.
MOST_BYTES, STORE_ROOM, QUOTA, SESSION_CHUNKS = 200_000, 10_000, 200, 256
RELEVANT, SAME, FLAGGED_DENSITY = 0.25, 0.95, 0.6


def is_session_scoped(source: Column, scope: Column) -> Column:
    return (F.coalesce(scope, F.lit("")) == "session") | F.coalesce(source, F.lit("")).startswith("tool_response")


def admitted(chunks: DataFrame, held: DataFrame, size: int = MOST_BYTES, quota: int = QUOTA) -> DataFrame:
    """chunks (chunk, principal, seq, text) with verdict: too large, over the principal's quota, else admitted.

    held (principal, n) says what each principal has in the store already. A principal's chunks count in order of seq; large
    ones take no place.
    """
    ok = F.octet_length(F.coalesce("text", F.lit(""))) <= size
    rank = F.sum(F.when(ok, 1).otherwise(0)).over(Window.partitionBy("principal").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    out = chunks.join(held, "principal", "left").withColumn("k", rank + F.coalesce("n", F.lit(0)))
    return out.withColumn("verdict", F.when(~ok, "too large").when(F.col("k") > quota, "over quota").otherwise("admitted")).drop("k", "n")


def routed(chunks: DataFrame, density: str, injection: str, key: bytes) -> DataFrame:
    """chunks with trust, status (quarantine, review, trusted), digest and a signature of id, text and verdict."""
    trust = axis.document_trust(F.col(density), F.col(injection))
    out = chunks.withColumn("trust", trust).withColumn("status", axis.trust_route(F.col("trust"))).withColumn("digest", signing.folded_digest(F.col("text")))
    return out.withColumn("signature", signing.hmac_sha256(key, record(F.col("chunk"), F.col("text"), F.col("status"))))


def record(chunk: Column, text: Column, status: Column) -> Column:
    """What a signature covers: lengths go before parts, so no two records read alike."""
    part = lambda c: F.concat(F.length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))
    return F.concat(part(chunk.cast("string")), part(text), part(status))


def is_valid(key: bytes) -> Column:
    return F.coalesce(signing.hmac_sha256(key, record(F.col("chunk"), F.col("text"), F.col("status"))) == F.col("signature"), F.lit(False))


def retained(chunks: DataFrame, session: str, seq: str, most: int = SESSION_CHUNKS) -> DataFrame:
    """The latest ``most`` chunks of a session."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(seq)))
    return chunks.withColumn("__k", rank).where(F.col("__k") <= most).drop("__k")


def visible(shared: DataFrame, own: DataFrame, session: str) -> DataFrame:
    """What a session may have read: the shared chunks and its own."""
    return shared.withColumn(session, F.lit(None).cast(dict(own.dtypes)[session])).unionByName(own, allowMissingColumns=True)


def flagged(valid: Column, blocked: Column, density: Column) -> Column:
    return ~F.coalesce(valid, F.lit(False)) | F.coalesce(blocked, F.lit(False)) | F.coalesce(density > FLAGGED_DENSITY, F.lit(False))


def usage(valid: Column, blocked: Column, similarity: Column) -> Column:
    """What becomes of a retrieved chunk."""
    return F.when(~valid | blocked, "quarantined").when(similarity < RELEVANT, "not_relevant").otherwise("used")


def diverse(ranked: DataFrame, query: str, rank: str, source: str, cluster: str, k: int) -> DataFrame:
    """Of ranked candidates the first k of a query that come from different sources and different clusters of near copies,
    with their new rank k.

    cluster names a candidate's near-duplicate group (embedding_dedup's component, say). A candidate that is not the first
    of its source, or of its cluster, gives way; that is decided by minima, not pair by pair.
    """
    w = lambda c: F.min(rank).over(Window.partitionBy(query, c))
    first = ranked.withColumn("__s", w(source)).withColumn("__c", w(cluster)).where((F.col(rank) == F.col("__s")) & (F.col(rank) == F.col("__c")))
    kept = F.row_number().over(Window.partitionBy(query).orderBy(rank))
    return first.withColumn("k", kept).where(F.col("k") <= k).drop("__s", "__c")


def reviewed(chunks: DataFrame, decisions: DataFrame) -> DataFrame:
    """chunks after decisions (chunk, decision, note): a held chunk is released or rejected; the latest decision by note wins
    a tie, and a decision on a chunk that is not held changes nothing."""
    last = decisions.groupBy("chunk").agg(F.max(F.struct("note", "decision")).alias("d"))
    new = F.when((F.col("status") == "review") & (F.col("d.decision") == "release"), "trusted").when((F.col("status") == "review") & (F.col("d.decision") == "reject"), "quarantine").otherwise(F.col("status"))
    return chunks.join(last, "chunk", "left").withColumn("status", new).withColumn("note", F.col("d.note")).drop("d")


def revalidated(chunks: DataFrame, key: bytes) -> DataFrame:
    """chunks whose signature no longer fits go to quarantine, with the reason."""
    bad = ~is_valid(key)
    return chunks.withColumn("reason", F.when(bad, "signature")).withColumn("status", F.when(bad, "quarantine").otherwise(F.col("status")))


def worst(retrieved: DataFrame, query: str, score: str, rank: str) -> DataFrame:
    """A row a query: its chunk of largest score, the first in rank at a tie."""
    return retrieved.groupBy(query).agg(F.max_by("chunk", F.struct(F.col(score), -F.col(rank))).alias("chunk"), F.max(score).alias(score))


def listed(chunks: DataFrame, operator: Column, excerpt: int = 200) -> DataFrame:
    """The store's list; only operators see whole texts."""
    return chunks.select("chunk", "source", "status", "trust", F.when(operator, F.col("text")).otherwise(F.substring("text", 1, excerpt)).alias("text"))


def rendered(chunk: Column, source: Column, text: Column, most: int = 4_000) -> Column:
    """A chunk as it is shown to a model: attributes escaped, the wrapper's own tags broken up, cut at ``most`` characters."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    body = F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, most), r"(?i)<\s*(/?)\s*(document|retrieved_context)\b[^>]*>", "[$1$2]")
    return F.concat(F.lit('<document id="'), escape(chunk.cast("string")), F.lit('" source="'), escape(source), F.lit('">\n'), body, F.lit("\n</document>"))


def context(chunks: DataFrame, query: str, rank: str) -> DataFrame:
    """(query, context): the rendered chunks of a query in order of rank, which retrieval bounds."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(rank, "rendered"))), lambda x: x["rendered"])
    return chunks.groupBy(query).agg(F.concat(F.lit("<retrieved_context>\n"), F.array_join(parts, "\n\n"), F.lit("\n</retrieved_context>")).alias("context"))


def placed(history: Column, context: Column) -> Column:
    """A conversation with its documents before the last user turn, or at the end without one; without documents as it is.

    history is array<struct<role, content>>.
    """
    doc = F.array(F.struct(F.lit("user").alias("role"), context.alias("content")))
    last = F.array_max(F.transform(history, lambda m, i: F.when(m["role"] == "user", i)))
    before = F.when(last.isNull(), history).otherwise(F.slice(history, F.lit(1), F.greatest(last, F.lit(0))))
    after = F.when(last.isNull(), F.slice(history, 1, 0)).otherwise(F.slice(history, last + 1, F.size(history)))
    return F.when(F.coalesce(context, F.lit("")) == "", history).otherwise(F.concat(before, doc, after))
