"""Hash chains over logs, folded in order inside segments of a fixed size, and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = "start"


def _digest(before: Column, entry: Column) -> Column:
    return F.sha2(F.concat(before, entry), 256)


def _folded(entries: Column) -> Column:
    """Of an array of digests in order, the array of links, each of the link before and its own digest."""
    step = lambda a, h: F.concat(a, F.array(_digest(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(START)), h)))
    return F.aggregate(entries, F.array().cast("array<string>"), step)


def chain(log: DataFrame, key: str, order: str, content: str, segment: int = 64) -> DataFrame:
    """log (key, order, content) with segment, before, link and seal.

    A link is the SHA-256 of the link before and of the entry's own digest; a segment of ``segment`` entries begins anew,
    and its seal is the digest of the seal before and its last link, so that a removed or altered entry breaks its own
    segment and all later seals. Folds run over a segment's digests and over a log's last links, never over a log whole.
    Orders must be unique in a log; a null content counts as empty.
    """
    h = F.sha2(F.coalesce(F.col(content), F.lit("")), 256)
    k = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = log.withColumn("segment", F.floor(k / segment)).withColumn("h", h)
    parts = rows.groupBy(key, "segment").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c"), "h"))).alias("xs"))  # ``segment`` entries at most
    parts = parts.withColumn("links", _folded(F.transform("xs", lambda x: x["h"])))
    lasts = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("segment", F.element_at("links", -1).alias("last")))).alias("ls"))
    seals = lasts.select(key, F.posexplode(_folded(F.transform("ls", lambda x: x["last"]))).alias("segment", "seal"))
    before = lambda i: F.coalesce(F.get("links", i - 1), F.lit(START))
    entries = F.transform("xs", lambda x, i: F.struct(x["o"].alias(order), x["c"].alias(content), before(i).alias("before"), F.get("links", i).alias("link")))
    return parts.select(key, "segment", F.explode(entries).alias("x")).select(key, "segment", "x.*").join(seals, [key, "segment"])


def verify(stored: DataFrame, content: str) -> DataFrame:
    """stored, as chain() returns it, with verified: the content still gives the link after the link before."""
    again = _digest(F.col("before"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    return stored.withColumn("verified", F.coalesce(again == F.col("link"), F.lit(False)))
