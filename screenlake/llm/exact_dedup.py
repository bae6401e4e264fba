"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A text's digest is the SHA-256 of its normalised form. A frequent-items sketch (Misra-Gries family, mergeable, of fixed
size) over all digests finds every digest held by more than about n / sketch_items rows. Those candidates, at most
``max_hot``, are verified by an exact count and minimum; the verified winners (a table of a fixed number of rows) are
broadcast, so that rows of hot groups are resolved on the map side and never shuffled. All other rows are grouped by an
ordinary shuffle on the digest, where no group can be larger than the sketch's error bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: ASCII white space; each run of it counts as one space.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def text_digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest): the lowercase hex SHA-256 of each whole text after white-space folding; null counts as empty."""
    folded = F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), SPACE_RUN, " ")
    return df.select(F.col(f"`{id_col}`").alias("id"), F.sha2(F.encode(folded, "UTF-8"), 256).alias("digest"))


def hot_digests(digests: DataFrame, max_hot: int = 512, sketch_items: int = 4096, least: int = 32) -> DataFrame:
    """(digest, keep, n) of verified frequent digests: at most max_hot rows, whatever the size of the input."""
    items = digests.agg(F.expr(f"approx_top_k(digest, {max_hot}, {sketch_items})").alias("t"))
    named = items.select(F.explode("t").alias("x")).select(F.col("x.item").alias("digest"), F.col("x.count").alias("guess"))
    named = named.where(F.col("guess") >= least).select("digest")
    return digests.join(F.broadcast(named), "digest").groupBy("digest").agg(F.min("id").alias("keep"), F.count("*").alias("n"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_hot: int = 512) -> DataFrame:
    """One row per input row: id, keep_id (smallest id with an equal text), group_size, kept, text_sha256.

    Null and empty texts are equal to each other. Rows that repeat an id and text whole count as two rows; of those, all
    with the smallest id are kept, since nothing tells them apart. Rows with a null id belong to their group, and are kept
    only if the whole group has no id. An empty table gives an empty result. Other columns are never read.
    """
    digests = stage(text_digests(df, id_col, text_col), "digests")
    hot = stage(hot_digests(digests, max_hot), "hot")
    small = F.broadcast(hot)  # at most max_hot rows
    removed = digests.join(small, "digest").select("id", "digest", "keep", "n")
    rest = digests.join(small.select("digest"), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min("id").alias("keep"), F.count("*").alias("n"))
    ordinary = rest.join(groups, "digest").select("id", "digest", "keep", "n")
    return removed.unionAll(ordinary).select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
