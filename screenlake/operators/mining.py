"""Frequent and discriminative sequential patterns of sessions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A task counts this many items of whole sessions at once.
ITEMS = 1_000_000


def symbol(layer: str, score: str):
    s = F.col(score)
    return F.concat(F.col(layer), F.lit(":"), F.when(s < 0.35, "LOW").when(s < 0.7, "MEDIUM").otherwise("HIGH"))


def sequences(events: DataFrame, session: str, order: str, item: str, *carry: str) -> DataFrame:
    """(session, items): a session's symbols in order."""
    x = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(item).alias("__item"))))
    return events.groupBy(session, *carry).agg(F.transform(x, lambda e: e["__item"]).alias("items"))


def frequent_patterns(seqs: DataFrame, session: str, items: str, min_support: float, max_length: int = 3) -> DataFrame:
    """(pattern, support, length) of ordered patterns, gaps allowed, that ceil(min_support * n) sessions hold.

    Level by level: a task walks the tree of the frequent patterns so far, each with the places after its earliest match in
    the task's sessions, and counts the symbols that follow. Only symbols that are frequent themselves are tried; the
    frequent patterns of a level but the last, at most (number of symbols) ** length, are sent to the tasks as numbers
    with the symbols as digits.
    """
    spark = seqs.sparkSession
    least = max(1, math.ceil(min_support * seqs.count()))
    held = seqs.select(F.explode(F.array_distinct(items)).alias("pattern")).where("pattern is not null")
    out = held.groupBy("pattern").agg(F.count("*").alias("support")).where(F.col("support") >= least).withColumn("length", F.lit(1))
    symbols = sorted(r.pattern for r in out.select("pattern").collect())
    levels = [np.array([0]), np.arange(len(symbols))]
    for k in range(2, max_length + 1):
        if not len(levels[-1]):
            break
        counted = _extensions(seqs.select(items), symbols, levels).groupBy("code").agg(F.sum("n").alias("support")).where(F.col("support") >= least)
        if k < max_length:
            rows = counted.toArrow()
            counted = spark.createDataFrame(rows) if rows.num_rows else spark.createDataFrame([], "code long, support long")
            levels.append(np.sort(rows.column("code").to_numpy()))
        names = F.array(*map(F.lit, symbols))
        digit = lambda at: F.get(names, F.expr(f"cast(code div {len(symbols) ** at} % {len(symbols)} as int)"))
        out = out.unionAll(counted.select(F.concat_ws(" > ", *[digit(at) for at in range(k - 1, -1, -1)]).alias("pattern"), "support", F.lit(k).alias("length")))
    return out


def _extensions(seqs: DataFrame, symbols: list[str], levels: list[np.ndarray]) -> DataFrame:
    """(code, n): sessions of a task that hold a pattern of the last level followed by a symbol."""
    sent = seqs.sparkSession.sparkContext.broadcast((symbols, levels))

    def run(batches):
        symbols, levels = sent.value
        known = [set(x.tolist()) for x in levels[:-1]] + [{int(c): i for i, c in enumerate(levels[-1])}]
        counts = np.zeros((len(levels[-1]), len(symbols)), np.int64)
        items, sizes, held = [], [], 0
        for batch in batches:
            column = batch.column(0).fill_null([]) if batch.column(0).null_count else batch.column(0)
            items.append(pc.fill_null(pc.index_in(column.flatten(), pa.array(symbols, column.type.value_type)), -1).to_numpy(zero_copy_only=False))
            sizes.append(pc.list_value_length(column).to_numpy(zero_copy_only=False))
            held += len(items[-1])
            if held >= ITEMS:
                _count(np.concatenate(items), np.concatenate(sizes), known, counts)
                items, sizes, held = [], [], 0
        if sizes:
            _count(np.concatenate(items), np.concatenate(sizes), known, counts)
        codes = levels[-1][:, None] * len(symbols) + np.arange(len(symbols))
        for at in range(0, len(counts), 5_000):
            some = counts[at : at + 5_000] > 0
            yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + 5_000][some]), pa.array(counts[at : at + 5_000][some])], names=["code", "n"])

    # a task sends a row for each pattern it holds, so there are no more tasks than cores
    return seqs.coalesce(seqs.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "code long, n long")


def _count(items: np.ndarray, sizes: np.ndarray, known: list, counts: np.ndarray) -> None:
    """Adds the sessions that hold each pattern of the last level and then each symbol; -1 is no symbol."""
    width, ends = counts.shape[1], np.cumsum(sizes + 1) - 1
    placed = np.full(len(items) + len(sizes), -1, np.int64)
    inner = np.ones(len(placed), bool)
    inner[ends] = False
    placed[inner] = items
    last = np.repeat(ends, sizes + 1)
    # a session has a place for each item and one after them; after[p, s] is the place after the next s, 0 if there is none
    after = np.zeros((len(placed), width), np.int32)
    for s in range(width):
        place = np.where(placed == s, np.arange(1, len(placed) + 1), len(placed) + 1)
        next_one = np.minimum.accumulate(place[::-1])[::-1]
        after[:, s] = np.where(next_one <= last, next_one, 0)

    def grow(code: int, depth: int, places: np.ndarray) -> None:
        found = after[places]
        if depth == len(known) - 1:
            counts[known[depth][code]] += np.count_nonzero(found, axis=0)
            return
        for s in range(width):
            if code * width + s in known[depth + 1]:
                there = found[:, s]
                there = there[there > 0]
                if len(there):
                    grow(code * width + s, depth + 1, there)

    grow(0, 0, (ends - sizes).astype(np.int32))


def discriminative(positive: DataFrame, negative: DataFrame, n_positive: int, n_negative: int, least: float = 0.8) -> DataFrame:
    """Patterns whose share of support among positive and negative sessions together is at least ``least``."""
    both = positive.select("pattern", F.col("support").alias("sp")).join(negative.select("pattern", F.col("support").alias("sn")), "pattern", "left")
    a, b = F.col("sp") / n_positive, F.coalesce(F.col("sn"), F.lit(0)) / n_negative
    return both.select("pattern", a.alias("support_positive"), b.alias("support_negative"), (a / (a + b)).alias("confidence")).where(F.col("confidence") >= least)


def is_subsequence(pattern: Column, sequence: Column) -> Column:
    """Whether a pattern's items occur in the sequence in order, with anything between; a fold over the sequence."""
    return F.aggregate(sequence, F.lit(0), lambda at, x: at + F.coalesce(F.get(pattern, at) == x, F.lit(False)).cast("int")) == F.size(pattern)


def contrasted(positive: DataFrame, negative: DataFrame, items: str, patterns: DataFrame, least: float = 0.8) -> DataFrame:
    """(pattern, positive, negative, ratio) of patterns whose share among positives makes up ``least`` of both shares.

    patterns holds few rows (an array in column pattern) and is sent to the sequences; each sequence meets each once.
    """
    def share(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.count("*").alias("n"))
        hits = df.crossJoin(F.broadcast(patterns)).where(is_subsequence(F.col("pattern"), F.col(items))).groupBy("pattern").agg(F.count("*").alias("c"))  # a bounded list
        return hits.crossJoin(F.broadcast(total)).select("pattern", (F.col("c") / F.col("n")).alias(name))

    both = patterns.join(share(positive, "positive"), "pattern", "left").join(share(negative, "negative"), "pattern", "left").fillna(0.0, ["positive", "negative"])
    ratio = F.when(F.col("positive") + F.col("negative") > 0, F.col("positive") / (F.col("positive") + F.col("negative"))).otherwise(0.0)
    return both.withColumn("ratio", ratio).where(F.col("ratio") >= least)


def flags(sequence: Column, patterns: list[list[str]]) -> Column:
    """Whether any of a few patterns occurs in a sequence."""
    out = F.lit(False)
    for p in patterns:
        out = out | is_subsequence(F.array(*map(F.lit, p)), sequence)
    return out
