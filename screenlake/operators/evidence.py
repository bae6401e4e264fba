"""E-values, sequential tests and their running products."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import running_sums


def pvalues(scores: DataFrame, benign: DataFrame, score: str, *keys: str) -> DataFrame:
    """Conformal p-values (1 + #{b >= s}) / (n + 1), by a running count over both tables' distinct scores."""
    sums = scores.select(F.col(score).alias("__at"), F.lit(0).alias("b")).unionAll(benign.select(F.col(score), F.lit(1))).where("__at is not null").groupBy("__at").agg(F.sum("b").alias("b"))
    total = sums.agg(F.sum("b").alias("n"))
    p = running_sums(sums, "__at", {"b": "above"}, descending=True).join(F.broadcast(total)).select("__at", ((1 + F.col("above")) / (F.col("n") + 1)).alias("p"), "n")
    return scores.join(p, F.col(score) == F.col("__at")).select(*keys, score, "p", "n")


def evalue(p: Column, kappa: Column | float) -> Column:
    k = F.lit(kappa) if isinstance(kappa, float) else kappa
    return k * F.pow(p, k - 1)


def optimal_kappa(n: Column) -> Column:
    return 1 / F.log(n + 1)


def largest_evalue(n: Column, kappa: Column) -> Column:
    return kappa * F.pow(n + 1, 1 - kappa)


def wealth(df: DataFrame, session: str, order: str, e: str) -> DataFrame:
    """The running product of a session's e-values, in logarithms."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("log_wealth", F.sum(F.log(F.col(e))).over(w))


def first_crossing(df: DataFrame, session: str, order: str, log_value: str, alpha: float) -> DataFrame:
    """Per session the first place at which the value reaches 1 / alpha; null if never."""
    crossed = F.when(F.col(log_value) >= math.log(1 / alpha) - 1e-12, F.col(order))
    return df.groupBy(session).agg(F.min(crossed).alias("first"), F.max(log_value).alias("largest"))


def _log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.when(F.abs(a - b) < 800, F.log1p(F.exp(-F.abs(a - b)))).otherwise(0.0)


def _log_mixture(steps: Column, start: Column) -> Column:
    """Of steps struct<l, w> in order (log e-value, log weight of a start here): the log mixture after each, after ``start``."""
    after = lambda acc, x: x["l"] + _log_add(F.coalesce(F.try_element_at(acc, F.lit(-1)), start), x["w"])
    return F.aggregate(steps, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(after(acc, x))))


def mixture(df: DataFrame, session: str, order: str, e: str, segment: int = 256) -> DataFrame:
    """sum over starts tau of the product of e from tau to t, weighted 1 / (tau (tau + 1)).

    The sum after t is e_t times the sum before plus the weight of a start at t, so it is folded in logarithms, which neither
    overflow nor vanish: over segments of a session first (what a segment adds, and what it multiplies by), then over a
    session's segments, then inside each segment from where the one before ended. E-values must be positive.
    """
    none = F.lit(-1e300)
    tau = F.row_number().over(Window.partitionBy(session).orderBy(order))
    rows = df.withColumn("__tau", tau).withColumn("__g", F.floor((F.col("__tau") - 1) / segment))
    step = F.struct(F.col("__tau").alias("k"), F.log(F.col(e)).alias("l"), (-F.log(F.col("__tau")) - F.log(F.col("__tau") + 1)).alias("w"))
    parts = rows.groupBy(session, "__g").agg(F.array_sort(F.collect_list(step)).alias("xs"))  # ``segment`` steps at most
    ends = parts.select(session, "__g", F.element_at(_log_mixture(F.col("xs"), none), -1).alias("b"), F.aggregate("xs", F.lit(0.0), lambda s, x: s + x["l"]).alias("a"))
    chain = ends.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("__g", "b", "a"))).alias("gs"))
    carry = lambda acc, g: _log_add(g["b"], F.element_at(acc, -1) + g["a"])
    starts = chain.select(session, F.posexplode(F.aggregate("gs", F.array(none), lambda acc, g: F.concat(acc, F.array(carry(acc, g))))).alias("__g", "__start"))
    inside = parts.join(starts, [session, "__g"]).select(session, F.explode(F.arrays_zip(F.transform("xs", lambda x: x["k"]).alias("k"), _log_mixture(F.col("xs"), F.col("__start")).alias("m"))).alias("z"))
    inside = inside.select(session, F.col("z").getField("k").alias("__tau"), F.exp(F.col("z").getField("m")).alias("mixture"))
    return rows.join(inside, [session, "__tau"]).drop("__tau", "__g")


def sprt(df: DataFrame, session: str, order: str, llr: str, alpha: float, beta: float) -> DataFrame:
    """Per session (verdict, consulted, total): the first crossing of Wald's bounds, else the sign of the sum."""
    upper, lower = math.log((1 - beta) / alpha), math.log(beta / (1 - alpha))
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = df.withColumn("__sum", F.sum(llr).over(w)).withColumn("__k", F.row_number().over(Window.partitionBy(session).orderBy(order)))
    stop = F.when((F.col("__sum") >= upper) | (F.col("__sum") <= lower), F.struct(F.col("__k").alias("k"), F.col("__sum").alias("s")))
    out = s.groupBy(session).agg(F.min(stop).alias("stop"), F.max(F.struct(F.col("__k").alias("k"), F.col("__sum").alias("s"))).alias("end"))
    at = F.coalesce("stop", "end")
    return out.select(session, F.when(at["s"] > 0, "malicious").otherwise("benign").alias("verdict"), at["k"].alias("consulted"), at["s"].alias("total"), F.col("stop").isNotNull().alias("crossed"))
