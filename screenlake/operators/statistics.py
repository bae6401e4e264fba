"""Calibration and evaluation statistics as aggregates and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups under this many rows are ranked whole; larger ones only within a band around the wanted rank.
WHOLE_GROUP = 5_000


def order_statistic(df: DataFrame, group: str, value: str, rank: Column, q: float) -> DataFrame:
    """(group, n, value): the value of ascending rank ``rank`` (an expression of n, near q * n); +inf beyond n.

    Large groups are narrowed by approximate quantiles to a few thousandths of their rows before the exact ranking.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    band = rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", [max(0.0, q - 0.002), min(1.0, q + 0.002)], 10_000).alias("b"))
    band = band.select("g", "n", F.when(F.col("n") < WHOLE_GROUP, F.lit(float("-inf"))).otherwise(F.col("b")[0]).alias("lo"), F.when(F.col("n") < WHOLE_GROUP, F.lit(float("inf"))).otherwise(F.col("b")[1]).alias("hi"))
    marked = rows.join(band, "g")
    below = marked.groupBy("g", "n").agg(F.sum((F.col("v") < F.col("lo")).cast("long")).alias("below"))
    inside = marked.where("v >= lo and v <= hi").groupBy("g", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("upto", upto).join(below, "g").withColumn("k", rank)
    found = found.where(F.col("below") + F.col("upto") >= F.col("k")).groupBy("g").agg(F.min("v").alias("value"))
    return below.join(found, "g", "left").select(F.col("g").alias(group), "n", F.coalesce("value", F.lit(float("inf"))).alias("value"))


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, names): linearly interpolated percentiles, from the two order statistics around each; no buffer of values."""
    out = None
    for name, q in shares.items():
        at = (F.col("n") - 1) * q
        low = order_statistic(df, group, value, F.floor(at + 1e-9) + 1, q).withColumnRenamed("value", "__low")
        high = order_statistic(df, group, value, F.least(F.floor(at + 1e-9) + 2, F.col("n")), q).select(group, F.col("value").alias("__high"))
        part = at - F.floor(at + 1e-9)
        both = low.join(high, group).select(group, (F.col("__low") + F.greatest(F.lit(0.0), part) * (F.col("__high") - F.col("__low"))).alias(name))
        out = both if out is None else out.join(both, group)
    return out


def conformal_thresholds(df: DataFrame, group: str, score: str, alpha: float) -> DataFrame:
    """Per group the split-conformal threshold: the ceil((n + 1)(1 - alpha))-th smallest score of n and +inf."""
    k = F.ceil((F.col("n") + 1) * F.lit(1 - alpha) - F.lit(1e-9))
    return order_statistic(df, group, score, k, 1 - alpha).withColumnRenamed("value", "tau")


def classification(df: DataFrame, label: str, score: str, threshold: float, *groups: str) -> DataFrame:
    """Counts, precision, recall, F1, accuracy; positive is score >= threshold; 0 where a denominator is 0."""
    p, y = F.col(score) >= threshold, F.col(label) == 1
    n = lambda c: F.sum(c.cast("long"))
    out = df.groupBy(*groups).agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & ~y).alias("tn"), n(~p & y).alias("fn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1).withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")))


def by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg, pos_upto, neg_upto) of distinct scores ascending; what every rank statistic needs.

    Rows are summed by score before they meet in order, so the last step sees distinct scores only.
    """
    sums = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    return running_sums(sums, "score", {"pos": "pos_upto", "neg": "neg_upto"})


def running_sums(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, slices: int = 64) -> DataFrame:
    """df with running sums of columns over all rows in order (ties together), without one task that sees all rows.

    Rows are cut into slices of value by approximate quantiles; sums run inside a slice, and each slice adds the totals of
    those before it, a row a slice. Nulls in order come first (last if descending).
    """
    sign = -1 if descending else 1
    key = F.col(order) * sign
    bounds = df.agg(F.percentile_approx(key, [k / slices for k in range(1, slices)], 10_000).alias("__bounds"))
    cut = F.coalesce(F.size(F.filter("__bounds", lambda b: b < key)), F.lit(-1))
    rows = df.crossJoin(F.broadcast(bounds)).withColumn("__slice", cut).drop("__bounds")  # one row of slices - 1 values
    totals = rows.groupBy("__slice").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    earlier = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__slice", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy("__slice").orderBy(key)
    out = rows.join(F.broadcast(totals), "__slice")
    for c, name in sums.items():
        out = out.withColumn(name, F.col(f"__{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("__slice", *[f"__{c}" for c in sums])


def smallest_of_each(df: DataFrame, group: str, value: str, tie: str, least: DataFrame) -> DataFrame:
    """Of each group the rows of smallest (value, tie), as many as the one row of ``least`` says; value is a hex digest.

    A first cut keeps values under a bound that holds a little more than the wanted share of evenly spread digests; where
    it holds too few, the group stays whole. Only what the cut keeps is ranked.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("__n")).join(F.broadcast(least))  # a row a group, and one row
    part = F.conv(F.substring(value, 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = F.least(F.lit(1.0), (F.col("least") + 6 * F.sqrt("least") + 50) / F.col("__n"))
    marked = df.join(F.broadcast(counts.select(group, "least", share.alias("__share"))), group).withColumn("__in", part < F.col("__share"))
    held = marked.groupBy(group).agg((F.sum(F.col("__in").cast("long")) >= F.max("least")).alias("__enough"))
    kept = marked.join(F.broadcast(held), group).where(F.col("__in") | ~F.col("__enough"))
    # ranked within slices of the digest first, so that one class is not one task
    sizes = kept.groupBy(group, F.floor(part * 256).alias("__slice")).agg(F.count("*").alias("__m"))
    before = F.coalesce(F.sum("__m").over(Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = kept.withColumn("__slice", F.floor(part * 256)).join(F.broadcast(sizes.select(group, "__slice", before.alias("__before"))), [group, "__slice"])
    rank = F.row_number().over(Window.partitionBy(group, "__slice").orderBy(value, tie)) + F.col("__before")
    return first.withColumn("__rank", rank).where(F.col("__rank") <= F.col("least")).select(*[F.col(f"`{c}`") for c in df.columns])


def auroc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: auroc; ties count a half, .5 if a class is empty."""
    s = by_score(df, label, score)
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg")) + 0.5 * F.col("pos") * F.col("neg"))
    pairs = F.sum("pos") * F.sum("neg")
    return s.agg(F.when(pairs > 0, wins / pairs).otherwise(0.5).alias("auroc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) of every distinct score as threshold, score >= threshold being positive."""
    s = by_score(df, label, score)
    total = s.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    s = s.join(F.broadcast(total))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return s.select(F.col("score").alias("threshold"), ratio(F.col("p") - F.col("pos_upto") + F.col("pos"), F.col("p")).alias("tpr"), ratio(F.col("n") - F.col("neg_upto") + F.col("neg"), F.col("n")).alias("fpr"))


def ks_statistic(df: DataFrame, label: str, score: str) -> DataFrame:
    s = by_score(df, label, score)
    total = s.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.join(F.broadcast(total)).agg(F.max(F.abs(F.col("pos_upto") / F.col("p") - F.col("neg_upto") / F.col("n"))).alias("ks"))


def calibration_bins(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy): accuracy of score >= .5 against the label; the last bin holds score 1."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    right = ((F.col(score) >= 0.5) == (F.col(label) == 1)).cast("double")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(right).alias("accuracy"))


def calibration_error(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    b = calibration_bins(df, label, score, bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, d = successes / n, 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """Of two boolean columns: rows only one gets right, and the continuity-corrected chi-squared (0 without such rows)."""
    n10, n01 = F.sum((F.col(a) & ~F.col(b)).cast("long")), F.sum((~F.col(a) & F.col(b)).cast("long"))
    out = df.agg(n10.alias("only_a"), n01.alias("only_b"))
    total = F.col("only_a") + F.col("only_b")
    return out.withColumn("chi2", F.when(total == 0, 0.0).otherwise(F.pow(F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)), 2) / total))


def weighted_quantile(df: DataFrame, group: str, value: str, weight: str, q: float) -> DataFrame:
    """The smallest value whose cumulative share of weight reaches q, per group."""
    rows = df.groupBy(group, value).agg(F.sum(weight).alias("w"))
    upto = F.sum("w").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("w").over(Window.partitionBy(group))
    return rows.withColumn("share", upto / total).where(F.col("share") >= q - 1e-12).groupBy(group).agg(F.min(value).alias("quantile"))


def weighted_quantile_of_all(df: DataFrame, value: str, weight: str, q: float) -> DataFrame:
    """One row, quantile: as weighted_quantile over all rows, by running sums in slices of value."""
    rows = df.groupBy(F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    s = running_sums(rows, "v", {"w": "upto"})
    total = s.agg(F.sum("w").alias("total"))
    return s.crossJoin(F.broadcast(total)).where(F.col("upto") / F.col("total") >= q - 1e-12).agg(F.min("v").alias("quantile"))  # one row


def density_ratio(calibration: DataFrame, deployment: DataFrame, score: str, bins: int = 20, clip: float = 50.0) -> DataFrame:
    """(bin, weight): the smoothed ratio of the two tables' histograms of a score in [0, 1], clipped."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    both = calibration.select(b.alias("bin"), F.lit(1).alias("c"), F.lit(0).alias("d")).unionAll(deployment.select(b.alias("bin"), F.lit(0), F.lit(1)))
    sums = both.groupBy("bin").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    total = sums.agg(F.sum("c").alias("tc"), F.sum("d").alias("td"))
    ratio = ((F.col("d") + 1) / (F.col("td") + bins)) / ((F.col("c") + 1) / (F.col("tc") + bins))
    return sums.join(F.broadcast(total)).select("bin", F.least(ratio, F.lit(clip)).alias("weight"))


def bootstrap_mean(df: DataFrame, key: str, value: str, rounds: int = 200, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of a mean by a Poisson bootstrap: each row's weight in a round comes from a hash of its key, so
    no row is drawn, moved or collected, and a rerun gives the same interval."""
    u = F.pmod(F.xxhash64(F.col(key), F.col("round")), F.lit(1 << 30)) / float(1 << 30)
    weight, tail = F.lit(0), 0.0
    for k in range(8):  # inverse of the Poisson(1) distribution function
        tail += math.exp(-1) / math.factorial(k)
        weight = weight + (u >= tail).cast("int")
    rows = df.select(key, value).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    means = rows.withColumn("w", weight).groupBy("round").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("mean"))
    a = (1 - confidence) / 2
    return means.agg(F.percentile("mean", a).alias("low"), F.percentile("mean", 1 - a).alias("high"))
