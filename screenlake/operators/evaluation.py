"""Evaluation beyond one pass: intervals, exact tests, curves, shift, fused e-values, ablations, decompositions, rounds.

Every function is a plan of aggregates, windows over aggregated rows and joins. Special functions that no engine function
offers (the incomplete beta and the normal tail) are worked out in Arrow functions over aggregated rows, a few at a time.
"""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import by_score, running_sums


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for k in range(400):
        m = k // 2
        term = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (d_ if abs(d_ := 1 + term * d) > tiny else tiny)
        c = c_ if abs(c_ := 1 + term / c) > tiny else tiny
        out *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (out - 1)


def _beta_point(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _beta_tail(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def _exact_low(k: pd.Series, n: pd.Series, confidence: pd.Series) -> pd.Series:
    return pd.Series([None if y == 0 else 0.0 if x == 0 else _beta_point((1 - c) / 2, x, y - x + 1) for x, y, c in zip(k, n, confidence)], dtype="float64")


def _exact_high(k: pd.Series, n: pd.Series, confidence: pd.Series) -> pd.Series:
    return pd.Series([None if y == 0 else 1.0 if x == y else _beta_point(1 - (1 - c) / 2, x + 1, y - x) for x, y, c in zip(k, n, confidence)], dtype="float64")


def clopper_pearson(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Exact interval of a share k of n; null of none."""
    return F.pandas_udf(_exact_low, "double")(k, n, F.lit(confidence)), F.pandas_udf(_exact_high, "double")(k, n, F.lit(confidence))


def stable(agreements: Column, n: Column, confidence: float = 0.95) -> Column:
    """Whether the lower bound of a one-sided interval of that confidence lies over a half."""
    return clopper_pearson(agreements, n, 2 * confidence - 1)[0] > 0.5


def _normal_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))


def two_sided(z: Column) -> Column:
    """Two-sided p-value of a standard normal; of a chi-squared with one degree, give its root."""
    return F.pandas_udf(_normal_tail, "double")(z)


def _binomial(b: pd.Series, c: pd.Series) -> pd.Series:
    def p(x: int, n: int) -> float:
        if n == 0:
            return 1.0
        terms = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(x + 1))
        return min(1.0, 2 * math.fsum(map(math.exp, terms)))

    return pd.Series([p(min(int(x), int(y)), int(x + y)) for x, y in zip(b, c)], dtype="float64")


def exact_mcnemar(only_a: Column, only_b: Column) -> Column:
    """Two-sided p-value that rows which only one gets right fall to either side alike."""
    return F.pandas_udf(_binomial, "double")(only_a, only_b)


def precision_recall(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall) for each distinct score as threshold."""
    s = by_score(df, label, score)
    total = s.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    s = s.crossJoin(F.broadcast(total))  # one row
    tp, fp = F.col("p") - F.col("pos_upto") + F.col("pos"), F.col("n") - F.col("neg_upto") + F.col("neg")
    return s.select(F.col("score").alias("threshold"), (tp / (tp + fp)).alias("precision"), F.when(F.col("p") > 0, tp / F.col("p")).otherwise(0.0).alias("recall"), (F.col("pos") / F.greatest(F.col("p"), F.lit(1))).alias("step"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the precision at each threshold, weighted by the recall that it adds."""
    return precision_recall(df, label, score).agg(F.sum(F.col("precision") * F.col("step")).alias("average_precision"))


def tpr_at_fpr(df: DataFrame, label: str, score: str, most: float = 0.05) -> DataFrame:
    """One row: the largest share of positives found at a share of negatives of ``most`` at most; 0 if none."""
    s = by_score(df, label, score)
    total = s.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    s = s.crossJoin(F.broadcast(total))
    fpr = (F.col("n") - F.col("neg_upto") + F.col("neg")) / F.greatest(F.col("n"), F.lit(1))
    tpr = (F.col("p") - F.col("pos_upto") + F.col("pos")) / F.greatest(F.col("p"), F.lit(1))
    return s.agg(F.coalesce(F.max(F.when(fpr <= most, tpr)), F.lit(0.0)).alias("tpr"))


def mann_whitney(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: u of the positives, and z with the ties' correction."""
    s = by_score(df, label, score)
    t = F.col("pos") + F.col("neg")
    u = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg")) + 0.5 * F.col("pos") * F.col("neg"))
    out = s.agg(u.alias("u"), F.sum("pos").cast("double").alias("a"), F.sum("neg").cast("double").alias("b"), F.sum((t * t * t - t).cast("double")).alias("ties"))
    n = F.col("a") + F.col("b")
    spread = F.sqrt(F.col("a") * F.col("b") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return out.select("u", F.when(spread > 0, (F.col("u") - F.col("a") * F.col("b") / 2) / spread).otherwise(0.0).alias("z"))


def pipeline_metrics(df: DataFrame, label: str, decision: str, warn_counts: bool = True) -> DataFrame:
    """One row: detection and false alarms of decisions, and how often each was taken."""
    caught = F.col(decision).isin("BLOCK", "WARN") if warn_counts else F.col(decision) == "BLOCK"
    y, n = F.col(label) == 1, lambda c: F.sum(c.cast("long"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return df.agg(share(n(caught & y), n(y)).alias("detection"), share(n(caught & ~y), n(~y)).alias("false_alarms"), *[n(F.col(decision) == d).alias(d.lower()) for d in ("ALLOW", "WARN", "BLOCK")])


def shift_diagnostics(calibration: DataFrame, deployment: DataFrame, score: str) -> DataFrame:
    """One row: KS distance and AUROC of deployment over calibration, share of deployment over calibration's 95th percentile."""
    both = calibration.select(F.col(score).alias("s"), F.lit(0).alias("y")).unionAll(deployment.select(F.col(score), F.lit(1)))
    s = by_score(both, "y", "s")
    total = s.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    s = s.crossJoin(F.broadcast(total)).withColumn("above", F.when(F.col("neg_upto") >= F.ceil(0.95 * F.col("n")), F.col("pos")).otherwise(0))
    at_cut = F.when((F.col("neg_upto") >= F.ceil(0.95 * F.col("n"))) & (F.col("neg_upto") - F.col("neg") < F.ceil(0.95 * F.col("n"))), F.col("pos")).otherwise(0)
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg")) + 0.5 * F.col("pos") * F.col("neg"))
    return s.agg(
        F.max(F.abs(F.col("pos_upto") / F.col("p") - F.col("neg_upto") / F.col("n"))).alias("ks"),
        (wins / (F.max("p") * F.max("n"))).alias("auroc"),
        ((F.sum("above") - F.sum(at_cut)) / F.max("p")).alias("above_p95"),
    )


# e-values of several layers


def leave_one_out(df: DataFrame, layer: str, score: str, label: str) -> DataFrame:
    """df with p and n: conformal p-values against the benign rows of the layer; a benign row doesn't count itself."""
    sums = df.groupBy(F.col(layer).alias("__l"), F.col(score).alias("__s")).agg(F.sum(1 - F.col(label)).alias("__b"))
    down = Window.partitionBy("__l").orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)  # distinct scores of a layer
    sums = sums.withColumn("__above", F.sum("__b").over(down)).withColumn("__n", F.sum("__b").over(Window.partitionBy("__l")))
    own = 1 - F.col(label)
    out = df.join(sums, (F.col(layer) == F.col("__l")) & (F.col(score) == F.col("__s")))
    return out.withColumn("p", (1 + F.col("__above") - own) / (F.col("__n") - own + 1)).withColumn("n", F.col("__n") - own).drop("__l", "__s", "__b", "__above", "__n")


def merged(df: DataFrame, session: str, e: str, label: str) -> DataFrame:
    """A row a session: the mean and the product of its e-values."""
    return df.groupBy(session, label).agg(F.avg(e).alias("mean_e"), F.exp(F.sum(F.log(e))).alias("product_e"), F.min("p").alias("least_p"), F.count("*").alias("k"))


def least_benign(alpha: float, kappa: Column | float) -> Column:
    """The fewest benign rows from which an e-value can reach 1 / alpha."""
    k = F.lit(kappa) if isinstance(kappa, float) else kappa
    return F.ceil(F.pow(1 / (alpha * k), 1 / (1 - k)) - 1 - 1e-9).cast("long")


def reachable_alpha(n: Column, kappa: Column) -> Column:
    return 1 / (kappa * F.pow(n + 1, 1 - kappa))


def pairwise_correlation(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, correlation) of each two columns, in one pass."""
    pairs = list(itertools.combinations(columns, 2))
    row = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("correlation")) for a, b in pairs])).alias("x")).select("x.*")


def density_log_ratio(df: DataFrame, training: DataFrame, score: str, label: str, width: float = 0.08, bins: int = 1_000) -> DataFrame:
    """df with llr: the log ratio of two Gaussian kernel densities of training scores in [0, 1].

    Training scores are summed in ``bins`` bins first, so a row meets at most two arrays of bins, sent to every task.
    """
    b = F.round(F.col(score) * bins).cast("int")
    sums = training.groupBy(b.alias("bin")).agg(F.sum(F.col(label)).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    known = sums.agg(F.array_sort(F.collect_list(F.struct("bin", "pos", "neg"))).alias("bins"))  # bins + 1 entries at most
    near = lambda side: F.aggregate("bins", F.lit(0.0), lambda a, x: a + x[side] * F.exp(-0.5 * F.pow((F.col(score) - x["bin"] / bins) / width, 2)))
    mass = lambda side: F.aggregate("bins", F.lit(0.0), lambda a, x: a + x[side])
    rows = df.crossJoin(F.broadcast(known))  # one row
    density = lambda side: near(side) / F.greatest(mass(side), F.lit(1.0)) + 1e-12
    return rows.withColumn("llr", F.log(density("pos")) - F.log(density("neg"))).drop("bins")


# layers against each other


def zero_false_hits(wide: DataFrame, layers: list[str], label: str) -> DataFrame:
    """Malicious rows with a bit for each layer whose score lies over all benign rows' scores of that layer."""
    tops = wide.where(F.col(label) == 0).agg(*[F.max(k).alias(f"__{k}") for k in layers])
    hit = [F.when(F.col(k) > F.coalesce(F.col(f"__{k}"), F.lit(float("-inf"))), 1 << i).otherwise(0) for i, k in enumerate(layers)]
    return wide.where(F.col(label) == 1).crossJoin(F.broadcast(tops)).withColumn("hits", sum(hit[1:], hit[0])).drop(*[f"__{k}" for k in layers])  # one row


def decomposition(hits: DataFrame, layers: list[str]) -> DataFrame:
    """(layers, found) of every set of layers: rows that any of them hits; one aggregate over bit masks."""
    masks = [m for m in range(1, 1 << len(layers))]
    name = lambda m: "+".join(k for i, k in enumerate(layers) if m >> i & 1)
    row = hits.agg(*[F.sum((F.col("hits").bitwiseAND(m) != 0).cast("long")).alias(str(m)) for m in masks])
    return row.select(F.explode(F.array(*[F.struct(F.lit(name(m)).alias("layers"), F.coalesce(F.col(str(m)), F.lit(0)).alias("found")) for m in masks])).alias("x")).select("x.*")


def ablation(wide: DataFrame, layers: list[str], label: str, group: str, block: float = 0.85, warn: float = 0.5) -> DataFrame:
    """(condition, group, n, caught, blocked): decisions of the maximum with all layers and without each of them.

    Scores are not made anew; rows are repeated once a condition, and rolled up over groups.
    """
    conditions = F.array(F.struct(F.lit("all").alias("condition"), F.greatest(F.lit(0.0), *layers).alias("top")), *[F.struct(F.lit(f"no {k}").alias("condition"), F.greatest(F.lit(0.0), *[x for x in layers if x != k]).alias("top")) for k in layers])
    rows = wide.select(label, group, F.explode(conditions).alias("c")).select(label, group, "c.*")
    return rows.rollup("condition", group).agg(F.count("*").alias("n"), F.sum((F.col("top") >= warn).cast("long")).alias("caught"), F.sum((F.col("top") >= block).cast("long")).alias("blocked")).where("condition is not null")


def unique_detections(wide: DataFrame, layers: list[str], key: str, label: str, warn: float = 0.5) -> DataFrame:
    """(layer, n): malicious rows that this layer alone brings to a warning."""
    over = F.filter(F.array(*[F.when(F.col(k) >= warn, F.lit(k)) for k in layers]), lambda x: x.isNotNull())
    return wide.where(F.col(label) == 1).withColumn("__over", over).where(F.size("__over") == 1).groupBy(F.get("__over", F.lit(0)).alias("layer")).agg(F.countDistinct(key).alias("n"))


def novelty(df: DataFrame, fused: str, top: str, warn: float = 0.5) -> DataFrame:
    """(part, n): what fusion and the largest layer each find: A both, B fusion alone, C the layer alone, D neither."""
    f, t = F.col(fused) >= warn, F.col(top) >= warn
    return df.groupBy(F.when(f & t, "A").when(f, "B").when(t, "C").otherwise("D").alias("part")).agg(F.count("*").alias("n"))


def certificate(scores: dict[str, Column], k: Column | int, eligible: tuple[str, ...], threshold: float = 0.5, epsilon: float = 0.05, carry: float = 0.15) -> Column:
    """struct<below, carrying, satisfied>: every layer at threshold - epsilon or below, and k eligible ones at carry or more."""
    zero = {n: F.coalesce(c, F.lit(0.0)) for n, c in scores.items()}
    below = F.greatest(*zero.values()) <= threshold - epsilon
    carrying = sum(((zero[n] >= carry).cast("int") for n in eligible), F.lit(0))
    return F.struct(below.alias("below"), carrying.alias("carrying"), (below & (carrying >= k)).alias("satisfied"))


def capacity_sweep(rooms: DataFrame, room: str, order: str, steps: int = 41, most: float = 1.5) -> DataFrame:
    """(budget, hidden, forced): budgets from 0 to ``most`` of all room poured into the layers in order, each to its brim."""
    spread = rooms.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(room).alias("r")))).alias("xs"))  # a row a layer
    total = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x["r"])
    b = spread.select("xs", total.alias("total"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i")).withColumn("budget", F.col("total") * most * F.col("i") / (steps - 1))
    hidden = F.least("budget", "total")
    return b.select(F.round("budget", 9).alias("budget"), hidden.alias("hidden"), (F.col("budget") - hidden).alias("forced"))


def rounds_until(df: DataFrame, key: str, round_: str, stopped: Column, last: int) -> DataFrame:
    """(round, stopped, share): of rows tried round after round, how many had stopped by each round up to ``last``."""
    first = df.groupBy(key).agg(F.min(F.when(stopped, F.col(round_))).alias("at"))
    counts = first.groupBy("at").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    grid = df.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias("round"))
    out = grid.crossJoin(F.broadcast(counts.where("at is not null"))).where("at <= round").groupBy("round").agg(F.sum("c").alias("stopped"))  # a row a round each
    return grid.join(out, "round", "left").crossJoin(F.broadcast(total)).select("round", F.coalesce("stopped", F.lit(0)).alias("stopped"), (F.coalesce("stopped", F.lit(0)) / F.col("n")).alias("share"))


def conformal_with_weights(calibration: DataFrame, score: str, weight: str, alpha: float) -> DataFrame:
    """One row, tau: the weighted (1 - alpha) quantile with the mean weight at infinity added."""
    sums = calibration.groupBy(F.col(score).alias("v")).agg(F.sum(weight).alias("w"), F.count("*").alias("c"))
    s = running_sums(sums, "v", {"w": "upto"})
    total = s.agg(F.sum("w").alias("total"), F.sum("c").alias("n"))
    s = s.crossJoin(F.broadcast(total)).where(F.col("upto") / (F.col("total") * (1 + 1 / F.col("n"))) >= 1 - alpha - 1e-12)
    return s.agg(F.coalesce(F.min("v"), F.lit(float("inf"))).alias("tau"))


def paired_bootstrap(df: DataFrame, key: str, cluster: str, a: str, b: str, label: str, rounds: int = 100, confidence: float = 0.95, bins: int = 10_000) -> DataFrame:
    """Interval of auroc(a) - auroc(b) by a Poisson bootstrap of clusters: a cluster's weight in a round comes from a hash.

    Scores in [0, 1] are summed by round and bin first, so what meets in order is rounds times bins rows.
    """
    u = F.pmod(F.xxhash64(F.col(cluster), F.col("round")), F.lit(1 << 30)) / float(1 << 30)
    weight, tail = F.lit(0), 0.0
    for k in range(8):
        tail += math.exp(-1) / math.factorial(k)
        weight = weight + (u >= tail).cast("int")
    rows = df.select(key, cluster, label, F.explode(F.array(F.struct(F.lit("a").alias("which"), F.col(a).alias("s")), F.struct(F.lit("b").alias("which"), F.col(b).alias("s")))).alias("x"))
    rows = rows.select(cluster, label, "x.which", F.round(F.col("x.s") * bins).cast("int").alias("bin"))
    by_cluster = rows.groupBy(cluster, "which", "bin").agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("q"))
    drawn = by_cluster.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("w", weight).where("w > 0")
    sums = drawn.groupBy("round", "which", "bin").agg(F.sum(F.col("p") * F.col("w")).alias("p"), F.sum(F.col("q") * F.col("w")).alias("q"))
    below = F.sum("q").over(Window.partitionBy("round", "which").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("below", F.coalesce(below, F.lit(0)))
    pairs = F.sum("p") * F.sum("q")
    each = sums.groupBy("round").pivot("which", ["a", "b"]).agg(F.when(pairs > 0, F.sum(F.col("p") * F.col("below") + 0.5 * F.col("p") * F.col("q")) / F.nullif(pairs, F.lit(0))))
    tail = (1 - confidence) / 2
    return each.agg(F.percentile(F.col("a") - F.col("b"), tail).alias("low"), F.percentile(F.col("a") - F.col("b"), 1 - tail).alias("high"), F.avg(F.col("a") - F.col("b")).alias("mean"))
