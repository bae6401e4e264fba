"""Evaluation of the events' scores: curves, exact tests, shift, fused e-values, ablations, decompositions, rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, evidence, statistics
from .fusion_queries import wide
from .registry import query
from .score_queries import EV, events, mean_score

LAYERS = ("L1", "L2", "L3", "L4", "L5")
_MEANS = ", ".join(f"avg(score) FILTER (WHERE layer = '{k}') AS {k}" for k in LAYERS)
WIDE = f"w AS (SELECT session, label, {_MEANS} FROM ev GROUP BY session, label)"
_S = "s AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM ev GROUP BY score), t AS (SELECT sum(p) AS tp, sum(q) AS tq FROM s)"


@query(f"""
    WITH {EV}, {_S}, c AS (SELECT score, p, sum(p) OVER w AS a, sum(q) OVER w AS b FROM s WINDOW w AS (ORDER BY score DESC))
    SELECT round(sum(a / (a + b) * p / tp), 8) AS average_precision FROM c, t""")
def evaluation_average_precision(spark, sf):
    return evaluation.average_precision(events(spark, sf), "label", "score").select(F.round("average_precision", 8).alias("average_precision"))


@query(f"""
    WITH {EV}, {_S}, c AS (SELECT sum(p) OVER w AS a, sum(q) OVER w AS b FROM s WINDOW w AS (ORDER BY score DESC)) SELECT round(coalesce(max(a / tp) FILTER (WHERE b / tq <= 0.05), 0), 8) AS tpr FROM c, t""")
def evaluation_tpr_at_fpr(spark, sf):
    return evaluation.tpr_at_fpr(events(spark, sf), "label", "score", 0.05).select(F.round("tpr", 8).alias("tpr"))


@query(f"""
    WITH {EV}, {_S}, c AS (SELECT p, q, sum(q) OVER (ORDER BY score) - q AS below FROM s), x AS (SELECT sum(p * below + 0.5 * p * q) AS u, sum(p)::DOUBLE AS a, sum(q)::DOUBLE AS b, sum((p + q)::DOUBLE ^ 3 - (p + q)) AS ties FROM c)
    SELECT u, round((u - a * b / 2) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))), 6) AS z FROM x""")
def evaluation_mann_whitney(spark, sf):
    return evaluation.mann_whitney(events(spark, sf), "label", "score").select("u", F.round("z", 6).alias("z"))


@query(f"""
    WITH {EV}, d AS (SELECT session, label, CASE WHEN max(score) >= .85 THEN 'BLOCK' WHEN avg(score) >= .3 THEN 'WARN' ELSE 'ALLOW' END AS d FROM ev GROUP BY session, label)
    SELECT round(count(*) FILTER (WHERE d <> 'ALLOW' AND label = 1) / count(*) FILTER (WHERE label = 1), 6) AS detection, round(count(*) FILTER (WHERE d <> 'ALLOW' AND label = 0) / count(*) FILTER (WHERE label = 0), 6) AS false_alarms,
      count(*) FILTER (WHERE d = 'ALLOW') AS allow, count(*) FILTER (WHERE d = 'WARN') AS warn, count(*) FILTER (WHERE d = 'BLOCK') AS block FROM d""")
def evaluation_pipeline(spark, sf):
    s = events(spark, sf).groupBy("session", "label").agg(F.when(F.max("score") >= 0.85, "BLOCK").when(F.avg("score") >= 0.3, "WARN").otherwise("ALLOW").alias("d"))
    m = evaluation.pipeline_metrics(s, "label", "d")
    return m.select(F.round("detection", 6).alias("detection"), F.round("false_alarms", 6).alias("false_alarms"), "allow", "warn", "block")


@query(f"""
    WITH {EV}, s AS (SELECT score, sum(label) AS d, sum(1 - label) AS c FROM ev GROUP BY score), t AS (SELECT sum(d) AS td, sum(c) AS tc FROM s), u AS (SELECT score, d, c, sum(d) OVER w AS ud, sum(c) OVER w AS uc FROM s WINDOW w AS (ORDER BY score)),
    q AS (SELECT min(score) AS p95 FROM u, t WHERE uc >= ceil(0.95 * tc))
    SELECT round(max(abs(ud / td - uc / tc)), 8) AS ks, round(sum(d * (uc - c) + 0.5 * d * c) / (max(td) * max(tc)), 8) AS auroc, round(sum(CASE WHEN score > p95 THEN d ELSE 0 END) / max(td), 8) AS above_p95 FROM u, t, q""")
def evaluation_shift(spark, sf):
    """How far the attackers' scores lie from the calibration rows: KS, AUROC and the share over the 95th percentile."""
    e = events(spark, sf)
    d = evaluation.shift_diagnostics(e.where("label = 0"), e.where("label = 1"), "score")
    return d.select(*[F.round(c, 8).alias(c) for c in ("ks", "auroc", "above_p95")])


_LOO = f"""{EV}, a AS (SELECT layer, score, sum(1 - label) AS b FROM ev GROUP BY layer, score), u AS (SELECT layer, score, sum(b) OVER (PARTITION BY layer ORDER BY score DESC) AS above, sum(b) OVER (PARTITION BY layer) AS n FROM a),
    p AS (SELECT session, label, (1 + above - (1 - label)) / (n - (1 - label) + 1) AS p FROM ev JOIN u ON ev.layer = u.layer AND ev.score = u.score), e AS (SELECT *, 0.5 * power(p, -0.5) AS e FROM p)"""


@query(f"""
    WITH {_LOO}, m AS (SELECT session, label, avg(e) AS mean_e, sum(ln(e)) AS log_product, min(p) AS least, count(*) AS k FROM e GROUP BY session, label)
    SELECT label, count(*) AS n, sum(CAST(mean_e >= 20 AS INT)) AS by_mean, sum(CAST(log_product >= ln(20) AS INT)) AS by_product, sum(CAST(least <= 0.05 / k AS INT)) AS by_union FROM m GROUP BY label""")
def evaluation_fused_evalues(spark, sf):
    """Alarms at 1 / .05 by the mean and by the product of a session's e-values, benign rows left out of their own pool."""
    p = evaluation.leave_one_out(events(spark, sf), "layer", "score", "label")
    m = evaluation.merged(p.withColumn("e", evidence.evalue(F.col("p"), 0.5)), "session", "e", "label")
    n = lambda c: F.sum(c.cast("int")).cast("long")
    return m.groupBy("label").agg(F.count("*").alias("n"), n(F.col("mean_e") >= 20).alias("by_mean"), n(F.log("product_e") >= F.log(F.lit(20.0))).alias("by_product"), n(F.col("least_p") <= 0.05 / F.col("k")).alias("by_union"))


@query(f"""
    WITH {EV}, {WIDE}, t AS (SELECT {', '.join(f'max({k}) AS t{k}' for k in LAYERS[:3])} FROM w WHERE label = 0), h AS (SELECT {', '.join(f'coalesce({k} > t{k}, false) AS {k}' for k in LAYERS[:3])} FROM w, t WHERE label = 1),
    c(layers, a, b, c) AS (VALUES ('L1', 1, 0, 0), ('L2', 0, 1, 0), ('L1+L2', 1, 1, 0), ('L3', 0, 0, 1), ('L1+L3', 1, 0, 1), ('L2+L3', 0, 1, 1), ('L1+L2+L3', 1, 1, 1))
    SELECT layers, count(*) FILTER (WHERE (a = 1 AND L1) OR (b = 1 AND L2) OR (c = 1 AND L3)) AS found FROM c, h GROUP BY layers""")
def evaluation_decomposition(spark, sf):
    """What each set of three layers finds over the largest benign score, from one pass over bit masks."""
    w = wide(spark, sf, F.avg)
    return evaluation.decomposition(evaluation.zero_false_hits(w, list(LAYERS[:3]), "label"), list(LAYERS[:3]))


_CONDITIONS = " UNION ALL ".join([f"SELECT 'all' AS condition, label, greatest(0, {', '.join(LAYERS)}) AS top FROM w"] + [f"SELECT 'no {k}', label, greatest(0, {', '.join(x for x in LAYERS if x != k)}) FROM w" for k in LAYERS])


@query(f"""
    WITH {EV}, w AS (SELECT session, label, {', '.join(f"max(score) FILTER (WHERE layer = '{k}') AS {k}" for k in LAYERS)} FROM ev GROUP BY session, label), c AS ({_CONDITIONS})
    SELECT condition, label, count(*) AS n, sum(CAST(top >= .5 AS INT)) AS caught, sum(CAST(top >= .85 AS INT)) AS blocked FROM c GROUP BY GROUPING SETS ((condition, label), (condition))""")
def evaluation_ablation(spark, sf):
    """Decisions with all layers and without each one, rolled up over classes."""
    return evaluation.ablation(wide(spark, sf), list(LAYERS), "label", "label").select("condition", "label", "n", "caught", "blocked")


@query(f"""
    WITH {EV}, {WIDE}, o AS (SELECT session, list_filter([{', '.join(f"CASE WHEN {k} >= 0.3 THEN '{k}' END" for k in LAYERS)}], lambda x: x IS NOT NULL) AS o FROM w WHERE label = 1) SELECT o[1] AS layer, count(*) AS n FROM o WHERE len(o) = 1 GROUP BY 1""")
def evaluation_unique_detections(spark, sf):
    return evaluation.unique_detections(wide(spark, sf, F.avg), list(LAYERS), "session", "label", 0.3)


@query(f"""
    WITH {EV}, {WIDE}, x AS (SELECT (coalesce(L1, 0) + coalesce(L2, 0) + coalesce(L3, 0)) / 3 >= 0.2 AS f, greatest(L1, L2, L3, L4, L5) >= 0.35 AS t FROM w) SELECT CASE WHEN f AND t THEN 'A' WHEN f THEN 'B' WHEN t THEN 'C' ELSE 'D' END AS part, count(*) AS n FROM x GROUP BY 1""")
def evaluation_novelty(spark, sf):
    w = wide(spark, sf, F.avg)
    fused = sum((F.coalesce(k, F.lit(0.0)) for k in LAYERS[:3]), F.lit(0.0)) / 3
    s = w.select((fused + 0.3).alias("fused"), (F.greatest(*LAYERS) + 0.15).alias("top"))
    return evaluation.novelty(s, "fused", "top")


@query(f"""
    WITH {EV}, {WIDE}, x AS (SELECT session, greatest({', '.join(f'coalesce({k}, 0)' for k in LAYERS)}) <= 0.45 AS below, {' + '.join(f'CAST(coalesce({k} >= .15, false) AS INT)' for k in LAYERS[:3])} AS carrying FROM w) SELECT session, below, carrying, below AND carrying >= 2 AS satisfied FROM x""")
def evaluation_certificates(spark, sf):
    """Sessions whose mean scores stay under every threshold while two of three layers carry signal."""
    w = wide(spark, sf, mean_score)
    c = evaluation.certificate({k: F.col(k) for k in LAYERS}, 2, LAYERS[:3])
    return w.select("session", c["below"].alias("below"), c["carrying"].alias("carrying"), c["satisfied"].alias("satisfied"))


@query(f"""
    WITH {EV}, r AS (SELECT layer, greatest(0, 0.48 - avg(score)) AS room FROM ev GROUP BY layer), t AS (SELECT sum(room) AS total FROM r)
    SELECT i AS step, round(total * 1.5 * i / 40, 6) AS budget, round(least(total * 1.5 * i / 40, total), 6) AS hidden, round(total * 1.5 * i / 40 - least(total * 1.5 * i / 40, total), 6) AS forced FROM t, range(0, 41) AS g(i)""")
def evaluation_capacity_sweep(spark, sf):
    """How much of 41 budgets fits under the layers' thresholds, and how much is forced over them."""
    r = events(spark, sf).groupBy("layer").agg(F.greatest(F.lit(0.0), 0.48 - F.avg("score")).alias("room"))
    s = evaluation.capacity_sweep(r, "room", "layer")
    step = F.when(F.max("budget").over(_all()) > 0, F.round(F.col("budget") / F.max("budget").over(_all()) * 40)).otherwise(0.0)
    return s.withColumn("step", step.cast("long")).select("step", *[F.round(c, 6).alias(c) for c in ("budget", "hidden", "forced")])


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # 41 rows


@query(f"""
    WITH {EV}, r AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY event_id) AS round, score FROM ev), f AS (SELECT session, min(round) FILTER (WHERE score < 0.02) AS first FROM r WHERE round <= 20 GROUP BY session)
    SELECT CAST(i AS INT) AS round, count(*) FILTER (WHERE first <= i) AS stopped, round(count(*) FILTER (WHERE first <= i) / count(*), 6) AS share FROM range(1, 21) AS g(i), f GROUP BY i""")
def evaluation_rounds(spark, sf):
    """By which of twenty attempts a session first came in under the threshold: the curve of evasion."""
    from pyspark.sql import Window

    r = events(spark, sf).withColumn("round", F.row_number().over(Window.partitionBy("session").orderBy("event_id"))).where("round <= 20")
    out = evaluation.rounds_until(r, "session", "round", F.col("score") < 0.02, 20)
    return out.select("round", "stopped", F.round("share", 6).alias("share"))


@query(f"""
    WITH {EV}, h AS (SELECT least(19, CAST(floor(score * 20) AS INT)) AS bin, sum(1 - label) AS c, sum(label) AS d FROM ev GROUP BY 1), t AS (SELECT sum(c) AS tc, sum(d) AS td FROM h),
    w AS (SELECT bin, least(50.0, ((d + 1) / (td + 20)) / ((c + 1) / (tc + 20))) AS weight FROM h, t),
    e AS (SELECT score, weight FROM ev JOIN w ON least(19, CAST(floor(score * 20) AS INT)) = bin WHERE label = 0), s AS (SELECT score, sum(weight) AS w FROM e GROUP BY score),
    m AS (SELECT sum(weight) + avg(weight) AS total FROM e), u AS (SELECT score, sum(w) OVER (ORDER BY score) / total AS share FROM s, m) SELECT coalesce(min(score), 'inf'::DOUBLE) AS tau FROM u WHERE share >= 0.95 - 1e-12""")
def evaluation_weighted_conformal(spark, sf):
    """The threshold under shift: calibration rows weighted by the histograms' ratio, the mean weight at infinity."""
    e = events(spark, sf)
    w = statistics.density_ratio(e.where("label = 0"), e.where("label = 1"), "score")
    rows = e.where("label = 0").withColumn("bin", F.least(F.floor(F.col("score") * 20), F.lit(19)).cast("int")).join(w, "bin")
    return evaluation.conformal_with_weights(rows, "score", "weight", 0.05)


_PAIRS = [(a, b) for i, a in enumerate(LAYERS) for b in LAYERS[i + 1 :]]


@query(f"WITH {EV}, {WIDE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM w" for a, b in _PAIRS))
def evaluation_dependence(spark, sf):
    """Correlation of each two layers' mean scores."""
    c = evaluation.pairwise_correlation(wide(spark, sf, F.avg), list(LAYERS))
    return c.select("a", "b", F.round("correlation", 6).alias("correlation"))


@query(f"""
    WITH {EV}, b AS (SELECT CAST(round(score * 100) AS INT) AS bin, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS q FROM ev WHERE session % 2 = 0 GROUP BY 1), m AS (SELECT sum(p) AS tp, sum(q) AS tq FROM b),
    x AS (SELECT DISTINCT score FROM ev), d AS (SELECT score, sum(p * exp(-0.5 * power((score - bin / 100) / 0.08, 2))) AS a, sum(q * exp(-0.5 * power((score - bin / 100) / 0.08, 2))) AS b FROM x, b GROUP BY score)
    SELECT event_id, round(ln(a / greatest(tp, 1) + 1e-12) - ln(b / greatest(tq, 1) + 1e-12), 6) AS llr FROM ev JOIN d ON ev.score = d.score, m""")
def evaluation_kernel_ratio(spark, sf):
    """Log ratio of kernel densities learned from every second session, for all events."""
    e = events(spark, sf)
    known = evaluation.density_log_ratio(e.select("score").distinct(), e.where("session % 2 = 0"), "score", "label", 0.08, 100)
    return e.join(known, "score").select("event_id", F.round("llr", 6).alias("llr"))


@query()
def evaluation_exact_intervals(spark, sf):
    """Clopper-Pearson intervals of alarm rates by layer, and the exact test of two thresholds."""
    e = events(spark, sf)
    c = e.groupBy("layer").agg(F.sum((F.col("score") >= 0.5).cast("long")).alias("k"), F.count("*").alias("n"), F.sum(((F.col("score") >= 0.5) & (F.col("label") == 1)).cast("long")).alias("a"), F.sum(((F.col("score") >= 0.5) & (F.col("label") == 0)).cast("long")).alias("b"))
    low, high = evaluation.clopper_pearson(F.col("k"), F.col("n"))
    return c.select("layer", "k", "n", low.alias("low"), high.alias("high"), evaluation.exact_mcnemar(F.col("a"), F.col("b")).alias("p"))


@query()
def evaluation_paired_bootstrap(spark, sf):
    """Interval of the difference of two scores' AUROC, sessions drawn whole."""
    e = events(spark, sf).withColumn("other", F.least(F.lit(1.0), F.col("score") * 0.5 + F.col("event_id") % 7 / 14))
    return evaluation.paired_bootstrap(e, "event_id", "session", "score", "other", "label", 50)


@query(f"""
    WITH {EV}, n AS (SELECT layer, sum(1 - label) AS n FROM ev GROUP BY layer), k AS (SELECT layer, n, 1 / ln(n + 1) AS kappa FROM n)
    SELECT layer, n, round(1 / (kappa * power(n + 1, 1 - kappa)), 8) AS reachable, CAST(ceil(power(1 / (0.05 * 0.5), 2) - 1 - 1e-9) AS BIGINT) AS least_benign FROM k""")
def evaluation_reachable_alpha(spark, sf):
    """The smallest error rate that a layer's benign rows allow, and how many rows an e-value of 20 takes."""
    n = events(spark, sf).groupBy("layer").agg(F.sum(1 - F.col("label")).alias("n"))
    return n.select("layer", "n", F.round(evaluation.reachable_alpha(F.col("n"), evidence.optimal_kappa(F.col("n"))), 8).alias("reachable"), evaluation.least_benign(0.05, 0.5).alias("least_benign"))
