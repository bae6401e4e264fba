"""Scores, evidence, sessions and evaluation over the events table.

An event's type names its layer and its value its score; every third user counts as an attacker.
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import axis, vectors
from ..operators import evidence, mining, retrieval, sessions, statistics
from .registry import query, table

# A layer's warn and block anchors.
ANCHORS = {"L1": (0.5494, 0.85), "L2": (0.372876, 0.600), "L3": (0.70, 0.85), "L4": (0.80, 0.97), "L5": (0.50, 0.85)}

EV = """ev AS (SELECT event_id, user_id AS session, CASE event_type WHEN 'click' THEN 'L1' WHEN 'view' THEN 'L2' WHEN 'purchase' THEN 'L3' WHEN 'error' THEN 'L4' ELSE 'L5' END AS layer,
      floor(least(1::DOUBLE, value / 120::DOUBLE) * 10000) / 10000 AS score, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS label FROM events)"""


def events(spark, sf):
    t = F.col("event_type")
    layer = F.when(t == "click", "L1").when(t == "view", "L2").when(t == "purchase", "L3").when(t == "error", "L4").otherwise("L5")
    score = F.floor(F.least(F.lit(1.0), F.col("value") / 120.0) * 10000) / 10000
    return table(spark, sf, "events", "event_id", "user_id", "event_type", "value").select("event_id", F.col("user_id").alias("session"), layer.alias("layer"), score.alias("score"), F.when(F.col("user_id") % 3 == 0, 1).otherwise(0).alias("label"))


def mean_score(score):
    """Mean of scores as of events(), the same in any order of rows: ten-thousandths are added as whole numbers, so that a
    mean that lies on a threshold is equal to it."""
    return F.avg(F.rint(score * 10000)) / 10000


def _rescale_sql(w, b):
    return f"CASE WHEN score <= 0 THEN 0 WHEN score <= {w} THEN score / {w} * 0.5 WHEN score <= {b} THEN 0.5 + (score - {w}) / ({b} - {w}) * 0.35 ELSE 0.85 + (score - {b}) END"


_SHARED_SQL = "CASE layer " + " ".join(f"WHEN '{k}' THEN {_rescale_sql(*v)}" for k, v in ANCHORS.items()) + " END"


def shared(score):
    out = F.lit(None).cast("double")
    for k, (w, b) in ANCHORS.items():
        out = F.when(F.col("layer") == k, axis.rescale(score, w, b)).otherwise(out)
    return out


@query(f"""
    WITH {EV}, s AS (SELECT event_id, score, round({_SHARED_SQL} + 1e-9::DOUBLE, 6) AS shared FROM ev)
    SELECT event_id, shared, CASE WHEN score >= .85 THEN 'CRITICAL' WHEN score >= .65 THEN 'HIGH' WHEN score >= .4 THEN 'MEDIUM' WHEN score >= .2 THEN 'LOW' ELSE 'CLEAN' END AS severity,
      CASE WHEN shared >= .85 THEN 'BLOCKED' WHEN shared >= .5 THEN 'WARNED' ELSE 'ALLOWED' END AS action FROM s""")
def axis_severity_and_action(spark, sf):
    """Scores of four decimals meet exact halves at the seventh; a billionth added sends those up, whatever a double's last bit."""
    s = events(spark, sf).withColumn("shared", F.round(shared(F.col("score")) + 1e-9, 6))
    return s.select("event_id", "shared", axis.severity(F.col("score")).alias("severity"), axis.action(F.col("shared")).alias("action"))


@query(f"WITH {EV} SELECT event_id, round(score, 6) AS back FROM ev")
def axis_round_trip(spark, sf):
    s = F.col("score")
    return events(spark, sf).select("event_id", F.round(axis.unscale(axis.rescale(s, 0.5494, 0.85), 0.5494, 0.85), 6).alias("back"))


@query(f"""
    WITH {EV}, m AS (SELECT session, layer, max(score) AS s FROM ev GROUP BY session, layer)
    SELECT session, round(1 - exp(-sum(CASE WHEN s >= 1 THEN 6.0 ELSE least(6.0, -ln(1 - s)) END)), 6) AS evidence, round(1 - exp(-count(*)), 6) AS saturated FROM m GROUP BY session""")
def axis_noisy_or(spark, sf):
    m = events(spark, sf).groupBy("session", "layer").agg(F.max("score").alias("s"))
    return m.groupBy("session").agg(F.round(axis.noisy_or(F.sort_array(F.collect_list("s"))), 6).alias("evidence"), F.round(axis.saturating(F.count("*")), 6).alias("saturated"))


@query(f"""
    WITH {EV}, m AS (SELECT session, layer, avg(score) AS s FROM ev GROUP BY session, layer), t AS (SELECT session, max(s) AS top, count(*) FILTER (WHERE s >= 0.5) AS warned FROM m GROUP BY session)
    SELECT session, CASE WHEN session % 50 = 0 OR top >= 0.85 THEN 'BLOCK' WHEN top >= 0.5 AND warned >= 2 THEN 'WARN' ELSE 'ALLOW' END AS decision FROM t""")
def axis_pipeline_decision(spark, sf):
    m = events(spark, sf).groupBy("session", "layer").agg(F.avg("score").alias("s"))
    scores = m.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("layer", "s"))).alias("scores"))
    return scores.select("session", axis.decision(F.col("scores"), F.col("session") % 50 == 0, F.lit(False), 2).alias("decision"))


@query(f"""
    WITH {EV}, d AS (SELECT session, avg(score) FILTER (WHERE layer = 'L2') AS density, max(score) FILTER (WHERE layer = 'L1') AS l1 FROM ev GROUP BY session),
    t AS (SELECT session, least(1.0, greatest(0.0, 1 - (.6 * density + .4 * l1))) AS trust FROM d)
    SELECT session, round(trust, 6) AS trust, CASE WHEN trust < .4 THEN 'quarantine' WHEN trust < .713 THEN 'review' ELSE 'trusted' END AS route FROM t WHERE trust IS NOT NULL""")
def ingest_trust_routing(spark, sf):
    of = lambda name: F.when(F.col("layer") == name, F.col("score"))
    d = events(spark, sf).groupBy("session").agg(F.avg(of("L2")).alias("density"), F.max(of("L1")).alias("l1")).where("density is not null and l1 is not null")
    trust = axis.document_trust(F.col("density"), F.col("l1"))
    return d.select("session", F.round(trust, 6).alias("trust"), axis.trust_route(trust).alias("route"))


@query(f"""
    WITH {EV}, r AS (SELECT layer, score, row_number() OVER (PARTITION BY layer ORDER BY score) AS k, count(*) OVER (PARTITION BY layer) AS n FROM ev WHERE label = 0)
    SELECT layer, n, coalesce(max(score) FILTER (WHERE k = ceil((n + 1) * 0.95 - 1e-9)), 'inf'::DOUBLE) AS tau FROM r GROUP BY layer, n""")
def conformal_mondrian_thresholds(spark, sf):
    return statistics.conformal_thresholds(events(spark, sf).where("label = 0"), "layer", "score", 0.05)


@query(f"""
    WITH {EV}, r AS (SELECT layer, score, row_number() OVER (PARTITION BY layer ORDER BY score) AS k, count(*) OVER (PARTITION BY layer) AS n FROM ev WHERE label = 0),
    t AS (SELECT layer, max(score) FILTER (WHERE k = ceil((n + 1) * 0.95 - 1e-9)) AS tau FROM r GROUP BY layer)
    SELECT ev.layer, label, count(*) AS n, round(avg(CASE WHEN score > tau THEN 1.0 ELSE 0.0 END), 6) AS rate FROM ev JOIN t ON ev.layer = t.layer GROUP BY ev.layer, label""")
def conformal_flag_rates(spark, sf):
    e = events(spark, sf)
    tau = statistics.conformal_thresholds(e.where("label = 0"), "layer", "score", 0.05).select("layer", "tau")
    return e.join(tau, "layer").groupBy("layer", "label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("score") > F.col("tau")).cast("double")), 6).alias("rate"))


@query(f"""
    WITH {EV}, h AS (SELECT least(19, CAST(floor(score * 20) AS INT)) AS bin, sum(1 - label) AS c, sum(label) AS d FROM ev GROUP BY 1), t AS (SELECT sum(c) AS tc, sum(d) AS td FROM h),
    w AS (SELECT bin, least(50.0, ((d + 1) / (td + 20)) / ((c + 1) / (tc + 20))) AS weight FROM h, t),
    e AS (SELECT score, weight FROM ev JOIN w ON least(19, CAST(floor(score * 20) AS INT)) = bin WHERE label = 0),
    s AS (SELECT score, sum(weight) AS w FROM e GROUP BY score), u AS (SELECT score, sum(w) OVER (ORDER BY score) / sum(w) OVER () AS share FROM s)
    SELECT 0 AS g, min(score) AS quantile FROM u WHERE share >= 0.95 - 1e-12""")
def conformal_shift_weighted_quantile(spark, sf):
    e = events(spark, sf)
    w = statistics.density_ratio(e.where("label = 0"), e.where("label = 1"), "score")
    rows = e.where("label = 0").withColumn("bin", F.least(F.floor(F.col("score") * 20), F.lit(19)).cast("int")).join(w, "bin")
    return statistics.weighted_quantile_of_all(rows, "score", "weight", 0.95).select(F.lit(0).alias("g"), "quantile")


_P_SQL = f"""{EV}, b AS (SELECT score AS x FROM ev WHERE label = 0 AND layer = 'L1'), nb AS (SELECT count(*) AS n FROM b),
    a AS (SELECT event_id, session, score FROM ev WHERE layer = 'L1' AND label = 1),
    cnt AS (SELECT s.score, count(b.x) AS above FROM (SELECT DISTINCT score FROM a) s LEFT JOIN b ON b.x >= s.score GROUP BY s.score),
    p AS (SELECT event_id, session, (1 + above) / (n + 1) AS p, n FROM a JOIN cnt ON a.score = cnt.score, nb)"""


def _pvalues(spark, sf):
    e = events(spark, sf).where("layer = 'L1'")
    return evidence.pvalues(e.where("label = 1").select("event_id", "session", "score"), e.where("label = 0"), "score", "event_id", "session")


@query(f"WITH {_P_SQL} SELECT event_id, round(p, 8) AS p, round((1 / ln(n + 1)) * power(p, (1 / ln(n + 1)) - 1), 6) AS e, round((1 / ln(n + 1)) * power(n + 1, 1 - 1 / ln(n + 1)), 6) AS largest FROM p")
def evidence_evalues(spark, sf):
    k = evidence.optimal_kappa(F.col("n"))
    return _pvalues(spark, sf).select("event_id", F.round("p", 8).alias("p"), F.round(evidence.evalue(F.col("p"), k), 6).alias("e"), F.round(evidence.largest_evalue(F.col("n"), k), 6).alias("largest"))


_E_SQL = f"{_P_SQL}, e AS (SELECT event_id, session, 0.5 * power(p, -0.5) AS e FROM p)"


def _evalues(spark, sf):
    return _pvalues(spark, sf).withColumn("e", evidence.evalue(F.col("p"), 0.5))


@query(f"""
    WITH {_E_SQL}, w AS (SELECT session, event_id, sum(ln(e)) OVER (PARTITION BY session ORDER BY event_id) AS lw FROM e)
    SELECT session, min(event_id) FILTER (WHERE lw >= ln(20) - 1e-12) AS first, round(max(lw), 6) AS largest FROM w GROUP BY session""")
def evidence_e_process(spark, sf):
    out = evidence.first_crossing(evidence.wealth(_evalues(spark, sf), "session", "event_id", "e"), "session", "event_id", "log_wealth", 0.05)
    return out.select("session", "first", F.round("largest", 6).alias("largest"))


@query(f"""
    WITH {_E_SQL}, s AS (SELECT session, event_id, e, sum(ln(e)) OVER w AS s, row_number() OVER w AS tau FROM e WINDOW w AS (PARTITION BY session ORDER BY event_id))
    SELECT event_id, round(exp(s) * sum(exp(-(s - ln(e))) / (tau * (tau + 1))) OVER (PARTITION BY session ORDER BY event_id), 6) AS mixture FROM s""")
def evidence_mixture_detector(spark, sf):
    return evidence.mixture(_evalues(spark, sf), "session", "event_id", "e").select("event_id", F.round("mixture", 6).alias("mixture"))


@query(f"WITH {_E_SQL} SELECT session, round(avg(e), 6) AS mean_e, round(exp(sum(ln(e))), 4) AS product_e, min(1 / (4 * e * e)) <= 0.05 / count(*) AS union_alarm FROM e GROUP BY session")
def evidence_merges(spark, sf):
    e = _evalues(spark, sf)
    return e.groupBy("session").agg(F.round(F.avg("e"), 6).alias("mean_e"), F.round(F.exp(F.sum(F.log("e"))), 4).alias("product_e"), (F.min(1 / (4 * F.col("e") * F.col("e"))) <= 0.05 / F.count("*")).alias("union_alarm"))


@query(f"""
    WITH {EV}, s AS (SELECT session, sum(score - 0.4) OVER w AS t, row_number() OVER w AS k FROM ev WINDOW w AS (PARTITION BY session ORDER BY event_id)),
    x AS (SELECT session, min(k) FILTER (WHERE t >= {math.log(19)} OR t <= {-math.log(19)}) AS stop, max(k) AS last FROM s GROUP BY session)
    SELECT x.session, CASE WHEN t > 0 THEN 'malicious' ELSE 'benign' END AS verdict, CAST(k AS INT) AS consulted, round(t, 6) AS total, stop IS NOT NULL AS crossed FROM x JOIN s ON x.session = s.session AND s.k = coalesce(stop, last)""")
def evidence_sprt(spark, sf):
    out = evidence.sprt(events(spark, sf).withColumn("llr", F.col("score") - 0.4), "session", "event_id", "llr", 0.05, 0.05)
    return out.withColumn("total", F.round("total", 6))


@query(f"""
    WITH {EV}, w AS (SELECT event_id, session, max(score) OVER s AS overall, max(score) FILTER (WHERE layer = 'L1') OVER s AS l1_max, max(score) FILTER (WHERE layer = 'L3') OVER s AS l3_max FROM ev WINDOW s AS (PARTITION BY session ORDER BY event_id))
    SELECT event_id, overall, l1_max, l3_max FROM w""")
def sessions_running_state(spark, sf):
    return sessions.session_state(events(spark, sf), "session", "event_id", "layer", "score").select("event_id", "overall", "l1_max", "l3_max")


@query(f"""
    WITH {EV}, w AS (SELECT event_id, session, max(score) FILTER (WHERE layer = 'L1') OVER s AS l1, max(score) FILTER (WHERE layer = 'L2') OVER s AS l2,
        arg_max(score, event_id) FILTER (WHERE layer = 'L3') OVER s AS l3, max(score) FILTER (WHERE layer = 'L4') OVER s AS l4, max(score) FILTER (WHERE layer = 'L5') OVER s AS l5
      FROM ev WINDOW s AS (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    f AS (SELECT session, event_id, 'SLOW_BURN' AS rule, least(1.0, greatest(l3, l1) + 0.1) AS rule_score FROM w WHERE l3 > .7 AND l1 > .3
      UNION ALL SELECT session, event_id, 'LEAK_AFTER_ATTACK', 0.98 FROM w WHERE (l1 > .5 OR l3 > .7) AND l5 > .5
      UNION ALL SELECT session, event_id, 'POISONED_CONTEXT', 0.97 FROM w WHERE l2 > .713 AND l4 >= .9)
    SELECT session, rule, min(event_id) AS first, round(arg_min(rule_score, event_id), 6) AS rule_score FROM f GROUP BY session, rule""")
def sessions_correlation_rules(spark, sf):
    out = sessions.correlate(events(spark, sf), "session", "event_id", "layer", "score")
    return out.select("session", "rule", "first", F.round("rule_score", 6).alias("rule_score"))


@query(f"WITH {EV} SELECT session, count(*) AS n_events, max(event_id) AS event_id, arg_max(layer, event_id) AS layer, arg_max(score, event_id) AS score FROM ev GROUP BY session")
def sessions_latest_event(spark, sf):
    return sessions.latest(events(spark, sf), "session", "event_id", "layer", "score")


@query(f"WITH {EV} SELECT event_id, session, layer, score FROM ev WHERE score >= 0.65 AND layer IN ('L1', 'L4') ORDER BY event_id DESC LIMIT 200")
def sessions_event_filter(spark, sf):
    """The newest 200 events of a severity and of two layers: a top-k report."""
    return events(spark, sf).where("score >= 0.65 and layer in ('L1', 'L4')").orderBy(F.desc("event_id")).limit(200).select("event_id", "session", "layer", "score")


@query(f"""
    WITH RECURSIVE {EV}, n AS (SELECT session AS node, round(1 - avg(score) / 2, 6) AS own FROM ev GROUP BY session),
    e AS (SELECT node // 2 AS u, node AS v, 0.9 AS w FROM n WHERE node > 1), r AS (
      SELECT node, own, own AS eff FROM n WHERE node <= 1 OR node // 2 NOT IN (SELECT node FROM n)
      UNION ALL SELECT n.node, n.own, n.own * (1 - 0.9 * (1 - r.eff)) FROM r JOIN e ON e.u = r.node JOIN n ON n.node = e.v)
    SELECT node, round(eff, 6) AS effective, eff < 0.75 AS low FROM r""")
def sessions_taint_propagation(spark, sf):
    n = events(spark, sf).groupBy(F.col("session").alias("node")).agg(F.round(1 - F.avg("score") / 2, 6).alias("own"))
    edges = n.where("node > 1").select(F.floor(F.col("node") / 2).alias("u"), F.col("node").alias("v"), F.lit(0.9).alias("w"))
    out = sessions.propagate(n, edges, 40)
    return out.select("node", F.round("effective", 6).alias("effective"), (F.col("effective") < 0.75).alias("low"))


@query()
def mining_frequent_patterns(spark, sf):
    e = events(spark, sf).withColumn("item", mining.symbol("layer", "score"))
    return mining.frequent_patterns(mining.sequences(e, "session", "event_id", "item"), "session", "items", 0.2, 5)


@query(f"""
    WITH {EV} SELECT layer, tp, fp, tn, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
      round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM (
      SELECT layer, count(*) FILTER (WHERE score >= .5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= .5 AND label = 0) AS fp, count(*) FILTER (WHERE score < .5 AND label = 0) AS tn, count(*) FILTER (WHERE score < .5 AND label = 1) AS fn FROM ev GROUP BY layer)""")
def metrics_classification(spark, sf):
    out = statistics.classification(events(spark, sf), "label", "score", 0.5, "layer")
    return out.select("layer", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy")])


@query(f"""
    WITH {EV}, s AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM ev GROUP BY score), u AS (SELECT *, sum(n) OVER (ORDER BY score) - n AS below FROM s)
    SELECT round(sum(p * below + 0.5 * p * n) / (sum(p) * sum(n)), 8) AS auroc, sum(p) AS n_pos, sum(n) AS n_neg FROM u""")
def metrics_auroc(spark, sf):
    return statistics.auroc(events(spark, sf), "label", "score").withColumn("auroc", F.round("auroc", 8))


@query(f"""
    WITH {EV}, t AS (SELECT sum(label) AS p, sum(1 - label) AS n FROM ev), s AS (SELECT score, sum(label) AS a, sum(1 - label) AS b FROM ev GROUP BY score)
    SELECT score AS threshold, round(sum(a) OVER w / p, 8) AS tpr, round(sum(b) OVER w / n, 8) AS fpr FROM s, t WINDOW w AS (ORDER BY score DESC)""")
def metrics_roc(spark, sf):
    return statistics.roc(events(spark, sf), "label", "score").select("threshold", F.round("tpr", 8).alias("tpr"), F.round("fpr", 8).alias("fpr"))


@query(f"""
    WITH {EV}, t AS (SELECT sum(label) AS p, sum(1 - label) AS n FROM ev), s AS (SELECT score, sum(label) AS a, sum(1 - label) AS b FROM ev GROUP BY score),
    c AS (SELECT sum(a) OVER (ORDER BY score) / p AS x, sum(b) OVER (ORDER BY score) / n AS y FROM s, t) SELECT round(max(abs(x - y)), 8) AS ks FROM c""")
def metrics_ks(spark, sf):
    return statistics.ks_statistic(events(spark, sf), "label", "score").select(F.round("ks", 8).alias("ks"))


@query(f"""
    WITH {EV}, b AS (SELECT least(9, CAST(floor(score * 10) AS INT)) AS bin, count(*) AS n, avg(score) AS c, avg(CASE WHEN (score >= .5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS a FROM ev GROUP BY 1)
    SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b""")
def metrics_calibration_error(spark, sf):
    return statistics.calibration_error(events(spark, sf), "label", "score").select(F.round("ece", 6).alias("ece"))


@query(f"""
    WITH {EV} SELECT layer, round(quantile_cont(score, .5), 6) AS p50, round(quantile_cont(score, .95), 6) AS p95, round(quantile_cont(score, .99), 6) AS p99, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS low, max(score) AS high FROM ev GROUP BY layer""")
def metrics_latency_percentiles(spark, sf):
    e = events(spark, sf)
    rest = e.groupBy("layer").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"), F.min("score").alias("low"), F.max("score").alias("high"))
    p = statistics.percentiles(e, "layer", "score", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.join(rest, "layer").select("layer", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "mean", "std", "low", "high")


@query(f"""
    WITH {EV}, c AS (SELECT layer, sum(label) AS k, count(*) AS n FROM ev WHERE score >= .5 GROUP BY layer), q AS (SELECT layer, k, n, k / n AS p, 1 + 1.96 * 1.96 / n AS d FROM c)
    SELECT layer, k, n, round(greatest(0, (p + 1.96 * 1.96 / (2 * n)) / d - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / d), 6) AS low,
      round(least(1, (p + 1.96 * 1.96 / (2 * n)) / d + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / d), 6) AS high FROM q""")
def metrics_wilson(spark, sf):
    c = events(spark, sf).where("score >= 0.5").groupBy("layer").agg(F.sum("label").alias("k"), F.count("*").alias("n"))
    low, high = statistics.wilson(F.col("k"), F.col("n"))
    return c.select("layer", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""
    WITH {EV}, r AS (SELECT (score >= .5) = (label = 1) AS a, (score >= .7) = (label = 1) AS b FROM ev), c AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b FROM r)
    SELECT only_a, only_b, round(power(greatest(abs(only_a - only_b) - 1, 0), 2) / (only_a + only_b), 6) AS chi2 FROM c""")
def metrics_mcnemar(spark, sf):
    right = lambda t: (F.col("score") >= t) == (F.col("label") == 1)
    return statistics.mcnemar(events(spark, sf).select(right(0.5).alias("a"), right(0.7).alias("b")), "a", "b").withColumn("chi2", F.round("chi2", 6))


@query()
def metrics_bootstrap(spark, sf):
    return statistics.bootstrap_mean(events(spark, sf), "event_id", "score")


@query(f"""
    WITH {EV} SELECT layer, label, count(*) AS n, round(avg(CASE WHEN score >= .5 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM ev GROUP BY ROLLUP (layer, label)""")
def metrics_ablation_rollup(spark, sf):
    """Detection rates overall, by layer and by layer and label in one pass."""
    return events(spark, sf).rollup("layer", "label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("score") >= 0.5).cast("double")), 6).alias("rate"))


@query(f"""
    WITH {EV}, m AS (SELECT session, label, max(score) FILTER (WHERE layer = 'L1') AS l1, max(score) FILTER (WHERE layer = 'L2') AS l2, max(score) FILTER (WHERE layer = 'L3') AS l3, max(score) FILTER (WHERE layer = 'L4') AS l4, max(score) FILTER (WHERE layer = 'L5') AS l5 FROM ev GROUP BY session, label)
    SELECT session, coalesce(greatest(coalesce(l1, 0), coalesce(l2, 0), coalesce(l3, 0), coalesce(l4, 0), coalesce(l5, 0)), 0) <= 0.45 AS below, CAST(coalesce(l1 >= .15, false) AS INT) + CAST(coalesce(l2 >= .15, false) AS INT) + CAST(coalesce(l3 >= .15, false) AS INT) AS carrying FROM m""")
def certificates_sub_threshold(spark, sf):
    """Every layer at .50 - .05 or below, and how many of the first three carry .15 or more."""
    m = events(spark, sf).groupBy("session", "label").agg(*[F.max(F.when(F.col("layer") == k, F.col("score"))).alias(k) for k in ANCHORS])
    top = F.greatest(*[F.coalesce(k, F.lit(0.0)) for k in ANCHORS])
    carrying = sum((F.coalesce(F.col(k) >= 0.15, F.lit(False)).cast("int") for k in ("L1", "L2", "L3")), F.lit(0))
    return m.select("session", (top <= 0.45).alias("below"), carrying.alias("carrying"))


@query(f"""
    WITH {EV}, r AS (SELECT layer, score, label FROM ev), s AS (SELECT layer, score, sum(label) AS p, sum(1 - label) AS n FROM r GROUP BY layer, score),
    u AS (SELECT *, sum(n) OVER (PARTITION BY layer ORDER BY score) - n AS below FROM s), a AS (SELECT layer, sum(p * below + 0.5 * p * n) / (sum(p) * sum(n)) AS auroc FROM u GROUP BY layer)
    SELECT layer, round(auroc, 6) AS auroc, round(0.48 * 2 * abs(auroc - 0.5), 6) AS capacity, CASE WHEN abs(auroc - .5) >= .35 THEN 'DEGENERATE' WHEN abs(auroc - .5) >= .15 THEN 'CONFOUNDED' ELSE 'clean' END AS verdict FROM a""")
def certificates_effective_capacity(spark, sf):
    """Room under a threshold of .50 with .02 to spare, weighted by how much a layer tells; and the corpus verdict."""
    e = events(spark, sf)
    s = e.groupBy("layer", "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    w = Window.partitionBy("layer").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("below", F.sum("n").over(w) - F.col("n"))
    a = s.groupBy("layer").agg((F.sum(F.col("p") * F.col("below") + 0.5 * F.col("p") * F.col("n")) / (F.sum("p") * F.sum("n"))).alias("a"))
    far = F.abs(F.col("a") - 0.5)
    return a.select("layer", F.round("a", 6).alias("auroc"), F.round(0.48 * 2 * far, 6).alias("capacity"), F.when(far >= 0.35, "DEGENERATE").when(far >= 0.15, "CONFOUNDED").otherwise("clean").alias("verdict"))


@query("""
    WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), v AS (SELECT c.conv_id, c.turn, e.embedding AS x FROM conversations c CROSS JOIN n JOIN embeddings e ON (c.conv_id * 7 + c.turn) % n.n = e.vec_id),
    p AS (SELECT conv_id, turn, x, lag(x) OVER w AS b, first(x) OVER w AS f FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    d AS (SELECT conv_id, turn, CASE WHEN b IS NULL THEN 0.0 ELSE greatest(0.0, 1 - list_cosine_similarity(x::DOUBLE[], b::DOUBLE[])) END AS velocity, CASE WHEN b IS NULL THEN 0.0 ELSE 1 - list_cosine_similarity(x::DOUBLE[], f::DOUBLE[]) END AS drift FROM p)
    SELECT conv_id, turn, round(velocity, 6) AS velocity, round(drift, 6) AS drift, round(least(1.0, greatest(0.0, 0.25 * drift * greatest(0.0, 1 - velocity))), 6) AS score FROM d""")
def conversation_drift(spark, sf):
    """Velocity from the turn before and drift from the first, with stored vectors as turns' embeddings."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    n = F.broadcast(e.agg((F.max("vec_id") + 1).alias("n")))  # one row
    c = table(spark, sf, "conversations", "conv_id", "turn").join(n).withColumn("vec_id", (F.col("conv_id") * 7 + F.col("turn")) % F.col("n")).drop("n")
    v = c.join(e, "vec_id")
    w = Window.partitionBy("conv_id").orderBy("turn")
    v = v.withColumn("before", F.lag("embedding").over(w)).withColumn("start", F.first("embedding").over(w))
    none = F.col("before").isNull()
    v = v.withColumn("velocity", F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - vectors.cosine(F.col("embedding"), F.col("before")))))
    v = v.withColumn("drift", F.when(none, 0.0).otherwise(1 - vectors.cosine(F.col("embedding"), F.col("start"))))
    score = axis.conversation_score(F.lit(0.0), F.col("drift"), F.col("velocity"), F.lit(0.0))
    return v.select("conv_id", "turn", F.round("velocity", 6).alias("velocity"), F.round("drift", 6).alias("drift"), F.round(score, 6).alias("score"))


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS x FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id, list_cosine_similarity(x::DOUBLE[], embedding::DOUBLE[]) AS c FROM q, embeddings WHERE query_id <> vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(c, 6) AS similarity FROM r WHERE rank <= 3""")
def retrieval_top_chunks(spark, sf):
    """The three nearest vectors of every query (ids divisible by 20): the stated queries go to the rows in blocks."""
    rows = table(spark, sf, "embeddings", "vec_id", "embedding")
    return retrieval.nearest(rows.where("vec_id % 20 = 0"), rows, 3).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))
