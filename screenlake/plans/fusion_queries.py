"""Fusion of scores: vectors against banks, quantile axes, tiers of a prompt, layers of a session, exported scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fusion
from .registry import query, table
from .score_queries import EV, events

# Banks: the first twenty stored vectors, by parity; knots and levels of a quantile axis; calibrated lines of tiers.
BANK = 20
KNOTS, OTHER, LEVELS = [0.1, 0.2, 0.4, 0.8], [0.05, 0.15, 0.5, 0.9], [0.25, 0.5, 0.75, 1.0]
LINES = {"rule": (-1.0, 3.0), "semantic": (-2.0, 4.0), "model": (-3.0, 9.0), "judge": (-0.5, 2.5)}
PRIOR = -0.7
COEF, MEAN, SCALE = [1.5, 0.8, 1.1, 0.6, 0.4], [0.3, 0.25, 0.35, 0.3, 0.2], [0.2, 0.15, 0.25, 0.2, 0.1]


def _doubles(values) -> F.Column:
    return F.array(*map(F.lit, map(float, values)))


def _banks(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding").where(F.col("vec_id") < BANK)  # one row of two arrays of vectors
    of = lambda parity: F.transform(F.array_sort(F.collect_list(F.when(F.col("vec_id") % 2 == parity, F.struct("vec_id", "embedding")))), lambda x: x["embedding"])
    return e.agg(of(0).alias("attacks"), of(1).alias("benign"))


@query(f"""
    WITH b AS (SELECT vec_id AS k, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id < {BANK}),
    s AS (SELECT e.vec_id, k % 2 AS parity, list_cosine_similarity(e.embedding::DOUBLE[], x) AS c FROM embeddings e, b),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, parity ORDER BY c DESC) AS n FROM s)
    SELECT vec_id, round((avg(c) FILTER (WHERE parity = 0 AND n <= 5) - avg(c) FILTER (WHERE parity = 1 AND n <= 5) + 1) / 2, 6) AS margin, round(max(c) FILTER (WHERE parity = 0), 6) AS nearest,
      round(max(c) - avg(c), 6) AS contrast FROM r GROUP BY vec_id""")
def fusion_vector_margins(spark, sf):
    """Margins, nearest anchors and contrast of stored vectors against two small banks, which are one row."""
    v, x = F.col("embedding"), table(spark, sf, "embeddings", "vec_id", "embedding").crossJoin(F.broadcast(_banks(spark, sf)))
    every = fusion.profile(F.concat(fusion.similarities(v, F.col("attacks")), fusion.similarities(v, F.col("benign"))))
    return x.select("vec_id", F.round(fusion.margin(v, F.col("attacks"), F.col("benign")), 6).alias("margin"), F.round(fusion.max_similarity(v, F.col("attacks")), 6).alias("nearest"), F.round(every["contrast"], 6).alias("contrast"))


def _quantile_sql(x, knots, levels):
    return f"list_extract({levels}, least(len(list_filter({knots}, lambda k: k < {x})) + 1, {len(LEVELS)}))"


@query(f"""
    WITH {EV}, t AS (SELECT event_id, score AS a, floor((1 - score) * (event_id % 10)) / 10 AS b FROM ev),
    u AS (SELECT event_id, a, b, ({_quantile_sql('a', KNOTS, LEVELS)} + {_quantile_sql('b', OTHER, LEVELS)}) / 2 AS u FROM t)
    SELECT event_id, round(a * b + 1e-9::DOUBLE, 6) AS agreement, CAST({_quantile_sql('b', OTHER, LEVELS)} AS DOUBLE) AS quantile, CAST(CASE WHEN event_id % 7 = 0 THEN a ELSE {_quantile_sql('u', LEVELS, KNOTS)} END AS DOUBLE) AS ensemble,
      round(CASE WHEN a <= 0.6 THEN a / 0.6 * 0.5494 ELSE 0.5494 + (a - 0.6) / 0.4 * 0.4 END + 1e-9::DOUBLE, 6) AS mapped FROM u""")
def fusion_model_tier(spark, sf):
    """Two models' scores combined by product and by quantiles; every seventh row lacks the second model."""
    s = events(spark, sf).select("event_id", F.col("score").alias("a"), (F.floor((1 - F.col("score")) * (F.col("event_id") % 10)) / 10).alias("b"))
    knots, other, levels = map(_doubles, (KNOTS, OTHER, LEVELS))
    second = F.when(F.col("event_id") % 7 != 0, F.col("b"))
    return s.select(
        "event_id",
        F.round(fusion.model_tier(F.col("a"), F.col("b"), "agreement") + 1e-9, 6).alias("agreement"),
        fusion.to_quantile(F.col("b"), other, levels).alias("quantile"),
        fusion.model_tier(F.col("a"), second, "ensemble", knots, other, levels).alias("ensemble"),
        F.round(fusion.onto_axis(F.col("a"), 0.6, 0.5494, 0.9494) + 1e-9, 6).alias("mapped")  # halves go up,
    )


_TIERS_SQL = "t AS (SELECT event_id, score AS s, CASE WHEN event_id % 11 = 0 THEN 0.92 ELSE 0 END AS rule, CASE WHEN event_id % 11 <> 0 THEN score END AS semantic, CASE WHEN event_id % 11 <> 0 AND event_id % 2 = 0 THEN 1 - score END AS model, CASE WHEN score > 0.3 AND score <= 0.75 AND event_id % 11 <> 0 THEN score * score END AS judge FROM ev)"


def _tiers(spark, sf):
    s, i = F.col("score"), F.col("event_id")
    ran = i % 11 != 0
    return events(spark, sf).select(
        "event_id",
        F.when(~ran, 0.92).otherwise(0.0).alias("rule"),
        F.when(ran, s).alias("semantic"),
        F.when(ran & (i % 2 == 0), 1 - s).alias("model"),
        F.when(ran & (s > 0.3) & (s <= 0.75), s * s).alias("judge"),
    )


def _term_sql(k):
    return f"coalesce(greatest(-6.0, least(6.0, {LINES[k][0]} + {LINES[k][1]}::DOUBLE * {k} - ({PRIOR}::DOUBLE))), 0)"


@query(f"""
    WITH {EV}, {_TIERS_SQL}, f AS (SELECT *, CASE WHEN rule > 0 THEN 0.92 ELSE greatest(0, semantic, model, judge) END AS fused, {' + '.join(map(_term_sql, LINES))} AS total FROM t)
    SELECT event_id, round(fused + 1e-9::DOUBLE, 6) AS fused, CASE WHEN fused > 0.75 THEN 'INJECTION' WHEN fused > 0.30 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS class,
      array_to_string(list_filter(['rule', CASE WHEN semantic IS NOT NULL THEN 'semantic' END, CASE WHEN model IS NOT NULL THEN 'model' END, CASE WHEN judge IS NOT NULL THEN 'judge' END], lambda x: x IS NOT NULL), '+') AS ran,
      round(1 / (1 + exp(-greatest(-30.0, least(30.0, total)))), 6) AS probability,
      round(CASE WHEN semantic IS NOT NULL AND model IS NULL AND judge IS NULL THEN -0.2 + greatest(-6.0, least(6.0, -2.0 + 4.0::DOUBLE * semantic + 0.2)) ELSE total END + 1e-9::DOUBLE, 6) AS by_pattern FROM f""")
def fusion_tiers(spark, sf):
    """Tiers of a prompt fused by their largest, by summed evidence and by a model of the pattern of tiers that ran."""
    t = _tiers(spark, sf)
    tiers = {k: F.col(k) for k in LINES}
    fused, total = fusion.max_fusion(*tiers.values()), fusion.evidence_sum(tiers, LINES, PRIOR)
    pattern = fusion.by_pattern(tiers, {("rule", "semantic"): (-0.2, {"semantic": LINES["semantic"]})}, total)
    return t.select("event_id", F.round(fused + 1e-9, 6).alias("fused"), fusion.l1_class(fused).alias("class"), F.array_join(fusion.availability(tiers), "+").alias("ran"), F.round(fusion.unit(total), 6).alias("probability"), F.round(pattern + 1e-9, 6).alias("by_pattern"))


_LAYERS = ("L1", "L2", "L3", "L4", "L5")
_WIDE_SQL = "w AS (SELECT session, label, " + ", ".join(f"max(score) FILTER (WHERE layer = '{k}') AS {k}" for k in _LAYERS) + " FROM ev GROUP BY session, label)"


def wide(spark, sf, f=F.max):
    """A row a session: each layer's score, null without events."""
    return events(spark, sf).groupBy("session", "label").agg(*[f(F.when(F.col("layer") == k, F.col("score"))).alias(k) for k in _LAYERS])


_Z_SQL = " + ".join(f"{c}::DOUBLE * (coalesce({k}, 0) - {m}::DOUBLE) / {s}::DOUBLE" for k, c, m, s in zip(_LAYERS, COEF, MEAN, SCALE))


@query(f"""
    WITH {EV}, w AS (SELECT session, label, {', '.join(f"avg(score) FILTER (WHERE layer = '{k}') AS {k}" for k in _LAYERS)} FROM ev GROUP BY session, label), p AS (SELECT *, 1 / (1 + exp(-({_Z_SQL} - 1.2))) AS p FROM w),
    v AS (SELECT *, list_max([{', '.join(f'coalesce({k}, -1)' for k in _LAYERS)}]) AS top FROM p)
    SELECT session, round(p, 6) AS p, CASE WHEN p >= 0.9 THEN 'BLOCK' WHEN p >= 0.4 THEN 'WARN' END AS fused, round(greatest(0, top), 6) AS score,
      CASE {' '.join(f"WHEN {k} = top THEN '{k}'" for k in _LAYERS)} ELSE 'L1' END AS dominant, CASE WHEN top >= .85 THEN 'BLOCKED' WHEN top >= .5 THEN 'WARNED' ELSE 'ALLOWED' END AS action FROM v""")
def fusion_layers(spark, sf):
    """A logistic model over the layers' mean scores, and the verdict by the largest with its dominant layer."""
    w = wide(spark, sf, F.avg)
    p = fusion.logistic_fusion([F.col(k) for k in _LAYERS], MEAN, SCALE, COEF, -1.2)
    v = fusion.input_verdict({k: F.col(k) for k in _LAYERS})
    return w.select("session", F.round(p, 6).alias("p"), fusion.fusion_action(p, 0.4, 0.9).alias("fused"), F.round(v["score"], 6).alias("score"), v["dominant"].alias("dominant"), v["action"].alias("action"))


@query(f"""
    WITH {EV}, d AS (SELECT event_id, score, CASE WHEN event_id % 4 = 0 THEN 'code' WHEN event_id % 900 < 600 THEN 'short' ELSE 'prose' END AS kind, (event_id % 5) / 4 AS danger FROM ev),
    t AS (SELECT *, CASE WHEN kind = 'short' THEN 1 - (1 - score) * (1 - danger) ELSE 1 - (1 - score * (1 + score / 2) / 2) * (1 - danger) END AS threat,
      CASE kind WHEN 'prose' THEN 0.019682 WHEN 'code' THEN 0.632877 ELSE 0.999712 END::DOUBLE AS warn, CASE kind WHEN 'prose' THEN 0.553796 WHEN 'code' THEN 0.697139 ELSE 0.999933 END::DOUBLE AS block FROM d),
    s AS (SELECT *, CASE WHEN threat <= 0 THEN 0 WHEN threat <= warn THEN threat / warn * .5 WHEN threat <= block THEN .5 + (threat - warn) / (block - warn) * .35 ELSE .85 + (threat - block) END AS shared FROM t)
    SELECT event_id, kind, round(threat + 1e-9::DOUBLE, 6) AS threat, round(shared + 1e-9::DOUBLE, 6) AS shared, CASE WHEN shared >= .85 THEN 'QUARANTINED' WHEN shared >= .5 THEN 'FLAGGED' ELSE 'ALLOWED' END AS verdict FROM s""")
def fusion_document_threat(spark, sf):
    """Threat of documents by kind, on the shared axis by the kind's own anchors, and the verdict on ingest."""
    i, s = F.col("event_id"), F.col("score")
    kind = fusion.document_kind(F.when(i % 4 == 0, "code").otherwise("prose"), i % 900)
    danger = (i % 5) / 4
    threat = F.when(kind == "short", fusion.short_threat(s, danger)).otherwise(fusion.document_threat(1 - s, s / 2, danger))
    d = events(spark, sf).select("event_id", kind.alias("kind"), threat.alias("threat"))
    d = d.withColumn("shared", fusion.on_shared_axis(F.col("threat"), fusion.anchor(F.col("kind"), 0), fusion.anchor(F.col("kind"), 1)))
    verdict = fusion.ingest_verdict(F.col("shared") >= 0.85, F.col("shared") >= 0.5)
    return d.select("event_id", "kind", F.round(F.col("threat") + 1e-9, 6).alias("threat"), F.round(F.col("shared") + 1e-9, 6).alias("shared"), verdict.alias("verdict"))


@query(f"""
    WITH {EV}, p AS (SELECT event_id, session, score, lag(score) OVER (PARTITION BY session ORDER BY event_id) AS b FROM ev),
    r AS (SELECT event_id, session, max(CASE WHEN b IS NULL THEN 0 ELSE 1 - abs(score - b) END) OVER w AS smooth, max(score * score) OVER w AS harm, avg(score / 2) OVER w AS esc FROM p WINDOW w AS (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT event_id, round((len(list_filter({KNOTS}, lambda k: k <= smooth)) + len(list_filter({OTHER}, lambda k: k <= harm)) + len(list_filter({LEVELS}, lambda k: k <= esc))) / 12, 6) AS fused FROM r""")
def fusion_conversation_ranks(spark, sf):
    """Running smoothness, harm and escalation of a session as shares of reference values, averaged."""
    w = Window.partitionBy("session").orderBy("event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = events(spark, sf).withColumn("b", F.lag("score").over(w))
    smooth = F.max(F.when(F.col("b").isNull(), 0.0).otherwise(1 - F.abs(F.col("score") - F.col("b")))).over(upto)
    s = s.select("event_id", smooth.alias("smooth"), F.max(F.col("score") * F.col("score")).over(upto).alias("harm"), F.avg(F.col("score") / 2).over(upto).alias("esc"))
    return s.select("event_id", F.round(fusion.rank_fusion([F.col("smooth"), F.col("harm"), F.col("esc")], [_doubles(KNOTS), _doubles(OTHER), _doubles(LEVELS)]), 6).alias("fused"))


_TAU = {"L1": 0.5, "L2": 0.4, "L3": 0.6}


@query(f"""
    WITH {EV}, x AS (SELECT event_id, layer, score, CASE layer WHEN 'L1' THEN 0.5 WHEN 'L2' THEN 0.4 ELSE 0.6 END::DOUBLE AS tau FROM ev WHERE layer IN ('L1', 'L2', 'L3'))
    SELECT event_id, CASE WHEN layer = 'L3' THEN CASE WHEN score >= tau THEN 1.0 ELSE 0.0 END
      ELSE greatest(-1, least(1, round_even(CASE WHEN score > tau THEN (score - tau) / (1 - tau) ELSE (score - tau) / tau END, 1))) END AS exported FROM x""")
def fusion_exported_scores(spark, sf):
    """Scores in tenths around their threshold, halves to even, and of one layer the verdict alone."""
    e = events(spark, sf).where(F.col("layer").isin(*_TAU))
    return e.select("event_id", fusion.exported(F.col("layer"), F.col("score"), _TAU, ("L3",)).alias("exported"))
