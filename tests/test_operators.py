"""Statistics, evidence, sessions and mining on small tables."""

from __future__ import annotations

import math
import random

import pytest

from screenlake.operators import evidence, mining, sessions, statistics


def test_conformal_thresholds(spark):
    rows = [("a", i / 100) for i in range(19)] + [("b", i / 100) for i in range(18)] + [("c", 0.5)] * 100
    got = {r.g: (r.n, r.tau) for r in statistics.conformal_thresholds(spark.createDataFrame(rows, "g string, s double"), "g", "s", 0.05).collect()}
    assert got == {"a": (19, 0.18), "b": (18, math.inf), "c": (100, 0.5)}


def test_order_statistic_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(statistics, "WHOLE_GROUP", 10)
    rng = random.Random(2)
    scores = [rng.random() for _ in range(3000)]
    df = spark.createDataFrame([("x", s) for s in scores], "g string, s double")
    assert statistics.conformal_thresholds(df, "g", "s", 0.05).first().tau == sorted(scores)[math.ceil(3001 * 0.95) - 1]


def test_rank_statistics(spark):
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5)], "y int, s double")
    assert statistics.auroc(ties, "y", "s").first().auroc == 0.5
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    df = spark.createDataFrame(rows, "y int, s double")
    assert statistics.auroc(df, "y", "s").first().auroc == pytest.approx(want)
    roc = {r.threshold: (r.tpr, r.fpr) for r in statistics.roc(df, "y", "s").collect()}
    assert all(roc[t] == pytest.approx((sum(p >= t for p in pos) / len(pos), sum(n >= t for n in neg) / len(neg))) for t in roc)
    last = spark.createDataFrame([(1, 1.0), (0, 0.95)], "y int, s double")
    assert {r.bin: r.n for r in statistics.calibration_bins(last, "y", "s").collect()} == {9: 2}


def test_bootstrap_repeats_and_covers(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(2000)], "k int, v double")
    a, b = (statistics.bootstrap_mean(df, "k", "v").first() for _ in range(2))
    assert a == b and a.low < 4.5 < a.high and a.high - a.low < 0.6


def test_weighted_quantile_and_mcnemar(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 1.0), (0, 3.0, 8.0)], "g int, v double, w double")
    assert [statistics.weighted_quantile(df, "g", "v", "w", q).first().quantile for q in (0.1, 0.2, 0.21)] == [1.0, 2.0, 3.0]
    pairs = spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 2 + [(True, True)] * 5, "a boolean, b boolean")
    assert statistics.mcnemar(pairs, "a", "b").first().chi2 == pytest.approx(2.5)


def test_evidence(spark):
    benign = spark.createDataFrame([(i / 100,) for i in range(99)], "s double")
    scores = spark.createDataFrame([(1, 2.0), (2, 0.5), (3, 0.5)], "k int, s double")
    got = {r.k: r.p for r in evidence.pvalues(scores, benign, "s", "k").collect()}
    assert got == pytest.approx({1: 0.01, 2: 0.5, 3: 0.5})
    e = spark.createDataFrame([(0, t, x) for t, x in enumerate((1.2, 0.7, 3.0, 2.0))], "g int, t int, e double")
    got = [r.mixture for r in evidence.mixture(e, "g", "t", "e").orderBy("t").collect()]
    want = [sum(math.prod([1.2, 0.7, 3.0, 2.0][tau : t + 1]) / ((tau + 1) * (tau + 2)) for tau in range(t + 1)) for t in range(4)]
    assert got == pytest.approx(want) and got[0] == pytest.approx(0.6)
    crossed = evidence.first_crossing(evidence.wealth(e, "g", "t", "e"), "g", "t", "log_wealth", 0.25).first()
    assert crossed["first"] == 3
    runs = [(1, t, x) for t, x in enumerate((2.0, 2.0, -9.0))] + [(2, t, x) for t, x in enumerate((0.1, -0.2))]
    got = {r.g: (r.verdict, r.consulted, r.crossed) for r in evidence.sprt(spark.createDataFrame(runs, "g int, t int, x double"), "g", "t", "x", 0.05, 0.05).collect()}
    assert got == {1: ("malicious", 2, True), 2: ("benign", 2, False)}


def test_correlation_rules(spark):
    rows = [(1, 0, "L3", 0.7), (1, 1, "L1", 0.9), (2, 0, "L1", 0.31), (2, 1, "L3", 0.71), (2, 2, "L3", 0.9), (2, 3, "L5", 0.6), (3, 0, "L2", 0.8), (3, 1, "L4", 0.9)]
    out = sessions.correlate(spark.createDataFrame(rows, "g int, t int, layer string, s double"), "g", "t", "layer", "s").collect()
    got = {(r["g"], r["rule"]): (r["first"], round(r["rule_score"], 6)) for r in out}
    assert got == {(2, "SLOW_BURN"): (1, 0.81), (2, "LEAK_AFTER_ATTACK"): (3, 0.98), (3, "POISONED_CONTEXT"): (1, 0.97)}


def test_taint(spark):
    nodes = spark.createDataFrame([("a", 0.58), ("b", 1.0), ("c", 1.0)], "node string, own double")
    edges = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 1.0)], "u string, v string, w double")
    got = {r.node: r.effective for r in sessions.propagate(nodes, edges).collect()}
    assert got == pytest.approx({"a": 0.58, "b": 0.601, "c": 0.601})
    with pytest.raises(ValueError):
        sessions.propagate(nodes, edges.unionAll(spark.createDataFrame([("c", "a", 0.9)], edges.schema)), 4)


def test_patterns(spark):
    seqs = spark.createDataFrame([(1, list("abc")), (2, list("acb")), (3, list("aab"))], "s int, items array<string>")
    got = {(r.pattern, r.support) for r in mining.frequent_patterns(seqs, "s", "items", 0.9, 3).collect()}
    assert got == {("a", 3), ("b", 3), ("a > b", 3)}
    bad = mining.frequent_patterns(seqs, "s", "items", 0.3, 2)
    good = mining.frequent_patterns(spark.createDataFrame([(1, list("b"))], "s int, items array<string>"), "s", "items", 0.5, 2)
    assert "b" not in {r.pattern for r in mining.discriminative(bad, good, 3, 1).collect()}
