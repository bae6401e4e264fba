"""Algebra over scores that models left in columns: margins, quantile axes, fusion of tiers and layers, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import axis
from .vectors import cosine

# Warn and block anchors by kind of document; below how many characters a document is short.
DOCUMENT_ANCHORS = {"prose": (0.019682, 0.553796), "code": (0.632877, 0.697139), "short": (0.999712, 0.999933), "legacy": (0.372876, 0.600)}
SHORT_DOCUMENT = 600
# An early rule's score, the clamp of a tier's evidence and of a logit.
RULE_SCORE, MOST_EVIDENCE, MOST_LOGIT = 0.92, 6.0, 60.0


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def sigmoid(z: Column, most: float = MOST_LOGIT) -> Column:
    return 1 / (1 + F.exp(-clamp(z, -most, most)))


# vectors against banks of vectors (small literal or broadcast arrays of vectors)


def similarities(v: Column, bank: Column) -> Column:
    return F.transform(bank, lambda b: cosine(v, b))


def max_similarity(v: Column, bank: Column) -> Column:
    return F.array_max(similarities(v, bank))


def margin(v: Column, attacks: Column, benign: Column, k: int = 5) -> Column:
    """Mean of the k nearest attacks less mean of the k nearest benign vectors, from [-1, 1] to [0, 1]."""
    top = lambda bank: F.slice(F.reverse(F.array_sort(similarities(v, bank))), 1, k)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    return (mean(top(attacks)) - mean(top(benign)) + 1) / 2


def profile(scores: Column) -> Column:
    """struct of a text's windows' largest and mean score, and their contrast."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return F.struct(F.array_max(scores).alias("most"), mean.alias("mean"), (F.array_max(scores) - mean).alias("contrast"))


def density(scores: Column, many: int = 15, share: float = 0.1, over: float = 0.5, cut: float = 0.85) -> Column:
    """The largest window score; of long texts with few windows over ``over``, a part of it."""
    few = F.size(F.filter(scores, lambda s: s > over)) / F.size(scores) < share
    return F.array_max(scores) * F.when((F.size(scores) > many) & few, cut).otherwise(1.0)


# quantile axes: knots and their levels are ascending arrays of equal length


def to_quantile(x: Column, knots: Column, levels: Column) -> Column:
    """The level of the first knot that isn't below x; the last level beyond all."""
    at = F.size(F.filter(knots, lambda k: k < x))
    return F.get(levels, F.least(at, F.size(levels) - 1))


def from_quantile(u: Column, knots: Column, levels: Column) -> Column:
    return to_quantile(u, levels, knots)


def model_tier(first: Column, second: Column, mode: str, knots: Column | None = None, other_knots: Column | None = None, levels: Column | None = None) -> Column:
    """The model tier on the first model's axis: first, agreement (product), second or ensemble (by quantiles).

    Without the second model's score the first one's stands.
    """
    if mode == "first":
        return first
    if mode == "agreement":
        return F.coalesce(first * second, first)
    u = to_quantile(second, other_knots, levels)
    if mode == "ensemble":
        u = (to_quantile(first, knots, levels) + u) / 2
    return F.when(second.isNull(), first).otherwise(from_quantile(u, knots, levels))


def reference_share(x: Column, reference: Column) -> Column:
    """Share of a reference at or below x."""
    return F.size(F.filter(reference, lambda r: r <= x)) / F.size(reference)


def rank_fusion(values: list[Column], references: list[Column]) -> Column:
    shares = [reference_share(x, r) for x, r in zip(values, references)]
    return sum(shares[1:], shares[0]) / len(shares)


def onto_axis(s: Column, tau: float, warn: float, top: float) -> Column:
    """0 to 0, tau to warn, 1 to top, straight between; a tau outside (0, 1) makes a step."""
    s = clamp(s)
    if not 0 < tau < 1:
        return F.when(s >= tau, warn).otherwise(0.0)
    return F.when(s <= tau, s / tau * warn).otherwise(warn + (s - tau) / (1.0 - tau) * (top - warn))


def onto_bin(a: Column, a_warn: Column, a_block: Column, b_warn: Column, b_block: Column) -> Column:
    """From one pair of anchors to another: straight below warn, between the anchors, and from block to 1."""
    below, between = a / a_warn * b_warn, b_warn + (a - a_warn) / (a_block - a_warn) * (b_block - b_warn)
    above = b_block + (a - a_block) / F.greatest(F.lit(1e-9), 1 - a_block) * (1 - b_block)
    return clamp(F.when(a <= a_warn, below).when(a <= a_block, between).otherwise(above))


def probe(v: Column, mean: list[float], scale: list[float], weights: list[float], intercept: float) -> Column:
    """Probability of a linear probe over a standardised vector."""
    arrays = [F.array(*map(F.lit, map(float, x))) for x in (mean, scale, weights)]
    terms = F.transform(F.arrays_zip(v.alias("x"), arrays[0].alias("m"), arrays[1].alias("s"), arrays[2].alias("w")), lambda t: (t["x"] - t["m"]) / t["s"] * t["w"])
    return sigmoid(F.aggregate(terms, F.lit(float(intercept)), lambda a, x: a + x), 500.0)


def probe_z(p: Column, mean: float, spread: float) -> Column:
    """A probe's log-odds on a standard scale, away from 0 and 1 by 1e-7."""
    q = clamp(p, 1e-7, 1 - 1e-7)
    return (F.log(q / (1 - q)) - mean) / spread


def judge_score(raw: Column) -> Column:
    """A judge's answer as a number in [0, 1], if it is nothing but a number; else null."""
    x = F.trim(raw).try_cast("double") if hasattr(Column, "try_cast") else F.trim(raw).cast("double")
    return F.when(F.trim(raw).rlike(r"^\d*\.?\d+$") & x.between(0.0, 1.0), x)


def wait_seconds(value: Column) -> Column:
    """Seconds of a text such as 3h8m38.4s or 250ms; a bare number counts as seconds; null if it is neither."""
    part = lambda unit: F.coalesce(F.regexp_extract(value, rf"(\d+(?:\.\d+)?){unit}", 1).try_cast("double"), F.lit(0.0))
    whole = part("h(?![a-z])") * 3600 + part("m(?![a-z])") * 60 + part("(?<!m)s(?![a-z])") + part("ms(?![a-z])") / 1000
    return F.when(value.rlike(r"^\d+(?:\.\d+)?$"), value.try_cast("double")).when(value.rlike(r"^(?:\d+(?:\.\d+)?(?:h|ms|m|s))+$"), whole)


# tiers of a prompt: nullable columns; null means that the tier did not run


def max_fusion(rule: Column, semantic: Column, model: Column, judge: Column) -> Column:
    """An early rule's fixed score, else the largest of the tiers that ran."""
    return F.when(F.coalesce(rule, F.lit(0.0)) > 0, RULE_SCORE).otherwise(F.greatest(F.lit(0.0), semantic, model, judge))


def availability(tiers: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(name)) for name, c in tiers.items()]))


def evidence_sum(tiers: dict[str, Column], lines: dict[str, tuple[float, float]], prior: float) -> Column:
    """Sum over the tiers that ran of their calibrated log-odds (intercept, slope) less the prior, each within +-6."""
    terms = [F.coalesce(clamp(lines[k][0] + lines[k][1] * c - prior, -MOST_EVIDENCE, MOST_EVIDENCE), F.lit(0.0)) for k, c in tiers.items() if k in lines]
    return sum(terms[1:], terms[0])


def by_pattern(tiers: dict[str, Column], models: dict[tuple[str, ...], tuple[float, dict[str, tuple[float, float]]]], fallback: Column) -> Column:
    """evidence_sum with the base rate and lines of the pattern of tiers that ran; a pattern without a model falls back."""
    out = fallback
    for pattern, (base, lines) in models.items():
        here = F.lit(True)
        for k, c in tiers.items():
            here = here & (c.isNotNull() if k in pattern else c.isNull())
        total = base + evidence_sum({k: tiers[k] for k in pattern}, lines, base) if lines else F.lit(base)
        out = F.when(here, total).otherwise(out)
    return out


def unit(log_ratio: Column) -> Column:
    return sigmoid(log_ratio, 30.0)


def l1_class(score: Column) -> Column:
    """Bands of the raw axis."""
    return F.when(score > 0.75, "INJECTION").when(score > 0.30, "SUSPICIOUS").otherwise("CLEAN")


def stack_verdict(fired: Column, hard: Column, first: Column, second: Column, tuned: Column, tau: float, band: float) -> Column:
    """A stack of calibrated scores over a first decision: a hard rule keeps it, a tuned score over tau lifts, one under the
    band leaves it, and between them the largest decides. Null scores did not run."""
    most = F.greatest(first, second, tuned)
    return F.when(hard, fired).when(tuned > tau, True).when(tuned.isNull() | (tuned < band), fired).otherwise(F.coalesce(most > tau, fired))


# layers of a session on the shared axis


def logistic_fusion(features: list[Column], mean: list[float], scale: list[float], weights: list[float], intercept: float) -> Column:
    """Probability by a standardised logistic model; a missing feature counts as 0 before standardising."""
    terms = [w * (F.coalesce(x, F.lit(0.0)) - m) / (s or 1.0) for x, m, s, w in zip(features, mean, scale, weights)]
    return sigmoid(sum(terms, F.lit(float(intercept))))


def fusion_action(p: Column, tau_warn: float, tau_block: float | None = None) -> Column:
    out = F.when(p >= tau_warn, "WARN")
    return out if tau_block is None else F.when(p >= tau_block, "BLOCK").otherwise(out)


def document_kind(content_type: Column, n_chars: Column) -> Column:
    """Which anchors judge a document."""
    return F.when(content_type == "code", "code").when(n_chars < SHORT_DOCUMENT, "short").otherwise("prose")


def anchor(kind: Column, which: int) -> Column:
    out = F.lit(DOCUMENT_ANCHORS["legacy"][which])
    for name, pair in DOCUMENT_ANCHORS.items():
        out = F.when(kind == name, F.lit(pair[which])).otherwise(out)
    return out


def document_threat(benign: Column, contrast: Column, danger: Column) -> Column:
    """1 - (1 - (1 - P(benign)) (1 + contrast) / 2) (1 - danger)."""
    return 1 - (1 - (1 - benign) * (1 + contrast) / 2) * (1 - danger)


def short_threat(injection: Column, danger: Column) -> Column:
    return 1 - (1 - injection) * (1 - danger)


def on_shared_axis(raw: Column, warn: Column, block: Column) -> Column:
    """rescale() with anchors by row."""
    return F.when(raw <= 0, 0.0).when(raw <= warn, raw / warn * 0.5).when(raw <= block, 0.5 + (raw - warn) / (block - warn) * 0.35).otherwise(0.85 + (raw - block))


def harm_shared(harm: Column, tau: float) -> Column:
    """The harm head: its anchor at WARN, never at BLOCK; 0 without a score."""
    return F.coalesce(onto_axis(harm, tau, 0.5, 0.85 - 1e-6), F.lit(0.0))


def input_verdict(scores: dict[str, Column]) -> Column:
    """struct<score, severity, action, dominant>: the largest of the layers that ran; the first in order wins a tie."""
    ranked = F.array(*[F.struct(F.coalesce(c, F.lit(-1.0)).alias("s"), F.lit(-i).alias("i"), F.lit(k[:2]).alias("k")) for i, (k, c) in enumerate(scores.items())])
    top = F.array_max(ranked)
    score = F.greatest(F.lit(0.0), top["s"])
    return F.struct(score.alias("score"), axis.severity(score).alias("severity"), axis.action(score).alias("action"), top["k"].alias("dominant"))


def ingest_verdict(quarantined: Column, review: Column) -> Column:
    return F.when(quarantined, "QUARANTINED").when(review, "FLAGGED").otherwise("ALLOWED")


def call_verdict(executes: Column, score: Column, warn: float = 0.80) -> Column:
    return F.when(~executes, "BLOCKED").when(score >= warn, "WARNED").otherwise("ALLOWED")


def one_decimal(score: Column, threshold: float) -> Column:
    """A score's distance from its threshold on [-1, 1] in tenths, halves to even, as some guards export it.

    The tenfold is rounded as the double it is: bround goes by the shortest decimals, to which 0.8500000000000001 is no half.
    """
    far = F.when(score > threshold, (score - threshold) / (1 - threshold)).otherwise((score - threshold) / threshold)
    return clamp(F.rint(far * 10) / 10, -1.0, 1.0)


def exported(layer: Column, score: Column, thresholds: dict[str, float], verdict_only: tuple[str, ...]) -> Column:
    """What each layer exports: tenths, or of those with a verdict only, 0 or 1."""
    out = F.lit(None).cast("double")
    for k, tau in thresholds.items():
        out = F.when(layer == k, (score >= tau).cast("double") if k in verdict_only else one_decimal(score, tau)).otherwise(out)
    return out
