"""Scores on the shared axis: severity, action, rescaling, evidence, decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shared axis's thresholds.
WARN, BLOCK = 0.50, 0.85


def severity(s: Column) -> Column:
    return F.when(s >= 0.85, "CRITICAL").when(s >= 0.65, "HIGH").when(s >= 0.40, "MEDIUM").when(s >= 0.20, "LOW").when(s.isNotNull(), "CLEAN")


def action(s: Column, warn: float = WARN, block: float = BLOCK) -> Column:
    return F.when(s >= block, "BLOCKED").when(s >= warn, "WARNED").when(s.isNotNull(), "ALLOWED")


def rescale(s: Column, warn: float, block: float, to_warn: float = WARN, to_block: float = BLOCK) -> Column:
    """Piecewise linear, a layer's anchors to the shared ones; keeps rising above the upper one. Null stays null."""
    return (
        F.when(s <= 0, 0.0)
        .when(s <= warn, s / warn * to_warn)
        .when(s <= block, to_warn + (s - warn) / (block - warn) * (to_block - to_warn))
        .otherwise(to_block + (s - block))
    )


def unscale(s: Column, warn: float, block: float, to_warn: float = WARN, to_block: float = BLOCK) -> Column:
    return (
        F.when(s <= 0, 0.0)
        .when(s <= to_warn, s / to_warn * warn)
        .when(s <= to_block, warn + (s - to_warn) / (to_block - to_warn) * (block - warn))
        .otherwise(block + (s - to_block))
    )


def saturating(n: Column) -> Column:
    return -F.expm1(-n)


def noisy_or(terms: Column, most: float = 6.0) -> Column:
    """Of an array of probabilities; each adds ``most`` at most, nulls nothing; rounded to nine places."""
    total = F.aggregate(terms, F.lit(0.0), lambda a, v: a + F.coalesce(F.when(v >= 1, F.lit(most)).otherwise(F.least(F.lit(most), -F.log1p(-F.greatest(v, F.lit(0.0))))), F.lit(0.0)))
    return F.round(-F.expm1(-total), 9)


def decision(scores: Column, block_rule: Column, warn_rule: Column, corroborate: int = 1) -> Column:
    """BLOCK, WARN or ALLOW from a map of layer scores; layers of one prefix of two characters corroborate once."""
    top = F.coalesce(F.array_max(F.map_values(scores)), F.lit(0.0))
    warned = F.size(F.array_distinct(F.transform(F.filter(F.map_entries(scores), lambda e: e["value"] >= WARN), lambda e: F.substring(e["key"], 1, 2))))
    return F.when(block_rule | (top >= BLOCK), "BLOCK").when(warn_rule | ((top >= WARN) & (warned >= corroborate)), "WARN").otherwise("ALLOW")


def document_trust(density: Column, injection: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (0.6 * density + 0.4 * injection)))


def trust_route(trust: Column) -> Column:
    return F.when(trust < 0.40, "quarantine").when(trust < 0.713, "review").otherwise("trusted")


def conversation_score(harm: Column, drift: Column, velocity: Column, escalation: Column) -> Column:
    s = 0.5 * harm + 0.25 * (drift * F.greatest(F.lit(0.0), 1 - velocity)) + F.when(escalation > 0.45, 0.25).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))
