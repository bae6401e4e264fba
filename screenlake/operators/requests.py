"""From a prompt to a verdict: rules over views of a text, tiers, the layers of a session, rules across layers, decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import axis, decode, fusion, hidden, patterns

# What a rule across layers does.
RULE_ACTIONS = {"SLOW_BURN": "BLOCKED", "POISONED_CONTEXT": "BLOCKED", "LEAK_AFTER_ATTACK": "BLOCKED", "LOW_TRUST_PATH": "WARNED"}
LOW_TRUST = 0.75


def prompt_views(c: Column) -> Column:
    """struct of a text's views: folded, and folded after all hiding is undone."""
    return F.struct(hidden.canonicalize(c).alias("folded"), hidden.canonicalize_hidden(c).alias("plain"))


def rule_verdict(c: Column, views: Column, decoded: Column) -> Column:
    """struct<score, class, reason> by rules alone, decoded spans before the text itself; null where no rule fires."""
    inner = F.filter(decoded, lambda v: (F.size(patterns.hits(v, patterns.INJECTION)) > 0) | (F.size(patterns.spoof_markers(v)) > 0))
    reason = patterns.injection_reason(c, views["folded"], views["plain"])
    out = lambda kind, why: F.struct(F.lit(fusion.RULE_SCORE).alias("score"), F.lit(kind).alias("class"), why.alias("reason"))
    return F.when(F.size(inner) > 0, out("OBFUSCATED_INJECTION", F.lit("decoded text"))).when(reason.isNotNull(), out("INJECTION", reason))


def prompt_verdict(df: DataFrame, text: str, semantic: Column, model: Column) -> DataFrame:
    """df with l1: struct<score, class, reason, tiers>. semantic and model are scores, null where they did not run."""
    v = df.withColumn("views", prompt_views(F.col(text))).withColumn("decoded", decode.decoded_views(F.col(text)))
    v = v.withColumn("rule", rule_verdict(F.col(text), F.col("views"), F.col("decoded"))).drop("views", "decoded")
    ran = F.col("rule").isNull()
    tiers = F.struct(F.coalesce("rule.score", F.lit(0.0)).alias("rule"), F.when(ran, semantic).alias("semantic"), F.when(ran, model).alias("model"), F.lit(None).cast("double").alias("judge"))
    v = v.withColumn("tiers", tiers)
    score = fusion.max_fusion(*[F.col(f"tiers.{k}") for k in ("rule", "semantic", "model", "judge")])
    l1 = F.struct(score.alias("score"), F.coalesce("rule.class", fusion.l1_class(score)).alias("class"), F.col("rule.reason").alias("reason"), F.col("tiers").alias("tiers"))
    return v.withColumn("l1", l1).drop("rule", "tiers")


def prompt_decision(score: Column, warn: float = 0.5494, block: float = 0.85) -> Column:
    return axis.action(axis.rescale(score, warn, block))


def unseen_turns(turns: DataFrame, seen: DataFrame, most: int = 8) -> DataFrame:
    """Of turns (session, turn, digest) the latest ``most`` whose digest was not scanned yet in the session."""
    fresh = turns.join(seen.select("session", "digest").distinct(), ["session", "digest"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("turn")))
    return fresh.withColumn("k", rank).where(F.col("k") <= most).drop("k")


def rules(l1: Column, l2_flagged: Column, l3: Column, l4_hijack: Column, l5: Column, least_trust: Column, disabled: tuple[str, ...] = ()) -> Column:
    """array<struct<rule, score>> of the rules that fire for a session, each once.

    Missing layers fire nothing; least_trust is the lowest trust that reaches an action of high impact.
    """
    l1, l3, l5 = (F.coalesce(x, F.lit(0.0)) for x in (l1, l3, l5))
    fired = {
        "SLOW_BURN": ((l3 > 0.7) & (l1 > 0.3), F.least(F.lit(1.0), F.greatest(l3, l1) + 0.1)),
        "POISONED_CONTEXT": (F.coalesce(l2_flagged & l4_hijack, F.lit(False)), F.lit(0.97)),
        "LEAK_AFTER_ATTACK": (((l1 > 0.5) | (l3 > 0.7)) & (l5 > 0.5), F.lit(0.98)),
        "LOW_TRUST_PATH": (F.coalesce(least_trust < LOW_TRUST, F.lit(False)), F.least(F.lit(1.0), 1 - least_trust + 0.1)),
    }
    return F.array_compact(F.array(*[F.when(when, F.struct(F.lit(k).alias("rule"), score.alias("score"))) for k, (when, score) in fired.items() if k not in disabled]))


def blocking(fired: Column) -> Column:
    """Names of the fired rules that end a session."""
    names = F.transform(fired, lambda x: x["rule"])
    return F.array_intersect(names, F.array(*[F.lit(k) for k, v in RULE_ACTIONS.items() if v == "BLOCKED"]))


def final_decision(scores: dict[str, Column], fired: Column, refused: Column, confirm: Column, corroborate: int = 1) -> Column:
    """BLOCK, WARN or ALLOW by the layers, the rules and the calls; a refused call blocks, one to confirm warns at least."""
    some = F.map_from_entries(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("k"), c.alias("v"))) for k, c in scores.items()])))
    warned = F.exists(fired, lambda x: F.array_contains(F.array(*[F.lit(k) for k, v in RULE_ACTIONS.items() if v == "WARNED"]), x["rule"]))
    by_score = axis.decision(some, F.size(blocking(fired)) > 0, warned, corroborate)
    return F.when(F.coalesce(refused, F.lit(False)), "BLOCK").when((by_score == "ALLOW") & F.coalesce(confirm, F.lit(False)), "WARN").otherwise(by_score)
