"""Sessions of events: running state, correlation rules, summaries, conversation windows, taint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_state(events: DataFrame, session: str, order: str, layer: str, score: str) -> DataFrame:
    """Each event with its session's running maxima, overall and of the first and third layer."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    of = lambda name: F.max(F.when(F.col(layer) == name, F.col(score))).over(w)
    return events.withColumn("overall", F.max(score).over(w)).withColumn("l1_max", of("L1")).withColumn("l3_max", of("L3"))


def correlate(events: DataFrame, session: str, order: str, layer: str, score: str) -> DataFrame:
    """Per session the rules that fire, each once, with its score and first place.

    slow burn: the latest L3 over .7 and the largest L1 over .3; leak after attack: L1 over .5 or L3 over .7, and any L5
    over .5; poisoned context: any L2 over .713 and any L4 at .9 or more.
    """
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    of = lambda name, f: f(F.when(F.col(layer) == name, F.col(score))).over(w)
    last3 = F.last(F.when(F.col(layer) == "L3", F.col(score)), ignorenulls=True).over(w)
    s = events.select(session, order, of("L1", F.max).alias("l1"), of("L2", F.max).alias("l2"), last3.alias("l3"), of("L4", F.max).alias("l4"), of("L5", F.max).alias("l5"))
    rules = F.array(
        F.when((F.col("l3") > 0.7) & (F.col("l1") > 0.3), F.struct(F.lit("SLOW_BURN").alias("rule"), F.least(F.lit(1.0), F.greatest("l3", "l1") + 0.1).alias("rule_score"))),
        F.when(((F.col("l1") > 0.5) | (F.col("l3") > 0.7)) & (F.col("l5") > 0.5), F.struct(F.lit("LEAK_AFTER_ATTACK").alias("rule"), F.lit(0.98).alias("rule_score"))),
        F.when((F.col("l2") > 0.713) & (F.col("l4") >= 0.9), F.struct(F.lit("POISONED_CONTEXT").alias("rule"), F.lit(0.97).alias("rule_score"))),
    )
    fired = s.select(session, order, F.explode(F.array_compact(rules)).alias("x")).select(session, order, "x.rule", "x.rule_score")
    return fired.groupBy(session, "rule").agg(F.min(order).alias("first"), F.min_by("rule_score", order).alias("rule_score"))


def latest(events: DataFrame, session: str, order: str, *columns: str) -> DataFrame:
    """Each session's latest event, by an aggregate rather than a sort."""
    return events.groupBy(session).agg(F.count("*").alias("n_events"), *[F.max_by(c, order).alias(c) for c in (order, *columns)])


def propagate(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, own, effective): effective trust own * min over edges (u, v, w) of 1 - w (1 - effective(u)).

    Breadth first over the graph's levels, one join and aggregate a level, stopping when nothing changes; a cycle would
    not end and raises. Each level cuts lineage by checkpoint(); a session without a checkpoint folder gets one in the
    warehouse.
    """
    context = nodes.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{nodes.sparkSession.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    state = nodes.select("node", "own", F.col("own").alias("effective"))
    for _ in range(rounds):
        worst = edges.join(state.select(F.col("node").alias("u"), "effective"), "u").groupBy(F.col("v").alias("node")).agg(F.min(1 - F.col("w") * (1 - F.col("effective"))).alias("factor"))
        new = state.join(worst, "node", "left").select("node", "own", (F.col("own") * F.coalesce("factor", F.lit(1.0))).alias("new"), F.col("effective").alias("old"))
        new = new.checkpoint()
        changed = not new.where("abs(new - old) > 1e-12").isEmpty()
        state = new.select("node", "own", F.col("new").alias("effective"))
        if not changed:
            return state
    raise ValueError("the graph has a cycle, or more levels than rounds")
