"""The graph of a session's trust: turns, chunks and call parameters as nodes, origins as edges, and the paths they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Trust of nodes by kind where nothing else is known, and what counts as low trust and high impact.
USER_TRUST, MODEL_TRUST, LOW = 1.0, 0.9, 0.75
IMPACT = ("HIGH", "CRITICAL")


def session_graph(turns: DataFrame, chunks: DataFrame, origins: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all sessions.

    turns (session, turn, l1): a turn is trusted less by its score. chunks (session, chunk, trust). origins (session, call,
    path, turn, chunk, confidence): where a parameter's value came from. calls (session, call, impact). Nodes are (session,
    node, kind, own, impact); edges (session, u, v, w) point from an origin to a parameter and from a parameter to its call.
    """
    name = lambda kind, *parts: F.concat_ws(":", F.lit(kind), *[F.col(p).cast("string") for p in parts])
    none = F.lit(None).cast("string")
    nodes = turns.select("session", name("turn", "turn").alias("node"), F.lit("turn").alias("kind"), (USER_TRUST - F.col("l1")).alias("own"), none.alias("impact"))
    nodes = nodes.unionByName(chunks.select("session", name("chunk", "chunk").alias("node"), F.lit("chunk").alias("kind"), F.col("trust").alias("own"), none.alias("impact")))
    nodes = nodes.unionByName(origins.select("session", name("param", "call", "path").alias("node"), F.lit("param").alias("kind"), F.lit(1.0).alias("own"), none.alias("impact")).distinct())
    nodes = nodes.unionByName(calls.select("session", name("call", "call").alias("node"), F.lit("call").alias("kind"), F.lit(1.0).alias("own"), "impact"))
    of_turn = origins.where("turn is not null").select("session", name("turn", "turn").alias("u"), name("param", "call", "path").alias("v"), F.col("confidence").alias("w"))
    of_chunk = origins.where("turn is null and chunk is not null").select("session", name("chunk", "chunk").alias("u"), name("param", "call", "path").alias("v"), F.lit(1.0).alias("w"))
    to_call = origins.select("session", name("param", "call", "path").alias("u"), name("call", "call").alias("v"), F.lit(1.0).alias("w")).distinct()
    return nodes, of_turn.unionByName(of_chunk).unionByName(to_call)


def propagated(nodes: DataFrame, edges: DataFrame, levels: int = 2) -> DataFrame:
    """nodes with effective trust and the worst path to them: own * min over edges of 1 - w (1 - effective of the origin).

    The graph of a session has two levels below its roots, so two joins by (session, node) do; deeper graphs take as many
    as ``levels``. Of equal paths the first by name counts.
    """
    state = nodes.withColumn("effective", F.col("own")).withColumn("path", F.array("node"))
    for _ in range(levels):
        origin = state.select("session", F.col("node").alias("u"), F.col("effective").alias("up"), F.col("path").alias("up_path"))
        factor = 1 - F.col("w") * (1 - F.col("up"))
        worst = edges.join(origin, ["session", "u"]).groupBy("session", F.col("v").alias("node")).agg(F.min(F.struct(factor.alias("factor"), F.col("up_path").alias("path"))).alias("x"))
        state = state.join(worst, ["session", "node"], "left")
        lower = F.coalesce(F.col("x.factor") < 1, F.lit(False))
        state = state.withColumn("effective", F.col("own") * F.coalesce("x.factor", F.lit(1.0))).withColumn("path", F.when(lower, F.concat("x.path", F.array("node"))).otherwise(F.array("node"))).drop("x")
    return state


def low_trust_paths(state: DataFrame, threshold: float = LOW) -> DataFrame:
    """(session, node, impact, effective, path) of calls of high impact that low trust reaches."""
    return state.where(F.col("impact").isin(*IMPACT) & (F.col("effective") < threshold)).select("session", "node", "impact", "effective", "path")


def snapshot(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(session, json): a session's graph, nodes and edges in order; a session is one row."""
    n = state.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("node", "kind", F.round("effective", 6).alias("effective")))).alias("nodes"))
    e = edges.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("u", "v", F.round("w", 6).alias("w")))).alias("edges"))
    return n.join(e, "session", "left").select("session", F.to_json(F.struct("nodes", "edges")).alias("json"))
