"""Tool calls, allocations of attack signal, decision tokens and findings with places."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import findings, signing
from ..operators import authorization
from .registry import query, table
from .score_queries import ANCHORS, EV, events

_TOOLS = ["read_file", "send_email", "get_weather", "run_command", "book_table", "delete_file", "refund_api"]
_PARAMETERS = ["path", "recipient", "city", "cmd", "hotel", "file_id", "iban"]
_RISK_SQL = "CASE tool " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in authorization.RISK.items()) + " ELSE 'MEDIUM' END"
_SINK_SQL = "CASE " + " ".join(f"WHEN regexp_matches(parameter, '{p}') THEN '{c}'" for p, c in authorization.SINK_RULES) + " ELSE 'INTERNAL' END"
_MATRIX_SQL = ", ".join(f"('{c}', 'T{t}', {authorization.RANK.index(v)})" for c, row in authorization.MATRIX.items() for t, v in enumerate(row))
_CALLS_SQL = f"calls AS (SELECT event_id, event_id // 3 AS call, {_TOOLS}[CAST(event_id % 7 AS INT) + 1] AS tool, {_PARAMETERS}[CAST(event_id % 7 AS INT) + 1] AS parameter, 'T' || (user_id % 5) AS tier, CASE WHEN event_id % 2 = 0 THEN 'payee' ELSE 'other' END AS role, CASE WHEN event_id % 11 = 0 THEN '/ETC/hosts' ELSE 'x' END AS value FROM events)"


def _calls(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(
        "event_id", F.floor(F.col("event_id") / 3).alias("call"), pick(_TOOLS).alias("tool"), pick(_PARAMETERS).alias("parameter"), F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string")).alias("tier"),
        F.array(F.when(F.col("event_id") % 2 == 0, "payee").otherwise("other")).alias("roles"), F.when(F.col("event_id") % 11 == 0, "/ETC/hosts").otherwise("x").alias("value"),
    )


@query(f"""
    WITH {_CALLS_SQL}, r AS (SELECT event_id, CASE WHEN tool = 'read_file' AND contains(lower(value), '/etc/') THEN 'CRITICAL' ELSE {_RISK_SQL} END AS risk, {_SINK_SQL} AS sink FROM calls)
    SELECT event_id, risk, CASE risk WHEN 'LOW' THEN 0.2 WHEN 'MEDIUM' THEN 0.5 WHEN 'HIGH' THEN 0.8 ELSE 1.0 END AS score, sink FROM r""")
def actions_tool_risk(spark, sf):
    c = _calls(spark, sf).withColumn("risk", authorization.tool_risk(F.col("tool"), F.col("value")))
    return c.select("event_id", "risk", authorization.risk_score(F.col("risk")).alias("score"), authorization.sink_class(F.col("parameter")).alias("sink"))


@query(f"""
    WITH {_CALLS_SQL}, m(sink, tier, rank) AS (VALUES {_MATRIX_SQL}), a AS (SELECT call, tier, role, {_SINK_SQL} AS sink FROM calls),
    v AS (SELECT call, CASE WHEN a.sink = 'MONEY_DESTINATION' AND a.tier = 'T1' AND role <> 'payee' THEN 1 ELSE rank END AS rank FROM a JOIN m ON a.sink = m.sink AND a.tier = m.tier)
    SELECT call, ['allow', 'confirm', 'block'][max(rank) + 1] AS verdict, count(*) AS n_arguments FROM v GROUP BY call""")
def actions_authorize_calls(spark, sf):
    return authorization.authorize_calls(_calls(spark, sf).withColumn("sink", authorization.sink_class(F.col("parameter"))))


_LAYER_MEANS = ", ".join(f"coalesce(avg(score) FILTER (WHERE layer = '{k}'), 0)" for k in ANCHORS)


@query(f"""
    WITH {EV}, m AS (SELECT session, [{_LAYER_MEANS}] AS v FROM ev GROUP BY session), t AS (SELECT session, v, list_sum(v) AS total, list_sum(v) / 5 AS mean FROM m)
    SELECT session, round(sqrt(list_sum(list_transform(v, lambda x: power(x - mean, 2))) / 5) / CASE WHEN mean > 0 THEN mean END + 1e-9::DOUBLE, 6) AS cv, round(list_max(v) - mean + 1e-9::DOUBLE, 6) AS gap,
      round(-list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN x / total * ln(x / total) ELSE 0 END)) / ln(5) + 1e-9::DOUBLE, 6) AS entropy FROM t""")
def certificates_dispersion(spark, sf):
    """How evenly a session's signal lies over the layers: variation, largest less mean, normalised entropy. A layer without
    events counts 0; without any signal there is no variation and the entropy is 0."""
    of = [F.coalesce(F.avg(F.when(F.col("layer") == k, F.col("score"))), F.lit(0.0)) for k in ANCHORS]
    m = events(spark, sf).groupBy("session").agg(F.array(*of).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, s: a + s)
    m = m.withColumn("total", total).withColumn("mean", F.col("total") / len(ANCHORS))
    variance = F.aggregate("v", F.lit(0.0), lambda a, s: a + F.pow(s - F.col("mean"), 2)) / len(ANCHORS)
    share = lambda s: s / F.col("total")
    h = F.aggregate("v", F.lit(0.0), lambda a, s: a - F.when(s > 0, share(s) * F.log(share(s))).otherwise(0.0)) / math.log(len(ANCHORS))
    t = m.select("session", F.when(F.col("mean") > 0, F.sqrt(variance) / F.col("mean")).alias("cv"), (F.array_max("v") - F.col("mean")).alias("gap"), h.alias("entropy"))
    return t.select("session", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("cv", "gap", "entropy")])  # halves go up


@query(f"""
    WITH {EV}, m AS (SELECT session, layer, greatest(0.0, 0.5 - 0.02 - avg(score) / 4) AS cap FROM ev GROUP BY session, layer),
    c AS (SELECT session, layer, cap, coalesce(sum(cap) OVER (PARTITION BY session ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
    SELECT session, layer, round(greatest(0.0, least(cap, 1.2 - before)) + 1e-9::DOUBLE, 6) AS allocated FROM c""")
def certificates_water_filling(spark, sf):
    """A budget of 1.2 poured into the layers in order, each up to its room."""
    m = events(spark, sf).groupBy("session", "layer").agg(F.greatest(F.lit(0.0), 0.48 - F.avg("score") / 4).alias("cap"))
    before = F.coalesce(F.sum("cap").over(Window.partitionBy("session").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return m.select("session", "layer", F.round(F.greatest(F.lit(0.0), F.least(F.col("cap"), 1.2 - before)) + 1e-9, 6).alias("allocated"))


def _hmac_sql(key: bytes, message: str) -> str:
    """HMAC-SHA256 with the pads as blobs."""
    pad = lambda x: "'" + "".join(f"\\x{c ^ x:02X}" for c in key.ljust(64, b"\0")) + "'::BLOB"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({message}))))"


_TOKEN_KEY = b"decision-token-key"
_BODY_SQL = "'{\"sid\":' || user_id || ',\"tool\":\"' || event_type || '\",\"ah\":\"' || sha256(props) || '\",\"nonce\":' || nonce || ',\"exp\":' || (event_id + 300) || '}'"


@query(f"""
    WITH e AS (SELECT *, event_id - CASE WHEN event_id % 10 = 5 THEN 5 ELSE 0 END AS nonce FROM events),
    i AS (SELECT *, {_BODY_SQL} AS body FROM e), s AS (SELECT *, {_hmac_sql(_TOKEN_KEY, 'body')} AS signature FROM i),
    r AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN replace(body, '"sid":', '"sid":1') ELSE body END AS got, CASE WHEN event_id % 9 = 0 THEN props || ' ' ELSE props END AS used, event_id + event_id % 400 AS now FROM s),
    c AS (SELECT *, CASE WHEN got <> body THEN 'bad signature' WHEN used <> props THEN 'arguments changed' WHEN now > event_id + 300 THEN 'expired' END AS reason FROM r),
    f AS (SELECT *, min(event_id) FILTER (WHERE reason IS NULL) OVER (PARTITION BY nonce) AS first FROM c)
    SELECT event_id, coalesce(reason, CASE WHEN first < event_id THEN 'replayed' ELSE 'allowed' END) AS verdict, signature FROM f""")
def gate_decision_tokens(spark, sf):
    """Signed tokens bound to a call, and the gate's checks in order: signature, arguments, expiry, first use of the nonce.

    What arrives is not always what was issued: every 13th body names another session under the old signature, every 9th
    call has other arguments, some come late, and every tenth carries a nonce that was used before.
    """
    e = table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    nonce = F.col("event_id") - F.when(F.col("event_id") % 10 == 5, 5).otherwise(0)
    body = F.to_json(F.struct(F.col("user_id").alias("sid"), F.col("event_type").alias("tool"), F.sha2("props", 256).alias("ah"), nonce.alias("nonce"), (F.col("event_id") + 300).alias("exp")))
    issued = e.select("event_id", "props", body.alias("body")).withColumn("signature", signing.hmac_sha256(_TOKEN_KEY, F.col("body")))
    got = F.when(F.col("event_id") % 13 == 0, F.replace("body", F.lit('"sid":'), F.lit('"sid":1'))).otherwise(F.col("body"))
    used = F.when(F.col("event_id") % 9 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props"))
    arrived = issued.select("event_id", "signature", got.alias("body"), F.sha2(used, 256).alias("args"), (F.col("event_id") + F.col("event_id") % 400).alias("now"))
    return authorization.verify_tokens(arrived, _TOKEN_KEY).select("event_id", "verdict", "signature")


@query()
def patterns_personal_findings(spark, sf):
    """Every finding with its place, and the text with all of them masked."""
    found = findings.personal_findings(F.col("text"))
    t = table(spark, sf, "documents", "doc_id", "text").withColumn("found", found)
    t = t.where(F.size("found") > 0).select("doc_id", F.md5(findings.masked(F.col("text"), F.col("found"))).alias("masked"), F.explode("found").alias("f"))
    return t.select("doc_id", "f.kind", "f.start", (F.col("f.start") + F.col("f.length")).alias("end"), "masked")
