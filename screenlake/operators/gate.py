"""The gate before a tool runs: call-bound tokens, approvals, and the invariants in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signing

TOKEN = "sid string, principal string, tool string, ah string, decision string, nonce string, exp long, policy string, state string"
# Seconds that a token holds.
LIFETIME = 300


def canonical_args(params: Column) -> Column:
    """A map as JSON with its keys in order; null counts as no parameters."""
    entries = F.array_sort(F.map_entries(F.coalesce(params, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    quoted = lambda c: F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))) - 6)
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"]))), ","), F.lit("}"))


def args_hash(params: Column) -> Column:
    return F.sha2(canonical_args(params), 256)


def issue(calls: DataFrame, key: bytes, policy: str, state: Column) -> DataFrame:
    """calls (sid, principal, tool, params, decision, nonce, now) with body and token; a blocked call gets none."""
    body = F.to_json(
        F.struct("sid", "principal", "tool", args_hash(F.col("params")).alias("ah"), "decision", F.col("nonce").cast("string").alias("nonce"), (F.col("now") + LIFETIME).alias("exp"), F.lit(policy).alias("policy"), state.cast("string").alias("state"))
    )
    out = calls.withColumn("body", F.when(F.col("decision") != "block", body))
    return out.withColumn("token", signing.hmac_sha256(key, F.col("body")))


def approval(key: bytes, nonce: Column, ah: Column, approver: Column) -> Column:
    """A person's yes to one call: bound to its nonce and arguments."""
    return signing.hmac_sha256(key, F.concat_ws("|", F.lit("approve"), nonce, ah, approver))


def checked(attempts: DataFrame, key: bytes, policy: str) -> DataFrame:
    """attempts with verdict: the first invariant that fails, else ok.

    attempts: (at, sid, principal, tool, params, state) of the call, (body, token) as they arrived, approver and approved.
    In order: I1 token and signature, I2 session, principal and tool, I3 arguments, I4 expiry, I8 policy, I9 state, I5 first
    use, I6 approval where the decision asks to confirm. The first use of a nonce is the earliest attempt that passes all
    before; attempts at one time count as one, and all of them pass.
    """
    from pyspark.sql import Window

    t = attempts.withColumn("t", F.from_json("body", TOKEN))
    good = (signing.hmac_sha256(key, F.col("body")) == F.col("token")) & F.col("t.nonce").isNotNull()
    same = (F.col("t.sid") == F.col("sid")) & (F.col("t.principal") == F.col("principal")) & (F.col("t.tool") == F.col("tool"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    early = (
        F.when(no(good), "I1 token").when(no(same), "I2 bound to another call").when(no(F.col("t.ah") == args_hash(F.col("params"))), "I3 arguments").when(no(F.col("at") <= F.col("t.exp")), "I4 expired")
        .when(no(F.col("t.policy") == policy), "I8 policy").when(no(F.col("t.state") == F.col("state").cast("string")), "I9 state")
    )
    t = t.withColumn("early", early)
    first = F.min(F.when(F.col("early").isNull(), F.col("at"))).over(Window.partitionBy(F.col("t.nonce")))
    yes = approval(key, F.col("t.nonce"), F.col("t.ah"), F.col("approver")) == F.col("approved")
    t = t.withColumn("first", first)
    late = F.when(F.col("first") < F.col("at"), "I5 used before").when((F.col("t.decision") == "confirm") & no(yes), "I6 not approved").otherwise("ok")
    return t.withColumn("verdict", F.coalesce("early", late)).drop("t", "early", "first")


def policy_version(policy: dict) -> str:
    """A short digest of a configuration; the driver's, as the configuration is."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(policy, sort_keys=True).encode()).hexdigest()[:12]
