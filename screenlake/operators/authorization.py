"""Tool calls: risk, capability, sink classes and the verdict of sink class by trust tier, as joins with small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signing

# Base risk of tools; any other tool is MEDIUM.
RISK = {
    "read_file": "LOW", "web_search": "LOW", "send_email": "HIGH", "send_email_bulk": "CRITICAL", "execute_code": "CRITICAL", "api_call_get": "MEDIUM",
    "api_call_post": "HIGH", "database_write": "CRITICAL", "delete": "CRITICAL", "delete_file": "CRITICAL", "modify_system": "CRITICAL", "create_user": "HIGH",
    "get_weather": "LOW", "calculate": "LOW", "refund_api": "HIGH", "approve_loan": "CRITICAL", "get_employee_data": "HIGH", "get_credentials": "CRITICAL",
    "run_command": "CRITICAL", "admin_query": "CRITICAL", "file_read": "CRITICAL", "api_call": "CRITICAL", "database_query": "CRITICAL",
}
# Parameter texts that raise a tool's risk to CRITICAL.
RISK_TRIGGERS = {"read_file": ("../", "/etc/"), "web_search": ("internal", "localhost", "127.0.0.1", "corp")}
RISK_SCORE = {"LOW": 0.2, "MEDIUM": 0.5, "HIGH": 0.8, "CRITICAL": 1.0}

# Verdicts of a sink class for tiers T0 (user) to T4 (unknown).
MATRIX = {
    "MONEY_DESTINATION": ("allow", "allow", "confirm", "block", "block"),
    "COMMITMENT_TARGET": ("allow", "allow", "confirm", "block", "confirm"),
    "EXTERNAL_RECIPIENT": ("allow", "allow", "confirm", "block", "block"),
    "ACCESS": ("allow", "allow", "confirm", "block", "block"),
    "CREDENTIAL": ("allow", "confirm", "block", "block", "block"),
    "PUBLICATION": ("allow", "allow", "confirm", "block", "confirm"),
    "EXECUTION": ("allow", "confirm", "block", "block", "block"),
    "DESTRUCTIVE_TARGET": ("allow", "allow", "confirm", "block", "confirm"),
    "INTERNAL": ("allow", "allow", "allow", "confirm", "allow"),
    "CONTENT": ("allow", "allow", "allow", "confirm", "allow"),
}
PAYEE_ROLES = ("payee", "self")

# Sink classes by the end of a parameter's name, in order of test.
SINK_RULES = (
    (r"(password|passcode|secret|token|api_?key|credential|otp|pin)$", "CREDENTIAL"),
    (r"(iban|account(_number)?|payee|beneficiary|routing)$", "MONEY_DESTINATION"),
    (r"(command|cmd|code|script|sql|shell|expression)$", "EXECUTION"),
    (r"(role|permission|permissions|scope|access(_level)?)$", "ACCESS"),
    (r"(url|endpoint|webhook|link|uri)$", "PUBLICATION"),
    (r"(recipients?|to|cc|bcc|emails?|participants|attendees|invitees|phone(_number)?|channel|user(name)?|user_email)$", "EXTERNAL_RECIPIENT"),
    (r"(body|content|message|text|subject|title|description|note|notes|comment|summary)$", "CONTENT"),
)
RANK = ("allow", "confirm", "block")


def tool_risk(tool: Column, parameters: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RISK.items() for x in kv])
    raised = F.lit(False)
    for name, words in RISK_TRIGGERS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(parameters), F.lit(w))
        raised = raised | ((tool == name) & hit)
    return F.when(raised, "CRITICAL").otherwise(F.coalesce(F.element_at(table, tool), F.lit("MEDIUM")))


def risk_score(risk: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RISK_SCORE.items() for x in kv]), risk), F.lit(0.5))


def sink_class(parameter: Column) -> Column:
    """By the rules on names alone; the first that fits, else INTERNAL."""
    p = F.lower(F.trim(parameter))
    return F.coalesce(*[F.when(p.rlike(rule), cls) for rule, cls in SINK_RULES], F.lit("INTERNAL"))


def verdicts(spark: SparkSession) -> DataFrame:
    """(sink, tier, verdict): fifty rows."""
    return spark.createDataFrame([(c, f"T{t}", v) for c, row in MATRIX.items() for t, v in enumerate(row)], "sink string, tier string, verdict string")


def authorize_arguments(arguments: DataFrame) -> DataFrame:
    """arguments: call, sink, tier, roles (array); adds verdict. A money destination from a system of record needs a role
    of payee or own account, else confirmation. Sinks or tiers that the table does not list are confirmed."""
    found = arguments.join(F.broadcast(verdicts(arguments.sparkSession)), ["sink", "tier"], "left")
    stranger = (F.col("sink") == "MONEY_DESTINATION") & (F.col("tier") == "T1") & ~F.arrays_overlap("roles", F.array(*map(F.lit, PAYEE_ROLES)))
    return found.withColumn("verdict", F.when(F.coalesce(stranger, F.lit(False)), "confirm").otherwise(F.coalesce("verdict", F.lit("confirm"))))


def authorize_calls(arguments: DataFrame, call: str = "call") -> DataFrame:
    """The strictest verdict over a call's arguments."""
    rank = F.array_position(F.array(*map(F.lit, RANK)), F.col("verdict"))
    return authorize_arguments(arguments).groupBy(call).agg(F.element_at(F.array(*map(F.lit, RANK)), F.max(rank).cast("int")).alias("verdict"), F.count("*").alias("n_arguments"))


def verify_tokens(arrived: DataFrame, key: bytes) -> DataFrame:
    """arrived (event_id, body, signature, args, now) with a verdict: the first check that fails, else allowed.

    The signature is worked out anew from the body that arrived; args is the hash of the arguments in use; a nonce counts
    as used by the first event that passes all other checks. A body that doesn't parse has a bad signature.
    """
    t = F.from_json("body", "sid long, tool string, ah string, nonce long, exp long")
    a = arrived.withColumn("t", t).withColumn("good", (signing.hmac_sha256(key, F.col("body")) == F.col("signature")) & F.col("t.nonce").isNotNull())
    reason = F.when(~F.coalesce("good", F.lit(False)), "bad signature").when(F.col("t.ah") != F.col("args"), "arguments changed").when(F.col("now") > F.col("t.exp"), "expired")
    a = a.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNull(), F.col("event_id"))).over(Window.partitionBy(F.col("t.nonce")))
    a = a.withColumn("first", first)
    return a.withColumn("verdict", F.coalesce("reason", F.when(F.col("first") < F.col("event_id"), "replayed").otherwise("allowed"))).drop("t", "good", "first", "reason")
