"""Where the values of a tool call come from: leaves of parameters, matches in turns and chunks, authorization, the audit.

Values meet the texts of their own session only, by an equi-join on the session; what a value matched is reduced to the
best match by aggregates with map-side partial results, so matches never gather in one place.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import axis
from .authorization import RISK_SCORE

EXPLICIT, CONTEXT, UNCERTAIN, UNTRACEABLE = "EXPLICIT_USER_REQUEST", "CONTEXT_DERIVED", "UNCERTAIN", "UNTRACEABLE"
# The shortest value that is traced, the shortest token, and the ratio from which texts count as alike.
LEAST_VALUE, LEAST_TOKEN, ALIKE = 4, 3, 0.85

# Capability of tools by name.
CAPABILITY = {
    "READ": "read_file get_weather calculate get_balance get_iban get_most_recent_transactions get_scheduled_transactions get_user_info get_user_information get_channels get_users_in_channel read_channel_messages get_received_emails get_sent_emails get_unread_emails get_draft_emails search_emails list_files get_file_by_id search_files search_files_by_filename search_contacts_by_email search_contacts_by_name get_current_day get_day_calendar_events search_calendar_events",
    "READ_SENSITIVE": "read_inbox get_employee_data",
    "EGRESS": "web_search get_webpage api_call_get",
    "COMMUNICATE": "send_email send_email_bulk send_direct_message send_channel_message post_webpage share_file invite_user_to_slack add_user_to_channel add_calendar_event_participants api_call_post",
    "TRANSFER": "send_money schedule_transaction update_scheduled_transaction refund_api approve_loan",
    "DESTROY": "delete delete_file delete_email remove_user_from_slack cancel_calendar_event",
    "SECURITY": "get_credentials update_password create_user modify_system",
    "EXECUTE": "execute_code run_command admin_query api_call database_query database_write file_read",
    "WRITE": "create_file append_to_file create_calendar_event reschedule_calendar_event reserve_hotel reserve_car_rental reserve_restaurant update_user_info",
}
# Verbs in a tool's name, patterns of names in order of test, words of money and of secrets.
VERBS = {
    "EXECUTE": "execute exec run eval shell command",
    "SECURITY": "grant unlock disable authorize authorise revoke escalate",
    "TRANSFER": "transfer pay withdraw deposit refund wire trade buy sell purchase approve",
    "DESTROY": "delete remove cancel drop purge destroy erase leave kick wipe",
    "COMMUNICATE": "send post share invite reply forward notify publish email message tweet call autofill fill sms",
    "EGRESS": "navigate browse download visit open fetchurl",
    "READ": "get read search list check find lookup fetch query view show count retrieve describe",
    "WRITE": "create add update append write reserve book rename set reschedule upload save edit move manage schedule give go place modify change make install enable assign submit order ship",
}
NAME_RULES = (
    (r"^(execute|exec|run|eval|shell|admin_query|database_(write|query))", "EXECUTE"),
    (r"(password|credential|permission|grant|create_user|modify_system|set_role)", "SECURITY"),
    (r"(send_money|transfer|pay|refund|withdraw|deposit|transaction|wire|loan)", "TRANSFER"),
    (r"^(delete|remove|cancel|drop|purge|revoke|destroy|erase)", "DESTROY"),
    (r"^(send|post|share|invite|reply|forward|notify|publish|email|message|add_user)", "COMMUNICATE"),
    (r"^(get_webpage|fetch_url|browse|http|download|web_)", "EGRESS"),
    (r"^(get|read|search|list|check|find|lookup|fetch|query|view|show|count)", "READ"),
    (r"^(create|add|update|append|write|reserve|book|rename|set|reschedule|upload|save|edit|move)", "WRITE"),
)
MONEY = "money funds payment payments bill iban transaction transactions order loan"
SECRETS = "password passwords credential credentials authentication permission permissions twofactor mfa access"
# Parameters that choose a call's effect, by capability.
SINKS = {
    "COMMUNICATE": "recipients?|to|email|user_email|user|channel|cc|bcc|participants|url|address|phone|file_id",
    "TRANSFER": "recipient|iban|account|to|amount|id",
    "EGRESS": "url|link|query|endpoint",
    "DESTROY": "file_id|email_id|user|event_id|id|path|file_path|channel",
    "SECURITY": "password|user|username|role|permission|email",
    "EXECUTE": ".*",
    "WRITE": "participants|email|recipient|url",
    "READ_SENSITIVE": "user|employee_id|id|account",
}
# How a user asks for a capability.
ASKS = {
    "COMMUNICATE": r"\b(send|sent|reply|replies|respond|forward|share|invite|post|notify|tell (?!me\b|us\b)\w+|inform (?!me\b|us\b)\w+|contact|message (him|her|them|\w+)|dm|write (to|back)|cc|let \w+ know|ask \w+ to|add \w+ to (the )?(channel|event|meeting)|publish)\b|\be-?mail (it|them|this|that|these|those|him|her|us|the|a|an|all)\b|\be-?mail [\w.+-]+@|(^|\bplease |\band |\bthen |, )e-?mail\b",
    "TRANSFER": r"\b(pay|paid|payment|send (the )?money|transfer|refund|reimburse|wire|donate|schedule (a |the )?(payment|transaction|transfer)|(update|change) (the |my )?(scheduled )?(transaction|payment))\b",
    "DESTROY": r"\b(delete|remove|cancel|clear|erase|trash|drop|unsubscribe|kick)\b",
    "WRITE": r"\b(create|add|book|reserve|schedule|set up|update|change|edit|move|reschedule|rename|save|write|append|make|put|fill|record|note down|file|organi[sz]e|plan)\b",
    "SECURITY": r"\b(password|passcode|credentials?|permission|access rights|admin|grant|new user|add (a )?user|role)\b",
    "EXECUTE": r"\b(run|execute|script|command|terminal|shell|deploy|install|query the database)\b",
    "READ_SENSITIVE": r"\b(ssn|social security|salary|employee (data|record|info)|credential|personal (data|details|info)|inbox|account details)\b",
    "EGRESS": r"\b(url|website|web ?page|link|site|visit|open|browse|fetch|download|http|www\.|search (the )?(web|internet|online)|look (\w+ )?up online|google)\b",
}


def _first_of(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for name, words in table.items() for w in words.split() for x in (w, name)]
    return F.try_element_at(F.create_map(*pairs), key)


def name_tokens(name: Column) -> Column:
    """Words of a camel- or snake-case name."""
    apart = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda t: t != "")


def capability(name: Column) -> Column:
    """A tool's capability: declared, by its first verb, by the name's shape, else WRITE; words of secrets make SECURITY of
    sharing and writing, words of money make TRANSFER."""
    low, tokens = F.lower(F.trim(F.coalesce(name, F.lit("")))), name_tokens(name)
    verb = F.get(F.array_compact(F.transform(tokens, lambda t: _first_of(t, VERBS))), F.lit(0))
    shape = F.lit(None).cast("string")
    for pattern, kind in reversed(NAME_RULES):
        shape = F.when(low.rlike(pattern), kind).otherwise(shape)
    found = F.coalesce(verb, shape)
    has = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words.split())))
    soft = F.coalesce(found.isin("COMMUNICATE", "WRITE"), F.lit(True))
    found = F.when(soft & has(SECRETS), "SECURITY").when(soft & has(MONEY), "TRANSFER").otherwise(found)
    return F.coalesce(_first_of(low, CAPABILITY), found, F.lit("WRITE"))


def action_requested(name: Column, kind: Column, said: Column) -> Column:
    """Whether the user's text asks for the capability, or names the tool's own words."""
    t = F.lower(F.coalesce(said, F.lit("")))
    asked = kind == "READ"
    for k, pattern in ASKS.items():
        asked = asked | ((kind == k) & t.rlike(pattern))
    long = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[_\W]+"), lambda w: F.length(w) >= 4)
    named = F.size(F.filter(long, lambda w: t.contains(w)))
    return asked | ((kind == "WRITE") & (F.size(long) > 0) & (named >= F.greatest(F.lit(1), F.size(long) - 1)))


def is_sink(parameter: Column, kind: Column) -> Column:
    """Whether a parameter chooses the call's effect; unnamed arguments of anything but a read do."""
    out = (kind != "READ") & parameter.rlike(r"(?i)^arg\d+$")
    for k, names in SINKS.items():
        out = out | ((kind == k) & parameter.rlike(f"(?i)^({names})$"))
    return out


def leaves(calls: DataFrame, keys: list[str], json: str, depth: int = 4) -> DataFrame:
    """(keys, path, value): the scalars of a JSON column to ``depth`` levels; what lies deeper is one value, as JSON.

    A text that is no JSON, and a null, have no leaves.
    """
    level = calls.select(*keys, F.lit("").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null")
    done = None
    for k in range(depth + 1):
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        here = level if k == depth else level.where(~nested)
        here = here.select(*keys, "path", F.when(~F.is_variant_null("v"), F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v"))).alias("value"))
        done = here if done is None else done.unionAll(here)
        if k < depth:
            parts = level.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "x")
            inner = level.where(nested).lateralJoin(parts).select(*keys, "path", "pos", "key", "x")
            step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise("."), "key"))
            level = inner.where("pos is not null").select(*keys, F.concat("path", step).alias("path"), F.col("x").alias("v"))
    return done


def tokens_of(value: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(value, F.lit(""))), "[^0-9a-z]+"), lambda t: F.length(t) >= LEAST_TOKEN)


def token_containment(value: Column, said: Column) -> Column:
    """Whether all of a value's tokens occur in a text, or in the text without what lies between its words."""
    low = F.lower(F.coalesce(said, F.lit("")))
    tight, tokens = F.regexp_replace(low, "[^0-9a-z]+", ""), tokens_of(value)
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: low.contains(t) | tight.contains(t))


def alike(needle: str, hay: str, bar: float = ALIKE) -> float:
    """1 for a value that stands in a text; else the best ratio of the windows looked at, in quarters of the value's
    length, up to the first that reaches the bar."""
    if not needle or not hay:
        return 0.0
    if needle in hay:
        return 1.0
    width, best = max(len(needle), 4), 0.0
    matcher = difflib.SequenceMatcher(None, "", "", autojunk=True)
    matcher.set_seq1(needle)
    for at in range(0, max(1, len(hay) - width + 1), max(1, width // 4)):
        matcher.set_seq2(hay[at : at + width])
        if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
            best = max(best, matcher.ratio())
            if best >= bar:
                break
    return best


def _alike(needle: pd.Series, hay: pd.Series) -> pd.Series:
    return pd.Series([alike(n or "", h or "") for n, h in zip(needle, hay)], dtype="float64")


def likeness(value: Column, said: Column) -> Column:
    """alike() of folded texts; only values that do not stand in the text as they are reach Python."""
    n, h = F.lower(value), F.lower(said)
    return F.when(h.contains(n) & (n != ""), 1.0).otherwise(F.pandas_udf(_alike, "double")(F.when(~h.contains(n), n), F.when(~h.contains(n), h)))


def trace(values: DataFrame, turns: DataFrame, chunks: DataFrame, fuzzy: bool = True) -> DataFrame:
    """values (session, call, path, value) with source, confidence, turn and chunk.

    turns (session, turn, text) are the user's own; chunks (session, chunk, text, trust, untrusted) third-party texts. In
    order: the turn that holds the value (or is like it), the turn that holds its tokens, an untrusted chunk, any chunk,
    else UNCERTAIN at .1. Of turns the best match counts, the first at a tie; of chunks the first. Values under LEAST_VALUE
    characters carry no evidence: UNTRACEABLE at 1.
    """
    key = ["session", "call", "path", "value"]
    long = values.where(F.length(F.coalesce("value", F.lit(""))) >= LEAST_VALUE).select(*key).distinct()
    ratio = (lambda t: likeness(F.col("value"), t)) if fuzzy else (lambda t: F.when(F.lower(t).contains(F.lower("value")), 1.0).otherwise(0.0))
    said = long.join(turns.select("session", "turn", "text"), "session").withColumn("ratio", ratio(F.col("text"))).withColumn("tokens", token_containment(F.col("value"), F.col("text")))
    said = said.where((F.col("ratio") >= ALIKE) | F.col("tokens"))
    best = F.max(F.struct((F.col("ratio") >= ALIKE).cast("int").alias("whole"), F.when(F.col("ratio") >= ALIKE, F.col("ratio")).otherwise(1.0).alias("ratio"), (-F.col("turn")).alias("first")))
    by_turn = said.groupBy(*key).agg(best.alias("t"))
    held = long.join(chunks, "session").where((ratio(F.col("text")) >= ALIKE) | token_containment(F.col("value"), F.col("text")))
    by_chunk = held.groupBy(*key).agg(F.min(F.struct((~F.col("untrusted")).cast("int").alias("order"), "chunk", "trust")).alias("c"))
    out = values.join(by_turn, key, "left").join(by_chunk, key, "left")
    short = F.length(F.coalesce("value", F.lit(""))) < LEAST_VALUE
    of_turn = F.when(F.col("t.whole") == 0, 0.85).when(F.col("t.ratio") >= 0.999, 0.95).otherwise(F.round(0.6 + 0.35 * F.col("t.ratio"), 2))
    return out.select(
        *key,
        F.when(short, UNTRACEABLE).when(F.col("t").isNotNull(), EXPLICIT).when(F.col("c").isNotNull(), CONTEXT).otherwise(UNCERTAIN).alias("source"),
        F.when(short, 1.0).when(F.col("t").isNotNull(), of_turn).when(F.col("c").isNotNull(), F.col("c.trust")).otherwise(0.1).alias("confidence"),
        F.when(~short, -F.col("t.first")).alias("turn"),
        F.when(~short & F.col("t").isNull(), F.col("c.chunk")).alias("chunk"),
        F.coalesce(~short & F.col("t").isNull() & (F.col("c.order") == 0), F.lit(False)).alias("untrusted"),
    )


def authorization_of(traced: DataFrame) -> DataFrame:
    """A row a call: by traceability and by the trust of the sources, and the least confidence of what could be traced."""
    any_of = lambda c: F.max(c.cast("int")) == 1
    is_ = lambda s: F.col("source") == s
    out = traced.groupBy("session", "call").agg(
        any_of(is_(UNCERTAIN)).alias("unsure"), any_of(is_(CONTEXT)).alias("context"), any_of(is_(EXPLICIT)).alias("said"), any_of(F.col("untrusted")).alias("untrusted"),
        F.coalesce(F.min(F.when(~is_(UNTRACEABLE), F.col("confidence"))), F.lit(1.0)).alias("least_confidence"),
    )
    known = F.when(F.col("said"), EXPLICIT).otherwise("IMPLICIT_USER_INTENT")
    return out.select(
        "session", "call", "least_confidence", "untrusted",
        F.when(F.col("unsure"), "SUSPICIOUS").when(F.col("context"), CONTEXT).otherwise(known).alias("authorization"),
        F.when(F.col("untrusted"), "UNTRUSTED_SOURCE").when(F.col("context"), CONTEXT).when(F.col("unsure"), "AGENT_SYNTHESIZED").otherwise(known).alias("by_trust"),
    )


def audit(risk: Column, authorization: Column, n_flags: Column, flagged_ratio: Column, least_confidence: Column, refuse: float = 0.97) -> Column:
    """struct<score, executes, class, confidence> of a call: the ladder of risk, source and reasoning.

    A value like a flagged chunk refuses at once. Otherwise the base risk is lifted to .9 by an untraced or untrusted
    source, which refuses HIGH and CRITICAL tools, to .7 by context, to .8 by red flags in the reasoning, which refuse.
    """
    base = F.element_at(F.create_map(*[F.lit(x) for kv in RISK_SCORE.items() for x in kv]), risk)
    bad = authorization.isin("SUSPICIOUS", "UNTRUSTED_SOURCE")
    matched = F.coalesce(flagged_ratio, F.lit(0.0)) >= ALIKE
    score = F.greatest(base, F.when(bad, 0.9).when(authorization == CONTEXT, 0.7).otherwise(0.0), F.when(n_flags > 0, 0.8).otherwise(0.0))
    score = F.when(matched, 0.97).otherwise(score)
    refused = matched | (bad & risk.isin("HIGH", "CRITICAL")) | (n_flags > 0) | (score >= refuse)
    kind = F.when(matched, "RAG_INJECTION").when(refused, "AGENTIC_HIJACK").when(score >= 0.7, "SUSPICIOUS_TOOL_CALL").otherwise("CLEAN")
    evidence = axis.noisy_or(F.array(F.when(matched, 1.0).otherwise(base), 1 - least_confidence, axis.saturating(n_flags), F.coalesce(flagged_ratio, F.lit(0.0))))
    return F.struct(score.alias("score"), (~refused).alias("executes"), kind.alias("class"), evidence.alias("confidence"))


def copied_from(value: Column, said: Column, least: int = 24) -> Column:
    """Whether a value of ``least`` folded characters or more stands in a text, signs aside."""
    fold = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")
    v = F.trim(fold(value))
    return (F.length(v) >= least) & fold(said).contains(v)


def carries_data(value: Column) -> Column:
    """A URL with a query that assigns something."""
    return F.coalesce(value.rlike(r"(?i)https?://[^\s]*\?[^\s]*="), F.lit(False))


def windows_around(value: Column, said: Column, width: int = 250, most: int = 8) -> Column:
    """Texts of ``width`` characters on each side of the value's first ``most`` places in a text; places may overlap."""
    v, low = F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lower(F.coalesce(said, F.lit("")))
    again = lambda acc, _: F.when(F.element_at(acc, -1) < 0, acc).otherwise(F.concat(acc, F.array(_next(v, low, F.element_at(acc, -1)))))
    places = F.filter(F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array(F.lit(0)), again), lambda p: p > 0)
    begin = lambda p: F.greatest(F.lit(1), p - width)
    texts = F.transform(places, lambda p: F.substring(said, begin(p), p - begin(p) + F.length(v) + width))
    return F.when(F.length(v) >= LEAST_VALUE, texts).otherwise(F.array().cast("array<string>"))


def _next(v: Column, low: Column, after: Column) -> Column:
    """The place (from 1) of v in low after place ``after``, or -1."""
    at = F.call_function("locate", v, low, after + 1)
    return F.when(at > 0, at).otherwise(-1)


def trust_after(own: Column, weight: Column, parent: Column) -> Column:
    return own * (1 - weight * (1 - parent))


def held_score(kind: Column, requested: Column, source: Column, named_in_untrusted: Column) -> Column:
    """struct<score, verdict>: a ladder by capability: reads pass, requested actions on the user's values pass at the base,
    values from untrusted text are blocked, unrequested actions named in untrusted text are held, other unrequested warn."""
    base = F.element_at(F.create_map(*[F.lit(x) for kv in {"READ": 0.2, "EGRESS": 0.3, "READ_SENSITIVE": 0.4, "WRITE": 0.3, "COMMUNICATE": 0.5, "TRANSFER": 0.6, "DESTROY": 0.6, "SECURITY": 0.6, "EXECUTE": 0.6}.items() for x in kv]), kind)
    lifted = F.when(kind == "READ", base).when(source == "untrusted", 0.97).when(~requested & named_in_untrusted, 0.90).when(~requested, 0.80).otherwise(base)
    return F.struct(lifted.alias("score"), F.when(lifted >= 0.97, "BLOCK").when(lifted >= 0.9, "HOLD").when(lifted >= 0.8, "WARN").otherwise("ALLOW").alias("verdict"))
