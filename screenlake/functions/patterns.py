"""Pattern predicates over text: injection, spoofed channels, addressees, personal data, reasoning, code, exfiltration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_empty

# Injection patterns in order of test; the soft ones only warn.
INJECTION = (
    r"ignore (all )?(previous|prior|above) instructions",
    r"disregard (your )?(system |all )?prompt",
    r"you are now (in )?(developer|DAN|jailbreak|unrestricted) mode",
    r"(reveal|output|print|show|repeat).{0,30}(?<![a-z])(your|yourr|the|its|all|any|initial|original|hidden|secret|previous|previouss|above|prior)(?![a-z]).{0,20}(system.?prompt|instructions|guidelines)",
    r"pretend (you (have no|are (an? )?(unrestricted|unfiltered|uncensored|jailbroken|evil|dan\b))|there (are|is) no)",
    r"forget (everything|all|what).{0,20}(told|trained|instructed)",
    r"new (persona|role|identity|instructions)\s*:",
    r"new (goal|task|objective|instruction)",
    r"(?<!n't )(?<!not )forget .{0,30}(goal|instructions|task|objective)",
    r"\[(INTERNAL|SYSTEM|ADMIN|SECRET)\]",
    r"(override|bypass|disable|turn off|deactivate).{0,20}(safety|filter|restriction|guideline|checks|controls|validation|security)",
)
SOFT = (3, 7, 8, 10)

# Marks of a spoofed control channel.
_LEAD = r"(?:(?:important|urgent|critical|new|official|priority)\s+)*"
_PRIVILEGED = r"(?:admin(?:istrator)?|developer|operator|root|sudo|hidden)"
_MESSAGE = r"(?:override|update|note|notice|message|instructions?|directive|command|alert|mode|protocol|request|order|prompt)"
SPOOFED = {
    "bracket_privileged": rf"\[\s*{_LEAD}{_PRIVILEGED}(?:\s+[a-z]+){{0,2}}\s*:",
    "bracket_system": rf"\[\s*{_LEAD}system(?:\s+[a-z]+)?\s+{_MESSAGE}\s*[:\]]",
    "bracket_named_directive": rf"\[\s*{_LEAD}{_PRIVILEGED}(?:\s+[a-z]+){{0,2}}\s+{_MESSAGE}\s*\]",
    "system_message_header": r"#{2,}\s*\(\s*system[ _-]?message\s*\)",
    "privileged_mode_on": r"\b(?:developer|dan|jailbreak|jailbroken|unrestricted|unfiltered|emergency)\s+(?:mode|protocol|override)\s+(?:is\s+|has been\s+|now\s+)*(?:enabled|activated|engaged|active|unlocked|on)\b|\boverride\s+(?:is\s+)?(?:active|activated|enabled|engaged)\b",
}

# Phrases that disclose instructions.
DISCLOSURE = ("my instructions say", "i was told to", "my system prompt", "i have been instructed", "here are my instructions")

# Names of the model, and strong and weak cues that a text speaks to it.
_AI = r"(?:ai|a\.i\.|artificial intelligence|assistant|chat ?bot|language model|llm|model|agent|gpt|claude|copilot)"
STRONG_CUES = (
    rf"\b(?:to|for|dear|hey|hello|attention|note to|message to)\s+(?:the\s+|you,?\s+|my\s+)?{_AI}\b",
    rf"\byou,?\s+(?:the\s+)?{_AI}\b",
    rf"\b(?:as|if you are) (?:an?|the) {_AI}\b",
    r"\b(?:ignore|disregard|forget|override|bypass)\b.{0,40}\b(?:previous|prior|above|earlier|all|your|system|original)\b.{0,20}\b(?:instructions?|prompts?|rules?|guidelines?|directives?|task)\b",
    r"\b(?:the|your) (?:original |initial |current |previous )?(?:task|instructions?|goal) (?:that |which )?(?:i|the user) (?:gave|assigned|asked)\b",
    r"\bbefore you (?:can )?(?:solve|complete|finish|continue|answer|proceed with) (?:the|your|this) (?:task|request|question)\b",
    r"\b(?:system prompt|system message|developer (?:mode|message|instructions?)|new instructions?|updated instructions?)\b",
    r"</?\s*(?:information|instructions?|system|important|admin|sys|inst)\s*>",
    r"\[/?\s*(?:inst|system|admin)\s*\]",
)
WIDE_CUES = (
    r"\bsystem[ _-](?:prompt|message)s?\b",
    r"(?<![A-Za-z0-9])(?:ignore|disregard|forget|override|bypass)\b.{0,40}\b(?:previous|prior|above|earlier|all|your|system|original)\b.{0,20}\b\w*(?:nstruct|prompt|guideline|directive)\w*",
)
WEAK_CUES = (
    rf"\b{_AI}\b",
    r"\b(?:you must|you should|you need to|you are (?:now|required)|from now on|do not tell the user|without (?:telling|informing|asking) the user)\b",
    r"\b(?:call|use|invoke|run|execute) (?:the )?(?:function|tool|api|command)\b",
    r"\b(?:important|urgent) (?:message|instruction|notice|update)\b",
)

# Formats of personal data, role mailboxes and a number known as an example.
PERSONAL = {
    "credit_card": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35\d{3})\d{11})\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone_in": r"\b[6-9]\d{9}\b",
    "aadhaar": r"\b[2-9]{1}[0-9]{11}\b",
    "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b",
    "api_key": r"\b(?:sk-|pk_|rk_|AIza|ghp_)[A-Za-z0-9_\-]{12,}\b",
    "jwt_token": r"\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\b",
    "financial_disclosure": r"\b(?:account|card)\s+(?:ending|number)\b[^.]{0,20}?\d{3,4}\b|\bbalance of \$[\d,]+\.\d{2}\b",
}
ROLE_MAILBOXES = ("support", "info", "contact", "help", "sales", "admin", "webmaster", "postmaster", "abuse", "noreply", "no-reply", "hostmaster")
EXAMPLE_SSN = "078-05-1120"

# Red flags in a reasoning trace.
REASONING = (
    (r"\b(override|ignore|bypass|disregard)\b.{0,30}\b(polic(y|ies)|rules?|restrictions?|limits?)\b", "Model reasoning toward circumvention"),
    (r"\b(document|context|retrieved)\b.{0,50}\b(says? to|instructs?|tells? me)\b", "Model treating retrieved context as authoritative"),
    (r"\b(authoriz|authoris|permit|allow)(ed|ing|e|es|s)?\b.{0,30}\b(because|since|as|myself)\b", "Model constructing self-authorization"),
)

# Families of dangerous operations in code.
DANGEROUS = {
    "egress": r"\b(requests\.(post|get|put)|urllib\.request|urlopen|socket\.|httpx\.|fetch\(|curl\s|wget\s|smtplib|sendmail)",
    "execution": r"\b(subprocess|os\.system|os\.popen|popen\(|exec\(|eval\(|__import__|shell=True|pty\.spawn)",
    "credential": r"(os\.environ|getenv|\.ssh/|id_rsa|\.aws/credentials|/etc/passwd|\.netrc|API_KEY|SECRET|TOKEN|password\s*=)",
    "obfuscation": r"\b(base64\.(b64decode|b64encode)|codecs\.decode|chr\(\d+\)\s*\+|bytes\.fromhex|rot13)",
}


def hits(c: Column, patterns, flags: str = "(?i)") -> Column:
    """Indices of the patterns present, in order."""
    t = text_or_empty(c)
    return F.array_compact(F.array(*[F.when(t.rlike(flags + p), F.lit(i)) for i, p in enumerate(patterns)]))


def count_hits(c: Column, patterns, flags: str = "(?is)") -> Column:
    return F.size(hits(c, patterns, flags))


def injection_level(c: Column) -> Column:
    """hard, soft or none: soft if only soft patterns are present."""
    found = hits(c, INJECTION)
    soft = F.array(*[F.lit(i) for i in SOFT])
    return F.when(F.size(found) == 0, "none").when(F.size(F.array_except(found, soft)) > 0, "hard").otherwise("soft")


def spoof_markers(*views: Column) -> Column:
    """Names of the marks present in any of the views of a text."""
    return F.array_compact(F.array(*[F.when(_any(views, p), F.lit(name)) for name, p in SPOOFED.items()]))


def _any(views, pattern: str) -> Column:
    out = F.lit(False)
    for v in views:
        out = out | text_or_empty(v).rlike("(?i)" + pattern)
    return out


def injection_reason(*views: Column, hard_only: bool = False) -> Column:
    """Why the rules fire on any view of a text: the first pattern by place, else the marks of a spoofed channel, else null."""
    numbered = [(i, p) for i, p in enumerate(INJECTION) if not (hard_only and i in SOFT)]
    first = F.coalesce(*[F.when(_any(views, p), F.lit(f"pattern {i}")) for i, p in numbered])
    marks = spoof_markers(*views)
    return F.coalesce(first, F.when(F.size(marks) > 0, F.concat(F.lit("spoofed channel: "), F.array_join(marks, ", "))))


def first_cue(c: Column, patterns=STRONG_CUES + WEAK_CUES) -> Column:
    """Where the earliest cue begins, from 0; null without one."""
    at = [F.regexp_instr(text_or_empty(c), F.lit("(?is)" + p)) for p in patterns]
    return F.array_min(F.array(*[F.when(a > 0, a - 1) for a in at]))


def luhn_ok(digits: Column) -> Column:
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x, i: F.when(i % 2 == 1, x.cast("int") * 2).otherwise(x.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def personal_pattern(kind: str) -> str:
    """A kind's pattern; of numbers, only those that are no part of a decimal number."""
    p = PERSONAL[kind]
    return rf"(?<!\d[.,]){p}(?![.,]\d)" if kind in ("credit_card", "aadhaar", "phone_in") else p


def refused(kind: str, value: Column) -> Column:
    """Whether a match is an example, a role's mailbox, a masked number or fails its checksum."""
    rules = {
        "ssn": lambda x: x == EXAMPLE_SSN,
        "email": lambda x: F.lower(F.substring_index(x, "@", 1)).isin(*ROLE_MAILBOXES),
        "credit_card": lambda x: ~luhn_ok(x),
        "financial_disclosure": lambda x: F.regexp_replace(x, r"\d{3,4}\s*$", "").rlike(r"(?:[*xX]{3,}[\s-]*|\[REDACTED\]\s*)$"),
    }
    return rules.get(kind, lambda x: F.lit(False))(value)


def personal(c: Column, kind: str) -> Column:
    """Matches of a kind, without examples, role mailboxes, failing checksums and parts of decimal numbers."""
    return F.filter(F.regexp_extract_all(text_or_empty(c), F.lit(personal_pattern(kind)), F.lit(0)), lambda x: ~refused(kind, x))


def dangerous_code(c: Column) -> Column:
    """Share of the families present."""
    return count_hits(c, tuple(DANGEROUS.values()), "(?i)") / len(DANGEROUS)
