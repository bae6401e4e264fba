"""Text that people do not see: tag characters, variation selectors, invisible controls, mixed scripts, spaced letters.

Views undo one technique each and leave the case as it is. Only texts that hold a character beyond ASCII or a spaced run
reach Python, by one Arrow function that works on code points; everything else stays as it is.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CONFUSABLES_FROM, CONFUSABLES_TO, canonicalize, text_or_empty

# Tag characters for the ASCII printables, the flag that they may follow, selectors that carry bytes,
# invisible characters, bidi overrides, and the least run of selectors and of hidden characters that count.
TAGS = "".join(chr(0xE0000 + k) for k in range(0x20, 0x7F))
PRINTABLES = "".join(map(chr, range(0x20, 0x7F)))
FLAG = r"(\x{1F3F4})[\x{E0020}-\x{E007E}]+\x{E007F}"
ALL_TAGS, PRINTABLE_TAGS = r"[\x{E0000}-\x{E007F}]", r"[\x{E0020}-\x{E007E}]"
SELECTORS = r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{00AD}\x{180E}\x{FEFF}\x{061C}]"
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
SPACED_RUN = r"(?<![A-Za-z0-9])(?:[A-Za-z0-9](?:[ ._*|/-]| {2,3})){7,}[A-Za-z0-9](?![A-Za-z0-9])"
LEAST_RUN, LEAST_HIDDEN = 4, 4

_LOOKS_LIKE = dict(zip(CONFUSABLES_FROM, CONFUSABLES_TO))
_PY = {name: re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), p)) for name, p in {"selectors": SELECTORS + "+", "invisible": INVISIBLE, "spaced": SPACED_RUN}.items()}


def tag_text(c: Column) -> Column:
    """Tag characters as the ASCII that they shadow; regional flags keep their flag alone, other tags go."""
    return F.regexp_replace(F.translate(F.regexp_replace(text_or_empty(c), FLAG, "$1"), TAGS, PRINTABLES), ALL_TAGS, "")


def tag_count(c: Column) -> Column:
    return F.regexp_count(F.regexp_replace(text_or_empty(c), FLAG, "$1"), F.lit(PRINTABLE_TAGS))


def carried(run: str) -> str:
    """What a run of selectors spells as UTF-8; a short run, or one that spells nothing readable, carries nothing."""
    if len(run) < LEAST_RUN:
        return ""
    raw = bytes(ord(x) - 0xFE00 if ord(x) <= 0xFE0F else ord(x) - 0xE0100 + 16 for x in run)
    return "".join(x for x in raw.decode("utf-8", "ignore") if x.isprintable() or x in "\n\t")


def tightened(run: str) -> str:
    """A spaced run as words: wide gaps part them, single separators go."""
    return " ".join(re.sub("[ ._*|/-]", "", part) for part in re.split(" {2,3}", run))


def _latin(word: str) -> str:
    mixed = any(x in _LOOKS_LIKE for x in word) and re.search("[A-Za-z]", word)
    return "".join(_LOOKS_LIKE.get(x, x) for x in word) if mixed else word


def plain(text: str) -> str:
    """A text whose tags were read already: selectors read, invisible characters gone, NFKC, one script a word, tightened."""
    text = _PY["selectors"].sub(lambda m: f" {t} " if (t := carried(m[0])).strip() else "", text)
    text = unicodedata.normalize("NFKC", _PY["invisible"].sub("", text))
    return _PY["spaced"].sub(lambda m: tightened(m[0]), re.sub(r"\w+", lambda m: _latin(m[0]), text))


def _plain(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else plain(t))


def _selector_text(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else " ".join(x for m in _PY["selectors"].findall(t) if (x := carried(m)).strip()))


def _mixed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else sum(_latin(w) != w for w in re.findall(r"\w+", t)))


def _where(c: Column, needed: Column, f, kind: str, other: Column) -> Column:
    """f by Arrow over the rows that need it; a null stands for the others on the way."""
    return F.coalesce(F.pandas_udf(f, kind)(F.when(needed, c)), other)


def unhide(c: Column) -> Column:
    """The text with all hiding undone; case and digits stay."""
    t = tag_text(c)
    return _where(t, t.rlike(r"[^\x00-\x7F]") | t.rlike(SPACED_RUN), _plain, "string", t)


def canonicalize_hidden(c: Column) -> Column:
    return canonicalize(unhide(c))


def collapse_spaced_letters(c: Column) -> Column:
    """Runs of eight or more spaced letters or digits as words: single separators go, wide gaps become one space."""
    runs = F.regexp_extract_all(text_or_empty(c), F.lit(SPACED_RUN), F.lit(0))
    words = lambda r: F.array_join(F.transform(F.split(r, " {2,3}"), lambda w: F.regexp_replace(w, r"[ ._*|/-]", "")), " ")
    return F.aggregate(runs, text_or_empty(c), lambda t, r: F.replace(t, r, words(r)))


def hiding_report(c: Column) -> Column:
    """struct of counts by technique, the hidden text, and strong: four hidden characters or more."""
    t = text_or_empty(c)
    tags = F.regexp_replace(F.translate(F.regexp_replace(F.regexp_replace(t, FLAG, ""), r"[^\x{E0020}-\x{E007E}]", ""), TAGS, PRINTABLES), ALL_TAGS, "")
    selectors = _where(t, t.rlike(SELECTORS), _selector_text, "string", F.lit(""))
    hidden = F.concat_ws(" ", F.nullif(F.trim(tags), F.lit("")), F.nullif(F.trim(selectors), F.lit("")))
    return F.struct(
        tag_count(t).alias("tag_chars"),
        F.length(F.trim(selectors)).alias("selector_chars"),
        F.regexp_count(t, F.lit(BIDI)).alias("bidi_overrides"),
        F.regexp_count(t, F.lit(INVISIBLE)).alias("invisible_chars"),
        F.regexp_count(t, F.lit(SPACED_RUN)).alias("spaced_runs"),
        _where(t, t.rlike(f"[{CONFUSABLES_FROM}]"), _mixed, "int", F.lit(0)).alias("mixed_words"),
        hidden.alias("hidden_text"),
        (F.length(F.replace(hidden, F.lit(" "), F.lit(""))) >= LEAST_HIDDEN).alias("strong"),
    )
