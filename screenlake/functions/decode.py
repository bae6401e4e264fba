"""Decoders and ciphers as column expressions."""

from __future__ import annotations

import base64
import html
import re
import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Spans of 8 characters or more, three escapes or more, English function words. A span is read to its end,
# also if that is a sign.
PRINTABLE = re.compile(r"[\x20-\x7E\r\n\t]{5,}")
BASE64_SPAN, BASE64URL_SPAN = re.compile(r"\b[A-Za-z0-9+/]{8,}+(?!\w)={0,2}"), re.compile(r"\b[A-Za-z0-9_-]{8,}+(?!\w)={0,2}")
HEX_SPAN, PERCENT = re.compile(r"\b[0-9a-fA-F]{8,}\b"), re.compile("%[0-9a-fA-F]{2}")
ENTITY = re.compile(r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z]{2,8});")
UNICODE_ESCAPE = re.compile(r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\U[0-9a-fA-F]{8}")
LEAST_ESCAPES = 3
FUNCTION_WORDS = frozenset("the and to of a in is you your that it for on with as this be are or all from not now".split())

# Percentages of the letters a to z in English.
ENGLISH = (8.167, 1.492, 2.782, 4.253, 12.702, 2.228, 2.015, 6.094, 6.966, 0.153, 0.772, 4.025, 2.406, 6.749, 7.507, 1.929, 0.095, 5.987, 6.327, 9.056, 2.758, 0.978, 2.360, 0.150, 1.974, 0.074)


def shift_letters(c: Column, shift: int) -> Column:
    k = shift % 26
    back = lambda a: a[-k:] + a[:-k] if k else a
    return F.translate(text_or_empty(c), UPPER + LOWER, back(UPPER) + back(LOWER))


def rot13(c: Column) -> Column:
    return shift_letters(c, 13)


def letter_counts(c: Column) -> Column:
    """Counts of a to z without regard to case; all other letters count in chi_squared's total only."""
    letters = F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z]", "")
    return let(letters, lambda t: F.array(*[F.length(t) - F.length(F.translate(t, x, "")) for x in LOWER]))


def _chi(counts: Column, n: Column, shift: Column) -> Column:
    share = F.array(*[F.lit(p / 100.0) for p in ENGLISH])
    term = lambda i: F.pow(F.get(counts, (i + shift) % 26) - n * F.get(share, i), 2) / (n * F.get(share, i))
    return F.aggregate(F.sequence(F.lit(0), F.lit(25)), F.lit(0.0), lambda a, i: a + term(i))


def chi_squared(counts: Column, shift: int = 0, least: int = 20) -> Column:
    """Against English after shifting letters back; the histogram is rotated, not the text. Null under ``least`` letters."""
    of = lambda c, n: F.when(n >= least, _chi(c, n, F.lit(shift)))
    return let(counts, lambda c: let(_total(c), lambda n: of(c, n)))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda a, x: a + x)


def caesar_shift(counts: Column, ratio: float = 0.5, most: float = 50.0, least: int = 20) -> Column:
    """The shift of least chi-squared if it is at most ratio of the raw one and at most ``most``; else null."""
    by_shift = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(25)), lambda s: F.struct(_chi(c, n, s).alias("chi"), s.alias("shift")))

    def judge(every: Column) -> Column:
        raw, best = F.get(every, F.lit(0))["chi"], F.array_min(F.slice(every, 2, 25))
        return F.when((best["chi"] < raw) & (best["chi"] <= raw * ratio) & (best["chi"] <= most), best["shift"])

    return let(counts, lambda c: let(_total(c), lambda n: F.when(n >= least, let(by_shift(c, n), judge))))


def decoded_views(c: Column) -> Column:
    """views_of each text."""
    return F.pandas_udf(_views, "array<string>")(c)


def _views(s: pd.Series) -> pd.Series:
    return s.map(lambda t: views_of(t or ""))


def views_of(t: str, depth: int = 2) -> list[str]:
    """Distinct plaintexts, longest first: of base64, base64url and hex spans, of percent, HTML and Unicode escapes and of
    reversed text, and of the same within those, ``depth`` levels in all. Nesting has no built-in form."""
    seen, level = {t: None}, [t]
    for _ in range(depth):
        inner = []
        for x in level:
            for kind, view in _one_level(x):
                if view not in seen:
                    seen[view] = None
                    if kind != "reversed":
                        inner.append(view)
        level = inner
    return sorted(list(seen)[1:], key=len, reverse=True)


def _one_level(t: str):
    spans = [("base64", m, None) for m in BASE64_SPAN.findall(t)] + [("base64url", m, b"-_") for m in BASE64URL_SPAN.findall(t) if "-" in m or "_" in m]
    for kind, span, letters in spans:
        core = span.rstrip("=")
        yield from _printable(kind, lambda: base64.b64decode(core + "=" * (-len(core) % 4), letters, validate=True))
    for span in HEX_SPAN.findall(t):
        yield from _printable("hex", lambda: bytes.fromhex(span))
    for kind, escape, decoded in (("url", PERCENT, urllib.parse.unquote), ("html", ENTITY, html.unescape), ("unicode", UNICODE_ESCAPE, _unescape)):
        if len(escape.findall(t)) >= LEAST_ESCAPES:
            yield kind, decoded(t)
    back = t[::-1]
    n = _function_words(back)
    if n >= 2 and n > _function_words(t):
        yield "reversed", back


def _printable(kind: str, decoded):
    try:
        view = decoded().decode("utf-8")
    except ValueError:
        return
    if PRINTABLE.fullmatch(view):
        yield kind, view


def _unescape(t: str) -> str:
    """Pairs of surrogates become their character, single ones U+FFFD; escapes beyond U+10FFFF stay."""
    out = UNICODE_ESCAPE.sub(lambda m: chr(int(m[0][2:], 16)) if int(m[0][2:], 16) <= 0x10FFFF else m[0], t)
    return out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _function_words(t: str) -> int:
    return sum(w in FUNCTION_WORDS for w in re.findall("[a-z]+", t.lower()))
