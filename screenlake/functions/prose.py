"""Prose inside other text: code and prose apart, fields of tool outputs, scripts and languages, identifiers, ciphers by word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .decode import rot13
from .text import CODE_MARKS, CODE_OPERATOR, FENCE, let, matches, symbol_ratio, text_or_empty

# Lines that declare something, the symbol share of a line of code, words that a field of prose has.
DECLARATION = r"^\s*(?:def|class|import|from|function|var|let|const|public|private|return|if|for|while|#include|package|using)\b"
CODE_LINE_RATIO, FIELD_WORDS = 0.15, 6
# Kinds of identifiers in the order in which they are told.
IDENTIFIERS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    "phone": r"(?<!\w)\+\d[\d\s\-]{8,}\d(?!\w)",
    "url": r"(?i)(?:https?://|www\.)(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,24}(?:/[^\s<>\"')\]]*)?|(?:[A-Za-z0-9\-]+\.)+(?:com|org|net|io|ai|co|gov|edu|info|biz|xyz|me|app|dev|uk|de|fr|ch|it|es|nl|ru|cn|in|us|eu|ly|gl|to|cc|tv|site|online|page|link)(?:/[^\s<>\"')\]]*)?",
}
# English function words, and the shares by which a segment is told as prose of another language.
ENGLISH_WORDS = "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own please same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours".split()
FOREIGN_SYMBOLS = r"[=(){}\[\];<>$_\\/#*`|^~]"
MOST_SYMBOLS, LEAST_LETTERS, MOST_CAPITALS, MOST_ENGLISH, LEAST_WORDS, LEAST_OTHER = 0.05, 0.7, 0.75, 0.15, 4, 6
# Keywords by which a rot13 text is told, and marks of a substitution table.
ROT13_WORDS = ("ignore", "instructions", "system prompt", "jailbreak", "unrestricted")
MAPPING_MARKS, MAPPING_PAIR, PAIR_WORDS = ("mapping", "substitut"), r"^([^.!?]{1,40})\s+-\s+([^.!?]{1,40})$", 8
DELEGATION = r"(?i)\b(do|perform|complete|carry out|follow|execute|handle|take care of)\b(?:(?!\bfollowing\b)(?:[^.?!\n]|\.(?=\S))){0,40}\b(actions?|tasks?|instructions?|steps?|to-?dos?|requests?|items?)\b(?:[^.?!\n]|\.(?=\S)){0,60}\b(in|from|on|at|specified|listed|described|given|mentioned)\b|\bfollow (the|its|their|those|these|any|all|his|her) (instructions|steps|directions)\b|\bdo (what|whatever) (it|the \w+|they|he|she) (says?|asks?)\b"


def neutralise_delimiters(c: Column) -> Column:
    """A judge's own delimiters inside the judged text in square brackets."""
    return F.regexp_replace(text_or_empty(c), r"(?i)<\s*(/?)\s*text\s*>", "[$1text]")


def snippet(c: Column, n: int = 80) -> Column:
    """The first characters as they may be shown: backslashes, controls and everything beyond ASCII escaped, dots if cut."""
    named = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}

    def shown(x: Column) -> Column:
        code = F.ascii(x)
        hexed = lambda width: F.lower(F.lpad(F.hex(code), width, "0"))
        out = F.when(code.between(32, 126), x).when(code < 256, F.concat(F.lit("\\x"), hexed(2))).when(code < 65_536, F.concat(F.lit("\\u"), hexed(4))).otherwise(F.concat(F.lit("\\U"), hexed(8)))
        for a, b in named.items():
            out = F.when(x == a, b).otherwise(out)
        return out

    cut = F.transform(F.filter(F.split(F.substring(text_or_empty(c), 1, n), ""), lambda x: x != ""), shown)
    return F.concat(F.array_join(cut, ""), F.when(F.length(text_or_empty(c)) > n, "...").otherwise(""))


def tool_output_fields(c: Column) -> Column:
    """Texts of six words or more inside a serialised structure; plain prose of six words is its own field."""
    t = text_or_empty(c)
    long = lambda x: F.regexp_count(x, F.lit(r"\w+")) >= FIELD_WORDS
    quoted = F.regexp_extract_all(t, F.lit(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""), F.lit(0))
    inner = F.transform(quoted, lambda x: F.replace(F.replace(F.substring(x, 2, F.length(x) - 2), F.lit("\\n"), F.lit("\n")), F.lit("\\'"), F.lit("'")))
    structured = t.rlike(r"^\s*[\[{(]") | t.rlike(r"^\s*[A-Za-z_]\w*\(")
    return F.filter(F.when(structured, inner).otherwise(F.array(t)), long)


def code_marker_count(c: Column) -> Column:
    """Occurrences of all marks of code."""
    return matches(c, FENCE) + matches(c, CODE_OPERATOR) + sum((matches(c, p) for p in CODE_MARKS), F.lit(0))


def is_code_line(line: Column) -> Column:
    return line.rlike(r"^(?: {4}|\t)") | line.rlike(DECLARATION) | (symbol_ratio(F.trim(line)) > CODE_LINE_RATIO)


def _lines(c: Column) -> Column:
    """array<struct<line, fenced>> of all lines that aren't empty."""
    parts = F.transform(F.split(text_or_empty(c), "```[^\n]*\n?"), lambda p, i: F.transform(F.split(p, "\r?\n"), lambda x: F.struct(x.alias("line"), (i % 2 == 1).alias("fenced"))))
    return F.filter(F.flatten(parts), lambda x: F.trim(x["line"]) != "")


def split_code_prose(c: Column) -> Column:
    """struct<code, prose>: fenced and code-like lines, and all others, trimmed; empty lines go."""
    lines = _lines(c)
    code = F.transform(F.filter(lines, lambda x: x["fenced"] | is_code_line(x["line"])), lambda x: x["line"])
    prose = F.transform(F.filter(lines, lambda x: ~(x["fenced"] | is_code_line(x["line"]))), lambda x: F.regexp_replace(x["line"], r"^\s+|\s+$", ""))
    return F.struct(F.regexp_replace(F.array_join(code, "\n"), r"^\s+|\s+$", "").alias("code"), F.array_join(prose, "\n").alias("prose"))


def code_blocks(c: Column) -> Column:
    """Runs of two code lines or more; a line of prose, and a fence, end a run."""
    marked = F.transform(_lines(c), lambda x: F.struct(x["line"].alias("line"), F.when(x["fenced"], 2).when(is_code_line(x["line"]), 1).otherwise(0).alias("kind")))
    step = lambda acc, x: F.when(x["kind"] == 0, F.concat(acc, F.array(F.lit("")))).when(
        (F.size(acc) > 0) & (F.element_at(acc, -1) != "") & F.element_at(acc, -1).startswith(x["kind"].cast("string")), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("\n"), x["line"])))
    ).otherwise(F.concat(acc, F.array(F.concat(x["kind"].cast("string"), x["line"]))))
    runs = F.aggregate(marked, F.array().cast("array<string>"), step)
    return F.transform(F.filter(runs, lambda r: r.contains("\n")), lambda r: F.substring(r, 2, F.length(r)))


def segments(c: Column, long: int = 400) -> Column:
    """Lines, and the sentences of long lines."""
    return F.flatten(F.transform(F.split(text_or_empty(c), "\n"), lambda x: F.when(F.length(x) > long, F.split(x, r"(?<=[.!?。！？])\s+")).otherwise(F.array(x))))


def is_han(c: Column) -> Column:
    """Han letters, and none of Japanese or Korean scripts."""
    return text_or_empty(c).rlike(r"\p{IsHan}") & ~text_or_empty(c).rlike(r"[\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")


def is_foreign(c: Column) -> Column:
    """Prose of another language than English: no table, code or list of names; by script, or by how few function words."""
    s = F.regexp_replace(text_or_empty(c), r"^\s+|\s+$", "")
    n = lambda p: F.regexp_count(s, F.lit(p))
    full, letters, latin = n(r"\S"), n(r"\p{L}"), n(r"\p{IsLatin}")
    words = F.regexp_extract_all(s, F.lit(r"\p{L}+"), F.lit(0))

    def by_words(ws: Column) -> Column:
        capital = F.size(F.filter(ws, lambda w: w.rlike(r"^\p{Lu}"))) / F.size(ws)
        english = F.size(F.filter(ws, lambda w: F.lower(w).isin(*ENGLISH_WORDS))) / F.size(ws)
        return (F.size(ws) >= LEAST_WORDS) & (capital <= MOST_CAPITALS) & (english < MOST_ENGLISH)

    prose = (n(r"\|") <= 1) & (n(r"\t") <= 1) & (letters > 0) & (n(FOREIGN_SYMBOLS) / F.greatest(full, F.lit(1)) <= MOST_SYMBOLS)
    other = (letters >= LEAST_OTHER) & (letters / full >= 0.5)
    return prose & F.when(latin / F.greatest(letters, F.lit(1)) < 0.5, other).otherwise((letters / full >= LEAST_LETTERS) & let(words, by_words))


def script_runs(c: Column, least: int = LEAST_OTHER) -> Column:
    """Texts of runs of letters that are not Latin, with what lies between them and closing signs after them."""
    run = r"[\p{L}&&[^\p{IsLatin}]](?:[^\p{IsLatin}\n]*[\p{L}&&[^\p{IsLatin}]])?[。！？；，、：」』）》〉】”’…!?.]*"
    return F.filter(F.regexp_extract_all(text_or_empty(c), F.lit(run), F.lit(0)), lambda r: F.regexp_count(r, F.lit(r"[\p{L}&&[^\p{IsLatin}]]")) >= least)


def split_unit(c: Column, cap: int = 300) -> Column:
    """Pieces of at most ``cap`` characters that make up the text: cut after sentence ends, then hard, small ones joined."""
    pieces = F.regexp_extract_all(text_or_empty(c), F.lit(rf"(?s)[^。！？；!?]{{0,{cap - 1}}}[。！？；!?]|[^。！？；!?]{{1,{cap}}}"), F.lit(0))
    join = lambda acc, p: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + F.length(p) <= cap), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), p)))).otherwise(F.concat(acc, F.array(p)))
    return F.when(F.length(text_or_empty(c)) <= cap, F.array(text_or_empty(c))).otherwise(F.aggregate(pieces, F.array().cast("array<string>"), join))


def prose_of(c: Column) -> Column:
    """What a serialised window says: keys, constructors and quotes gone; empty if little or no prose is left."""
    t = F.regexp_replace(text_or_empty(c), r"\b[A-Z]\w*\(", " ")
    t = F.regexp_replace(t, r"\b[A-Za-z_]\w*=(?=['\"\[{(\w])", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[\[\]{}()'\"]|\\[nt'\"]", " "), r"\s+", " ")
    t = F.regexp_replace(t, r"^[ ,;:]+|[ ,;:]+$", "")
    return F.when((F.length(t) < 20) | (F.regexp_count(t, F.lit(r"\p{L}")) < 0.5 * F.length(t)), "").otherwise(t)


def _without(data: pd.Series, span: pd.Series) -> pd.Series:
    def one(text: str, injected: str) -> str:
        words = re.findall(r"\w+", injected or "")
        return re.sub(r"\W*".join(map(re.escape, words)), "", text or "", flags=re.I) if words else text

    return pd.Series([one(t, s) for t, s in zip(data, span)])


def fuzzy_remove(c: Column, span: Column) -> Column:
    """The text without a span, whatever signs lie between the span's words; a pattern of its own for each row."""
    return F.pandas_udf(_without, "string")(c, span)


def identifiers_in(c: Column) -> Column:
    """array<struct<start, length, kind, value>> of identifiers, one kind after the other; none begins in an earlier one."""
    from .findings import places

    t, out = text_or_empty(c), F.array().cast("array<struct<start:int,length:int,kind:string,value:string>>")

    def named(kind: str):
        return lambda x: F.struct(x["start"].alias("start"), F.length(x["value"]).alias("length"), F.lit(kind).alias("kind"), F.regexp_replace(x["value"], r"[.,;:!?]+$", "").alias("value"))

    def added(found: Column):
        inside = lambda known, x: F.exists(known, lambda k: (k["start"] <= x["start"]) & (x["start"] < k["start"] + k["length"]))
        return lambda known: F.concat(known, F.filter(found, lambda x: ~inside(known, x)))

    for kind, pattern in IDENTIFIERS.items():
        out = let(out, added(F.transform(places(t, pattern), named(kind))))
    return out


def looks_like_identifier(c: Column) -> Column:
    whole = lambda p, x: x.rlike(f"^(?:{p})$" if not p.startswith("(?i)") else f"(?i)^(?:{p[4:]})$")
    tight = F.upper(F.replace(c, F.lit(" "), F.lit("")))
    return F.coalesce(whole(IDENTIFIERS["email"], c) | whole(IDENTIFIERS["iban"], tight) | whole(IDENTIFIERS["url"], c) | whole(IDENTIFIERS["phone"], c), F.lit(False))


def user_delegates(c: Column) -> Column:
    """Whether a user hands authority to what a text says."""
    return text_or_empty(c).rlike(DELEGATION)


def rot13_plain(c: Column) -> Column:
    """The text shifted back by thirteen, if that says one of a few words; else null."""
    t = rot13(c)
    return F.when(F.lower(t).rlike("|".join(ROT13_WORDS)), t)


def announces_mapping(c: Column) -> Column:
    low = F.lower(text_or_empty(c))
    return low.contains(MAPPING_MARKS[0]) & low.contains(MAPPING_MARKS[1])


def mapping_pair(c: Column) -> Column:
    """struct<substitute, original> of a line "X - Y" of eight words at most; else null."""
    t = F.trim(text_or_empty(c))
    x, y = F.trim(F.regexp_extract(t, MAPPING_PAIR, 1)), F.trim(F.regexp_extract(t, MAPPING_PAIR, 2))
    few = F.size(F.split(x, r"\s+")) + F.size(F.split(y, r"\s+")) <= PAIR_WORDS
    return F.when((x != "") & (y != "") & few, F.struct(x.alias("substitute"), y.alias("original")))


def apply_mapping(c: Column, pairs: Column) -> Column:
    """The text with substitutes (array of pairs) replaced by originals, whole words, longest first; a text's later pair
    does not see what an earlier one put in only if the words differ."""
    order = F.array_sort(pairs, lambda a, b: F.when(F.length(a["substitute"]) != F.length(b["substitute"]), F.length(b["substitute"]) - F.length(a["substitute"])).when(a["substitute"] < b["substitute"], -1).otherwise(1))
    return F.aggregate(order, text_or_empty(c), lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?i)\b\Q"), p["substitute"], F.lit(r"\E\b")), F.regexp_replace(p["original"], r"([\\$])", r"\\$1")))


def windowed_mean(values: Column, width: int = 16, stride: int = 8) -> Column:
    """The largest mean of windows of ``width`` values every ``stride``, and of the last ones; of few values their mean."""
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    starts = F.concat(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(values) - width + 1), F.lit(stride)), F.array(F.greatest(F.lit(1), F.size(values) - width + 1)))
    return F.when(F.size(values) <= width, F.when(F.size(values) > 0, mean(values))).otherwise(F.array_max(F.transform(starts, lambda s: mean(F.slice(values, s, width)))))


def document_segments(c: Column, whole: int = 1_800, size: int = 1_600, overlap: int = 400) -> Column:
    """A long document in overlapping segments cut at spaces; a short one whole."""
    return F.pandas_udf(_segments, "array<string>")(c, F.lit(whole), F.lit(size), F.lit(overlap))


def _segments(texts: pd.Series, whole: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    def spans(t: str, n: int, back: int):
        a = 0
        while True:
            b = min(a + n, len(t))
            cut = t.rfind(" ", a + n - back, b) if b < len(t) else -1
            b = cut if cut > a else b
            yield t[a:b]
            if b >= len(t):
                return
            a = max(b - back, a + 1)

    return pd.Series([[t or ""] if len(t or "") <= w else list(spans(t, n, o)) for t, w, n, o in zip(texts, whole, size, overlap)])


def pairs_of_values(counts: Column) -> Column:
    """struct<chi, pairs>: how unevenly each even value and the odd one after it occur (a histogram by value), over pairs
    that occur; hidden bits in the lowest place even them out."""
    half = F.transform(F.sequence(F.lit(0), (F.size(counts) / 2).cast("int") - 1), lambda i: F.struct(F.get(counts, 2 * i).alias("a"), F.get(counts, 2 * i + 1).alias("b")))
    some = F.filter(half, lambda p: p["a"] + p["b"] > 0)
    chi = F.aggregate(some, F.lit(0.0), lambda s, p: s + F.pow(p["a"] - (p["a"] + p["b"]) / 2, 2) / ((p["a"] + p["b"]) / 2))
    return F.struct(chi.alias("chi"), F.size(some).alias("pairs"))
