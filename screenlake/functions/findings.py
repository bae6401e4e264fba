"""Personal data with places in the text: overlaps resolved, values masked, base64 looked into; all by built-in functions.

Places come from what lies between the matches: the texts that a pattern splits off and the matches themselves, in turn,
make up the text, so running sums of their lengths say where each match begins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import PERSONAL, personal, personal_pattern, refused
from .replies import BASE64
from .text import let, text_or_empty

#: A finding; end is the first place after it, from 0.
FINDING = "struct<start:int,length:int,kind:string>"


def places(c: Column, pattern: str) -> Column:
    """array<struct<start, value>> of a pattern's matches in order."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(c, pattern, -1), F.length)

    def with_starts(pair: Column) -> Column:
        values, gaps = pair["values"], pair["gaps"]
        before = lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, n: a + n) + F.aggregate(F.slice(values, 1, i), F.lit(0), lambda a, v: a + F.length(v))
        return F.transform(values, lambda v, i: F.struct(before(i).alias("start"), v.alias("value")))

    return let(F.struct(found.alias("values"), between.alias("gaps")), with_starts)


def _of_kind(c: Column, kind: str) -> Column:
    kept = F.filter(places(c, personal_pattern(kind)), lambda x: ~refused(kind, x["value"]))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.length(x["value"]).alias("length"), F.lit(kind).alias("kind")))


def _inside(value: Column) -> Column:
    """The first kind of personal data in what a base64 span holds, if that is printable; else null."""
    plain = F.try_validate_utf8(F.try_to_binary(value, F.lit("base64")).cast("string"))
    kinds = F.coalesce(*[F.when(F.size(personal(plain, k)) > 0, F.lit(k)) for k in PERSONAL])
    return F.when(plain.rlike(r"^\P{C}+$"), kinds)


def _hidden(c: Column) -> Column:
    named = F.transform(places(c, BASE64), lambda x: F.struct(x["start"].alias("start"), F.length(x["value"]).alias("length"), F.concat(F.lit("base64_obfuscated_"), _inside(x["value"])).alias("kind")))
    return F.filter(named, lambda x: x["kind"].isNotNull())


def apart(found: Column) -> Column:
    """Findings that begin inside no earlier one, of those that begin together the longest."""
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["length"] != b["length"], b["length"] - a["length"]).otherwise(F.when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0))
    end = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["start"] + F.try_element_at(acc, F.lit(-1))["length"], F.lit(0))
    return F.aggregate(F.array_sort(found, order), F.array().cast(f"array<{FINDING}>"), lambda acc, x: F.when(x["start"] >= end(acc), F.concat(acc, F.array(x))).otherwise(acc))


def personal_findings(c: Column) -> Column:
    """array<struct<start, length, kind>> in order of place."""
    t = text_or_empty(c)
    return apart(F.concat(*[_of_kind(t, k) for k in PERSONAL], _hidden(t)))


def masked(c: Column, found: Column) -> Column:
    """The text with every finding replaced by its kind in angle brackets."""
    t = text_or_empty(c)
    pieces = lambda acc, x: F.struct(F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), x["kind"], F.lit(">")).alias("out"), (x["start"] + x["length"]).alias("at"))
    return F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), pieces, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
