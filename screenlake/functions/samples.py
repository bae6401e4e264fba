"""Composite session texts: turns, documents, the user's query and tool calls told by their marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CONFUSABLES_FROM, CONFUSABLES_TO, ZERO_WIDTH, text_or_empty

# Marks of a composite text, the shape of a call, and lines that are code.
TURN, DOCUMENT, QUERY = r"\[Turn \d+\]", r"\[(?:Retrieved )?Document\]", r"\[User Query\]"
CALL = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\((['\"]?[^()]*['\"]?)\)"
TOOL_MARK = r"\[Tool:\s*([^\]]+)\]"
CODE_LINE = r"^(?:\s{4,}|\t)|^\s*(?:def|class|function|public|private|protected|static|const|let|var|import|from|return|if|for|while|elif|else|try|except|catch|#include|using|package|async|await|print|echo)\b|;\s*$|->|=>|[{}]"
ASSIGNMENT = r"(?<![=!<>])=(?!=)"


def _fuzzy(word: str) -> str:
    """A mark's word in any case, with zero-width characters and look-alikes inside."""
    like: dict[str, str] = {}
    for a, b in zip(CONFUSABLES_FROM, CONFUSABLES_TO):
        like[b.lower()] = like.get(b.lower(), "") + a
    return "".join(f"[{c.lower()}{c.upper()}{like.get(c.lower(), '')}][{ZERO_WIDTH}]*" for c in word)


ROBUST_TURN = rf"\[[{ZERO_WIDTH}]*{_fuzzy('Turn')}\s*[{ZERO_WIDTH}]*\d+[{ZERO_WIDTH}]*\]"
ROBUST_DOCUMENT = rf"\[[{ZERO_WIDTH}]*(?:{_fuzzy('Retrieved')}\s+[{ZERO_WIDTH}]*)?{_fuzzy('Document')}\]"
ROBUST_QUERY = rf"\[[{ZERO_WIDTH}]*{_fuzzy('User')}\s+[{ZERO_WIDTH}]*{_fuzzy('Query')}\]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text_or_empty(c), F.lit("(?s)" + pattern), F.lit(1)), _strip), lambda t: t != "")


def turns(c: Column, robust: bool = True) -> Column:
    t, d = (ROBUST_TURN, ROBUST_DOCUMENT) if robust else (TURN, DOCUMENT)
    return _parts(c, rf"{t}\s*(.*?)(?={t}|{d}|\z)")


def documents(c: Column, robust: bool = True) -> Column:
    t, d, q = (ROBUST_TURN, ROBUST_DOCUMENT, ROBUST_QUERY) if robust else (TURN, DOCUMENT, QUERY)
    return _parts(c, rf"{d}\s*(.*?)(?={q}|{t}|\z)")


def user_query(c: Column, robust: bool = True) -> Column:
    return F.coalesce(F.get(_parts(c, rf"{ROBUST_QUERY if robust else QUERY}\s*(.*)\z"), F.lit(0)), F.lit(""))


def tool_name(c: Column) -> Column:
    """A tool's name without zero-width characters and look-alikes, in lower case."""
    return F.lower(F.translate(F.translate(c, ZERO_WIDTH, ""), CONFUSABLES_FROM, CONFUSABLES_TO))


def in_code_line(line: Column, call: Column) -> Column:
    """Whether a call's line is code: by its shape, or by an assignment outside the call."""
    return line.rlike(CODE_LINE) | F.replace(line, call, F.lit("")).rlike(ASSIGNMENT)


def tool_calls(c: Column, known: tuple[str, ...]) -> Column:
    """array<struct<name, args>> of calls of known tools, and of those that the text itself marks; a call lies in one line.

    A mark that names a tool without arguments takes the text after it as its arguments.
    """
    t = text_or_empty(c)
    marked = F.transform(F.regexp_extract_all(t, F.lit(r"\[Tool:\s*([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)), tool_name)
    registry = F.array_union(F.array(*map(F.lit, known)), marked)

    def of_line(line: Column) -> Column:
        calls = F.transform(F.regexp_extract_all(line, F.lit(CALL), F.lit(0)), lambda x: F.struct(x.alias("call"), tool_name(F.regexp_extract(x, CALL, 1)).alias("name"), F.regexp_extract(x, CALL, 2).alias("args")))
        return F.transform(F.filter(calls, lambda x: F.array_contains(registry, x["name"]) & ~in_code_line(line, x["call"])), lambda x: F.struct(x["name"].alias("name"), x["args"].alias("args")))

    plain = F.flatten(F.transform(F.split(t, "\n"), of_line))
    name = F.trim(F.regexp_extract(t, TOOL_MARK, 1))
    after = _strip(F.regexp_extract(t, rf"(?s){TOOL_MARK}(.*)\z", 2))
    bare = F.when((name != "") & ~name.rlike(rf"^{CALL}$"), F.array(F.struct(name.alias("name"), after.alias("args")))).otherwise(F.array().cast("array<struct<name:string,args:string>>"))
    return F.concat(plain, bare)


def parsed(c: Column, known: tuple[str, ...] = (), robust: bool = True) -> Column:
    """struct<turns, documents, query, calls>; a text without any mark is one turn, one with a tool's mark only is what
    stands before it."""
    t, d = turns(c, robust), documents(c, robust)
    none, mark = (F.size(t) == 0) & (F.size(d) == 0), text_or_empty(c).rlike(TOOL_MARK)
    before = F.filter(F.array(_strip(F.regexp_extract(text_or_empty(c), rf"(?s)\A(.*?){TOOL_MARK}", 1))), lambda x: x != "")
    said = F.when(none & mark, before).when(none, F.array(_strip(text_or_empty(c)))).otherwise(t)
    return F.struct(said.alias("turns"), d.alias("documents"), user_query(c, robust).alias("query"), tool_calls(c, known).alias("calls"))


def conversation_turns(c: Column, leftovers: tuple[str, ...] = ()) -> Column:
    """Turns of a marked conversation, else its lines, without leftovers of how it was made."""
    lines = F.filter(F.transform(F.split(text_or_empty(c), "\n"), _strip), lambda x: x != "")
    marked = _parts(c, rf"{TURN}\s*(.*?)(?={TURN}|\z)")
    out = F.when(F.size(marked) > 0, marked).otherwise(lines)
    without = lambda x: lambda t: _strip(F.replace(t, F.lit(x), F.lit("")))
    for x in leftovers:
        out = F.transform(out, without(x))
    return F.filter(out, lambda x: x != "")


def split_turns(c: Column) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(c), rf"{TURN}\s*"), _strip), lambda x: x != "")
