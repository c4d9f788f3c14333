"""Column functions over symbol ids: M:Ns.Type.Member(args), T:Ns.Type, F:Ns.Type.Field."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare(sym: Column) -> Column:
    """The id without kind prefix, parameters and arity marks."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(sym, "(", 1), r"^[A-Z!]:", ""), r"`+[0-9]+", "")


def declaring_type(sym: Column) -> Column:
    return F.regexp_extract(bare(sym), r"^(.*)\.[^.]+$", 1)


def member(sym: Column) -> Column:
    return F.regexp_extract(bare(sym), r"([^.]+)$", 1)


def _parts(tokens: Column, mark: str, opening: str, closing: str) -> Column:
    """Tokens joined up to each mark that stands outside all brackets, in one pass; spaces never double."""
    zero = F.struct(F.lit(0).alias("deep"), F.expr("cast(array() as array<string>)").alias("parts"), F.lit("").alias("own"))

    def step(acc, t):
        ends = (t == mark) & (acc["deep"] == 0)
        deep = acc["deep"] + F.when(t.isin(*opening), 1).when(t.isin(*closing), -1).otherwise(0)
        own = F.when(ends, "").when((t == " ") & F.endswith(acc["own"], F.lit(" ")), acc["own"]).otherwise(F.concat(acc["own"], t))
        return F.struct(deep.alias("deep"), F.when(ends, F.concat(acc["parts"], F.array(acc["own"]))).otherwise(acc["parts"]).alias("parts"), own.alias("own"))

    parts = F.aggregate(tokens, zero, step, lambda acc: F.concat(acc["parts"], F.array(acc["own"])))
    return F.transform(parts, lambda x: F.trim(x))


def top_level(text: Column, separator: str = ",", opening: str = "<([{", closing: str = ">)]}") -> Column:
    """The trimmed parts of a list whose separators inside brackets, however deep, don't count."""
    return _parts(F.split(text, ""), separator, opening, closing)


def arity(sym: Column) -> Column:
    """Parameters of a method id: commas outside all brackets, plus one."""
    inner = F.regexp_extract(sym, r"\((.*)\)", 1)
    return F.when(inner == "", F.lit(0)).otherwise(F.size(top_level(inner)))


def part(text: Column, n: Column) -> Column:
    """The nth part, from 0, of a list of display types; null where there is none."""
    return F.when((F.trim(text) != "") & (n >= 0), F.get(top_level(text, ",", "<([", ">)]"), n))


def listed(text: Column, n: Column) -> Column:
    """The nth string, from 0, of a JSON array; null where there is none."""
    return F.when(n >= 0, F.get(F.from_json(text, "array<string>"), n))


#: Literals, comments and spaces, the mark, and any other character of a condition.
_LITERAL = r"""(?s)"(?:\\.|[^"\\])*+"?|'(?:\\.|[^'\\])*+'?"""
_BLANK = r"""//[^\n]*+\n?|/\*.*?(?:\*/|\z)|\s+"""


def conjuncts(text: Column) -> Column:
    """The clauses of a condition, sorted and once each, by its outermost &&: comments go, spaces become one, literals stay."""
    tokens = F.regexp_extract_all(text, F.lit(f"{_LITERAL}|{_BLANK}|&&|."), F.lit(0))
    tokens = F.transform(tokens, lambda t: F.when(t.rlike(f"(?s)^(?:{_BLANK})$"), " ").otherwise(t))
    return F.array_sort(F.array_distinct(F.filter(_parts(tokens, "&&", "([{", ")]}"), lambda c: c != "")))


def simple_name(sym: Column) -> Column:
    return F.substring_index(bare(sym), ".", -1)


def resource_key(sym: Column, suffixes: list[str]) -> Column:
    """The simple type name without the longest of the suffixes, unless nothing would be left."""
    name = F.substring_index(F.regexp_extract(F.regexp_replace(sym, "^.:", ""), "^([^<`{]*)", 1), ".", -1)
    out = name
    for s in sorted(suffixes, key=lambda s: (len(s), s)):
        out = F.when(name.endswith(s) & (F.length(name) > len(s)), F.substring(name, F.lit(1), F.length(name) - len(s))).otherwise(out)
    return F.nullif(out, F.lit(""))


def glob(pattern: str) -> str:
    """A regular expression for **, * and ? over paths."""
    parts = re.split(r"(\*\*/?|\*|\?)", pattern)
    return "^" + "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + "$"


def wildcard(head: Column, pattern: str) -> Column:
    """Segments of the pattern in order, without regard to case, in what stands before the parameters."""
    return F.substring_index(head, "(", 1).rlike("(?i)^.:?" + ".*".join(re.escape(p) for p in pattern.split("*")))


def within(actual: Column, gate: Column) -> Column:
    """actual is the gate or lies below it."""
    return (actual == gate) | F.startswith(actual, F.concat(gate, F.lit(".")))


def whole_word(text: Column, word: Column) -> Column:
    """Whether an identifier stands in a text with no letter, digit or underscore beside it."""
    return F.coalesce(F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{Nd}_])\Q"), word, F.lit(r"\E(?![\p{L}\p{Nd}_])"))), F.lit(False))


def http_resource(text: Column) -> Column:
    """A URL without its scheme and closing slashes; a path without its opening ones."""
    return F.when(F.contains(text, F.lit("://")), F.rtrim(F.regexp_replace(text, "^(?s:.*?)://", ""), F.lit("/"))).otherwise(F.ltrim(text, F.lit("/")))


def packed(text: Column, names: list[str]) -> Column:
    """A list packed with U+001E between records and U+001F between fields, as an array of structs."""
    rows = F.filter(F.split(text, "\u001e"), lambda x: x != "")
    return F.transform(rows, lambda r: F.struct(*(F.get(F.split(r, "\u001f"), F.lit(k)).alias(n) for k, n in enumerate(names))))
