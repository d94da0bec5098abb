"""Prompts from templates, replies of a model as JSON, and texts without glyphs that plain fonts lack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Glyphs and what is written instead.
GLYPHS = {
    "\u20b9": "Rs ", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2212": "-", "\u2013": "-", "\u2014": " - ", "\u2015": " - ",
    "\u00a0": " ", "\u202f": " ", "\u2009": " ", "\u200a": " ", "\u2007": " ", "\u200b": "", "\u2060": "", "\ufeff": "",
    "\u2192": "->", "\u2190": "<-", "\u2264": "<=", "\u2265": ">=", "\u00d7": "x",
}


def json_reply(raw: Column) -> Column:
    """The JSON of a reply without code fences, else that from its first { to its last }, else null."""
    text = F.regexp_replace(F.regexp_replace(raw, r"```(?:json)?", ""), r"^\s+|\s+$", "")
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(F.nullif(inner, F.lit(""))).isNotNull(), inner)


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """{key} replaced for these keys only, in order; other braces stay."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)


def plain_glyphs(text: Column) -> Column:
    """P01."""
    text = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), GLYPHS.items(), text)
    return F.regexp_replace(text, r"Rs\s+(?=\d)", "Rs ")


def table_cells(lines: Column) -> Column:
    """Array of rows of a Markdown pipe table, without separators, padded to the widest."""
    rows = F.transform(lines, lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|", -1), lambda c: F.trim(c)))
    rows = F.filter(rows, lambda r: F.exists(r, lambda c: (c != "") & ~c.rlike(r"^:?-{2,}:?$")))
    widest = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), widest - F.size(r))))


def bold(line: Column) -> Column:
    """A line for markup: special characters as entities, **words** bold."""
    safe = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), plain_glyphs(line))
    return F.regexp_replace(safe, r"\*\*(.+?)\*\*", "<b>$1</b>")
