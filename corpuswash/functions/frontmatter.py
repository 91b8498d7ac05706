"""Markdown frontmatter: identifying keys found and removed, line by line, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuswash.schema import finding, none

#: Keys that name an author, tool or model, without hyphens and underscores (fixed values).
IDENTIFYING_KEYS = [
    "author", "authors", "creator", "editor", "contributor", "lastmodifiedby", "generator", "poweredby", "tool", "model", "aimodel", "ai",
    "aigenerated", "assistant", "prompt", "sourcemodel", "og:generator",
]

_SPACE_ENDS = r"(?U)^\s+|\s+$"


def is_identifying(key: Column) -> Column:
    return F.lower(F.translate(key, "-_", "")).isin(IDENTIFYING_KEYS)


def _raw(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _lines(text: Column) -> Column:
    return F.transform(_raw(text), lambda x: F.regexp_replace(x, r"\r+$", ""))


def _close(lines: Column) -> Column:
    """Place of the closing line among the lines after the first (from 1), or 0."""
    rest = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    return F.array_position(F.transform(rest, lambda x: x.isin("---", "...")), True).cast("int")


def has_frontmatter(text: Column) -> Column:
    lines = _lines(text)
    # Lines are split only where the text starts like frontmatter.
    return F.coalesce(F.when(text.startswith("---"), (F.size(lines) > 1) & (lines[0] == "---") & (_close(lines) > 0)), F.lit(False))


def _key(line: Column) -> Column:
    """The key of a key line, else null: no leading blank or hyphen, a colon, no blank inside the key."""
    head = F.regexp_replace(F.substring_index(line, ":", 1), _SPACE_ENDS, "")
    shaped = line.contains(":") & ~line.rlike(r"^((?U:\s)|-)") & (head != "") & ~head.rlike(r"(?U:\s)")
    return F.when(shaped, head)


def _identifying_line(line: Column) -> Column:
    return F.coalesce(is_identifying(_key(line)), F.lit(False))


def _value_of(line: Column) -> Column:
    tail = F.concat_ws(":", F.slice(F.split(line, ":", -1), 2, F.size(F.split(line, ":", -1))))
    return F.regexp_replace(tail, _SPACE_ENDS, "")


def inspect_frontmatter(text: Column) -> Column:
    lines = _lines(text)
    body = F.slice(lines, 2, F.greatest(_close(lines) - 1, F.lit(0)))
    found = F.transform(F.filter(body, _identifying_line), lambda x, i: finding("frontmatter", category=F.lit("key"), label=_key(x), value=_value_of(x), ordinal=i))
    return F.when(has_frontmatter(text), found).otherwise(none())


def strip_frontmatter(text: Column) -> Column:
    raw, lines = _raw(text), _lines(text)
    close = _close(lines)
    body = F.filter(F.slice(lines, 2, F.greatest(close - 1, F.lit(0))), lambda x: ~_identifying_line(x))
    rest = F.slice(raw, close + 2, F.size(raw))
    joined = F.array_join(F.concat(F.slice(raw, 1, 1), body, F.array(F.element_at(lines, close + 1)), rest), "\n")
    return F.when(has_frontmatter(text), joined).otherwise(text)
