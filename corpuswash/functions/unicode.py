"""Invisible characters and typography as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuswash.options import TextOptions
from corpuswash.schema import bind, finding, none

#: Code points of each category (fixed values).  A byte order mark that starts a text is no finding.
CATEGORIES: dict[str, list[tuple[int, int]]] = {
    "zero-width": [(0x200B, 0x200C), (0x2060, 0x2060), (0x00AD, 0x00AD), (0x061C, 0x061C), (0x200E, 0x200F), (0xFEFF, 0xFEFF)],
    "zero-width-joiner": [(0x200D, 0x200D)],
    "bidi-control": [(0x202A, 0x202E), (0x2066, 0x2069)],
    "unicode-tag": [(0xE0000, 0xE007F)],
    "variation-selector": [(0xE0100, 0xE01EF)],
}
#: Typographic characters, their kind and plain form (fixed values).
TYPOGRAPHY: list[tuple[str, str, str]] = [
    ("curly-quote", "\u2018\u2019\u201a\u201b", "'"),
    ("curly-quote", "\u201c\u201d\u201e\u201f", '"'),
    ("dash", "\u2013\u2014", "-"),
    ("non-breaking-space", "\u00a0\u202f", " "),
]


def char_class(categories: list[str]) -> str:
    """A regular expression class, the same for Java and RE2."""
    ranges = [r for c in categories for r in CATEGORIES[c]]
    return "[" + "".join(f"\\x{{{a:04X}}}" if a == b else f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges) + "]"


_NOT_FIRST_MARK = r"(?<!^\x{FEFF})"  # after the class, so that it is looked at for hits only
_TYPOGRAPHIC = "[" + "".join(chars for _, chars, _ in TYPOGRAPHY) + "]"


def category_of(codepoint: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, ranges in CATEGORIES.items():
        hit = F.lit(False)
        for a, b in ranges:
            hit = hit | codepoint.between(a, b)
        out = F.when(hit, name).otherwise(out)
    return out


def typography_kind(char: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in dict.fromkeys(k for k, _, _ in TYPOGRAPHY):
        chars = [c for k, cs, _ in TYPOGRAPHY if k == kind for c in cs]
        out = F.when(char.isin(chars), kind).otherwise(out)
    return out


def invisible_chars(text: Column) -> Column:
    """All invisible characters of the text, in order."""
    return F.regexp_extract_all(text, F.lit(char_class(list(CATEGORIES)) + _NOT_FIRST_MARK), F.lit(0))


def typographic_chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({_TYPOGRAPHIC})"), F.lit(1))


def counted(chars: Column, family: str) -> Column:
    """One finding per different character with its count, in order of first occurrence."""
    kind = category_of if family == "invisible" else None

    def one(joined: Column, c: Column, i: Column) -> Column:
        cp = F.ascii(c)
        name = kind(cp) if kind else typography_kind(c)
        n = F.length(joined) - F.length(F.replace(joined, c, F.lit("")))
        return finding(family, category=name, label=F.format_string("U+%04X", cp), codepoint=cp, count=n, ordinal=i)

    return F.coalesce(bind(chars, lambda a: bind(F.array_join(a, ""), lambda joined: F.transform(F.array_distinct(a), lambda c, i: one(joined, c, i)))), none())


def inspect_invisible(text: Column) -> Column:
    return counted(invisible_chars(text), "invisible")


def inspect_typography(text: Column) -> Column:
    return counted(typographic_chars(text), "typography")


def removed_categories(options: TextOptions) -> list[str]:
    wanted = {
        "zero-width": options.strip_zero_width, "zero-width-joiner": options.strip_zero_width_joiner, "bidi-control": options.strip_bidi_controls,
        "unicode-tag": options.strip_unicode_tags, "variation-selector": options.strip_variation_selectors,
    }
    return [c for c in CATEGORIES if wanted[c]]


def strip_invisible(text: Column, options: TextOptions = TextOptions()) -> Column:
    gone = removed_categories(options)
    return F.regexp_replace(text, char_class(gone) + _NOT_FIRST_MARK, "") if gone else text


def normalize_typography(text: Column) -> Column:
    return F.translate(text, "".join(cs for _, cs, _ in TYPOGRAPHY), "".join(p * len(cs) for _, cs, p in TYPOGRAPHY))
