"""Inspecting and cleaning DataFrames of texts.

A text's extension decides which passes run: frontmatter for md and markdown, HTML tags for html and htm, SVG for
svg; invisible characters always.  Cleaning runs the passes one after the other, invisible characters last, as
they are documented; ``repeat_until_stable`` runs them again (a fixed number of times), since a removed invisible
character can complete a key or tag.

Null text gives null cleaned text, no findings and ok = true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswash.functions import frontmatter, markup, style, unicode
from corpuswash.options import InspectTextOptions, TextOptions
from corpuswash.schema import bind, none

MARKDOWN, HTML, SVG = ("md", "markdown"), ("html", "htm"), ("svg",)


def inspect_text(df: DataFrame, text: str = "text", ext: Column | None = None, options: InspectTextOptions = InspectTextOptions()) -> DataFrame:
    """df with char_count, findings (one array over all passes, each on the original text) and is_clean."""
    t, e = F.col(text), F.lower(ext) if ext is not None else F.lit("txt")
    passes = {
        "invisible": unicode.inspect_invisible(t),
        "frontmatter": F.when(e.isin(*MARKDOWN), frontmatter.inspect_frontmatter(t)).otherwise(none()),
        "html": F.when(e.isin(*HTML), bind(markup.html_tokens(t), markup.inspect_html)).otherwise(none()),
        "svg": F.when(e.isin(*SVG), bind(markup.svg_tokens(t), markup.inspect_svg)).otherwise(none()),
        "typography": unicode.inspect_typography(t),
    }
    if options.style:
        passes["style"] = style.inspect_style(t)
    wanted = [p for family, p in passes.items() if options.families is None or family in options.families]
    out = df.withColumn("char_count", F.length(t).cast("bigint")).withColumn("findings", F.coalesce(F.concat(*wanted), none()) if wanted else none())
    return out.withColumn("is_clean", F.size("findings") == 0)


def clean_text(df: DataFrame, text: str = "text", ext: Column | None = None, options: TextOptions = TextOptions(), rounds: int = 1) -> DataFrame:
    """df with cleaned, chars_in and chars_out."""
    e = F.lower(ext) if ext is not None else F.lit("txt")
    out = df.withColumn("cleaned", F.col(text))
    for _ in range(rounds):
        c = F.col("cleaned")
        out = out.withColumn("cleaned", F.when(e.isin(*MARKDOWN), frontmatter.strip_frontmatter(c)).otherwise(c))
        out = out.withColumn("cleaned", F.when(e.isin(*HTML), markup.strip_html(markup.html_tokens(c))).when(e.isin(*SVG), markup.strip_svg(markup.svg_tokens(c))).otherwise(c))
        if options.normalize_typography:
            out = out.withColumn("cleaned", unicode.normalize_typography(c))
        out = out.withColumn("cleaned", unicode.strip_invisible(c, options))
    return out.withColumn("chars_in", F.length(text).cast("bigint")).withColumn("chars_out", F.length("cleaned").cast("bigint"))


def clean_text_report(df: DataFrame, text: str = "text", ext: Column | None = None, options: TextOptions = TextOptions()) -> DataFrame:
    """clean_text's columns and what each pass removed from the text as it found it: removed, frontmatter_keys_removed,
    html_findings_removed, svg_findings_removed, typography_normalized."""
    e = F.lower(ext) if ext is not None else F.lit("txt")
    c, nothing = F.col("cleaned"), none()
    out = df.withColumn("cleaned", F.col(text))
    out = out.withColumn("frontmatter_keys_removed", F.transform(F.when(e.isin(*MARKDOWN), frontmatter.inspect_frontmatter(c)).otherwise(nothing), lambda f: f["label"]))
    out = out.withColumn("cleaned", F.when(e.isin(*MARKDOWN), frontmatter.strip_frontmatter(c)).otherwise(c))
    out = out.withColumn("html_findings_removed", F.when(e.isin(*HTML), bind(markup.html_tokens(c), markup.inspect_html)).otherwise(nothing))
    out = out.withColumn("svg_findings_removed", F.when(e.isin(*SVG), bind(markup.svg_tokens(c), markup.inspect_svg)).otherwise(nothing))
    out = out.withColumn("cleaned", F.when(e.isin(*HTML), markup.strip_html(markup.html_tokens(c))).when(e.isin(*SVG), markup.strip_svg(markup.svg_tokens(c))).otherwise(c))
    out = out.withColumn("typography_normalized", unicode.inspect_typography(c) if options.normalize_typography else nothing)
    if options.normalize_typography:
        out = out.withColumn("cleaned", unicode.normalize_typography(c))
    gone = unicode.removed_categories(options)
    out = out.withColumn("removed", F.filter(unicode.inspect_invisible(c), lambda f: f["category"].isin(gone)))
    out = out.withColumn("cleaned", unicode.strip_invisible(c, options))
    return out.withColumn("chars_in", F.length(text).cast("bigint")).withColumn("chars_out", F.length("cleaned").cast("bigint"))


def repeat_until_stable(df: DataFrame, text: str = "text", ext: Column | None = None, options: TextOptions = TextOptions(), rounds: int = 3) -> DataFrame:
    """Cleaning whose result does not change when it is cleaned again, for texts nested up to `rounds` deep."""
    return clean_text(df, text, ext, options, rounds)
