"""HTML and SVG metadata as Column expressions.

A text is cut into tokens by one regular expression whose alternatives also cover unterminated constructs (then
the rest is one token, kept as it is); tokens are judged, findings listed, and the kept ones joined again.
Quantifiers over long runs are possessive, so the matcher's stack stays flat on tags of any size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuswash.functions.frontmatter import is_identifying
from corpuswash.schema import finding, none

_INNER = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""
_NAME_END = r"(?=[/>]|(?U:\s))"
HTML_TOKEN = rf"""(?is)<!--.*?-->|<!--.*\z|<meta{_NAME_END}{_INNER}|<meta{_NAME_END}.*\z|[^<]++|<"""
_META = rf"(?is)^<meta{_NAME_END}{_INNER}$"
_ATTR = r"""([^\s=>/][^\s=>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?"""
_SVG_META = r"<(?i:metadata)" + _NAME_END
SVG_TOKEN = rf"""(?s)<!--.*?-->|<!--.*\z|{_SVG_META}(?:[^"'>]++|"[^"]*+"|'[^']*+')*+(?<=/)>|{_SVG_META}{_INNER}.*?</metadata>|<(?!/){_INNER}|[^<]++|<"""
_SVG_ATTR = r"""(?s)^<[^\s/>]*|(?U:\s)*[/>].*$|(?U:\s)*[^=\s>/]+(?:\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?"""
_EDITOR_ATTR = r"(?i)^\s+(inkscape|sodipodi):"
PREVIEW = 60


def preview(text: Column) -> Column:
    """text on one line, cut after PREVIEW characters."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > PREVIEW, F.concat(F.substring(flat, 1, PREVIEW), F.lit("\u2026"))).otherwise(flat)


def _comment_body(token: Column) -> Column:
    return F.regexp_extract(token, r"(?s)^<!--(.*)-->$", 1)


def _is_comment(token: Column) -> Column:
    return token.rlike(r"(?s)^<!--.*-->$")


def _attributes(token: Column) -> Column:
    body = F.substring(token, 6, 1 << 30)
    part = lambda k: F.regexp_extract_all(body, F.lit(_ATTR), F.lit(k))
    return F.transform(
        F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d")),
        lambda x: F.struct(F.lower(x["a"]).alias("name"), F.concat(x["b"], x["c"], x["d"]).alias("value")),
    )


def _first(attributes: Column, *names: str) -> Column:
    return F.get(F.filter(attributes, lambda a: a["name"].isin(*names)), F.lit(0))["value"]


def html_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HTML_TOKEN), F.lit(0))


def _html_comment(token: Column) -> Column:
    return _is_comment(token) & ~token.rlike(r"^<!--(?U:\s)*\[[iI][fF]")


def _html_meta(token: Column) -> Column:
    return token.rlike(_META) & F.coalesce(is_identifying(_first(_attributes(token), "name", "property")), F.lit(False))


def inspect_html(tokens: Column) -> Column:
    """Findings of the tokens of an HTML text."""
    dropped = F.filter(tokens, lambda t: _html_comment(t) | _html_meta(t))

    def one(t: Column, i: Column) -> Column:
        comment, attributes = _is_comment(t), _attributes(t)
        return finding(
            "html",
            category=F.when(comment, "comment").otherwise("meta"),
            label=F.when(comment, "comment").otherwise(F.lower(_first(attributes, "name", "property"))),
            value=F.when(comment, preview(_comment_body(t))).otherwise(F.coalesce(_first(attributes, "content"), F.lit(""))),
            ordinal=i,
        )

    return F.coalesce(F.transform(dropped, one), none())


def strip_html(tokens: Column) -> Column:
    return F.array_join(F.filter(tokens, lambda t: ~(_html_comment(t) | _html_meta(t))), "")


def svg_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SVG_TOKEN), F.lit(0))


def _svg_metadata(token: Column) -> Column:
    return token.rlike(r"(?s)^" + _SVG_META) & token.rlike(r"(?s)(/>|</metadata>)$")


def _svg_parts(token: Column) -> Column:
    """Name, attributes with their leading blanks, and end of a tag."""
    return F.regexp_extract_all(token, F.lit(_SVG_ATTR), F.lit(0))


def _is_tag(token: Column) -> Column:
    return token.rlike(r"(?s)^<[^/].*>$") & ~token.startswith("<!--")


def inspect_svg(tokens: Column) -> Column:
    """Findings of the tokens of an SVG text, in document order."""

    def one(t: Column) -> Column:
        body = F.regexp_extract(t, rf"""(?s)^{_SVG_META}(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>(.*)</metadata>$""", 1)
        whole = F.when(_is_comment(t), F.array(finding("svg", category=F.lit("comment"), label=F.lit("comment"), value=preview(_comment_body(t)))))
        whole = whole.when(_svg_metadata(t), F.array(finding("svg", category=F.lit("metadata-element"), label=F.lit("metadata"), value=preview(body))))
        own = F.filter(_svg_parts(t), lambda p: p.rlike(_EDITOR_ATTR))

        def attr(p: Column) -> Column:
            name = F.trim(F.regexp_extract(p, r"(?s)^\s+([^=\s]+)", 1))
            value = F.regexp_extract(p, r"""(?s)=\s*(?:"([^"]*)"|'([^']*)'|(\S*))$""", 1)
            other = F.concat(F.regexp_extract(p, r"""(?s)=\s*'([^']*)'$""", 1), F.regexp_extract(p, r"""(?s)=\s*([^\s"'][^\s]*)$""", 1))
            return finding("svg", category=F.lit("namespaced-attr"), label=name, value=F.concat(value, other))

        return whole.when(_is_tag(t), F.transform(own, attr)).otherwise(none())

    found = F.flatten(F.transform(tokens, one))
    return F.coalesce(F.transform(found, lambda f, i: f.withField("ordinal", i)), none())


def strip_svg(tokens: Column) -> Column:
    kept = F.filter(tokens, lambda t: ~(_is_comment(t) | _svg_metadata(t)))
    return F.array_join(F.transform(kept, lambda t: F.when(_is_tag(t), F.array_join(F.filter(_svg_parts(t), lambda p: ~p.rlike(_EDITOR_ATTR)), "")).otherwise(t)), "")
