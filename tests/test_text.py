"""Row-level cases of the text operators."""

import pytest
from pyspark.sql import functions as F

from corpuswash.functions import frontmatter, markup, style, unicode
from corpuswash.operators.text import clean_text, inspect_text, repeat_until_stable
from corpuswash.options import InspectTextOptions, TextOptions

TAGGED = "text" + chr(0xE0001) + "".join(chr(0xE0000 + ord(c)) for c in "secret") + chr(0xE007F)
FAMILY = "\U0001f468‍\U0001f469‍\U0001f467"


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, cleaned",
    [
        ("The​quick⁠brown​fox", "Thequickbrownfox"),
        (FAMILY, FAMILY),
        (TAGGED, "text"),
        ("hidden\U000e0100\U000e0101payload", "hiddenpayload"),
        ("﻿Hello﻿World", "﻿HelloWorld"),
        ("invoice‮exe.txt", "invoiceexe.txt"),
        ("nothing unusual here.", "nothing unusual here."),
        ("line\n﻿next", "line\nnext"),
        ("", ""),
        (None, None),
    ],
)
def test_invisible_cleaned(spark, text, cleaned):
    assert one(spark, text, unicode.strip_invisible) == cleaned


def test_joiner_only_on_request(spark):
    assert one(spark, "a‍b", lambda c: unicode.strip_invisible(c, TextOptions(strip_zero_width_joiner=True))) == "ab"
    keep = TextOptions(strip_bidi_controls=False)
    assert one(spark, "a‮‏b", lambda c: unicode.strip_invisible(c, keep)) == "a‮b"


def test_invisible_findings_in_order_of_first_occurrence(spark):
    found = one(spark, "a‍b​c‍", unicode.inspect_invisible)
    assert [(f["category"], f["codepoint"], f["count"], f["ordinal"], f["label"]) for f in found] == [("zero-width-joiner", 0x200D, 2, 0, "U+200D"), ("zero-width", 0x200B, 1, 1, "U+200B")]
    assert one(spark, None, unicode.inspect_invisible) == []


@pytest.mark.parametrize("text, plain", [("“Hello,” she said, ‘it’s fine’.", "\"Hello,\" she said, 'it's fine'."), ("models—like this one–often", "models-like this one-often"), ("10 km and 3 pm", "10 km and 3 pm")])
def test_typography(spark, text, plain):
    assert one(spark, text, unicode.normalize_typography) == plain


FRONT = "---\ntitle: T\nauthor: Jane\ndate: 2024\ngenerator: x\ntags: [a]\n---\nbody author: stays\n"


@pytest.mark.parametrize(
    "text, cleaned",
    [
        (FRONT, "---\ntitle: T\ndate: 2024\ntags: [a]\n---\nbody author: stays\n"),
        ("---\nLast-Modified-By: x\n---\n", "---\n---\n"),
        ("author: x\nbody", "author: x\nbody"),
        ("---\nauthors:\n  - A\n---\n", "---\n  - A\n---\n"),
        ("---\nauthor: x\nbody", "---\nauthor: x\nbody"),
        ("---\r\ntitle: T\r\nauthor: J\r\n---\r\nbody\r\n", "---\r\ntitle: T\n---\nbody\r\n"),
        ("﻿---\nauthor: x\n---\n", "﻿---\nauthor: x\n---\n"),
        ("---", "---"),
        ("", ""),
        (None, None),
    ],
)
def test_frontmatter(spark, text, cleaned):
    assert one(spark, text, frontmatter.strip_frontmatter) == cleaned


def test_frontmatter_findings(spark):
    found = one(spark, FRONT, frontmatter.inspect_frontmatter)
    assert [(f["label"], f["value"]) for f in found] == [("author", "Jane"), ("generator", "x")]


@pytest.mark.parametrize(
    "html, cleaned, values",
    [
        ('<meta charset="u"><meta name="generator" content="G"><meta name="viewport" content="w">', '<meta charset="u"><meta name="viewport" content="w">', ["G"]),
        ('<meta name="author" content="Jane"><!-- by\n Jane --><p>x</p>', "<p>x</p>", ["Jane", "by Jane"]),
        ("<!--[if IE]>x<![endif]-->", "<!--[if IE]>x<![endif]-->", []),
        ("<p>a</p>", "<p>a</p>", []),
        ("a<!-- open <meta name=author content=x>", "a<!-- open <meta name=author content=x>", []),
        ('<metadata name="author">', '<metadata name="author">', []),
        ('<meta name="author" content="a > b">z', "z", ["a > b"]),
        ('<meta name="viewport" property="author">', '<meta name="viewport" property="author">', []),
        ('<meta name="dc.creator" content="x">', '<meta name="dc.creator" content="x">', []),
        ('<meta name="author" content="unclosed>', '<meta name="author" content="unclosed>', []),
        ("<日本 <META NAME=author>", "<日本 ", [""]),
        ("", "", []),
    ],
)
def test_html(spark, html, cleaned, values):
    tokens = one(spark, html, markup.html_tokens)
    assert "".join(tokens) == html
    assert one(spark, html, lambda c: markup.strip_html(markup.html_tokens(c))) == cleaned
    assert [f["value"] for f in one(spark, html, lambda c: markup.inspect_html(markup.html_tokens(c)))] == values


def test_preview_is_cut(spark):
    long = "<!--" + "a " * 100 + "-->"
    assert one(spark, long, lambda c: markup.inspect_html(markup.html_tokens(c)))[0]["value"] == ("a " * 30) + "…"


def test_huge_tag_does_not_overflow(spark):
    big = '<meta name="x" content="' + "y" * 400_000 + '">'
    assert one(spark, big, lambda c: markup.strip_html(markup.html_tokens(c))) == big


@pytest.mark.parametrize(
    "svg, cleaned, kinds",
    [
        ("<svg><!-- c --><metadata>m</metadata><path/></svg>", "<svg><path/></svg>", ["comment", "metadata-element"]),
        ("<svg><metadata/></svg>", "<svg></svg>", ["metadata-element"]),
        ('<svg inkscape:version="1" width="2"><g sodipodi:x=\'3\' INKSCAPE:y=4 id="q"/></svg>', '<svg width="2"><g id="q"/></svg>', ["namespaced-attr"] * 3),
        ("<svg><title>t</title><desc>d</desc></svg>", "<svg><title>t</title><desc>d</desc></svg>", []),
        ('<g title="inkscape:x">', '<g title="inkscape:x">', []),
        ("<METADATA>q</METADATA>", "<METADATA>q</METADATA>", []),
        ("<g><!-- open", "<g><!-- open", []),
    ],
)
def test_svg(spark, svg, cleaned, kinds):
    assert one(spark, svg, lambda c: markup.strip_svg(markup.svg_tokens(c))) == cleaned
    assert [f["category"] for f in one(spark, svg, lambda c: markup.inspect_svg(markup.svg_tokens(c)))] == kinds


def test_style(spark):
    found = one(spark, "We delve into an intricate landscape, really; underscore_delve. Not just a cutting-edge, cutting-edge.", style.inspect_style)
    assert [(f["category"], f["label"], f["count"]) for f in found] == [("vocabulary", "delve", 2), ("vocabulary", "underscore", 1), ("vocabulary", "intricate", 1), ("vocabulary", "landscape", 1), ("vocabulary", "cutting-edge", 2), ("phrase", "not just a", 1)]
    assert [f["label"] for f in one(spark, "One two three four. " * 6, style.inspect_style)] == ["uniform sentence length"]
    assert one(spark, "Short. Text.", style.inspect_style) == []
    assert [f["label"] for f in one(spark, "word " * 100 + "—", style.inspect_style)] == ["elevated em dash usage"]
    assert one(spark, None, style.inspect_style) == []


def test_style_of_texts_without_words(spark):
    """Neither an empty nor a blank text has a mean sentence length; the query leaves them out."""
    for text in ("", " \n", "...", None):
        assert one(spark, text, style.variation) is None
        assert one(spark, text, style.inspect_style) == []


def test_passes_by_extension_and_order(spark):
    rows = [("a.md", "---\nauthor: x\n---\nb​"), ("a.html", "<!-- c -->“q”"), ("a.svg", "<svg><metadata/></svg>"), ("a.txt", "<!-- c -->"), ("n.txt", None)]
    df = spark.createDataFrame(rows, "path string, text string")
    ext = F.regexp_extract("path", r"\.([^.]+)$", 1)
    got = {r["path"]: (r["cleaned"], r["chars_in"]) for r in clean_text(df, ext=ext).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a.md": "---\n---\nb", "a.html": "“q”", "a.svg": "<svg></svg>", "a.txt": "<!-- c -->", "n.txt": None}
    seen = {r["path"]: (len(r["findings"]), r["is_clean"], r["char_count"]) for r in inspect_text(df, ext=ext, options=InspectTextOptions(style=True)).collect()}
    assert seen["a.md"] == (2, False, 20) and seen["a.html"] == (3, False, 13) and seen["n.txt"] == (0, True, None)


def test_hidden_key_needs_another_round(spark):
    df = spark.createDataFrame([("---\naut​hor: x\n---\n",)], "text string")
    assert clean_text(df, ext=F.lit("md")).first()["cleaned"] == "---\nauthor: x\n---\n"
    assert repeat_until_stable(df, ext=F.lit("md")).first()["cleaned"] == "---\n---\n"
