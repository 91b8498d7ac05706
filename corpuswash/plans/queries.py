"""Registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswash.functions import frontmatter, markup, style, unicode
from corpuswash.operators import report
from corpuswash.operators.text import clean_text, inspect_text
from corpuswash.options import InspectTextOptions, TextOptions
from corpuswash.plans import overlay
from corpuswash.plans.overlay import DIRTY, DRAWN, FRONTED, HEADED, STYLED, TYPED
from corpuswash.sources.files import image_format

QUERIES: dict = {}
ORACLES: dict = {}
_ROLE_RULE = "CASE WHEN conv_id % 3 = 0 THEN replace(text, ' ', ' \u200b') ELSE text END"


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def _class(*categories: str) -> str:
    return unicode.char_class(list(categories or unicode.CATEGORIES))


def _category_sql(cp: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'{cp} BETWEEN {a} AND {b}' for a, b in ranges)} THEN '{name}'" for name, ranges in unicode.CATEGORIES.items())
    return f"CASE {cases} END"


#: Invisible characters of t in DuckDB: a byte order mark that starts the text is left out.
_BODY = "CASE WHEN starts_with(t, chr(65279)) THEN substr(t, 2) ELSE t END"
_INVISIBLE = f"SELECT doc_id, unnest(regexp_extract_all({_BODY}, '{_class()}')) AS c FROM d"
_STRIPPED = f"CASE WHEN starts_with(t, chr(65279)) THEN chr(65279) ELSE '' END || regexp_replace({_BODY}, '{_class(*[c for c in unicode.CATEGORIES if c != 'zero-width-joiner'])}', '', 'g')"
_D = f"WITH d AS (SELECT doc_id, {DIRTY} AS t FROM documents)"


@query("invisible_counts_by_codepoint", f"{_D}, x AS ({_INVISIBLE}) SELECT {_category_sql('unicode(c)')} AS category, unicode(c) AS codepoint, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM x GROUP BY 1, 2")
def invisible_counts_by_codepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlay.documents(spark, sf_dir, DIRTY).select("doc_id", F.explode(unicode.inspect_invisible(F.col("t"))).alias("f"))
    return found.groupBy("f.category", "f.codepoint").agg(F.sum("f.count").alias("occurrences"), F.count("*").alias("docs"))


@query("invisible_counts_by_category", f"{_D}, x AS ({_INVISIBLE}) SELECT {_category_sql('unicode(c)')} AS category, count(*) AS occurrences FROM x GROUP BY 1")
def invisible_counts_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = overlay.documents(spark, sf_dir, DIRTY).select(F.explode(unicode.invisible_chars(F.col("t"))).alias("c"))
    return chars.groupBy(unicode.category_of(F.ascii("c")).alias("category")).agg(F.count("*").alias("occurrences"))


@query("invisible_first_occurrence", f"""{_D}, x AS (SELECT doc_id, unnest(regexp_extract_all({_BODY}, '{_class()}')) AS c, generate_subscripts(regexp_extract_all({_BODY}, '{_class()}'), 1) AS i FROM d),
g AS (SELECT doc_id, unicode(c) AS codepoint, count(*) AS occurrences, min(i) AS i FROM x GROUP BY 1, 2)
SELECT doc_id, codepoint, occurrences, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS ordinal FROM g""")
def invisible_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlay.documents(spark, sf_dir, DIRTY).select("doc_id", F.explode(unicode.inspect_invisible(F.col("t"))).alias("f"))
    return found.select("doc_id", "f.codepoint", F.col("f.count").alias("occurrences"), "f.ordinal")


@query("invisible_clean_lengths", f"{_D} SELECT doc_id, length(t) AS chars_in, length({_STRIPPED}) AS chars_out FROM d")
def invisible_clean_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_text(overlay.documents(spark, sf_dir, DIRTY), "t").select("doc_id", "chars_in", "chars_out")


@query("invisible_clean_text", f"{_D} SELECT doc_id, {_STRIPPED} AS cleaned FROM d")
def invisible_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_text(overlay.documents(spark, sf_dir, DIRTY), "t").select("doc_id", "cleaned")


@query("invisible_clean_options", f"{_D} SELECT doc_id, length(CASE WHEN starts_with(t, chr(65279)) THEN chr(65279) ELSE '' END || regexp_replace({_BODY}, '{_class('zero-width', 'zero-width-joiner', 'variation-selector')}', '', 'g')) AS chars_out FROM d")
def invisible_clean_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = TextOptions(strip_zero_width_joiner=True, strip_bidi_controls=False, strip_unicode_tags=False)
    return clean_text(overlay.documents(spark, sf_dir, DIRTY), "t", options=options).select("doc_id", "chars_out")


_TYPOGRAPHIC = "[" + "".join(chars for _, chars, _ in unicode.TYPOGRAPHY) + "]"
_KIND_SQL = "CASE " + " ".join(f"WHEN contains('{chars}', c) THEN '{kind}'" for kind, chars, _ in unicode.TYPOGRAPHY) + " END"
_PLAIN_FROM = "".join(chars for _, chars, _ in unicode.TYPOGRAPHY)
_PLAIN_TO = "".join(plain * len(chars) for _, chars, plain in unicode.TYPOGRAPHY).replace("'", "''")
_T = f"WITH d AS (SELECT doc_id, {TYPED} AS t FROM documents)"


@query("typography_counts", f"{_T}, x AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_TYPOGRAPHIC}')) AS c FROM d) SELECT {_KIND_SQL} AS kind, unicode(c) AS codepoint, count(*) AS occurrences FROM x GROUP BY 1, 2")
def typography_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlay.documents(spark, sf_dir, TYPED).select(F.explode(unicode.inspect_typography(F.col("t"))).alias("f"))
    return found.groupBy(F.col("f.category").alias("kind"), "f.codepoint").agg(F.sum("f.count").alias("occurrences"))


@query("typography_normalized", f"{_T} SELECT doc_id, translate(t, '{_PLAIN_FROM}', '{_PLAIN_TO}') AS cleaned FROM d")
def typography_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.documents(spark, sf_dir, TYPED).select("doc_id", unicode.normalize_typography(F.col("t")).alias("cleaned"))


_KEYS = ", ".join(f"'{k}'" for k in frontmatter.IDENTIFYING_KEYS)
_FRONT = f"""
WITH d AS (SELECT doc_id, string_split(t, chr(10)) AS raw FROM (SELECT doc_id, {FRONTED} AS t FROM documents)),
n AS (SELECT doc_id, raw, list_transform(raw, lambda x: regexp_replace(x, '\\r+$', '')) AS ln FROM d),
c AS (SELECT doc_id, raw, ln, CASE WHEN len(raw) > 1 AND ln[1] = '---' THEN coalesce(list_position(list_transform(ln[2:], lambda x: x IN ('---', '...')), true), 0) ELSE 0 END AS z FROM n)"""
_IS_KEY = f"regexp_matches(l, '^[^\\s:-][^\\s:]*[ \\t]*:') AND lower(translate(trim(string_split(l, ':')[1]), '-_', '')) IN ({_KEYS})"


@query("frontmatter_findings", f"""{_FRONT}, b AS (SELECT doc_id, unnest(list_filter(ln[2:z], lambda l: {_IS_KEY})) AS l FROM c WHERE z > 0)
SELECT doc_id, trim(string_split(l, ':')[1]) AS key, trim(substr(l, instr(l, ':') + 1)) AS value FROM b""")
def frontmatter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlay.documents(spark, sf_dir, FRONTED).select("doc_id", F.explode(frontmatter.inspect_frontmatter(F.col("t"))).alias("f"))
    return found.select("doc_id", F.col("f.label").alias("key"), F.col("f.value").alias("value"))


@query("frontmatter_stripped", f"""{_FRONT} SELECT doc_id, z > 0 AS had_frontmatter, CASE WHEN z > 0 THEN array_to_string(list_concat(raw[1:1], list_filter(ln[2:z], lambda l: NOT ({_IS_KEY})), ln[z + 1:z + 1], raw[z + 2:]), chr(10)) ELSE array_to_string(raw, chr(10)) END AS cleaned FROM c""")
def frontmatter_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = overlay.documents(spark, sf_dir, FRONTED)
    return docs.select("doc_id", frontmatter.has_frontmatter(F.col("t")).alias("had_frontmatter"), frontmatter.strip_frontmatter(F.col("t")).alias("cleaned"))


_PREVIEW = "CASE WHEN length({x}) > 60 THEN left({x}, 60) || '…' ELSE {x} END"
_SQUEEZED = "trim(regexp_replace(c, '\\s+', ' ', 'g'))"


@query("html_comment_findings", f"""WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1, 's')) AS c FROM pages)
SELECT page_id, {_PREVIEW.format(x=_SQUEEZED)} AS value FROM x WHERE NOT regexp_matches(c, '^\\s*\\[[iI][fF]')""")
def html_comment_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", markup.html_tokens(F.col("html")).alias("tokens"))
    found = pages.select("page_id", F.explode(markup.inspect_html(F.col("tokens"))).alias("f")).filter(F.col("f.category") == "comment")
    return found.select("page_id", F.col("f.value").alias("value"))


@query("html_meta_findings", """SELECT page_id, 'generator' AS label, 'Gen ' || page_id AS value FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'og:generator', 'x' FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'author', 'a > b' FROM pages WHERE page_id % 3 = 1""")
def html_meta_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = overlay.pages(spark, sf_dir).select("page_id", markup.html_tokens(F.col("t")).alias("tokens"))
    found = pages.select("page_id", F.explode(markup.inspect_html(F.col("tokens"))).alias("f")).filter(F.col("f.category") == "meta")
    return found.select("page_id", "f.label", "f.value")


@query("html_stripped", f"""WITH d AS (SELECT page_id, {HEADED} AS t FROM pages)
SELECT page_id, regexp_replace(regexp_replace(t, '<!--.*?-->', '', 'gs'), '<(?:meta|META) (?:name="generator"|property=og:generator|name="author")(?:[^"\\x27>]|"[^"]*")*>', '', 'g') AS cleaned FROM d""")
def html_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = overlay.pages(spark, sf_dir).select("page_id", markup.html_tokens(F.col("t")).alias("tokens"))
    return pages.select("page_id", markup.strip_html(F.col("tokens")).alias("cleaned"))


@query("svg_findings", """SELECT doc_id, 0 AS ordinal, 'namespaced-attr' AS kind, 'inkscape:version' AS label, '1.' || doc_id AS value FROM documents
UNION ALL SELECT doc_id, 1, 'metadata-element', 'metadata', 'm' || doc_id FROM documents UNION ALL SELECT doc_id, 2, 'comment', 'comment', 'c' || doc_id FROM documents
UNION ALL SELECT doc_id, 3, 'namespaced-attr', 'sodipodi:nodetypes', 'cc' FROM documents""")
def svg_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = overlay.documents(spark, sf_dir, DRAWN).select("doc_id", F.explode(markup.inspect_svg(markup.svg_tokens(F.col("t")))).alias("f"))
    return docs.select("doc_id", "f.ordinal", F.col("f.category").alias("kind"), "f.label", "f.value")


@query("svg_stripped", """SELECT doc_id, '<svg width="1"><path d="M0"/><title>' || lang || '</title></svg>' AS cleaned FROM documents""")
def svg_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.documents(spark, sf_dir, DRAWN).select("doc_id", markup.strip_svg(markup.svg_tokens(F.col("t"))).alias("cleaned"))


_S = f"WITH d AS (SELECT doc_id, {STYLED} AS t FROM documents)"
_WORDS = ", ".join(f"'{w}'" for w in style.WORDS if "-" not in w)
_PHRASES = ", ".join("'" + p.replace("'", "''") + "'" for p in style.PHRASES)


@query("style_vocabulary", f"""{_S}, x AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS w FROM d)
SELECT doc_id, w AS label, count(*) AS occurrences FROM x WHERE w IN ({_WORDS}) GROUP BY 1, 2
UNION ALL SELECT doc_id, 'cutting-edge', CAST((length(t) - length(replace(lower(t), 'cutting-edge', ''))) / 12 AS BIGINT) FROM d WHERE contains(lower(t), 'cutting-edge')""")
def style_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = overlay.documents(spark, sf_dir, STYLED).select("doc_id", F.explode(style.word_counts(F.col("t"))).alias("f"))
    return docs.select("doc_id", "f.label", F.col("f.count").alias("occurrences"))


@query("style_phrases", f"""{_S}, p AS (SELECT unnest([{_PHRASES}]) AS label)
SELECT doc_id, label, CAST((length(lower(t)) - length(replace(lower(t), label, ''))) / length(label) AS BIGINT) AS occurrences FROM d, p WHERE contains(lower(t), label)""")
def style_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = overlay.documents(spark, sf_dir, STYLED).select("doc_id", F.explode(style.phrase_counts(F.col("t"))).alias("f"))
    return docs.select("doc_id", "f.label", F.col("f.count").alias("occurrences"))


@query("style_burstiness", """WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: len(regexp_extract_all(x, '[^\\s]+'))), lambda n: n > 0) AS w FROM documents),
m AS (SELECT doc_id, len(w) AS sentences, list_sum(w) / len(w) AS mean, w FROM s WHERE len(w) >= 6)
SELECT doc_id, CAST(sentences AS INT) AS sentences, round(sqrt(list_sum(list_transform(w, lambda n: (n - mean) * (n - mean))) / sentences) / mean, 9) AS cv FROM m WHERE mean >= 3
AND sqrt(list_sum(list_transform(w, lambda n: (n - mean) * (n - mean))) / sentences) / mean < 0.35""")
def style_burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.select("doc_id", F.size(style.sentence_lengths(F.col("text"))).alias("sentences"), style.variation(F.col("text")).alias("cv"))
    return docs.filter(F.col("cv") < style.LOW_VARIATION).withColumn("cv", F.round("cv", 9))


@query("style_em_dash", f"""{_S}, x AS (SELECT doc_id, len(regexp_extract_all(t, '[^\\s]+')) AS words, length(t) - length(replace(t, chr(8212), '')) AS dashes FROM d)
SELECT doc_id, round(dashes / words * 1000.0, 9) AS rate FROM x WHERE words >= 100 AND dashes / words * 1000.0 >= 4""")
def style_em_dash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = overlay.documents(spark, sf_dir, STYLED).select("doc_id", style.dash_rate(F.col("t")).alias("rate"))
    return docs.filter(F.col("rate") >= style.DASHES_PER_1000).select("doc_id", F.round("rate", 9).alias("rate"))


_REPORT = InspectTextOptions(style=False)


@query("text_pipeline_clean", f"""WITH d AS (SELECT doc_id, {DIRTY.replace('text', '(' + TYPED + ')')} AS t FROM documents),
n AS (SELECT doc_id, t AS t0, translate(t, '{_PLAIN_FROM}', '{_PLAIN_TO}') AS t FROM d) SELECT doc_id, length(t0) AS chars_in, length({_STRIPPED}) AS chars_out, {_STRIPPED} AS cleaned FROM n""")
def text_pipeline_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = overlay.documents(spark, sf_dir, DIRTY.replace("text", f"({TYPED})"))
    return clean_text(docs, "t", F.lit("md"), TextOptions(normalize_typography=True)).select("doc_id", "chars_in", "chars_out", "cleaned")


@query("inspect_report_gate", f"""WITH d AS (SELECT doc_id, {DIRTY} AS t FROM documents), x AS (SELECT len(regexp_extract_all({_BODY}, '{_class()}')) + len(regexp_extract_all(t, '{_TYPOGRAPHIC}')) AS n FROM d)
SELECT count(*) AS files, count(*) FILTER (WHERE n > 0) AS files_with_findings, CAST(0 AS BIGINT) AS failures, bool_or(n > 0) AS failed FROM x""")
def inspect_report_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.gate(inspect_text(overlay.documents(spark, sf_dir, DIRTY), "t", options=_REPORT))


@query("clean_summary", "SELECT count(*) AS total, count(*) AS succeeded FROM documents")
def clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(clean_text(overlay.documents(spark, sf_dir, DIRTY), "t"), F.col("cleaned").isNotNull())


@query("findings_by_kind_pivot", """SELECT count(*) FILTER (WHERE page_id % 3 = 1) + 2 * count(*) FILTER (WHERE page_id % 3 = 0) AS meta, CAST(sum(len(regexp_extract_all(html, '<!--.*?-->', 0, 's'))) AS BIGINT) AS comment FROM pages""")
def findings_by_kind_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.kinds_pivot(inspect_text(overlay.pages(spark, sf_dir), "t", F.lit("html"), InspectTextOptions(families=("html",))), ["meta", "comment"])


@query("conversations_invisible_by_role", f"""WITH d AS (SELECT role, {_ROLE_RULE} AS t FROM conversations)
SELECT role, count(*) AS turns, CAST(sum(len(regexp_extract_all({_BODY}, '{_class()}'))) AS BIGINT) AS occurrences FROM d GROUP BY role""")
def conversations_invisible_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", F.expr(_ROLE_RULE).alias("t"))
    return rows.groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.size(unicode.invisible_chars(F.col("t")))).cast("bigint").alias("occurrences"))


@query("findings_top_sources", f"""WITH d AS (SELECT source, {DIRTY} AS t FROM documents)
SELECT source, CAST(sum(len(regexp_extract_all({_BODY}, '{_class()}'))) AS BIGINT) AS occurrences FROM d GROUP BY source ORDER BY occurrences DESC, source LIMIT 10""")
def findings_top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = overlay.documents(spark, sf_dir, DIRTY, "source")
    return docs.groupBy("source").agg(F.sum(F.size(unicode.invisible_chars(F.col("t")))).cast("bigint").alias("occurrences")).orderBy(F.desc("occurrences"), "source").limit(10)


_HEADS = ["FFD8FFE000104A4649460001", "89504E470D0A1A0A0000000D", "524946460000000057454250", "424D00000000000000000000", "474946383961010001000000", "49492A000800000000000000", "4D4D002A0000000800000000"]


@query("magic_format_detect", """WITH h AS (SELECT doc_id, ['FFD8FFE000104A4649460001','89504E470D0A1A0A0000000D','524946460000000057454250','424D00000000000000000000','474946383961010001000000','49492A000800000000000000','4D4D002A0000000800000000','504B030414000600'][doc_id % 8 + 1] AS x FROM documents)
SELECT doc_id, CASE WHEN starts_with(x, 'FFD8FF') THEN 'jpeg' WHEN starts_with(x, '89504E47') THEN 'png' WHEN starts_with(x, '52494646') THEN 'webp' WHEN starts_with(x, '424D') THEN 'bmp' WHEN starts_with(x, '474946') THEN 'gif' WHEN starts_with(x, '49492A00') OR starts_with(x, '4D4D002A') THEN 'tiff' END AS format FROM h""")
def magic_format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*[F.lit(h) for h in [*_HEADS, "504B030414000600"]])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.unhex(F.element_at(heads, (F.col("doc_id") % 8 + 1).cast("int"))).alias("content"))
    return docs.select("doc_id", image_format(F.col("content")).alias("format"))
