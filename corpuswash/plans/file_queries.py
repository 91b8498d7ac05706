"""Registered queries over binary files, reports and names, and their DuckDB counterparts.

Files are made from whole table rows (samples.py); the SQL says what must be found in them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswash.functions import unicode
from corpuswash.operators import report
from corpuswash.operators.binaries import clean_files, inspect_files
from corpuswash.operators.images import inspect_images
from corpuswash.operators.text import clean_text_report, inspect_text
from corpuswash.options import InspectTextOptions, TextOptions
from corpuswash.plans import overlay, samples
from corpuswash.plans.overlay import DIRTY, HEADED, TYPED
from corpuswash.plans.queries import _BODY, _D, _INVISIBLE, _KIND_SQL, _TYPOGRAPHIC, _category_sql, _class, query
from corpuswash.plans.samples import raw, said
from corpuswash.sources.files import decode_utf8, kind_of


def _files(spark: SparkSession, sf_dir: str, content) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", content.alias("content"))


def _found(df: DataFrame, *fields: str) -> DataFrame:
    return df.select("doc_id", F.explode("findings").alias("f")).select("doc_id", *[f"f.{c}" for c in fields])


def _pick(by: int, *cases):
    """cases[doc_id % by]"""
    out = cases[-1]
    for k in range(len(cases) - 2, -1, -1):
        out = F.when(F.col("doc_id") % by == k, cases[k]).otherwise(out)
    return out


def _png():
    text = samples.png_chunk(b"tEXt", F.concat(raw(b"parameters\0"), said(F.col("text"))))
    author = samples.png_chunk(b"tEXt", F.concat(raw(b"Author\0"), said(F.col("source"))))
    gps = samples.png_chunk(b"eXIf", raw(samples.exif(0x8825)))
    return samples.png(_pick(4, text, author, F.concat(gps, samples.png_chunk(b"caBX", said(F.col("lang")))), raw(b"")))


@query("image_png_findings", """SELECT doc_id, 'ai-generator' AS category, 'generation parameters ("parameters")' AS label, CAST(11 + strlen(coalesce(text, '')) AS BIGINT) AS size_bytes, 0 AS ordinal, 4 AS width FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'unknown', 'text metadata ("Author")', 7 + strlen(coalesce(source, '')), 0, 4 FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, 'gps', 'EXIF with GPS location', 26, 0, 4 FROM documents WHERE doc_id % 4 = 2
UNION ALL SELECT doc_id, 'c2pa', 'content credentials (caBX)', strlen(coalesce(lang, '')), 1, 4 FROM documents WHERE doc_id % 4 = 2""")
def image_png_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inspect_images(_files(spark, sf_dir, _png()), key="doc_id").filter("ok AND format = 'png'")
    return found.select("doc_id", "width", F.explode("findings").alias("f")).select("doc_id", "f.category", "f.label", "f.size_bytes", "f.ordinal", "width")


_PNG_PLAIN = samples.PNG_START + samples.PNG_END


@query("image_png_cleaned", f"""SELECT doc_id, CAST({len(_PNG_PLAIN)} + CASE doc_id % 4 WHEN 0 THEN 23 + strlen(coalesce(text, '')) WHEN 1 THEN 19 + strlen(coalesce(source, '')) WHEN 2 THEN 50 + strlen(coalesce(lang, '')) ELSE 0 END AS BIGINT) AS bytes_in,
CAST({len(_PNG_PLAIN)} AS BIGINT) AS bytes_out, '{hashlib.md5(_PNG_PLAIN).hexdigest()}' AS digest FROM documents""")
def image_png_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_files(_files(spark, sf_dir, _png()), "image", key="doc_id").select("doc_id", "bytes_in", "bytes_out", F.md5("cleaned").alias("digest"))


@query("image_jpeg_findings", """SELECT doc_id, 'exif' AS category, 'EXIF metadata' AS label, CAST(32 AS BIGINT) AS size_bytes FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'ai-generator', 'generation parameters in a comment', 7 + strlen(coalesce(source, '')) FROM documents WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 'unknown', 'comment segment', strlen(coalesce(lang, '')) FROM documents WHERE doc_id % 3 = 2
UNION ALL SELECT doc_id, 'iptc', 'IPTC metadata (APP13)', 4 + strlen(coalesce(source, '')) FROM documents
UNION ALL SELECT doc_id, 'xmp', 'XMP metadata', 33 FROM documents UNION ALL SELECT doc_id, 'c2pa', 'provenance marker in XMP', 33 FROM documents""")
def image_jpeg_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    exif = samples.jpeg_segment(0xE1, raw(b"Exif\0\0" + samples.exif(0x0132)))
    steps = samples.jpeg_segment(0xFE, F.concat(raw(b"Steps: "), said(F.col("source"))))
    comment = samples.jpeg_segment(0xFE, said(F.col("lang")))
    iptc = samples.jpeg_segment(0xED, F.concat(raw(b"8BIM"), said(F.col("source"))))
    xmp = samples.jpeg_segment(0xE1, raw(b"http://ns.adobe.com/xap/1.0/\0c2pa"))
    whole = samples.jpeg(samples.jpeg_segment(0xE0, raw(b"JFIF\0")), _pick(3, exif, steps, comment), iptc, xmp)
    return _found(inspect_files(_files(spark, sf_dir, whole), "image", key="doc_id").filter("ok"), "category", "label", "size_bytes")


@query("image_webp_gif_findings", """SELECT page_id, 'webp' AS format, 'exif' AS category, CAST(26 AS BIGINT) AS size_bytes FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'webp', 'xmp', strlen(coalesce(url, '')) FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'gif', CASE WHEN page_id % 3 = 0 THEN 'ai-generator' ELSE 'unknown' END, CASE WHEN page_id % 3 = 0 THEN 6 ELSE 0 END + strlen(left(coalesce(url, ''), 60)) FROM pages WHERE page_id % 2 = 1""")
def image_webp_gif_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    webp = samples.webp(samples.webp_chunk(b"EXIF", raw(samples.exif(0x0110))), samples.webp_chunk(b"XMP ", said(F.col("url"))))
    gif = samples.gif(F.concat(F.when(F.col("page_id") % 3 == 0, raw(b"Steps:")).otherwise(raw(b"")), said(F.substring("url", 1, 60))))
    found = inspect_images(pages.select("page_id", F.when(F.col("page_id") % 2 == 0, webp).otherwise(gif).alias("content")), key="page_id")
    return found.select("page_id", "format", F.explode("findings").alias("f")).select("page_id", "format", "f.category", "f.size_bytes")


@query("image_tiff_bmp_sizes", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'tiff' ELSE 'bmp' END AS format, CAST(n_chars % 500 + 1 AS INT) AS width, CAST(strlen(coalesce(source, '')) + 1 AS INT) AS height,
CASE WHEN doc_id % 4 = 0 THEN 'gps' WHEN doc_id % 4 = 2 THEN 'exif' END AS category FROM documents""")
def image_tiff_bmp_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = F.col("n_chars") % 500 + 1, F.octet_length(F.coalesce("source", F.lit(""))) + 1
    tag = F.when(F.col("doc_id") % 4 == 0, 0x8825).otherwise(0x010F)
    found = inspect_images(_files(spark, sf_dir, F.when(F.col("doc_id") % 2 == 0, samples.tiff(width, height, tag)).otherwise(samples.bmp(width, height))), key="doc_id")
    return found.select("doc_id", "format", "width", "height", F.get("findings", F.lit(0))["category"].alias("category"))


def _office():
    return samples.ooxml(said(F.concat(F.lit("by "), F.coalesce("source", F.lit("")))), said(F.concat(F.lit("c"), F.col("doc_id").cast("string"))), said(F.col("text")))


@query("ooxml_findings", """SELECT doc_id, 'docProps/core.xml' AS location, 'creator' AS label, trim('by ' || coalesce(source, '')) AS value FROM documents UNION ALL SELECT doc_id, 'docProps/custom.xml', 'Client', 'c' || doc_id FROM documents""")
def ooxml_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(inspect_files(_files(spark, sf_dir, _office()), "ooxml", key="doc_id"), "location", "label", "value")


@query("ooxml_cleaned", "SELECT doc_id, true AS ok, true AS changed, 0 AS left_over FROM documents")
def ooxml_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean_files(_files(spark, sf_dir, _office()), "ooxml", key="doc_id").select(F.struct("doc_id", "bytes_in", "bytes_out").alias("was"), F.col("cleaned").alias("content"))
    after = inspect_files(cleaned.select(F.to_json("was").alias("path"), "content"), "ooxml")
    was = F.from_json("path", "doc_id long, bytes_in long, bytes_out long")
    return after.select(was["doc_id"].alias("doc_id"), "ok", (was["bytes_in"] != was["bytes_out"]).alias("changed"), F.size("findings").alias("left_over"))


def _pdf():
    xmp = F.concat(raw(b"<x:xmpmeta>"), said(F.substring("source", 1, 40)), raw(b"</x:xmpmeta>"))
    return samples.pdf(said(F.concat(F.lit("A "), F.coalesce("lang", F.lit("")))), xmp)


@query("pdf_findings", """SELECT doc_id, 'Info' AS location, 'Author' AS label, 'A ' || coalesce(lang, '') AS value FROM documents UNION ALL SELECT doc_id, 'Info', 'Title', 'A' FROM documents
UNION ALL SELECT doc_id, 'object 4', 'XMP', '<x:xmpmeta>' || left(coalesce(source, ''), 40) || '</x:xmpmeta>' FROM documents""")
def pdf_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(inspect_files(_files(spark, sf_dir, _pdf()), "pdf", key="doc_id"), "location", "label", "value")


@query("pdf_cleaned", """SELECT doc_id, true AS same_length, false AS names_source FROM documents""")
def pdf_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_files(_files(spark, sf_dir, _pdf()), "pdf", key="doc_id")
    return out.select("doc_id", (F.col("bytes_in") == F.col("bytes_out")).alias("same_length"), F.hex("cleaned").contains(F.hex(F.lit("xmpmeta"))).alias("names_source"))


def _mp3():
    return samples.mp3(said(F.concat(F.lit("by "), F.coalesce("source", F.lit("")))), said(F.concat(F.lit("song "), F.col("doc_id").cast("string"))), F.concat(raw(b"\xff\xfb\x90\x00"), said(F.col("text"))))


@query("mp3_findings", """SELECT doc_id, 'ID3v2' AS location, 'TPE1' AS label, 'by ' || coalesce(source, '') AS value FROM documents UNION ALL SELECT doc_id, 'ID3v1', 'title', 'song ' || doc_id FROM documents""")
def mp3_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(inspect_files(_files(spark, sf_dir, _mp3()), "mp3", key="doc_id"), "location", "label", "value")


@query("mp3_cleaned", """SELECT doc_id, md5('\\xFF\\xFB\\x90\\x00'::BLOB || encode(coalesce(text, ''))) AS digest FROM documents""")
def mp3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_files(_files(spark, sf_dir, _mp3()), "mp3", key="doc_id").select("doc_id", F.md5("cleaned").alias("digest"))


def _mp4():
    return samples.mp4(said(F.concat(F.lit("n"), F.col("doc_id").cast("string"))), said(F.col("text")), said(F.col("source")))


@query("mp4_findings", """SELECT doc_id, '©nam' AS label, 'n' || doc_id AS value FROM documents UNION ALL SELECT doc_id, 'covr', 'image data, ' || strlen(coalesce(text, '')) || ' bytes' FROM documents""")
def mp4_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(inspect_files(_files(spark, sf_dir, _mp4()), "mp4", key="doc_id"), "label", "value")


@query("mp4_cleaned", """SELECT doc_id, CAST(120 + strlen('n' || doc_id) + strlen(coalesce(text, '')) + strlen(coalesce(source, '')) AS BIGINT) AS bytes_out, coalesce(source, '') AS sound FROM documents""")
def mp4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    out = clean_files(_files(spark, sf_dir, _mp4()), "mp4", key="doc_id").filter("bytes_in = bytes_out").join(docs, "doc_id")
    return out.select("doc_id", "bytes_out", F.expr("CAST(substring(cleaned, CAST(bytes_out AS INT) - octet_length(coalesce(source, '')) + 1, octet_length(coalesce(source, ''))) AS STRING)").alias("sound"))


_EXT = ["PNG", "docx", "pdf", "Mp3", "m4a", "txt"]


@query("mixed_folder_by_kind", """WITH d AS (SELECT doc_id % 6 AS k, count(*) AS files FROM documents GROUP BY 1)
SELECT CASE k WHEN 0 THEN 'image' WHEN 1 THEN 'ooxml' WHEN 2 THEN 'pdf' WHEN 3 THEN 'mp3' WHEN 4 THEN 'mp4' END AS kind, CASE WHEN k = 5 THEN 0 ELSE files END AS good,
CAST(CASE k WHEN 0 THEN (SELECT count(*) FROM documents WHERE doc_id % 6 = 0 AND doc_id % 4 = 0) + 2 * (SELECT count(*) FROM documents WHERE doc_id % 6 = 0 AND doc_id % 4 = 2) WHEN 1 THEN 2 * files WHEN 2 THEN 3 * files WHEN 3 THEN 2 * files WHEN 4 THEN 2 * files ELSE 0 END AS BIGINT) AS findings FROM d WHERE k < 5""")
def mixed_folder_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of all kinds; each file goes to its own inspector by its extension."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.col("doc_id") % 6 + 1).cast("int"))
    files = docs.select(F.concat(F.lit("/in/f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), _pick(6, _png(), _office(), _pdf(), _mp3(), _mp4(), said(F.col("text"))).alias("content"))
    found = inspect_files(files.withColumn("kind", kind_of(F.col("path"))).filter("kind != 'text'"))
    return found.groupBy(kind_of(F.col("path")).alias("kind")).agg(F.count_if("ok").alias("good"), F.sum(F.size("findings")).cast("bigint").alias("findings"))


@query("utf8_decoded", """SELECT doc_id, doc_id % 5 <> 0 AS ok, CASE WHEN doc_id % 5 <> 0 THEN length(coalesce(text, '')) END AS chars, CASE WHEN doc_id % 5 = 0 THEN 'not valid UTF-8 text' END AS error FROM documents""")
def utf8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(said(F.col("text")), F.when(F.col("doc_id") % 5 == 0, raw(b"\xc3\x28")).otherwise(raw(b"")))
    return decode_utf8(_files(spark, sf_dir, content)).select("doc_id", "ok", F.length("text").cast("bigint").alias("chars"), "error")


@query("clean_names", """WITH d AS (SELECT doc_id, ['/a/b/x' || doc_id || '.tar.gz', 'y' || doc_id, '/q/.md', 'z.z/n' || doc_id || '.HTML'][doc_id % 4 + 1] AS p FROM documents), n AS (SELECT doc_id, p, regexp_extract(p, '([^/]*)$', 1) AS f FROM d)
SELECT doc_id, CASE WHEN regexp_matches(f, '..*[.][^.]*$') AND NOT regexp_matches(f, '^[.][^.]*$') THEN regexp_replace(f, '[.]([^.]*)$', '-clean.\\1') ELSE f || '-clean' END AS name FROM n""")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    path = _pick(4, F.concat(F.lit("/a/b/x"), i, F.lit(".tar.gz")), F.concat(F.lit("y"), i), F.lit("/q/.md"), F.concat(F.lit("z.z/n"), i, F.lit(".HTML")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", report.clean_name(path).alias("name"))


_GONE = [c for c in unicode.CATEGORIES if c != "zero-width-joiner"]


@query("text_clean_report", f"""WITH d AS (SELECT doc_id, {DIRTY.replace('text', '(' + TYPED + ')')} AS t FROM documents), x AS (SELECT doc_id, unnest(regexp_extract_all({_BODY}, '{_class(*_GONE)}')) AS c FROM d), y AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_TYPOGRAPHIC}')) AS c FROM d)
SELECT doc_id, 'removed' AS what, {_category_sql('unicode(c)')} AS kind, printf('U+%04X', unicode(c)) AS codepoint, count(*) AS count FROM x GROUP BY ALL
UNION ALL SELECT doc_id, 'typography', {_KIND_SQL}, printf('U+%04X', unicode(c)), count(*) FROM y GROUP BY ALL""")
def text_clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = overlay.documents(spark, sf_dir, DIRTY.replace("text", f"({TYPED})"))
    told = report.text_clean_json(clean_text_report(docs, "t", F.lit("md"), TextOptions(normalize_typography=True)), "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("-clean.md")))
    one = "array<struct<{}:string,codepoint:string,count:long>>"
    read = told.select("doc_id", F.from_json("report", f"removed {one.format('category')}, typography_normalized {one.format('kind')}").alias("r"))
    # One pass over the texts: both lists are read from the same report.
    told_of = lambda what, kind: F.transform(F.col(f"r.{what}"), lambda x: F.struct(F.lit(what.split("_")[0]).alias("what"), x[kind].alias("kind"), x["codepoint"].alias("codepoint"), x["count"].alias("count")))
    return read.select("doc_id", F.inline(F.concat(told_of("removed", "category"), told_of("typography_normalized", "kind"))))


@query("json_inspect_report", f"""{_D}, x AS ({_INVISIBLE}) SELECT doc_id, CAST(true AS BOOLEAN) AS ok, count(c) = 0 AS clean, count(DISTINCT c) AS kinds, count(c) AS marks FROM documents LEFT JOIN x USING (doc_id) GROUP BY doc_id""")
def json_inspect_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = report.json_report(inspect_text(overlay.documents(spark, sf_dir, DIRTY), "t", options=InspectTextOptions(families=("invisible",))), "doc_id", "char_count")
    read = told.select("doc_id", F.from_json("report", "ok boolean, clean boolean, findings array<struct<category:string,count:long>>").alias("r"))
    marks = F.aggregate("r.findings", F.lit(0).cast("bigint"), lambda a, f: a + f["count"])
    return read.select("doc_id", "r.ok", "r.clean", F.size("r.findings").cast("bigint").alias("kinds"), marks.alias("marks"))


@query("text_report_lines", f"""WITH d AS (SELECT page_id, {HEADED} AS t FROM pages), c AS (SELECT page_id, len(regexp_extract_all(t, '<!--.*?-->', 0, 's')) + len(regexp_extract_all(t, '<(?:meta|META) (?:name="generator"|property=og:generator|name="author")')) AS n FROM d)
SELECT page_id, CASE WHEN n = 0 THEN 'clean ' ELSE 'found ' END || page_id AS head, n + 1 AS lines FROM c""")
def text_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = inspect_text(overlay.pages(spark, sf_dir), "t", F.lit("html"), InspectTextOptions(families=("html",))).withColumn("page", F.col("page_id").cast("string"))
    lines = report.text_lines(pages, "page")
    return lines.groupBy(F.col("page").cast("bigint").alias("page_id")).agg(F.max_by("line", -F.col("nth")).alias("head"), F.count("*").alias("lines"))
