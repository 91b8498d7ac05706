"""Findings as rows, JSON reports, summaries and the pass/fail gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswash.functions.style import CAVEAT


def explode_findings(df: DataFrame, *keys: str) -> DataFrame:
    """One row per finding, with the given key columns."""
    return df.select(*keys, F.explode("findings").alias("f")).select(*keys, "f.*")


def json_report(df: DataFrame, file: str, *fields: str) -> DataFrame:
    """(file, report): one JSON object per row; failed rows carry file, ok and error only.  Where style findings are
    among them, the report carries the caveat about those."""
    found = F.transform("findings", lambda f: F.struct(f["family"].alias("family"), f["category"].alias("category"), f["location"].alias("location"), f["label"].alias("label"), f["value"].alias("value"), f["count"].alias("count"), f["size_bytes"].alias("size_bytes")))
    ok = F.col("ok") if "ok" in df.columns else F.lit(True)
    good = F.to_json(F.struct(F.col(file).alias("file"), F.lit(True).alias("ok"), *fields, (F.size("findings") == 0).alias("clean"), found.alias("findings"), F.when(F.exists("findings", lambda f: f["family"] == "style"), CAVEAT).alias("style_caveat")))
    bad = F.to_json(F.struct(F.col(file).alias("file"), F.lit(False).alias("ok"), (F.col("error") if "error" in df.columns else F.lit(None).cast("string")).alias("error")))
    return df.select(F.col(file), F.when(ok, good).otherwise(bad).alias("report"))


def text_clean_json(df: DataFrame, file: str, output: Column) -> DataFrame:
    """(file, report) of clean_text_report's rows: lengths and what each pass removed."""
    counts = lambda c, name: F.transform(c, lambda f: F.struct(f["category"].alias(name), f["label"].alias("codepoint"), f["count"].alias("count")))
    marks = lambda c: F.transform(c, lambda f: F.struct(f["category"].alias("kind"), f["label"].alias("label")))
    good = F.struct(
        F.col(file).alias("file"), F.lit(True).alias("ok"), output.alias("output"), "chars_in", "chars_out", counts("removed", "category").alias("removed"), "frontmatter_keys_removed",
        marks("html_findings_removed").alias("html_findings_removed"), marks("svg_findings_removed").alias("svg_findings_removed"), counts("typography_normalized", "kind").alias("typography_normalized"),
    )
    return df.select(F.col(file), F.to_json(good).alias("report"))


def file_clean_json(df: DataFrame, file: str, output: Column, *fields: str) -> DataFrame:
    """(file, report) of cleaned images, packages, PDF or media files: sizes and further fields, or the error."""
    good = F.to_json(F.struct(F.col(file).alias("file"), F.lit(True).alias("ok"), output.alias("output"), *fields, "bytes_in", "bytes_out"))
    bad = F.to_json(F.struct(F.col(file).alias("file"), F.lit(False).alias("ok"), F.col("error").alias("error")))
    return df.select(F.col(file), F.when(F.col("ok"), good).otherwise(bad).alias("report"))


def text_lines(df: DataFrame, file: str) -> DataFrame:
    """(file, line): a line for each file and one for each of its findings, as a person reads them."""
    ok = F.col("ok") if "ok" in df.columns else F.lit(True)
    said = lambda f: F.concat_ws(" ", F.lit("  -"), F.concat(F.lit("["), F.coalesce(f["category"], f["location"], f["family"]), F.lit("]")), f["label"], F.when(f["value"].isNotNull(), F.concat(F.lit("= "), f["value"])), F.when(f["count"] > 1, F.concat(F.lit("x"), f["count"].cast("string"))))
    head = F.when(~ok, F.concat(F.lit("fail "), file, F.lit(": "), F.coalesce("error", F.lit("")) if "error" in df.columns else F.lit("")))
    head = head.when(F.size("findings") == 0, F.concat(F.lit("clean "), file)).otherwise(F.concat(F.lit("found "), file))
    return df.select(F.col(file), F.posexplode(F.concat(F.array(head), F.when(ok, F.transform("findings", said)).otherwise(F.array()))).alias("nth", "line"))


def summary(df: DataFrame, ok: Column) -> DataFrame:
    """total and succeeded."""
    return df.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"))


def gate(df: DataFrame, ok: Column | None = None) -> DataFrame:
    """files, files_with_findings, failures, failed: an inspection fails on any finding or failure."""
    fine = ok if ok is not None else F.lit(True)
    dirty = F.size("findings") > 0
    return df.agg(
        F.count("*").alias("files"), F.count_if(dirty).alias("files_with_findings"), F.count_if(~fine).alias("failures"), F.coalesce(F.bool_or(dirty | ~fine), F.lit(False)).alias("failed")
    )


def _of(category: str):
    return lambda f: f["category"] == category


def kinds_pivot(df: DataFrame, kinds: list[str]) -> DataFrame:
    """Findings of each kind, one column a kind (hyphens as underscores)."""
    return df.agg(*[F.coalesce(F.sum(F.size(F.filter("findings", _of(k)))), F.lit(0)).cast("bigint").alias(k.replace("-", "_")) for k in kinds])


def clean_name(path: Column, ext: Column | None = None) -> Column:
    """{stem}-clean.{ext} of a path's file name."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    own = F.regexp_extract(name, r".\.([^.]*)$", 1)
    e = ext if ext is not None else own
    return F.when(e == "", F.concat(stem, F.lit("-clean"))).otherwise(F.concat(stem, F.lit("-clean."), e))


def write_cleaned_text(df: DataFrame, out_dir: str, text: str = "cleaned", key: str = "path") -> None:
    """Cleaned texts as a table keyed by path, in a new place; inputs are never overwritten."""
    df.select(key, F.col(text).alias("cleaned")).write.mode("errorifexists").parquet(out_dir)
