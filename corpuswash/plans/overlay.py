"""Test texts with hidden and identifying content, made from the tables by a rule, in Spark and in SQL alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each overlay as SQL that Spark and DuckDB both run.
DIRTY = """
CASE WHEN doc_id % 7 = 0 THEN chr(65279) ELSE '' END ||
CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', ' ' || chr(8203))
  WHEN doc_id % 5 = 0 THEN replace(text, ' ', ' ' || '\U000e0041')
  WHEN doc_id % 11 = 0 THEN replace(text, ' ', chr(65279) || ' ')
  WHEN doc_id % 13 = 1 THEN replace(text, 'e', 'e' || chr(8205) || chr(8238))
  ELSE text END
"""
TYPED = """
CASE WHEN doc_id % 4 = 1 THEN replace(text, '. ', chr(8217) || '. ' || chr(8212) || ' ')
  WHEN doc_id % 4 = 2 THEN replace(text, ', ', ',' || chr(160) || chr(8220))
  WHEN doc_id % 4 = 3 THEN replace(text, ' ', chr(8239)) ELSE text END
"""
FRONTED = """
CASE WHEN doc_id % 6 = 1 THEN '---' || chr(10) || 'title: T' || doc_id || chr(10) || 'author: A ' || doc_id || chr(10) || '  editor: nested' || chr(10) || '- tool: item' || chr(10) || 'Powered-By:  z: y ' || chr(10) || '---' || chr(10) || text
  WHEN doc_id % 6 = 2 THEN '---' || chr(10) || 'author: x' || chr(10) || text
  WHEN doc_id % 6 = 3 THEN '---' || chr(10) || 'ai_model: m' || chr(10) || 'date: d' || chr(10) || '...' || chr(10) || text
  ELSE text END
"""
STYLED = """
CASE WHEN doc_id % 4 = 0 THEN 'We delve into the intricate tapestry; not just a landscape. Realm, cutting-edge; realm_x cutting-edge when it comes to it. ' || text
  WHEN doc_id % 4 = 1 THEN replace(text, ', ', ' ' || chr(8212) || ' ') || ' seamless Leverage'
  ELSE text END
"""
HEADED = """
CASE WHEN page_id % 3 = 0 THEN replace(html, '<head>', '<head><meta name="generator" content="Gen ' || page_id || '"><META property=og:generator content=x>')
  WHEN page_id % 3 = 1 THEN replace(html, '<head>', '<head><meta name="author" content="a > b"><meta name="viewport" content="w">')
  ELSE html END
"""
DRAWN = """
'<svg inkscape:version="1.' || doc_id || '" width="1"><metadata>m' || doc_id || '</metadata><!-- c' || doc_id || ' --><path d="M0" sodipodi:nodetypes="cc"/><title>' || lang || '</title></svg>'
"""


def _literal(rule: str) -> str:
    """The rule with characters in place of chr() of large code points, which the engines read differently."""
    return re.sub(r"chr\((\d{3,})\)", lambda m: f"'{chr(int(m[1]))}'", rule)


DIRTY, TYPED, STYLED = _literal(DIRTY), _literal(TYPED), _literal(STYLED)


def documents(spark: SparkSession, sf_dir: str, rule: str, *more: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *more, F.expr(rule).alias("t"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr(HEADED).alias("t"))
