"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of documents.  Defined results: documents without text stay through the filters (they are neither toxic
nor near anything) and take no part in the mix, which has no words of them to take; rows of equal
doc_id and text become one row in the near-duplicate stage (the least in all columns), rows without doc_id too if they
have words; different texts of one doc_id are judged each; very long texts are read whole; empty tables pass through;
further columns of documents pass through the filters, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswash.llm import decontaminate, jaccard, mixing, shards, toxicity
from corpuswash.llm.common import materialize, own_names, quoted, release, small_batches, table, without
from corpuswash.llm.queries import toxicity_model

SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    release(spark)
    return toxicity.score(docs, model).filter(F.col("toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of linked documents; rows are judged by id and text."""
    small_batches(spark)
    (row,) = own_names(docs.columns, "row")
    marked = docs.withColumn(row, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    ranked = marked.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(row).alias("row")).alias("key"), "text")
    classes = materialize(jaccard.link_classes(ranked, "key"), "pipeline-classes")
    release(spark)
    away = classes.filter(F.col("key") != F.col("component_id")).select(F.col("key.row").alias(row))
    kept = without(marked, away, row)
    repeated = classes.filter(F.col("key.doc_id").isNotNull() | (F.col("n_shingles") > 0)).groupBy(F.col("key.row").alias(row)).count().filter(F.col("count") > 1).select(row)
    columns = [quoted(c) for c in docs.columns]
    if not repeated.isEmpty():
        one = kept.join(repeated, row, "left_semi").groupBy(row).agg(F.min(F.struct(*columns)).alias("least"))
        kept = without(kept, repeated, row).select(*columns).unionByName(one.select("least.*"))
    return kept.select(*columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole copy."""
    small_batches(spark)
    size, copies, copy = own_names(docs.columns, "words", "copies", "copy")
    mixed = mixing.mix(docs.withColumn(size, mixing.words(F.col("text"))), size=size)
    times = F.when(F.col(size) > 0, F.floor(F.col("taken") / F.col(size) + 0.5)).otherwise(0).cast("int")
    mixed = mixed.withColumn(copies, times).filter(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    return mixed.select(*map(quoted, docs.columns))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot along the Hilbert curve of language, source and size."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    checksum = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    sized = docs.withColumn("size", size).withColumn("text_crc32", checksum)
    return shards.hilbert_shards(sized, ["lang", "source", "size"], ["text_crc32", "doc_id"], SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the trained toxicity model; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
