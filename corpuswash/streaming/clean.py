"""Cleaning as a stream: new files are cleaned once and appended as rows.  Row-local, so there is no state."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuswash.operators.text import clean_text
from corpuswash.options import TextOptions
from corpuswash.sources.files import EXTENSIONS, decode_utf8, extension, stream_files


def clean_text_stream(spark: SparkSession, folder: str, out_dir: str, checkpoint: str, options: TextOptions = TextOptions()) -> StreamingQuery:
    """Clean the text files that are in folder now (and were not cleaned by this checkpoint) into a table."""
    files = stream_files(spark, folder).filter(extension(F.col("path")).isin(EXTENSIONS["text"]))
    cleaned = clean_text(decode_utf8(files), "text", extension(F.col("path")), options)
    rows = cleaned.select("path", "ok", "error", "cleaned", "chars_in", "chars_out")
    return rows.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
