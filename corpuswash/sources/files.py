"""Files as rows: discovery, size filter, formats by content and by name, strict UTF-8."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of each kind of file, lower case (fixed values).
EXTENSIONS = {
    "image": ["jpg", "jpeg", "png", "webp", "bmp", "gif", "tif", "tiff"],
    "text": ["txt", "md", "markdown", "text", "html", "htm", "svg"],
    "ooxml": ["docx", "xlsx", "pptx"],
    "pdf": ["pdf"],
    "mp3": ["mp3"],
    "mp4": ["mp4", "m4a", "m4v", "mov"],
}
MIME = {
    "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "bmp": "image/bmp", "gif": "image/gif", "tiff": "image/tiff",
}


def extension(path: Column) -> Column:
    """Lower-case extension of a path's file name; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def kind_of(path: Column) -> Column:
    e, out = extension(path), F.lit(None).cast("string")
    for kind, names in EXTENSIONS.items():
        out = F.when(e.isin(names), kind).otherwise(out)
    return out


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether path is a folder of the store it names (patterns and missing paths are none)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return bool(store.exists(place) and store.getFileStatus(place).isDirectory())


def expand_inputs(spark: SparkSession, inputs: Sequence[str], kinds: Sequence[str], recursive: bool = False, max_bytes: int | None = None) -> DataFrame:
    """path, modificationTime, length, content, kind of the given files and, if recursive, of folders' supported files.

    A file named itself is kept whatever its extension.  A folder, in whatever store, without recursive is an error.  The size
    limit is pushed into the scan, so larger files are never read.
    """
    folders = [p for p in inputs if is_folder(spark, p)]
    files = [p for p in inputs if p not in folders]
    if folders and not recursive:
        raise ValueError(f"{folders[0]} is a directory; pass recursive=True")
    supported = [e for k in kinds for e in EXTENSIONS[k]]
    parts = []
    if files:
        parts.append(spark.read.format("binaryFile").load(files))
    if folders:
        parts.append(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).filter(extension(F.col("path")).isin(supported)))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if max_bytes is not None:
        out = out.filter(F.col("length") <= max_bytes)
    return out.withColumn("kind", kind_of(F.col("path")))


def skipped(spark: SparkSession, folders: Sequence[str], kinds: Sequence[str]) -> int:
    """Number of files in the folders whose extension is not supported; contents are not read."""
    supported = [e for k in kinds for e in EXTENSIONS[k]]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders)).select("path")
    return found.filter(~extension(F.col("path")).isin(supported)).count()


def distinct_uploads(df: DataFrame) -> DataFrame:
    """Files without repeats of one name, size and time."""
    return df.dropDuplicates(["path", "length", "modificationTime"])


def decode_utf8(df: DataFrame, content: str = "content") -> DataFrame:
    """df with text, ok and error: invalid UTF-8 is an error of the row, not of the job."""
    text = F.try_validate_utf8(F.col(content).cast("string"))
    ok = F.col(content).isNull() | text.isNotNull()
    return df.withColumn("text", text).withColumn("ok", ok).withColumn("error", F.when(~ok, "not valid UTF-8 text"))


def image_format(content: Column) -> Column:
    """Image format by the first bytes, or null."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(head.startswith("424D"), "bmp")
        .when(head.startswith("474946383961") | head.startswith("474946383761"), "gif")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
    )


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """A file stream over a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
