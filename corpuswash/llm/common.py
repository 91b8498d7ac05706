"""Helpers shared by the training-data operators: tables, shared folder, Arrow text batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass of a Python worker takes at most (a longer text is taken alone).
CHUNK_BYTES = 1 << 19
#: Rows that go to Python together.
ARROW_ROWS = 1000
#: Words of the bitmap that tells rows apart which an anti join must look at.
BITMAP_WORDS = 1 << 17


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python a thousand at a time, unless the session has set fewer: ten thousand of them (the
    default) take hundreds of MB of an executor's memory outside its heap."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; sets small_batches()."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); only where that is unset, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished queries deleted now: Spark does that when the driver's heap is collected, which
    may be long after a large shuffle."""
    gc.collect()
    spark._jvm.System.gc()


def without(df: DataFrame, bad: DataFrame, column: str) -> DataFrame:
    """df less the rows whose column (a long, no null) is in bad (one column of that name).

    Only rows that may be bad are shuffled: a bitmap of BITMAP_WORDS * 64 bits at most, of the bad values, tells the
    others apart.  Where bad grows so large that all bits are set, this is a plain anti join.
    """
    word, bit, words, bits = own_names(df.columns, "word", "bit", "words", "bits")
    where = F.pmod(F.shiftright(quoted(column), 6), F.lit(BITMAP_WORDS)).cast("int")
    one = F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST({quoted(column)} & 63 AS INT))")
    bad = materialize(bad.distinct(), "bad-rows")
    bitmap = bad.select(where.alias(words), one.alias(bits)).groupBy(words).agg(F.bit_or(bits).alias(bits))
    bitmap = materialize(bitmap, "bad-bits")
    marked = df.withColumn(word, where).withColumn(bit, one).join(F.broadcast(bitmap), F.col(word) == F.col(words), "left")
    may = F.coalesce(F.col(bits).bitwiseAND(F.col(bit)), F.lit(0)) != 0
    kept = [quoted(c) for c in df.columns]
    return marked.filter(~may).select(*kept).unionByName(marked.filter(may).select(*kept).join(bad, column, "left_anti"))


def remainder(key: str, by: int) -> Column:
    """crc32 of the key as text, modulo by."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(by))


def bounded_sample(df: DataFrame, label: str, key: str, per_label: int, seed: str) -> DataFrame:
    """About per_label rows of every label, chosen by hash of the key (the same rows in every run).

    The counts cover all rows; only the share that is kept is chosen so that the sample is bounded.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    grain = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(grain))
    keep = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda kv: str(kv[0])):
        keep = keep | ((F.col(label) == F.lit(value)) & (draw < F.lit(int(grain * min(1.0, per_label / n)))))
    return df.filter(keep)


def sampled_texts(rows: DataFrame, most_bytes: int) -> list[tuple[str, object, str]]:
    """rows (k, y, t) as sorted tuples, without null texts and labels; thinned by hash of the key where a label's texts
    have more than most_bytes, texts of more than a fiftieth of that left out."""
    held = materialize(rows.select("k", "y", "t").dropna(subset=["y", "t"]).filter(F.octet_length("t") <= most_bytes // 50), "sample")
    sizes = {r[0]: r[1] for r in held.groupBy("y").agg(F.sum(F.octet_length("t"))).collect()}
    grain = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit("bytes"), F.col("k").cast("string")), F.lit(grain))
    keep = F.lit(False)
    for value, size in sorted(sizes.items(), key=lambda kv: str(kv[0])):
        keep = keep | ((F.col("y") == F.lit(value)) & (draw < F.lit(int(grain * min(1.0, most_bytes / max(size, 1))))))
    found = sorted((str(r["k"]), r["y"], r["t"]) for r in held.filter(keep).collect())
    discard(held)
    return found


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts whose characters sum to about limit at most; at least one text each."""
    a, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(texts):
        yield a, len(texts)


def text_chunks(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[str | None]]]:
    """(a, b, texts of rows a to b - 1) over a batch: only one run of about limit bytes is made Python strings at a time."""
    lean()
    texts = batch.column(column)
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(upto):
        start = int(upto[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(upto, start + limit, side="right")))
        yield a, b, texts.slice(a, b - a).to_pylist()
        a = b


def lean() -> None:
    """In a worker: large buffers come from and go back to the system, in place of pools that keep them."""
    global _lean
    if not _lean:
        _lean = True
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            ctypes.CDLL(None).mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        except (AttributeError, OSError):  # not glibc
            pass


def trim() -> None:
    """Give freed memory back to the system: workers live on between stages, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def own_names(taken: Sequence[str], *names: str) -> list[str]:
    """Names for working columns that clash with none of the caller's."""
    mark = "_"
    while any(t.lower() == f"{mark}{n}".lower() for t in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def quoted(name: str) -> str:
    """name as a column reference, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: names that a Python stage can take, whatever they were."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by one U+000A, and where each starts (one more at the end)."""
    joined = "\n".join([t or "" for t in texts] + [""])
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([(len(t) if t else 0) + 1 for t in texts], out=starts[1:])
    return cps, starts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Odd base of the rolling hashes, and its inverse modulo 2**64.
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_lean = False


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, at least n of them (kept between calls)."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", ODD), ("down", INVERSE)):
            p = np.full(max(n, 1 << 20), base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]
