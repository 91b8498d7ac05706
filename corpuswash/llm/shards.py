"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised at its own quantiles, the cells are numbered along a Hilbert curve, rows are range
partitioned and sorted by curve index, and the sorted sequence is cut into runs of equal row counts (law
``rows``).  Rows near each other in every dimension share a shard, so minima and maxima of several columns prune
files at once.  Equal texts have equal dimensions and checksums, so they lie side by side on the curve.

Exact positions need no single task: a partition knows its rows' local positions, and only the partitions' row
counts (one number each) meet on the driver.

Defined results: nulls of a dimension come before all values; ties of the curve index go by text checksum, then
by the given keys; fully equal rows are interchangeable; an empty table gives no rows; very long strings are ordered by
the six bytes after the dimension's common prefix; extra columns stay, whatever their names (law, shard, slot and curve are
replaced).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import materialize, quoted

#: Bits of each quantised dimension.
BITS = 6


def hilbert_index(cells: Sequence[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Curve index of the cells (one array per dimension, values below 2**bits), by the transposed-axes method."""
    x = [np.asarray(c, np.int64).copy() for c in cells]
    n, q = len(x), 1 << (bits - 1)
    if n == 1:
        return x[0]
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(high & (i > 0), x[i], x[i] ^ (swap if i > 0 else 0))
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ t) >> b) & 1)
    return index


def ordered_number(df: DataFrame, dims: Sequence[str]) -> list[Column]:
    """Each dimension as a double that keeps its order: strings by the six bytes after their common prefix."""
    strings = [d for d in dims if isinstance(df.schema[d].dataType, StringType)]
    ends = df.agg(F.lit(1), *[f(quoted(d)).alias(f"{k}{i}") for i, d in enumerate(strings) for k, f in (("lo", F.min), ("hi", F.max))]).first() if strings else None
    out = []
    for d in dims:
        if d in strings:
            lo, hi = ends[f"lo{strings.index(d)}"] or "", ends[f"hi{strings.index(d)}"] or ""
            same = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
            code = F.conv(F.rpad(F.substring(F.hex(F.substring(F.col(quoted(d)), same + 1, 6).cast("binary")), 1, 12), 12, "0"), 16, 10)
            out.append(F.coalesce(code.cast("double"), F.lit(-1.0)))
        else:
            out.append(F.coalesce(F.col(quoted(d)).cast("double"), F.lit(-1e300)))
    return out


def hilbert_shards(df: DataFrame, dims: Sequence[str], keys: Sequence[str], n_shards: int, bits: int = BITS) -> DataFrame:
    """df with law, shard (0 to n_shards - 1), slot (gapless from 0 within a shard) and curve (the Hilbert index)."""
    kept = F.struct(*[quoted(c) for c in df.columns if c not in ("law", "shard", "slot", "curve")]).alias("row")
    numbers = ordered_number(df, dims)
    cuts_at = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(x, cuts_at, 2000).alias(f"q{i}") for i, x in enumerate(numbers)]).first()
    cuts = [np.unique(np.asarray(q if q is not None else [], float)) for q in found]

    @F.pandas_udf("long")
    def curve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)  # one dimension comes bare
            yield pd.Series(hilbert_index([np.searchsorted(c, x.to_numpy(), side="right") for c, x in zip(cuts, columns)], bits))

    ties = [f"key{i}" for i in range(len(keys))]
    order = ["curve", *ties]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.select(kept, curve(*numbers).alias("curve"), *[F.col(quoted(k)).alias(t) for k, t in zip(keys, ties)])
    laid = laid.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("row", "curve")
    laid = materialize(laid.withColumn("at", F.monotonically_increasing_id()), "shards")

    part, local = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in laid.groupBy(part.alias("part")).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    spark = df.sparkSession
    offsets = spark.createDataFrame(offsets, "part long, offset long")  # one row for each partition
    base, extra = divmod(total, n_shards)
    cut = extra * (base + 1)
    placed = laid.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("pos", F.col("offset") + local)
    late = F.col("pos") - F.lit(cut)
    width = max(base, 1)
    return placed.select(
        "row.*",
        F.lit("rows").alias("law"),
        F.when(F.col("pos") < cut, F.floor(F.col("pos") / (base + 1))).otherwise(extra + F.floor(late / width)).cast("int").alias("shard"),
        F.when(F.col("pos") < cut, F.col("pos") % (base + 1)).otherwise(late % width).cast("long").alias("slot"),
        "curve",
    )
