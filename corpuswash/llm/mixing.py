"""Sources mixed to target weights by Sainte-Lague apportionment of equal-token blocks.

The weights share all tokens of the corpus; a source's target stops at ``most_repeats`` times its size and the
excess is shared again by weight.  Tokens are dealt in blocks of ``block`` tokens, twice by the same rule, every block going
to the highest quotient target / (2 * blocks + 1): all blocks to the sources, then each source's blocks to its
buckets (the shards of the mix), whose targets are their parts of the source's tokens.  So every bucket has an integer quota
before any block is selected, and a source's quotas sum to its own.  The quotas are found from their closed form (each target
rounded) and the few quotients by which the rounded numbers miss the total.  A bucket's documents are laid end to end
in seeded order; its quota takes that line as often as it fits and then the first blocks of it once more.

A source may hold most rows: its buckets are parts of the seeded order (hash of the key), about 128 to 256 rows each, so
no task holds a whole source.  Only DataFrame functions run here.

Defined results: a null source is a source of its own, the last; null text has size 0; size-0 documents take
nothing; of equal quotients the first in order wins; equal rows are interchangeable; a very long document is cut like
any other; an empty table gives no rows; extra columns stay, whatever their names (those that mix adds are replaced).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, quoted

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Tokens of a block.
BLOCK = 16
MOST_REPEATS = 3
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded(key: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def seats(df: DataFrame, group: str, order: str, target: str, total: str) -> DataFrame:
    """df with quota: each group's total (whole blocks) dealt to its rows by the highest quotients of target (in blocks).

    Rows have different `order` within a group; of equal quotients the smaller one goes first.
    """
    whole = Window.partitionBy(group)
    rounded = (
        df.withColumn("q", F.floor(F.col(target) + 0.5))
        .withColumn("miss", F.col(total) - F.sum("q").over(whole))
        .withColumn("tries", F.ceil(F.col(target) / F.greatest(F.sum(target).over(whole), F.lit(1.0)) * (F.abs("miss") + F.count("*").over(whole))) + 2)
    )
    # The next quotients of each row on the side of the miss; the highest (or lowest) |miss| of them change hands.
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("tries"), F.abs("miss")).cast("long"))).alias("k")
    tried = rounded.filter(F.col("miss") != 0).select(group, order, "q", "miss", target, k)
    seat = F.when(F.col("miss") > 0, F.col("q") + F.col("k")).otherwise(F.col("q") - 1 - F.col("k"))
    tried = tried.withColumn("seat", seat).filter(F.col("seat") >= 0)
    quotient = F.col(target) / (2 * F.col("seat") + 1)
    first = F.when(F.col("miss") > 0, -quotient).otherwise(quotient), F.col(order) * F.signum("miss")
    tried = tried.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*first)))
    moved = tried.filter(F.col("rank") <= F.abs("miss")).groupBy(group, order).agg(F.sum(F.signum("miss")).cast("long").alias("moved"))
    quota = (F.col("q") + F.coalesce("moved", F.lit(0))).cast("long").alias("quota")
    return rounded.join(moved, [group, order], "left").select(*df.columns, quota)


def quotas(sizes: DataFrame, weights: Sequence[int], block: int, most: int) -> DataFrame:
    """Per source: size, target (double) and quota (blocks).  sizes: one row (source, source_size) per source."""
    one = Window.partitionBy()  # over sources, one row each; never over documents
    by_name = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = by_name.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", "i").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        weighed.withColumn("left", F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("w").over(one) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("full", F.col("ratio") <= F.col("level"))
    )
    level = F.max(F.when(~F.col("full"), F.struct(-F.col("ratio"), -F.col("i"), F.col("level").alias("v")))).over(one)["v"]
    aimed = filled.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * level))
    aimed = aimed.withColumn("aim", F.col("target") / block).withColumn("total", F.floor(F.sum("source_size").over(one) / block + 0.5)).withColumn("all", F.lit(0))
    return seats(aimed, "all", "i", "aim", "total").select("source", "source_size", "target", "quota")


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", weights: Sequence[int] = WEIGHTS, block: int = BLOCK, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """df with source_size, target, quota and bucket_quota (blocks) and taken (tokens of this row that the mix takes)."""
    added = ("source_size", "target", "taken", "quota", "bucket_quota")
    kept = F.struct(*[quoted(c) for c in df.columns if c not in added]).alias("row")
    base = df.select(kept, F.col(quoted(source)).alias("source"), F.col(quoted(size)).alias("size"), seeded(F.col(quoted(key)), seed).alias("order"))
    by_source = materialize(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    largest = by_source.agg(F.max("n")).first()[0] or 0
    bits = min(16, (int(largest) // 128).bit_length())  # buckets of 128 to 256 rows of the largest source, at most 65536 a source
    goal = quotas(by_source.select("source", "source_size"), weights, block, most)
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    goal = materialize(goal.select(name(F.col("source")).alias("name"), "source_size", "target", "quota"), "mix-quotas")

    bucket = F.shiftright(F.conv(F.substring("order", 1, 4), 16, 10).cast("int"), 16 - bits)
    base = base.select("row", "size", "order", name(F.col("source")).alias("name"), bucket.alias("bucket"))
    sums = base.groupBy("name", "bucket").agg(F.sum("size").alias("sum")).join(goal, "name")
    part = F.when(F.col("source_size") > 0, F.col("quota").cast("double") * F.col("sum") / F.col("source_size")).otherwise(0.0)
    shares = seats(sums.select("name", "bucket", "sum", part.alias("aim"), F.col("quota").alias("total")), "name", "bucket", "aim", "total")
    tokens = F.col("bucket_quota") * block
    passes = F.when(F.col("sum") > 0, F.least(F.floor(tokens / F.col("sum")), F.lit(most))).otherwise(0)
    lines = shares.select("name", "bucket", "sum", F.col("quota").alias("bucket_quota")).withColumn("passes", passes)
    lines = lines.withColumn("rest", F.when(F.col("passes") < most, tokens - F.col("passes") * F.col("sum")).otherwise(0))

    inside = Window.partitionBy("name", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = base.join(lines, ["name", "bucket"]).withColumn("end", F.sum("size").over(inside)).join(goal, "name")
    once = F.greatest(F.least(F.col("rest"), F.col("end")) - (F.col("end") - F.col("size")), F.lit(0))
    return placed.select("row.*", "source_size", "target", "quota", "bucket_quota", (F.col("passes") * F.col("size") + once).cast("long").alias("taken"))
