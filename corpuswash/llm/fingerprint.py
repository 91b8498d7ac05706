"""Improbable-feature digests of texts.

Windows of WINDOW bytes start at every byte of a text.  A window's entropy over byte classes gives its rarity: how far
it lies from the entropy usual for prose; windows of almost no entropy are void.  A window is a feature if none of the
windows up to NEAR places from it on either side is rarer (so insertions shift nothing).  Features go into Bloom filters of FILTER_BYTES bytes, five bits each; after PER_FILTER features the
next filter of the chain begins.  Likeness of two digests: every filter of the shorter chain is compared with
filters of the other, by the bits they share beyond what chance would share, as part of the most they could
share; the best matches are averaged.  Only filters up to BAND places from each other in their chains are compared, so
the work grows with the length of the texts.

Digests are made in one pass over range partitions of the key, sorted, so that a document's successor is the next
row; only one row per partition (its first) is copied to the partition before.

Defined results: null text is empty; an empty text has an empty digest; two empty digests are alike (1), an
empty and another are not (0); a text without any feature has all its runs of six bytes as features; equal texts
have equal digests; of windows that are equally rare all are features, of equally good matches any gives the same likeness; rows
of equal keys follow one another by text, null keys come first; a very long text is read whole, one at a time; an empty
table gives no rows; repeated rows stay; keys are numbers, strings, dates or times; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ByteType, DateType, DoubleType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from .common import CHUNK_BYTES, ODD, chunks, mix64, power_tables, quoted, text_chunks, trim
from .shards import ordered_number

WINDOW, NEAR, CLASSES = 32, 16, 16
#: Bits of entropy usual for a window of prose (of at most 4), and the least that a window must have.
USUAL, LEAST = 3.2, 1.2
FILTER_BYTES, PER_FILTER = 256, 160
#: Bytes of the runs that stand in for features in texts without any.
SHORT = 6
#: Filters of two chains are compared up to so many places apart.
BAND = 32
_BITS = FILTER_BYTES * 8


def _byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64))


_CODES = _byte_codes()
_PLOGP = np.array([0.0] + [-(n / WINDOW) * np.log2(n / WINDOW) for n in range(1, WINDOW + 1)], np.float32)


def features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of several texts (bytes end to end; where each starts, one more at the end), and their text."""
    n = len(data)
    text_sizes = np.diff(starts)
    hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= WINDOW:
        m = n - WINDOW + 1
        entropy = np.zeros(m, np.float32)
        classes = (data ^ (data >> 4)) & (CLASSES - 1)
        upto = np.zeros(n + 1, np.uint8)
        for c in range(CLASSES):
            np.cumsum(classes == c, dtype=np.uint8, out=upto[1:])  # modulo 256: differences go up to WINDOW
            entropy += _PLOGP[upto[WINDOW:] - upto[:-WINDOW]]
        up, down = power_tables(n + 1)
        poly = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data] * up[:n], out=poly[1:])
        window = mix64((poly[WINDOW:] - poly[:-WINDOW]) * down[:m])
        key = (1 + (np.abs(entropy - np.float32(USUAL)) * 1000).astype(np.int64)) << 40 | (window >> np.uint64(24)).view(np.int64)
        key[entropy < LEAST] = -1
        # No window reaches over the end of its text; so those of two texts are more than NEAR places apart.
        key[np.repeat(starts[1:], text_sizes)[:m] - np.arange(m) < WINDOW] = -1
        pad = np.full(NEAR, -1, np.int64)
        most, size = np.concatenate([pad, key, pad]), 1
        while size < 2 * NEAR + 1:
            step = min(size, 2 * NEAR + 1 - size)
            most = np.maximum(most[:-step], most[step:])
            size += step
        at = np.flatnonzero((key >= 0) & (key == most))
        hashes, owner = window[at], np.searchsorted(starts, at, side="right") - 1
    count = np.bincount(owner, minlength=len(text_sizes))
    bare = np.flatnonzero((count == 0) & (text_sizes > 0))
    if len(bare):
        short = [_short(data[starts[k] : starts[k + 1]]) for k in bare]
        hashes, owner = np.concatenate([hashes, *short]), np.concatenate([owner, np.repeat(bare, [len(x) for x in short])])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def _short(own: np.ndarray) -> np.ndarray:
    """Hashes of the different runs of SHORT bytes of one text without other features (of all of it, if shorter)."""
    if len(own) <= SHORT:
        return np.array([int.from_bytes(hashlib.sha256(own.tobytes()).digest()[:8], "little")], np.uint64)
    runs = np.lib.stride_tricks.sliding_window_view(own, SHORT)
    scale = ODD ** np.arange(SHORT, dtype=np.uint64)
    return np.unique(mix64((_CODES[runs] * scale).sum(1, dtype=np.uint64)))


def filters(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters of n texts (rows of bytes) and where each text's chain starts, one more at the end."""
    count = np.bincount(owner, minlength=n)
    chain = -(-count // PER_FILTER)
    first = np.concatenate([[0], np.cumsum(chain)])
    nth = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(count)])[owner]
    row = first[owner] + nth // PER_FILTER
    bits = np.zeros(int(first[-1]) * _BITS, np.uint8)
    for k in range(5):
        bits[row * _BITS + ((hashes >> np.uint64(11 * k)) & np.uint64(_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits.reshape(-1, _BITS), axis=1), first


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared bits beyond chance, as part of the most that could be shared, for filters side by side."""
    na, nb = np.bitwise_count(a).sum(-1, dtype=np.int64), np.bitwise_count(b).sum(-1, dtype=np.int64)
    shared = np.bitwise_count(a & b).sum(-1, dtype=np.int64)
    chance = na * nb / _BITS
    most = np.minimum(na, nb)
    return np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0.0, 1.0)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Likeness of the digests of two lists of texts, pair by pair."""
    (fa, sa), (fb, sb) = a, b
    na, nb = np.diff(sa), np.diff(sb)
    out = np.where((na == 0) & (nb == 0), 1.0, 0.0)
    single = (na == 1) & (nb == 1)
    if single.any():
        out[single] = _overlap(fa[sa[:-1][single]], fb[sb[:-1][single]])
    for k in np.flatnonzero((na > 0) & (nb > 0) & ~single):
        x, y = fa[sa[k] : sa[k + 1]], fb[sb[k] : sb[k + 1]]
        if len(x) > len(y):
            x, y = y, x
        best = np.zeros(len(x))
        for shift in range(-BAND, BAND + 1):
            a, b = max(0, -shift), min(len(x), len(y) - shift)
            if a < b:
                best[a:b] = np.maximum(best[a:b], _overlap(x[a:b], y[a + shift : b + shift]))
        out[k] = float(best.mean())
    return out


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    hashes, owner = features(np.frombuffer(b"".join(raw), np.uint8), starts)
    return filters(hashes, owner, len(texts))


def as_text(found: tuple[np.ndarray, np.ndarray]) -> list[str]:
    rows, first = found
    return [base64.b64encode(rows[a:b].tobytes()).decode() for a, b in zip(first[:-1], first[1:])]


def edited(text: str, following: str) -> str:
    """text with its last floor(n/4) code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def place_of(df: DataFrame, key: str) -> Column:
    """A number that orders rows as the key does, up to ties; nulls lowest."""
    kind = df.schema[key].dataType
    if isinstance(kind, StringType):
        (number,) = ordered_number(df, [key])
        return number
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        number = F.col(quoted(key)).cast("timestamp").cast("double")
    elif isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return F.coalesce(F.col(quoted(key)).cast("long"), F.lit(-(1 << 63)))
    else:
        number = F.col(quoted(key)).cast("double")
    return F.coalesce(number, F.lit(float("-inf")))


def part_of(place: Column, cuts: list) -> Column:
    """Number of cuts below place, by two short steps: first among every so many of them, then within that stretch."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    stretches = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = F.size(F.filter(F.array(*[F.lit(x[-1]) for x in stretches]), lambda c: c < place))
    fine = F.get(F.array(*[F.array(*[F.lit(c) for c in x]) for x in stretches]), coarse)
    within = F.coalesce(F.size(F.filter(fine, lambda c: c < place)), F.lit(0))
    return F.least(coarse * step, F.lit(len(cuts))) + F.when(coarse < len(stretches), within).otherwise(0)


def with_successor(df: DataFrame, key: str, text: str) -> DataFrame:
    """(part, copy, p, k, t) rows in range partitions, sorted; each part also has, marked, the first row of the next one."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = place_of(df, key)
    rows = df.select(place.alias("p"), F.col(quoted(key)).alias("k"), F.coalesce(quoted(text), F.lit("")).alias("t"))
    cuts = rows.agg(F.percentile_approx("p", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))  # one number for each partition
    rows = rows.withColumn("part", part_of(F.col("p"), cuts).cast("int"))
    firsts = sorted((r["part"], r["first"]) for r in rows.groupBy("part").agg(F.min("p").alias("first")).collect())
    if not firsts:
        return rows.withColumn("copy", F.lit(0)).select("part", "copy", "p", "k", "t")
    # Rows that may be the first of a part also go to the part before; those of the first part to the last one.
    kinds = StructType([StructField("p", rows.schema["p"].dataType), StructField("before", IntegerType())])
    before = df.sparkSession.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], kinds)
    home = F.struct(F.col("part").alias("part"), F.lit(0).alias("copy"))
    away = F.struct(F.col("before").alias("part"), F.lit(1).alias("copy"))
    spread = rows.join(F.broadcast(before), "p", "left")  # one row for each partition
    spread = spread.withColumn("go", F.explode(F.when(F.col("before").isNotNull(), F.array(home, away)).otherwise(F.array(home))))
    laid = spread.select("go.part", "go.copy", "p", "k", "t")
    return laid.repartition(max(parts, 1), "part").sortWithinPartitions("part", "copy", "p", "k", "t")


def fingerprint_all(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    kinds = {"n_chars": LongType(), "edited_sha256": StringType(), "fingerprint": StringType(), "edited_fingerprint": StringType(), "near_edited": DoubleType(), "near_next": DoubleType()}
    schema = StructType([StructField(key, df.schema[key].dataType), *(StructField(c, k) for c, k in kinds.items())])
    sort = to_arrow_type(df.schema[key].dataType)

    def finish(keys: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        """Rows of all texts but the last, which only follows."""
        own = texts[:-1]
        for a, b in chunks(own, CHUNK_BYTES // 2):
            now, after = own[a:b], texts[a + 1 : b + 1]
            new = [edited(x, y) for x, y in zip(now, after)]
            base = digests([*now, after[-1]])
            mine, their = (base[0], base[1][:-1]), (base[0], base[1][1:])
            made = digests(new)
            sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[a:b], sort), pa.array([len(x) for x in now], pa.int64()), pa.array(sha), pa.array(as_text(mine)), pa.array(as_text(made)), pa.array(likeness(mine, made)), pa.array(likeness(mine, their))],
                names=schema.names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        texts: list[str] = []
        size, part, closed = 0, None, True
        for batch in batches:
            rows = ((p, copy, k, t) for a, b, texts in text_chunks(batch, 4) for p, copy, k, t in zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in (0, 1, 3)), texts))
            for p, copy, k, t in rows:
                if p != part:
                    part, closed, keys, texts, size = p, False, [], [], 0
                if closed:
                    continue  # more rows of the key that the next partition starts with
                keys.append(k)
                texts.append(t)
                size += len(t)
                if copy:
                    yield from finish(keys, texts)
                    closed = True
                elif size > CHUNK_BYTES and len(texts) > 1:
                    yield from finish(keys, texts)
                    keys, texts, size = keys[-1:], texts[-1:], len(t)
        # A part always ends with its copied row, so nothing is left here.
        trim()

    return with_successor(df, key, text).mapInArrow(run, schema)
