"""Documents linked by Jaccard similarity of their word shingles: a count-vector R-tree join.

A document's set is its distinct shingles of WIDTH words (as 64-bit hashes); equal sets are one node.  Two nodes
link when ``100 * intersection >= PERCENT * union``.  Shingles are hashed into groups; a node's group counts are its
point.  The sum over groups of the smaller of two counts bounds the intersection of two sets from above, for two
points and for a point and the upper corner of a box alike.

* Top of the tree.  With one group for each shingle, points that share none of their leading n - ceil(n * PERCENT /
  100) + 1 coordinates cannot reach the bound, in any order of the coordinates.  So a node is entered under each of its
  leading coordinates, and only nodes of one coordinate can meet.  A coordinate with up to LISTED nodes is one leaf: its
  pairs are bounded by points (64 to 1024 groups, by set size).  So are, shortest first, longer ones with up to one of
  SHARED nodes, while a bucket's pairs of these are no more than PAIRED for each of its entries: what strangers share by chance
  grows with the table, and must not join all of it.  A coordinate with more nodes holds them together as they are.  The order goes from long shingles to short ones, since the number of strangers that share a run of short,
  frequent words grows with the square of the table, and puts shingles that many documents repeat last; it never
  decides a result.
* Cells.  The connected components of what may meet are the cells.
* Blocks.  A cell is packed by coordinates (the least shingle, then the size) into blocks of up to BLOCK_NODES nodes.  In a
  block an R-tree (CountTree) is searched for each point, and what it leaves is verified on the sets.
* Between blocks.  Every block of a split cell also gets a few centres of the cell.  Nodes that are still outside the
  cell's largest component then search the boxes of the cell's other blocks (upper corner over BOX_GROUPS groups, range
  of sizes) and visit the blocks whose box does not rule a link out.  Boxes are dealt in pages of PAGE, so
  a node outside is copied once for each page of its cell (and for each block it visits), not for each block.
* Components.  Verified links form components over all cells.

Memory: a task holds one block (at most BLOCK_NODES nodes or BLOCK_BYTES of sets, a larger set alone), one page of boxes,
or one bucket of coordinates (500,000 entries of 11 bytes on average).  Coordinates of more than SALTED nodes are dealt in
parts; a coordinate that no window of COUNTED shingles repeats has at most one entry for each window.  On disk lie, beside
the entries, the sets of one round of cells (three times at most: held, shuffled to their cells, and to their blocks).  Broadcast are only the
RANKED most repeated shingles at most, and a bitmap of fixed size that says which texts are in cells.

Shingles are 58 bits of hash below 6 bits of length.  Nodes have 64-bit hashes of sets: among 1e9 different sets one pair
in about 37 such corpora would collide.  While
candidates are sought nodes go by 48 bits and coordinates by 32 bits in their bucket: a collision there only adds a candidate.

Defined results: null text and text without words have no shingles and no links; texts of fewer words than WIDTH
have one shingle, the whole sequence; very long texts are read whole, one at a time; repeated rows stay and are equal
sets; a null key takes part but is no smallest key; ties cannot occur (links are exact, the least key is unique); an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import ODD, discard, materialize, mix64, power_tables, quoted, release, text_chunks, trim
from .components import CHUNK, components, forest, thinned

WIDTH, PERCENT = 5, 75
#: Points of an R-tree leaf, boxes of an inner node; groups of a block's tree for each element of its largest set, at most.
LEAF, FANOUT, SPREAD, BOX_GROUPS = 8, 8, 16, 1 << 16
#: Nodes and bytes of sets of a block at most; centres of a split cell; boxes of a page; nodes that search a page in one task.
BLOCK_NODES, BLOCK_BYTES, CENTRES, PAGE, SEARCHING = 128, 16 << 20, 8, 32, 4096
#: Rounds in which cells are verified, were all sets of the table in cells: fewer, if fewer are; bytes of sets that are
#: no round of their own.
ROUNDS, ROUND_BYTES = 5, 32 << 20
#: Shingles counted at a time while looking for repeated ones; local count from which one is reported; sum from
#: which it is ordered last, by that sum; most of them; nodes of a part of a shingle that more nodes have.
COUNTED, LOCAL, REPEATED, RANKED, SALTED = 2_000_000, 2, 8, 500_000, 2000
BITMAP_WORDS = 1 << 20
#: Nodes of a coordinate up to which all its pairs are looked at one by one; one of how many nodes of a large table may share such
#: a coordinate; pairs of those for each entry of a bucket; pairs that are joined with their points at a time.
LISTED, SHARED, PAIRED, POINTED = 48, 5000, 0.25, 4_000_000
#: Entries of coordinates that a task packs at a time; buckets of coordinates for each partition.
POSTED, BUCKETS = 400_000, 4
#: Sizes go by their logarithm to this base while candidates are sought; linked sets differ by up to SIZE_STEPS.
SIZE_BASE, SIZE_STEPS = 1.06, 5
#: Bits of a shingle that say how long it is, the longest first; bytes of words from which all count as longest.
LENGTH_BITS, LONGEST = 6, 71

_STEPS = mix64(np.arange(101, 101 + 16, dtype=np.uint64)) | np.uint64(1)
_SPACES = (9, 10, 11, 12, 13, 32)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256)
    lower[65:91] += 32
    codes = mix64(lower.astype(np.uint64) + np.uint64(1))
    word = np.ones(256, bool)
    word[list(_SPACES)] = False
    return codes, word


_CODES, _WORD = _tables()

def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted: longer shingles come first (by the bytes of their words)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    up, down = power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * up[: len(data)], out=total[1:])
    inside = np.concatenate([[False], _WORD[data], [False]]).astype(np.int8)
    turn = np.diff(inside)
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    words = mix64((total[end] - total[begin]) * down[begin])
    first = np.searchsorted(begin, starts)
    n = len(words) - WIDTH + 1
    runs = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(WIDTH):
            runs += words[k : k + n] * _STEPS[k]
        upto = np.concatenate([[0], np.cumsum(end - begin)])
        most = 1 << LENGTH_BITS
        length = np.clip(LONGEST - (upto[WIDTH:] - upto[:-WIDTH]), 0, most - 1).astype(np.uint64)
        runs = mix64(runs) >> np.uint64(LENGTH_BITS) | length << np.uint64(64 - LENGTH_BITS)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(runs[a : b - WIDTH + 1]))
        elif b > a:
            short = int((words[a:b] * _STEPS[8 : 8 + b - a]).sum(dtype=np.uint64)) + b - a
            out.append(mix64(np.array([short & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(shingles: np.ndarray) -> int:
    """64-bit hash of a set, as a signed integer."""
    s = int(mix64(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) + len(shingles) * int(ODD)
    return int(mix64(np.array([s & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0])


def point_of(shingles: np.ndarray) -> bytes:
    """Group counts of a set: 64 groups, 256 from 400 elements, 1024 from 1600; empty where a count needs more than a byte."""
    groups = 64 if len(shingles) < 400 else 256 if len(shingles) < 1600 else 1024
    counts = np.bincount((shingles >> np.uint64(17)).astype(np.int64) & (groups - 1), minlength=groups)
    return counts.astype(np.uint8).tobytes() if len(shingles) and counts.max() < 256 else b""


def may_link(a: bytes, n: int, b: bytes, m: int) -> bool:
    """Whether two points allow their sets (of n and m elements) to link; finer points are folded to coarser ones."""
    if not a or not b:
        return True
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    groups = min(len(x), len(y))
    if len(x) != len(y):
        x, y = (v.reshape(-1, groups).sum(0, dtype=np.uint32) for v in (x, y))
    common = int(np.minimum(x, y).sum(dtype=np.int64))
    return (100 + PERCENT) * common >= PERCENT * (n + m)


def _sets(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        for a, _, texts in text_chunks(batch, column):
            yield batch, a, shingle_sets(texts)


def prefix(n: Column | int) -> Column | int:
    """Leading coordinates of a set of n: two sets that link share one of them."""
    return n - -(-n * PERCENT // 100) + 1 if isinstance(n, int) else n - F.ceil(n * PERCENT / 100) + 1


def survey(df: DataFrame) -> DataFrame:
    """df: key, text.  Rows (key, node, n, lead, point) of all texts, and rows (shingle, seen) of shingles repeated
    within a part of the table."""
    schema = StructType([StructField("key", df.schema["key"].dataType), *(StructField(c, LongType()) for c in ("node", "n", "lead")), StructField("point", BinaryType()), StructField("shingle", LongType()), StructField("seen", LongType())])
    names = schema.names

    def repeated(kept: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        values, count = np.unique(np.concatenate(kept), return_counts=True)
        often = count >= LOCAL
        return values[often].view(np.int64), count[often]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        known: set[int] = set()
        size, sort = 0, None

        def report() -> pa.RecordBatch:
            values, count = repeated(kept)
            m = len(values)
            none = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(m, sort), none, none, none, pa.nulls(m, pa.binary()), pa.array(values), pa.array(count.astype(np.int64))], names=names)

        for batch, a, sets in _sets(batches, 1):
            sort = batch.column(0).type
            nodes = [node_of(s) for s in sets]
            m = len(sets)
            for node, s in zip(nodes, sets):
                if node not in known:
                    known.add(node)
                    kept.append(s)
                    size += len(s)
            lead = pa.array(np.array([s[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64))
            none = pa.nulls(m, pa.int64())
            sizes, points = pa.array([len(s) for s in sets], pa.int64()), pa.array([point_of(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), pa.array(nodes, pa.int64()), sizes, lead, points, none, none], names=names)
            if size > COUNTED:
                yield report()
                kept, known, size = [], set(), 0
        if sort is not None:
            yield report()
        kept, known = [], set()
        trim()

    return df.select("key", "text").mapInArrow(run, schema)


def size_code(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log(np.maximum(n, 1)) / np.log(SIZE_BASE) + 1e-9, 255).astype(np.uint8)


def packed(key: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> bytes:
    """Entries of one bucket: keys (4 or 12 bytes each), the nodes' 48 bits, size codes."""
    return key.tobytes() + (nodes & 0xFFFFFFFF).astype(np.uint32).tobytes() + (nodes >> 32).astype(np.uint16).tobytes() + sizes.tobytes()


def unpacked(blobs: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, nodes, sizes = [], [], []
    for blob in blobs:
        m = len(blob) // (kind.itemsize + 7)
        ends = np.cumsum([0, kind.itemsize * m, 4 * m, 2 * m, m])
        key, low, high, size = (np.frombuffer(blob[x:y], k) for x, y, k in zip(ends[:-1], ends[1:], (kind, np.uint32, np.uint16, np.uint8)))
        keys.append(key)
        nodes.append(low.astype(np.int64) | high.astype(np.int64) << 32)
        sizes.append(size)
    return np.concatenate(keys), np.concatenate(nodes), np.concatenate(sizes)


#: Keys in the packed entries: 32 bits of a shingle in its bucket; a whole shingle and its part, where it has parts.
_PLAIN, _PARTED = np.dtype(np.uint32), np.dtype([("shingle", "<u8"), ("part", "<u4")])


def entries(df: DataFrame, ranked: np.ndarray, seen: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, parted, packed) of the leading coordinates of every node; copies within a part of the table once.

    ranked: sorted repeated shingles; seen: how often each was seen.  Coordinates are ordered by (seen, hash).
    """
    shared = df.sparkSession.sparkContext.broadcast((ranked, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, times = shared.value
        known: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def dealt() -> Iterator[pa.RecordBatch]:
            token, part, node, size = (np.concatenate(x) for x in zip(*held))
            parted = part > 0
            out_bucket, out_kind, out = [], [], []
            for kind in (False, True):
                own = np.flatnonzero(parted == kind)
                if not len(own):
                    continue
                mixed = mix64(token[own] + part[own].astype(np.uint64) * ODD)
                place = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                own, place = own[order], place[order]
                if kind:
                    key = np.empty(len(own), _PARTED)
                    key["shingle"], key["part"] = token[own], part[own]
                else:
                    key = mixed[order].astype(np.uint32)
                first = np.flatnonzero(np.diff(place, prepend=-1))
                for x, y in zip(first.tolist(), [*first[1:].tolist(), len(place)]):
                    out_bucket.append(int(place[x]))
                    out_kind.append(kind)
                    out.append(packed(key[x:y], node[own[x:y]], size[own[x:y]]))
            for x in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(out_bucket[x : x + 256], pa.int32()), pa.array(out_kind[x : x + 256]), pa.array(out[x : x + 256], pa.binary())], names=["bucket", "parted", "packed"])

        for _, _, sets in _sets(batches, 1):
            if len(known) > 200_000:
                known = set()
            fresh = []
            for s in sets:
                node = node_of(s) if len(s) else 0
                if len(s) and node not in known:
                    known.add(node)
                    fresh.append((node, s))
            if not fresh:
                continue
            flat = np.concatenate([s for _, s in fresh])
            if len(last):
                place = np.minimum(np.searchsorted(last, flat), len(last) - 1)
                late = np.where(last[place] == flat, times[place], 0)
            else:
                late = np.zeros(len(flat), np.int64)
            at, tokens, flags, lengths = 0, [], [], []
            for _, s in fresh:
                n = len(s)
                most = prefix(n)
                is_late = late[at : at + n]
                at += n
                if is_late[:most].any():
                    order = np.argsort(is_late, kind="stable")[:most]
                    tokens.append(s[order])
                    flags.append(is_late[order])
                else:
                    tokens.append(s[:most])
                    flags.append(is_late[:most])
                lengths.append(most)
            node = np.repeat(np.array([x for x, _ in fresh], np.int64), lengths)
            flag = np.concatenate(flags)
            part = np.where(flag >= SALTED, 1 + (mix64(node.view(np.uint64)) % (1 + flag // (SALTED // 2)).astype(np.uint64)).astype(np.int64), 0)
            codes = np.repeat(size_code(np.array([len(s) for _, s in fresh])), lengths)
            held.append((np.concatenate(tokens), part, (node >> 16) & 0xFFFFFFFFFFFF, codes))
            count += len(node)
            if count > POSTED:
                yield from dealt()
                held, count = [], 0
        if held:
            yield from dealt()
        held, known = [], set()
        trim()

    return df.select("key", "text").mapInArrow(run, "bucket int, parted boolean, packed binary")


def runs(key: np.ndarray, node: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by key and node, each once; start of each key's run, one more at the end."""
    order = np.lexsort((node, key)) if key.dtype == _PLAIN else np.lexsort((node, key["part"], key["shingle"]))
    key, node, size = key[order], node[order], size[order]
    other = key[1:] != key[:-1]
    once = np.concatenate([[True], other | (node[1:] != node[:-1])])
    key, node, size = key[once], node[once], size[once]
    return key, node, size, np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def met_in(key: np.ndarray, node: np.ndarray, size: np.ndarray, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of two nodes) of coordinates with up to LISTED nodes (or `most`, while PAIRED allows it) whose sizes allow a
    link, and edges that hold more together."""
    _, node, size, start = runs(key, node, size)
    length = np.diff(start)
    listed = length <= LISTED
    longer = np.flatnonzero(~listed & (length <= most))
    longer = longer[np.argsort(length[longer], kind="stable")]
    listed[longer[np.cumsum(length[longer] * (length[longer] - 1) // 2) <= PAIRED * len(node)]] = True
    listed = np.repeat(listed, length)
    after = np.repeat(start[1:], length) - np.arange(len(node))  # entries of the run from each one on
    ahead = np.flatnonzero(listed & (after > 1))
    pairs = []
    step = 1
    while len(ahead):
        near = np.abs(size[ahead].astype(np.int16) - size[ahead + step]) <= SIZE_STEPS
        pairs.append(np.stack([node[ahead[near]], node[ahead[near] + step]], axis=1))
        step += 1
        ahead = ahead[after[ahead] > step]
    found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    first = np.repeat(start[:-1], length)
    long = np.flatnonzero(~listed & (first < np.arange(len(node))))
    return found, np.unique(np.stack([node[long], node[first[long]]], axis=1), axis=0)


def meetings(posted: DataFrame, parts: int, most: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) that may link, edges (a, b) that hold nodes of one coordinate together, and the table both are read from;
    most as for met_in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []

        def rows(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), kind, np.int32))], names=["a", "b", "kind"])

        def close() -> Iterator[pa.RecordBatch]:
            if now[1]:
                key, node, _, start = runs(*unpacked(blobs, _PARTED))
                first = np.repeat(start[:-1], np.diff(start))
                more = np.flatnonzero(first < np.arange(len(node)))
                yield rows(node[more], node[first[more]], 1)
                # The parts of one shingle are joined by their first nodes.
                yield rows(node[start[:-1]], key["shingle"][start[:-1]].view(np.int64), 2)
            else:
                pairs, edges = met_in(*unpacked(blobs, _PLAIN), most)
                for x in range(0, len(pairs), 100_000):
                    yield rows(pairs[x : x + 100_000, 0], pairs[x : x + 100_000, 1], 0)
                yield rows(edges[:, 0], edges[:, 1], 1)

        for batch in batches:
            for bucket, parted, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, parted) != now:
                    if blobs:
                        yield from close()
                    now, blobs = (bucket, parted), []
                blobs.append(blob)
        if blobs:
            yield from close()
        blobs = []
        trim()

    dealt = posted.repartition(parts, "bucket").sortWithinPartitions("bucket", "parted")
    met = materialize(dealt.mapInArrow(run, "a long, b long, kind int"), "jaccard-met")
    pairs = met.filter(F.col("kind") == 0).select("a", "b").distinct()
    firsts = met.filter(F.col("kind") == 2).select("a", F.col("b").alias("shingle"))
    across = firsts.join(firsts.groupBy("shingle").agg(F.min("a").alias("b")), "shingle").filter(F.col("a") != F.col("b")).select("a", "b")
    return pairs, met.filter(F.col("kind") == 1).select("a", "b").unionByName(across), met


def allowed_pairs(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Edges (a, b) that join the nodes of all pairs whose points allow a link.  points: short, n, point."""
    left = points.select(F.col("short").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
    right = points.select(F.col("short").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                ends, others, na, nb, x, y = (batch.column(i).slice(k, 2000).to_pylist() for i in range(6))
                kept = [i for i in range(len(ends)) if may_link(x[i], na[i], y[i], nb[i])]
                a += [ends[i] for i in kept]
                b += [others[i] for i in kept]
            if len(a) >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in forest(a, b)], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in forest(a, b)], names=["a", "b"])
        trim()

    return both.mapInArrow(run, "a long, b long")


def pointed(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """allowed_pairs of POINTED pairs at a time: points are many times longer than pairs, and lie on disk for one part only."""
    spark = pairs.sparkSession
    pairs = materialize(pairs, "jaccard-pairs")
    rounds = max(1, -(-pairs.count() // POINTED))
    found = None
    for k in range(rounds):
        own = materialize(allowed_pairs(pairs.filter(F.pmod(F.xxhash64("a"), F.lit(rounds)) == k), points), "jaccard-allowed")
        found = own if found is None else found.unionByName(own)
        if rounds > 1:
            release(spark)
    discard(pairs)
    return found


def bitmap_of(nodes: DataFrame) -> np.ndarray:
    """Bitmap of fixed size with one bit set for each node."""
    word = F.shiftright("node", 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)).cast("int")
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(node & 63 AS INT))")
    found = nodes.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toPandas()
    out = np.zeros(BITMAP_WORDS, np.uint64)
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).view(np.uint64)
    return out


def cell_sets(df: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(node, shingles as bytes) of the texts whose node is in the bitmap, copies within a part once."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        known: set[int] = set()
        for _, _, sets in _sets(batches, 1):
            rows = []
            if len(known) > 200_000:
                known = set()
            for s in sets:
                if len(s):
                    node = node_of(s)
                    bits = int(words[(node >> 6) & (BITMAP_WORDS - 1)])
                    if bits >> (node & 63) & 1 and node not in known:
                        known.add(node)
                        rows.append((node, s.tobytes()))
            if rows:
                node, own = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(own, pa.binary())], names=["node", "shingles"])
        known = set()
        trim()

    return df.select("key", "text").mapInArrow(run, "node long, shingles binary")


def group_counts(shingles: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups (a power of two of them) that a set has elements in, and how many in each."""
    return np.unique((shingles >> np.uint64(17)).astype(np.int64) & (groups - 1), return_counts=True)


def corner(points: list[tuple[np.ndarray, np.ndarray]], groups: int) -> np.ndarray:
    """Upper corner of points, as bytes; 255 stands for 255 and more."""
    upper = np.zeros(groups, np.uint8)
    for at, count in points:
        upper[at] = np.maximum(upper[at], np.minimum(count, 255))
    return upper


def overlap(upper: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bound of what the sets in boxes (rows of upper corners) share with a point: the sum of smaller counts."""
    own = upper[:, at].astype(np.int64)
    return np.where(own == 255, count, np.minimum(own, count)).sum(1)


def fits(common: np.ndarray, size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which boxes (bounds of the overlap, ranges of sizes) may hold a set that links with one of the given size."""
    sizes = (low * PERCENT <= size * 100) & (high * 100 >= size * PERCENT)
    # Links need 100 * common >= PERCENT * (size + other - common); the box's least size asks least.
    return sizes & ((100 + PERCENT) * common >= PERCENT * (size + np.maximum(low, -(-size * PERCENT // 100))))


class CountTree:
    """R-tree over group counts of sets, packed by coordinates: by the first group that a set has, then by size.

    The groups are so many (SPREAD for each element of the largest set) that the upper corner of a leaf of unrelated
    sets leaves most groups empty; boxes also keep the range of sizes.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in sets], np.int64)
        self.groups = 1 << min(max((SPREAD * int(sizes.max(initial=1))).bit_length(), 6), BOX_GROUPS.bit_length() - 1)
        points = [group_counts(s, self.groups) for s in sets]
        lead = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((sizes, lead))
        self.points, self.sizes = [points[i] for i in self.order], sizes[self.order]
        n = len(sets)
        cuts = np.arange(0, n, LEAF)
        upper = np.stack([corner(self.points[a : a + LEAF], self.groups) for a in cuts]) if n else np.zeros((0, self.groups), np.uint8)
        # (upper corners, least size, largest size, first child, one past the last child), leaves first
        self.levels = [(upper, np.minimum.reduceat(self.sizes, cuts), np.maximum.reduceat(self.sizes, cuts), cuts, np.append(cuts[1:], n))] if n else []
        while n and len(self.levels[-1][0]) > FANOUT:
            upper, low, high, _, _ = self.levels[-1]
            cuts = np.arange(0, len(upper), FANOUT)
            self.levels.append((np.maximum.reduceat(upper, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), cuts, np.append(cuts[1:], len(upper))))

    def search(self, shingles: np.ndarray) -> np.ndarray:
        """The sets (places in the list given) that the bound allows to link with this one."""
        if not self.levels or not len(shingles):
            return np.zeros(0, np.int64)
        at, count = group_counts(shingles, self.groups)
        size = len(shingles)
        boxes = np.arange(len(self.levels[-1][0]))
        for upper, low, high, first, last in reversed(self.levels):
            boxes = boxes[fits(overlap(upper[boxes], at, count), size, low[boxes], high[boxes])]
            if not len(boxes):
                return boxes
            width = last[boxes] - first[boxes]
            boxes = np.repeat(first[boxes] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        own = np.zeros(self.groups, np.int64)
        own[at] = count
        common = np.array([int(np.minimum(own[a], c).sum()) for a, c in (self.points[k] for k in boxes)])
        return self.order[boxes[fits(common, size, self.sizes[boxes], self.sizes[boxes])]]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < PERCENT * len(b):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def join_block(nodes: list[int], sets: list[np.ndarray], asking: np.ndarray, resident: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect nodes of a block further than root says, between asking and resident nodes (a node may be both)."""
    home = np.flatnonzero(resident)
    tree = CountTree([sets[i] for i in home])
    root, found = root.copy(), []
    for i in np.flatnonzero(asking).tolist():
        near = home[tree.search(sets[i])]
        near = near[(root[near] != root[i]) & ~(resident[i] & asking[near] & (near < i))]  # two that are both meet once
        while len(near):
            j = int(near[0])
            if linked(sets[i], sets[j]):
                found.append((nodes[i], nodes[j]))
                root[root == root[j]] = root[i]
            near = near[1:]
            near = near[root[near] != root[i]]
    return found


def join_blocks(held: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (a, b) for links within every block.  held: node, shingles; plan: node, cell, block, asking, resident, root."""
    rows = held.join(plan, "node")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.select("cell", "block", "node", "shingles", "asking", "resident", "root").repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets, asking, resident, root = None, [], [], [], [], []
        links: list[tuple[int, int]] = []

        def close() -> None:
            if len(nodes) > 1 and any(asking):
                ids = {r: k for k, r in enumerate(dict.fromkeys(root))}
                links.extend(join_block(nodes, sets, np.array(asking), np.array(resident), np.array([ids[r] for r in root])))

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])
            links.clear()
            return out

        for batch in batches:
            cells, blocks, ids, _, asks, lives, roots = (c.to_pylist() if k != 3 else None for k, c in enumerate(batch.columns))
            for k, (cell, block, node, ask, live, r) in enumerate(zip(cells, blocks, ids, asks, lives, roots)):
                if (cell, block) != now:
                    close()
                    now, nodes, sets, asking, resident, root = (cell, block), [], [], [], [], []
                if nodes and nodes[-1] == node:  # the same set from another part of the table, or a centre at home
                    asking[-1], resident[-1] = asking[-1] or ask, resident[-1] or live
                    continue
                nodes.append(node)
                sets.append(np.frombuffer(batch.column(3)[k].as_py(), np.uint64))
                asking.append(ask)
                resident.append(live)
                root.append(r)
            if links:
                yield batch_of()
        close()
        if links:
            yield batch_of()
        nodes, sets = [], []
        trim()

    return laid.mapInArrow(run, "a long, b long")


def packed_blocks(split: DataFrame) -> DataFrame:
    """split (node, cell, n, lead) with block: cells packed by lead and size into blocks of BLOCK_NODES or BLOCK_BYTES."""
    parts = int(split.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["cell", "lead", "n", "node"]
    weight = F.greatest(F.lit(1.0), F.col("n") * 8 * (BLOCK_NODES / BLOCK_BYTES))
    laid = split.select("node", "cell", "n", "lead", weight.alias("weight")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = materialize(laid.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "jaccard-laid")
    # A running sum within a part of the order; what lies before the part is one number for each part.
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return laid.withColumn("sum", F.sum("weight").over(inside)).select(
        "node", "cell", "n", F.concat_ws(":", "part", F.floor((F.col("sum") - F.col("weight")) / BLOCK_NODES).cast("long")).alias("block")
    )


def boxes_of(held: DataFrame, plan: DataFrame) -> DataFrame:
    """(cell, block, low, high, upper) of every block of plan (node, cell, block), made of the sets in held."""
    rows = held.join(plan, "node").select("cell", "block", "node", "shingles")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartition(parts, "cell", "block").sortWithinPartitions("cell", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, upper, low, high = None, None, 0, 0

        def box() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.string()), pa.array([low], pa.int64()), pa.array([high], pa.int64()), pa.array([upper.tobytes()], pa.binary())],
                names=["cell", "block", "low", "high", "upper"],
            )

        for batch in batches:
            for cell, block, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                s = np.frombuffer(own.as_py(), np.uint64)
                if (cell, block) != now:
                    if now:
                        yield box()
                    now, upper, low, high = (cell, block), np.zeros(BOX_GROUPS, np.uint8), len(s), len(s)
                at, count = group_counts(s, BOX_GROUPS)
                upper[at] = np.maximum(upper[at], np.minimum(count, 255))
                low, high = min(low, len(s)), max(high, len(s))
        if now:
            yield box()

    return laid.mapInArrow(run, "cell long, block string, low long, high long, upper binary")


def visits(held: DataFrame, outside: DataFrame, boxes: DataFrame) -> DataFrame:
    """(node, cell, block): the blocks of its cell that each outside node (node, cell, block) must visit, by their boxes."""
    nth = boxes.select("cell", "block").withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("block")) - 1)
    numbered = boxes.join(nth.select("cell", "block", F.floor(F.col("nth") / PAGE).cast("int").alias("page")), ["cell", "block"])
    slices = outside.groupBy("cell").agg(F.ceil(F.count("*") / SEARCHING).cast("int").alias("slices"))
    paged = boxes.groupBy("cell").agg(F.ceil(F.count("*") / PAGE).cast("int").alias("pages")).join(slices, "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shelf = numbered.join(slices, "cell").select("cell", "page", every("slices").alias("slice"), F.lit(None).cast("long").alias("node"), "block", "low", "high", F.col("upper").alias("own"))
    asked = held.join(outside, "node").join(paged, "cell").select(
        "cell", every("pages").alias("page"), F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("slice"), "node", "block", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), F.col("shingles").alias("own")
    )
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = shelf.unionByName(asked).repartition(parts, "cell", "page", "slice").sortWithinPartitions("cell", "page", "slice", F.col("node").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, low, high, upper, stacked = None, [], [], [], [], None
        for batch in batches:
            cells, pages, parts_, nodes, blocks, lows, highs = (batch.column(k).to_pylist() for k in range(7))
            found: list[tuple[int, int, str]] = []
            for k, node in enumerate(nodes):
                if (cells[k], pages[k], parts_[k]) != now:
                    now, names, low, high, upper, stacked = (cells[k], pages[k], parts_[k]), [], [], [], [], None
                own = batch.column(7)[k].as_py()
                if node is None:
                    names.append(blocks[k])
                    low.append(lows[k])
                    high.append(highs[k])
                    upper.append(np.frombuffer(own, np.uint8))
                    continue
                if stacked is None:
                    stacked = (np.stack(upper), np.array(low), np.array(high))
                s = np.frombuffer(own, np.uint64)
                passed = fits(overlap(stacked[0], *group_counts(s, BOX_GROUPS)), len(s), stacked[1], stacked[2])
                found += [(node, cells[k], names[x]) for x in np.flatnonzero(passed).tolist() if names[x] != blocks[k]]
            if found:
                node, cell, block = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(cell, pa.int64()), pa.array(block, pa.string())], names=["node", "cell", "block"])

    return laid.mapInArrow(run, "node long, cell long, block string").distinct()


def cell_links(df: DataFrame, sized: DataFrame) -> DataFrame:
    """Verified links (a, b) inside the cells of sized (node, n, lead, cell): enough of them to connect what is linked.

    Who meets whom is planned on (node, n, lead) alone; the sets are added last, and shuffled only then.
    """
    held = materialize(cell_sets(df, bitmap_of(sized.select("node"))), "jaccard-sets")
    weight = sized.groupBy("cell").agg(F.count("*").alias("nodes"), (F.sum("n") * 8).alias("bytes"))
    whole = (F.col("nodes") <= BLOCK_NODES) & (F.col("bytes") <= BLOCK_BYTES)
    yes, no = F.lit(True), F.lit(False)
    plan = sized.join(weight.filter(whole).select("cell"), "cell").select("node", "cell", F.lit("").alias("block"), yes.alias("asking"), yes.alias("resident"), F.col("node").alias("root"))
    links = materialize(join_blocks(held, plan), "jaccard-links")

    split = sized.join(weight.filter(~whole).select("cell"), "cell")
    if not split.isEmpty():
        split = materialize(packed_blocks(split), "jaccard-blocks")
        # Centres: in each split cell the smallest nodes of a few slices; every block of the cell gets them.
        slice_ = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(CENTRES))
        centres = split.groupBy("cell", slice_.alias("slice")).agg(F.min("node").alias("node"))
        everywhere = centres.select("node", "cell").join(split.select("cell", "block").distinct(), "cell")
        plan = split.select("node", "cell", "block", yes.alias("asking")).unionByName(everywhere.select("node", "cell", "block", no.alias("asking")))
        inside = materialize(join_blocks(held, plan.select("*", yes.alias("resident"), F.col("node").alias("root"))), "jaccard-inside")
        links = links.unionByName(inside)
        settled = split.join(components(inside, "jaccard-inner"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        settled = materialize(settled, "jaccard-split")
        largest = settled.groupBy("cell", "root").agg(F.count("*").alias("c")).groupBy("cell").agg(F.max(F.struct("c", "root")).alias("m")).select("cell", F.col("m.root").alias("main"))
        outside = settled.join(largest, "cell").filter(F.col("root") != F.col("main")).select("node", "cell", "block", "root")
        outside = materialize(outside, "jaccard-searching")
        if not outside.isEmpty():
            boxes = materialize(boxes_of(held, settled.join(outside.select("cell").distinct(), "cell", "left_semi").select("node", "cell", "block")), "jaccard-boxes")
            hits = materialize(visits(held, outside.select("node", "cell", "block"), boxes), "jaccard-visits")
            visiting = hits.join(outside.select("node", "root"), "node").select("node", "cell", "block", yes.alias("asking"), no.alias("resident"), "root")
            living = settled.join(hits.select("cell", "block").distinct(), ["cell", "block"], "left_semi").select("node", "cell", "block", no.alias("asking"), yes.alias("resident"), "root")
            links = links.unionByName(materialize(join_blocks(held, visiting.unionByName(living)), "jaccard-between"))
    discard(held)
    release(df.sparkSession)
    return links


def link_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) for every row."""
    df = df.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
    seen = materialize(survey(df), "jaccard-survey")
    docs = seen.filter(F.col("node").isNotNull()).select("key", "node", "n", "lead", "point")
    repeated = seen.filter(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= REPEATED)
    ranked = repeated.orderBy(F.desc("seen"), "shingle").limit(RANKED).toPandas()
    tokens, times = ranked["shingle"].to_numpy(np.int64).view(np.uint64), ranked["seen"].to_numpy(np.int64)
    by_token = np.argsort(tokens)

    short = F.shiftrightunsigned("node", 16)
    points = docs.filter(F.col("n") > 0).dropDuplicates(["node"]).select("node", short.alias("short"), "n", "lead", "point")
    posted = docs.filter(F.col("n") > 0).agg(F.sum(prefix(F.col("n")))).first()[0] or 0
    nodes = points.count()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(posted) // 2_000_000)
    pairs, edges, met = meetings(entries(df, tokens[by_token], times[by_token], parts * BUCKETS), parts, nodes // SHARED)
    release(df.sparkSession)
    cells = components(thinned(edges).unionByName(pointed(pairs, points)), "jaccard-cells", thin=False)
    discard(met)
    release(df.sparkSession)

    sized = materialize(points.select("node", "short", "n", "lead").join(cells.select(F.col("node").alias("short"), F.col("root").alias("cell")), "short").drop("short"), "jaccard-placed")
    release(df.sparkSession)
    # Links stay within cells: the sets of a part of the cells are laid out at a time, and deleted before the next part.
    total = points.agg(F.sum("n")).first()[0] or 0
    inside = sized.agg(F.sum("n")).first()[0] or 0
    rounds = max(1, min(-(-ROUNDS * inside // max(total, 1)), -(-inside * 8 // ROUND_BYTES)))
    links = None
    for k in range(rounds):
        found = cell_links(df, sized.filter(F.pmod(F.xxhash64("cell", F.lit(2)), F.lit(rounds)) == k))
        links = found if links is None else links.unionByName(found)

    roots = components(links, "jaccard-roots")
    by_node = docs.filter(F.col("n") > 0).groupBy("node").agg(F.min("key").alias("least"))
    by_node = by_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = by_node.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = by_node.join(least, "root").select("node", "component_id")
    out = docs.select("key", "node", "n").join(by_node, "node", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))
