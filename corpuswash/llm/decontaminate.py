"""Benchmark items in documents, edits included: CGK embedding, bit-sampling LSH, exact edit distance.

An item of L code points is found in a document where some passage is within floor(L * EDITS) edits of it (texts
lower-cased, every white space one blank).  Two walks drift apart with every edit, so an item of 2 * PIECE characters
or more is embedded in pieces of PIECE to 1.5 * PIECE characters: at least one of them has no larger part of edits
than the item.  Pieces (and shorter items, which are one piece) of similar length form a class with one window
length; windows of that length start at every word of every document, at every place of words longer than LATE_WORD
(scripts without spaces, joined text), and where a piece would start by one of its first SEEDED q-grams.

* A window is looked at further only if it could hold a piece: one with k edits in L characters keeps at least
  L - q + 1 - q * k of its q-grams, so windows with fewer q-grams of the class's pieces cannot.  A class's q is so small that
  this number is positive for each of its pieces; a piece for which it is not begins another class.  Nothing is lost here.
* The CGK embedding walks through the window: at each step it writes the current character and moves on by a
  random bit that depends on step and character.  Texts at a small edit distance get outputs at a small Hamming
  distance.  Each of REPEATS hash tables samples SAMPLED positions of one of WALKS walks; a window meets the pieces
  that agree with it on all of a table's positions.
* What meets is verified by exact edit distance of the whole item to the best passage around the place where the
  item would start.

The benchmark is the stated query set: it is taken in blocks of at most BLOCK_CHARS characters, which is also
the bound of what is broadcast; every block meets all documents.

Defined results: null and empty texts and items match nothing; repeated rows are reported each; items with equal
texts are reported each; of several passages the one with fewest edits, then the first, is reported; very long texts are
read whole, one at a time; without documents or items there are no rows; extra columns are ignored by find_items and
stay in clean, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import ODD, code_points, mix64, numbered, own_names, power_tables, quoted, text_chunks, trim, without

#: Edits allowed as a part of the item's length.
EDITS = 0.1
#: Independent walks, hash tables in all, characters that a table samples.
WALKS, REPEATS, SAMPLED = 4, 192, 5
#: Length of the pieces of long items, at least; a cut is moved to a word that starts up to so many places from it.
PIECE, NEAR_WORD = 160, 8
#: Longest to shortest piece of a class; usual q of the q-gram count; characters of items taken at once.
CLASS_RATIO, GRAM, BLOCK_CHARS = 1.12, 8, 4_000_000
#: A passage counts as starting at a word that begins up to so many places after its start.
LATE_WORD = 16
#: q-grams at the start of a piece that show where it starts; windows that are embedded at a time.
SEEDED, EMBEDDED = 64, 1000
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def plain_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isspace():
            table[cp] = 32
        elif c.isupper() and len(c.lower()) == 1:
            table[cp] = ord(c.lower())
    return table


def plain(text: str) -> str:
    """text lower-cased code point by code point, with blanks for white space."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return plain_table()[cps].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def allowed(n: int) -> int:
    return int(n * EDITS + 1e-9)


def pieces(text: str) -> list[tuple[int, int]]:
    """The pieces [a, b) of an item, which make up all of it; cuts are where words start, if one starts near."""
    n = max(1, len(text) // PIECE)
    cuts = [0]
    for k in range(1, n):
        at = len(text) * k // n
        words = [j for j in range(at - NEAR_WORD, at + NEAR_WORD + 1) if text[j - 1] == " " != text[j]]
        cuts.append(min(words, key=lambda j: abs(j - at), default=at))
    return list(zip(cuts, [*cuts[1:], len(text)]))


def gram_slots(cps: np.ndarray, q: int, total: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A slot of the q-gram tables for each q-gram: the high bits of its rolling hash."""
    n = len(cps) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = total[q : q + n] - total[:n]
    h *= down[:n]
    h *= _SPREAD
    h >>= np.uint64(42)
    return h.view(np.int64)


def prefix_sums(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = power_tables(len(cps) + 1)
    total = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * up[: len(cps)], out=total[1:])
    return total, down


@dataclass
class LengthClass:
    """Pieces of similar length with their hash tables."""

    window: int
    gram: int
    least: int  # q-grams of the benchmark that a window must hold
    span: int  # places in which they are counted
    pieces: list[int] = field(default_factory=list)
    flag: tuple[int, int] = (0, 0)  # number of its q-gram table, and its bit there
    bits: np.ndarray = None  # a walk's 64 random bits for each step, one row a walk
    places: np.ndarray = None  # sampled steps, one row a table
    known: np.ndarray = None  # sorted signatures of all tables (the table is part of a signature)
    held: np.ndarray = None  # their pieces
    marks: np.ndarray = None  # whether a signature begins with these bits

    @cached_property
    def moves(self) -> np.ndarray:
        """Whether a walk moves on, by step, and by walk and character (mod 64)."""
        bits = self.bits.T[: int(self.places.max()) + 1, :, None] >> np.arange(64, dtype=np.uint64)
        return (bits & np.uint64(1)).astype(np.uint8).reshape(len(bits), -1)

    def signatures(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Signatures of the windows, one row a table; walks stop at the window's or the text's end."""
        needed, place = np.unique(self.places, return_inverse=True)
        row = {int(step): k for k, step in enumerate(needed)}
        moves = self.moves
        steps = len(moves)
        # Each window's characters, then zeros as far as a walk can get.
        at = starts[:, None] + np.arange(self.window)
        chars = np.zeros((len(starts), max(self.window, steps) + 1), np.uint32)
        chars[:, : self.window] = np.where(at < ends[:, None], cps[np.minimum(at, len(cps) - 1)], 0)
        flat, classes = chars.ravel(), (chars & np.uint32(63)).ravel().astype(np.intp)
        written = np.zeros((len(needed), WALKS, len(starts)), np.uint32)
        at = np.tile(np.arange(len(starts)) * chars.shape[1], (WALKS, 1))
        walk = np.arange(WALKS)[:, None] * 64
        for step in range(steps):
            if step in row:
                written[row[step]] = flat.take(at)
            kind = classes.take(at)
            kind += walk
            at += moves[step].take(kind)
        tables = np.arange(REPEATS)
        sig = np.repeat((tables.astype(np.uint64) + np.uint64(1))[:, None], len(starts), axis=1)
        for k in range(self.places.shape[1]):
            sig *= ODD
            sig += written[place.reshape(self.places.shape)[:, k], tables % WALKS]
        return mix64(sig)

    def high(self, sig: np.ndarray) -> np.ndarray:
        return (sig >> np.uint64(65 - len(self.marks).bit_length())).view(np.int64)

    def hold(self, sig: np.ndarray) -> None:
        """Keep the signatures of the class's pieces, one row a table."""
        sig, pieces = sig.ravel(), np.tile(np.asarray(self.pieces, np.int32), len(sig))
        by = np.argsort(sig, kind="stable")
        self.known, self.held = sig[by], pieces[by]
        self.marks = np.zeros(1 << min(max((16 * len(sig)).bit_length(), 16), 22), bool)
        self.marks[self.high(self.known)] = True

    def meet(self, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, piece) of what agrees in a table, as often as it does.  Few signatures get past the marks."""
        table, window = np.nonzero(self.marks[self.high(sig)])
        sig = sig[table, window]
        left = np.searchsorted(self.known, sig, "left")
        some = np.flatnonzero(self.known[np.minimum(left, len(self.known) - 1)] == sig)
        left, window = left[some], window[some]
        width = np.searchsorted(self.known, sig[some], "right") - left
        nth = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        return np.repeat(window, width), self.held[np.repeat(left, width) + nth]


@dataclass
class ItemIndex:
    texts: list[str]
    pieces: list[tuple[int, int]]  # item, and where the piece starts in it
    classes: list[LengthClass]
    #: (q, table of 2**22 sets of 16 classes by hash, places in pieces that start with it, whether any of 16 such sets is not empty)
    grams: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]
    own: dict[int, tuple[int, np.ndarray]]  # per item: number of its q-gram table, its sorted slots

    @classmethod
    def build(cls, texts: list[str | None], seed: int = 11) -> ItemIndex:
        texts = [plain(t or "") for t in texts]
        draw = np.random.default_rng(seed)
        cut = [(i, a, b) for i, t in enumerate(texts) if t.strip() for a, b in pieces(t)]
        parts = [texts[i][a:b] for i, a, b in cut]
        classes: list[LengthClass] = []
        for n, i in sorted((len(t), i) for i, t in enumerate(parts)):
            k = allowed(n)
            if not classes or n > classes[-1].window * CLASS_RATIO or n + 1 - classes[-1].gram * (k + 1) < max(1, n // 40):
                q = min(GRAM, n, max(1, (n + 1 - max(1, n // 20)) // (k + 1)))  # n + 1 - q * (k + 1) q-grams stay
                classes.append(LengthClass(n, q, 0, n))
            classes[-1].pieces.append(i)
        grams: list[tuple[int, np.ndarray, np.ndarray]] = []
        members: list[int] = []
        own: dict[int, tuple[int, np.ndarray]] = {}
        for c in classes:
            longest = max(len(parts[i]) for i in c.pieces)
            c.least = max(1, min(len(parts[i]) - c.gram + 1 - c.gram * allowed(len(parts[i])) for i in c.pieces))
            c.span = longest + allowed(longest)
            at = next((k for k, (q, _, _) in enumerate(grams) if q == c.gram and members[k] < 16), len(grams))
            if at == len(grams):
                grams.append((c.gram, np.zeros(1 << 22, np.uint16), np.full(1 << 22, 255, np.uint8)))
                members.append(0)
            c.flag = (at, members[at])
            members[at] += 1
            c.bits = draw.integers(0, 1 << 63, (WALKS, 2 * c.window + 1), dtype=np.uint64, endpoint=True) ^ (draw.integers(0, 2, (WALKS, 2 * c.window + 1), dtype=np.uint64) << np.uint64(63))
            reach = max(1, 2 * c.window - 2)
            c.places = np.sort(np.stack([draw.choice(reach, min(SAMPLED, reach), replace=False) for _ in range(REPEATS)]), axis=1)
            cps, starts = code_points([parts[i] for i in c.pieces])
            total, down = prefix_sums(cps)
            slots = gram_slots(cps, c.gram, total, down)
            grams[c.flag[0]][1][slots] |= np.uint16(1 << c.flag[1])
            for i, a, b in zip(c.pieces, starts[:-1], starts[1:]):
                item, _, end = cut[i]
                first = slots[a : min(b - c.gram, a + SEEDED)]
                np.minimum.at(grams[c.flag[0]][2], first, np.arange(len(first), dtype=np.uint8))
                if end - cut[i][1] == len(texts[item]):
                    own[item] = (c.flag[0], np.unique(slots[a : b - c.gram]))
                elif item not in own:
                    whole, _ = code_points([texts[item]])
                    own[item] = (c.flag[0], np.unique(gram_slots(whole[:-1], c.gram, *prefix_sums(whole[:-1]))))
            c.hold(c.signatures(cps, starts[:-1].copy(), starts[1:] - 1))
        return cls(texts, [(i, a) for i, a, _ in cut], classes, [(q, flags, places, flags.reshape(-1, 16).any(1)) for q, flags, places in grams], own)


def best_passage(item: str, text: str) -> tuple[int, int]:
    """(edits, end) of the passage of text nearest to item: bit-parallel, free start and end; the first of equals."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (m, 0)
    for j, ch in enumerate(text):
        eq = masks.get(ch, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


def matches(index: ItemIndex, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of the items found in the texts."""
    raw, starts = code_points(texts)
    cps = plain_table()[raw]
    cps[starts[1:] - 1] = 0  # the end of a text is like no character
    blank = np.concatenate([[True], (cps[:-1] == 32) | (cps[:-1] == 0)])
    solid = (cps != 32) & (cps != 0)
    starting = blank & solid
    words = np.flatnonzero(starting)
    size = np.flatnonzero(solid & np.concatenate([~solid[1:], [True]])) + 1 - words
    for a, n in zip(words[size > LATE_WORD].tolist(), size[size > LATE_WORD].tolist()):
        starting[a : a + n] = True
    words = np.flatnonzero(starting)
    if not len(words):
        return []
    total, down = prefix_sums(cps)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    slots = [gram_slots(cps, q, total, down) for q, *_ in index.grams]
    for (_, flags, places, coarse), slot in zip(index.grams, slots):
        at = np.flatnonzero(coarse.take(slot >> 4))  # a table that stays in the cache leaves few for the large one
        mask = flags.take(slot[at])
        at, mask = at[mask > 0], mask[mask > 0]
        hits.append((at, mask, places[slot[at]]))
    met: list[np.ndarray] = []  # window start * number of pieces + piece, each once
    n_pieces = max(1, len(index.pieces))
    for c in index.classes:
        at, mask, place = hits[c.flag[0]]
        own = (mask >> np.uint16(c.flag[1])) & np.uint16(1) == 1
        at, place = at[own], place[own]
        # Runs of enough hits close together; only words near them can start a window with enough hits.
        dense = np.flatnonzero(at[c.least - 1 :] - at[: max(0, len(at) - c.least + 1)] < c.span + LATE_WORD)
        if not len(dense):
            continue
        near = np.zeros(len(words) + 1, np.int32)
        np.add.at(near, np.searchsorted(words, at[dense + c.least - 1] - c.span, "left"), 1)
        np.add.at(near, np.searchsorted(words, at[dense] + LATE_WORD, "right"), -1)
        seeds = at[place < 255] - place[place < 255]
        could = np.union1d(words[np.flatnonzero(np.cumsum(near[:-1]) > 0)], seeds[seeds >= 0])
        owner = np.searchsorted(starts, could, side="right") - 1
        lo = np.maximum(could - LATE_WORD, starts[owner])
        hi = np.minimum(could + c.span, starts[owner + 1] - 1)
        could = could[np.searchsorted(at, hi, "left") - np.searchsorted(at, lo, "left") >= c.least]
        for a in range(0, len(could), EMBEDDED):
            some = could[a : a + EMBEDDED]
            which, piece = c.meet(c.signatures(cps, some, starts[np.searchsorted(starts, some, side="right")] - 1))
            if len(which):
                met.append(np.unique(some[which] * n_pieces + piece))
    if not met:
        return []
    window, piece = np.divmod(np.unique(np.concatenate(met)), n_pieces)
    owner = np.searchsorted(starts, window, side="right") - 1
    item_of, offset = (np.array(x, np.int64) for x in zip(*index.pieces))
    pairs = np.unique(np.stack([owner, item_of[piece], window - offset[piece]], axis=1), axis=0)
    # What meets one item at starts within its length of each other is verified together.
    regions: list[list[int]] = []
    for doc, item, at in pairs.tolist():
        if regions and regions[-1][:2] == [doc, item] and at - regions[-1][3] <= len(index.texts[item]):
            regions[-1][3] = at
        else:
            regions.append([doc, item, at, at])
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for doc, item, first, last in regions:
        want = index.texts[item]
        k = allowed(len(want))
        lo = max(int(starts[doc]), first - 2 * k - LATE_WORD)
        hi = max(lo, min(int(starts[doc + 1]) - 1, last + len(want) + 2 * k + 1))
        which, known = index.own[item]
        q = index.grams[which][0]
        here = slots[which][lo : max(lo, hi - q + 1)]
        if (known[np.minimum(np.searchsorted(known, here), len(known) - 1)] == here).sum() < len(want) - q + 1 - q * k:
            continue  # too few of the item's own q-grams
        near = cps[lo:hi].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        at = near.find(want)
        edits, end = (0, at + len(want)) if at >= 0 else best_passage(want, near)
        if edits <= k:
            back = len(want) if at >= 0 else best_passage(want[::-1], near[:end][::-1])[1]
            new = (edits, lo + end - back - int(starts[doc]), lo + end - int(starts[doc]))
            if (doc, item) not in found or new < found[doc, item]:
                found[doc, item] = new
    return [(doc, item, *m) for (doc, item), m in sorted(found.items())]


def item_blocks(items: DataFrame, item_key: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of at most BLOCK_CHARS characters (a longer one alone), streamed, never all at once."""
    block, size = [], 0
    for r in items.select(F.col(quoted(item_key)).alias("k"), F.col(quoted(text)).alias("t")).filter(F.length("t") > 0).toLocalIterator():
        if block and size + len(r["t"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["k"], r["t"]))
        size += len(r["t"])
    if block:
        yield block


def find_items(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item_key, edits, start, end: one row for each document and item found in it (code points, end exclusive)."""
    rows = df.select(F.col(quoted(key)).alias(key), F.col(quoted(text)).alias("text" if key != "text" else "_text"))
    schema = StructType([rows.schema[0], StructField(item_key, items.schema[item_key].dataType), StructField("edits", IntegerType()), StructField("start", LongType()), StructField("end", LongType())])
    item_sort = to_arrow_type(items.schema[item_key].dataType)
    out = None
    for block in item_blocks(items, item_key, item_text):
        shared = df.sparkSession.sparkContext.broadcast((ItemIndex.build([t for _, t in block]), [k for k, _ in block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, names = shared.value
            for batch in batches:
                for a, _, texts in text_chunks(batch, 1):
                    found = matches(index, texts)
                    if found:
                        doc, item, edits, start, end = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([a + d for d in doc])), pa.array([names[i] for i in item], item_sort), pa.array(edits, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                            names=schema.names,
                        )
            trim()

        part = numbered(rows).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def clean(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the documents in which an item is found; rows with a null key are judged like others."""
    (marker,) = own_names(df.columns, "row")
    marked = df.withColumn(marker, F.xxhash64(F.coalesce(F.col(quoted(key)).cast("string"), F.lit("null")), F.coalesce(F.col(quoted(text)), F.lit(""))))
    bad = find_items(marked, items, marker, text).select(marker)
    return without(marked, bad, marker).select(*map(quoted, df.columns))
