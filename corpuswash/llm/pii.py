"""Personal data in texts: fixed base patterns plus a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) find well-formed data, leftmost and without retries.  What they leave,
for instance a card right behind a phone number whose joint match failed its digit count, or an address spelled
``name [at] host [dot] org``, by half (``name [at] host.org``) or with blanks, is decided by a semi-Markov conditional random
field: candidate segments are runs of whole digit groups (at most MOST_GROUPS of them) and unusual addresses, with all
ends that their dots allow; features look at a whole segment (check digits, digit counts, grouping, signs, neighbours) and
at two segments next to each other (their kinds, and whether GAP characters or less part them); dynamic programming over
the segments of a region chooses the non-overlapping set, boundaries and kinds together, of the highest score, where text
outside any segment scores 0.  Base spans always stay; added spans never overlap them.

Weights are fitted to a bounded sample of the corpus: the base spans are the true segments of their regions, and
variants of them (other separators, two of them side by side, spelled-out addresses) are added, and digit groups that are
none of the kinds.

Defined results: null text is empty and has no spans; positions are code points, ends exclusive; spans are ordered
by start, then kind as listed; of sets of segments with equal scores the one that was found first stays; very long texts are
read whole, one at a time; repeated rows stay; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import numbered, quoted, sampled_texts, text_chunks, trim

KINDS = ("email", "ip", "card", "phone")
#: Texts that the weights are fitted to and their bytes, about.
SAMPLE, SAMPLE_BYTES = 2000, 8 << 20
MOST_GROUPS = 8
#: Characters between two segments that are still next to each other.
GAP = 2

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_REGION = re.compile(r"\+?\(?[0-9](?:[ ().+-]{0,3}[0-9])*")
_GROUP = re.compile(r"[0-9]++")
#: What every spelled-out address holds.
_AT = re.compile(r"@|[\[({] ?at ?[\])}]| at ", re.I)
_DOT = r"(?: ?\. ?| ?[\[({] ?dot ?[\])}] ?| dot )"
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}( ?@ ?| ?[\[({] ?at ?[\])}] ?| at )[A-Za-z0-9-]{1,63}((?:" + _DOT + r"[A-Za-z0-9-]{1,63}){1,6})", re.I)
_LABEL = re.compile(_DOT + r"[A-Za-z0-9-]{1,63}", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base patterns, ordered."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at) if s < at else None
        if m:
            out.append((s, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if re.search(r"[0-9]", text):
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
                    out.append((m.start(), m.end(), "ip"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _edges(text: str, s: int, e: int) -> list[float]:
    before, after = text[s - 1 : s], text[e : e + 1]
    return [float(before.isalnum() or before in ("_", "=", "\"", "#")), float(after.isalnum() or after in ("_", "\""))]


def _follows(text: str, s: int, e: int) -> float:
    """A digit group goes on outside the segment within one sign of it."""
    return float(bool(re.search(r"[0-9][.-]$", text[max(0, s - 2) : s])) or bool(re.match(r"[.-][0-9]", text[e : e + 2])))


FEATURES = {"email": 12, "ip": 5, "card": 8, "phone": 12}
OFFSET = dict(zip(FEATURES, np.cumsum([0, *FEATURES.values()]).tolist()))
#: Behind the segments' own features: one for each two kinds next to each other.
N_OWN = sum(FEATURES.values())
N_FEATURES = N_OWN + len(KINDS) ** 2


def features(text: str, s: int, e: int, kind: str) -> np.ndarray:
    """Whole-span features of one candidate segment, in the block of its kind."""
    own = text[s:e]
    left, right = _edges(text, s, e)
    if kind == "email":
        tail = re.split(r"\.|dot", own, flags=re.I)[-1].strip(" [](){}")
        spelled_at, spelled_dot = bool(re.search(r"[\[({ ]at[\])} ]", own, re.I)), bool(re.search(r"[\[({ ]dot[\])} ]", own, re.I))
        name, *at = re.split(r"( ?@| at | ?[\[({])", own, maxsplit=1, flags=re.I)
        word = not (re.search(r"[A-Za-z]", name) and re.search(r"[0-9._%+-]", name))  # as in "look at this.That"
        prose = word and at[0].lower() == " at "
        values = [1, tail.isalpha() and 2 <= len(tail) <= 6, "@" in own, spelled_at and spelled_dot, bool(re.search(r"[\[({]", own)), left or right, prose and not spelled_dot, bool(_LABEL.match(text, e)), " @ " in own and not word, bool(re.search(r"\. ", own)), prose and spelled_dot, " @ " in own and word]
    else:
        groups = _GROUP.findall(own)
        n = sum(map(len, groups))
        if kind == "ip":
            values = [1, all(len(g) <= 3 and int(g) <= 255 for g in groups), any(len(g) > 1 and g[0] == "0" for g in groups), left or right, _follows(text, s, e)]
        elif kind == "card":
            even = len(groups) == 1 or all(len(g) == 4 for g in groups[:-1]) or [len(g) for g in groups] == [4, 6, 5]
            values = [1, luhn("".join(groups)), n == 16, n in (13, 14, 15, 19), own[0] in "3456", even, left or right, _follows(text, s, e)]
        else:
            values = [1, own[0] == "+", "(" in own, n in (10, 11), len(groups) in (3, 4), len(groups[-1]) == 4, len(groups) == 1, left or right, _follows(text, s, e), n > 12, n == 9, [len(g) for g in groups] == [3, 2, 4]]
    out = np.zeros(N_FEATURES)
    out[OFFSET[kind] : OFFSET[kind] + len(values)] = values
    return out


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[list[tuple[int, int, str]]]:
    """Candidate segments outside the taken spans, as lists for each region of text."""
    out = []
    busy = sorted(taken)

    def free(s: int, e: int) -> bool:
        return not any(a < e and s < b for a, b, _ in busy)

    if re.search(r"[0-9]", text):
        for m in _REGION.finditer(text):
            if m.end() - m.start() < 7:
                continue
            near = [x for x in busy if x[0] < m.end() and m.start() < x[1]] if busy else []
            if any(a <= m.start() and m.end() <= b for a, b, _ in near):
                continue
            groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, m.start(), m.end())]
            found = []
            for i, (s, _) in enumerate(groups):
                n = 0
                lead = s - 1 if s > m.start() and text[s - 1] in "+(" else s
                lead = lead - 1 if lead > m.start() and lead < s and text[lead - 1] == "+" else lead
                for j in range(i, min(len(groups), i + MOST_GROUPS)):
                    e = groups[j][1]
                    n += e - groups[j][0]
                    if n > 19:
                        break
                    inner = text[s:e]
                    if j == i + 3 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", inner):
                        found.append((s, e, "ip"))
                    if 12 <= n and re.fullmatch(r"[0-9]([ -]?[0-9])*", inner):
                        found.append((s, e, "card"))
                    if 9 <= n <= 15 and "+" not in inner:
                        found.append((lead, e, "phone"))
            found = [c for c in found if not any(a < c[1] and c[0] < b for a, b, _ in near)]
            if found:
                out.append(found)
    if _AT.search(text):
        m, end = _SPELLED.search(text), 0
        while m:
            ends = [x.end() for x in _LABEL.finditer(text, m.start(2), m.end(2))]  # after each dot's label
            found = [(m.start(), e, "email") for e in ends if free(m.start(), e)]
            if found:
                if m.start() >= end:
                    out.append([])
                out[-1] += found
                end = max(end, found[-1][1])
            m = _SPELLED.search(text, m.end(1))  # what follows "at" may be the name of the next: "look at ann.lee [at] ..."
    return out


def _lattice(segments: list[tuple[int, int, str]]) -> tuple[list[int], list[int], list[list[int]]]:
    """Segments by end; for each, how many end more than GAP before it starts, and which end within GAP of its start."""
    order = sorted(range(len(segments)), key=lambda k: (segments[k][1], segments[k][0]))
    ends = np.array([segments[k][1] for k in order])
    starts = np.array([segments[k][0] for k in order])
    far, near = np.searchsorted(ends, starts - GAP, side="left"), np.searchsorted(ends, starts, side="right")
    return order, far.tolist(), [list(range(a, b)) for a, b in zip(far.tolist(), near.tolist())]


def decode(segments: list[tuple[int, int, str]], scores: np.ndarray, pairs: np.ndarray | None = None) -> list[int]:
    """Indices of the non-overlapping segments with the highest sum of scores and of pairs (kind by kind) next to each other."""
    pairs = np.zeros((len(KINDS), len(KINDS))) if pairs is None else pairs
    order, far, near = _lattice(segments)
    kind = [KINDS.index(segments[k][2]) for k in order]
    best, last, value, before = [0.0], [-1], [], []  # best[n]: of the first n; last[n]: its last segment
    for n, k in enumerate(order):
        base, prior = best[far[n]], last[far[n]]
        for j in near[n]:
            with_j = value[j] + pairs[kind[j], kind[n]]
            if with_j > base:
                base, prior = with_j, j
        value.append(base + float(scores[k]))
        before.append(prior)
        better = value[n] > best[n]
        best.append(value[n] if better else best[n])
        last.append(n if better else last[n])
    picked, n = [], last[-1]
    while n >= 0:
        picked.append(order[n])
        n = before[n]
    return sorted(picked)


def expectations(segments: list[tuple[int, int, str]], scores: np.ndarray, pairs: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partition sum over all non-overlapping sets of segments; each segment's marginal probability; the expected
    number of neighbours, kind by kind."""
    pairs = np.zeros((len(KINDS), len(KINDS))) if pairs is None else pairs
    order, far, near = _lattice(segments)
    kind = [KINDS.index(segments[k][2]) for k in order]
    ahead, value, inner = [0.0], [], []
    for n, k in enumerate(order):
        ways = [ahead[far[n]], *(value[j] + pairs[kind[j], kind[n]] for j in near[n])]
        inner.append(float(np.logaddexp.reduce(ways)))
        value.append(inner[n] + float(scores[k]))
        ahead.append(float(np.logaddexp(ahead[n], value[n])))
    # The gradient of the log partition sum, carried backwards through the recursion.
    flow, own, both = np.zeros(len(order) + 1), np.zeros(len(order)), np.zeros_like(pairs)
    flow[-1] = 1.0
    for n in range(len(order) - 1, -1, -1):
        share = np.exp(value[n] - ahead[n + 1])
        own[n] += flow[n + 1] * share
        flow[n] += flow[n + 1] * (1 - share)
        flow[far[n]] += own[n] * np.exp(ahead[far[n]] - inner[n])
        for j in near[n]:
            part = own[n] * np.exp(value[j] + pairs[kind[j], kind[n]] - inner[n])
            own[j] += part
            both[kind[j], kind[n]] += part
    marginal = np.zeros(len(segments))
    marginal[order] = own
    return ahead[-1], marginal, both


def neighbours(segments: list[tuple[int, int, str]]) -> np.ndarray:
    """Kind by kind, how many of the (non-overlapping) segments stand next to each other."""
    out = np.zeros((len(KINDS), len(KINDS)))
    for x, y in zip(sorted(segments), sorted(segments)[1:]):
        out[KINDS.index(x[2]), KINDS.index(y[2])] += y[0] - x[1] <= GAP
    return out


def examples(texts: list[str], seed: int = 3, count: int = 700) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Short texts with true segments, made of the sample's base spans and variants of them."""
    draw = random.Random(seed)
    spans: dict[str, list[str]] = {k: [] for k in KINDS}
    context = []
    for t in texts:
        for s, e, kind in base_spans(t)[:20]:
            spans[kind].append(t[s:e])
            context.append((t[max(0, s - 12) : s].rpartition(" ")[0] + " ", " " + t[e : e + 12].partition(" ")[2]))
    if not spans["phone"]:
        spans["phone"] = ["+1 (212) 555-0199", "+44 20 7946 0958"]
    if not spans["card"]:
        spans["card"] = ["4111111111111111", "5500 0000 0000 0004"]
    if not spans["ip"]:
        spans["ip"] = ["192.0.2.17", "203.0.113.5"]
    if not spans["email"]:
        spans["email"] = ["ann.lee@example.com", "bo@mail.example.org"]
    context = context or [("call ", " now")]
    some = lambda kind: draw.choice(spans[kind][:3000])

    def phone() -> str:
        d = _digits(some("phone"))[-10:]
        return draw.choice([some("phone"), f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}"])

    def card() -> str:
        d = _digits(some("card"))
        sign = draw.choice([" ", "-", ""])
        return sign.join(d[i : i + 4] for i in range(0, len(d), 4))

    def email() -> str:
        local, _, host = some("email").partition("@")
        at, dot = draw.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" at ", " dot "), (" @ ", " . "), (" @ ", "."), (" [at] ", "."), ("(at)", "."), ("@", " [dot] "), ("@", "(dot)"), (" at ", ".")])
        if (at, dot) == (" at ", ".") and not re.search(r"[0-9._%+-]", local):
            at = " (at) "
        host = draw.choice([host, host, host.rpartition(".")[0] + draw.choice([".co.uk", ".org", ".edu.au"])])
        return local + at + host.replace(".", dot)

    def other() -> str:
        n = draw.randint(7, 19)
        d = "".join(draw.choice("0123456789") for _ in range(n))
        if n >= 12 and luhn(d):
            d = d[:-1] + str((int(d[-1]) + 1) % 10)
        date = f"{draw.randint(1900, 2099)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}"
        version = f"{draw.randint(1, 30)}.{draw.randint(256, 9999)}.{draw.randint(0, 999)}.{draw.randint(256, 99999)}"
        glued = f"{draw.choice('abcdef')}{d}{draw.choice('abcdef')}"
        listed = " ".join(str(draw.randint(10, 99999)) for _ in range(draw.randint(3, 7)))
        social = f"{draw.randint(100, 899)}-{draw.randint(10, 99)}-{draw.randint(1000, 9999)}"
        return draw.choice([social, d, date, f"{date} {draw.randint(10, 23)}.{draw.randint(10, 59)}", version, glued, listed, "look at the dot on it", "look at this.That", "see it at example.com", "met @ noon . Then", "he is at home dot"])

    make = {"phone": phone, "card": card, "email": email, "ip": lambda: some("ip")}
    out = []
    for _ in range(count):
        before, after = draw.choice(context)
        text, truth = before, []
        for k in draw.choices(["phone", "card", "ip", "email", "none"], weights=[4, 4, 2, 2, 5], k=draw.randint(1, 3)):
            own = other() if k == "none" else make[k]()
            if k != "none":
                truth.append((len(text), len(text) + len(own), k))
            text += own + draw.choice([" ", " ", ", ", "\n"])
        out.append((text + after, truth))
    return out


def fit(texts: list[str], steps: int = 60, rate: float = 0.7, decay: float = 1e-3) -> np.ndarray:
    """Weights that make the true segments likely: gradient ascent on the conditional log likelihood."""
    lattices = []
    for text, truth in examples(texts):
        for segments in candidates(text, []):
            true = [c for c in segments if c in truth]
            lattices.append((segments, np.stack([features(text, *c) for c in segments]), np.array([float(c in truth) for c in segments]), neighbours(true).ravel()))
    weights, speed = np.zeros(N_FEATURES), np.zeros(N_FEATURES) + 1e-8
    for _ in range(steps):
        gradient = -decay * len(lattices) * weights
        for segments, x, true, beside in lattices:
            _, marginal, both = expectations(segments, x @ weights, weights[N_OWN:].reshape(len(KINDS), -1))
            gradient += x.T @ (true - marginal)
            gradient[N_OWN:] += beside - both.ravel()
        speed += gradient**2
        weights += rate * gradient / np.sqrt(speed)
    return weights


def find(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and the spans that the model adds."""
    base = base_spans(text)
    added = []
    for segments in candidates(text, base):
        scores = np.array([features(text, *c) @ weights for c in segments])
        added += [segments[k] for k in decode(segments, scores, weights[N_OWN:].reshape(len(KINDS), -1))]
    clear: list[tuple[int, int, str]] = []
    for a in sorted(added):  # a spelled-out address may lie across a region of digits: the earlier one stays
        if not clear or a[0] >= clear[-1][1]:
            clear.append(a)
    return base, clear


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted to about `sample` texts (SAMPLE_BYTES of them), chosen by hash of the key."""
    rows = df.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).alias("t"), F.lit(0).alias("y"))
    n, grain = df.count(), 1 << 30
    keep = F.pmod(F.xxhash64(F.lit("pii"), F.col("k").cast("string")), F.lit(grain)) < int(grain * min(1.0, sample / max(n, 1)))
    return fit([t for _, _, t in sampled_texts(rows.filter(keep & F.col("t").rlike("[0-9@]")), SAMPLE_BYTES)])


def find_all(df: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans (array of kind, start, end, base), one row per text."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    rows = df.select(F.col(quoted(key)).alias(key), F.col(quoted(text)).alias("text" if key != "text" else "_text"))
    span_type = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("base", BooleanType())])
    schema = StructType([rows.schema[0], StructField("spans", ArrayType(span_type))])
    span = to_arrow_type(span_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for a, b, texts in text_chunks(batch, 1):
                out = []
                for t in texts:
                    base, added = find(t or "", w)
                    both = [(s, e, k, True) for s, e, k in base] + [(s, e, k, False) for s, e, k in added]
                    both.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
                    out.append([{"kind": k, "start": s, "end": e, "base": y} for s, e, k, y in both])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.list_(span))], names=schema.names)
        trim()

    return numbered(rows).mapInArrow(run, schema)


def digest(base: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(joined(base).encode()).hexdigest()
