"""Language id, fingerprints, personal data, decontamination, toxicity: numpy parts against brute force."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from corpuswash.llm import decontaminate, fingerprint, lang_id, pii, toxicity

ENGLISH = ["the cat sat on the mat and was there with that thing", "this is not the end of the story that was told"]
GERMAN = ["der hund und die katze sind nicht auf dem tisch gewesen", "das ist nicht das ende der geschichte und auch nicht schön"]
RUSSIAN = ["это не конец истории и не начало", "кошка сидит на столе"]


@pytest.fixture(scope="module")
def model():
    texts = (ENGLISH + GERMAN + RUSSIAN) * 5
    return lang_id.LanguageModel.fit(texts, (["en"] * 2 + ["de"] * 2 + ["ru"] * 2) * 5)


def brute_viterbi(scores, penalty):
    best = max(itertools.product(range(scores.shape[1]), repeat=len(scores)), key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])))
    return sum(scores[i, k] for i, k in enumerate(best)) - penalty * sum(a != b for a, b in zip(best, best[1:]))


def test_viterbi_is_optimal():
    draw = np.random.default_rng(1)
    lengths = [1, 5, 7, 3, 6]
    scores = draw.normal(0, 3, (sum(lengths), 3)).astype(np.float32)
    text = np.repeat(np.arange(5), lengths)
    tags = lang_id.viterbi(scores, text, 6, 2.0)
    for k in range(5):
        own, path = scores[text == k], tags[text == k]
        value = sum(own[i, t] for i, t in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        assert value == pytest.approx(brute_viterbi(own, 2.0), abs=1e-3)


def test_languages_and_spans(model):
    mixed = "the cat was there and that is not the end. кошка сидит на столе"
    texts = ["the story of the cat", "die katze und der hund", mixed, "", None, "123 !?", "ΑΒΓ", "x" * 50_000, "story İstanbul the the the"]
    langs, score, n, (start, end, tag) = lang_id.label(model, texts)
    assert langs[:2] == ["en", "de"] and langs[2] == "en" and langs[3:6] == ["und"] * 3
    assert list(score[3:6]) == [0, 0, 0] and (score >= 0).all() and (score <= 1).all()
    at = int(n[:2].sum())
    assert [(mixed[a:b], model.languages[t]) for a, b, t in zip(start[at : at + 2], end[at : at + 2], tag[at : at + 2])] == [("the cat was there and that is not the end", "en"), ("кошка сидит на столе", "ru")]
    assert lang_id.label(lang_id.LanguageModel.fit([], []), ["abc"])[0] == ["und"]


def test_fingerprints():
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9)))
    long = [" ".join(word() for _ in range(n)) for n in (300, 3000, 40)]
    texts = [*long, long[0], "", "", "short", "abc abc abc abc", "Dem " * 400, "é€𐍈" * 30]
    found = fingerprint.digests(texts)
    names = fingerprint.as_text(found)
    assert names[0] == names[3] and names[4] == "" and len(set(names)) == len(set(texts))
    changed = fingerprint.digests([fingerprint.edited(t, long[1][::-1]) for t in texts])
    near = fingerprint.likeness(found, changed)
    assert (near[:4] > 0.5).all() and near[4] == 1
    assert (fingerprint.likeness(found, found) == 1).all()
    shifted = fingerprint.digests(["zz" + t for t in long])
    assert (fingerprint.likeness((found[0][: found[1][3]], found[1][:4]), shifted) > 0.8).all()
    other = fingerprint.likeness(fingerprint.digests([long[0], "", "x"]), fingerprint.digests([long[1], "x", ""]))
    assert other[0] < 0.2 and list(other[1:]) == [0, 0]
    assert fingerprint.edited("abcdefgh", "XY") == "abcdefXY" and fingerprint.edited("abcdefgh", "X") == "abcdefX" and fingerprint.edited("abc", "X") == "abc"


def test_fingerprints_look_at_every_window():
    """Features are the rarest of the windows that start at every byte, by a plain count for each of them."""
    import numpy as np

    draw = random.Random(4)
    texts = ["".join(draw.choice("abcdefgh ,.ABC0123é") for _ in range(n)).encode() for n in (31, 32, 400, 33, 0, 700)]
    texts.append(b"one two " * 30)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    hashes, owner = fingerprint.features(np.frombuffer(b"".join(texts), np.uint8), starts)
    for k, text in enumerate(texts):
        keys, names = [], []
        for i in range(len(text) - fingerprint.WINDOW + 1):
            own = text[i : i + fingerprint.WINDOW]
            classes = [(b ^ b >> 4) & (fingerprint.CLASSES - 1) for b in own]
            entropy = np.float32(0)
            for c in range(fingerprint.CLASSES):
                entropy += fingerprint._PLOGP[classes.count(c)]
            name = sum(int(fingerprint._CODES[b]) * pow(int(fingerprint.ODD), j, 1 << 64) for j, b in enumerate(own)) % (1 << 64)
            names.append(int(fingerprint.mix64(np.array([name], np.uint64))[0]))
            keys.append((int(np.abs(entropy - np.float32(fingerprint.USUAL)) * np.float32(1000)), names[-1] >> 24) if entropy >= fingerprint.LEAST else (-1, 0))
        near = fingerprint.NEAR
        want = [names[i] for i, key in enumerate(keys) if key[0] >= 0 and key == max(keys[max(0, i - near) : i + near + 1])]
        if want:
            assert hashes[owner == k].tolist() == want


def test_a_text_has_the_same_digest_alone_and_among_others():
    texts = ["one two three four five six seven eight nine ten eleven " * k for k in range(1, 6)]
    together = fingerprint.as_text(fingerprint.digests(texts))
    assert together == [fingerprint.as_text(fingerprint.digests([t]))[0] for t in texts]


def plain_pii(text):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for kind, pattern in kinds:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(g) <= 255 for g in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))


def test_base_spans_match_the_patterns():
    draw = random.Random(5)
    for _ in range(8000):
        text = "".join(draw.choice("0123456789 .-+()@ab_%\n١é") for _ in range(draw.randint(0, 40)))
        assert pii.base_spans(text) == plain_pii(text)
    for text in ("4111111111111111", "4111 1111 1111 1111x", "a.b@c-d.e.f, g@h", "256.1.1.1 1.2.3.4", "00000000000000000001.1.1.1", "+1 (555) 010-9999."):
        assert pii.base_spans(text) == plain_pii(text)


def test_segment_dynamics_against_brute_force():
    draw = random.Random(3)
    for turn in range(120):
        segments = sorted({(a, a + draw.randint(1, 5), draw.choice(pii.KINDS)) for a in (draw.randint(0, 14) for _ in range(7))})
        scores = np.array([draw.uniform(-2, 2) for _ in segments])
        pairs = np.array([[draw.uniform(-2, 2) for _ in pii.KINDS] for _ in pii.KINDS]) * (turn % 2)
        sets = [c for r in range(len(segments) + 1) for c in itertools.combinations(range(len(segments)), r) if all(segments[i][1] <= segments[j][0] or segments[j][1] <= segments[i][0] for i, j in itertools.combinations(c, 2))]
        beside = [pii.neighbours([segments[i] for i in c]) for c in sets]
        weight = np.array([scores[list(c)].sum() + (n * pairs).sum() for c, n in zip(sets, beside)])
        log_z, marginal, both = pii.expectations(segments, scores, pairs)
        assert log_z == pytest.approx(np.logaddexp.reduce(weight))
        p = np.exp(weight - log_z)
        assert marginal == pytest.approx([sum(q for q, c in zip(p, sets) if k in c) for k in range(len(segments))])
        assert both == pytest.approx(sum(q * n for q, n in zip(p, beside)))
        assert weight[sets.index(tuple(pii.decode(segments, scores, pairs)))] == pytest.approx(weight.max())


def test_added_spans_held_out():
    """Precision and recall of added spans, kind by kind, on variants that the weights were not fitted to."""
    texts = ["call +1 (258) 555-7056 or mail ann.lee@example.com", "card 4083486860054702 at 10.1.2.3", "bo_x@mail.example.org or +44 20 7946 0958", "5500 0000 0000 0004 from 172.16.0.9"]
    weights = pii.fit(texts)
    hit, said, true = ({k: 0 for k in pii.KINDS} for _ in range(3))
    for text, truth in pii.examples(texts, seed=77, count=400):
        base, added = pii.find(text, weights)
        free = [t for t in truth if not any(t[0] < e and s < t[1] for s, e, _ in base)]
        for s in added:
            said[s[2]] += 1
            hit[s[2]] += s in truth
        for t in free:
            true[t[2]] += 1
    for kind in ("email", "card", "phone"):
        assert hit[kind] >= 0.9 * said[kind] and hit[kind] >= 0.85 * true[kind], (kind, hit, said, true)


def test_added_spans():
    weights = pii.fit(["call +1 (258) 555-7056 or mail ann.lee@example.com", "card 4083486860054702 at 10.1.2.3"])
    found = lambda t: [(t[s:e], k) for s, e, k in pii.find(t, weights)[1]]
    assert found("call +1 (258) 555-7056 4083486860054702 now") == [("+1 (258) 555-7056", "phone"), ("4083486860054702", "card")]
    assert found("write joe.doe [at] example [dot] com please") == [("joe.doe [at] example [dot] com", "email")]
    for own in ("joe.doe at example dot co dot uk", "joe.doe @ example . com", "joe [at] mail [dot] example [dot] org"):
        assert found(f"write {own}, please") == [(own, "email")], own
    for clean in ("number 123-45-6789 is none", "on 2020-01-02 we met", "item 1234567 of 9876543", "look at the dot on it", "", "a52506ed8c5833c9ce3be815983848c6"):
        assert found(clean) == []
    assert pii.joined([(9, 12, "phone"), (2, 5, "card"), (2, 4, "email")]) == "email:2:4,card:2:5,phone:9:12"


def test_half_spelled_addresses():
    weights = pii.fit(["call +1 (258) 555-7056 or mail ann.lee@example.com", "card 4083486860054702 at 10.1.2.3"])
    found = lambda t: [(t[s:e], k) for s, e, k in pii.find(t, weights)[1]]
    for own in ("joe.doe [at] example.com", "joe(at)example.org", "JOE (AT) EXAMPLE.ORG", "joe@example [dot] com", "joe.doe at mail.example.com", "joe [at] example [dot] com"):
        for text in ("write {} please", "{}", "an anecdote: {}", "look at {} now"):
            assert found(text.format(own)) == [(own, "email")], text.format(own)
    for clean in ("look at this.That is all", "we met at noon.Then we left", "see it at example.com today", "an anecdote at home.Then"):
        assert found(clean) == [], clean


def edit_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for ch in text:
        new = [0]
        for i, c in enumerate(item):
            new.append(min(row[i] + (c != ch), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_best_passage_against_brute_force():
    draw = random.Random(4)
    for _ in range(200):
        item = "".join(draw.choice("abc") for _ in range(draw.randint(1, 12)))
        text = "".join(draw.choice("abcd") for _ in range(draw.randint(0, 20)))
        assert decontaminate.best_passage(item, text)[0] == edit_distance(item, text)


def mutate(draw, text, k):
    s = list(text)
    for _ in range(k):
        j, kind = draw.randrange(len(s)), draw.random()
        if kind < 0.34:
            s[j] = draw.choice("abcdefgh ")
        elif kind < 0.67:
            del s[j]
        else:
            s.insert(j, draw.choice("abcdefgh "))
    return "".join(s)


def test_decontamination_recall_and_precision():
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstu") for _ in range(draw.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(draw.randint(15, 60)) for _ in range(60)]
    index = decontaminate.ItemIndex.build(items)
    docs = [f"{text(50)}\n{mutate(draw, i, int(len(i) * 0.08)).upper()} {text(50)}" for i in items]
    clean = [text(150) for _ in range(60)]
    found = decontaminate.matches(index, docs + clean + ["", None])
    assert sum((k, k) in {(d, i) for d, i, *_ in found} for k in range(60)) >= 57
    assert all(d == i for d, i, *_ in found)
    for d, i, edits, start, end in found:
        assert edit_distance(decontaminate.plain(items[i]), decontaminate.plain(docs[d][start:end])) == edits
    assert decontaminate.matches(decontaminate.ItemIndex.build(["", None, "tiny"]), ["a tiny text", "x"]) == [(0, 2, 0, 2, 6)]
    assert decontaminate.matches(index, []) == []


@pytest.mark.parametrize("n, count", [(1000, 40), (3000, 25)])
def test_decontamination_of_long_items(n, count):
    draw = random.Random(n)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstu") for _ in range(draw.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(n)[:n].strip() for _ in range(count)]
    for item in items:
        cuts = decontaminate.pieces(item)
        assert "".join(item[a:b] for a, b in cuts) == item and min(b - a for a, b in cuts) >= decontaminate.PIECE - 2 * decontaminate.NEAR_WORD
    index = decontaminate.ItemIndex.build(items)
    for share in (0.08, 0.1):
        docs = [f"{text(50)} {mutate(draw, i, int(len(i) * share))} {text(50)}" for i in items]
        found = decontaminate.matches(index, docs)
        assert len(found) >= 0.95 * count and all(d == i and edits <= n * share for d, i, edits, *_ in found)


def test_decontamination_tables_are_searched_together():
    """All hash tables of a class are one sorted list: a window meets a piece as often as they agree in a table."""
    import numpy as np

    draw = random.Random(12)
    items = ["".join(draw.choice("abcdefgh ") for _ in range(90)) for _ in range(30)]
    index = decontaminate.ItemIndex.build([*items, items[3]])
    (c,) = index.classes
    texts = [draw.choice(items)[:80] + "".join(draw.choice("abcd") for _ in range(10)) for _ in range(40)]
    cps, starts = decontaminate.code_points(texts)
    sig = c.signatures(cps, starts[:-1], starts[1:] - 1)
    cps, starts = decontaminate.code_points([index.texts[i] for i, _ in (index.pieces[p] for p in c.pieces)])
    own = c.signatures(cps, starts[:-1], starts[1:] - 1)
    assert len(sig) == decontaminate.REPEATS
    want = sorted((w, p) for r in range(len(sig)) for w in range(40) for k, p in enumerate(c.pieces) if sig[r, w] == own[r, k])
    assert want and sorted(zip(*(x.tolist() for x in c.meet(sig)))) == want
    assert not len(c.meet(sig[:, :0])[0]) and not len(c.meet(np.zeros_like(sig))[0])


def test_decontamination_of_mixed_lengths():
    """Items of all lengths in one index, up to the full allowance; glued to other words too."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 9)))
    text = lambda n: (" ".join(word() for _ in range(n))[:n].strip() + "abc")[:n]
    lengths = [15, 20, 27, 30, 33, 40, 52, 64, 80, 100, 120, 160, 200, 300, 400]
    items = [text(n) for n in lengths * 6]
    index = decontaminate.ItemIndex.build(items)
    for c in index.classes:
        for i in c.pieces:
            item, start = index.pieces[i]
            n = next(b - a for a, b in decontaminate.pieces(index.texts[item]) if a == start)
            assert n - c.gram + 1 - c.gram * decontaminate.allowed(n) >= 1
    for rate in (0.02, 0.05, 0.08, 0.1):
        for glue in (" ", word() + word()):
            docs = [f"{text(200)}{glue}{mutate(draw, i, int(len(i) * rate + 1e-9))}{glue}{text(200)}" for i in items]
            found = {(d, i) for d, i, *_ in decontaminate.matches(index, docs)}
            for k, n in enumerate(lengths):
                assert sum((d, d) in found for d in range(k, len(items), len(lengths))) >= 5, (rate, glue, n)


def test_a_short_item_beside_a_shorter_one():
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("etaoinshrdlu ") for _ in range(n - 1)) + "x"
    for _ in range(20):
        index = decontaminate.ItemIndex.build([text(27), own := text(30)])
        assert any(i == 1 for _, i, *_ in decontaminate.matches(index, [f"{text(100)} {mutate(draw, own, 3)} {text(100)}"]))


def test_decontamination_without_spaces():
    draw = random.Random(12)
    text = lambda n, first, last: "".join(chr(draw.randint(first, last)) for _ in range(n))
    for first, last in ((0x4E00, 0x5E00), (0x3041, 0x3094), (0x61, 0x7A)):
        items = [text(n, first, last) for n in (6, 14, 40, 150, 700)]
        index = decontaminate.ItemIndex.build(items)
        docs = [text(400, first, last) + i + text(n, first, last) for i in items for n in (400, 0)]
        assert [(d, i, edits, start) for d, i, edits, start, _ in decontaminate.matches(index, docs)] == [(d, d // 2, 0, 400) for d in range(10)]
        edited = [text(400, first, last) + i[:20] + "#" + i[21:] + text(400, first, last) for i in items[2:]]
        assert [(d, i, edits) for d, i, edits, *_ in decontaminate.matches(index, edited)] == [(d, d + 2, 1) for d in range(3)]


def brute_kernel(left, right):
    """Gap-weighted subsequences of four marks within tokens, one by one."""

    def weights(sentence):
        out, norm, last = {}, toxicity.SHORT, None
        for token in sentence:
            marks = [0, *token, 0]
            if len(token) < 2 or token == last:
                last = token
                continue
            last = token
            for places in itertools.combinations(range(len(marks)), 4):
                spread = places[-1] - places[0] + 1
                if spread <= 6 and all(y - x <= 3 for x, y in zip(places, places[1:])):
                    code = tuple(marks[i] for i in places)
                    out[code] = out.get(code, 0) + toxicity.DECAY**spread
                    norm += toxicity.DECAY ** (2 * spread)
        return {c: v / norm**0.5 for c, v in out.items()}

    a, b = weights(left), weights(right)
    return sum(v * b.get(c, 0) for c, v in a.items())


def test_kernel_of_sentences_against_brute_force():
    draw = np.random.default_rng(0)
    tokens = [tuple(draw.integers(1, 4, n).tolist()) for n in (1, 2, 3, 5, 6, 8, 11)]
    sentences = [[tokens[i] for i in draw.integers(0, 7, n)] for n in (1, 2, 3, 5, 8, 4, 4)]
    raw = [b"\0" + b"".join(bytes(t) + b"\0" for t in s) for s in sentences]
    found = toxicity.kernel(raw, raw[:4])
    assert found == pytest.approx(np.array([[brute_kernel(a, b) for b in sentences[:4]] for a in sentences]))
    # One weight for each subsequence rates sentences as the landmarks do, whatever stands around them.
    beta, weights = draw.normal(size=4), np.zeros(toxicity.SLOTS)
    who, code, value = toxicity.features(raw[:4])
    np.add.at(weights, code, beta[who] * value)
    text = ". ".join(" ".join("".join(chr(96 + c) for c in t) for t in s) for s in sentences if not any(len(t) == 1 for t in s))
    kept = [k for k, s in enumerate(sentences) if not any(len(t) == 1 for t in s)]
    split = toxicity.sentences_of([text])
    assert split.raw() == [raw[k] for k in kept]
    assert toxicity.sentence_sums(split, weights.astype(np.float32)) == pytest.approx((found @ beta)[kept], rel=1e-3, abs=1e-4)


def test_sentences():
    read = lambda t: ["".join(chr(96 + c) if c else " " for c in x).strip() for x in toxicity.sentences_of([t]).raw()]
    assert read("One two. Three!\nFour a.b five") == ["one two", "three", "four ab five"]
    assert read("a1 " * 20) == [" ".join(["ai"] * 8)] * 2 + [" ".join(["ai"] * 4)]
    assert read("noooooo way") == ["nooo way"] and read("i d i o t now") == ["idiot now"]
    s = toxicity.sentences_of(["a b.", None, "", "cc dd. ee"])
    assert s.text.tolist() == [0, 3, 3]


def test_toxic_documents_of_ordinary_words():
    """No word is toxic by itself often enough to be listed, but some sentences only toxic documents have."""
    draw = random.Random(9)
    words = ["".join(draw.choice(["ta", "ri", "mo", "en", "lu", "ske"]) for _ in range(draw.randint(2, 4))) for _ in range(200)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    threat = lambda: draw.choice(["we know where you sleep", "you will pay for this"])
    good = [f"{text(20)}. {draw.choice(['you sleep well', 'we know this', 'pay the bill'])}. {text(20)}" for _ in range(150)]
    bad = [f"{text(20)}. {threat()}. {text(20)}" for _ in range(60)]
    model = toxicity.fit(good + bad, [0] * 150 + [1] * 60)
    assert (model.scores([f"{text(15)}. {threat()}. {text(9)}" for _ in range(40)]) >= toxicity.THRESHOLD).mean() > 0.9
    assert (model.scores([f"{text(15)}. you sleep well. {text(9)}" for _ in range(40)]) < toxicity.THRESHOLD).mean() > 0.9


def test_toxicity_learns_and_tolerates_spelling():
    draw = random.Random(8)
    words = ["".join(draw.choice(["ta", "ri", "mo", "en", "lu", "ske"]) for _ in range(draw.randint(1, 4))) for _ in range(300)]
    text = lambda n: [draw.choice(words) for _ in range(n)]
    insults = ["idiot", "moron", "scumbag"]
    good = [" ".join(text(40)) for _ in range(200)]
    bad = [" ".join(w[:20] + [draw.choice(insults)] + w[20:]) for w in (text(40) for _ in range(60))]
    model = toxicity.fit(good + bad, [0] * 200 + [1] * 60)
    plain = " ".join(text(10))
    for spelled in ("idiot", "IDIOT!", "id-iot", "i d i o t", "idiiot", "id1ot", "s.c.u.m.b.a.g", "mor*on"):
        assert model.scores([f"{plain} {spelled} {plain}"])[0] >= toxicity.THRESHOLD, spelled
    assert (model.scores([" ".join(text(60)) for _ in range(50)]) < toxicity.THRESHOLD).mean() > 0.95
    assert list(model.scores(["", None, "...", "7 . 8"])) == [0, 0, 0, 0]
    assert list(toxicity.fit(["a b c"], [0]).scores(["x"])) == [0]
    assert zlib.crc32(model.weights.tobytes()) == zlib.crc32(toxicity.fit(good + bad, [0] * 200 + [1] * 60).weights.tobytes())


@pytest.mark.parametrize("letters, insults, space", [
    ("абвгдежзиклмнопрстуф", ["придурок", "мерзавец"], " "), ("αβγδεζηθικλμνξοπρστ", ["ηλιθιος", "βλακας"], " "), ("가나다라마바사아자차카타파하", ["멍청이", "쓰레기"], " "),
    ("ابتثجحخدذرزسشصضط", ["كلبحقير", "غبيجدا"], " "), ("的一是在不了有和人这中大为上个国我以要他时来用们", ["笨蛋", "混账"], ""), ("กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ", ["ไอ้โง่", "สารเลว"], ""),
])
def test_toxicity_of_other_scripts(letters, insults, space):
    draw = random.Random(3)
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(2, 7))) for _ in range(300)]
    text = lambda n: [draw.choice(words) for _ in range(n)]
    good = [space.join(text(40)) for _ in range(200)]
    bad = [space.join(w[:20] + [draw.choice(insults)] + w[20:]) for w in (text(40) for _ in range(60))]
    model = toxicity.fit(good + bad, [0] * 200 + [1] * 60)
    found = model.scores([space.join([*text(10), i, *text(10)]) for i in insults])
    assert (found >= toxicity.THRESHOLD).all()
    assert (model.scores([space.join(text(60)) for _ in range(50)]) < toxicity.THRESHOLD).mean() > 0.95


def test_toxicity_reads_disguised_latin_letters():
    draw = random.Random(8)
    words = ["".join(draw.choice(["ta", "ri", "mo", "en", "lu", "ske"]) for _ in range(draw.randint(1, 4))) for _ in range(300)]
    text = lambda n: [draw.choice(words) for _ in range(n)]
    good = [" ".join(text(40)) for _ in range(200)]
    bad = [" ".join([*text(20), "idiot", *text(20)]) for _ in range(60)]
    model = toxicity.fit(good + bad, [0] * 200 + [1] * 60)
    full, bold = "".join(chr(0xFF21 + ord(c) - 97) for c in "idiot"), "".join(chr(0x1D41A + ord(c) - 97) for c in "idiot")
    for spelled in (full, full.lower(), bold):
        assert model.scores([f"{' '.join(text(10))} {spelled} now"])[0] >= toxicity.THRESHOLD, spelled


def test_toxicity_learns_rare_insults():
    draw = random.Random(4)
    word = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    words = [word("aeioulmnrst", draw.randint(2, 9)) for _ in range(500)]
    text = lambda n: [draw.choice(words) for _ in range(n)]
    insults = sorted({word("bcdfghkopuvwxyz", draw.randint(5, 9)) for _ in range(400)})
    good = [" ".join(text(30)) for _ in range(1600)]
    bad = [" ".join([*text(15), insult, *text(15)]) for insult in insults for _ in range(4)]
    model = toxicity.fit(good + bad, [0] * len(good) + [1] * len(bad))
    assert (model.scores([" ".join([*text(10), i, *text(10)]) for i in insults]) >= toxicity.THRESHOLD).mean() > 0.95
    assert (model.scores([" ".join(text(30)) for _ in range(300)]) < toxicity.THRESHOLD).mean() > 0.95
