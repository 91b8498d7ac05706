"""Operators on small DataFrames: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from corpuswash.llm import chat_format, common, components, decontaminate, fingerprint, jaccard, lang_id, mixing, pii, queries, shards, toxicity, url_filter

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_urls(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("x.org", "/a", "block"), ("x.org", "/a", "allow")], "host string, path string, action string")
    urls = ["http://A.Example.COM/en/1?q#f", "https://www.example.com/en/", "http://example.com", "http://example.com/de", "http://notexample.com/en/x", "http://x.org/abc", "nonsense", "", None, "ftp://h://i/j", "http://x.org/abc"]
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules, default="block").orderBy("page_id").collect()]
    assert got == [
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("example.com", "", None, "block"), ("example.com", "/de", "com/", "allow"),
        ("notexample.com", "/en/x", "com/", "allow"), ("x.org", "/abc", "x.org/a", "allow"), ("", "", None, "block"), ("", "", None, "block"), ("", "", None, "block"), ("h:", "//i/j", None, "block"),
        ("x.org", "/abc", "x.org/a", "allow"),
    ]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_chat_layouts():
    layouts = {
        "messages": {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        "shared": {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        "nested": {"data": {"turns": [{"speaker": "human", "text": "a"}, {"speaker": "bot", "text": "b"}]}},
        "instruction": {"instruction": "a", "output": "b"},
        "prompt": {"prompt": "a", "completion": "b"},
    }
    for name, record in layouts.items():
        assert chat_format.canonical(record) == (name, [("user", "a"), ("assistant", "b")])
    assert chat_format.canonical({"input": "", "instruction": "i", "output": "o"}) == ("instruction_input", [("system", "i"), ("assistant", "o")])
    assert chat_format.canonical({"other": 1}) == (None, []) and chat_format.canonical([1]) == (None, [])


def test_chat_round_trip():
    draw = random.Random(1)
    for _ in range(500):
        turns = [("".join(draw.choice("ab:\\#<\n") for _ in range(draw.randint(0, 5))), "".join(draw.choice(["\\", "#", "<", "</turn>", "### ", "n", "\n", "é", ": "]) for _ in range(draw.randint(0, 8)))) for _ in range(draw.randint(0, 4))]
        turns.append(("assistant", turns[0][1] if turns else ""))
        text, mask = chat_format.render(turns)
        assert chat_format.read_back(text) == turns
        assert "".join(chat_format.unescape(text[a:b]) for a, b in mask) == "".join(t for r, t in turns if r == "assistant")
    with pytest.raises(ValueError):
        chat_format.read_back("### user: x")


def test_chat_rows(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "</turn>"), (1, 0, "user", None), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "user", "y")], "conv_id long, turn long, role string, text string").withColumn("m", F.lit(1))
    out = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_records(chat_format.as_records(rows))).collect()}
    assert out[1]["n_turns"] == 3 and out[1]["loss_chars"] == 7 and out[1]["loss_sha256"] == hashlib.sha256(b"</turn>").hexdigest()
    assert out[1]["turns_sha256"] == hashlib.sha256(b"user\n\nuser\n\nassistant\n</turn>\n").hexdigest() and out[2]["n_turns"] == 1 and None in out
    bad = spark.createDataFrame([(1, "{"), (2, None), (3, json.dumps({"prompt": "p", "completion": "c"}))], "conv_id long, record string")
    assert [r["mapping"] for r in chat_format.format_records(bad).orderBy("conv_id").collect()] == [None, None, "prompt"]
    assert chat_format.as_records(rows.limit(0)).count() == 0


def test_hilbert_curve_is_continuous_and_whole():
    import numpy as np

    for n, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")).reshape(n, -1)
        index = shards.hilbert_index(list(cells), bits)
        assert sorted(index) == list(range(1 << (n * bits)))
        path = cells[:, np.argsort(index)]
        assert (np.abs(np.diff(path, axis=1)).sum(0) == 1).all()


def test_shards(spark):
    rows = [(i if i % 9 else None, ["en", "de", None][i % 3], f"src{i % 5}", i * i % 97, i % 4, i) for i in range(101)] + [(7, "en", "src1", 5, 0, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, size long, text_crc32 long, slot long")
    out = shards.hilbert_shards(df, ["lang", "source", "size"], ["text_crc32", "doc_id"], 24).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == 104 and set(by) == set(range(24)) and {len(v) for v in by.values()} <= {4, 5}
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and {r["law"] for r in out} == {"rows"}
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in out)
    assert shards.hilbert_shards(df.limit(0), ["lang", "source", "size"], ["text_crc32", "doc_id"], 24).count() == 0
    few = shards.hilbert_shards(df.limit(5), ["lang"], ["doc_id"], 24).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(i, 0) for i in range(5)]


def brute_mix(rows):
    """Targets by repeated filling and seats one by one."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_.remove(s)
    seats = dict.fromkeys(names, 0)
    for _ in range(int(total / mixing.BLOCK + 0.5)):
        s = max(names, key=lambda s: (target[s] / (2 * seats[s] + 1), -names.index(s)))
        seats[s] += 1
    return sizes, target, seats


def brute_taken(rows):
    """For every source its seats, its buckets' seats, and words taken by key, one block and one document at a time."""
    sizes, target, seats = brute_mix(rows)
    bits = (max((sum(x[1] == s for x in rows) for s in sizes), default=0) // 128).bit_length()
    given, taken = {}, {}
    for s in sizes:
        lines = {}
        for key, of, n in rows:
            if of == s:
                order = hashlib.md5(f"mix-1:{'' if key is None else key}".encode()).hexdigest()
                lines.setdefault(int(order[:4], 16) >> (16 - bits), []).append((order, n, key))
        aim = {k: seats[s] * sum(x[1] for x in v) / sizes[s] if sizes[s] else 0 for k, v in sorted(lines.items())}
        dealt = dict.fromkeys(aim, 0)
        for _ in range(seats[s]):
            dealt[max(aim, key=lambda k: (aim[k] / (2 * dealt[k] + 1), -k))] += 1
        for k, line in lines.items():
            left = min(dealt[k] * mixing.BLOCK, 3 * sum(x[1] for x in line))
            taken |= {x[2]: 0 for x in line}
            while left:
                for _, n, key in sorted(line):
                    taken[key] += min(n, left)
                    left -= min(n, left)
            given |= {x[2]: dealt[k] for x in line}
    return sizes, target, seats, given, taken


def test_mixing(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice(["a", "b", "c", "d", None, "a", "a"]), draw.choice([0, 3, 40, 500])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit("x"))
    out = mixing.mix(df).collect()
    sizes, target, seats, given, taken = brute_taken(rows)
    assert len(out) == 700
    for s in sizes:
        own = [r for r in out if r["source"] == s]
        assert {r["quota"] for r in own} == {seats[s]}
        assert all(r["bucket_quota"] == given[r["doc_id"]] and r["taken"] == taken[r["doc_id"]] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= mixing.BLOCK * 4
        assert all(r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[s] for r in own)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    assert mixing.mix(df.limit(0)).count() == 0
    zero = mixing.mix(spark.createDataFrame([(None, None, 0), (1, "a", 0)], "doc_id long, source string, size long")).collect()
    assert [r["taken"] for r in zero] == [0, 0]
    texts = spark.createDataFrame([("a b\tc",), ("",), (None,), ("\u00a0x y",)], "t string").select(mixing.words(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in texts] == [3, 0, 0, 2]


def brute_links(rows):
    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        w = [x for part in w for x in part.replace("\t", "\n").replace("\r", "\n").split("\n") if x]
        return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(s), least[find(i)] if s else k) for i, (k, s) in enumerate(sets))


def near_rows(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 6)))
    rows, passage = [], [word() for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(draw.choice([3, 5, 8, 30, 120]))] + draw.choice([[], passage])
        for _ in range(draw.choice([1, 2, 6, 14])):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                text[draw.randrange(len(text))] = word()
            rows.append((len(rows) * 3 % 101 + 1000 * len(rows), draw.choice([" ", "\n", " \t"]).join(text).upper()))
    return [*rows, (1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (5, "one  TWO")]


SMALL = {"CENTRES": 2, "LISTED": 3, "PAGE": 1, "SEARCHING": 3}


@pytest.mark.parametrize("changed, seed", [({}, 1), (SMALL | {"BLOCK_NODES": 4, "REPEATED": 2}, 2), (SMALL | {"BLOCK_NODES": 6, "RANKED": 0}, 3), (SMALL | {"BLOCK_NODES": 5, "REPEATED": 2, "SALTED": 4}, 4)])
def test_jaccard_join(spark, monkeypatch, changed, seed):
    for name, value in changed.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("n", F.lit(None).cast("string")).withColumn("key", F.lit(1)).repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_classes(df).collect())
    assert got == brute_links(rows)


@pytest.mark.parametrize("limits", [SMALL | {"BLOCK_NODES": 4}, SMALL | {"BLOCK_BYTES": 2000, "PAGE": 2}])
def test_jaccard_cell_of_strangers(spark, monkeypatch, limits):
    """One cell whose nodes mostly stay apart: they search the boxes of the other blocks; links between blocks are found."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    shared, rows = [word() for _ in range(30)], []
    for k in range(40):
        own = [word() for _ in range(50)]
        rows.append((2 * k, " ".join([*shared, *own])))
        if k % 3 == 0:  # a copy with a word changed, whose least shingle may differ
            own[draw.randrange(50)] = word()
            rows.append((2 * k + 1, " ".join([*shared, *own])))
    everything = lambda pairs, points: pairs  # noqa: E731  as if no point ruled a pair out
    monkeypatch.setattr(jaccard, "allowed_pairs", everything)
    monkeypatch.setattr(jaccard, "REPEATED", 1 << 30)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_classes(df).collect()) == brute_links(rows)


def test_shuffle_files_of_finished_queries_are_deleted(spark):
    """release() has them deleted, without waiting for the driver's heap to fill up."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    lying = lambda: {n for n in (blocks.getAllFiles().apply(i).getName() for i in range(blocks.getAllFiles().size())) if n.startswith("shuffle_")}
    before = lying()
    spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count().collect()
    own = lying() - before
    assert own
    for _ in range(10):  # the listeners may still hold the query the first time
        common.release(spark)
        time.sleep(0.5)
        if not own & lying():
            break
    assert not own & lying()


def test_jaccard_sets_lie_on_disk_in_rounds(spark, monkeypatch):
    """Where nearly every row has a near copy, only a part of the sets is written at a time, and deleted before the next part."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(60)]
        for _ in range(2):
            base[draw.randrange(60)] = word()
            rows.append((len(rows), " ".join(base)))
    lying, most, rounds = {}, [], []
    write, delete = jaccard.materialize, jaccard.discard

    def written(df, name):
        out = write(df, name)
        if name == "jaccard-sets":
            lying[out.shared_path] = out.count()
            rounds.append(lying[out.shared_path])
            most.append(sum(lying.values()))
        return out

    def deleted(*tables):
        delete(*tables)
        for df in tables:
            lying.pop(df.shared_path, None)

    monkeypatch.setattr(jaccard, "ROUND_BYTES", 1000, raising=False)
    monkeypatch.setattr(jaccard, "materialize", written)
    monkeypatch.setattr(jaccard, "discard", deleted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_classes(df).collect()) == brute_links(rows)
    assert max(most) <= 0.5 * len(rows) < len(rows) <= sum(rounds)


def test_jaccard_strangers_of_a_frequent_coordinate_are_no_cell(spark, monkeypatch):
    """A leading shingle that many strangers hold is looked at pair by pair, in parts, and does not join them."""
    draw = random.Random(9)
    word = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    passage = " ".join(word(16) for _ in range(5))
    rows = [(2 * k, " ".join([passage, *(word(5) for _ in range(4000))])) for k in range(60)]
    rows += [(2 * k + 1, rows[k][1] + " more") for k in (3, 30)]
    placed, write = [], jaccard.materialize

    def written(df, name):
        out = write(df, name)
        if name == "jaccard-placed":
            placed.append(out.count())
        return out

    for name, value in {"REPEATED": 1 << 30, "SHARED": 1, "POINTED": 500}.items():
        monkeypatch.setattr(jaccard, name, value, raising=False)
    monkeypatch.setattr(jaccard, "materialize", written)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_classes(df).collect()) == brute_links(rows)
    assert placed == [4]


def test_jaccard_long_shingles_lead():
    """Frequent short words, which strangers share, do not come among the leading coordinates of a text with longer ones."""
    short = " ".join("the of and to in it is as by on at an or if".split() * 2)
    (own,) = jaccard.shingle_sets([short + " " + " ".join(f"considerable{k} neighbourhoods{k}" for k in range(20))])
    (stop,) = jaccard.shingle_sets([short])
    assert not set(own[: jaccard.prefix(len(own))].tolist()) & set(stop.tolist())
    assert len(set(own.tolist()) & set(stop.tolist())) == len(stop)


def test_jaccard_bounds_hold():
    import numpy as np

    draw = np.random.default_rng(5)
    for n in (1, 30, 500, 2000, 6000):
        base = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        for keep in (0.8, 0.86, 0.9, 0.97):
            other = np.unique(np.concatenate([base[draw.random(len(base)) < keep], draw.integers(0, 1 << 63, int(n * (1 - keep)), dtype=np.uint64)]))
            if jaccard.linked(base, other):
                assert jaccard.may_link(jaccard.point_of(base), len(base), jaccard.point_of(other), len(other))
                assert len(jaccard.CountTree([other] * 200).search(base)) == 200
                assert set(base[: jaccard.prefix(len(base))]) & set(other[: jaccard.prefix(len(other))])
                box = jaccard.corner([jaccard.group_counts(s, 64) for s in (other, base[:3])], 64)[None]  # counts of 255 and more
                size = np.array([len(other)])
                assert jaccard.fits(jaccard.overlap(box, *jaccard.group_counts(base, 64)), len(base), size, size).all()


@pytest.mark.parametrize("n", [50, 120, 400, 1000, 2000])
def test_jaccard_boxes_rule_strangers_out(n):
    """Leaves of unrelated sets are pruned as a whole, and so are boxes of blocks; their own sets are found."""
    import numpy as np

    draw = np.random.default_rng(n)
    sets = [np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(128)]
    tree = jaccard.CountTree(sets)
    looked = found = 0
    for i in range(0, 128, 4):
        at, count = jaccard.group_counts(sets[i], tree.groups)
        upper, low, high, _, _ = tree.levels[0]
        looked += int(jaccard.fits(jaccard.overlap(upper, at, count), n, low, high).sum())
        found += int(tree.search(sets[i]).tolist() == [i])
    assert found == 32 and looked == 32  # of 512 leaves
    if n <= 400:
        box = jaccard.corner([jaccard.group_counts(s, jaccard.BOX_GROUPS) for s in sets], jaccard.BOX_GROUPS)[None]
        size = np.array([n])
        strangers = [np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(50)]
        fit = lambda s: jaccard.fits(jaccard.overlap(box, *jaccard.group_counts(s, jaccard.BOX_GROUPS)), len(s), size, size)[0]
        assert not any(fit(s) for s in strangers) and all(fit(s) for s in sets)


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {*range(301), 1000, 1001, 1002}
    assert len({got[i] for i in range(301)}) == 1 and len({got[i] for i in (1000, 1001, 1002)}) == 1 and got[0] != got[1000]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    again = components.components(spark.createDataFrame(edges, "a long, b long"), thin=False).collect()
    assert len({r["root"] for r in again}) == 2 and len(again) == len(got)


def test_successors(spark):
    texts = {i: f"document {i} " + "word " * (i % 7) * 20 for i in range(60)} | {60: "", 61: None}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, part int").repartition(5)
    out = {r["doc_id"]: r for r in fingerprint.fingerprint_all(df).collect()}
    assert set(out) == set(texts)
    for k, t in texts.items():
        new = fingerprint.edited(t or "", texts[(k + 1) % 62] or "")
        assert out[k]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and out[k]["n_chars"] == len(t or "")
    assert fingerprint.fingerprint_all(df.limit(0)).count() == 0
    assert fingerprint.fingerprint_all(df.filter("doc_id = 3")).count() == 1


def test_frames_of_the_text_models(spark):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["call +1 (258) 555-7056 4083486860054702", None, "", "a" * 70_000, "x", "x"])]
    df = docs_of(spark, rows)
    spans = {r["doc_id"]: r["spans"] for r in pii.find_all(df, pii.learn(df)).collect()}
    assert [(s["kind"], s["base"]) for s in spans[0]] == [("phone", False), ("card", False)] and spans[1] == []
    assert pii.find_all(df.limit(0), pii.fit([])).count() == 0
    model = lang_id.learn(df)
    assert {r["lang_pred"] for r in lang_id.identify(df, model, ["doc_id", "n_chars"]).collect()} == {"und"}
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.score(df, toxicity.learn(df, labels))
    assert scored.columns == [*df.columns, "toxicity"] and scored.count() == 6
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away from it"), (2, None), (3, "")], "item_id long, text string")
    docs = docs_of(spark, [(1, "so The quick brown fax jumps over the lazy dog and\nruns away from it today", None, None, 1), (2, "clean", None, None, 1), (3, None, None, None, 1), (3, None, None, None, 1)])
    assert [(r["doc_id"], r["item_id"], r["edits"], r["start"]) for r in decontaminate.find_items(docs, items).collect()] == [(1, 1, 1, 3)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [2, 3, 3]
    assert decontaminate.find_items(docs, items.limit(0)).count() == 0 and decontaminate.clean(docs.limit(0), items).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    tidy = lambda row: repr([round(v, 6) if isinstance(v, float) else v for v in row])
    assert sorted(tidy([r[c] for c in columns]) for r in got.collect()) == sorted(tidy([r[i] for i in place]) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    """Every stage against brute force."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns, name
        if name == "toxicity":
            model = queries.toxicity_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            rows = [r for r in rows if model.scores([r[1]])[0] < toxicity.THRESHOLD]
        if name == "ngram_jaccard":
            least = {k for k, _, c in brute_links([r[:2] for r in rows]) if k == c}
            rows = [r for r in rows if r[0] in least]
        if name == "decontamination":
            items = [decontaminate.plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            found = lambda t: any(decontaminate.best_passage(i, t)[0] <= decontaminate.allowed(len(i)) for i in items)
            rows = [r for r in rows if r[1] is None or not found(decontaminate.plain(r[1]))]
        if name == "mixing":
            *_, taken = brute_taken([(r[0], r[3], len(r[1].split()) if r[1] else 0) for r in rows])
            rows = [r for r in rows if r[1] and r[1].split() for _ in range(int(taken[r[0]] / len(r[1].split()) + 0.5))]
        assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows, key=str), name
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert out.count() == len(rows) and {"shard", "slot"} <= set(out.columns)
    by = {}
    for r in sorted(out.collect(), key=lambda r: (r["curve"], r["text_crc32"], r["doc_id"])):
        by.setdefault(r["shard"], []).append(r["slot"])
    assert list(by) == list(range(24)) and all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_near_copies_are_dropped_by_row(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (2, text(2)), (3, text(3)), (None, text(3)), (None, text(4)), (None, text(4)), (None, text(4) + " end"), (None, None), (None, None), (4, None), (4, None), (4, text(5))]
    docs = docs_of(spark, [(k, t, "en", f"s{i}", 1) for i, (k, t) in enumerate(rows)])
    got = sorted((r["doc_id"] or 0, (r["text"] or "").split(" ")[0], r["source"]) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    unnamed = [x for x in got if x[0] == 0]
    assert [x for x in got if x[0]] == [(1, "w1x0", "s0"), (2, "w2x0", "s2"), (3, "w3x0", "s4"), (4, "", "s11"), (4, "w5x0", "s13")]
    assert [x[1] for x in unnamed] == ["", "", "w4x0"]
