"""The registered queries, whole, against plain versions; every operator among clashing column names."""

import hashlib
import inspect
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswash.llm import chat_format, common, components, decontaminate, fingerprint, jaccard, lang_id, mixing, pii, queries, shards, toxicity, url_filter
from test_text_models import plain_pii

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def run(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}


@tables
def test_op1(spark, documents):
    out = run(spark, "op1_language_id")
    assert {"doc_id", "held_out", "lang_pred", "score"} <= set(next(iter(out.values())).asDict()) and len(out) == len(documents)
    learn = [r for r in documents if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None and r["text"] is not None]
    learn.sort(key=lambda r: (r["lang"], str(r["doc_id"])))
    model = lang_id.LanguageModel.fit([r["text"] for r in learn], [r["lang"] for r in learn])
    lower, script = lang_id.letter_tables()

    def plain(text):
        """Words one by one, Viterbi one step at a time."""
        w = lang_id.words_of([text])
        if not len(w.first):
            return "und"
        back, letters, value = [], np.zeros(len(model.languages)), None
        ends = [*w.first[1:], len(w.buckets)]
        for a, b, kind in zip(w.first, ends, w.script):
            own = sum(model.table[x].astype(np.float32) for x in w.buckets[a:b]) + np.where(model.allowed[kind], 0, -np.inf)
            own = np.where(np.isinf(own), -1e4, own)
            if value is None:
                value = own.astype(float)
                continue
            top = value.max() - lang_id.PENALTY
            back.append(np.where(value >= top, np.arange(len(value)), value.argmax()))
            value = np.maximum(value, top) + own
        path = [int(value.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        for tag, n in zip(reversed(path), w.length):
            letters[tag] += n
        return model.languages[int(letters.argmax())]

    right = []
    for r in documents:
        got = out[r["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= got["score"] <= 1
        assert got["lang_pred"] == plain(r["text"] or ""), r["doc_id"]
        if got["held_out"] and r["lang"] is not None and got["lang_pred"] != "und":
            right.append(got["lang_pred"] == r["lang"])
    assert np.mean(right) > 0.95


@tables
def test_op2(spark, documents):
    out = run(spark, "op2_fingerprint")
    texts = [r["text"] or "" for r in documents]
    assert len(out) == len(texts)
    alone = {t: fingerprint.digests([t]) for t in set(texts)}
    for r, own, after in zip(documents, texts, [*texts[1:], texts[0]]):
        got, k = out[r["doc_id"]], len(own) // 4
        new = own[: len(own) - k] + after[:k] if k else own
        made = fingerprint.digests([new])
        assert got["n_chars"] == len(own) and got["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert [got["fingerprint"], got["edited_fingerprint"]] == [*fingerprint.as_text(alone[own]), *fingerprint.as_text(made)]
        assert got["near_edited"] == pytest.approx(fingerprint.likeness(alone[own], made)[0])
        assert got["near_next"] == pytest.approx(fingerprint.likeness(alone[own], alone[after])[0])
    assert np.median([r["near_edited"] for r in out.values()]) > 0.6 > 0.1 > np.median([r["near_next"] for r in out.values()])


@tables
def test_op3(spark, documents):
    out = run(spark, "op3_pii")
    assert len(out) == len(documents)
    for r in documents:
        got, base = out[r["doc_id"]], plain_pii(r["text"] or "")
        said = [f"{k}:{s}:{e}" for s, e, k in base]
        assert got["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [got[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in base) for k in pii.KINDS]
        spans = got["spans"].split(",") if got["spans"] else []
        assert set(said) <= set(spans) and got["n_spans"] == len(spans)
        added = sorted((int(s), int(e)) for k, s, e in (x.split(":") for x in spans if x not in said))
        assert all(b <= s or e <= a for a, b in added for s, e, _ in base) and all(b <= c for (_, b), (c, _) in zip(added, added[1:]))


@tables
def test_op4(spark, documents):
    items = [(r["item_id"], decontaminate.plain(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for r in documents:
        text = decontaminate.plain(r["text"] or "")
        for k, item in items:
            edits, _ = decontaminate.best_passage(item, text)
            if edits <= decontaminate.allowed(len(item)):
                want[r["doc_id"], k] = edits
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op4_decontaminate(spark, SF).collect()}
    assert len(want) > 1 and {k: v for k, v in want.items() if k in got} == got and len(got) >= 0.95 * len(want)


@tables
def test_op7(spark, documents):
    out = run(spark, "op7_toxicity")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    learn = sorted((str(r["doc_id"]), labels[r["doc_id"]], r["text"]) for r in documents if labels.get(r["doc_id"]) in (0, 1) and not held(r["doc_id"]) and r["text"] is not None)
    model = toxicity.fit([t for *_, t in learn], [y for _, y, _ in learn])
    assert len(out) == len(documents)
    for r in documents:
        got = out[r["doc_id"]]
        assert got["held_out"] == held(r["doc_id"]) and got["score"] == pytest.approx(model.scores([r["text"]])[0], abs=1e-4)
        assert 0 <= got["score"] <= 1 and got["predicted"] == int(got["score"] >= 0.3)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_toxicity_on_held_out_labels(spark):
    """On sf0.01, beside a logistic machine over words that has the same labels."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in rows.filter("text is not null").collect())
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    learn, test = [r for r in rows if not held(r[0])], [r for r in rows if held(r[0])]
    y = np.array([r[1] for r in test])
    found = toxicity.fit([t for *_, t in learn], [v for _, v, _ in learn]).scores([t for *_, t in test]) >= toxicity.THRESHOLD
    words = lambda t: set(re.findall("[a-z]+", t.lower()))
    index = {w: i for i, w in enumerate(sorted({w for *_, t in learn for w in words(t)}))}
    x = np.zeros((len(rows), len(index)), np.float32)
    for i, (*_, t) in enumerate([*learn, *test]):
        x[i, [index[w] for w in words(t) if w in index]] = 1
    a, b, truth, w, bias = x[: len(learn)], x[len(learn) :], np.array([v for _, v, _ in learn]), np.zeros(len(index)), 0.0
    cost = np.where(truth == 1, (truth == 0).sum() / max(1, truth.sum()), 1.0)
    for _ in range(300):
        p = 1 / (1 + np.exp(-(a @ w + bias)))
        w -= 0.02 * (a.T @ (cost * (p - truth)) / len(a) * 10 + 0.01 * w)
        bias -= 0.02 * (cost * (p - truth)).mean()
    plain = 1 / (1 + np.exp(-(b @ w + bias))) >= 0.5
    f = lambda said: 2 * (said & (y == 1)).sum() / max(1, said.sum() + y.sum())
    print("sentences", f(found), "words", f(plain))
    assert f(found) >= 0.55 and f(found) >= f(plain) and (found & (y == 0)).sum() <= 0.06 * (y == 0).sum()


@tables
def test_op8(spark, documents):
    out = run(spark, "op8_hilbert_shards")
    assert len(out) == len(documents)
    for r in documents:
        raw = (r["text"] or "").encode()
        assert [out[r["doc_id"]][c] for c in ("size", "text_crc32", "law", "grown_shard")] == [len(raw) + 8, zlib.crc32(raw), "rows", None]
    line = sorted(out.values(), key=lambda r: (r["curve"], r["text_crc32"], r["doc_id"]))
    base, extra = divmod(len(line), 24)
    assert [(r["shard"], r["slot"]) for r in line] == [(k, i) for k in range(24) for i in range(base + (k < extra))]
    # The curve index of the cells: order-keeping numbers, quantised at their own quantiles.
    cells = {}
    for r in documents:
        cells.setdefault((r["lang"], r["source"], len((r["text"] or "").encode())), set()).add(out[r["doc_id"]]["curve"])
    assert all(len(v) == 1 for v in cells.values())


TEXTS = ["the quick brown fox jumps over the lazy dog and runs away", "mail ann.lee@example.com or +1 (258) 555-7056", "", None, "idiot of a text with an idiot in it"]


def literals(*modules):
    """Every name that these modules write out as a string."""
    return sorted({x for m in (common, components, *modules) for x in re.findall(r'"([A-Za-z_][A-Za-z_0-9]*)"', inspect.getsource(m))})


def clashing(df, *modules, but=()):
    """df with a column for every name that the modules use, and for odd ones."""
    taken = {c.lower() for c in (*df.columns, *but)}
    names = [n for n in [*literals(*modules), "_row", "_text", "_word", "_order", "a.b", "a b", "back`tick"] if n.lower() not in taken and not taken.add(n.lower())]
    names = [n for n in names if re.fullmatch(r"[A-Za-z_0-9.` ]+", n)]
    return df.select("*", *[F.lit(f"c:{n}").alias(n) for n in names], F.struct(F.lit(1).alias("x y")).alias("odd struct"))


def same(got, want, columns):
    show = lambda df: sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert show(got) == show(want)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, t, ["en", "de"][i % 2], f"s{i % 2}", 5 * i) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, lang string, source string, size long")
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and")], "item_id long, text string")
    model = lang_id.LanguageModel.fit(["the dog and the fox", "der hund und der fuchs"], ["en", "de"])
    mean = toxicity.fit(["an idiot here", "idiot there now", "you idiot man", "a dog here", "there now fox", "you man dog"] * 3, [1, 1, 1, 0, 0, 0] * 3)
    weights = np.zeros(pii.N_FEATURES)
    ignoring = {
        lang_id: (lambda df: lang_id.identify(df, model, ["doc_id"]), ["doc_id", "lang_pred", "score"]),
        fingerprint: (fingerprint.fingerprint_all, ["doc_id", "n_chars", "fingerprint", "near_next"]),
        pii: (lambda df: pii.find_all(df, weights), ["doc_id"]),
        decontaminate: (lambda df: decontaminate.find_items(df, items), ["doc_id", "item_id", "start"]),
        jaccard: (jaccard.link_classes, ["doc_id", "n_shingles", "component_id"]),
    }
    for module, (operator, columns) in ignoring.items():
        same(operator(clashing(docs, module)), operator(docs), columns)
    keeping = {
        toxicity: (lambda df: toxicity.score(df, mean), ["toxicity"]),
        decontaminate: (lambda df: decontaminate.clean(df, items), []),
        mixing: (mixing.mix, ["source_size", "target", "quota", "bucket_quota", "taken"]),
        shards: (lambda df: shards.hilbert_shards(df, ["lang", "size"], ["doc_id"], 3), ["law", "shard", "slot", "curve"]),
    }
    for module, (operator, added) in keeping.items():
        wide = clashing(docs, module, but=added)
        got = operator(wide)
        assert set(got.columns) == {*wide.columns, *added}
        same(got, operator(docs), [*docs.columns, *added])
        extra = [c for c in wide.columns if c not in docs.columns and c != "odd struct"]
        assert all(r[c] == f"c:{c}" for r in got.collect() for c in extra)
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, action string")
    wide = clashing(pages, url_filter, but=("host", "path", "rule", "verdict"))
    same(url_filter.judge_urls(wide, rules), url_filter.judge_urls(pages, rules), ["page_id", "host", "path", "rule", "verdict"])
    assert {*wide.columns, "host", "path", "rule", "verdict"} == set(url_filter.judge_urls(wide, rules).columns)
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "bot", "b")], "conv_id long, turn long, role string, text string")
    chat = lambda df: chat_format.digests(chat_format.format_records(chat_format.as_records(df)))
    same(chat(clashing(rows, chat_format)), chat(rows), ["conv_id", "turns_sha256", "loss_chars"])


def test_pipeline_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, lang string, source string, n_chars long")
    wide = clashing(docs, corpus_pipeline, but=("text_crc32", "size", "curve", "law", "shard", "slot", "toxicity", "taken", "target", "quota", "source_size", "bucket_quota"))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns, name
        same(got, stage(spark, docs, SF), docs.columns)


@pytest.mark.parametrize("kind, keys", [("int", [3, 1, None, 2, 1]), ("string", ["doc-10", "doc-2", None, "doc-100", "doc-2"]), ("double", [0.5, -1.0, None, 2.5, -1.0]), ("date", ["2020-01-03", "2020-01-01", None, "2021-05-05", "2020-01-01"]), ("bigint", [1 << 40, -5, None, 7, -5])])
def test_fingerprint_keys(spark, kind, keys):
    """Keys of several kinds, null and repeated ones; the successor is the next row by key, then text."""
    import datetime

    draw = random.Random(1)
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(n)) for n in (400, 300, 500, 200, 350)]
    rows = [(datetime.date.fromisoformat(k) if kind == "date" and k else k, t) for k, t in zip(keys, texts)]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    line = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
    want = sorted((str(k), hashlib.sha256(fingerprint.edited(t, line[(i + 1) % 5][1]).encode()).hexdigest()) for i, (k, t) in enumerate(line))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in fingerprint.fingerprint_all(df.repartition(3)).collect()) == want
    assert fingerprint.fingerprint_all(df.limit(0)).count() == 0


def test_many_languages(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(150)]
    model = lang_id.LanguageModel.fit([f"{w} {w}" for w in words], [f"l{i:03d}" for i in range(150)])
    found = lang_id.label(model, words)[0]
    assert sum(x == f"l{i:03d}" for i, x in enumerate(found)) > 140 and max(found) > "l140"
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lang_id.identify(empty, model, ["doc_id"]).count() == 0


def test_texts_beyond_a_chunk(spark, monkeypatch):
    """Whole texts, however long: what counts stands at the end."""
    filler = "some words that say nothing at all of it "
    long = filler * (2 * common.CHUNK_BYTES // len(filler))
    item = "a passage of the benchmark that stands behind everything else"
    tail = f"{item}. mail joe@example.com you idiot"
    docs = spark.createDataFrame([(1, long + tail), (2, "short"), (3, long + tail), (4, long)], "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.find_items(docs, items).collect()) == [1, 3]
    spans = {r["doc_id"]: r["spans"] for r in pii.find_all(docs, np.zeros(pii.N_FEATURES)).collect()}
    assert [(long + tail)[s["start"] : s["end"]] for s in spans[1]] == ["joe@example.com"] and spans[4] == []
    model = toxicity.fit(["an idiot here", "idiot there now", "you idiot man", "a dog here", "there now fox", "you man dog"] * 3, [1, 1, 1, 0, 0, 0] * 3)
    score = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    assert score[1] == score[3] >= toxicity.THRESHOLD > score[4]
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprint_all(docs).collect()}
    assert prints[1] == prints[3] != prints[4]
    links = {r["doc_id"]: r["component_id"] for r in jaccard.link_classes(docs).collect()}
    assert links[1] == links[3] == 1


def test_bad_rows_are_found_by_bitmap(spark):
    df = spark.range(2000).select(F.xxhash64("id").alias("h"), "id").withColumn("_word", F.lit("kept"))
    bad = df.filter("id % 7 = 0").select("h")
    assert sorted(r["id"] for r in common.without(df, bad, "h").collect()) == [i for i in range(2000) if i % 7]
    assert common.without(df, bad.limit(0), "h").count() == 2000 and common.without(df.limit(0), bad, "h").count() == 0
