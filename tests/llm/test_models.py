"""Models: accuracy on rows they were not trained on, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratestep.llm import langid, textbytes, toxicity

SYLLABLES = {"aa": "ka ro mi te su no".split(), "bb": "schrü pfe gen tung aub eit".split(), "cc": "ción que llo ñar ez ado".split(), "dd": "ование при ста ть не".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_codewords_are_apart():
    for k in (1, 2, 3, 5, 7, 12):
        c = langid.codewords(k)
        assert c.shape[0] == k and set(np.unique(c)) <= {-1.0, 1.0}
        if k > 1:
            assert min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) >= max(1, c.shape[1] // 4)


def test_language_accuracy(spark, sf):
    df = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    out = langid.identify(df, langid.train(df), keep=["doc_id", "lang"])
    held = out.where("held_out").toPandas()
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all() and held.ambiguous.mean() < 0.02
    crc = [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]
    assert all(crc)


def test_language_odd_rows(spark):
    rng = random.Random(0)
    rows = [(i, prose(rng, lang, 60), lang) for i, lang in enumerate(list(SYLLABLES) * 30)]
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "12 34 !! 😀", "bb"), (503, "12", None), (504, prose(rng, "dd", 100_000), None), (505, prose(rng, "aa", 50), None), (505, prose(rng, "aa", 50), None), (None, prose(rng, "cc", 50), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("lang_pred", "score", "held_out", "ambiguous", "__t")})
    model = langid.train(df)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, model, keep=df.columns).collect()]
    by = {i: (p, s) for i, p, s in got}
    assert all(by[i] == ("und", 0.0) for i in (500, 501, 502, 503))
    assert by[504][0] == "dd" and by[505][0] == "aa" and by[None][0] == "cc" and len(got) == len(rows)
    assert langid.identify(df.where("false"), model).collect() == []
    assert langid.train(df.where("false")) is None and langid.train(df.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}


def test_between_two_languages_is_flagged():
    rng = random.Random(1)
    x, y = [], []
    for k, lang in enumerate(("aa", "bb", "cc")):
        for _ in range(60):
            t = prose(rng, lang, 80).encode()
            x.append(langid.bags(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]))[0])
            y.append(k)
    m = langid.fit(np.array(x), np.array(y), ["aa", "bb", "cc"])
    _, _, clear = m.decode(np.array(x))
    mixed = (np.array(x[:60]) + np.array(x[60:120])) / 2
    _, _, lead = m.decode(mixed)
    assert np.median(lead) < np.median(clear) / 3


RUDE = ["grumblok", "snarfet", "zotterig", "blixwad"]


def toxic_corpus(n, seed, rude=RUDE):
    rng = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        w = prose(rng, "aa", rng.randrange(20, 300)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(max(1, len(w) // 60)):
                w.insert(rng.randrange(len(w)), rng.choice(rude))
        texts.append(" ".join(w))
        y.append(int(bad))
    return texts, np.array(y)


def scores(model, texts):
    raw = [t.encode() for t in texts]
    off = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    return model.probability(*model.logits(np.frombuffer(b"".join(raw), dtype=np.uint8), off))


@pytest.fixture(scope="module")
def model():
    texts, y = toxic_corpus(600, 1)
    return toxicity.fit([t.encode() for t in texts], y)


def test_toxicity_on_new_texts_and_new_spellings(model):
    texts, y = toxic_corpus(400, 2)
    p = scores(model, texts)
    assert (p[y == 1] >= 0.7).mean() > 0.9 and (p[y == 0] >= 0.7).mean() < 0.02
    rng = random.Random(3)
    base = [prose(rng, "aa", 30) for _ in range(20)]
    # Never seen as words; their n-grams were.
    varied = scores(model, [f"{t} {w}" for t, w in zip(base, ["grumbloks", "snarfets", "zotterige", "blixwads"] * 5, strict=True)])
    assert varied.mean() > scores(model, base).mean() + 0.25
    assert (scores(model, ["ka " * 2000, "rokami " * 300]) < 0.7).all()


def test_long_texts_are_read_whole(model):
    rng = random.Random(4)
    long = prose(rng, "aa", 30_000)
    assert scores(model, [long])[0] < 0.7 <= scores(model, [long + " grumblok snarfet " + prose(rng, "aa", 10)])[0]


def test_features_follow_row_borders():
    data = b"abcdefgh"
    off = np.array([0, 4, 4, 8])
    ids, words, row, hashes = toxicity.features(np.frombuffer(data, dtype=np.uint8), off)
    one, _, _, h1 = toxicity.features(np.frombuffer(b"abcd", dtype=np.uint8), np.array([0, 4]))
    two, _, _, h2 = toxicity.features(np.frombuffer(b"efgh", dtype=np.uint8), np.array([0, 4]))
    assert sorted(ids) == sorted([*one, *two]) and row.tolist() == [0, 2] and hashes.tolist() == [*h1, *h2] and set(words) == {0, 1}


def test_toxicity_queries(spark, sf):
    d = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    hit = out.predicted == 1
    assert hit[out.toxic == 1].mean() > 0.7 and hit[out.toxic == 0].mean() < 0.02
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id)


def test_toxicity_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "grumblok snarfet ka ro"), (4, "grumblok snarfet ka ro"), (None, "ka ro mi"), (6, "ka ro " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "held_out", "predicted", "__t", "toxic")})
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(df, model).collect()}
    assert got[1] == got[2] == got[3] and got[1][1] == 0 and got[4][1] == 1 and got[6][1] == 0 and len(toxicity.score(df, model).collect()) == 7
    assert toxicity.score(df.where("false"), model).collect() == []
    labels = spark.createDataFrame([(4, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(df, labels.where("false")) is None and toxicity.train(df.where("false"), labels) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}


def test_span_hashes_depend_on_the_bytes_alone():
    data = np.frombuffer(b"the cat the hat THE", dtype=np.uint8)
    sep = np.arange(256) == 32
    b, e, _ = textbytes.word_spans(data, np.array([0]), sep)
    h = textbytes.span_hashes(data, b, e)
    assert h[0] == h[2] and len(set(h.tolist())) == 4
    h2 = textbytes.span_hashes(textbytes.LOWER[data], b, e)
    assert h2[0] == h2[4]
