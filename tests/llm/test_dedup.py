"""Near-duplicate operators against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratestep.llm import embedding_dedup, graph, minhash_dedup
from ratestep.runtime import Scratch


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng, n_words, edits, copies):
    vocab = [f"w{i}" for i in range(400)]
    base = rng.choices(vocab, k=n_words)
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(edits * (k % 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_families_near_the_threshold(spark):
    rng = random.Random(1)
    texts = [t for n, e in ((8, 1), (30, 1), (60, 1), (60, 2), (200, 4), (400, 9)) for _ in range(6) for t in family(rng, n, e, 6)]
    passage = " ".join(f"common{i}" for i in range(60))
    texts += [passage + " " + " ".join(rng.choices([f"v{i}" for i in range(500)], k=40)) for _ in range(60)]
    texts += [t.upper() for t in texts[:10]] + ["one two", "one  two", "one", "a b c d", "a b c d e", "\tA\nb c d E"]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    got = result(minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs)


def test_a_loose_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    base = rng.choices(vocab, k=120)
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(120)] = rng.choice(vocab)
        docs.append((i, " ".join(w)))
    got = result(minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs)


def test_test_data(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = result(minhash_dedup.near_duplicates(df))
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_minhash_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(150_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "p q r s t u", None), (4, "p q r s t u", None), (5, "p q r s t u", "b"), (None, "p q r s t u", "b"), (7, long, "c"), (8, long + " z", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumns({c: F.lit("clash") for c in ("n", "key", "keys", "f1", "component_id", "kept", "n_shingles", "hub")})
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (None, 2, None, True), (7, 149_996, 7, True), (8, 149_997, 7, False)], key=str)
    assert minhash_dedup.near_duplicates(df.where("false")).collect() == []


def test_texts_that_share_an_id(spark):
    """Two texts under id 1, each near a text of another id, and ids that only occur with copies."""
    words = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, words("a")), (1, words("b")), (2, words("a") + " z"), (3, words("b") + " z"), (4, words("c")), (4, words("c")), (5, words("d")), (5, words("D")), (0, words("e")), (0, words("b") + " y"), (6, None), (6, "")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = sorted((r.doc_id, r.n_shingles, r.component_id) for r in got)
    assert by == sorted([(1, 36, 1), (2, 37, 1), (1, 36, 0), (3, 37, 0), (0, 37, 0), (0, 36, 0), (4, 36, 4), (4, 36, 4), (5, 36, 5), (5, 36, 5), (6, 0, 6), (6, 0, 6)])
    stands = [(r.doc_id, r.n_shingles, r.text_hash) for r in got if r.stands]
    assert len(set(stands)) == 7 and sorted(x[0] for x in set(stands)) == [0, 0, 1, 4, 5, 6, 6]


def test_hubs_are_dealt_out(spark, monkeypatch):
    """Shares of eight rows, so that stars and components are split."""
    monkeypatch.setattr(graph, "SHARE", 8)
    test_components(spark)
    rng = random.Random(9)
    docs = list(enumerate(family(rng, 300, 3, 60) + family(rng, 80, 1, 40)))
    assert result(minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_signatures_agree_as_often_as_sets_do():
    h = minhash_dedup.OneHash(32, 4, 256)
    rng = np.random.default_rng(0)
    for n in (6, 40, 3000):
        share = []
        for _ in range(60):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            y = np.unique(np.r_[x[: int(n * 0.8)], rng.integers(0, 2**63, n - int(n * 0.8), dtype=np.uint64)])
            both = len(np.intersect1d(x, y))
            share.append((h.signature(x) == h.signature(y)).mean() - both / (2 * n - both))
        assert abs(np.mean(share)) < 0.06


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 200, rng.integers(0, 90)).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = minhash_dedup.common_counts(sets, width=16)
    assert all(want[i][j] in (None, got[i, j]) for i in range(12) for j in range(12))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in graph.components(Scratch(spark, "t"), df).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
    assert graph.components(Scratch(spark, "t"), df.where("false")).collect() == []


def brute_vectors(rows):
    ok = {}
    for i, v in rows:
        if v is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            ok[i] = x / np.linalg.norm(x)
    links, lab = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(ok), 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.95]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in rows:
        for a, b in pairs:
            lab[a] = lab[b] = min(lab[a], lab[b])
    return {i: (links[i], lab[i]) for i, _ in rows}


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(25):
        c = rng.normal(size=24)
        rows += [c + rng.normal(size=24) * 0.12 * (k % 3) for k in range(int(rng.integers(1, 9)))]
    hot = rng.normal(size=24)
    rows += [hot] * 15 + [hot + rng.normal(size=24) * 0.05 for _ in range(30)]
    rows = [[float(np.float32(x)) for x in r] for r in rows]
    rows = list(enumerate([*rows, None, [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [], [1.0] * 5, [1.0] * 5]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, miss=1e-6).collect()}
    want = brute_vectors(rows)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert found >= 0.99 * there and all(got[i][0] <= want[i][0] for i in want)
    if found == there:
        assert got == want


def test_vectors_of_the_test_data(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == brute_vectors([(r.vec_id, r.embedding) for r in df.collect()])


def test_vector_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (None, [1.0, 0.0], 3), (2, [2.0, 0.0], 4), (3, [1e300, 1e300], 5), (4, [1e-300, 1e-300], 6)], "vec_id long, embedding array<double>, label int")
    df = df.withColumns({c: F.lit(0) for c in ("id", "vec", "cls", "n_links", "component_id", "key")})
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, True), (2, 2, 1, False), (3, 1, 3, True), (4, 1, 3, False)], key=str)
    assert embedding_dedup.near_duplicates(df.where("false")).collect() == []


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_codes_are_balanced_and_the_index_follows_the_input():
    rng = np.random.default_rng(0)
    x = unit(rng.normal(size=(3000, 32)) + 0.3)
    q = embedding_dedup.learn(x, 10**7, 0.95, 0.002)
    assert q.bits(x).mean(0) == pytest.approx(np.full(embedding_dedup.CODE, 0.5), abs=0.01)
    size = [np.unpackbits(embedding_dedup.learn(x, n, 0.95, 0.002).masks[:1].view(np.uint8)).sum() for n in (10**2, 10**5, 10**7, 10**9)]
    assert size == sorted(size) and size[0] == 0 and size[-1] >= 15
    # Planted pairs that the model has not seen meet in some table and pass the radius.
    fresh = unit(rng.normal(size=(2000, 32)) + 0.3)
    a, b = q.codes(fresh), q.codes(embedding_dedup.planted(fresh, 0.95, seed=9))
    meet = (q.keys(a) == q.keys(b)).any(1) & (np.bitwise_count(a ^ b).sum(1) <= q.radius)
    assert meet.mean() > 0.99


def test_a_large_index_finds_what_one_bucket_finds(spark, monkeypatch):
    """Tables and blocks forced on a small input, against all pairs."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "_DEAL", 1.0)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 32))
    x = np.concatenate([x, x[:200] + 0.1 * rng.normal(size=(200, 32)), x[:1] + 0.08 * rng.normal(size=(120, 32))])
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    want = {i: n for i, (n, _) in brute_vectors(rows).items()}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.99 * sum(want.values()) > 100


def test_vectors_of_a_skewed_table(spark):
    """A third of the rows in one cone, where pairs that do not link have cosines of about 0.9."""
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    axis = unit(rng.normal(size=64))

    def across(x):
        u = rng.normal(size=x.shape)
        return unit(u - (u * x).sum(1, keepdims=True) * x)

    cone = np.sqrt(0.9) * axis + np.sqrt(0.1) * across(np.tile(axis, (500, 1)))
    t = rng.uniform(0.95, 0.96, size=(500, 1))
    x = np.concatenate([cone, t * cone + np.sqrt(1 - t * t) * across(cone), unit(rng.normal(size=(2000, 64)))])
    want = int(np.sum(x @ x.T >= 0.95)) - len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    assert 0.985 * want <= got <= want


@pytest.mark.parametrize("n_ids", [0, 5, 9000])
def test_filter_lets_through_all_ids_and_few_others(spark, n_ids):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    ids = spark.range(n_ids).select((F.col("id") * 2).alias("id"))
    got = {r.id for r in minhash_dedup._packed_texts(docs, "doc_id", "text", ids, None).select("id").collect()}
    wanted = {2 * k for k in range(n_ids)}
    assert wanted <= got
    assert len(got - wanted) <= 0.05 * (20000 - n_ids)
