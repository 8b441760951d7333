"""The pipeline: each stage against a plain version of its decision, on its own input."""

import pytest
from pyspark.sql import functions as F
from test_dedup import brute
from test_text import base_spans, draw, hit_words, poisson

import corpus_pipeline as p
from ratestep.runtime import Scratch


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, scratch, out = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark, "t"), []
    extra = spark.createDataFrame([(9001, "1234 !!", "en", "src0", 7), (9002, None, "en", "src0", 0), (9003, "token = 'abcdef0123456789abcd' " * 2, "en", "src1", 62)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.orderBy("doc_id").limit(1))
    for _, stage in p.STAGES:
        after = scratch.cut(stage(spark, docs, sf))
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for before, after in stages[:-1]:
        assert before.columns == after.columns


def test_language_stage_drops_what_has_no_letters_and_little_else(stages):
    before, after = stages[0]
    gone = set(rows(before)) - set(rows(after))
    assert {9001, 9002} <= gone and len(gone) <= 5


def test_near_duplicates_stage_keeps_one_of_each_group(stages):
    before, after = stages[1]
    want = {i for i, (_, c) in brute([(r.doc_id, r.text) for r in rows(before).values()]).items() if c == i}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)


def test_decontamination_stage(spark, sf, stages):
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = set(rows(after))
    for i, r in rows(before).items():
        words, hit, _ = hit_words(r.text, items)
        assert (i in kept) == (not (hit and 20 * len(hit) >= len(words)))


def test_secret_stage_leaves_no_base_pattern_and_loses_no_document(stages):
    before, after = stages[3]
    a, b = rows(before), rows(after)
    assert set(a) == set(b)
    for i, r in b.items():
        assert not base_spans(r.text) and r.n_chars == (len(r.text) if r.text != a[i].text else a[i].n_chars)
        if not base_spans(a[i].text) and "[SECRET]" not in r.text:
            assert r.text == a[i].text


def test_mixing_stage(stages):
    before, after = stages[4]
    by = {}
    for r in rows(before).values():
        by.setdefault(r.source, []).append(r)
    size = {s: sum(len(r.text) for r in v) for s, v in by.items()}
    total, w = sum(size.values()), {s: n**0.5 for s, n in size.items()}
    got = {r.doc_id: r["n"] for r in after.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for s, v in by.items():
        rate = total * w[s] / sum(w.values()) / size[s]
        for r in v:
            assert got.get(r.doc_id, 0) == poisson(draw("mix", r.doc_id), rate)


def test_run(spark, sf):
    out = p.run(spark, sf)
    assert out.count() > 0 and "mix_order" in out.columns and p.ORACLE_SQL is None


def test_columns_of_clashing_names_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = ("lang_pred", "score", "ambiguous", "text_hash", "row_order", "stands", "component_id", "n_words", "items", "contaminated", "found", "base", "row")
    wide = Scratch(spark, "t").cut(docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id")) for c in names}))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns
        for r in out.collect():
            assert all(r[c] == f"{c} {r.doc_id}" for c in names), name
        assert stage(spark, wide.where("false"), sf).collect() == []
    assert p.STAGES[-1][1](spark, wide.where("false"), sf).collect() == []


def test_texts_under_one_id_are_documents_of_their_own(spark, sf):
    words = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, words("a"), "x"), (1, words("b"), "y"), (1, words("b"), "x"), (2, words("a") + " z", "x"), (None, words("a"), "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    got = p.distinct_documents(spark, df, sf).collect()
    assert sorted(map(str, got)) == sorted(map(str, [df.collect()[k] for k in (0, 2, 4, 5)]))
