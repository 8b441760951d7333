"""A corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, mixing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the documents that go on, with the columns
of ``documents``; the last one returns copies with their place in the mixture. ``run`` writes each stage's result as Parquet
in the shared folder and reads it again for the next one. Empty tables go through every stage; columns of any names, those that a
stage uses itself included, come out of all stages but the last as they went in; the last one replaces columns of its own names.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratestep.llm import decontaminate, langid, minhash_dedup, mixing, secrets
from ratestep.runtime import Scratch


def own_columns(*used: str):
    """A stage that adds columns of the names ``used``: those of its caller step aside under other names and come back after it."""

    def wrap(stage):
        @functools.wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            aside = {c: f"{c}_{uuid.uuid4().hex}" for c in docs.columns if c in used}
            out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
            return out.withColumnsRenamed({v: k for k, v in aside.items()})

        return run

    return wrap


@own_columns("held_out", "lang_pred", "score", "ambiguous")
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter and those between two languages go."""
    out = langid.identify(docs, langid.train(docs), keep=docs.columns)
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select(*docs.columns)


@own_columns("text_hash", "row_order")
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    A row is known by its id and its text, so that different texts under one id are different documents. Of rows that repeat both, the first
    by their other columns stays. Rows without an id stay.
    """
    stand = minhash_dedup.near_duplicates(docs).where("stands").select("doc_id", "text_hash")
    known = stand.where(F.col("doc_id").isNotNull())
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    out = hashed.join(known, ["doc_id", "text_hash"], "left_semi")
    if not known.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        order = F.to_json(F.struct(*(F.col(c) for c in docs.columns if c not in ("doc_id", "text"))))
        first = Window.partitionBy("doc_id", "text_hash").orderBy("row_order")
        out = out.withColumn("row_order", order).withColumn("row_order", F.row_number().over(first)).where("row_order = 1")
    return out.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


@own_columns("n_words", "n_hit", "n_items", "items_sha256", "spans", "items", "runs", "contaminated")
def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, items, keep=docs.columns).where(~F.col("contaminated")).select(*docs.columns)


@own_columns("found")
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mark."""
    found = secrets.find_secrets(docs, secrets.train(secrets.generated_samples(docs)), keep=docs.columns)
    hit = F.size("found") > 0
    text = secrets.redacted(F.col("text"), F.col("found"))
    out = found.withColumn("text", text).withColumn("n_chars", F.when(hit, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents at the rates that bring the sources to their target shares, in one global order."""
    return mixing.mix(docs)


STAGES = [
    ("language", languages),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_of_benchmarks),
    ("secrets", without_secrets),
    ("mixing", mixture),
]

#: SQL has neither the language model nor the Markov models; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        after = scratch.cut(out, name)
        scratch.drop(docs)
        docs = after
    return docs
