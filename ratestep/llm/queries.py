"""The queries of this subpackage over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratestep.llm import chat, decontaminate, embedding_dedup, html_extract, langid, minhash_dedup, mixing, secrets, toxicity, warc
from ratestep.runtime import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc").path("archives")
    written = warc.write_warc(_table(spark, sf_dir, "pages"), folder)
    return warc.page_records(warc.read_warc(spark, *written))


#: The conversation that every run adds: its texts are the template's own control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], turns.schema)
    return chat.digest(chat.format_trees(chat.linear(turns.unionByName(extra)), unique=True))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.withColumn("mix_rate", F.round("mix_rate", 6))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    table = secrets.train(secrets.generated_samples(docs))
    return secrets.report(secrets.find_secrets(docs, table))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash", "stands")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that no model decides."""
    return secrets.report(secrets.find_secrets(_table(spark, sf_dir, "documents"), [0.0] * 67 * 67)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def toxicity_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column of op3 that no model decides."""
    return toxicity.score(_table(spark, sf_dir, "documents"), None).select("doc_id", "held_out")


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that no model decides: the fold, and whether a text has no letter (a model of one language gives it to all others)."""
    one = langid.Model(["any"], langid.codewords(1), np.zeros((langid.BUCKETS, 1), dtype=np.float32), np.zeros(1, dtype=np.float32), np.ones(1, dtype=np.float32))
    out = langid.identify(_table(spark, sf_dir, "documents"), one)
    return out.select("doc_id", "held_out", (F.col("lang_pred") == langid.UNKNOWN).alias("und"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_chat": op2_chat,
    "op3_toxicity": op3_toxicity,
    "op4_language": op4_language,
    "op5_mixing": op5_mixing,
    "op6_secrets": op6_secrets,
    "op7_decontamination": op7_decontamination,
    "op8_html": op8_html,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_minhash_dedup": op10_minhash_dedup,
    "secret_base_spans": secret_base_spans,
    "toxicity_folds": toxicity_folds,
    "language_folds": language_folds,
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS7 = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORDS10 = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+')"
_SYMBOL = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * {k} + 1, 5))::BIGINT >> {s}) & 31), 1)"
_BASE32 = " || ".join(_SYMBOL.format(k=k, s=s) for k in range(8) for s in (15, 10, 5, 0))

_BITS = "list_reduce([{0}, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))"
_CRC32 = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda acc, b: {_BITS.format('xor(acc, b)')}))"


def _base_spans(name: str, kind: int, pattern: str, group: int, least: int) -> str:
    """Rows (doc_id, kind, s, e): the pieces between matches and the matches alternate."""
    return f"""
        {name}_m AS (SELECT doc_id, list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) AS found, list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x)) AS part,
            list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) AS gap FROM d WHERE regexp_matches(t, '{pattern}')),
        {name} AS (SELECT doc_id, {kind} AS kind, list_sum(gap[1:i]) + coalesce(list_sum(found[1:i - 1]), 0) AS s, list_sum(gap[1:i]) + list_sum(found[1:i]) AS e
            FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM {name}_m) WHERE part[i] >= {least})"""


_ASSIGN = """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

ORACLE: dict[str, str] = {
    "toxicity_folds": f"SELECT doc_id, coalesce({_CRC32} % 3 = 1, false) AS held_out FROM documents",
    "language_folds": f"SELECT doc_id, coalesce({_CRC32} % 5 = 0, false) AS held_out, NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS und FROM documents",
    "secret_base_spans": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{_base_spans("a", 0, _ASSIGN, 1, 12)},{_base_spans("b", 1, "AKIA[A-Z0-9]+", 0, 18)},{_base_spans("c", 2, "[0-9a-f]+", 0, 16)},
        every AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
        named AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
            string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind) AS spans FROM every GROUP BY 1)
        SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN named USING (doc_id)""",
    "op1_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        q AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first_id FROM p)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM q""",
    "op2_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
        e AS (
            SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS safe,
                replace(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(13), '\r'), chr(10), '\n') AS safe_role
            FROM c)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length('<|im_start|>' || safe_role || chr(10) || safe || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op5_mixing": """
        WITH RECURSIVE s AS (SELECT coalesce(source, '') AS k, sum(length(coalesce(text, '')))::DOUBLE AS n FROM documents GROUP BY 1),
        w AS (SELECT k, n, sqrt(n) AS w FROM s),
        r AS (SELECT k, (SELECT sum(n) FROM w) * w / (SELECT sum(w) FROM w) / n AS rate FROM w WHERE n > 0),
        c AS (
            SELECT k, rate, 0 AS i, exp(-rate) AS p, exp(-rate) AS cdf FROM r
            UNION ALL
            SELECT k, rate, i + 1, p * rate / (i + 1), cdf + p * rate / (i + 1) FROM c WHERE i < 150),
        d AS (SELECT *, ('0x' || substr(md5('mix:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
        n AS (
            SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, round(c.rate, 6) AS mix_rate, count(*)::INTEGER AS mix_copies
            FROM d JOIN c ON coalesce(d.source, '') = c.k AND c.cdf <= d.u GROUP BY ALL)
        SELECT *, md5('mix-order:' || doc_id || ':' || mix_copy) AS mix_order
        FROM (SELECT *, unnest(range(1, mix_copies + 1))::INTEGER AS mix_copy FROM n)""",
    "op7_decontamination": f"""
        WITH b AS (SELECT item_id, {_WORDS7} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) END) AS s,
                least(len(w), 13) AS size
            FROM b),
        sizes AS (SELECT DISTINCT size FROM win),
        d AS (SELECT doc_id, {_WORDS7} AS w FROM documents),
        placed AS (
            SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i,
                unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS s
            FROM d, sizes WHERE len(w) >= size),
        hit AS (SELECT placed.doc_id, placed.i, placed.size, win.item_id FROM placed JOIN win USING (s, size)),
        words AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY 1),
        items AS (
            SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
            FROM hit GROUP BY 1)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_embedding_dedup": """
        WITH RECURSIVE d AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        v AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM d WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
        reach AS (SELECT a AS vec_id, a AS r FROM (SELECT DISTINCT a FROM link) UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.r),
        comp AS (SELECT vec_id, min(r) AS c FROM reach GROUP BY 1),
        n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1)
        SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c, d.vec_id) AS component_id, coalesce(c, d.vec_id) = d.vec_id AS kept
        FROM d LEFT JOIN n USING (vec_id) LEFT JOIN comp USING (vec_id)""",
    "op10_minhash_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS10} AS w FROM documents),
        sh AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
            FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reach AS (SELECT a AS doc_id, a AS r FROM (SELECT DISTINCT a FROM link) UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r),
        comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
