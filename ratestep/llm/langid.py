"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language has a codeword; a logistic classifier for each bit sees the text as an L2-normalised bag of hashed
n-grams (square roots of counts). Decoding adds the bits' logistic losses against each codeword, each weighted by the bit's
training accuracy, and takes the nearest codeword; a small lead over the second flags the row as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestep.llm.textbytes import CHUNK, chunks, columns
from ratestep.runtime import Scratch, bounded_batches, ensure_importable

BUCKETS = 1 << 13
UNKNOWN = "und"
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_SALT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def has_letter(raw: bytes) -> bool:
    """Whether a text has a letter of any script."""
    folded = raw.translate(_FOLD.tobytes())
    if folded.translate(None, bytes(range(33)) + bytes(range(128, 256))):
        return True
    return any(map(str.isalpha, raw.decode("utf-8", "replace"))) if folded.strip() else False


def _counts(data: np.ndarray, off: np.ndarray, begins: int | None = None) -> np.ndarray:
    """(rows, BUCKETS) counts of n-grams; of a part of a text, only of those among its first ``begins`` bytes."""
    base, rows = off[0], len(off) - 1
    b = _FOLD[data[base : off[-1]]].astype(np.uint32)
    out = np.zeros(rows * BUCKETS, dtype=np.float64)
    row = np.repeat(np.arange(rows, dtype=np.int64) * BUCKETS, np.diff(off))
    gram = b
    for n in (1, 2, 3):
        if n > 1:
            gram = gram[:-1] | b[n - 1 :] << np.uint32(8 * (n - 1))
        if not len(gram):
            break
        same = row[: len(gram)] == row[n - 1 : n - 1 + len(gram)]
        # A gram of spaces only says nothing.
        same &= (b[: len(gram)] != 32) | (b[n - 1 : n - 1 + len(gram)] != 32)
        if begins is not None:
            same[begins:] = False
        with np.errstate(over="ignore"):
            h = (gram * _SALT[n - 1]) >> np.uint32(32 - 13)
        out += np.bincount(row[: len(gram)][same] + h[same], minlength=len(out))
    return out.reshape(rows, BUCKETS)


def bags(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, BUCKETS) of normalised n-gram counts; rows follow each other in ``data``. A long text is read in parts."""
    if len(off) == 2 and off[1] - off[0] > CHUNK:
        out = sum(_counts(data, np.array([k, min(k + CHUNK + 2, off[1])]), CHUNK) for k in range(off[0], off[1], CHUNK))
    else:
        out = _counts(data, off)
    x = np.sqrt(out).astype(np.float32)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def codewords(k: int) -> np.ndarray:
    """(k, bits) of +-1: every split of the languages up to 7 of them, beyond that rows of a random code, drawn until all are apart.

    A row is drawn anew while it is nearer than a quarter of the bits to one before it, so that no two rows are alike for any k.
    """
    if k <= 1:
        return np.ones((k, 1), dtype=np.float32)
    if k <= 7:
        splits = [s for s in itertools.product((1, -1), repeat=k - 1) if -1 in s]
        return np.array([(1, *s) for s in splits], dtype=np.float32).T
    rng = np.random.default_rng(k)
    bits = int(np.ceil(10 * np.log2(k)))
    while True:
        out = np.empty((k, bits), dtype=np.float32)
        for i in range(k):
            out[i] = rng.choice(np.array([-1, 1], dtype=np.float32), size=bits)
            while i and (out[:i] != out[i]).sum(1).min() < bits / 4:
                out[i] = rng.choice(np.array([-1, 1], dtype=np.float32), size=bits)
        if (out != out[0]).any(0).all():
            return out


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of exp(-loss), and the lead over the second as a share of the possible loss."""
        f = x @ self.weight + self.bias
        loss = np.stack([(np.logaddexp(0, -f * c) * self.trust).sum(1) for c in self.code], axis=1)
        if len(self.languages) == 1:
            return np.zeros(len(x), dtype=int), np.ones(len(x)), np.ones(len(x))
        order = np.argsort(loss, axis=1, kind="stable")
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        first, second = (np.take_along_axis(loss, order[:, k : k + 1], 1)[:, 0] for k in (0, 1))
        return order[:, 0], 1 / p.sum(1), (second - first) / self.trust.sum()


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 120, decay: float = 1e-4) -> Model:
    """Logistic regressions of all bits at once by Adam on the whole sample; languages weigh alike."""
    code = codewords(len(languages))
    target = code[y]
    share = (1.0 / np.bincount(y, minlength=len(languages)).clip(1))[y]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        f = x @ w + b
        g = -target * share / (1 + np.exp(np.clip(target * f, -50, 50)))
        gw, gb = x.T @ g + decay * w, g.sum(0)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.2 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        b -= rate * mb / (np.sqrt(vb) + 1e-8)
    right = ((x @ w + b > 0) == (target > 0)).mean(0)
    return Model(languages, code, w, b, np.maximum(2 * right - 1, 0.05).astype(np.float32))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, max_bytes: int) -> DataFrame:
    """About ``per_language`` rows of each language, by a hash of the id.

    The counts of languages stay a table, written so that Spark knows its size: it is broadcast if it is small, whatever labels there are.
    """
    known = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0) & (F.octet_length(text_col) <= max_bytes))
    own = known.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    share = F.least(F.lit(1.0), per_language / F.col("n"))
    limit = Scratch(docs.sparkSession, "languages").cut(own.groupBy("l").agg(F.count(F.lit(1)).alias("n")).select("l", (share * (1 << 30)).cast("long").alias("limit")), "limit")
    return own.join(limit, "l").where(F.pmod("h", F.lit(1 << 30)) < F.col("limit")).select(F.col("t").alias(text_col), F.col("l").alias(lang_col))


def train(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 5, per_language: int = 400, max_bytes: int = 1 << 16
) -> Model | None:
    """A model from rows with a language whose crc32(id as text) mod ``held_out`` is not 0; None if there are none.

    The sample is bounded: about ``per_language`` whole texts of each language, of ``max_bytes`` at most each.
    """
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % held_out != 0
    bounded_batches(docs.sparkSession)
    rows = sample(docs.where(rest), id_col, text_col, lang_col, per_language, max_bytes).toArrow().to_batches()
    x, langs = [], []
    for batch in rows:
        data, off, _ = columns(batch, text_col)
        keep = []
        for i in range(0, batch.num_rows, 128):
            x.append(bags(data, off[i : i + 129]))
        keep = [has_letter(data[off[k] : off[k + 1]].tobytes()) for k in range(batch.num_rows)]
        langs += [v if ok else None for v, ok in zip(batch.column(lang_col).to_pylist(), keep, strict=True)]
    use = np.array([v is not None for v in langs], dtype=bool)
    if not use.any():
        return None
    names = sorted({v for v in langs if v is not None})
    return fit(np.concatenate(x)[use], np.array([names.index(v) for v in langs if v is not None]), names)


def identify(
    docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", held_out: int = 5, least_lead: float = 0.02, keep: list[str] | None = None
) -> DataFrame:
    """``keep`` (the id by default), held_out, lang_pred, score and ambiguous for each row.

    A null text and one without a letter of any script is "und" with score 0, as is every row without a
    model. Rows that repeat get equal predictions. Names in ``keep`` that clash with the added ones are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(model)
    added = ["held_out", "lang_pred", "score", "ambiguous"]
    kept = [c for c in (keep or [id_col]) if c not in added]
    text = text_col if text_col in kept else "_".join(["text", *kept])  # a name that none of them has
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % held_out == 0, F.lit(False))
    wide = docs.select(*kept, held.alias("held_out"), *([] if text in kept else [F.col(text_col).alias(text)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off, valid = columns(batch, text)
            n = batch.num_rows
            best, score, lead = np.full(n, -1), np.zeros(n), np.zeros(n)
            lettered = np.array([bool(valid[k]) and has_letter(data[off[k] : off[k + 1]].tobytes()) for k in range(n)], dtype=bool)
            if m is not None:
                for lo, hi in chunks(off, CHUNK):
                    for i in range(lo, hi, 128):
                        j = min(i + 128, hi)
                        best[i:j], score[i:j], lead[i:j] = m.decode(bags(data, off[i : j + 1]))
            known = lettered & (best >= 0)
            pred = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
            cols = [batch.column(c) for c in (*kept, "held_out")]
            cols += [pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(~known | (lead < least_lead))]
            yield pa.RecordBatch.from_arrays(cols, [*kept, *added])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return wide.mapInArrow(run, ", ".join([*(f"`{c}` {fields[c]}" for c in kept), "held_out boolean, lang_pred string, score double, ambiguous boolean"]))
