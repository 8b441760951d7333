"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams (3 to 5 bytes, word ends marked) and of its whole form;
a window's vector is the mean over its 24 places (repeated words and missing ones count as zero); a linear softmax gives the window's class. As all that is linear, scoring
needs one number a bucket: the vector times the softmax weights. A document has the score of its most toxic
window, calibrated on the training documents, so a long text is not diluted and is still read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratestep.llm.textbytes import U64, chunks, columns, slices, span_hashes, word_spans
from ratestep.runtime import Scratch, bounded_batches, ensure_importable

BITS = 17
WINDOW = 24
_KEEP = np.full(256, 32, dtype=np.uint8)
_KEEP[48:58] = np.arange(48, 58)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
_ISSEP = np.arange(256) == 32
_ENDS = _KEEP == 32
_MULT = {3: U64(0x9E3779B97F4A7C15), 4: U64(0xC2B2AE3D27D4EB4F), 5: U64(0x165667B19E3779F9)}


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word of bucket, row of word, 64-bit hash of word) over consecutive rows."""
    base = off[0]
    raw = _KEEP[data[base : off[-1]]]
    # A space before every row, so that words end at row ends.
    shift = np.arange(len(off) - 1)
    text = np.full(len(raw) + len(off), 32, dtype=np.uint8)
    starts = off[:-1] - base + shift
    place = np.ones(len(text), dtype=bool)
    place[starts] = False
    place[-1] = False
    text[place] = raw
    b, e, row = word_spans(text, starts, _ISSEP)
    hashes = span_hashes(text, b, e)
    ids, words = [(hashes >> U64(64 - BITS)).astype(np.int32)], [np.arange(len(b), dtype=np.int32)]
    inside = text != 32
    word_at = (np.cumsum(np.bincount(b, minlength=len(text))[: len(text)]) - 1).astype(np.int32)
    wide = text.astype(U64)
    gram = wide
    for n in range(2, 6):
        gram = gram[:-1] | wide[n - 1 :] << U64(8 * (n - 1))
        if n < 3 or not len(gram):
            continue
        ok = inside[1 : 1 + len(gram)].copy()
        for k in range(2, n - 1):
            ok &= inside[k : k + len(gram)]
        at = np.flatnonzero(ok)
        with np.errstate(over="ignore"):
            ids.append(((gram[at] * _MULT[n]) >> U64(64 - BITS)).astype(np.int32))
        words.append(word_at[at + 1])
    return np.concatenate(ids), np.concatenate(words), row, hashes


def fresh(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words whose form did not occur among the WINDOW - 1 words before them in their row: repetition adds nothing."""
    order = np.argsort(hashes, kind="stable")
    same = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1]) & (np.diff(order) < WINDOW)
    out = np.ones(len(hashes), dtype=bool)
    out[order[1:][same]] = False
    return out


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slope: float
    length: float
    shift: float

    def logits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest window logit of each row, and the log of its number of windows; rows without words count as an empty window."""
        out, windows = np.full(len(off) - 1, self.bias), np.zeros(len(off) - 1)
        for i, j in chunks(off):
            # A long text of its own is read in parts, so that only its words are held at once.
            parts = [(off[i : j + 1], None)] if j > i + 1 else [(np.array(x), 0) for x in slices(data, off[i], off[j], _ENDS)]
            read = []
            for cut, only in parts:
                ids, words, row, hashes = features(data, cut)
                score = np.bincount(words, weights=self.table[ids], minlength=len(row)) / np.maximum(np.bincount(words, minlength=len(row)), 1)
                read.append((score, row if only is None else np.zeros(len(row), dtype=np.int64), hashes))
            score, row, hashes = (np.concatenate(x) for x in zip(*read, strict=True)) if read else [np.zeros(0)] * 3
            if not len(row):
                continue
            first = np.searchsorted(row, np.arange(j - i))
            # Windows of WINDOW words that overlap by half; a text's last one ends with the text.
            sums = np.r_[0.0, np.cumsum(score * fresh(hashes, row))]
            count = np.bincount(row, minlength=j - i)
            for r in np.flatnonzero(count):
                lo, n = first[r], count[r]
                w = min(WINDOW, n)
                at = lo + np.r_[np.arange(0, n - w, WINDOW // 2), n - w]
                out[i + r] = self.bias + (sums[at + w] - sums[at]).max() / WINDOW
                windows[i + r] = np.log(len(at))
        return out, windows

    def probability(self, logit: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """The largest of many logits is large by chance: the calibration takes their number into account."""
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.length * windows + self.shift, -50, 50)))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of runs of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def fit(texts: list[bytes], labels: np.ndarray, *, dim: int = 4, steps: int = 90, rate: float = 0.3, least_seen: int = 3, floor: float = 0.03, seed: int = 1) -> Model:
    """Joint training of bucket vectors and softmax weights by Adam over all windows of all texts given."""
    rng = np.random.default_rng(seed)
    off = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    window_words, window_doc = [], []
    forms: dict[int, int] = {}
    feats: list[np.ndarray] = []
    for i, j in chunks(off, 1 << 20):
        ids, words, row, hashes = features(data, off[i : j + 1])
        uniq, where, inv = np.unique(hashes, return_index=True, return_inverse=True)
        order = np.argsort(words, kind="stable")
        cut = np.searchsorted(words[order], np.arange(len(hashes) + 1))
        local = np.empty(len(uniq), dtype=np.int64)
        for u, (h, k) in enumerate(zip(uniq.tolist(), where.tolist(), strict=True)):
            if h not in forms:
                forms[h] = len(forms)
                feats.append(ids[order[cut[k] : cut[k + 1]]])
            local[u] = forms[h]
        word_ids = local[inv]
        new = fresh(hashes, row)
        first = np.searchsorted(row, np.arange(j - i + 1))
        for r in range(j - i):
            lo, hi = first[r], first[r + 1]
            for at in range(lo, hi, WINDOW):
                end = min(at + WINDOW, hi)
                if (w := word_ids[at:end][new[at:end]]).size:
                    window_words.append(w)
                    window_doc.append(i + r)
    if not window_words:
        return Model(np.zeros(1 << BITS, dtype=np.float32), -5.0, 1.0, 0.0, 0.0)
    doc = np.array(window_doc)
    sizes = np.array([len(w) for w in window_words])
    flat, win = np.concatenate(window_words), np.repeat(np.arange(len(sizes)), sizes)
    fsize = np.array([len(f) for f in feats])
    bucket, form = np.concatenate(feats), np.repeat(np.arange(len(feats), dtype=np.int32), fsize)
    used, slot = np.unique(bucket, return_inverse=True)
    slot = slot.astype(np.int32)
    # A bucket that few documents have says nothing of its class: its vector stays zero.
    f_cut, w_cut = np.r_[0, np.cumsum(fsize)[:-1]], np.r_[0, np.cumsum(sizes)[:-1]]
    known = np.unique(doc[win] * len(feats) + flat)
    of_doc = np.searchsorted(known, np.arange(len(labels) + 1) * len(feats))
    seen = np.zeros(len(used), dtype=np.int32)
    for d in np.flatnonzero(np.diff(of_doc)):
        f = known[of_doc[d] : of_doc[d + 1]] - d * len(feats)
        seen[np.unique(slot[np.repeat(f_cut[f], fsize[f]) + _within(fsize[f])])] += 1
    common = (seen >= least_seen).astype(np.float32)[:, None]
    y = labels[doc].astype(np.float64)
    e = rng.normal(0, 0.05, (len(used), dim)).astype(np.float32) * common
    w = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    c = np.zeros(2, dtype=np.float32)
    both = [np.zeros_like(x) for x in (e, w, c, e, w, c)]
    target = np.stack([1 - y, y], axis=1)
    active = np.ones(len(y))

    def spreader(target_of: np.ndarray, source_of: np.ndarray):
        """Sums of rows of a source over their targets; every target has one at least."""
        order = np.argsort(target_of, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(target_of[order]) > 0])
        source = source_of[order].astype(np.int32)
        return lambda values: np.add.reduceat(np.take(values, source, axis=0), first, axis=0)

    to_forms, to_buckets = spreader(flat, win), spreader(slot, form)
    f_inv = (1 / fsize).astype(np.float32)[:, None]
    for t in range(1, steps + 1):
        word = np.add.reduceat(np.take(e, slot, axis=0), f_cut, axis=0) * f_inv
        vec = np.add.reduceat(np.take(word, flat, axis=0), w_cut, axis=0) / np.float32(WINDOW)
        z = vec @ w + c
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        if t in (steps // 3, steps // 2, 3 * steps // 4):
            # A toxic document has clean windows too: go on with its most toxic one and those that look toxic.
            top = np.full(len(labels), -1.0)
            np.maximum.at(top, doc, p[:, 1])
            active = np.where(y == 0, 1.0, (p[:, 1] >= 0.5) | (p[:, 1] >= top[doc]))
        on, off_ = active * y, active * (1 - y)
        share = (0.5 * on / max(1, on.sum()) + 0.5 * off_ / max(1, off_.sum()))[:, None]
        g = ((p - target) * share).astype(np.float32)
        gw, gc = vec.T @ g + 1e-5 * w, g.sum(0)
        gvec = ((g @ w.T) / np.float32(WINDOW)).astype(np.float32)
        gword = to_forms(gvec) * f_inv
        ge = to_buckets(gword) * common
        for k, (x, gx) in enumerate(((e, ge), (w, gw), (c, gc))):
            both[k] = 0.9 * both[k] + 0.1 * gx
            both[k + 3] = 0.98 * both[k + 3] + 0.02 * gx * gx
            scale = np.sqrt(both[k + 3])
            # Rare buckets have small gradients: a floor keeps their steps small.
            x -= rate * np.sqrt(1 - 0.98**t) / (1 - 0.9**t) * both[k] / (scale + floor * scale.max() + 1e-12)
    table = np.zeros(1 << BITS, dtype=np.float32)
    table[used] = e @ (w[:, 1] - w[:, 0])
    model = Model(table, float(c[1] - c[0]), 1.0, 0.0, 0.0)
    return calibrated(model, *model.logits(data, off), labels)


def calibrated(model: Model, logit: np.ndarray, windows: np.ndarray, y: np.ndarray, steps: int = 60) -> Model:
    """A logistic curve from document logits and lengths to labels, by damped Newton steps; more windows never make a text more toxic."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    scale = max(1e-6, float(np.std(logit)))
    full = np.stack([logit / scale, windows, np.ones(len(logit))], axis=1)
    for use in ([0, 1, 2], [0, 2]):
        x, a = full[:, use], np.zeros(len(use))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(use))
            step = np.linalg.solve(h, x.T @ (t - p) - 1e-3 * a)
            a = a + step * min(1.0, 3 / max(1e-9, float(np.abs(step).max())))
        if len(use) == 2 or a[1] <= 0:
            break
    model.slope, model.length, model.shift = float(max(a[0], 1e-6) / scale), float(a[1]) if len(use) == 3 else 0.0, float(a[-1])
    return model


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 1, folds: int = 3, per_class: int = 1500, max_bytes: int = 1 << 16,
    max_total: int = 10_000_000,
) -> Model | None:
    """A model from labelled rows outside the held-out fold; None without any.

    The sample is bounded: about ``per_class`` texts of each class, by a hash of the id, of ``max_bytes`` at most each and, of both classes together,
    about ``max_total`` bytes: fewer texts where they are long, each of them whole. Labels that repeat count once, the largest; null labels are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    bounded_batches(spark)
    known = labels.where(F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != fold))
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y"))
    there = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    if not there:
        return None
    share = F.when(F.col("__y") == 1, F.lit(int(min(1.0, per_class / there.get(1, 1)) * (1 << 30)))).otherwise(F.lit(int(min(1.0, per_class / max(1, there.get(0, 1))) * (1 << 30))))
    # Of the order of per_class * 2 rows: written, so that Spark knows its size.
    chosen = scratch.cut(known.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < share), "sample")
    texts = docs.where((F.octet_length(text_col) > 0) & (F.octet_length(text_col) <= max_bytes)).select(id_col, F.col(text_col).alias("__t"))
    drawn = scratch.cut(texts.join(chosen, id_col).select(id_col, "__t", "__y"), "texts")
    # At most about 2 * per_class rows, so that one task may add up their sizes.
    so_far = F.sum(F.octet_length("__t")).over(Window.partitionBy("__y").orderBy(F.xxhash64(F.col(id_col)), id_col))
    rows = drawn.withColumn("__s", so_far).where(F.col("__s") <= max_total // len(there)).select(id_col, "__t", "__y").toArrow().sort_by(id_col)
    scratch.drop(chosen, drawn)
    if not rows.num_rows:
        return None
    return fit([x.encode() for x in rows.column("__t").to_pylist()], np.array(rows.column("__y").to_pylist(), dtype=np.int64))


def score(
    docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", fold: int = 1, folds: int = 3, least: float = 0.7
) -> DataFrame:
    """(id, held_out, score, predicted) of each row; null and empty texts have the score of an empty window.

    Without a model every score is 0. A null id is not held out. Other columns, of whatever names, are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off, _ = columns(batch, "__t")
            p = m.probability(*m.logits(data, off)) if m is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= least).astype(np.int32))], [id_col, "held_out", "score", "predicted"]
            )

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
    return docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col).alias("__t")).mapInArrow(
        run, f"{id_col} {kind}, held_out boolean, score double, predicted int"
    )
