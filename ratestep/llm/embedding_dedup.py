"""Near-duplicate vectors: iterative quantisation to balanced binary codes, multi-index Hamming tables, reranking with the original vectors.

Rotations learnt from a bounded sample (each turns the centred sample towards the corners of the cube) give the planes of a code of
``CODE`` bits, cut at the sample's medians. Every table is keyed by a random subset of the code's bits. How many bits and tables there are is
measured, not assumed: pairs just at the threshold are planted around sample vectors, towards random directions and towards other vectors, and the
cheapest setting whose planted pairs meet often enough is taken, so that skewed and centred tables get more tables, not fewer links.

What is dealt to the tables is the id and the code. Members of a bucket whose codes are near enough bring their vectors, which are compared by cosine
in double precision. Buckets with more than ``BLOCK`` vectors are dealt out as pairs of blocks, so a hot bucket is split over many tasks. A pair
counts in the first table where it meets; what leaves a task are counts and a spanning star, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestep.llm.graph import components
from ratestep.llm.textbytes import U64, mix64
from ratestep.runtime import Scratch, bounded_batches

BLOCK = 1024
CODE = 256
_WORDS = CODE // 64
#: What dealing a row to a table costs, in comparisons of two codes.
_DEAL = 500.0


@dataclass
class Quantiser:
    mean: np.ndarray
    planes: np.ndarray
    cut: np.ndarray
    masks: np.ndarray
    radius: int

    def bits(self, x: np.ndarray) -> np.ndarray:
        """(rows, CODE) sides of the planes; equal directions are on equal sides, whatever their rounding."""
        return (x - self.mean) @ self.planes - self.cut > 1e-9

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, words) of 64 bits each."""
        return np.packbits(self.bits(x), axis=1).view(np.uint64)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket keys."""
        out = np.empty((len(codes), len(self.masks)), dtype=np.int64)
        with np.errstate(over="ignore"):
            for t, mask in enumerate(self.masks):
                h = np.full(len(codes), U64(t + 1))
                for w in range(_WORDS):
                    h = mix64(h * U64(0x9E3779B97F4A7C15) + (codes[:, w] & mask[w]))
                out[:, t] = h.view(np.int64)
        return out


def rotations(x: np.ndarray, planes: int, rounds: int = 25, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, planes and cuts of iterative quantisation from as many random rotations as it takes; ``x`` has unit rows."""
    mean = x.mean(0)
    v = x - mean
    rng, dim, out = np.random.default_rng(seed), x.shape[1], []
    _, _, axes = np.linalg.svd(v, full_matrices=True) if len(v) <= dim else np.linalg.svd(v.T @ v)
    w = v @ axes.T
    while sum(p.shape[1] for p in out) < planes:
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, s = np.linalg.svd(np.sign(w @ r).T @ w)
            r = (u @ s).T
        out.append((axes.T @ r)[:, rng.permutation(dim)])
    found = np.concatenate(out, axis=1)[:, :planes]
    at = np.sort(v @ found, axis=0)
    k = len(at) // 2
    return mean, found, (at[max(0, k - 1)] + at[k]) / 2 if len(at) % 2 == 0 else (at[k] + at[min(k + 1, len(at) - 1)]) / 2


def planted(x: np.ndarray, threshold: float, seed: int = 6) -> np.ndarray:
    """A partner of each row at a cosine of just ``threshold``: half of them off in a random direction, half towards another row."""
    rng = np.random.default_rng(seed)
    u = rng.normal(size=x.shape)
    other = x[rng.permutation(len(x))]
    u[::2] = other[::2]
    u -= (u * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(u, axis=1, keepdims=True)
    ok = size > 1e-6
    return np.where(ok, threshold * x + math.sqrt(1 - threshold**2) * u / np.where(ok, size, 1.0), x)


def learn(x: np.ndarray, rows: int, threshold: float, miss: float, most_bits: int = 40, seed: int = 5) -> Quantiser:
    """Planes, tables and radius for ``rows`` vectors of which ``x`` is a sample (unit rows).

    A pair that agrees on a share a of the code meets in a table of b random bits with probability a**b; the number of tables makes the mean of
    (1 - a**b)**tables over the planted pairs half of ``miss``. Few rows need no bits: one bucket holds all of them.
    """
    q = Quantiser(*rotations(x, CODE, seed=seed), np.zeros((1, _WORDS), dtype=np.uint64), CODE)
    own, near = q.bits(x), q.bits(planted(x, threshold))
    agree = (own == near).mean(1)
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(x), (2, 20_000))
    apart = a != b
    chance = (own[a[apart]] == own[b[apart]]).mean(1) if apart.any() else np.zeros(1)
    best = (_DEAL + rows, 0, 1)
    for bits in range(1, min(most_bits, CODE // 4) + 1):
        p = agree**bits
        lo, hi = 1, 1
        while np.mean((1 - p) ** hi) > miss / 2 and hi < 1 << 20:
            lo, hi = hi, 2 * hi
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if np.mean((1 - p) ** mid) <= miss / 2 else (mid + 1, hi)
        best = min(best, (hi * (_DEAL + rows * float(np.mean(chance**bits))), bits, hi))
    _, bits, tables = best
    if bits:
        masks = np.zeros((tables, CODE), dtype=bool)
        for m in masks:
            m[rng.choice(CODE, bits, replace=False)] = True
        q.masks = np.packbits(masks, axis=1).view(np.uint64)
        far = np.sort((own != near).sum(1))
        q.radius = int(far[min(len(far) - 1, int(np.ceil(len(far) * (1 - miss / 4))))]) + 4
    return q


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(r, dtype=kind) for r in raw]).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(kind: str):
    """Vectors as bytes of their own precision; null where one cannot be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column(1)
            off = np.asarray(a.offsets) if len(a) else np.zeros(1, dtype=np.int64)
            whole = np.asarray(a.values.cast(pa.float64()).fill_null(np.nan)) if len(a.values) else np.zeros(0)
            there, vals = np.asarray(a.is_valid()), []
            for k in range(batch.num_rows):
                x = whole[off[k] : off[k + 1]] if there[k] else whole[:0]
                top = np.abs(x).max() if len(x) else 0.0
                if np.isfinite(top) and top > 0:
                    # Far from one, squares of doubles would overflow or vanish.
                    x = x / top if not 1e-100 < top < 1e100 else x
                    vals.append(np.ascontiguousarray(x + 0.0, dtype=kind).tobytes())
                else:
                    vals.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vals, pa.binary())], ["id", "vec"])

    return run


def _grouped(columns: tuple[str, ...], solve, names: list[str], kinds: list[pa.DataType]):
    """A worker over groups (key, i, j) that arrive sorted; ``solve(head, rows)`` gives a group's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out, size = None, [], [], 0

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "i", "j", *columns)]
            for key, i, j, *rest in zip(*cols, strict=True):
                if (key, i, j) != now:
                    if len(held) > 1:
                        out.append(solve(now, held))
                        size += len(out[-1][0])
                        if size > 50_000:
                            yield pack()
                            out, size = [], 0
                    now, held = (key, i, j), []
                held.append(rest)
        if len(held) > 1:
            out.append(solve(now, held))
        if out:
            yield pack()

    return run


def _first_meeting(codes: np.ndarray, masks: np.ndarray, table: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether pairs agree on the bits of ``table`` and on those of none before it."""
    x = codes[p] ^ codes[q]
    out = ((x & masks[table]) == 0).all(1)
    for m in masks[:table]:
        at = np.flatnonzero(out)
        if not len(at):
            break
        out[at[((x[at] & m) == 0).all(1)]] = False
    return out


def _near(shared):
    """Members of a bucket, or of a pair of its blocks, that have another whose code is near and that they meet here first."""

    def solve(head: tuple, rows: list) -> tuple[np.ndarray, ...]:
        model = shared.value
        ids, side = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=bool)
        codes = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint64).reshape(-1, _WORDS)
        one, two = (np.flatnonzero(~side), np.flatnonzero(side)) if side.any() else (np.arange(len(ids)),) * 2
        apart = np.zeros((len(one), len(two)), dtype=np.uint16)
        for w in range(_WORDS):
            apart += np.bitwise_count(codes[one, w][:, None] ^ codes[two, w][None, :])
        close = apart <= model.radius
        p, q = np.nonzero(close if side.any() else np.triu(close, 1))
        p, q = one[p], two[q]
        first = _first_meeting(codes, model.masks, rows[0][3], p, q)
        hit = np.zeros(len(ids), dtype=bool)
        hit[p[first]] = hit[q[first]] = True
        n = int(hit.sum())
        return (*(np.full(n, h) for h in head), ids[hit], side[hit], np.full(n, rows[0][3]))

    return _grouped(("id", "side", "code", "t"), solve, ["key", "i", "j", "id", "side", "t"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32()])


def _pairs(shared, kind: str, threshold: float):
    """Counts of links and stars of a group."""

    def solve(head: tuple, rows: list) -> tuple[np.ndarray, ...]:
        ids, copies = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        side = np.array([r[2] for r in rows], dtype=bool)
        x = _unit([r[3] for r in rows], kind)
        codes = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint64).reshape(-1, _WORDS)
        if side.any():
            left, right = np.flatnonzero(~side), np.flatnonzero(side)
            p, q = np.nonzero(x[left] @ x[right].T >= threshold)
            p, q = left[p], right[q]
        else:
            p, q = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        label = np.arange(len(ids))
        while len(p):
            was = label.copy()
            np.minimum.at(label, p, label[q])
            np.minimum.at(label, q, label[p])
            label = label[label]
            if (was == label).all():
                break
        first = _first_meeting(codes, shared.value.masks, rows[0][5], p, q)
        p1, q1 = p[first], q[first]
        n = np.bincount(p1, weights=copies[q1], minlength=len(ids)) + np.bincount(q1, weights=copies[p1], minlength=len(ids))
        keep = (n > 0) | (label != np.arange(len(ids)))
        return ids[keep], n[keep].astype(np.int64), ids[label[keep]]

    return _grouped(("id", "copies", "side", "vec", "code", "t"), solve, ["a", "n", "b"], [pa.int64()] * 3)


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, miss: float = 0.002, sample_rows: int = 4096
) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    Links rows with a cosine of ``threshold`` or more. Null and zero vectors, those with null or non-finite
    components, and rows with a null id link with nothing; vectors of different lengths do not link. Copies are one class:
    they link with each other and share all links, and are compared once. Rows that repeat an id are rows of their own that share
    its component. An empty table gives an empty result. The codes are learnt from about ``sample_rows`` vectors of each length, every vector is indexed.
    ``miss`` is the share of planted pairs just at the threshold that may be missed.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "vectors")
    # Floats stay floats on the way; cosines are of doubles.
    kind = "f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "f8"
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col)).mapInArrow(_packed(kind), "id long, vec binary")
    own = scratch.cut(raw.withColumn("cls", F.when(F.col("id").isNotNull(), F.md5("vec"))), "own")
    known = own.where(F.col("cls").isNotNull())
    classes = scratch.cut(known.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")), "classes")
    links, edges = None, None
    for r in classes.groupBy((F.octet_length("vec") / int(kind[1])).cast("int").alias("dim")).count().orderBy("dim").collect():
        found = _linked(classes, kind, r["dim"], r["count"], scratch, threshold, miss, sample_rows)
        counted = found.groupBy("a").agg(F.sum("n").alias("n"))
        star = found.where(F.col("a") != F.col("b")).select("a", "b")
        links = counted if links is None else links.unionByName(counted)
        edges = star if edges is None else edges.unionByName(star)
    if links is None:
        empty = own.where("false")
        links, edges = empty.select(F.col("id").alias("a"), F.lit(0).cast("long").alias("n")), empty.select(F.col("id").alias("a"), F.col("id").alias("b"))
    links = links.groupBy("a").agg(F.sum("n").alias("n"))
    parts = components(scratch, edges)
    by_class = (
        classes.select("cls", F.col("rep"), "copies")
        .join(links.withColumnRenamed("a", "rep"), "rep", "left")
        .join(parts.withColumnRenamed("id", "rep"), "rep", "left")
        .select("cls", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = own.select("id", "cls").join(by_class, "cls", "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _linked(classes: DataFrame, kind: str, dim: int, rows: int, scratch: Scratch, threshold: float, miss: float, sample_rows: int) -> DataFrame:
    spark = classes.sparkSession
    mine = classes.where(F.octet_length("vec") == int(kind[1]) * dim)
    share = int(min(1.0, sample_rows / rows) * (1 << 30))
    drawn = mine.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < share).select("rep", "vec").toArrow().sort_by("rep")
    if not drawn.num_rows:
        drawn = mine.select("rep", "vec").limit(1).toArrow()
    model = spark.sparkContext.broadcast(learn(_unit(drawn.column("vec").to_pylist(), kind), rows, threshold, miss))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = model.value.codes(_unit(batch.column("vec").to_pylist(), kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"), batch.column("vec"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(model.value.keys(codes)), pa.list_(pa.int64()))],
                ["id", "copies", "vec", "code", "keys"],
            )

    coded = scratch.cut(mine.select("rep", "copies", "vec").mapInArrow(code, "id long, copies long, vec binary, code binary, keys array<long>"), "coded")
    sizes = coded.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # Few buckets are so large: written, so that Spark knows their number and broadcasts them.
    large = scratch.cut(sizes.where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large")
    own, other = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.col("other")
    # Side: the rows of block j in the pair (i, j); a block with itself has one side only.
    placed = (
        coded.select("id", "code", F.posexplode("keys").alias("t", "key")).join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", other).alias("i"), F.greatest("own", other).alias("j"), "id", (F.col("own") > other).alias("side"), "code", "t")
    )
    dealt = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = scratch.cut(dealt(placed).mapInArrow(_near(model), "key long, i int, j int, id long, side boolean, t int"), "near")
    full = dealt(near.join(coded.select("id", "copies", "vec", "code"), "id"))
    return scratch.cut(full.mapInArrow(_pairs(model, kind, threshold), "a long, n long, b long"), "linked")
