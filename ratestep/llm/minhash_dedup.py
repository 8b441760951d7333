"""Near-duplicate documents: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Steps: every text becomes the set of its distinct 64-bit shingle hashes (vectorised, in Arrow batches of
bounded size). Documents with equal sets are one class, found with a partial aggregate on a 128-bit sum of
the set; only the smallest document of a class goes on. One pass over its set gives ``bins`` minima; an empty bin takes
the value of the occupied bin that a fixed random order of the bins, its own, names first. ``rows`` bins make one
band, each band one bucket key. In a bucket every document is paired with its hub, the smallest id, so a
bucket of n documents gives n - 1 pairs. Pairs pass a size test (exact) and a sketch test (five standard
deviations of slack), then the full sets are compared. What a star leaves apart is settled by a second pass over the
buckets that still span several components, in pairs of blocks of bounded size: members whose sketch is like that of
a member of another component bring their texts, the full sets of a block are intersected at once, and what leaves a
task are the links that join components there, never all pairs.

A pair at similarity 0.75 shares no bucket with probability (1 - 0.75**4)**32 = 5e-6, less above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestep.llm.graph import components, dealt, hot, repeated
from ratestep.llm.textbytes import LOWER, U64, chunks, columns, mix64, slices, span_hashes, word_spans
from ratestep.runtime import Scratch, bounded_batches

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
BLOCK = 512
#: The filter of the documents that share a bucket has this many bits at most.
FILTER_BITS = 1 << 25
#: Bits of a bitmap of Spark's bitmap_construct_agg.
_BUCKET_BITS = 1 << 15
_STEP = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; ``off`` are byte offsets into ``data``."""
    out: list[np.ndarray] = []
    for i, j in chunks(off):
        # A long text is read in parts, so that only its words' hashes are held at once.
        read = []
        for lo, hi in [(off[i], off[j])] if j > i + 1 else slices(data, off[i], off[j], _SPACE):
            part = LOWER[data[lo:hi]]
            b, e, row = word_spans(part, off[i:j] - off[i] if j > i + 1 else np.zeros(1, dtype=np.int64), _SPACE)
            read.append((span_hashes(part, b, e), row))
        w, row = (np.concatenate(x) for x in zip(*read, strict=True)) if read else (np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64))
        cut = np.searchsorted(row, np.arange(j - i + 1))
        with np.errstate(over="ignore"):
            n = len(w) - width + 1
            if n > 0:
                s = np.zeros(n, dtype=U64)
                for k in range(width):
                    s = (s + w[k : k + n]) * _STEP[k % len(_STEP)]
                s = mix64(s + U64(width))
            for r in range(j - i):
                lo, hi = cut[r], cut[r + 1]
                if hi - lo >= width:
                    out.append(np.unique(s[lo : hi - width + 1]))
                elif hi > lo:
                    x = U64(0)
                    for k in range(lo, hi):
                        x = (x + w[k]) * _STEP[(k - lo) % len(_STEP)]
                    out.append(mix64(np.array([x + U64(hi - lo)], dtype=U64)))
                else:
                    out.append(np.zeros(0, dtype=U64))
    return out


class OneHash:
    """One-permutation signatures; the first ``bands * rows`` of a fixed random order of the bins make the bands."""

    def __init__(self, bands: int, rows: int, bins: int):
        self.bands, self.rows, self.bins = bands, rows, bins
        self.used = np.random.default_rng(bins).permutation(bins)[: bands * rows]
        k = np.arange(self.bins, dtype=U64)
        with np.errstate(over="ignore"):
            self.order = (mix64(k[:, None] * U64(0x9E3779B97F4A7C15) + mix64(k[None, :] + U64(77))) >> U64(40)).astype(np.uint32)
        self.salt = mix64(np.arange(1, self.bands + 1, dtype=U64) << U64(33))
        self.weight = mix64(np.arange(101, 101 + self.rows, dtype=U64)) | U64(1)

    def signature(self, s: np.ndarray) -> np.ndarray:
        """``s`` is sorted, and a bin is a range of hash values: its minimum comes first."""
        where = ((s >> U64(32)) * U64(self.bins) >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        full = where[first]
        sig = np.empty(self.bins, dtype=U64)
        sig[full] = s[first]
        if len(full) < self.bins:
            empty = np.ones(self.bins, dtype=bool)
            empty[full] = False
            empty = np.flatnonzero(empty)
            sig[empty] = sig[full[self.order[np.ix_(empty, full)].argmin(1)]]
        return mix64(sig)

    def keys(self, sig: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((sig[self.used].reshape(self.bands, self.rows) * self.weight).sum(1, dtype=U64) + self.salt).view(np.int64)


def sign(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, bins: int) -> DataFrame:
    """One row a document: id, the hash of its text, n, the 128-bit sum of its set, band keys and an 8-bit sketch of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = OneHash(bands, rows, bins)
        for batch in batches:
            data, off, _ = columns(batch, "text")
            n, f1, f2, keys, sketch = [], [], [], [], []
            for s in shingle_sets(data, off, width):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    f1.append(int(s.sum(dtype=U64).view(np.int64)) if len(s) else 0)
                    f2.append(int(mix64(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64)) if len(s) else 0)
                if len(s):
                    sig = h.signature(s)
                    keys.append(h.keys(sig))
                    sketch.append((sig & U64(255)).astype(np.uint8).tobytes())
                else:
                    keys.append(None)
                    sketch.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["id", "h", "n", "f1", "f2", "keys", "sketch"],
            )

    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, h long, n long, f1 long, f2 long, keys array<long>, sketch binary")


def _least(threshold: float, bins: int, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The share of equal sketch bins below which a pair is not over the threshold."""
    eff = np.maximum(np.minimum(np.minimum(na, nb), bins), 1)
    return threshold - 5 * np.sqrt(threshold * (1 - threshold) / eff)


def _by_hub(pairs: DataFrame, values: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (b, salt, a, na, nb, v) of ``pairs(a, b, ...)`` with the value ``v`` of a; before those of a hub b, a row with a null ``a`` and the hub's value.

    A hub's value is sent once for each share of its pairs, not with every pair, and the pairs of a hub with very many are dealt out.
    """
    parts = hot(pairs, "b", scratch)
    left = dealt(pairs, "b", "a", parts).join(values.select(F.col("id").alias("a"), "v"), "a").select("b", "salt", "a", "na", "nb", "v")
    hubs = repeated(pairs.groupBy("b").agg(F.max("nb").alias("nb")).join(values.select(F.col("id").alias("b"), "v"), "b"), "b", parts)
    none = F.lit(None).cast("long")
    return left.unionByName(hubs.select("b", "salt", none.alias("a"), none.alias("na"), "nb", "v")).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())


def _alike(threshold: float, bins: int):
    """Pairs whose sketches could belong to a pair over the threshold, from the rows of ``_by_hub``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((1, bins), dtype=np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype=np.uint8).reshape(-1, bins)
            hub = np.asarray(batch.column("a").is_null())
            every = np.concatenate([last, x[hub]])
            at = np.cumsum(hub)
            least = _least(threshold, bins, batch.column("na").fill_null(1).to_numpy(), batch.column("nb").to_numpy())
            ok = ~hub & ((x == every[at]).mean(1) >= least)
            last = every[-1:]
            yield batch.filter(pa.array(ok)).select(["a", "b", "na", "nb"])

    return run


def _grouped(columns_: tuple[str, ...], solve, out_names: list[str], out_types: list[pa.DataType]):
    """A worker over groups (key, i, j) that arrive sorted; ``solve(head, rows)`` gives a group's output rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(out_types)], out_names)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "i", "j", *columns_)]
            for key, i, j, *rest in zip(*cols, strict=True):
                if (key, i, j) != now:
                    if len(held) > 1:
                        out += solve(now, held)
                    if len(out) > 20_000:
                        yield pack()
                        out = []
                    now, held = (key, i, j), []
                held.append(rest)
        if len(held) > 1:
            out += solve(now, held)
        if out:
            yield pack()

    return run


def _unsettled(threshold: float, bins: int):
    """Members of a group whose sketch is like that of a member of another component."""

    def solve(head: tuple, rows: list) -> list[tuple]:
        n, part = (np.array([r[k] for r in rows]) for k in (1, 2))
        side = np.array([r[3] for r in rows], dtype=bool)
        x = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8).reshape(-1, bins)
        hit = np.zeros(len(rows), dtype=bool)
        for k in np.flatnonzero(~side):
            r = np.flatnonzero((part != part[k]) & (side if side.any() else np.arange(len(rows)) > k))
            r = r[np.minimum(n[r], n[k]) >= threshold * np.maximum(n[r], n[k]) - 1e-9]
            if len(r):
                r = r[(x[r] == x[k]).mean(1) >= _least(threshold, bins, n[r], n[k])]
                hit[r] = True
                hit[k] |= len(r) > 0
        return [(*head, rows[k][0], rows[k][2], rows[k][3]) for k in np.flatnonzero(hit)]

    return _grouped(
        ("id", "n", "part", "side", "sketch"), solve, ["key", "i", "j", "id", "part", "side"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    )


def common_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """(n, n) sizes of all intersections: products of slices of the incidence matrix, without shingles that only one set has."""
    n = len(sets)
    flat, who = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    col = np.cumsum(new) - 1
    shared = np.bincount(col) > 1
    keep = shared[col]
    col, who = (np.cumsum(shared) - 1)[col[keep]], who[keep]
    out = np.zeros((n, n))
    cut = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else -1) + width + 1, width))
    for k in range(len(cut) - 1):
        x = np.zeros((n, width), dtype=np.float32)
        x[who[cut[k] : cut[k + 1]], col[cut[k] : cut[k + 1]] - k * width] = 1
        out += x @ x.T
    return out


def _joining(width: int, percent: int):
    """Links between components in a group, one for each pair of components that it joins at most."""

    def solve(head: tuple, rows: list) -> list[tuple]:
        open_ = zstandard.ZstdDecompressor().decompress
        raw = [open_(r[3]) for r in rows]
        off = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
        sets = shingle_sets(np.frombuffer(b"".join(raw), dtype=np.uint8), off, width)
        ids, part = [r[0] for r in rows], [r[1] for r in rows]
        side = np.array([r[2] for r in rows], dtype=bool)
        size = np.array([len(s) for s in sets])
        both = common_counts(sets)
        linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (both > 0)
        if side.any():
            linked &= side[None, :] & ~side[:, None]
        own = np.array(part)
        p, q = np.nonzero(np.triu(linked | linked.T, 1) & (own[:, None] != own[None, :]))
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                root[c] = root.get(root[c], root[c])
                c = root[c]
            return c

        out = []
        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            x, y = find(part[a]), find(part[b])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((max(ids[a], ids[b]), min(ids[a], ids[b])))
        return out

    return _grouped(("id", "part", "side", "z"), solve, ["a", "b"], [pa.int64(), pa.int64()])


def _verified(width: int, percent: int):
    """Compares the full sets of both texts of a pair, from the rows of ``_by_hub``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        hub = np.zeros(0, dtype=U64)
        for batch in batches:
            keep = []
            for a, z in zip(batch.column("a"), batch.column("v"), strict=True):
                raw = np.frombuffer(open_(z.as_py()), dtype=np.uint8)
                s = shingle_sets(raw, np.array([0, len(raw)]), width)[0]
                if not a.is_valid:
                    hub = s
                    keep.append(False)
                    continue
                both = len(np.intersect1d(s, hub, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(hub) - both) and both > 0)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _with_keys(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """Adds ``key``: the id, or for ids in ``again``, which have several rows, a hash of id and text."""
    if again is None:
        return rows.withColumn("key", F.col("id"))
    own = F.when(F.col("there"), F.xxhash64("id", "h")).otherwise(F.col("id"))
    return rows.join(again.select("id", F.lit(True).alias("there")), "id", "left").withColumn("key", own).drop("there")


def _packed_texts(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame, again: DataFrame | None) -> DataFrame:
    """(id, z): compressed texts of the documents that a Bloom filter of ``ids`` lets through: all of ``ids``, and few others.

    The filter has FILTER_BITS bits at most, whatever the input; when it fills up, more texts pass and are dropped by the join.
    """
    spark = docs.sparkSession
    there = ids.count()
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(_BUCKET_BITS.bit_length() - 1, (16 * max(there, 1)).bit_length()))
    spots = ids.select(F.explode(F.array(*(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits)) for k in (1, 2)))).alias("p"))
    # Bitmaps of 4 KiB are put together by the cluster: the driver gets bits / _BUCKET_BITS rows at most.
    buckets = spots.groupBy(F.floor(F.col("p") / _BUCKET_BITS).alias("w")).agg(F.bitmap_construct_agg(F.col("p") % _BUCKET_BITS).alias("b")).collect()
    table = np.zeros((bits // _BUCKET_BITS, _BUCKET_BITS // 8), dtype=np.uint8)
    for r in buckets:
        table[r.w] = np.frombuffer(r.b, dtype=np.uint8)
    shared = spark.sparkContext.broadcast(table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.frombuffer(shared.value, dtype=np.uint8)
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ok = np.ones(batch.num_rows, dtype=bool)
            for k in (1, 2):
                p = batch.column(f"p{k}").to_numpy(zero_copy_only=False)
                ok &= t[p // 8] >> (p % 8).astype(np.uint8) & 1 == 1
            if ok.any():
                kept = batch.filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([kept.column("id"), pa.array([press(x.encode()) for x in kept.column("text").to_pylist()], pa.binary())], ["id", "z"])

    mine = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    mine = _with_keys(mine, again).select(F.col("key").alias("id"), "text")
    out = mine.withColumns({f"p{k}": F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits)) for k in (1, 2)}).mapInArrow(run, "id long, z binary")
    return out if again is None else out.dropDuplicates(["id"])


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    bands: int = 32,
    rows: int = 4,
    bins: int = 256,
) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_hash, stands), a row for every row of ``docs``.

    Links documents with 100 * intersection >= ``percent`` * union of their word shingles. Null and empty
    texts, and texts of white space only, have empty sets and link with nothing: component_id is their own id. Rows that
    repeat an id each get a row with that id's component; if their texts differ, each has the component of its own text, named by the smallest id in it. A null id
    gets a null component_id and is kept. ``stands`` marks the rows of one text for each component (all rows without words or id): those that repeat
    an id and a text, and no others, stand together. Other columns of ``docs``, of whatever names, are not read. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "minhash")
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    signed = scratch.cut(sign(docs, id_col, text_col, width, bands, rows, bins), "signed")
    again = scratch.cut(signed.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"), "again")
    again = None if again.isEmpty() else again
    signed = _with_keys(signed, again)
    known = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    reps = known.groupBy("f1", "f2", "n").agg(F.min_by(F.struct(F.col("key").alias("id"), F.col("id").alias("doc"), "keys", "sketch"), F.struct("id", "h")).alias("r"))
    reps = scratch.cut(reps.select("f1", "f2", "n", "r.*"), "reps")
    keyed = reps.select("id", "n", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.max("id").alias("hi")).where("hub.id < hi")
    shared = scratch.cut(keyed.join(hubs.select("key", F.col("hub.id").alias("b"), F.col("hub.n").alias("nb")), "key"), "buckets")
    sketches = reps.select("id", "n", "sketch")
    wanted = shared.select("id").distinct()
    own = scratch.cut(_packed_texts(docs, id_col, text_col, wanted, again), "texts")

    star = (
        shared.where(F.col("id") != F.col("b")).where(100 * F.least("n", "nb") >= percent * F.greatest("n", "nb"))
        .select(F.col("id").alias("a"), "b", F.col("n").alias("na"), "nb").distinct()
    )
    rows_of = lambda pairs, values: _by_hub(pairs, values, scratch)
    sketched = rows_of(scratch.cut(star, "star"), sketches.select("id", F.col("sketch").alias("v")))
    likely = scratch.cut(sketched.mapInArrow(_alike(percent / 100, bins), "a long, b long, na long, nb long"), "likely")
    links = scratch.cut(rows_of(likely, own.select("id", F.col("z").alias("v"))).mapInArrow(_verified(width, percent), "a long, b long"), "links")
    parts = components(scratch, links)

    placed = shared.select("key", "id", "n").join(parts.withColumnRenamed("component", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    spans = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    apart = placed.join(spans.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "key").join(sketches.select("id", "sketch"), "id")
    blocks = (
        apart.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "n", "part", (F.col("own") > F.col("other")).alias("side"), "sketch")
    )
    spread = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    open_ = spread(blocks).mapInArrow(_unsettled(percent / 100, bins), "key long, i int, j int, id long, part long, side boolean")
    more = spread(scratch.cut(open_, "open").join(own, "id")).mapInArrow(_joining(width, percent), "a long, b long")
    links = links.unionByName(scratch.cut(more, "more"))
    parts = components(scratch, links)

    classes = reps.select("f1", "f2", "n", "id", "doc").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    if again is None:
        classes = classes.withColumns({"name": F.col("component"), "first": F.col("component")})
    else:
        # Named by the smallest id of its documents: a key of a text that shares its id is not one.
        least = classes.groupBy("component").agg(F.min(F.struct("doc", "id")).alias("s")).where((F.col("s.doc") != F.col("component")) | (F.col("s.id") != F.col("component")))
        classes = classes.join(scratch.cut(least, "names"), "component", "left").withColumns({"name": F.coalesce("s.doc", "component"), "first": F.coalesce("s.id", "component")})
    out = signed.select("id", "h", "n", "f1", "f2", "key").join(classes.select("f1", "f2", "n", "name", F.col("first"), F.col("id").alias("class")), ["f1", "f2", "n"], "left")
    name = F.when(F.col("n") > 0, F.coalesce("name", "id")).otherwise(F.col("id"))
    stands = F.col("id").isNull() | (F.col("n") == 0) | ((F.col("class") == F.col("first")) & (F.col("key") == F.col("class")))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), name).alias("component_id"), F.col("h").alias("text_hash"), stands.alias("stands")
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
