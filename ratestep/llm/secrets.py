"""Secret scans with DataFrame operations only: fixed patterns, and character Markov models of random strings and identifiers.

Offsets come from ``split`` and ``regexp_extract_all`` with the same pattern: the pieces between matches and the
matches alternate, so running sums of their lengths are the code point offsets. The Markov part scores each
long token with log P(token | random) - log P(token | identifier), two first-order character models trained
from labelled samples by one bigram count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The three base patterns.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A token long enough to tell the models apart.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
KINDS = ("assign", "access", "hex", "markov")
_K = len(ALPHABET) + 1
#: Items of a block of a running fold, and characters of a chunk of text.
_BLOCK, _CHUNK = 64, 4096
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _running(items: Column, zero: Column, join, value, out) -> Column:
    """``out(x, state)`` for each item, the state being ``join`` of the values of all items before it.

    Folds that append copy what they have, so they run over blocks of ``_BLOCK`` items and over one state a block: time grows in proportion to the
    items, up to many thousands of blocks.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(_BLOCK)), lambda k: F.slice(items, k + 1, F.lit(_BLOCK)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: join(acc, value(x))))
    none = F.slice(F.array(zero), 1, 0)
    starts = F.aggregate(totals, F.struct(zero.alias("at"), none.alias("all")), lambda acc, t: F.struct(join(acc["at"], t).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")), lambda acc: acc["all"])

    def within(b: Column, s: Column) -> Column:
        empty = F.transform(F.slice(b, 1, 0), lambda x: out(x, s))
        step = lambda acc, x: F.struct(join(acc["at"], value(x)).alias("at"), F.array_append(acc["all"], out(x, acc["at"])).alias("all"))
        return F.aggregate(b, F.struct(s.alias("at"), empty.alias("all")), step, lambda acc: acc["all"])

    return F.flatten(F.zip_with(blocks, starts, within))


def _spans(df: DataFrame, into: str, text: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> DataFrame:
    """Adds ``into``: spans of the matches of ``pattern``; with ``group``, only those whose group has ``least`` characters."""
    t = F.col(text)
    length = lambda xs: F.transform(xs, F.char_length)
    parts = [length(F.split(t, pattern, -1)).alias("gap"), length(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).alias("len")]
    if group:
        parts.append(length(F.regexp_extract_all(t, F.lit(pattern), F.lit(group))).alias("part"))
    # A column of its own: it is read in several places, and patterns should run once.
    df = df.withColumn(into, F.when(t.rlike(pattern), F.arrays_zip(*parts)))

    def span(x: Column, at: Column) -> Column:
        start = at + x["gap"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.coalesce(x["len"], F.lit(0))).alias("end"), (x["part"] if group else F.lit(least)).alias("part"), x["len"].isNotNull().alias("ok"))

    placed = _running(F.col(into), F.lit(0).cast("long"), lambda p, q: p + q, lambda x: (x["gap"] + F.coalesce(x["len"], F.lit(0))).cast("long"), span)
    kept = F.filter(placed, lambda s: s["ok"] & (s["part"] >= least))
    plain = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return df.withColumn(into, F.when(F.col(into).isNotNull(), plain).otherwise(F.array()).cast(SPAN))


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(samples: DataFrame, *, text_col: str = "text", label_col: str = "label") -> list[float]:
    """Log-likelihood ratios of character pairs, from samples labelled 1 (random) and 0 (ordinary identifier).

    Counts are made by the cluster; what comes to the driver has at most 2 * 67 * 67 rows. Null texts and
    labels are left out. Add-half smoothing; without any sample all ratios are 0.
    """
    codes = samples.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(label_col).cast("int").alias("y"), _codes(F.col(text_col)).alias("c"))
    pairs = codes.where(F.size("c") > 1).select(
        "y", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * _K + b)).alias("pair")
    )
    count = {(r.y, r.pair): r["count"] for r in pairs.groupBy("y", "pair").count().collect()}
    out = []
    for a in range(_K):
        rows = [[count.get((y, a * _K + b), 0) + 0.5 for b in range(_K)] for y in (0, 1)]
        total = [math.fsum(r) for r in rows]
        out += [math.log(rows[1][b] / total[1]) - math.log(rows[0][b] / total[0]) for b in range(_K)]
    return out


def llr(tokens: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of each token of an array column."""
    # One literal that is folded when the query is planned: a list would be handed to the JVM number by number, which took 9 s.
    ratio = F.split(F.lit(",".join(repr(float(x)) for x in table)), ",").cast("array<double>")
    return F.transform(
        F.transform(tokens, _codes),
        lambda c: F.aggregate(
            F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * _K + b),
            F.lit(0.0),
            lambda acc, k: acc + F.get(ratio, k),
        ),
    )


def find_secrets(docs: DataFrame, table: list[float], *, id_col: str = "doc_id", text_col: str = "text", least_llr: float = 7.0, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (the id by default) of each row with ``found``: its spans (start, kind, end) in code points, by start, then kind.

    A column called found is replaced.

    Kinds 0 to 2 are the base patterns, 3 the tokens whose ratio is ``least_llr`` or more and that
    no base span covers whole. A null text is empty and has no spans; rows that repeat are scanned alike.
    """
    # What is kept travels in one struct, so that its names cannot clash with those used here.
    kept = [c for c in (keep or [id_col]) if c != "found"]
    df = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for into, pattern, kind, group, least in (("s0", ASSIGN, 0, 2, 12), ("s1", ACCESS, 1, 0, 0), ("s2", HEX, 2, 0, 0), ("s3", TOKEN, 3, 0, 0)):
        df = _spans(df, into, "t", pattern, kind, group, least)
    ratios = F.arrays_zip(F.col("s3").alias("s"), llr(F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)), table).alias("r"))
    df = df.withColumn("likely", F.when(F.size("s3") > 0, F.transform(F.filter(ratios, lambda x: x["r"] >= least_llr), lambda x: x["s"])))
    df = df.withColumn("base", F.array_sort(F.concat("s0", "s1", "s2")))
    # In order of starts, base spans before tokens: a base span covers a token if the furthest end so far is not before the token's.
    df = df.withColumn("every", F.when(F.size("likely") > 0, F.array_sort(F.concat("base", "likely"))))
    reach = lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(F.lit(-1).cast("long"))
    seen = _running(F.col("every"), F.lit(-1).cast("long"), F.greatest, reach, lambda x, at: F.struct(x.alias("s"), ((x["kind"] < 3) | (x["end"] > at)).alias("ok")))
    found = F.transform(F.filter(seen, lambda x: x["ok"]), lambda x: x["s"])
    return df.withColumn("found", F.when(F.col("every").isNotNull(), found).otherwise(F.col("base"))).select("row.*", "found")


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as one string."""
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_named(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _named(F.col("found")).alias("spans"),
        n(3).alias("n_markov"),
    )


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, and every run of overlapping spans, replaced by ``mark``.

    The text is cut into chunks first: a piece between two spans is taken from its own chunks, not counted out from the start of the text.
    """
    zero = F.lit(0).cast("long")
    runs = _running(found, zero, F.greatest, lambda s: s["end"], lambda s, at: F.struct(at.alias("a"), s["start"].alias("b"), (s["start"] >= at).alias("ok")))
    last = F.struct(F.aggregate(found, zero, lambda acc, s: F.greatest(acc, s["end"])).alias("a"), F.char_length(text).cast("long").alias("b"), F.lit(True).alias("ok"))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))

    def piece(p: Column, own: Column) -> Column:
        first = F.floor(p["a"] / _CHUNK).cast("int")
        n = F.ceil(p["b"] / _CHUNK).cast("int") - first
        return F.when(p["b"] > p["a"], F.substring(F.array_join(F.slice(own, first + 1, n), ""), (p["a"] % _CHUNK).cast("int") + 1, (p["b"] - p["a"]).cast("int"))).otherwise(F.lit(""))

    pieces = F.concat(F.filter(runs, lambda p: p["ok"]), F.array(last))
    # Chunks in an array of one: a lambda's argument is evaluated once for all pieces.
    done = F.element_at(F.transform(F.array(chunks), lambda own: F.array_join(F.transform(pieces, lambda p: piece(p, own)), mark)), 1)
    return F.when(F.size(found) > 0, done).otherwise(text)


def generated_samples(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", random_rows: int = 6000, sample_docs: int = 1500) -> DataFrame:
    """Labelled samples: random strings from hashes of counters, identifiers from words of a bounded sample of documents.

    ``sample_docs`` documents at most (about; the smallest hashes of their ids) give one identifier of every three consecutive words, joined by
    "_", "-", "/" or nothing, lower case, capitalised or upper case, some with a short number.
    """
    spark = docs.sparkSession
    i = F.col("id").cast("string")
    sha = F.unhex(F.sha2(i, 256))
    strings = (
        F.when(F.col("id") % 4 == 0, F.sha2(i, 256))
        .when(F.col("id") % 4 == 1, F.translate(F.base64(sha), "=", ""))
        .when(F.col("id") % 4 == 2, F.upper(F.translate(F.base64(sha), "=+/", "")))
        .otherwise(F.translate(F.translate(F.base64(sha), "+/", "-_"), "=", ""))
    )
    random = spark.range(random_rows).select(F.substring(strings, 1, 40).alias("text"), F.lit(1).alias("label"))
    there = docs.count()
    share = min(1.0, sample_docs / max(1, there))
    sample = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)).select(F.col(text_col).alias("t"))
    words = sample.select(F.regexp_extract_all("t", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    glued = words.where(F.size("w") >= 3).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 3, F.lit(3)), lambda k: F.struct(k.alias("k"), F.slice("w", k + 1, 3).alias("w")))).alias("x")
    )
    k = F.col("x.k")
    pick = F.get(F.array(F.lit("_"), F.lit("-"), F.lit("/"), F.lit("")), (k % 4).cast("int"))
    joined = F.array_join("x.w", " ")
    cased = F.get(F.array(F.lower(joined), F.initcap(joined), F.upper(joined)), (k % 5 % 3).cast("int"))
    number = F.when(k % 6 == 0, (k % 97).cast("string")).otherwise(F.lit(""))
    ordinary = glued.select(F.concat(F.array_join(F.split(cased, " "), "\x01"), number).alias("n"), pick.alias("j")).select(
        F.replace("n", F.lit("\x01"), "j").alias("text"), F.lit(0).alias("label")
    )
    return random.unionByName(ordinary)
