"""Connected components of an edge table by alternating star contractions, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ratestep.runtime import Scratch


#: Rows of one key that go to one task.
SHARE = 1024


def hot(rows: DataFrame, key: str, scratch: Scratch, share: int = 0) -> DataFrame:
    """(key, parts) of the keys with more than ``share`` rows; few, and written, so that Spark knows their number and broadcasts them."""
    share = share or SHARE
    return scratch.cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("parts")), "hot")


def dealt(rows: DataFrame, key: str, by: str, parts: DataFrame | None) -> DataFrame:
    """Adds ``salt``: the rows of a hot key are dealt out over its parts by a hash of ``by``."""
    if parts is None:
        return rows.withColumn("salt", F.lit(0))
    return rows.join(parts, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")).cast("int"), F.lit(0))).drop("parts")


def repeated(rows: DataFrame, key: str, parts: DataFrame | None) -> DataFrame:
    """The other side of ``dealt``: the row of a hot key once for each part."""
    if parts is None:
        return rows.withColumn("salt", F.lit(0))
    return rows.join(parts, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def _joined(rows: DataFrame, low: DataFrame, key: str, by: str, scratch: Scratch | None) -> DataFrame:
    """``rows`` with the row of ``low`` for their key."""
    if scratch is None:
        return rows.join(low, key)
    parts = hot(rows, key, scratch)
    return dealt(rows, key, by, parts).join(repeated(low, key, parts), [key, "salt"]).drop("salt")


def _large_star(e: DataFrame, scratch: Scratch | None) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _joined(both.where(F.col("v") > F.col("u")), low, "u", "v", scratch).select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(e: DataFrame, scratch: Scratch | None) -> DataFrame:
    # a < b in every edge: the neighbours of b that are not larger are its a's.
    low = e.groupBy("b").agg(F.min("a").alias("m"))
    hung = _joined(e, low, "b", "a", scratch).where(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return low.select(F.col("m").alias("a"), "b").unionByName(hung)


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges(a, b)``; the component is the smallest id that can be reached.

    Both contractions take minima with partial aggregation, and the edges of a hub are dealt out over several tasks, so a hub with very many
    edges costs a row a task; each round is written to the shared folder, and a sum of hashes taken while it is written tells when nothing changes. An id without edges is not returned; no edges give an
    empty table. Loops and edges with a null end are left out.
    """
    start = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = scratch.cut(start, "edges")
    seen = {"n": now.count()}
    for k in range(max_rounds):
        # Without more edges than one hub's share there is nothing to deal out.
        salted = scratch if seen["n"] > SHARE else None
        watch = Observation()
        mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")]
        wide = _large_star(now, salted)
        wide = wide if salted is None else scratch.cut(wide, "wide")
        after = scratch.cut(_small_star(wide, salted).distinct().observe(watch, *mark), "star")
        got = watch.get
        scratch.drop(now, wide)
        now = after
        if got == seen or not got.get("n"):
            break
        seen = got
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    )
