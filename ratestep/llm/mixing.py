"""Mixing sources to target weights by Poisson replication, with DataFrame operations only.

A source of size n (characters) with target share w of a budget B is to be repeated w * B / n times on
average. Each document draws a uniform number from a hash of its id and the seed, inverts the Poisson distribution
function of its source's rate, and is emitted so many times; a second hash of id and copy gives the global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratestep.runtime import Scratch

#: A larger rate is drawn as a sum of equal parts below it, so that exp(-rate) stays in range.
LARGEST = 300.0


def uniform(*parts: Column | str) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, *, source_col: str, text_col: str, weights: dict[str, float] | None, temperature: float, epochs: float) -> DataFrame:
    """(key, rate, parts, cdf) of each source; one partial aggregate over the table, a row for each source after it."""
    sizes = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("key")).agg(
        F.sum(F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).cast("long")).alias("n")
    )
    if weights is None:
        raw = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "key string, w double")
        raw = sizes.join(named, "key", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    whole = raw.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 0, F.col("w"))).alias("w")).first()
    budget, weight = float(whole["n"] or 0) * epochs, float(whole["w"] or 0.0)
    rate = F.when((F.col("n") > 0) & F.lit(weight > 0), F.lit(budget) * F.col("w") / F.lit(weight or 1.0) / F.col("n")).otherwise(F.lit(0.0))
    part = raw.select("key", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST).cast("int")))
    part = part.withColumn("each", F.col("rate") / F.col("parts"))
    top = F.ceil(F.col("each") + 12 * F.sqrt("each") + 20).cast("int")
    start = F.struct(F.exp(-F.col("each")).alias("p"), F.exp(-F.col("each")).alias("c"), F.array(F.exp(-F.col("each"))).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("each") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.array_append(acc["all"], acc["c"] + p).alias("all"))

    return part.select("key", "rate", "parts", F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["all"]).alias("cdf"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    seed: str = "mix",
    columns: list[str] | None = None,
) -> DataFrame:
    """``columns`` (all of ``docs`` by default) of each document, once a copy, with mix_copy, mix_copies, mix_rate and mix_order.

    ``weights`` are target shares by source, normalised over the sources there are; sources without one are left
    out. Without ``weights`` the shares are sizes to the power ``temperature``. A null source counts as "". Null and empty texts add nothing to
    a size but are repeated like any document of their source; a source without any text has rate 0. Rows that
    repeat an id draw the same count; a null id draws as "null". An empty table gives an empty result. The columns that
    are added replace columns of the same name. The rates are written first, so that Spark's own size check decides whether they are broadcast;
    otherwise the join is on the source and adaptive execution splits a hot one.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    by = scratch.cut(rates(docs, source_col=source_col, text_col=text_col, weights=weights, temperature=temperature, epochs=epochs), "rates")
    keep = [c for c in (columns or docs.columns) if c not in ("mix_copy", "mix_copies", "mix_rate", "mix_order")]
    # What is kept travels in one struct, so that its names cannot clash with those used here.
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"))
    u = lambda j: uniform(seed, F.col("id"), j)
    below = lambda v: F.aggregate("cdf", F.lit(0), lambda n, c: n + F.when(c <= v, 1).otherwise(0))
    drawn = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda acc, j: acc + below(u(j)))
    counted = rows.join(by, "key").withColumn("u", u(F.lit(1))).withColumn("mix_copies", F.when(F.col("parts") == 1, F.size(F.filter("cdf", lambda c: c <= F.col("u")))).otherwise(drawn))
    copies = F.explode(F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1), F.col("mix_copies"))))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), "id", F.col("mix_copy").cast("string")))
    out = counted.select("row", "id", F.col("rate").alias("mix_rate"), "mix_copies", copies.alias("mix_copy")).withColumn("mix_order", order)
    return out.select("row.*", "mix_rate", "mix_copies", "mix_copy", "mix_order").repartition("mix_order").sortWithinPartitions("mix_order")
