"""Hierarchies: nodes (node, parent, y, exposure) with counts at the leaves; one level loop of joins up, one down.

A node is one bin with probability rho, else it is cut into its children. A subtree without events is one bin. Levels are few; each
is a partial aggregate by parent. Several prior settings go through the same loop as rows of a stated grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ratestep.plans.exact import log_add, log_gamma
from ratestep.runtime import Scratch


def log_evidence(y: Column, e: Column, alpha: Column, beta: Column) -> Column:
    """Gamma-Poisson log evidence of a region, without the factor of the data alone."""
    return alpha * F.log(beta) - log_gamma(alpha) + log_gamma(y + alpha) - (y + alpha) * F.log(e + beta)


def levels(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Nodes by depth from the roots; written once each, and counted while they are written."""
    nodes = scratch.cut(nodes.select("node", "parent", F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("exposure", F.lit(0.0)).alias("exposure")), "nodes")
    out, now = [], nodes.where(F.col("parent").isNull())
    while len(out) <= 64:
        seen = Observation()
        now = scratch.cut(now.observe(seen, F.count(F.lit(1)).alias("n")), "level")
        if not seen.get.get("n"):
            return out
        out.append(now)
        now = nodes.join(now.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent", "y", "exposure")
    raise ValueError("the hierarchy has a cycle, or more than 64 levels")


def _grid(df: DataFrame, grid: list[tuple[float, float, float]]) -> DataFrame:
    return df.withColumn("g", F.explode(F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta"), F.lit(float(r)).alias("rho")) for a, b, r in grid))))


def evidences(by_level: list[DataFrame], grid: list[tuple[float, float, float]], scratch: Scratch, *, best: bool = False) -> list[DataFrame]:
    """For each level (g, node, parent, y, exposure, L, Z, Zc): evidence as one bin, of the subtree, and of its cut children (null at a leaf).

    Counts and exposures are totals of the subtree: an inner node's own are added to its children's. With ``best`` the larger of the two ways is
    taken instead of their sum.
    """
    out: list[DataFrame] = [None] * len(by_level)
    below = None
    for k in range(len(by_level) - 1, -1, -1):
        x = _grid(by_level[k], grid)
        if below is None:
            x = x.withColumn("Zc", F.lit(None).cast("double"))
        else:
            up = below.groupBy("g", F.col("parent").alias("node")).agg(F.sum("y").alias("cy"), F.sum("exposure").alias("ce"), F.sum("Z").alias("Zc"))
            add = {c: F.col(c) + F.coalesce(more, F.lit(0.0)) for c, more in (("y", "cy"), ("exposure", "ce"))}
            x = x.join(up, ["g", "node"], "left").withColumns(add)
        x = x.withColumn("L", log_evidence(F.col("y"), F.col("exposure"), F.col("g.alpha"), F.col("g.beta")))
        whole, cut = F.log(F.col("g.rho")) + F.col("L"), F.log1p(-F.col("g.rho")) + F.col("Zc")
        z = F.when(F.col("Zc").isNull() | (F.col("y") == 0), F.col("L")).otherwise(F.greatest(whole, cut) if best else log_add(whole, cut))
        below = out[k] = scratch.cut(x.select("g", "node", "parent", "y", "exposure", "L", z.alias("Z"), F.when(F.col("y") > 0, F.col("Zc")).alias("Zc")), "z")
    return out


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _by_node(by_level: list[DataFrame], setting: tuple[float, float, float], scratch: Scratch) -> DataFrame:
    each = evidences(by_level, [setting], scratch)
    return _all([x.select("node", F.lit(k).alias("level"), "y", "exposure", F.col("L").alias("log_bin"), F.col("Z").alias("log_z")) for k, x in enumerate(each)])


def tree_evidence(nodes: DataFrame, alpha: float, beta: float, rho: float, *, scratch: Scratch | None = None) -> DataFrame:
    """(node, level, y, exposure, log_bin, log_z): every node's evidence as one bin, and over all ways to cut below it."""
    scratch = scratch or Scratch(nodes.sparkSession, "tree")
    return _by_node(levels(nodes, scratch), (alpha, beta, rho), scratch)


def _carried(x: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """What is handed down a level; written at every fourth one, so that plans stay short."""
    return scratch.cut(x, "down") if k % 4 == 3 else x


def tree_posterior(nodes: DataFrame, alpha: float, beta: float, rho: float, *, scratch: Scratch | None = None) -> DataFrame:
    """(node, parent, level, p_bin, rate): P(the node is a bin of the partition), from the root down; rate is its posterior mean as one bin.

    A node below a subtree without events is never reached: that subtree is one bin.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "tree")
    parts, reach = [], None
    for k, x in enumerate(evidences(levels(nodes, scratch), [(alpha, beta, rho)], scratch)):
        own = F.when(F.col("Zc").isNull(), F.lit(1.0)).otherwise(F.exp(F.log(F.lit(rho)) + F.col("L") - F.col("Z")))
        x = x.withColumn("own", own)
        x = x.withColumn("reach", F.lit(1.0)) if reach is None else x.join(reach, "parent").withColumn("reach", F.col("r"))
        x = x.select("node", "parent", F.lit(k).alias("level"), (F.col("reach") * F.col("own")).alias("p_bin"), ((F.col("y") + alpha) / (F.col("exposure") + beta)).alias("rate"), (F.col("reach") * (1 - F.col("own"))).alias("r"))
        x = _carried(x, k, scratch)
        reach = x.select(F.col("node").alias("parent"), "r")
        parts.append(x.drop("r"))
    return _all(parts)


def _best(by_level: list[DataFrame], setting: tuple[float, float, float], scratch: Scratch) -> DataFrame:
    parts, open_, rho = [], None, setting[2]
    for k, x in enumerate(evidences(by_level, [setting], scratch, best=True)):
        x = x.withColumn("cut", F.coalesce(F.log1p(F.lit(-rho)) + F.col("Zc") > F.log(F.lit(rho)) + F.col("L"), F.lit(False)))
        if open_ is not None:
            x = x.join(open_, "parent", "left_semi")
        x = _carried(x.select("node", F.lit(k).alias("level"), "y", "exposure", "cut"), k, scratch)
        open_ = x.where("cut").select(F.col("node").alias("parent"))
        parts.append(x.where(~F.col("cut")).drop("cut"))
    return _all(parts)


def best_partition(nodes: DataFrame, alpha: float, beta: float, rho: float, *, scratch: Scratch | None = None) -> DataFrame:
    """(node, level, y, exposure): the bins of the most probable partition; a tie stays whole."""
    scratch = scratch or Scratch(nodes.sparkSession, "tree")
    return _best(levels(nodes, scratch), (alpha, beta, rho), scratch)


def prior_search(nodes: DataFrame, grid: list[tuple[float, float, float]], *, scratch: Scratch | None = None) -> DataFrame:
    """(alpha, beta, rho, log_z) of every setting of a stated grid, summed over the roots; all settings go through one loop."""
    scratch = scratch or Scratch(nodes.sparkSession, "tree")
    root = evidences(levels(nodes, scratch), grid, scratch)[0]
    return root.groupBy("g").agg(F.sum("Z").alias("log_z")).select("g.alpha", "g.beta", "g.rho", "log_z")


def best_prior(nodes: DataFrame, grid: list[tuple[float, float, float]]) -> DataFrame:
    return prior_search(nodes, grid).agg(F.max_by(F.struct("alpha", "beta", "rho"), "log_z").alias("p"), F.max("log_z").alias("log_z")).select("p.alpha", "p.beta", "p.rho", "log_z")


def leaf_rates(posterior: DataFrame, depth: int) -> DataFrame:
    """(node, rate) of the nodes that have no children in the table: the mean over the ancestors that may be their bin."""
    walk = posterior.join(posterior.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct(), "node", "left_anti")
    walk = walk.select(F.col("node").alias("leaf"), "parent", (F.col("p_bin") * F.col("rate")).alias("x"))
    up = posterior.select(F.col("node").alias("parent"), F.col("parent").alias("next"), (F.col("p_bin") * F.col("rate")).alias("more"))
    for _ in range(depth - 1):
        walk = walk.join(up, "parent", "left").select("leaf", F.col("next").alias("parent"), (F.col("x") + F.coalesce("more", F.lit(0.0))).alias("x"))
    return walk.select(F.col("leaf").alias("node"), F.col("x").alias("rate"))


def lookup(nodes: DataFrame, bins: DataFrame, places: DataFrame, depth: int) -> DataFrame:
    """(place, node): the bin of a partition that holds each place's node: the nearest among the node and its ancestors."""
    up = nodes.select("node", "parent")
    walk, found = places.select("place", "node"), None
    for k in range(depth + 1):
        hit = walk.join(bins.select("node"), "node").select("place", "node", F.lit(k).alias("up"))
        found = hit if found is None else found.unionByName(hit)
        if k < depth:
            walk = walk.join(up, "node").where("parent IS NOT NULL").select("place", F.col("parent").alias("node"))
    return found.groupBy("place").agg(F.min_by("node", "up").alias("node"))


def held_out(train: DataFrame, whole: DataFrame, alpha: float, beta: float, rho: float) -> DataFrame:
    """(log_p_tree, log_p_best): log predictive of what ``whole`` adds: averaged over cuts, and in the best partition of ``train``."""
    scratch = Scratch(train.sparkSession, "tree")
    setting = (alpha, beta, rho)
    by_level = [levels(x, scratch) for x in (train, whole)]
    z = [evidences(by_level[0], [setting], scratch)[0].agg(F.sum("Z").alias("z"))]
    best = _best(by_level[0], setting, scratch)
    every = _by_node(by_level[1], setting, scratch)
    z.append(every.where("level = 0").agg(F.sum("log_z").alias("z")))
    after = every.select("node", F.col("log_bin").alias("l2"))
    a, b = F.lit(float(alpha)), F.lit(float(beta))
    fixed = best.join(after, "node").agg(F.sum(F.col("l2") - log_evidence(F.col("y"), F.col("exposure"), a, b)).alias("log_p_best"))
    both = z[0].withColumnRenamed("z", "z1").withColumn("one", F.lit(1)).join(z[1].withColumnRenamed("z", "z2").withColumn("one", F.lit(1)), "one").join(fixed.withColumn("one", F.lit(1)), "one")
    return both.select((F.col("z2") - F.col("z1")).alias("log_p_tree"), "log_p_best")


def merge_neighbours(bins: DataFrame, edges: DataFrame, alpha: float, beta: float, gamma: float = 0.1) -> DataFrame:
    """(region, node, merged): greedy joining of neighbouring bins in each region; ``bins`` has region, node, y, exposure, ``edges`` region, a, b.

    Joining is sequential, so a region is one unit of work.
    """
    import numpy as np

    from ratestep.functions.planes import merge_bins
    from ratestep.operators.fit import kernel

    left = bins.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("node", "y", "exposure"))).alias("bins"))
    right = edges.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("edges"))

    def one(r: dict) -> list[dict]:
        names = [x["node"] for x in r["bins"]]
        at = {n: k for k, n in enumerate(names)}
        near = [(at[x["a"]], at[x["b"]]) for x in r["edges"] or [] if x["a"] in at and x["b"] in at]
        label, _ = merge_bins(np.array([x["y"] for x in r["bins"]]), np.array([x["exposure"] for x in r["bins"]]), near, alpha, beta, gamma)
        return [{"node": names[k], "merged": names[int(x)]} for k, x in enumerate(label)]

    return kernel(left.join(right, "region", "left"), one, "region string, node string, merged string", keep="region")


def dyadic(series: DataFrame, T: int, alpha: float, beta: float, rho: float) -> DataFrame:
    """(series_id, log_evidence) of series of T = 2**d intervals under cuts in halves: levels are shifts of k, no edge table is needed."""
    depth = T.bit_length() - 1
    if T != 1 << depth:
        raise ValueError("T must be a power of two")
    a, b = F.lit(float(alpha)), F.lit(float(beta))
    now = series.select("series_id", F.col("k").cast("int").alias("k"), "y", "e").withColumn("z", log_evidence(F.col("y"), F.col("e"), a, b))
    for _ in range(depth):
        up = now.groupBy("series_id", F.shiftright("k", 1).alias("k")).agg(F.sum("y").alias("y"), F.sum("e").alias("e"), F.sum("z").alias("zc"))
        now = up.select("series_id", "k", "y", "e", log_add(F.log(F.lit(rho)) + log_evidence(F.col("y"), F.col("e"), a, b), F.log1p(F.lit(-rho)) + F.col("zc")).alias("z"))
    return now.select("series_id", F.col("z").alias("log_evidence"))
