"""Reply trees to chat transcripts: self-joins enumerate root-to-leaf paths, branches are ranked, chosen paths are formatted.

Paths come from pointer doubling: jump tables to the 2**k-th ancestor are made by joining each with itself, then
every leaf's rows (leaf, node) double from the longest jump down, so a tree of depth d takes 2 * log2(d) self-joins and the rows of a path stay
spread over the cluster until its text is put together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratestep.runtime import Scratch, bounded_batches, ensure_importable

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``: no control string is left, and a backslash always has a partner."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: m[1], text, flags=re.S)


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), text, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a formatted conversation; anything else in it is an error."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"text outside turns at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"text outside turns at {at}")
    return out


def keyed(nodes: DataFrame, unique: bool = False) -> DataFrame:
    """Rows with a key for tree and node that nulls and repeated ids have too: (t, k, up, tree, node, role, text, score).

    Rows alike in all of these are one node. Of different rows with one id, the first in order (parent, role, text, score) is the node that replies
    hang on; each other one is a reply of its own to its parent. ``unique`` says that there are none, and saves the shuffle.
    """
    own = nodes.select("tree", "node", "parent", "role", "text", "score")
    if unique:
        own = own.withColumn("copy", F.lit(1))
    else:
        own = own.distinct().withColumn("copy", F.row_number().over(Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score")))
    return own.select(
        F.struct("tree").alias("t"), F.struct("node", "copy").alias("k"), F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("node"), F.lit(1).alias("copy"))).alias("up"),
        "tree", "node", "role", "text", "score",
    )


def paths(keys: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(t, leaf, k, up) for every node of every root-to-leaf path, ``up`` counted from the leaf; and the nodes (t, k) that lead into a cycle, which have no path.

    A parent that is null or not there makes a root. A node that still has an ancestor after as many steps as its tree has nodes leads into a cycle.
    """
    links = scratch.cut(keys.select("t", "k", "up"), "links")
    there = links.select("t", F.col("k").alias("up"))
    jump = scratch.cut(links.where(F.col("up").isNotNull()).join(there, ["t", "up"], "left_semi").select("t", "k", F.col("up").alias("far")), "jump")
    leaves = links.select("t", "k").join(jump.select("t", F.col("far").alias("k")).distinct(), ["t", "k"], "left_anti")
    most = links.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    jumps = []
    while (1 << len(jumps)) <= most and not jump.isEmpty():
        jumps.append(jump)
        jump = scratch.cut(jump.join(jump.select("t", F.col("k").alias("far"), F.col("far").alias("further")), ["t", "far"]).select("t", "k", F.col("further").alias("far")), "jump")
    loops = jump.select("t", "k")
    out = leaves.join(loops, ["t", "k"], "left_anti").select("t", F.col("k").alias("leaf"), "k", F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 1, -1, -1):
        more = out.join(jumps[k], ["t", "k"]).select("t", "leaf", F.col("far").alias("k"), (F.col("up") + (1 << k)).alias("up"))
        # Written: the rows are read twice in the next round, and a plan that repeats its input doubles with each.
        out = scratch.cut(out.unionByName(more), "paths")
    return out, loops


def cyclic(nodes: DataFrame) -> DataFrame:
    """(tree, node) of the rows that lead into a cycle of reply links; ``format_trees`` has no conversation for them."""
    loops = paths(keyed(nodes), Scratch(nodes.sparkSession, "chat"))[1]
    return loops.select("t.tree", "k.node").distinct()


def format_trees(nodes: DataFrame, *, best: int | None = None, train_role: str = "assistant", scratch: Scratch | None = None, unique: bool = False) -> DataFrame:
    """Formatted conversations, one for each chosen root-to-leaf path.

    ``nodes`` has tree, node, parent, role, text and score. A path's score is the mean of its nodes' scores (null: 0); paths of a
    tree are ranked by it, then by leaf, and the ``best`` first ones are formatted (all by default). Returns tree, leaf, rank,
    path_score, n_turns, formatted and mask: the spans (start, end) in code points of the texts under the loss mask,
    those of ``train_role``. Null texts and roles are empty. Null trees are one tree, a null node has no replies. Rows that repeat are one node; different rows
    with one node id each have a path (see ``keyed``; ``unique`` says that there are none). Nodes that lead into a cycle have no path (``cyclic`` lists them);
    other trees are not affected. Other columns are not read.
    """
    spark = nodes.sparkSession
    scratch = scratch or Scratch(spark, "chat")
    full = keyed(nodes, unique)
    if not unique:
        full = scratch.cut(full, "nodes")
    steps = paths(full, scratch)[0]
    if best is not None:
        scored = steps.join(full.select("t", "k", F.coalesce("score", F.lit(0.0)).alias("score")), ["t", "k"]).groupBy("t", "leaf").agg(F.avg("score").alias("s"))
        rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("s"), "leaf"))
        steps = steps.join(scored.withColumn("r", rank).where(F.col("r") <= best).select("t", "leaf"), ["t", "leaf"], "left_semi")
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    turn = F.struct(
        (-F.col("up")).alias("at"),
        F.concat(F.lit(START), role, F.lit("\n")).alias("head"),
        text.alias("body"),
        (F.coalesce("role", F.lit("")) == train_role).alias("on"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    grouped = steps.join(full.select("t", "k", "role", "text", "score"), ["t", "k"]).groupBy("t", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    tail = END + "\n"

    def span(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(t["head"])
        end = start + F.char_length(t["body"])
        s = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((end + len(tail)).alias("at"), F.when(t["on"], F.array_append(acc["all"], s)).otherwise(acc["all"]).alias("all"))

    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("all"))
    out = grouped.select(
        "t.tree",
        F.col("leaf.node").alias("leaf"),
        F.col("leaf.copy").alias("__copy"),
        (F.aggregate("turns", F.lit(0.0), lambda a, t: a + t["score"]) / F.size("turns")).alias("path_score"),
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"),
        F.aggregate("turns", empty, span, lambda a: a["all"]).alias("mask"),
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf", "__copy")).cast("long")).drop("__copy")


def linear(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", score: Column | None = None) -> DataFrame:
    """Rows of turns as reply trees with one path: each replies to the one before, by turn, then role and text.

    Repeated rows and repeated turn numbers stay turns of their own; a null turn comes first; rows with a null id form one conversation.
    """
    order = Window.partitionBy(id_col).orderBy(F.col(turn_col), F.col(role_col), F.col(text_col))
    at = F.row_number().over(order).cast("long")
    return turns.select(
        F.col(id_col).alias("tree"), at.alias("node"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), (score if score is not None else F.lit(0.0)).alias("score")
    ).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def digest(formatted: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """What the formatted conversations hold, read back from them: turns, and texts under the loss mask. Ids of any type, and null, are kept."""
    ensure_importable(formatted.sparkSession)
    bounded_batches(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in mask)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = [pa.array([r[k] for r in rows], pa.string() if k in (1, 3) else pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), *cols], [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    shape = f"`{id_col}` {dict(formatted.dtypes)['tree']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree", "formatted", "mask").mapInArrow(run, shape)
