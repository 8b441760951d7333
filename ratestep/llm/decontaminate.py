"""Benchmark decontamination: one Aho-Corasick automaton over pieces of the normalised test items.

Texts are normalised to " w1 w2 ... " (A-Z lowered, words joined by single spaces), so that a pattern with its outer
spaces only matches whole words. The automaton scans each text once; the windows around a match are looked up among those of the
items, turned into word positions and, for documents with hits, into code point offsets of the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestep.llm.textbytes import columns
from ratestep.runtime import Scratch, bounded_batches, ensure_importable

#: A word in a text that is not lowered yet.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_BUILT: dict[str, Automaton] = {}


def normalised(raw: bytes) -> bytes:
    return b" " + b" ".join(raw.translate(_NORMAL).split()) + b" "


def windows(text: str | None, size: int) -> list[bytes]:
    """The windows of an item, in order, words joined by single spaces."""
    words = (text or "").encode().translate(_NORMAL).split()
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


@dataclass
class Automaton:
    """Pieces of items in one Aho-Corasick automaton, and the windows that tell which items a piece stands for.

    An item is cut into every ``piece``-th run of ``piece`` words. With ``size`` = 2 * ``piece`` - 1 every window holds such a run whole,
    so that a match of one, looked at in the few windows around it, finds all windows, and the automaton has a node for about every
    byte of the items instead of one for every byte of every window. Items of fewer than ``size`` words are patterns whole.
    """

    tree: ahocorasick.Automaton
    names: list[str]
    windows: dict[bytes, tuple[int, ...]]
    size: int
    piece: int


def automaton(items: list[tuple[str, str | None]], size: int) -> Automaton:
    names = sorted({i for i, _ in items})
    at = {x: k for k, x in enumerate(names)}
    piece = (size + 1) // 2
    found: dict[bytes, tuple[int, ...]] = {}
    tree = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for item, text in items:
        every = windows(text, size)
        for w in every:
            who = found.get(w, ())
            if at[item] not in who:
                found[w] = (*who, at[item])
        words = (text or "").encode().translate(_NORMAL).split()
        if len(words) < size:
            cut = every
        else:
            cut = [b" ".join(words[i : i + piece]) for i in range(0, len(words) - piece + 1, piece)]
        for w in cut:
            tree.add_word(f" {w.decode('latin-1')} ", w.count(b" ") + 1)
    if len(tree):
        tree.make_automaton()
    return Automaton(tree, names, found, size, piece)


def scan(a: Automaton, text: bytes) -> tuple[int, list[tuple[int, int]], list[int]]:
    """Words of the text, merged runs of hit words (first, end), and the positions of the items found."""
    words = text.translate(_NORMAL).split()
    if not words or not len(a.tree):
        return len(words), [], []
    flat = b" " + b" ".join(words) + b" "
    runs, who, gaps, seen = [], set(), None, set()
    for end, n in a.tree.iter(flat.decode("latin-1")):
        if gaps is None:
            gaps = np.flatnonzero(np.frombuffer(flat, dtype=np.uint8) == 32)
        last = int(np.searchsorted(gaps, end))
        # The match as a short item, and every window around it.
        around = [(last - n, n)] if n < a.size else []
        around += [(x, a.size) for x in range(max(0, last - a.size), min(last - n, len(words) - a.size) + 1)]
        for span in around:
            if span in seen:
                continue
            seen.add(span)
            if hit := a.windows.get(b" ".join(words[span[0] : span[0] + span[1]])):
                runs.append((span[0], span[0] + span[1]))
                who.update(hit)
    return len(words), merged(runs), sorted(who)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of runs, in order; runs that touch are one."""
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans in the original text of runs of words."""
    spans = [m.span() for m in WORD.finditer(text)]
    return [(spans[lo][0], spans[hi - 1][1]) for lo, hi in runs]


def item_blocks(items: DataFrame, item_col: str, text_col: str, max_chars: int) -> list[DataFrame]:
    """Test items (i, t) in blocks of about ``max_chars``, to be collected one at a time; only the size is read here."""
    known = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    chars = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(chars) // max_chars))
    return [known.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k) for k in range(n)]


def _scanner(shared, key: str, size: int, kept: list[str], text_col: str, last: bool):
    """One pass over the rows; all but the first bring the runs and items of the passes before, all but the last hand the text on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = automaton(shared.value, size)
        a = _BUILT[key]
        for batch in batches:
            data, off, _ = columns(batch, text_col)
            raw = data.tobytes()
            before = zip(*(batch.column(c).to_pylist() for c in ("runs", "items")), strict=True) if "runs" in batch.schema.names else [((), ())] * batch.num_rows
            n, runs, spans, who = [], [], [], []
            for k, (old, named) in enumerate(before):
                count, hit, items = scan(a, raw[off[k] : off[k + 1]])
                if old:
                    hit = merged([*hit, *((x["first"], x["end"]) for x in old)])
                n.append(count)
                runs.append([{"first": x, "end": y} for x, y in hit])
                spans.append([{"start": x, "end": y} for x, y in offsets(raw[off[k] : off[k + 1]].decode(), hit)] if hit and last else [])
                who.append(sorted({*named, *(a.names[i] for i in items)}))
            pair = lambda x, y: pa.list_(pa.struct([(x, pa.int64()), (y, pa.int64())]))
            more = pa.array(spans, pair("start", "end")) if last else batch.column(text_col)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(runs, pair("first", "end")), more, pa.array(who, pa.list_(pa.string()))],
                [*kept, "n_words", "runs", "spans" if last else text_col, "items"],
            )

    return run


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 13,
    max_chars: int = 4_000_000,
    min_share: int = 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """A row for each row of ``docs``: ``keep`` (the id by default), its words, hit words, the items found, spans in the original text, and a verdict.

    A document is contaminated if ``min_share`` * n_hit >= n_words and n_hit > 0. Null and empty texts have no words. Items
    without words and items with a null id find nothing; items that repeat count once; an empty ``items`` table leaves
    every document clean. Items are held by every worker, in one automaton as long as their texts have no
    more than ``max_chars`` bytes (about 100 bytes of memory for each of them). Larger sets are scanned in several passes of about that size: every row carries its text and its hits
    from pass to pass in a written table, so ids may repeat or be null, and only one block is held at a time. All passes but the last run at once. Names in ``keep`` that clash with the added ones are replaced; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ensure_importable(spark)
    added = ("n_words", "n_hit", "n_items", "items_sha256", "spans", "items", "runs", "contaminated")
    kept = [c for c in (keep or [id_col]) if c not in added]
    kinds = dict(docs.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    runs, found_items = "n_words long, runs array<struct<first:long,end:long>>", "items array<string>"
    # The text has a name of its own on the way, whatever the names in ``keep``.
    text = f"text_{uuid.uuid4().hex}"
    found = docs.select(*dict.fromkeys(kept), F.col(text_col).alias(text))
    blocks = item_blocks(items, item_col, item_text_col, max_chars)
    scratch = Scratch(spark, "contamination") if len(blocks) > 1 else None
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        shared = spark.sparkContext.broadcast([(r.i, r.t) for r in block.collect()])
        more = "spans array<struct<start:long,end:long>>" if last else f"`{text}` {kinds[text_col]}"
        out = found.mapInArrow(_scanner(shared, uuid.uuid4().hex, size, kept, text, last), f"{shape}, {runs}, {more}, {found_items}")
        if not last:
            out = scratch.cut(out, "pass")
            shared.destroy()
            scratch.drop(found)
        found = out
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["first"])
    names = F.array_sort("items")
    return found.select(
        *kept,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        "spans",
        names.alias("items"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (min_share * F.col("n_hit") >= F.col("n_words")))

