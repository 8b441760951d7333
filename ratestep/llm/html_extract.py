"""Main text of pages by a recurrent block labeller: a bidirectional LSTM in numpy over the leaf sequence of a page.

Each block gives hashed features of its tag path (elements, their class and id words, neighbouring pairs), hashed words,
and a few numbers. The network reads the whole sequence in both directions, so every label sees the whole page. It is
trained here, on pages that ``training_pages`` composes with known labels from many layouts.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestep.llm.html_blocks import Block, Node, blocks
from ratestep.llm.textbytes import LOWER, U64, span_hashes, word_spans
from ratestep.runtime import bounded_batches, ensure_importable

PATH, WORDS, PLAIN = 96, 32, 8
SIZE = PATH + WORDS + PLAIN
_SEP = np.ones(256, dtype=bool)
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _put(v: np.ndarray, key: str, x: float) -> None:
    h = zlib.crc32(key.encode())
    v[h % PATH] += x if h >> 16 & 1 else -x


def _chain(node: Node) -> np.ndarray:
    """Signed hashes of a node and its ancestors, each a half: what all paths through the node have in common. Kept in the nodes."""
    todo = []
    while node is not None and node.vector is None:
        todo.append(node)
        node = node.parent
    v = node.vector[0] if node is not None else np.zeros(PATH, dtype=np.float32)
    for node in reversed(todo):
        v = v.copy()
        _put(v, f"t:{node.tag}", 0.5)
        if node.parent is not None:
            _put(v, f"{node.tag}<{node.parent.tag}", 0.5)
        for name in dict.fromkeys(node.names):
            _put(v, f"n:{name}", 1.5)
        node.vector = [v, None]
    return v


def path_vector(node: Node | None) -> np.ndarray:
    """Signed hashes of the path's elements; the nearest four count most."""
    if node is None:
        return np.zeros(PATH, dtype=np.float32)
    _chain(node)
    if node.vector[1] is None:
        v = node.vector[0].copy()
        _put(v, f"<{node.tag}", 1.0)
        _put(v, f"leaf:{node.tag}", 1.0)
        at, last = node, ""
        for _ in range(4):
            _put(v, f"t:{at.tag}", 0.5)
            if last:
                _put(v, f"{last}<{at.tag}", 0.5)
            at, last = at.parent, at.tag
            if at is None:
                break
        node.vector[1] = v
    return node.vector[1]


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """(blocks, SIZE) of each page."""
    every = [b for p in pages for b in p]
    if not every:
        return [np.zeros((0, SIZE), dtype=np.float32) for _ in pages]
    raw = [b.text.encode() for b in every]
    off = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    data = LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    b, e, row = word_spans(data, off[:-1], _SEP)
    h = mixed = span_hashes(data, b, e) if len(b) else np.zeros(0, dtype=U64)
    slot = (mixed >> U64(59)).astype(np.int64)
    sign = np.where((h >> U64(58) & U64(1)).astype(bool), 1.0, -1.0)
    n = np.bincount(row, minlength=len(every)).astype(np.float64)
    digits = np.add.reduceat(np.r_[_DIGIT[data], 0], off[:-1], dtype=np.int64)  # every block has text
    words = np.bincount(row * WORDS + slot, weights=sign, minlength=len(every) * WORDS).reshape(-1, WORDS)
    x = np.zeros((len(every), SIZE), dtype=np.float32)
    x[:, PATH : PATH + WORDS] = words / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1)
    k = 0
    for p in pages:
        for i, blk in enumerate(p):
            x[k, :PATH] = path_vector(blk.node)
            chars = len(blk.text)
            x[k, PATH + WORDS :] = (
                np.log1p(chars) / 5, np.log1p(n[k]) / 4, blk.linked, sum(map(blk.text.count, ".!?")) / max(1.0, n[k]), blk.depth / 8,
                i / len(p), blk.text[:1] in "©®", digits[k] / max(1, chars),
            )
            k += 1
    cut = np.cumsum([len(p) for p in pages])[:-1]
    return np.split(x, cut)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Two LSTMs of ``hidden`` units, one for each direction, and a logistic output."""

    def __init__(self, hidden: int = 20, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.par = {}
        for d in "fb":
            self.par[f"x{d}"] = (rng.normal(0, 1, (SIZE, 4 * hidden)) / np.sqrt(SIZE)).astype(np.float32)
            self.par[f"h{d}"] = (rng.normal(0, 1, (hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.par[f"c{d}"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)].astype(np.float32)
        self.par["out"] = (rng.normal(0, 1, (2 * hidden, 1)) / np.sqrt(2 * hidden)).astype(np.float32)
        self.par["bias"] = np.zeros(1, dtype=np.float32)

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States of one direction over (time, batch, SIZE)."""
        n, t = x.shape[1], self.hidden
        z = (x.reshape(-1, SIZE) @ self.par[f"x{d}"]).reshape(len(x), n, 4 * t) + self.par[f"c{d}"]
        h, c = np.zeros((n, t), dtype=np.float32), np.zeros((n, t), dtype=np.float32)
        states, kept = np.empty((len(x), n, t), dtype=np.float32), []
        for k in range(len(x)):
            a = z[k] + h @ self.par[f"h{d}"]
            s = _sigmoid(a[:, : 3 * t])
            g = np.tanh(a[:, 3 * t :])
            before, was = c, h
            c = s[:, t : 2 * t] * c + s[:, :t] * g
            tc = np.tanh(c)
            h = s[:, 2 * t : 3 * t] * tc
            states[k] = h
            kept.append((s, g, before, was, tc))
        return states, kept

    def _back(self, x: np.ndarray, d: str, kept: list, grad: np.ndarray, into: dict) -> None:
        t = self.hidden
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        dz = np.empty((len(x), x.shape[1], 4 * t), dtype=np.float32)
        for k in range(len(x) - 1, -1, -1):
            s, g, before, was, tc = kept[k]
            dh = dh + grad[k]
            dc = dc + dh * s[:, 2 * t :] * (1 - tc * tc)
            ds = np.concatenate([dc * g, dc * before, dh * tc], axis=1) * s * (1 - s)
            dz[k] = np.concatenate([ds, dc * s[:, :t] * (1 - g * g)], axis=1)
            into[f"h{d}"] += was.T @ dz[k]
            dh = dz[k] @ self.par[f"h{d}"].T
            dc = dc * s[:, t : 2 * t]
        into[f"x{d}"] += x.reshape(-1, SIZE).T @ dz.reshape(-1, 4 * t)
        into[f"c{d}"] += dz.sum((0, 1))

    @staticmethod
    def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequences side by side, forwards and backwards, and where each place of the one is in the other."""
        n = max(map(len, seqs))
        x = np.zeros((n, len(seqs), SIZE), dtype=np.float32)
        y = np.zeros_like(x)
        flip = np.tile(np.arange(n)[:, None], (1, len(seqs)))
        for k, s in enumerate(seqs):
            x[: len(s), k], y[: len(s), k] = s, s[::-1]
            flip[: len(s), k] = np.arange(len(s))[::-1]
        return x, y, flip

    def logits(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
        x, y, flip = self._padded(seqs)
        hf, kf = self._run(x, "f")
        hb, kb = self._run(y, "b")
        both = np.concatenate([hf, np.take_along_axis(hb, flip[:, :, None], 0)], axis=2)
        return (both @ self.par["out"])[:, :, 0] + self.par["bias"], (x, y, flip, kf, kb, both)

    def predict(self, seqs: list[np.ndarray], cells: int = 1 << 14) -> list[np.ndarray]:
        """Probability of main text of each block; pages of like lengths are run side by side."""
        out: list[np.ndarray] = [np.zeros(0)] * len(seqs)
        order, i = sorted((k for k in range(len(seqs)) if len(seqs[k])), key=lambda k: len(seqs[k])), 0
        while i < len(order):
            j = i + 1
            while j < len(order) and len(seqs[order[j]]) * (j + 1 - i) <= cells:
                j += 1
            z, _ = self.logits([seqs[k] for k in order[i:j]])
            for c, k in enumerate(order[i:j]):
                out[k] = _sigmoid(z[: len(seqs[k]), c])
            i = j
        return out

    def fit(self, seqs: list[np.ndarray], labels: list[np.ndarray], epochs: int = 16, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Labeller:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.par.items()}
        v = {k: np.zeros_like(p) for k, p in self.par.items()}
        t = 0
        for epoch in range(epochs):
            # Pages of like lengths share a batch; the batches come in random order.
            order = rng.permutation(len(seqs))
            order = order[np.argsort([len(seqs[k]) + rng.integers(0, 4) for k in order], kind="stable")]
            for i in rng.permutation(range(0, len(order), batch)):
                part = order[i : i + batch]
                z, (x, y, flip, kf, kb, both) = self.logits([seqs[k] for k in part])
                want, mask = np.zeros_like(z), np.zeros_like(z)
                for c, k in enumerate(part):
                    want[: len(labels[k]), c], mask[: len(labels[k]), c] = labels[k], 1
                dz = ((_sigmoid(z) - want) * mask / mask.sum()).astype(np.float32)[:, :, None]
                into = {k: np.zeros_like(p) for k, p in self.par.items()}
                into["out"] = np.tensordot(both, dz, axes=([0, 1], [0, 1]))
                into["bias"] = dz.sum((0, 1))
                grad = dz @ self.par["out"].T
                self._back(x, "f", kf, grad[:, :, : self.hidden], into)
                self._back(y, "b", kb, np.take_along_axis(grad[:, :, self.hidden :], flip[:, :, None], 0), into)
                t += 1
                step = rate * (1 - epoch / epochs) ** 0.5 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
                for k, g in into.items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.par[k] -= step * m[k] / (np.sqrt(v[k]) + 1e-8)
        return self


def training_pages(n: int, seed: int = 11) -> Iterator[tuple[str, list[str]]]:
    """Pages of many layouts with the texts of their main blocks, composed from random words."""
    rng = np.random.default_rng(seed)
    syll = "ba be bi bo da de di do fa fi ka ke ko la le li lo ma me mi mo na ne no ra re ri ro sa se si so ta te ti to va ve vi é ü ß ñ ch tion ing".split()
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick(syll) for _ in range(int(rng.integers(1, 4))))
    words = lambda lo, hi: " ".join(word() for _ in range(int(rng.integers(lo, hi + 1))))
    chance = lambda p: rng.random() < p

    def sentence(lo: int = 3, hi: int = 14) -> str:
        s = words(lo, hi).capitalize() + pick([".", ".", "!", "?", "", "!!"])
        return s.upper() if chance(0.1) else s

    def prose() -> str:
        return " ".join(sentence() for _ in range(int(rng.integers(1, 7))))

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{words(1, 3).capitalize()}</a></{tag}>' for _ in range(k))

    def boiler(kind: str) -> str:
        k = int(rng.integers(1, 7))
        said = lambda xs: f"{pick(xs)} {words(0, 5)}".strip()
        if kind == "nav":
            return pick([
                f"<nav><ul>{links(k)}</ul></nav>", f'<ul class="{pick(["menu", "nav", "navbar", "breadcrumb", "pagination"])}">{links(k)}</ul>',
                f'<div id="{pick(["nav", "menu", "navigation", "topbar"])}">{links(k, "span")}</div>', f'<div role="navigation">{links(k, "p")}</div>',
            ])
        if kind == "header":
            return pick([f"<header><p>{words(1, 6)}</p></header>", f'<div class="{pick(["header", "site-header", "masthead", "logo"])}">{words(1, 8)}</div>', f"<header><h1>{words(1, 4)}</h1><nav>{links(k)}</nav></header>"])
        if kind == "footer":
            c = pick(["&copy;", "©", "Copyright", ""])
            return pick([f"<footer>{c} {words(1, 6)} &middot; {prose()}</footer>", f'<div class="{pick(["footer", "site-footer", "copyright", "colophon"])}"><p>{c} {words(1, 12)}</p></div>', f"<footer><ul>{links(k)}</ul><p>{c} {prose()}</p></footer>"])
        if kind == "side":
            body = pick([f"<h3>{words(1, 4)}</h3><ul>{links(k)}</ul>", f"<p>{prose()}</p>", f"<h2>{words(1, 3)}</h2><p>{prose()}</p><p>{prose()}</p>"])
            return pick([f"<aside>{body}</aside>", f'<div class="{pick(["sidebar", "widget", "related", "rail"])}">{body}</div>', f'<section class="{pick(["sidebar", "related-posts", "trending"])}">{body}</section>'])
        if kind == "notice":
            return f'<div class="{pick(["notice", "cookie", "cookie-banner", "alert", "consent", "gdpr", "notification", "message"])}"><p>{said(["Cookies", "We use cookies", "Notice:", "Please accept", prose()])}</p>{pick(["", "<button>OK</button>"])}</div>'
        if kind == "ad":
            return pick([f'<div class="{pick(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"])}">{pick([words(2, 12), prose(), f"<p>{prose()}</p>"])}</div>', f'<aside class="ad"><p>{prose()}</p></aside>', f'<div id="ad-{k}">{prose()}</div>'])
        if kind == "form":
            return pick([f'<form action="/{word()}"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button></form>', f'<form class="{pick(["search", "newsletter", "login", "subscribe"])}"><p>{sentence()}</p><select><option>{word()}</option><option>{word()}</option></select></form>', f"<form><fieldset><legend>{words(1, 3)}</legend><p>{prose()}</p></fieldset></form>"])
        said = "".join(f'<{t}{pick(["", " class=comment"])}><p>{prose()}</p></{t}>' for t in [pick(["li", "div", "article"])] for _ in range(k))
        return pick([f'<section class="comments"><h2>{words(1, 3)}</h2>{said}</section>', f'<div id="comments">{said}</div>', f'<ol class="{pick(["commentlist", "comments", "replies"])}">{said}</ol>'])

    def main() -> tuple[str, list[str]]:
        texts: list[str] = []

        def own(tag: str, text: str, wrap: str = "") -> str:
            texts.append(" ".join(text.split()))
            head, tail = (f"<{wrap}>", f"</{wrap}>" if chance(0.8) else "") if wrap else ("", "")
            return f"<{tag}>{head}{text}{tail}" + ("" if tag == "p" and chance(0.1) else f"</{tag}>")

        out = [own("h1", words(2, 8))] if chance(0.85) else []
        inner = lambda kind: boiler(kind) if chance(0.06) else ""
        # A few articles are long, and some of those repeat themselves.
        n, plain = (int(rng.integers(60, 300)), 1.0 if chance(0.5) else 0.7) if chance(0.05) else (int(rng.integers(1, 9)), 0.7)
        again = prose() if plain == 1.0 and chance(0.5) else None
        for _ in range(n):
            r = rng.random()
            if again:
                out.append(own("p", again))
                continue
            if r < plain:
                out.append(own("p", prose(), pick(["", "", "", "b", "em", "span"])))
            elif r < 0.78:
                out.append(own(pick(["h2", "h3"]), words(1, 6)))
            elif r < 0.86:
                tag = pick(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(own("li", sentence()) for _ in range(int(rng.integers(1, 5)))) + f"</{tag}>")
            elif r < 0.91:
                out.append(f"<blockquote>{own('p', prose())}</blockquote>")
            elif r < 0.95:
                out.append("<table>" + "".join("<tr>" + own("td", words(1, 3)) + own("td", words(1, 3)) + "</tr>" for _ in range(int(rng.integers(1, 4)))) + "</table>")
            else:
                out.append(own("pre", prose()) if chance(0.5) else f"<figure>{own('figcaption', sentence())}</figure>")
            out.append(inner(pick(["ad", "side", "form", "notice"])))
        body = "".join(out)
        wrap = pick(["article"] * 5 + ["main", "main+article", "div:content", "div:post", "div:entry-content", "div:article-body", "div:main", "section:story", "id:content", "id:main", "body"])
        if wrap == "main+article":
            return f"<main><article>{body}</article></main>", texts
        if wrap == "body":
            return body, texts
        tag, _, name = wrap.partition(":")
        if tag == "id":
            return f'<div id="{name}">{body}</div>', texts
        return (f'<{tag} class="{name}">{body}</{tag}>' if name else f"<{tag}>{body}</{tag}>"), texts

    for _ in range(n):
        before = [boiler(x) for x in ("notice", "header", "nav", "ad", "form", "side") if chance(0.45)]
        after = [boiler(x) for x in ("ad", "comments", "form", "side", "notice") if chance(0.35)]
        body, texts = main()
        if chance(0.05):
            body, texts = "", []
        foot = boiler("footer") if chance(0.85) else ""
        middle = "".join([*before, body, *after])
        middle = (middle if chance(0.7) else f"<div class=wrap>{middle}</div>") + foot
        yield middle if chance(0.15) else f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{middle}</body></html>", texts


def labelled(page: str, texts: list[str]) -> tuple[list[Block], np.ndarray]:
    """Blocks of a composed page; the main ones are found in order."""
    found, y, k = blocks(page), [], 0
    for b in found:
        hit = k < len(texts) and b.text == texts[k]
        k += hit
        y.append(float(hit))
    return found, np.array(y, dtype=np.float32)


@functools.lru_cache(maxsize=1)
def trained(pages: int = 1200) -> Labeller:
    made = [labelled(*x) for x in training_pages(pages)]
    made = [x for x in made if x[0]]
    return Labeller().fit(vectors([x[0] for x in made]), [x[1] for x in made])


def extract_all(pages: list[str], model: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n\n".join(b.text for b, x in zip(f, p, strict=True) if x >= 0.5) for f, p in zip(found, model.predict(vectors(found)), strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each row: the blocks labelled main text, joined by two line feeds.

    A null or empty page, and one without main text, gives an empty text. Rows that repeat get equal texts; other
    columns, of whatever names, are not read. Pages of any length are read whole.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(model or trained())
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for i in range(0, batch.num_rows, 256):
                texts += extract_all([x or "" for x in batch.column(2).slice(i, 256).to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long")
