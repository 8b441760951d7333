"""Change-point streams on all nodes of a hierarchy, pooled by how well each level has predicted lately.

The state of a tree is one group: its nodes' streams, and discounted log scores. After each interval every node's score is added to
its discounted sum; for a leaf, its ancestors are weighted as the bins that may hold it, and its predictive is their mixture,
each ancestor's rate shared out by exposure.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ratestep.functions.live import ChangePointStream
from ratestep.functions.special import logsumexp
from ratestep.runtime import ensure_importable


class PooledTree:
    """``parents`` maps node to parent (None for the root), ``exposure`` gives each leaf's share."""

    def __init__(self, parents: dict[str, str | None], exposure: dict[str, float], prior: tuple[float, float], expected_run_length: float, rho: float = 0.5, half_life: float | None = None):
        self.parents, self.rho, self.keep = parents, rho, 1.0 if half_life is None else 0.5 ** (1 / half_life)
        self.leaves = sorted(exposure)
        self.chain = {leaf: self._up(leaf) for leaf in self.leaves}
        self.size: dict[str, float] = {}
        for leaf, e in exposure.items():
            for n in self.chain[leaf]:
                self.size[n] = self.size.get(n, 0.0) + e
        self.children: dict[str, list[str]] = {}
        for n, p in parents.items():
            if p is not None and n in self.size:
                self.children.setdefault(p, []).append(n)
        self.order = sorted(self.size, key=lambda n: -len(self._up(n)))
        self.stream = {n: ChangePointStream.poisson(*prior, expected_run_length) for n in self.size}
        self.score = dict.fromkeys(self.size, 0.0)

    def _up(self, node: str) -> list[str]:
        out = [node]
        while (p := self.parents.get(out[-1])) is not None:
            out.append(p)
        return out

    def weights(self, leaf: str) -> dict[str, float]:
        """P(the bin that holds the leaf is this ancestor), from the root down."""
        z: dict[str, float] = {}
        for n in self.order:
            below = self.children.get(n)
            z[n] = self.score[n] if not below else float(np.logaddexp(np.log(self.rho) + self.score[n], np.log1p(-self.rho) + sum(z[c] for c in below)))
        out, reach = {}, 1.0
        for n in reversed(self.chain[leaf]):
            own = 1.0 if not self.children.get(n) else float(np.exp(np.log(self.rho) + self.score[n] - z[n]))
            out[n] = reach * own
            reach *= 1 - own
        return out

    def step(self, counts: dict[str, float]) -> list[tuple[str, float, float, float]]:
        """(leaf, count, log score alone, log score pooled) of an interval, then adds it. All leaves are taken as counted: missing ones are 0."""
        out = []
        for leaf in self.leaves:
            x = counts.get(leaf, 0.0)
            alone = float(self.stream[leaf].next_logpmf(x, self.size[leaf])[0])
            terms = [np.log(max(w, 1e-300)) + float(self.stream[n].next_logpmf(x, self.size[leaf])[0]) for n, w in self.weights(leaf).items()]
            out.append((leaf, x, alone, float(logsumexp(np.array(terms)))))
        total: dict[str, float] = {}
        for leaf in self.leaves:
            for n in self.chain[leaf]:
                total[n] = total.get(n, 0.0) + counts.get(leaf, 0.0)
        # A node as one bin scores all of its leaves: its own total, and how the total falls on equal rates.
        for n, s in self.stream.items():
            below = [leaf for leaf in self.leaves if n in self.chain[leaf]]
            self.score[n] = self.keep * self.score[n] + float(s.next_logpmf(total[n], self.size[n])[0]) + _multinomial([counts.get(x, 0.0) for x in below], [self.size[x] for x in below])
            s.update(total[n], self.size[n])
        return out


def _multinomial(x: list[float], e: list[float]) -> float:
    from ratestep.functions.special import lgamma, xlogy

    x, p = np.array(x), np.array(e) / sum(e)
    return float(lgamma(x.sum() + 1) - lgamma(x + 1).sum() + xlogy(x, p).sum())


_SHAPE = "tree string, n long, leaf string, y double, alone double, pooled double"
_NAMES = [c.split()[0] for c in _SHAPE.split(", ")]


def replay_pooled(rows: DataFrame, parents: dict[str, str | None], exposure: dict[str, float], prior: tuple[float, float], expected_run_length: float, **kw) -> DataFrame:
    """(tree, n, leaf, y, alone, pooled) of a table of rows (tree, n, leaf, y); rows of one interval and leaf are added up, gaps count as empty intervals."""
    ensure_importable(rows.sparkSession)

    def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tree, out, last = PooledTree(parents, exposure, prior, expected_run_length, **kw), [], None
        for n, part in frame.groupby("n"):
            for i in range(int(n) if last is None else last + 1, int(n) + 1):
                out += [(key[0], i, *x) for x in tree.step(part.groupby("leaf")["y"].sum().to_dict() if i == n else {})]
            last = int(n)
        return pd.DataFrame(out, columns=_NAMES)

    return rows.groupBy("tree").applyInPandas(whole, _SHAPE)


def watch_pooled(
    rows: DataFrame, parents: dict[str, str | None], exposure: dict[str, float], prior: tuple[float, float], expected_run_length: float, *, seconds: int = 3600, **kw
) -> DataFrame:
    """The same for a stream of rows (tree, ts, leaf, y) with a watermark on ``ts``: (tree, n, leaf, y, alone, pooled, late).

    Counts are held in the state until the watermark has passed the end of their interval of ``seconds``, so that an interval may come in any number of
    micro-batches. ``late`` is the total of a tree that came after its interval was closed and is in no count. A tree is one group, as its scores
    depend on all of its leaves; forests are spread by tree.
    """
    ensure_importable(rows.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tree, last, held, late = pickle.loads(state.get[0]) if state.exists else (PooledTree(parents, exposure, prior, expected_run_length, **kw), None, {}, 0.0)
        for f in frames:
            for (n, leaf), y in f.groupby(["n", "leaf"])["y"].sum().items():
                if last is not None and n <= last:
                    late += float(y)
                else:
                    own = held.setdefault(int(n), {})
                    own[leaf] = own.get(leaf, 0.0) + float(y)
        mark, out = state.getCurrentWatermarkMs(), []
        for n in sorted(n for n in held if (n + 1) * seconds * 1000 <= mark):
            for i in range(n if last is None else last + 1, n + 1):
                out += [(key[0], i, *x, late) for x in tree.step(held[n] if i == n else {})]
            last = n
            del held[n]
        if held:
            state.setTimeoutTimestamp(max((min(held) + 1) * seconds * 1000, mark + 1))
        state.update((pickle.dumps((tree, last, held, late)),))
        yield pd.DataFrame(out, columns=[*_NAMES, "late"])

    timed = rows.withColumn("n", F.floor(F.unix_timestamp("ts") / seconds).cast("long")).select("tree", "ts", "n", "leaf", F.col("y").cast("double").alias("y"))
    return timed.groupBy("tree").applyInPandasWithState(step, _SHAPE + ", late double", "blob binary", "append", GroupStateTimeout.EventTimeTimeout)
