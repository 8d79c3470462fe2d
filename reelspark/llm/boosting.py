"""Histogram gradient-boosted trees in numpy, flattened into arrays for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A model is fitted on at most so many labelled rows, those with the least hashed ids.
FIT_ROWS = 20_000


@dataclass(frozen=True)
class Trees:
    """All trees' nodes in shared arrays; a leaf points to itself."""

    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of ``x``."""
        out = np.full(len(x), self.base)
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            node = np.broadcast_to(self.root, (len(part), len(self.root))).copy()
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[row, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            out[lo : lo + 4096] += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: int = 10) -> Trees:
    """Logistic loss, second order, level by level on quantile bins. No rows give an even score."""
    n, m = x.shape
    mean = float(np.clip(y.mean(), 0.01, 0.99)) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    feature, cuts, left, right, value, roots = [0], [0.0], [0], [0], [0.0], []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, m), int)
    margin = np.full(n, base)
    if not n or y.min() == y.max():
        trees = 0
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        ids = [len(feature)]
        roots.append(ids[0])
        for kept in ((feature, 0), (cuts, 0.0), (left, ids[0]), (right, ids[0]), (value, 0.0)):
            kept[0].append(kept[1])
        for level in range(depth + 1):
            k = len(ids)
            gs, hs, cs = (np.bincount(node[node >= 0], weights=None if w is None else w[node >= 0], minlength=k) for w in (g, h, None))
            for i, at in enumerate(ids):
                value[at] = float(-rate * gs[i] / (hs[i] + l2))
            if level == depth:
                break
            live = node >= 0
            best, pick = np.full(k, 1e-6), np.full((k, 2), -1)
            for j in range(m):
                if not len(edges[j]):
                    continue
                flat = node[live] * bins + binned[live, j]
                hg, hh, hc = (np.bincount(flat, weights=None if w is None else w[live], minlength=k * bins).reshape(k, bins).cumsum(axis=1)[:, : len(edges[j])] for w in (g, h, None))
                gain = hg**2 / (hh + l2) + (gs[:, None] - hg) ** 2 / (hs[:, None] - hh + l2) - (gs**2 / (hs + l2))[:, None]
                gain[(hc < least) | (cs[:, None] - hc < least)] = -1
                b = gain.argmax(axis=1)
                v = gain[np.arange(k), b]
                better = v > best
                best[better], pick[better] = v[better], np.stack([np.full(k, j), b], axis=1)[better]
            nxt, moved = [], np.full(n, -1)
            for i, at in enumerate(ids):
                j, b = pick[i]
                if j < 0:
                    continue
                feature[at], cuts[at] = int(j), float(edges[j][b])
                inside = node == i
                low = binned[:, j] <= b
                for side, mask in ((left, inside & low), (right, inside & ~low)):
                    moved[mask] = len(nxt)
                    side[at] = len(feature)
                    nxt.append(len(feature))
                    for kept in ((feature, 0), (cuts, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
                        kept[0].append(kept[1])
            stay = (moved < 0) & live
            if stay.any():
                margin[stay] += np.array([value[i] for i in ids])[node[stay]]
            node, ids = moved, nxt
            if not ids:
                break
        if ids and (node >= 0).any():
            margin[node >= 0] += np.array([value[i] for i in ids])[node[node >= 0]]
    a = np.array
    return Trees(a(roots, dtype=np.int64), a(feature), a(cuts), a(left), a(right), a(value), depth, base)


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0; null ids too."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def about(id_col: Column, rows: int, total: int) -> Column:
    """Keeps a tenth more than ``rows`` of ``total`` ids, by their hashes, so that a limit after it moves little."""
    share = min(1.0, (1.1 * rows + 100) / max(total, 1))
    return F.pmod(F.xxhash64(F.lit("fit"), id_col), F.lit(1 << 30)) < int(share * (1 << 30))


def named(labels: DataFrame, id_col: str) -> DataFrame:
    """Labels whose id column has the name ``doc_id``."""
    return labels.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" and id_col in labels.columns else labels


def sampled(labels: DataFrame, label_col: str, rows: int) -> DataFrame:
    """(lid, y) of the labels that are not held out, about ``rows`` by the hashes of their ids."""
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("lid"), F.col(label_col).cast("double").alias("y"))
    return known.filter(about(F.col("lid"), rows, known.count()))


def training_rows(features: DataFrame, labels: DataFrame, label_col: str, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``rows`` rows of (id, f) with a label, not held out, by the least hashes of their ids."""
    known = sampled(labels, label_col, rows)
    got = features.join(known, features["id"] == known["lid"]).select(F.xxhash64("id").alias("o"), "id", "f", "y").orderBy("o", "id", "y", "f").limit(rows).toPandas()
    x = np.array(got["f"].tolist(), dtype=np.float64)
    return x.reshape(len(got), x.shape[1] if x.ndim == 2 else 1), got["y"].to_numpy(dtype=float)


def scored(features: DataFrame, model: Trees, at_least: float, id_col: str) -> DataFrame:
    """id, ``held_out``, ``score`` and ``predicted`` of (id, f)."""
    import pyarrow as pa

    shared = features.sparkSession.sparkContext.broadcast(model)  # bounded by trees and depth

    def run(batches):
        for b in batches:
            if b.num_rows:
                f = b.column("f")
                x = f.flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(shared.value.score(x))], ["id", "score"])

    out = features.select("id", "f").mapInArrow(run, "id bigint, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"))
