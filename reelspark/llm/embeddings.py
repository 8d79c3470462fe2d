"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector is rotated at random and kept as one bit a dimension, with its inner product with that code as
a correction factor; the other side of a pair is the rotated vector in bytes. The corrected product is an
unbiased estimate of the cosine with a known spread, so a confidence bound tells which pairs can reach the
threshold; only those are recomputed in double precision. Bits of further rotations key the tables in which
pairs meet: their number follows the number of vectors, and the number of tables the wanted recall. A task
settles its pairs itself and sends on what follows from them, counts of links and a spanning forest, so nothing
grows with the square of a group's size but the work on it, which is dealt out in tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import Forest
from .common import cut, prepare, shuffle_parts
from .components import components

#: Chance that a pair right at the threshold meets in no table; closer pairs are missed far more rarely.
MISS = 1e-4
#: Width of the confidence bound in standard errors.
SIGMAS = 5.0
#: A larger group of one key is compared as pairs of tiles of about this size.
TILE = 2048
ROWS_A_TASK = 60_000


def tables_for(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` vectors; without any miss all of a label share one key."""
    if not miss:
        return 0, 1
    p = 1 - math.acos(threshold) / math.pi
    bits = min(40, max(6, math.ceil(math.log2(max(n, 2) / 16))))
    return bits, math.ceil(math.log(miss) / math.log(1 - p**bits))


def rotation(dim: int, number: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _vectors(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix for each length of vector."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat, size = col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy()
    at = np.cumsum(size) - size
    return [(rows, flat[at[rows][:, None] + np.arange(d)].astype(np.float64)) for d in np.unique(size) for rows in [np.flatnonzero(size == d)]]


def encode(classes: DataFrame, bits: int, tables: int, seed: int, small: bool) -> DataFrame:
    """(rep, label, n, dim, v, keys, packed) of (rep, label, n, v): the vector as bytes, its key in each table, all key bits."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rep, label, n = (b.column(c) for c in ("rep", "label", "n"))
            for rows, raw in _vectors(b.column("v")):
                dim, many = raw.shape[1], len(rows)
                x = raw / np.abs(raw).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                turned = [x @ rotation(dim, r, seed) > 0 for r in range(1, 1 + -(-bits * tables // dim))]
                key_bits = np.concatenate([np.zeros((many, 0), bool), *turned], axis=1)[:, : bits * tables]
                keys = (key_bits.reshape(many, tables, bits).astype(np.int64) << np.arange(bits)).sum(axis=2)
                packed, at = np.packbits(key_bits, axis=1), pa.array(rows)
                data = raw.astype(np.float32 if small else np.float64)
                yield pa.RecordBatch.from_arrays(
                    [rep.take(at), label.take(at), n.take(at), pa.array(np.full(many, dim, np.int32)), pa.array([r.tobytes() for r in data], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, many * tables + 1, tables, dtype=np.int32)), pa.array(keys.reshape(-1))), pa.array([r.tobytes() for r in packed], pa.binary())],
                    ["rep", "label", "n", "dim", "v", "keys", "packed"],
                )

    return classes.select("rep", "label", "n", "v").mapInArrow(run, "rep bigint, label bigint, n bigint, dim int, v binary, keys array<bigint>, packed binary")


class Estimates:
    """Rotated vectors as signs with a correction factor, and as bytes with a scale."""

    def __init__(self, raw: np.ndarray, seed: int):
        x = raw / np.abs(raw).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        o = x @ rotation(raw.shape[1], 0, seed)
        self.dim = raw.shape[1]
        self.factor = np.abs(o).sum(axis=1) / math.sqrt(self.dim)
        self.scale = np.abs(o).max(axis=1) / 127
        self.bytes = np.rint(o / self.scale[:, None]).astype(np.int8)
        self.sign = (o > 0).astype(np.int8) * 2 - 1
        self.spread = SIGMAS * np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor / math.sqrt(max(self.dim - 1, 1))

    def upper(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bounds of the cosines, from the signs of ``i`` and the bytes of ``j``."""
        dot = np.einsum("ij,ij->i", self.sign[i], self.bytes[j], dtype=np.float32) * self.scale[j] / math.sqrt(self.dim)
        off = self.scale[j] * math.sqrt(self.dim) / 2 / self.factor[i]  # what rounding to bytes may take away
        return dot / self.factor[i] + self.spread[i] + off


def links(coded: DataFrame, threshold: float, bits: int, tables: int, total: int, seed: int, small: bool) -> DataFrame:
    """Rows (a, b, far) of all pairs whose cosine in double precision reaches the threshold.

    With ``b`` null, ``far`` is how many rows of other classes a task has found to link with ``a``; over all
    tasks each pair counts once, in the first table that it meets in. Else (a, b) is an edge of a spanning forest.
    """
    group = ["label", "dim", "t", "key"]
    large = cut(coded.select("label", "dim", F.posexplode("keys").alias("t", "key")).groupBy(*group).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 2 * TILE))
    rows = coded.select("rep", "label", "n", "dim", "v", "packed", F.posexplode("keys").alias("t", "key"))
    none = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own")))
    if large.isEmpty():
        tiled = rows.withColumn("tile", F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own")))
    else:
        tiles = F.ceil(F.col("size") / TILE).cast("int")
        own = F.pmod(F.xxhash64("rep"), tiles).cast("int")
        meets = F.transform(F.sequence(F.lit(0), tiles - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"), own.alias("own")))
        tiled = rows.join(large, group, "left").withColumn("tile", F.explode(F.when(F.col("size").isNull(), none).otherwise(meets))).drop("size")
    parts = max(shuffle_parts(coded), total * tables // ROWS_A_TASK)
    dealt = tiled.select(*group, "rep", "n", "v", "packed", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), F.col("tile.own").alias("own")).repartition(parts, *group, "i", "j")

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        col = lambda c: t.column(c).to_numpy()
        order = np.lexsort((col("j"), col("i"), col("key"), col("t"), col("dim"), col("label")))
        t = t.take(pa.array(order))
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for c in (*group, "i", "j"):
            x = col(c)
            new[1:] |= x[1:] != x[:-1]
        gid = np.cumsum(new)
        size = np.bincount(gid)
        table_no, dim, own, cross = col("t"), col("dim"), col("own"), col("i") != col("j")
        weight, names = col("n"), np.unique(col("rep"))
        local = np.searchsorted(names, col("rep"))
        far, forest, kept = np.zeros(len(names), np.int64), Forest(len(names)), []
        v, packed = t.column("v"), t.column("packed")
        for d in np.unique(dim):
            mine = np.flatnonzero((dim == d) & (size[gid] > 1))
            if len(mine) < 2:
                continue
            at, g = pa.array(mine), gid[mine]
            raw = np.frombuffer(b"".join(v.take(at).to_pylist()), np.float32 if small else np.float64).reshape(len(mine), d).astype(np.float64)
            key_bits = np.frombuffer(b"".join(packed.take(at).to_pylist()), np.uint8).reshape(len(mine), -1)
            est, norm = Estimates(raw, seed), np.sqrt(np.einsum("ij,ij->i", raw, raw))
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            count = np.diff(np.r_[first, len(g)])
            end = np.repeat(first + count, count)
            for shift in range(1, int(count.max())):
                left = np.flatnonzero(np.arange(len(g)) + shift < end)
                for lo in range(0, len(left), 100_000):
                    i = left[lo : lo + 100_000]
                    j = i + shift
                    ri, rj = mine[i], mine[j]
                    ok = ~cross[ri] | (own[ri] != own[rj])
                    i, j = i[ok], j[ok]
                    ok = est.upper(i, j) >= threshold
                    i, j = i[ok], j[ok]
                    ok = est.upper(j, i) >= threshold
                    i, j = i[ok], j[ok]
                    if not len(i):
                        continue
                    ok = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= threshold
                    i, j = i[ok], j[ok]
                    if not len(i):
                        continue
                    if bits:  # a pair counts in the first table that it meets in
                        apart = np.unpackbits(key_bits[i] ^ key_bits[j], axis=1, count=bits * tables).reshape(len(i), tables, bits).any(axis=2)
                        ok = (~apart).argmax(axis=1) == table_no[mine[i]]
                        i, j = i[ok], j[ok]
                    ri, rj = mine[i], mine[j]
                    np.add.at(far, local[ri], weight[rj])
                    np.add.at(far, local[rj], weight[ri])
                    kept += forest.spanning(local[ri], local[rj])
        some = np.flatnonzero(far)
        edges = names[np.array(kept, dtype=np.int64).reshape(-1, 2)]
        nothing = pa.nulls(len(some), pa.int64())
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), nothing, pa.array(far[some])], ["a", "b", "far"])
        if len(edges):
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1]), pa.array(np.zeros(len(edges), np.int64))], ["a", "b", "far"])

    return dealt.mapInArrow(run, "a bigint, b bigint, far bigint")


def near_duplicates(df: DataFrame, *, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 7, miss: float = MISS) -> DataFrame:
    """Per row: id, ``n_links`` (other rows linked directly), ``component_id`` (least id reachable), ``kept``.

    Rows link if their labels are equal and not null and the cosine is ``threshold`` or more in double
    precision. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different length. Equal vectors of a label are one class, so copies are not expanded into
    pairs. A row with a null id links with nothing and is kept. Repeated rows count as separate rows; equal
    cosines at the threshold link. Empty input gives empty output; other columns are ignored.

    ``miss`` is the chance that a pair right at the threshold is not found; with 0 all pairs of a label are
    compared, in tiles, and the result is exact.
    """
    prepare(df.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    whole = dict(df.dtypes)[label_col] in ("tinyint", "smallint", "int", "bigint", "boolean")
    label = F.col(label_col).cast("bigint") if whole else F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))  # other labels by a hash
    rows = df.select(df[id_col].cast("long").alias("id"), label.alias("label"), v.alias("v"), fine.alias("fine"))
    rows = rows.withColumn("h0", F.xxhash64("label", "v")).withColumn("h1", F.xxhash64(F.lit(1), "v", "label"))
    classes = cut(rows.filter("fine and id is not null").groupBy("label", "h0", "h1").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")))
    # an id may name several vectors; classes need names of their own
    classes = cut(classes.withColumn("name", F.col("rep")).groupBy("rep").agg(F.collect_list(F.struct("label", "h0", "h1", "n", "v")).alias("all")).select("rep", F.posexplode("all").alias("no", "x")).select("rep", F.when(F.col("no") == 0, F.col("rep")).otherwise(F.xxhash64("rep", "x.h0", "x.h1")).alias("name"), "x.*"))
    total = classes.count()
    named = classes.select(F.col("name").alias("rep"), "label", "n", "v")
    bits, tables = tables_for(total, threshold, miss)
    small = "array<float>" in dict(df.dtypes)[vector_col]
    found = cut(links(cut(encode(named, bits, tables, seed, small)), threshold, bits, tables, total, seed, small))
    degree = found.filter("b is null").groupBy("a").agg(F.sum("far").alias("far"))
    # several classes of one id are the same node, as they share its name in the result
    ids = classes.select(F.col("name").alias("x"), F.col("rep").alias("y"))
    edges = found.filter("b is not null").join(ids.toDF("a", "ra"), "a").join(ids.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    found = components(edges)
    facts = classes.join(degree, classes["name"] == degree["a"], "left").join(found, classes["rep"] == found["node"], "left")
    facts = facts.select("h0", "h1", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("comp"))
    out = rows.select("id", "fine", "h0", "h1").join(facts.toDF("f0", "f1", "links", "comp"), F.col("fine") & F.col("id").isNotNull() & (F.col("h0") == F.col("f0")) & (F.col("h1") == F.col("f1")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "id").alias("component_id"), F.col("id").eqNullSafe(F.coalesce("comp", "id")).alias("kept"))
