"""SimHash near-duplicate detection with bit-sliced comparison.

Documents become binary codes by majority vote over their shingles' hashes. Equal codes form one class, so
copies cost nothing further. Classes meet in tables keyed by part of the code, and within a table's
groups codes are compared bit-sliced (``bitslice``). Each task sends on a spanning forest of its links, and
the components of all links are the groups of near-duplicates. Where links are verified on the texts and some
fail, the texts that they connect are compared with each other (``_settled``). For similarity of shingle sets the
tables are keyed by least shingle hashes instead, so that groups do not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import Forest, close_pairs
from .common import cut, mix64, prepare, shuffle_parts, slices, utf8
from .components import components

SEED = 42


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words (ASCII lower case, one space between); of all words if fewer."""
    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)


def majority(h: np.ndarray) -> int:
    """The word whose bits are those set in over half of ``h``; zero if there are none."""
    n = len(h)
    if not n:
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = n // 255 * 255
    count = bits[whole:].sum(0, dtype=np.int64)
    if whole:  # sums of up to 255 bits fit a byte
        count += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0])


def codes(df: DataFrame, *, size: int, words: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``code``, an array of ``words`` longs of 64 bits each, of every row.

    The first word votes over the shingles' own hashes, each further one over hashes mixed anew; with
    ``distinct`` a repeated shingle votes once, so that codes follow the similarity of sets. Null and
    empty texts, and texts of white space only, have the zero code. One narrow pass over whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for t in b.column("text").to_pylist():
                h = shingle_hashes(t, size)
                if distinct:
                    h = np.unique(h)
                rows.append([majority(h if not w else mix64(h + np.uint64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))) for w in range(words)])
            flat = np.array(rows, dtype=np.uint64).reshape(-1).view(np.int64)
            code = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, words, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("id"), code], ["id", "code"])

    return df.select(df[id_col].cast("long").alias("id"), utf8(text_col).alias("text")).mapInArrow(run, "id bigint, code array<bigint>")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(radius: int, blocks: int, bits: int = 64) -> list[int]:
    """Masks of all choices of ``blocks - radius`` of the blocks: codes within the radius agree on one at least."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


#: A task gets about so many rows of the tables; a larger group of one key is compared as pairs of tiles.
ROWS_A_TASK, GROUP = 400_000, 8192


def links(classes: DataFrame, masks: list[int] | None = None, *, words: int, radii: tuple[int, ...]) -> DataFrame:
    """Pairs (a, b) of ``rep`` that join all classes which meet in a table and whose codes differ in ``radii[-1]`` bits or fewer.

    ``classes`` has ``rep`` and ``code``; rows meet where their codes agree on a mask or, without masks, where an
    entry of their column ``keys`` is the same. Groups of over ``2 * GROUP`` rows are dealt out as pairs of tiles.
    Within a task links are thinned to a spanning forest, which keeps every component and is no larger than the
    task's rows; it is built radius by radius, so that closer pairs come first. ``d`` is the radius at which a
    pair was found.
    """
    if masks is None:
        tables = F.posexplode("keys").alias("t", "key")
    else:
        split = [[_signed(m >> 64 * w & (1 << 64) - 1) for w in range(words)] for m in masks]
        tables = F.posexplode(F.array(*[F.xxhash64(F.lit(t), *[F.col("code")[w].bitwiseAND(F.lit(m).cast("long")) for w, m in enumerate(ms) if m]) for t, ms in enumerate(split)])).alias("t", "key")
        held = np.array([[m >> 64 * w & (1 << 64) - 1 for w in range(words)] for m in masks], dtype=np.uint64)
    rows = classes.select("rep", "code", tables)
    large = cut(classes.select(tables).groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * GROUP))
    if large.isEmpty():
        rows = rows.select("t", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep", "code")
    else:
        tiles = F.ceil(F.col("n") / GROUP).cast("int")
        own = F.pmod(F.xxhash64("rep"), tiles).cast("int")
        meets = F.transform(F.sequence(F.lit(0), tiles - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
        alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
        rows = rows.join(large, ["t", "key"], "left").withColumn("m", F.explode(F.when(F.col("n").isNull(), alone).otherwise(meets))).select("t", "key", "m.i", "m.j", "rep", "code")
    parts = max(shuffle_parts(classes), classes.count() * (len(masks) if masks else KEYS) // ROWS_A_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches([b.cast(schema) for b in batches if b.num_rows], schema)
        if not got.num_rows:
            return
        t, rep, i, j = (got.column(c).to_numpy() for c in ("t", "rep", "i", "j"))
        code = got.column("code").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, words)
        key = got.column("key").to_numpy()[:, None] if masks is None else code & held[t]
        order = np.lexsort((j, i, *key.T, t))
        t, key, i, j = t[order], key[order], i[order], j[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]).any(axis=1) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        group = np.cumsum(new)
        sizes = np.bincount(group)
        many = sizes[group] > 1
        order, group = order[many], group[many]
        if not len(order):
            return
        uniq, local = np.unique(rep[order], return_inverse=True)
        forest, kept = Forest(len(uniq)), []
        held_codes = np.ascontiguousarray(code[order])
        for radius in radii:
            for x, y in close_pairs(held_codes, group, radius):
                some = forest.apart(local[x], local[y])
                x, y = x[some], y[some]
                near = np.argsort(np.bitwise_count(held_codes[x] ^ held_codes[y]).sum(axis=1), kind="stable")  # closest first
                kept += [(a, b, radius) for a, b in forest.spanning(local[x[near]], local[y[near]])]
        if kept:
            kept = np.array(kept)
            pairs = uniq[kept[:, :2]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1)), pa.array(kept[:, 2])], ["a", "b", "d"])

    schema = pa.schema([("t", pa.int32()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("rep", pa.int64()), ("code", pa.list_(pa.int64()))])
    return rows.repartition(parts, "t", "key", "i", "j").mapInArrow(run, "a bigint, b bigint, d bigint").groupBy("a", "b").agg(F.min("d").alias("d"))


def near_duplicates(df: DataFrame, *, size: int = 5, words: int = 1, radius: int, masks: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``code`` and ``component_id``, the smallest id reachable by links, of every row.

    Rows without text share the zero code and are linked like any other. A null id forms a class of its own
    only by its code and never names a component while another id has that code. Repeated rows repeat in the
    result; empty input gives empty output; other columns are ignored.
    """
    prepare(df.sparkSession)
    coded = cut(codes(df, size=size, words=words, id_col=id_col, text_col=text_col))
    classes = coded.groupBy("code").agg(F.min("id").alias("rep"))
    classes = cut(classes)
    found = components(links(classes.filter("rep is not null"), masks, words=words, radii=(radius,)))
    named = classes.join(found, classes["rep"] == found["node"], "left").select(F.col("code").alias("c"), F.coalesce("component", "rep").alias("component_id"))
    return coded.join(named, coded["code"] == named["c"]).select(F.col("id").alias(id_col), "code", "component_id")


#: Of 256 bits: radii tried in turn, the last one far beyond what a similarity of 0.8 gives also for texts of few
#: shingles, whose codes scatter most.
WORDS, RADII = 4, (16, 36, 60, 80)
#: Tables in which texts meet, and how many minima make up a key. A pair right at a similarity of 0.8 meets in none of
#: them with a chance of (1 - 0.8 ** 4) ** 14 = 0.0006; keys have 64 bits, so a table's groups do not grow with the corpus
#: beyond texts that are alike.
KEYS, MINIMA = 14, 4
_DRAWN = np.random.default_rng(20).integers(0, 1 << 63, (2, KEYS * MINIMA), dtype=np.uint64)
FACTORS, SHIFTS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def table_keys(h: np.ndarray) -> np.ndarray:
    """One key a table of a set of shingle hashes: from the least hash under each of some permutations."""
    least = np.full(KEYS * MINIMA, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(h), 4096):
        least = np.minimum(least, (h[a : a + 4096, None] * FACTORS + SHIFTS).min(axis=0))
    key = np.zeros(KEYS, np.uint64)
    for m in range(MINIMA):
        key = mix64(key ^ least[m::MINIMA])
    return key


def sketches(df: DataFrame, *, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``code`` (``WORDS`` words, each shingle votes once), ``keys`` and two hashes of the shingle set, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            code, keys, s0, s1 = [], [], [], []
            for t in b.column("text").to_pylist():
                h = np.unique(shingle_hashes(t, size))
                code += [majority(h if not w else mix64(h + np.uint64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))) for w in range(WORDS)]
                keys.append(table_keys(h))
                whole = h.tobytes()
                s0.append(xxhash.xxh3_64_intdigest(whole))
                s1.append(xxhash.xxh64_intdigest(whole, 1))
            n = b.num_rows
            lists = lambda flat, k, n=n: pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(flat.view(np.int64)))
            word = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists(np.array(code, dtype=np.uint64), WORDS), lists(np.concatenate(keys), KEYS), word(s0), word(s1)], ["id", "code", "keys", "s0", "s1"])

    return df.select(df[id_col].cast("long").alias("id"), utf8(text_col).alias("text")).mapInArrow(run, "id bigint, code array<bigint>, keys array<bigint>, s0 bigint, s1 bigint")


def _sets(texts: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``id`` and ``s``, the sorted distinct shingle hashes as bytes, of the texts whose id is in ``ids``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [np.unique(shingle_hashes(t, size)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.binary())], ["id", "s"])

    return cut(texts.join(ids, "id", "left_semi").mapInArrow(sets, "id bigint, s binary"))


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b), and ``ok`` if their shingle sets have a Jaccard similarity of ``least`` or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = []
                for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both >= least * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    found = _sets(texts, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), size)
    side = lambda n: found.select(F.col("id").alias(n), F.col("s").alias(f"s{n}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(compare, "a bigint, b bigint, ok boolean")


#: Families are compared in tiles of about so many texts.
TILE = 256


def _tile_links(table: pa.Table, least: float) -> pa.Table:
    """Of one pair of tiles (or one tile against itself) a spanning forest of the similar texts that have different labels."""
    rep, lab = table.column("rep").to_numpy(), table.column("lab").to_numpy()
    first, second = (table.column(n).to_numpy(zero_copy_only=False).astype(bool) for n in ("first", "second"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    kinds, of = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    held = second[row]
    order = np.argsort(of[held], kind="stable")
    holders = row[held][order]  # rows of the second tile that hold a shingle, shingle by shingle
    begin = np.searchsorted(of[held][order], np.arange(len(kinds) + 1))
    begin, count = begin[:-1], np.diff(begin)
    at, forest, kept = np.r_[0, np.cumsum(size)], Forest(len(sets)), []
    for i in np.flatnonzero(first).tolist():
        mine = of[at[i] : at[i + 1]]
        n = count[mine]
        places = np.repeat(begin[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(holders[places], minlength=len(sets))
        near = np.flatnonzero((both > 0) & (both >= least * (size[i] + size - both)) & (lab != lab[i]))
        kept += forest.spanning(np.full(len(near), i), near)
    ends = np.array(kept, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": rep[ends[:, 0]], "b": rep[ends[:, 1]]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _settled(labels: DataFrame, checked: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """``labels`` (``rep``, ``lab``) with those made one whose texts are similar, though the pairs on the forests were not.

    A pair that fails has kept other pairs of its two trees out of the forest. Labels that failed pairs connect
    form a family; any candidate pair with two labels lies within one. All texts of a family are compared
    with all that have another label, in pairs of tiles: a label of ``TILE`` texts or more has tiles of its
    own, which are not compared with each other, the others share tiles.
    """
    side = lambda n: labels.select(F.col("rep").alias(n), F.col("lab").alias(f"l{n}"))
    failed = checked.filter(~F.col("ok")).join(side("a"), "a").join(side("b"), "b").filter("la <> lb")
    across = cut(failed.select("la", "lb").distinct())
    if across.isEmpty():
        return labels
    family = components(across, left="la", right="lb").select(F.col("node").alias("lab"), F.col("component").alias("fam"))
    members = cut(labels.join(family, "lab"))
    sizes = members.groupBy("fam", "lab").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.when(F.col("n") >= TILE, F.col("lab").cast("string")).otherwise(F.lit("")))
    groups = sizes.groupBy("fam", "g").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("parts"))
    placed = members.join(sizes.join(groups, ["fam", "g"]), ["fam", "lab"]).withColumn("k", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    placed = placed.join(_sets(texts, members.select(F.col("rep").alias("id")), size), F.col("rep") == F.col("id")).select("fam", "g", "k", "rep", "lab", "s")
    tiles = cut(groups.select("fam", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k")))
    tile = lambda n: tiles.select("fam", F.struct("g", "k").alias(n))
    meet = tile("x").join(tile("y"), "fam").filter("x <= y and (x.g <> y.g or x.g = '')")
    ends = meet.select("fam", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("e"))
    ends = ends.select("fam", F.xxhash64("fam", "x", "y").alias("meeting"), "x", "y", (F.col("e") == F.col("x")).alias("first"), (F.col("e") == F.col("y")).alias("second"), F.col("e.g").alias("g"), F.col("e.k").alias("k"))
    rows = ends.join(placed, ["fam", "g", "k"]).select("meeting", "fam", "x", "y", "first", "second", "rep", "lab", "s")
    more = rows.groupBy("meeting", "fam", "x", "y").applyInArrow(lambda t: _tile_links(t, least), "a bigint, b bigint")
    joined = more.join(side("a"), "a").join(side("b"), "b").select("la", "lb")
    merged = components(joined, left="la", right="lb")
    return labels.join(merged, labels["lab"] == merged["node"], "left").select("rep", F.coalesce("component", "lab").alias("lab"))


def one_of_each(df: DataFrame, *, size: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` but for near-duplicates of a row with a smaller id; all columns stay.

    Documents are near-duplicates if the sets of their word shingles have a Jaccard similarity of ``least`` or
    more, or through others that are. Texts meet in tables keyed by least shingle hashes, where their SimHash
    codes of four words are compared; the pairs on spanning forests are verified on the shingles, all of them.
    Where some fail, all texts that the pairs connect are compared. Texts with equal shingle sets (by two 64-bit
    hashes) are one class; null and empty texts are one such class. Rows with a null id stay, as do all rows of an
    id that stays. Empty input gives empty output.
    """
    prepare(df.sparkSession)
    every = df.select(df[id_col].cast("long").alias("id"), utf8(text_col).alias("text"))
    coded = cut(sketches(df, size=size, id_col=id_col, text_col=text_col).filter("id is not null"))
    classes = cut(coded.groupBy("s0", "s1").agg(F.min("id").alias("rep"), F.first("code").alias("code"), F.first("keys").alias("keys")))
    pairs = cut(links(classes.groupBy("rep").agg(F.min_by("code", F.struct("s0", "s1")).alias("code"), F.min_by("keys", F.struct("s0", "s1")).alias("keys")), words=WORDS, radii=RADII))
    checked = cut(_verified(pairs, every, size, least))
    found = components(checked.filter("ok").select("a", "b"))
    labels = cut(classes.select("rep").distinct().join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("lab")))
    named = classes.select("s0", "s1", "rep").join(_settled(labels, checked, every, size, least), "rep").select("s0", "s1", F.col("lab").alias("first"))
    gone = coded.select("id", "s0", "s1").join(named, ["s0", "s1"]).filter("id <> first").select("id").distinct()
    return df.join(gone, df[id_col].cast("long") == gone["id"], "left_anti")
