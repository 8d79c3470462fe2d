"""Removal of repeated byte strings by threshold-bounded interval expansion.

Each shard of segments (``windows``) becomes one text with a Burrows-Wheeler transform. Intervals of its
suffix array are expanded breadth first by prepending characters; a boundary first reached from strings of
length L parts suffixes with exactly L bytes in common, so common prefixes come out by increasing value, and
the expansion stops at the least length. Suffixes that no boundary parts share that many bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, prepare, shuffle_parts, unpacked, utf8
from .windows import Kind, by_shard, recurring_segments, shards

U = np.uint64
#: Bytes of segments in one text, whose arrays should stay in a core's cache.
SHARD_BYTES = 1 << 17


def first_symbols(text: np.ndarray, count: int, bits: int) -> np.ndarray:
    """The ``count`` symbols from each place on as one number, of ``bits`` bits each."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(count, np.uint8)])
    key = np.zeros(n, dtype=np.uint64)
    for j in range(count):
        key <<= U(bits)
        key |= padded[j : j + n]
    return key


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse of symbols 0..255 that end with the only 0, by prefix doubling.

    Sort keys carry the place in their low bits, so plain sorts do instead of index sorts.
    """
    n = len(text)
    bits = max(1, int(n).bit_length())
    place = np.arange(n, dtype=np.uint64)
    low = U((1 << bits) - 1)
    wide = max(1, int(text.max(initial=0)).bit_length())
    took = max(1, (64 - bits) // wide)
    key = first_symbols(text, took, wide)
    key = np.sort((key << U(bits)) | place)
    sa = (key & low).astype(np.int64)
    new = np.r_[True, (key[1:] >> U(bits)) != (key[:-1] >> U(bits))]
    rank = np.empty(n, dtype=np.uint64)
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1].astype(np.uint64)
    step = took
    while not new.all():
        # only suffixes that still share a rank are sorted again, within their rank
        tied = ~(new & np.r_[new[1:], True])
        at = np.flatnonzero(tied)
        s = sa[at]
        after = np.where(s + step < n, rank[np.minimum(s + step, n - 1)] + U(1), U(0))
        # tied rows are few beside all rows, so their group numbers take fewer bits
        group = np.cumsum(new[at]) - 1
        small = max(1, int(len(at)).bit_length())
        head = None
        if int(group[-1]).bit_length() + bits + 1 + small <= 64:
            k = np.sort((group.astype(np.uint64) << U(bits + 1 + small)) | (after << U(small)) | np.arange(len(at), dtype=np.uint64))
            order = (k & U((1 << small) - 1)).astype(np.int64)
            head = k >> U(small)
        else:
            order = np.lexsort((after, group))
        s2 = s[order]
        sa[at] = s2
        if head is None:
            same = (group[1:] == group[:-1]) & (after[order][1:] == after[order][:-1])
        else:
            same = head[1:] == head[:-1]
        first = np.r_[True, ~same]
        new[at] = first
        rank[s2] = at[np.flatnonzero(first)[np.cumsum(first) - 1]].astype(np.uint64)
        step *= 2
    return sa, rank.astype(np.int64)


def shared_prefixes(sa: np.ndarray, isa: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """For each row of the suffix array: does it share ``least`` symbols or more with the row before?

    The expansion starts at strings of a few symbols, whose intervals are those of equal first symbols.
    """
    n = len(text)
    before = np.where(sa > 0, sa - 1, n - 1)
    symbol = text[before]  # the transform
    to = isa[before].astype(np.int64)  # row of the suffix with that symbol prepended
    back = np.empty(n, dtype=np.int64)
    back[to] = np.arange(n)
    head = text[sa]  # first symbols, in order: buckets of ``to``
    fresh = np.r_[True, head[1:] != head[:-1]]
    prev_same, next_same = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    rows = np.flatnonzero(~fresh)
    prev_same[back[rows]] = back[rows - 1]
    next_same[back[rows - 1]] = back[rows]
    del symbol, head
    begun = min(least, 8)
    first = first_symbols(text, begun, 8)[sa]
    parted = np.ones(n + 1, dtype=bool)
    parted[1:n] = first[1:] != first[:-1]
    edge = np.flatnonzero(parted)
    lo, hi = edge[:-1], edge[1:]
    # the ends that shorter strings do not part; the last one was there from the start
    fresh = np.r_[(first[hi[:-1]] >> U(8)) == (first[hi[:-1] - 1] >> U(8)), False]
    lo, hi = lo[fresh], hi[fresh]
    for _ in range(least - begun):
        if not len(lo):
            break
        size = hi - lo
        owner = np.repeat(np.arange(len(lo)), size)
        row = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner]
        firsts = np.sort(to[row[prev_same[row] < lo[owner]]])
        lasts = np.sort(to[row[next_same[row] >= hi[owner]]]) + 1
        new = ~parted[lasts]
        lo, hi = firsts[new], lasts[new]
        parted[hi] = True
    return ~parted[:n]


def repeated_places(segs: list[bytes], copies: list[int], least: int) -> list[list[tuple[int, int]]]:
    """Of each segment the ranges (first, last) of places at which a string of ``least`` bytes starts that occurs twice.

    A segment counts as often as it has ``copies``.
    """
    # 0 ends the text, 1 ends a segment, bytes move to the symbols above; UTF-8 has at most 243 different ones
    joined = np.frombuffer(b"".join(segs), dtype=np.uint8)
    seen = np.flatnonzero(np.bincount(joined, minlength=256))
    if len(seen) > 254:
        raise ValueError("texts must be UTF-8")
    code = np.zeros(256, dtype=np.uint8)
    code[seen] = np.arange(2, len(seen) + 2)
    lens = np.fromiter(map(len, segs), np.int64, len(segs))
    begin = np.cumsum(lens + 1) - lens - 1
    text = np.ones(int(lens.sum()) + len(segs) + 1, dtype=np.uint8)
    text[np.arange(len(joined)) + np.repeat(np.arange(len(segs)), lens)] = code[joined]
    text[-1] = 0
    sa, isa = suffix_array(text)
    same = shared_prefixes(sa, isa, text, least)
    group = np.cumsum(~same) - 1
    owner = np.repeat(np.arange(len(segs) + 1), np.r_[lens + 1, 1])[sa]
    owner[owner == len(segs)] = len(segs) - 1
    left = begin[owner] + lens[owner] - sa
    valid = left >= least
    weight = np.where(valid, np.asarray(copies)[owner], 0)
    good = valid & (np.bincount(group, weights=weight)[group] >= 2)
    mark = np.zeros(len(text) + 1, dtype=np.int8)
    mark[sa[good]] = 1
    edge = np.flatnonzero(np.diff(np.r_[0, mark]))
    out: list[list[tuple[int, int]]] = [[] for _ in segs]
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        i = int(np.searchsorted(begin, a, side="right")) - 1
        out[i].append((a - int(begin[i]), z - 1 - int(begin[i])))
    return out


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_col)


def remove_repeats(df: DataFrame, *, least: int = 400, gram: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``kept`` bytes and the ``removed`` maximal (start, end) byte ranges.

    A byte goes if a string of ``least`` bytes over it also starts anywhere else, in the same row or another;
    strings do not cross rows and are judged on the input. Null texts are empty; texts may have any length. Null and
    repeated ids are allowed: rows are told apart by id and a hash of the text, and equal rows count as often as they
    occur. Empty input gives empty output; other columns are ignored.
    """
    prepare(df.sparkSession)
    kind = Kind(span=least, gram=gram, words=False, sampled=16)
    every = df.select(df[id_col].cast("long").alias("mark"), utf8(text_col).alias("text"))
    rows = every.select(row_key("mark", "text").alias("key"), "mark", "text")
    dealt = packed(rows).repartition(shuffle_parts(df), "key")

    whole, short = recurring_segments(rows, dealt, kind, marked=False)

    def locate(batches):
        for t in shards(batches, SHARD_BYTES):
            found = repeated_places(t.column("seg").to_pylist(), t.column("n").to_pylist(), least)
            h, sh = t.column("h").to_pylist(), t.column("sh").to_pylist()
            rows = [(h[i], sh[i], [{"a": a, "z": z} for a, z in f]) for i, f in enumerate(found) if f]
            if rows:
                x, y, z = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z, pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))], ["h", "sh", "hits"])

    hits = by_shard(whole).mapInArrow(locate, "h bigint, sh bigint, hits array<struct<a:int,z:int>>")
    placed = short.join(hits, ["h", "sh"]).select("key", "mark", F.transform("hits", lambda x: F.struct((F.col("start") + x["a"]).alias("a"), (F.col("start") + x["z"]).alias("z"))).alias("at"))
    # a hash may be shared by rows of different ids: the id tells them apart
    ranges = placed.groupBy(F.col("key").alias("rk")).agg(F.collect_set(F.struct("mark", "at")).alias("found"))
    own = F.filter("found", lambda x: x["mark"].eqNullSafe(F.col("mark")))
    judged = dealt.join(ranges, dealt["key"] == F.col("rk"), "left").select(F.col("mark").alias("id"), "text", F.flatten(F.transform(own, lambda x: x["at"])).alias("at"))
    return _emit(judged, least).withColumnRenamed("id", id_col)


def _emit(df: DataFrame, least: int) -> DataFrame:
    def run(batches):
        for b in unpacked(batches):
            n_bytes, n_removed, kept, ranges = [], [], [], []
            for text, at in zip(b.column("text").to_pylist(), b.column("at").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for x in sorted((r["a"], r["z"] + least) for r in at or ()):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append([*x])
                ends = [0, *[x for r in runs for x in r], len(text)]
                kept.append(b"".join(text[a:z] for a, z in zip(ends[::2], ends[1::2], strict=True)))
                n_bytes.append(len(text))
                n_removed.append(len(text) - len(kept[-1]))
                ranges.append([{"start": a, "end": z} for a, z in runs])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(ranges, kind)], ["id", "n_bytes", "n_removed", "kept", "removed"])

    return df.mapInArrow(run, "id bigint, n_bytes bigint, n_removed bigint, kept binary, removed array<struct<start:bigint,end:bigint>>")
