"""Finding windows of text that occur more than once, without shipping every window.

A window of ``span`` units (bytes or words) is assigned to the least-ranked of its grams of ``gram`` units,
its anchor. Equal windows have equal anchors, so those whose anchor occurs once need no further look. Runs of
windows with one anchor are cut out as one segment and meet, by anchor, in one shard. Very frequent grams rank
last: a window takes one only if it holds no other, and then lies within a passage that is frequent itself, so
that a shard gets few different segments.

Windows of bytes are long beside a gram, so a recurring gram says little. Equal windows have their anchor at the same
place, so all those with it in their first half share the bytes after it that lie in each of them, and those with
it in their second half the bytes up to it; a half is looked at only if these bytes recur.

Rows that share a key are told apart by their mark; equal rows may share both. Texts of any length are cut into
pieces, so memory is bounded by the longest text and some arrays over a piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, joined, mix64, shuffle_parts, slices, unpacked, word_bounds

U = np.uint64
FACTOR = U(0x9E3779B97F4A7C15)
POS_BITS = 26
#: A text piece has about so many bytes at most, and is worked on by itself; longer texts are cut into pieces that
#: overlap by a window less one unit, so that every window lies in one piece. An anchor near a cut may count twice,
#: which only has a segment looked at.
PIECE_BYTES = 4 << 20
#: Frequent grams: at least so many in a slice, and in all slices; no more than HOT_MOST are broadcast.
LOCAL_MIN, HOT_MIN, HOT_MOST = 4, 500, 20_000


def byte_grams(buf: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes (a power of two) from each position on; the last ones are short."""
    h = mix64(np.arange(256, dtype=np.uint64) + U(1))[buf]
    f, k = FACTOR, 1
    while k < size:
        h[:-k] = h[:-k] * f + h[k:]
        f = U(int(f) * int(f) & 0xFFFFFFFFFFFFFFFF)
        k *= 2
    return mix64(h)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: eight bytes a step over all words that are so long."""
    h = (ends - starts).astype(np.uint64) * FACTOR
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(buf), 8), (1, 1))
    left = ends - starts
    at, todo = starts.copy(), np.arange(len(starts))
    keep = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
    while len(todo):
        x = np.ascontiguousarray(eight[at]).view(np.uint64)[:, 0] & keep[np.minimum(left, 8)]
        h[todo] = mix64(h[todo] ^ x) * FACTOR
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` consecutive hashes from each position on (the last ones are short)."""
    out = np.zeros(len(h), dtype=np.uint64)
    for j in range(min(size, len(h))):
        out[: len(h) - j] = out[: len(h) - j] * FACTOR + h[j:]
    return mix64(out)


@dataclass
class Slice:
    """Units of some texts: gram hashes, the row of each unit, and the windows' places in the text."""

    grams: np.ndarray
    first: np.ndarray  # first unit of each piece
    count: np.ndarray  # units of each piece
    row: np.ndarray  # row of each piece
    base: np.ndarray  # units of the row before the piece
    cut_out: Callable[[int, int], bytes]  # units [a, b) of the slice as bytes


@dataclass(frozen=True)
class Kind:
    """How texts are cut into units."""

    span: int
    gram: int
    words: bool
    sampled: int = 1  # of byte grams, one in so many (a power of two) is counted and ranks first

    def cut_up(self, texts: list[bytes]) -> Iterator[Slice]:
        """The texts' pieces, as many in a slice as have about ``PIECE_BYTES``."""
        pieces, row, base, size = [], [], [], 0
        for i, t in enumerate(texts):
            for lo, piece in self._pieces(t):
                if pieces and size + len(piece) > PIECE_BYTES:
                    yield self._slice(pieces, row, base)
                    pieces, row, base, size = [], [], [], 0
                pieces.append(piece)
                row.append(i)
                base.append(lo)
                size += len(piece)
        yield self._slice(pieces, row, base)

    def _pieces(self, t: bytes) -> Iterator[tuple[int, bytes]]:
        if len(t) <= PIECE_BYTES:
            yield 0, t
        elif self.words:
            s, e = word_bounds(np.frombuffer(t + b"\n", np.uint8))
            step = max(1, PIECE_BYTES // 8)
            for lo in range(0, max(1, len(s) - self.span + 1), step):
                hi = min(len(s), lo + step + self.span - 1)
                yield lo, t[s[lo] : e[hi - 1]] if hi else b""
        else:
            for lo in range(0, max(1, len(t) - self.span + 1), PIECE_BYTES):
                yield lo, t[lo : lo + PIECE_BYTES + self.span - 1]

    def _slice(self, pieces: list[bytes], row: list[int], base: list[int]) -> Slice:
        buf, at = joined(pieces)
        data = buf.tobytes()
        row, base = np.array(row, dtype=np.int64), np.array(base, dtype=np.int64)
        if self.words:
            s, e = word_bounds(buf)
            first = np.searchsorted(s, at[:-1])
            count = np.diff(np.r_[first, len(s)])
            return Slice(gram_hashes(word_hashes(buf, s, e), self.gram), first, count, row, base, lambda a, b: b" ".join(data[s[a] : e[b - 1]].split()))
        return Slice(byte_grams(buf, self.gram), at[:-1], np.diff(at) - 1, row, base, lambda a, b: data[a:b])

    def counted(self, grams: np.ndarray) -> np.ndarray:
        return grams if self.sampled == 1 else grams[(grams >> U(58)) & U(self.sampled - 1) == 0]

    def segments(self, s: Slice, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Piece, first window, last window (in units of the slice) and anchor of every segment."""
        return self.anchored(s, hot)[:4]

    def parts(self, s: Slice, first: np.ndarray, last: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segment, key, first window and last window of every part of a segment; equal windows are in parts of one key."""
        if self.words:
            return np.arange(len(h)), h, first, last
        half = (self.span - self.gram + 1) // 2
        left, right = np.flatnonzero(at - first >= half), np.flatnonzero(at - last < half)
        a = np.concatenate([at[left] - half, at[right]])
        z = np.concatenate([at[left] + self.gram, at[right] + self.span - half + 1])
        key = np.fromiter((xxhash.xxh3_64_intdigest(s.cut_out(x, y)) for x, y in zip(a.tolist(), z.tolist(), strict=True)), np.uint64, len(a))
        lo = np.concatenate([first[left], np.maximum(first[right], at[right] - half + 1)])
        hi = np.concatenate([np.minimum(last[left], at[left] - half), last[right]])
        return np.concatenate([left, right]), key, lo, hi

    def anchored(self, s: Slice, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``segments`` and the places of the anchors."""
        g = self.span - self.gram + 1
        n = len(s.grams)
        none = np.zeros(0, np.int64)
        if n < self.span:
            return none, none, none, none.astype(np.uint64), none
        rank = np.zeros(n, dtype=np.uint64)
        if self.sampled > 1:
            rank[(s.grams >> U(58)) & U(self.sampled - 1) != 0] = 1
        if len(hot):
            can = np.flatnonzero(rank == 0)  # others are not counted
            k = np.searchsorted(hot, s.grams[can])
            k[k == len(hot)] = 0
            rank[can[hot[k] == s.grams[can]]] = 2
        key = (rank << U(62)) | ((s.grams >> U(2)) & U(((1 << 62) - 1) ^ ((1 << POS_BITS) - 1))) | np.arange(n, dtype=np.uint64)
        assert n < 1 << POS_BITS  # slices hold no more than a few pieces
        width, low = 1, key  # low[i]: least key of [i, i + width)
        while width * 2 <= g:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < g:
            low = np.minimum(low[: n - g + 1], low[g - width : n - width + 1])
        at = (low & U((1 << POS_BITS) - 1)).view(np.int64)
        held = np.flatnonzero(s.count >= self.span)
        if not len(held):
            return none, none, none, none.astype(np.uint64), none
        begin, end = s.first[held], s.first[held] + s.count[held] - self.span + 1
        turn = np.zeros(n + 1, dtype=bool)
        turn[1 : len(at)] = at[1:] != at[:-1]
        turn[begin] = turn[end] = True
        edge = np.flatnonzero(turn)
        owner = np.searchsorted(begin, edge, side="right") - 1
        k = np.flatnonzero((owner >= 0) & (edge < end[owner]))
        first = edge[k]
        return held[owner[k]], first, edge[k + 1] - 1, s.grams[at[first]], at[first]


#: Bytes of text worked on at once: their arrays of eight bytes each should stay in a core's cache.
SLICE_BYTES = 1 << 17
#: Grams are counted over the slices of about so many bytes.
COUNT_BYTES = 4 << 20
#: So many places of keys are sorted and sent at once; so many bytes of segments are held to count equal ones.
HELD_KEYS, HELD_BYTES = 1 << 18, 4 << 20


def _each(batches: Iterator[pa.RecordBatch], kind: Kind, whole: bool = True) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    for b in slices(batches if whole else unpacked(batches), "text", SLICE_BYTES):
        for s in kind.cut_up(b.column("text").to_pylist()):
            yield b, s


def frequent_grams(docs: DataFrame, kind: Kind) -> np.ndarray:
    """Hashes of the most frequent grams, sorted; at most HOT_MOST. They only steer which task gets what."""

    def counts(held):
        g, n = np.unique(np.concatenate(held), return_counts=True)
        many = n >= LOCAL_MIN
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(g[many].view(np.int64)), pa.array(n[many])], ["gram", "n"])

    def run(batches):
        held, size = [], 0
        for b, s in _each(batches, kind):
            held.append(kind.counted(s.grams))
            size += len(s.grams) * (6 if kind.words else 1)
            if size >= COUNT_BYTES:
                yield from counts(held)
                held, size = [], 0
        if held:
            yield from counts(held)

    found = cut(docs.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
    total = found.agg(F.sum("n")).first()[0] or 0
    # no more than HOT_MOST grams can each make up that share of all
    top = found.filter(F.col("n") >= max(HOT_MIN, -(-total // HOT_MOST))).select("gram").collect()
    return np.sort(np.array([r.gram for r in top], dtype=np.int64).view(np.uint64))


def _runs(h: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, h[1:] != h[:-1]])


def _sort(places: list[np.ndarray], marked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (key, row, mark) in order of the key, where each key begins, and whether it recurs, for each place.

    A key recurs if it has two places, of different marks if ``marked``.
    """
    p = np.concatenate(places, axis=1)
    p = p[:, np.lexsort((p[2], p[0])) if marked else np.argsort(p[0])]
    begin = _runs(p[0])
    end = np.r_[begin[1:], p.shape[1]]
    again = p[2][begin] != p[2][end - 1] if marked else end - begin > 1
    return p, begin, np.repeat(again, end - begin)


def recurring_keys(rows: DataFrame, kind: Kind, hot, *, marked: bool) -> DataFrame:
    """Rows (key) and the keys (h) of parts in them that recur, some of them twice.

    The places of a key meet in one task, packed into a few binary rows. Where a task sees by itself that a key recurs,
    it sends on two places only, so that no task gets all the places of a frequent one.
    """
    n = shuffle_parts(rows)

    def bucket(h: np.ndarray) -> np.ndarray:
        return (mix64(h) >> U(32)) * U(n) >> U(32)

    def packs(held: list[np.ndarray]) -> pa.RecordBatch:
        p, begin, again = _sort(held, marked)
        pair = np.r_[begin, np.r_[begin[1:], p.shape[1]] - 1][np.tile(again[begin], 2)]
        sent = p[: 2 + marked, np.r_[np.flatnonzero(~again), pair]]
        known = p[:2, again]
        cells = []
        for x, to in ((sent, bucket(sent[0])), (known, bucket(known[1]))):
            x = x[:, np.argsort(to, kind="stable")]
            edge = np.r_[0, np.cumsum(np.bincount(to.astype(np.int64), minlength=n))].tolist()
            cells.append([np.ascontiguousarray(x[:, a:z]).tobytes() for a, z in zip(edge[:-1], edge[1:], strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(cells[0], pa.binary()), pa.array(cells[1], pa.binary())], ["part", "sent", "known"])

    def places(batches):
        held, size = [], 0
        for b, s in _each(batches, kind):
            piece, first, last, h, at = kind.anchored(s, hot.value)
            i, key, _, _ = kind.parts(s, first, last, h, at)
            if not len(key):
                continue
            row = s.row[piece[i]]
            if marked:  # one place a row is enough
                row, key = _pairs(row, key)
            of = b.column("key").to_numpy().view(U)[row]
            held.append(np.stack([key, of, b.column("mark").to_numpy().view(U)[row]] if marked else [key, of, of]))
            size += len(key)
            if size >= HELD_KEYS:
                yield packs(held)
                held, size = [], 0
        if held:
            yield packs(held)

    def out(p: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(p[1].view(np.int64)), pa.array(p[0].view(np.int64))], ["key", "h"])

    def settled(batches):
        held = []
        for b in batches:
            for sent, known in zip(b.column("sent").to_pylist(), b.column("known").to_pylist(), strict=True):
                if sent:
                    p = np.frombuffer(sent, U).reshape(2 + marked, -1)
                    held.append(p if marked else p[[0, 1, 1]])
                if known:
                    yield out(np.frombuffer(known, U).reshape(2, -1))
        if held:
            p, _, again = _sort(held, marked)
            yield out(p[:2, again])

    dealt = rows.mapInArrow(places, "part int, sent binary, known binary").repartitionById(n, "part")
    return dealt.mapInArrow(settled, "key bigint, h bigint")


SEGMENTS = pa.schema([("h", pa.int64()), ("sh", pa.int64()), ("seg", pa.binary()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def recurring_segments(rows: DataFrame, dealt: DataFrame, kind: Kind, *, marked: bool, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments with a part that recurs, of ``rows`` (key, mark, text as binary); with ``marked``, under several marks.

    ``dealt`` is ``rows``, ``packed`` and hash-partitioned by key, so that its one shuffle of the texts serves every use.
    ``among`` (key) restricts the rows. The result are the segments (h, sh, seg, how often they occur, the least and
    the greatest key), equal ones of a task as one row, and their places: (key, mark, start, windows, h, sh); ``start``
    counts units from the start of the text, ``sh`` is a hash of ``seg``.
    """
    hot = rows.sparkSession.sparkContext.broadcast(frequent_grams(rows, kind))
    met = recurring_keys(rows, kind, hot, marked=marked)
    if among is not None:
        met = met.join(among, "key", "left_semi")
    sets = cut(met.groupBy("key").agg(F.collect_list("h").alias("hs")))
    held = dealt.join(sets, "key").select("key", "mark", "text", "hs")

    def found(batches):
        """Slice, row, first window, last window, anchor, text and its hash of the segments."""
        for b, s in _each(batches, kind, whole=False):
            piece, first, last, h, at = kind.anchored(s, hot.value)
            i, key, lo, hi = kind.parts(s, first, last, h, at)
            hs = b.column("hs")
            flat = hs.flatten().to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(b.num_rows), hs.value_lengths().to_numpy())
            wanted = np.unique(mix64(flat) ^ mix64(owner.astype(np.uint64) + U(7)))
            ok = np.isin(mix64(key) ^ mix64(s.row[piece[i]].astype(np.uint64) + U(7)), wanted)
            if not ok.any():
                continue
            first, last = np.full(len(h), len(s.grams)), np.full(len(h), -1)
            np.minimum.at(first, i[ok], lo[ok])
            np.maximum.at(last, i[ok], hi[ok])
            got = np.flatnonzero(last >= 0)
            piece, first, last, h = piece[got], first[got], last[got], h[got]
            text = [s.cut_out(a, z + kind.span) for a, z in zip(first.tolist(), last.tolist(), strict=True)]
            yield b, s, piece, first, last, h, text, np.fromiter(map(xxhash.xxh3_64_intdigest, text), np.uint64, len(text))

    def places(batches):
        for b, s, piece, first, last, h, _, sh in found(batches):
            row = pa.array(s.row[piece])
            cols = [b.column("key").take(row), b.column("mark").take(row), pa.array(first - s.first[piece] + s.base[piece]), pa.array(last - first + 1), pa.array(h.view(np.int64)), pa.array(sh.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "mark", "start", "windows", "h", "sh"])

    def texts(batches):
        held: dict[tuple[int, int], list] = {}
        size = 0
        for b, s, piece, _, _, h, text, sh in found(batches):
            key = b.column("key").to_numpy()[s.row[piece]]
            for x, t, k in zip(zip(h.view(np.int64).tolist(), sh.view(np.int64).tolist(), strict=True), text, key.tolist(), strict=True):
                got = held.get(x)
                if got is None:
                    held[x] = [t, 1, k, k]
                    size += len(t)
                else:
                    got[1], got[2], got[3] = got[1] + 1, min(got[2], k), max(got[3], k)
            if size >= HELD_BYTES:  # those met again stay, unless they are most
                stay = {x: v for x, v in held.items() if v[1] > 1}
                size = sum(len(v[0]) for v in stay.values())
                if size > HELD_BYTES // 2:
                    stay, size = {}, 0
                yield _rows({x: v for x, v in held.items() if x not in stay})
                held = stay
        if held:
            yield _rows(held)

    return held.mapInArrow(texts, "h bigint, sh bigint, seg binary, n bigint, lo bigint, hi bigint"), held.mapInArrow(places, "key bigint, mark bigint, start bigint, windows bigint, h bigint, sh bigint")


def _rows(held: dict[tuple[int, int], list]) -> pa.RecordBatch:
    h, sh = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((h, sh, *zip(*held.values(), strict=True)), SEGMENTS, strict=True)], schema=SEGMENTS)


def _pairs(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])])
    return r[first], x[first]


def _merged(t: pa.Table) -> pa.Table:
    """Equal segments, which follow each other, as one row."""
    h, sh, n, lo, hi = (t.column(c).to_numpy() for c in ("h", "sh", "n", "lo", "hi"))
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (sh[1:] != sh[:-1])])
    if len(first) == len(h):
        return t
    cols = [h[first], sh[first], t.column("seg").take(pa.array(first)), np.add.reduceat(n, first), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)]
    return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in cols], schema=SEGMENTS)


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The rows of a task, which come in order of anchor and hash, in tables of about ``limit`` bytes of segments.

    No anchor is split; no more than a table and a batch are held.
    """
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        t = _merged(pa.Table.from_batches([b.cast(SEGMENTS)]))
        h = t.column("h").to_numpy()
        total = np.cumsum(pc.binary_length(t.column("seg")).to_numpy().astype(np.int64))
        lo = 0
        if held and held[-1].column("h")[-1].as_py() != h[0] and size >= limit:
            yield _merged(pa.concat_tables(held).combine_chunks())
            held, size = [], 0
        for a in _runs(h)[1:].tolist():
            if size + total[a - 1] - (total[lo - 1] if lo else 0) >= limit:
                yield _merged(pa.concat_tables([*held, t.slice(lo, a - lo)]).combine_chunks())
                held, size, lo = [], 0, a
        held.append(t.slice(lo))
        size += int(total[-1] - (total[lo - 1] if lo else 0))
    if held:
        yield _merged(pa.concat_tables(held).combine_chunks())


def by_shard(segments: DataFrame) -> DataFrame:
    """The segments dealt out by anchor, each task's in order of anchor and hash."""
    return segments.repartition(shuffle_parts(segments), "h").sortWithinPartitions("h", "sh")
