"""Benchmark decontamination by q-gram counting in diagonal bands and banded alignment.

Benchmark items are searched by overlapping windows: every ``FINE`` bytes one of ``PART``, so that any verbatim
passage of PART + FINE - 1 bytes (69) holds one, besides long ones that bear more edits. By the q-gram lemma a window of m characters found with at
most e edits shares m + 1 - q (e + 1) of its q-grams with the place, all on diagonals no more than e apart. So
shared q-grams are counted in overlapping bands of diagonals, bands that reach the bound are retained, and
each is verified by an alignment restricted to its diagonals, all of a slice at once. Items shorter than a
q-gram are looked up exactly, as runs of whole words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, prepare, slices, utf8, word_bounds
from .windows import FACTOR

U = np.uint64
Q = 10
#: Longer items are looked for window by window.
WINDOW, STRIDE, WHOLE = 128, 64, 160
#: Items of more than PART bytes also by shorter windows at a small stride. (62 bytes bear 4 edits and then share 13
#: q-grams; 64 would bear 5 and share only 5, which mostly finds places that alignment refuses.)
PART, FINE = 62, 8
#: Share of a window's characters that may be edited.
EDITS = 0.08
#: Half the width of a band of diagonals; above any window's edits.
BAND = 16
#: Items of so many bytes make one broadcast index; more items take further passes.
BLOCK_BYTES = 32 << 20
BITS = 22
#: Shared q-grams are looked at in portions of so many pairs of places, however common a q-gram is.
WORK, WINDOW_WORK = 1 << 21, 1 << 18
_GAPS = re.compile(r"[\W_]+")


def normal(text: str) -> bytes:
    """Lower case; runs of anything but letters and digits become one space."""
    return _GAPS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def gram_codes(buf: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes from each position on, of two overlapping words."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    words = np.ndarray((len(buf) + 2,), dtype=np.uint64, buffer=padded.data, strides=(1,))
    code = words[: len(buf)] * FACTOR
    code ^= code >> U(31)
    code += words[Q - 8 : len(buf) + Q - 8] * U(0xBF58476D1CE4E5B9)
    code *= U(0x94D049BB133111EB)
    return code


def edit_budget(m: int) -> int:
    """Edits allowed in ``m`` characters, so few that a shared q-gram is left."""
    return max(0, min(int(EDITS * m), (m - Q) // Q))


def window_grid(n: int) -> list[tuple[int, int, int]]:
    """(length, stride, count) of an item's windows of each kind; the last window of a kind ends with the item."""
    kinds = [(n, 1, 1)] if n <= WHOLE else [(WINDOW, STRIDE, -(-(n - WINDOW) // STRIDE) + 1)]
    return kinds if n <= PART else [*kinds, (PART, FINE, -(-(n - PART) // FINE) + 1)]


@dataclass
class Index:
    """All windows of a block of items, and where each q-gram occurs in the items (not window by window)."""

    item: np.ndarray  # of each window
    windows: list[bytes]
    start: np.ndarray  # of each window in its item
    least: np.ndarray
    budget: np.ndarray
    size: np.ndarray  # of each item
    grid: np.ndarray  # of each item and kind: first window, length, stride, count
    weakest: np.ndarray  # the least shared q-grams that any window of an item asks for
    codes: np.ndarray  # sorted, one entry for each occurrence
    owner: np.ndarray
    place: np.ndarray
    present: np.ndarray
    short: dict[bytes, list[int]]  # items of under Q bytes, and their windows (after all others)

    @classmethod
    def of(cls, items: list[tuple[int, bytes]]) -> Index:
        brief = sorted({(t, i) for i, t in items if 0 < len(t) < Q})
        items = [(i, t) for i, t in items if len(t) >= Q]
        cut, ids, start, grid = [], [], [], np.zeros((len(items), 2, 4), np.int64)
        for o, (i, t) in enumerate(items):
            for kind, (length, stride, count) in enumerate(window_grid(len(t))):
                grid[o, kind] = len(cut), length, stride, count
                for k in range(count):
                    a = min(k * stride, len(t) - length)
                    cut.append(t[a : a + length])
                    start.append(a)
                    ids.append(i)
        buf, at = joined([t for _, t in items])
        n = np.diff(at) - 1
        codes = gram_codes(buf)
        owner = np.repeat(np.arange(len(items)), n + 1)
        place = np.arange(len(buf)) - at[owner]
        ok = place <= n[owner] - Q if len(items) else np.zeros(0, bool)
        codes, owner, place = codes[: len(buf)][ok], owner[ok], place[ok]
        order = np.argsort(codes, kind="stable")
        present = np.zeros(1 << BITS, bool)
        present[codes >> U(64 - BITS)] = True
        budget = np.array([edit_budget(len(w)) for w in cut], dtype=np.int64)
        least = np.array([len(w) + 1 - Q * (e + 1) for w, e in zip(cut, budget.tolist(), strict=True)], dtype=np.int64)
        weakest = np.minimum.reduceat(least, grid[:, 0, 0]) if items else least
        short: dict[bytes, list[int]] = {}
        for k, (t, i) in enumerate(brief, len(cut)):
            short.setdefault(t, []).append(k)
            ids.append(i)
        return cls(np.array(ids, dtype=np.int64), cut + [t for t, _ in brief], np.array(start, dtype=np.int64), least, np.r_[budget, np.zeros(len(brief), np.int64)], n, grid, weakest, codes[order], owner[order], place[order], present, short)

    def _windows_of(self, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hit, window): for q-grams at ``place`` of the items ``owner``, every window that holds them whole."""
        hits, found = [], []
        for kind in range(2):
            first, length, stride, count = self.grid[owner, kind].T
            some = np.flatnonzero(count)
            first, length, stride, count, p, end = first[some], length[some], stride[some], count[some], place[some], self.size[owner[some]]
            lo = np.minimum(np.maximum(-(-(p + Q - length) // stride), 0), count - 1)
            hi = np.where(p >= end - length, count - 1, np.minimum(p // stride, count - 2))
            n = np.maximum(hi - lo + 1, 0)
            hits.append(np.repeat(some, n))
            found.append(np.repeat(first + lo - np.cumsum(n) + n, n) + np.arange(n.sum()))
        return np.concatenate(hits), np.concatenate(found)

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, window, edits) of every window found in a text (normal form), with its fewest edits."""
        return sorted(self._brief(texts) + self._long(texts))

    def _brief(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """Items of under Q bytes, exactly and on the bounds of words: by their first eight bytes, then in full."""
        if not self.short:
            return []
        buf, at = joined(texts)
        s, e = word_bounds(buf)
        head = lambda x, size: x & np.where(size >= 8, U(0xFFFFFFFFFFFFFFFF), (U(1) << (U(8) * np.minimum(size, 7).astype(U))) - U(1))
        keys = [t.ljust(8, b"\0")[:8] for t in self.short]
        known = np.unique(np.frombuffer(b"".join(keys), np.uint64))
        eight = np.ndarray((len(buf),), dtype=np.uint64, buffer=np.concatenate([buf, np.zeros(8, np.uint8)]).data, strides=(1,))
        found = set()
        for n in sorted({t.count(b" ") + 1 for t in self.short}):
            first, last = s[: len(s) - n + 1], e[n - 1 :]
            near = np.flatnonzero(last - first < Q)
            near = near[np.isin(head(eight[first[near]], last[near] - first[near]), known)]
            text = np.searchsorted(at, first[near], side="right") - 1
            for t, a, z in zip(text.tolist(), first[near].tolist(), last[near].tolist(), strict=True):
                found |= {(t, w, 0) for w in self.short.get(buf[a:z].tobytes(), ())}
        return list(found)

    def _long(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        buf, at = joined(texts)
        if not len(buf) or not len(self.codes):
            return []
        codes = gram_codes(buf)
        p = np.flatnonzero(self.present[codes >> U(64 - BITS)])
        c = codes[p]
        lo, hi = np.searchsorted(self.codes, c, side="left"), np.searchsorted(self.codes, c, side="right")
        got = hi > lo
        p, lo, n = p[got], lo[got], (hi - lo)[got]
        if not len(p):
            return []
        if n.sum() > WORK and len(texts) > 1:  # texts apart, so that what is counted below stays small
            half = len(texts) // 2
            return self._long(texts[:half]) + [(t + half, w, d) for t, w, d in self._long(texts[half:])]
        ends = np.cumsum(n)

        def portions(size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """(place in the buffer, entry of the index) of all shared q-grams."""
            for a in range(0, int(ends[-1]), size):
                k = np.arange(a, min(a + size, int(ends[-1])))
                of = np.searchsorted(ends, k, side="right")
                yield p[of], lo[of] + k - (ends[of] - n[of])

        # a pair of text and item that shares fewer q-grams than the easiest window asks for has no window
        items = len(self.size)
        shared = _summed(np.unique((np.searchsorted(at, q, side="right") - 1) * items + self.owner[hit], return_counts=True) for q, hit in portions(WORK))
        pairs = shared[0][shared[1] >= self.weakest[shared[0] % items]]
        if not len(pairs):
            return []
        heads: list[tuple[np.ndarray, ...]] = []

        def banded() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for q, hit in portions(WINDOW_WORK):
                owner, place, text = self.owner[hit], self.place[hit], np.searchsorted(at, q, side="right") - 1
                some = np.isin(text * items + owner, pairs)
                if not some.any():
                    continue
                q, owner, place, text = q[some], owner[some], place[some], text[some]
                hit, w = self._windows_of(owner, place)
                # on the window's own diagonals
                text, inner = text[hit], place[hit] - self.start[w]
                diagonal = q[hit] - inner
                heads.append(tuple(x[inner == 0] for x in (text, w, q[hit] - at[text])))
                # each diagonal lies in two bands of twice BAND, so that any run no wider than BAND lies in one
                band = np.concatenate([diagonal // BAND, diagonal // BAND - 1]) + 64
                yield np.unique(np.tile(text * len(self.windows) + w, 2) * n_bands + band, return_counts=True)

        n_bands = len(buf) // BAND + 130
        key, count = _summed(banded())
        pair, band = key // n_bands, key % n_bands - 64
        text, w = pair // len(self.windows), pair % len(self.windows)
        ok = count >= self.least[w]
        text, w, band = text[ok], w[ok], band[ok]
        best: dict[tuple[int, int], int] = {}
        # verbatim windows need no alignment
        pair = text * len(self.windows) + w
        for verbatim in heads:
            good = np.isin(verbatim[0] * len(self.windows) + verbatim[1], pair)
            for t, x, a in zip(*(v[good].tolist() for v in verbatim), strict=True):
                if (t, x) not in best and texts[t].startswith(self.windows[x], a):
                    best[t, x] = 0
        rest = ~np.isin(pair, np.array([t * len(self.windows) + x for t, x in best], dtype=np.int64))
        text, w, band = text[rest], w[rest], band[rest]
        for a in range(0, len(text), 2048):
            part = slice(a, a + 2048)
            for t, x, d in zip(text[part].tolist(), w[part].tolist(), self._align(buf, at, text[part], w[part], band[part]).tolist(), strict=True):
                if d <= self.budget[x]:
                    best[t, x] = min(d, best.get((t, x), d))
        return [(t, x, d) for (t, x), d in best.items()]

    def _align(self, buf, at, text, w, band) -> np.ndarray:
        """Fewest edits of each window against its text on the band's diagonals, with some to either side."""
        side = int(self.budget.max())
        width = 2 * BAND + 2 * side
        base = band * BAND - side
        size = np.array([len(self.windows[x]) for x in w.tolist()])
        longest = int(size.max())
        chars = np.zeros((len(w), longest), np.uint8)
        for i, x in enumerate(w.tolist()):
            chars[i, : size[i]] = np.frombuffer(self.windows[x], np.uint8)
        k = np.arange(width)
        row = np.zeros((len(w), width), np.int32)
        out = np.full(len(w), 1 << 20)
        first, last, lane, budget = at[text][:, None], at[text + 1][:, None] - 1, np.arange(len(w)), self.budget[w]
        base = base[:, None] + k
        for i in range(longest):
            pos = base + i
            inside = (pos >= first) & (pos < last)
            same = inside & (buf[np.clip(pos, 0, len(buf) - 1)] == chars[:, i : i + 1])
            new = row + ~same
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
            row = (np.minimum.accumulate(new - k, axis=1) + k).astype(np.int32)
            done = size == i + 1
            if done.any():
                out[lane[done]] = row[done].min(axis=1)
            if i % 8 == 7:  # lanes that are through, or that have more edits already than they may have, need no more steps
                live = (row.min(axis=1) <= budget) & (size > i + 1)
                if not live.all():
                    row, base, first, last, lane, budget, size, chars = (x[live] for x in (row, base, first, last, lane, budget, size, chars))
                    if not len(lane):
                        break
        return out


def _summed(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key, of counts by key."""
    held, size, most = [], 0, 1 << 20

    def merged() -> tuple[np.ndarray, np.ndarray]:
        if len(held) < 2:
            return held[0] if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        k, of = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return k, np.bincount(of, weights=np.concatenate([c for _, c in held]), minlength=len(k)).astype(np.int64)

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > most:  # a merge at least halves what is held or doubles the room
            held = [merged()]
            size, most = len(held[0][0]), max(most, 2 * len(held[0][0]))
    return merged()


def indexes(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", block: int = BLOCK_BYTES) -> Iterator[Index]:
    """One index for each block of items; an item without a letter or digit has nothing to look for."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = 1 + total // block
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).orderBy("i", "t").collect() if parts > 1 else items.orderBy("i", "t").collect()
        yield Index.of([(r.i, normal(r.t)) for r in rows])


def matches(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """(id, ``item_id``, ``n_windows`` of the item found in the text, fewest ``edits``) of contaminated rows.

    A row matches an item if it holds one of the item's windows within the edit budget, after both are brought
    to lower case with single spaces for all but letters and digits; an item of under Q bytes must occur exactly,
    as whole words. Null and empty texts match nothing, nor do items that are null or hold no letter or digit;
    null ids are kept; repeated rows repeat; empty tables give no rows; other columns are ignored. Whole
    texts, however long, are scanned in one narrow pass for each block of items.
    """
    prepare(df.sparkSession)
    docs = df.select(df[id_col].cast("long").alias("id"), utf8(text_col).alias("text"))
    sc, out = df.sparkSession.sparkContext, None
    for index in indexes(benchmark, **names):
        shared = sc.broadcast(index)  # no more than BLOCK_BYTES of items

        def run(batches, shared=shared):
            index = shared.value
            for b in slices(batches, "text", 2 << 20):
                found: dict[tuple[int, int], list[int]] = {}
                for t, w, d in index.find([normal(x.decode()) for x in b.column("text").to_pylist()]):
                    found.setdefault((t, int(index.item[w])), []).append(d)
                if found:
                    rows = pa.array([t for t, _ in found])
                    yield pa.RecordBatch.from_arrays([b.column("id").take(rows), pa.array([i for _, i in found]), pa.array([len(d) for d in found.values()]), pa.array([min(d) for d in found.values()], pa.int64())], ["id", "item_id", "n_windows", "edits"])

        part = docs.mapInArrow(run, "id bigint, item_id bigint, n_windows bigint, edits bigint")
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("id", id_col)


def clean(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **names) -> DataFrame:
    """The rows of ``df`` whose text matches no item, all columns as they are; no shuffle. Null texts stay."""
    prepare(df.sparkSession)
    sc = df.sparkSession.sparkContext
    for index in indexes(benchmark, **names):
        shared = sc.broadcast(index)

        def run(batches, shared=shared):
            for b in slices(batches, text_col, 2 << 20):
                bad = {t for t, _, _ in shared.value.find([normal(x or "") for x in b.column(text_col).to_pylist()])}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)]))

        df = df.mapInArrow(run, df.schema)
    return df
