"""Bit-sliced Hamming comparison within groups of binary codes.

Codes are stored vertically: bit plane p holds bit p of 64 codes in one word. Codes sorted by group are
compared with those ``shift`` places on, 64 pairs a word, for growing shifts: differing bits are added to
counters kept as bit planes by carry-save adders. A counter starts so high that passing the radius carries
out of its top plane, and blocks (words) in which every pair has passed it are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
ALL = U(0xFFFFFFFFFFFFFFFF)


def planes_of(codes: np.ndarray) -> np.ndarray:
    """(bits, blocks) words from (n, words) codes; bit i of block j belongs to code 64 * j + i."""
    n, words = codes.shape
    pad = np.zeros((-(-n // 64) * 64, words), dtype=U)
    pad[:n] = codes
    out = np.empty((words * 64, len(pad) // 64), dtype=U)
    for lo in range(0, len(pad), 1 << 15):  # in pieces, as single bits take a byte each
        bits = np.unpackbits(pad[lo : lo + (1 << 15)].view(np.uint8), axis=1, bitorder="little")
        out[:, lo // 64 : (lo + len(bits)) // 64] = np.packbits(bits.T.copy(), axis=1, bitorder="little").view(U)
    return out


def _shifted(plane: np.ndarray, at: np.ndarray, part: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Words that begin ``part`` bits into the words ``at``; a shift by 64 leaves nothing."""
    return (plane[at] >> part) | (plane[at + 1] << rest)


def _runs(reach: np.ndarray, longest: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(blocks, shift of each) for growing shifts, several shifts together until there are ``width`` blocks."""
    held, size = [], 0
    for shift in range(1, longest):
        blocks = np.flatnonzero(reach >= shift)
        held.append((blocks, np.full(len(blocks), shift)))
        size += len(blocks)
        if size >= width or shift == longest - 1:
            yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held, size = [], 0


def close_pairs(codes: np.ndarray, group: np.ndarray, radius: int, step: int = 8, width: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of equal ``group`` whose codes differ in at most ``radius`` bits.

    ``codes`` is (n, words) of 64-bit words; rows of one group must be adjacent.
    """
    n = len(codes)
    if n < 2:
        return
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, n])
    planes = planes_of(codes)
    blocks_n = planes.shape[1]
    longest = int(sizes.max())
    planes = np.concatenate([planes, np.zeros((len(planes), longest // 64 + 2), dtype=U)], axis=1)
    last = np.zeros(blocks_n * 64, dtype=np.int64)  # end of each row's group; 0 beyond the rows
    last[:n] = np.repeat(first + sizes, sizes)
    m = max(1, int(radius).bit_length())
    start = (1 << m) - 1 - radius
    reach = np.zeros(blocks_n, dtype=np.int64)  # longest shift that a block still has pairs at
    np.maximum.at(reach, np.arange(n) // 64, last[:n] - 1 - np.arange(n))
    for blocks, shift in _runs(reach, longest, width):
        lane = blocks[:, None] * 64 + np.arange(64)
        valid = np.packbits(lane + shift[:, None] < last[lane], axis=1, bitorder="little").view(U)[:, 0]
        over = ~valid
        at, part = blocks + shift // 64, (shift % 64).astype(U)
        rest = U(64) - part
        counter = [np.full(len(blocks), ALL if start >> k & 1 else U(0)) for k in range(m)]
        for p in range(0, len(planes), 2):
            a = planes[p][blocks] ^ _shifted(planes[p], at, part, rest)
            b = planes[p + 1][blocks] ^ _shifted(planes[p + 1], at, part, rest)
            c = counter[0]
            u = c ^ a
            counter[0] = u ^ b
            carry = (c & a) | (u & b)
            for k in range(1, m):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if p % step == step - 2:
                live = over != ALL
                if not live.all():
                    blocks, over, shift, at, part, rest = (x[live] for x in (blocks, over, shift, at, part, rest))
                    counter = [x[live] for x in counter]
                    if not len(blocks):
                        break
        if len(blocks):
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            row, bit = np.nonzero(hit)
            if len(row):
                i = blocks[row] * 64 + bit
                yield i, i + shift[row]


class Forest:
    """Union-find over small integers; ``spanning`` keeps only the pairs that join two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.label = np.arange(n)  # roots as of the last look; trees only grow together

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs are not known to lie in one tree."""
        return self.label[left] != self.label[right]

    def spanning(self, left: np.ndarray, right: np.ndarray, portion: int = 4096) -> list[tuple[int, int]]:
        kept = []
        while True:  # in portions, so that pairs of one tree are dropped in bulk
            some = self.apart(left, right)
            left, right = left[some], right[some]
            if not len(left):
                return kept
            before = len(kept)
            for a, b in zip(left[:portion].tolist(), right[:portion].tolist(), strict=True):
                x, y = self.find(a), self.find(b)
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
                    kept.append((a, b))
            left, right = left[portion:], right[portion:]
            if len(kept) > before:
                root = np.array(self.parent)
                while ((up := root[root]) != root).any():
                    root = up
                self.label = root
