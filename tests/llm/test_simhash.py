import random
import re

import numpy as np
import pytest
import xxhash

from reelspark.llm import bitslice, queries
from reelspark.llm import simhash as S
from reelspark.llm.components import components


def test_close_pairs_matches_counting():
    rng = np.random.default_rng(1)
    for words, radius in ((1, 2), (1, 5), (4, 44)):
        base = rng.integers(0, 2**63, (12, words), dtype=np.uint64)
        codes = base[rng.integers(0, 12, 700)]
        for _ in range(radius):
            codes[np.arange(700), rng.integers(0, words, 700)] ^= rng.integers(0, 2, 700, dtype=np.uint64) << rng.integers(0, 64, 700, dtype=np.uint64)
        group = np.sort(rng.integers(0, 9, 700))
        got = {(i, j) for a, b in bitslice.close_pairs(codes, group, radius) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        d = np.bitwise_count(codes[:, None, :] ^ codes[None, :, :]).sum(-1)
        want = {(i, j) for i in range(700) for j in range(i + 1, 700) if group[i] == group[j] and d[i, j] <= radius}
        assert got == want and want


def brute(rows):
    fps = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(rows[i][0]), find(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((i, f"{f:016x}", find(i)) for (i, _), f in zip(rows, fps, strict=True))


def test_query_against_brute_force(spark, sf_dir, tmp_path):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for i in range(60):
        w = rng.choice(rows)[1].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((10_000 + i, " ".join(w)))
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "One"), (20_004, "one"), (20_005, "É é")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op6_simhash(spark, str(tmp_path)).collect()))
    want = brute(rows)
    assert got == want and sum(r[0] != r[2] for r in want) > 20


@pytest.mark.parametrize("radius,blocks", [(2, 8), (1, 4)])
def test_masks_cover_the_radius(radius, blocks):
    masks = S.block_masks(radius, blocks)
    for flips in ((0, 63), (5, 6), (31, 32))[: 3 if radius == 2 else 0]:
        x = sum(1 << f for f in flips)
        assert any(not x & m for m in masks)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 103), (103, 205)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 103, 103: 103, 205: 103}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    ids = list(range(1000))
    random.Random(3).shuffle(ids)  # a long chain whose ids come in any order
    got = components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long").repartition(4)).collect()
    assert {r.component for r in got} == {0} and len(got) == 1000


def test_large_groups_are_dealt_out_as_tiles(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    key = lambda df: sorted((r.doc_id, r.component_id) for r in df.collect())
    want, kept = key(S.near_duplicates(docs, size=3, radius=2, masks=S.block_masks(2, 8))), sorted(r.doc_id for r in S.one_of_each(docs).collect())
    monkeypatch.setattr(S, "GROUP", 2)
    assert key(S.near_duplicates(docs, size=3, radius=2, masks=S.block_masks(2, 8))) == want
    assert sorted(r.doc_id for r in S.one_of_each(docs).collect()) == kept


@pytest.mark.parametrize("words", [9, 14, 40, 300])
def test_pairs_right_at_the_similarity_meet(words):
    """Of pairs of texts with a similarity of 0.8 to 0.85 almost all share a key and lie within the last radius."""
    rng = random.Random(words)
    met = n = 0
    while n < 300:
        a = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        b = list(a)
        for _ in range(max(1, round(words / 50))):
            rng.choice([lambda: b.append(f"x{rng.randrange(10**6)}"), lambda: b.insert(0, f"x{rng.randrange(10**6)}"), lambda: b.__setitem__(rng.randrange(len(b)), f"x{rng.randrange(10**6)}")])()
        x, y = (np.unique(S.shingle_hashes(" ".join(t).encode(), 5)) for t in (a, b))
        both = len(np.intersect1d(x, y))
        if 0.8 <= both / (len(x) + len(y) - both) < 0.86:
            codes = [[S.majority(S.mix64(h + np.uint64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if w else h) for w in range(4)] for h in (x, y)]
            n += 1
            met += (S.table_keys(x) == S.table_keys(y)).any() and sum((p ^ q).bit_count() for p, q in zip(*codes)) <= S.RADII[-1]
    assert met >= 0.985 * n


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c", 0), (1, "a b c", 0), (None, "a b c", 0)], "doc_id long, text string, code int")
    out = S.near_duplicates(df, radius=2, masks=S.block_masks(2, 8)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in out) == [(0, 1), (1, 1), (1, 1)]
    assert S.near_duplicates(df.limit(0), radius=2, masks=S.block_masks(2, 8)).count() == 0


def firsts(rows, size, least):
    """The ids that stay if every pair of texts is compared by its shingles."""
    sets = {}
    for i, t in rows:
        w = t.lower().encode().split()
        sets[i] = {b" ".join(w[k : k + size]) for k in range(len(w) - size + 1)} or {b" ".join(w)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i for i in ids if find(i) == i}


@pytest.mark.parametrize("seed,tile", [(1, 256), (2, 16)])
def test_dense_group_of_edited_copies_is_settled_exactly(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(S, "TILE", tile, raising=False)
    rng = random.Random(seed)
    base, rows = [f"w{rng.randrange(5000)}" for _ in range(200)], []
    for i in range(300):
        rows.append((i, " ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in base)))
    rng.shuffle(rows)
    got = [r.doc_id for r in S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = firsts(rows, 5, 0.8)
    assert 40 < len(want) < 250 and sorted(got) == sorted(want), (len(got), len(want))
