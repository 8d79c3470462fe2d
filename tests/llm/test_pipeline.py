"""Each stage against a brute-force version, on its own input."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline as P
from reelspark.llm import secrets as S
from reelspark.llm import toxicity as T

from .test_secrets import brute as secret_spans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) rows of every stage."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    from reelspark.llm.common import spill

    rng = random.Random(8)
    rows = docs.collect()
    extra = []
    for i in range(80):  # near copies of longer texts: a few words changed
        r = rng.choice([x for x in rows if 80 < len(x.text.split()) < 600])
        w = r.text.split(" ")
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", ""])
        extra.append((50_000 + i, " ".join(w), r.lang, r.source, len(" ".join(w))))
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    for name, f in P.STAGES:
        got = spill(f(spark, docs, SF), "t")
        out.append((docs.collect(), got.collect(), got.columns, docs.columns))
        docs = got
    return out


def test_toxic_documents_go(spark, stages):
    before, after, columns, were = stages[0]
    docs = spark.createDataFrame(before, spark.read.parquet(f"{SF}/documents.parquet").schema)
    scores = {r.doc_id: r.score for r in T.toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert columns == were and {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id] < 0.5}
    assert 0 < len(before) - len(after) < 0.2 * len(before)


def test_one_of_each_group_stays(stages):
    before, after, columns, were = stages[1]

    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {r.doc_id: shingles(r.text) for r in before}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    near = {(a, b) for h in holders.values() if len(h) < 60 for k, a in enumerate(h) for b in h[:k]}
    for a, b in near:
        x, y = sets[a], sets[b]
        if len(x & y) >= 0.8 * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    want = {i for i in sets if find(i) == i}
    got = {r.doc_id for r in after}
    assert columns == were and want <= got, "a clean document is gone"
    assert len(got - want) <= 0.02 * (len(sets) - len(want)), "near copies are left"
    assert len(sets) - len(want) > 60


def test_contaminated_documents_go(spark, stages):
    """Who holds 69 bytes of an item goes; who shares no 11 bytes with one, which any window found must, stays."""
    before, after, columns, were = stages[2]
    plain = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip().encode()
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    parts = lambda n: {t[i : i + n] for t in items for i in range(len(t) - n + 1)}
    long, short = parts(69) | {t for t in items if len(t) < 69}, parts(11)
    kept, bad = {r.doc_id for r in after}, 0
    for r in before:
        t = plain(r.text)
        held = any(t[i : i + 69] in long for i in range(len(t))) or any(x in t for x in items if len(x) < 69)
        bad += held
        if held:
            assert r.doc_id not in kept
        elif r.doc_id not in kept:
            assert any(t[i : i + 11] in short for i in range(len(t)))
    assert columns == were and kept <= {r.doc_id for r in before} and 0 < bad <= len(before) - len(after) <= 1.5 * bad


def test_secrets_are_hidden(stages):
    before, after, columns, were = stages[3]
    got = {r.doc_id: r for r in after}
    assert columns == were and set(got) == {r.doc_id for r in before}
    changed = 0
    for r in before:
        spans, t = sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in secret_spans(r.text).split(",") if x), r.text
        runs = []
        for a, z in spans:
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], z)
            else:
                runs.append([a, z])
        for a, z in reversed(runs):
            t = t[:a] + "[SECRET]" + t[z:]
        assert got[r.doc_id].text == t and got[r.doc_id].n_chars == (len(t) if runs else r.n_chars)
        changed += bool(runs)
    assert changed


def test_mixing(stages):
    before, after, _, _ = stages[4]
    sources = Counter(r.source for r in before)
    number = lambda *k: int(hashlib.md5("|".join(map(str, k)).encode()).hexdigest()[:13], 16) / 2**52
    want = []
    for r in before:
        rate = len(before) / len(sources) / sources[r.source]
        u, k, p, c = number(42, r.doc_id), 0, math.exp(-rate), math.exp(-rate)
        while u >= c and k < 200:
            k += 1
            p *= rate / k
            c += p
        want += [(r.doc_id, i, number(43, r.doc_id, i), r.text) for i in range(k)]
    assert sorted((r.doc_id, r["copy"], r.shuffle_key, r.text) for r in after) == sorted(want) and len(after) > 0.7 * len(before)


def test_stages_take_nulls_empty_tables_and_clashing_columns(spark):
    """Null and empty texts, repeated rows, null ids, columns named as inner ones, no rows at all, no n_chars."""
    rows = [(1, None, "a", 0), (2, "", "a", 0), (3, "plain words of a text", None, 21), (3, "plain words of a text", None, 21), (None, "token=abcdef99", "b", 14), (4, "token = abcdef99 it is", "b", 22), (5, "x " * 50_000, "a", 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    for extra in ("id", "code", "__spans", "__before", "__gone", "spans", "__n", "s0", "key"):
        docs = docs.withColumn(extra, P.F.lit(7))
    for name, f in P.STAGES:
        for d in (docs, docs.limit(0), docs.drop("n_chars")):
            got = f(spark, d, "/root/testdata/sf0.001")
            out = got.collect()
            assert set(d.columns) <= set(got.columns) and all(r["__spans"] == 7 and r["__n"] == 7 and r["id"] == 7 for r in out), name
            if d is docs and name != "mixing sources":
                ids = sorted(r.doc_id or 0 for r in out)
                assert ids == ([0, 1, 3, 3, 4, 5] if name == "simhash near-dedup" else [0, 1, 2, 3, 3, 4, 5]), name  # 1 and 2: no words
            if name == "secret scans":
                assert {r.doc_id: r.text for r in out}.get(4, "[SECRET] it is") == "[SECRET] it is"


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "secret scans", "mixing sources"]
    assert P.run(spark, "/root/testdata/sf0.001").count() > 50
    assert S.WINDOW == 20
