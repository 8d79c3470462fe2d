import math
from collections import Counter

import numpy as np
import pytest

from reelspark.llm import boosting, quality, queries


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / n1 / (len(y) - n1)


def test_flat_traversal_equals_walking_the_nodes():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = boosting.fit(x, y, trees=20, depth=3)

    def walk(row):
        out = t.base
        for r in t.root:
            while t.left[r] != r:
                r = t.left[r] if row[t.feature[r]] <= t.cut[r] else t.right[r]
            out += t.value[r]
        return 1 / (1 + np.exp(-out))

    got = t.score(x)
    assert np.allclose(got, [walk(r) for r in x])
    assert ((got > 0.5) == y).mean() > 0.95


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op2_quality(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    test = out[out.held_out]
    a, acc = auc(test.quality.to_numpy(), test.score.to_numpy()), (test.predicted == test.quality).mean()
    print("quality: held-out AUC", a, "accuracy", acc)
    assert a > 0.8 and acc > 0.9
    import zlib

    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()


def plain_statistics(t):
    """The same numbers, one text at a time."""
    words, lines, size = t.split(), (t + b"\n").split(b"\n")[:-1], len(t)
    n, one, w1 = len(words), max(size, 1), max(len(words), 1)
    is_upper = lambda c: 65 <= c <= 90
    share = lambda f: sum(map(f, t)) / one
    threes = [tuple(words[i : i + 3]) for i in range(n - 2)]
    most = lambda x: max(Counter(x).values(), default=0)
    p = [c / one for c in Counter(t).values()]
    return [
        math.log1p(size), math.log1p(n), sum(map(len, words)) / w1, share(is_upper), share(lambda c: 48 <= c <= 57), share(lambda c: quality.MARKS[c]), share(lambda c: quality.SYMBOLS[c]), share(lambda c: c == 32),
        t.count(b"\n") / w1, share(lambda c: c >= 128), len(set(words)) / w1, most(words) / w1, sum(a == b for a, b in zip(words, words[1:])) / w1, len(set(threes)) / max(n - 2, 1), len(set(lines)) / len(lines), size / len(lines),
        sum(sum(map(is_upper, w)) >= max(2, 0.6 * len(w)) for w in words) / w1, sum(bool(quality.MARKS[w[-1]]) for w in words) / w1, sum(len(w) > 15 for w in words) / w1, sum(len(w) <= 3 for w in words) / w1,
        -sum(x * math.log2(x) for x in p), most(threes) / w1, sum(is_upper(w[0]) for w in words) / w1,
    ]


def walk(trees, row):
    out = trees.base
    for r in trees.root:
        while trees.left[r] != r:
            r = trees.left[r] if row[trees.feature[r]] <= trees.cut[r] else trees.right[r]
        out += trees.value[r]
    return 1 / (1 + math.exp(-min(max(out, -30), 30)))


def test_query_against_plain_statistics_and_trees(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in queries.op2_quality(spark, sf).collect()}
    model = boosting.fit(*boosting.training_rows(quality.features(docs), labels, "quality"))
    rows = docs.collect()
    texts = [(r.text or "").encode() for r in rows]
    for r, t in zip(rows, texts, strict=True):
        plain = plain_statistics(t)
        assert quality.statistics([t])[0].tolist() == pytest.approx(plain, abs=1e-12)
        want = walk(model, quality.statistics([b"x y", t])[1])
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == (want >= 0.3)
    for t in (b"", b"\n", b"A", b"ab AB a.b\n\nab", b"\xc3\xa9 " * 50, b"x" * 300_000):
        assert quality.statistics([t])[0].tolist() == pytest.approx(plain_statistics(t), abs=1e-12)


def test_statistics_of_odd_texts():
    x = quality.statistics([b"", b" \n", b"a", b"A A A A", "é".encode() * 100000, b"x " * 100000, b"\n\n\n"])
    assert x.shape == (7, len(quality.NAMES)) and np.isfinite(x).all()
    assert (quality.statistics([b"abc def", b"x"])[1] == quality.statistics([b"x"])[0]).all()


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, None, 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 0)], "doc_id long, quality int")
    out = quality.quality_scores(df, labels).collect()
    assert len(out) == 3 and {r.score for r in out} == {0.5} and {r.held_out for r in out if r.doc_id is None} == {True}
    assert quality.quality_scores(df.limit(0), labels.limit(0)).count() == 0
    keyed = quality.quality_scores(df.withColumnRenamed("doc_id", "k"), labels.withColumnRenamed("doc_id", "k"), id_col="k")
    assert keyed.columns[0] == "k" and keyed.count() == 3
