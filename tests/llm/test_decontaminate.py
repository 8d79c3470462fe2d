import random

import numpy as np
import pytest

from reelspark.llm import decontaminate as D
from reelspark.llm import queries


def sellers(window, text):
    """Fewest edits of the window against any part of the text."""
    row = list(range(len(window) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, w in enumerate(window, 1):
            new.append(min(row[i - 1] + (w != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def changed(rng, t, n):
    t = list(t)
    for _ in range(n):
        i = rng.randrange(len(t))
        rng.choice([lambda: t.__setitem__(i, "z"), lambda: t.insert(i, "y"), lambda: t.pop(i)])()
    return "".join(t)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices(["an", "th", "er", "on", "re", "ing"], k=rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.choice([12, 25, 60]))) for i in range(12)]
    docs = []
    for i in range(60):
        t = text(rng.randint(5, 60))
        if i % 2:
            q = rng.choice(items)[1]
            cut = q if rng.random() < 0.6 else q[: rng.randint(len(q) // 2, len(q))]
            t = t + " " + changed(rng, cut, rng.choice([0, 2, 5, 9, 12, 20])) + " " + text(5)
        docs.append((i, t))
    return items, docs


def test_against_full_alignment(spark, data):
    items, docs = data
    index = D.Index.of([(i, D.normal(t)) for i, t in items])
    want = []
    for i, t in docs:
        for item in {int(x) for x in index.item}:
            d = [s for w in np.flatnonzero(index.item == item) if (s := sellers(index.windows[w], D.normal(t))) <= index.budget[w]]
            if d:
                want.append((i, item, len(d), min(d)))
    got = D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 15
    kept = {r.doc_id for r in D.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {i for i, _ in docs} - {w[0] for w in want}


def test_blocks_of_items_give_the_same(spark, data):
    items, docs = data
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, D.matches(d, b).collect()))
    assert one == sorted(map(tuple, D.matches(d, b, block=700).collect()))


def test_verbatim_leaks_of_the_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").collect(), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if D.normal(i.text) in D.normal(d.text)}
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontaminate(spark, sf).collect()}
    assert want and want <= got and len(got) < 2 * len(want)


def test_edges(spark):
    d = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "The QUICK brown-fox, jumps over a lazy dog", 1)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, None), (3, ""), (4, "tiny"), (None, "x")], "item_id long, text string")
    assert [tuple(r) for r in D.matches(d, b).collect()] == [(None, 1, 1, 0)]
    d2 = d.union(spark.createDataFrame([(7, "A TINY thing", 1), (8, "tinyx = 42; x == 42!", 1), (9, "x 4 2 tin y", 1)], d.schema))
    b2 = b.union(spark.createDataFrame([(5, "x = 42"), (6, "?!"), (7, "a lazy"), (8, "x = 42")], b.schema))
    assert sorted(map(tuple, D.matches(d2, b2).filter("doc_id is not null").collect())) == [(7, 4, 1, 0), (8, 5, 1, 0), (8, 8, 1, 0)]
    assert [tuple(r) for r in D.matches(d2, b2).filter("doc_id is null and item_id > 1").collect()] == [(None, 7, 1, 0)]
    assert {r.doc_id for r in D.clean(d2, b2).collect()} == {1, 2, 9}
    assert D.matches(d, b.limit(0)).count() == 0 and D.matches(d.limit(0), b).count() == 0 and D.clean(d, b).count() == 2


@pytest.mark.parametrize("n", [70, 80, 160, 161, 190, 224, 303, 384])
def test_excerpts_at_all_offsets_against_full_alignment(n):
    rng = random.Random(n)
    text = lambda k: "".join(rng.choices("abcdefghij klmnop", k=k))
    item = D.normal(text(3 * n))[:n].strip().ljust(n, b"q")
    index = D.Index.of([(5, item)])
    docs, clear = [], []
    for length in {69, 80, 100, 118, 130, 150, n} - set(range(n + 1, 200)):
        for a in range(n - length + 1):
            docs.append(b" ".join([D.normal(text(60)), item[a : a + length], D.normal(text(40))]))
    found = {}
    for t, w, d in index.find(docs):
        found.setdefault(t, {})[w] = d
    assert sorted(found) == list(range(len(docs))) and all(0 in x.values() for x in found.values())
    for t in rng.sample(range(len(docs)), min(3, len(docs))):
        want = {w: s for w, x in enumerate(index.windows) if (s := sellers(x, docs[t])) <= index.budget[w]}
        assert found[t] == want


def test_common_grams_are_looked_at_in_portions(monkeypatch):
    """A q-gram that is frequent on both sides: the pairs of places are counted in portions of bounded size."""
    rng = random.Random(4)
    items = [(i, D.normal("the same question again and again " * 2 + str(rng.random()))) for i in range(40)]
    index = D.Index.of(items)
    long = D.normal("the same question again and again " * 60)
    texts = [long, b"nothing of it", items[7][1], long + b" " + items[9][1]]
    want = index.find(texts)
    exact = {(t, int(index.item[w])) for t, w, d in want if not d and len(index.windows[w]) > 80}
    assert (2, 7) in exact and (3, 9) in exact and not [1 for t, _, _ in want if t == 1]
    most = []
    of = index._windows_of
    monkeypatch.setattr(index, "_windows_of", lambda owner, place: most.append(len(owner)) or of(owner, place))
    monkeypatch.setattr(D, "WORK", 9973)
    monkeypatch.setattr(D, "WINDOW_WORK", 4999)
    assert index.find(texts) == want and max(most) <= 4999 and len(most) > 10
