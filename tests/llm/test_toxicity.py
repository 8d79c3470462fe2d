import math
import random

import numpy as np
import pytest

from reelspark.llm import queries
from reelspark.llm import toxicity as T

from .test_quality import auc


def edits(a, b):
    """Edit distance with swaps of neighbours (each place edited once)."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)][len(b)]


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_edit_distance(seed):
    rng = random.Random(seed)
    made = lambda lo, hi: "".join(rng.choices("abcé", k=rng.randint(lo, hi)))
    terms = {made(3, 7): rng.random() < 0.4 for _ in range(6)}
    terms = [T.Term(t, s, 1.0 + i) for i, (t, s) in enumerate(terms.items())]
    words = [made(1, 9) for _ in range(600)] + [t.text for t in terms] + [t.text + made(1, 4) for t in terms]
    words += [w[:i] + "x" + w[i + 1 :] for t in terms for w in [t.text] for i in range(len(w))]
    m = T.Matcher(terms)
    points = np.array([ord(c) for w in words for c in w] + [10])
    ends = np.cumsum([len(w) for w in words])
    kind, _ = m.match(points, ends - [len(w) for w in words], ends)
    for w, k in zip(words, kind.tolist(), strict=True):
        want = 0
        for t in terms:
            fuzzy = len(t.text) >= T.FUZZY_LENGTH
            d = min(edits(t.text, w[:i]) for i in range(len(w) + 1)) if t.stem else edits(t.text, w)
            exact = w.startswith(t.text) if t.stem else w == t.text
            want = max(want, (2 if t.stem else 4) if exact else (1 if t.stem else 3) if fuzzy and d <= 1 else 0)
        assert k == want, (w, k, want, terms)


def plain_hit(word, terms, known={}):
    """(kind, weight) of a word: 4 a term, 3 a term with an error, 2 a stem, 1 a stem with an error."""
    key = (word, id(terms))
    if key not in known:
        best = (0, 0.0)
        for t in terms:
            n, long = len(t.text), len(t.text) >= T.FUZZY_LENGTH
            if t.stem:
                exact = word.startswith(t.text)
                near = long and any(edits(t.text, word[: n + d]) <= 1 for d in (-1, 0, 1))
            else:
                exact, near = word == t.text, long and abs(len(word) - n) < 2 and edits(t.text, word) <= 1
            best = max(best, ((2 if t.stem else 4) if exact else (1 if t.stem else 3), t.weight) if exact or near else (0, 0.0))
        known[key] = best
    return known[key]


def plain_features(text, terms):
    """The same sums, word by word."""
    t = text.lower()
    words, i = [], 0
    letter = lambda c: ord(c) >= 0x3000 or bool(T.WORD.fullmatch(c))
    while i < len(t):
        j = i
        while j < len(t) and letter(t[j]):
            j += 1
        if j > i:
            words.append((i, j, t[i:j]))
        i = max(j, i + 1)
    hits = [(k, s, e, *plain_hit(w, terms)) for k, (s, e, w) in enumerate(words)]
    hits = [h for h in hits if h[3]]
    n = {k: 0 for k in (1, 2, 3, 4)}
    total = top = quoted_n = cue_n = you_n = crowd_n = open_ = 0.0
    for k, s, e, kind, weight in hits:
        begin, end = t.rfind("\n", 0, s) + 1, (t + "\n").index("\n", e)
        quotes = lambda a, z: sum(c in T.QUOTES for c in t[a:z])
        quoted = quotes(begin, s) % 2 == 1 and quotes(e, end) > 0
        near = {w for _, _, w in words[max(0, k - T.WINDOW) : k + T.WINDOW + 1]}
        cue, you = bool(near & T.REPORTING), bool(near & T.ADDRESS)
        crowd = min(sum(abs(k - h[0]) <= T.WINDOW for h in hits) - 1, 3)
        score = weight * (0.6 if kind % 2 else 1.0) * (0.4 if quoted else 1) * (0.7 if cue else 1) * (1.2 if you else 1) * (1 + 0.2 * crowd)
        total, top, quoted_n, cue_n, you_n, crowd_n, open_ = total + score, max(top, score), quoted_n + quoted, cue_n + cue, you_n + you, crowd_n + crowd, open_ + score * (not quoted)
        n[kind] += 1
    w1 = max(len(words), 1)
    out = [math.log1p(len(words)), total, top, 100 * total / w1, 100 * len(hits) / w1, quoted_n, cue_n, you_n, crowd_n, open_]
    for k in (1, 2, 3, 4):
        out += [n[k], 100 * n[k] / w1]
    return [*out, len({h[4] for h in hits}), len({h[4] for h in hits if h[3] % 2 == 0})]


def walk(trees, row):
    out = trees.base
    for r in trees.root:
        while trees.left[r] != r:
            r = trees.left[r] if row[trees.feature[r]] <= trees.cut[r] else trees.right[r]
        out += trees.value[r]
    return 1 / (1 + math.exp(-min(max(out, -30), 30)))


def test_query_against_plain_features_and_trees(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, sf).collect()}
    model, _ = T.train(docs, labels, whole=False)
    assert model.terms and len(got) == docs.count()
    matcher = T.Matcher(model.terms)
    for r in docs.collect():
        row = T.context_features(["you x", r.text or ""], matcher)[1]
        assert row.tolist() == pytest.approx(plain_features(r.text or "", model.terms)), r.doc_id
        want = walk(model.trees, row)  # cuts may lie right on a value, so the last bit counts
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == (want >= 0.5), r.doc_id


def test_features_of_odd_texts_against_plain_ones():
    rng = random.Random(2)
    terms = [T.Term("moron", False, 2.0), T.Term("idio", True, 1.5), T.Term("馬鹿野郎だ", False, 3.0), T.Term("scum", False, 1.0), T.Term("dummkopf", True, 2.5)]
    bits = ["you", "said", "moron", "mor0n", "Idiot", "idio", "馬鹿野郎だ", "馬鹿郎だ", "scum", "Dumkopfig", '"', "„", "\n", "nice", "été", "İx", "_", "'", "。"]
    texts = ["", "\n", "moron", "。moron"] + [rng.choice(["", " "]).join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(300)] + [" ".join(rng.choices(bits, k=3000))]
    got = T.context_features(texts, T.Matcher(terms))
    for t, row in zip(texts, got.tolist(), strict=True):
        assert row == pytest.approx(plain_features(t, terms)), t
    assert got[:, 14].max() > 0 and got[:, 16].max() > 0


def test_quotation_weighs_less():
    m = T.Matcher([T.Term("moron", False, 2.0)])
    plain, quoted, missp, none, empty = T.context_features(["you are a moron ok", 'he said "you moron" ok', "you are a mor0n ok", "you are a nice ok", ""], m)
    assert plain[1] > quoted[1] > 0 and plain[1] > missp[1] > 0 and not none[1] and not empty.any()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op1_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    test = out[out.held_out]
    a, acc = auc(test.toxic.to_numpy(), test.score.to_numpy()), (test.predicted == test.toxic).mean()
    print("toxicity: held-out AUC", a, "accuracy", acc)
    assert a > 0.9 and acc > 0.95


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, None, 1), (3, "x" * 300_000, 1)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    out = T.toxicity_scores(df, labels).collect()
    assert len(out) == 4 and {r.score for r in out} == {0.5}
    assert T.toxicity_scores(df.limit(0), labels.limit(0)).count() == 0
