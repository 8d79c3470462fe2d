import random

import pytest

from reelspark.llm.token_counts import DEFAULT_VOCABULARY, LongestMatch, read_vocabulary, token_counts


def greedy(text, tokens, longest):
    n = 0
    for w in text.encode().split():
        w, i = b" " + w, 0
        while i < len(w):
            i = next(j for j in range(min(len(w), i + longest), i, -1) if j == i + 1 or w[i:j] in tokens)
            n += 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_small_random_vocabularies(spark, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("ab ", k=rng.randint(1, 7))).encode() for _ in range(25)]
    texts = ["".join(rng.choices("ab c\n", k=rng.randint(0, 60))) for _ in range(80)]
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocab).collect()}
    assert got == {i: greedy(t, set(vocab), 7) for i, t in enumerate(texts)}


def test_public_vocabulary_on_the_documents(spark, sf_dir):
    vocab = read_vocabulary(DEFAULT_VOCABULARY)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens, longest = set(vocab), max(map(len, vocab))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(docs, vocab).collect()}
    assert got == {r.doc_id: (len(r.text.encode().split()), greedy(r.text, tokens, longest)) for r in docs.collect()}


def test_very_long_words(spark):
    """Words of a hundred thousand to two million bytes, among short ones."""
    rng = random.Random(9)
    vocab = ["".join(rng.choices("ab", k=rng.randint(1, 7))).encode() for _ in range(25)]
    texts = ["ab " * 50 + "".join(rng.choices("abc", k=100_000)) + " b", "".join(rng.choices("ab", k=70)), "x" * 2_000_000]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocab).collect()}
    assert got[0] == (52, greedy(texts[0], set(vocab), 7)) and got[1] == (1, greedy(texts[1], set(vocab), 7)) and got[2] == (1, 2_000_001)


def test_nulls_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "aa bb", 7), (2, "aa bb", 7)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(df, [b" a", b"bb"]).collect()), key=str)
    assert got == sorted([(1, 0, 0), (None, 0, 0), (2, 2, 4), (2, 2, 4)], key=str)
    assert token_counts(df.limit(0), [b"a"]).count() == 0


def test_failure_links_pop_several_tokens():
    auto = LongestMatch([b"abcde", b"ab", b"cd"], prefix=b"")
    import numpy as np

    buf = np.frombuffer(b"abcdf\n", np.uint8)
    assert auto.count(buf, np.array([0]), np.array([5])).tolist() == [3]
