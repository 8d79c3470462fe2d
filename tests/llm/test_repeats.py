import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelspark.llm import phrases, queries, substrings, windows
from reelspark.llm.common import packed


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    """Documents with passages, whole texts and parts of them planted again."""
    rng = random.Random(11)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for i in range(70):
        a, b = rng.choice(rows)[1], rng.choice(rows)[1]
        lo = rng.randrange(len(a))
        cut = a[lo : lo + rng.choice([390, 399, 400, 405, 900, 3000])]
        rows.append((rng.choice([-1, 1]) * (5000 + i), b[:100] + cut + b[100:300] + rng.choice(["", cut, cut[:410]])))
    rows += [(rows[5][0], rows[9][1][:2000]), (rows[6][0], rows[7][1])]  # ids with several texts
    rows += [(9000, rows[3][1]), (9001, rows[3][1]), (9002, None), (9003, ""), (9004, "é" * 500), (9005, "x" * 1200), (9006, " ".join("same" for _ in range(40)))]
    return rows


def brute_bytes(rows, n):
    seen = defaultdict(int)
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] += 1
    out = []
    for (k, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((k, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, n):
    least = {}
    words = [(t or "").encode().split() for _, t in rows]
    for (k, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - n + 1):
            x = tuple(w[i : i + n])
            least[x] = min(least.get(x, k), k)
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < k:
                gone[i : i + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_both_queries_against_brute_force(spark, rows, tmp_path, monkeypatch, hot):
    if hot:  # frequent grams and small pieces come into play
        monkeypatch.setattr(windows, "HOT_MIN", 5)
        monkeypatch.setattr(windows, "LOCAL_MIN", 2)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op8_phrase_dedup(spark, str(tmp_path)).collect()))
    want = brute_words(rows, 13)
    assert got == want and sum(r[2] > 0 for r in want) > 50
    got = sorted(map(tuple, queries.op3_suffix_dedup(spark, str(tmp_path)).collect()), key=str)
    want = brute_bytes(rows, 400)
    assert got == want and sum(r[2] > 0 for r in want) > 50


def test_small_strings_and_pieces(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abc ", k=rng.randint(0, 200)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substrings.remove_repeats(df, least=8, gram=4).collect()), key=str)
    assert got == brute_bytes(rows, 8)


@pytest.mark.parametrize("words", [False, True])
def test_pieces_hold_every_window_once(monkeypatch, words):
    monkeypatch.setattr(windows, "PIECE_BYTES", 64)
    kind = windows.Kind(span=8, gram=4, words=words)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(n)).encode() for n in (300, 0, 1, 9, 40)]
    got = []
    for s in kind.cut_up(texts):
        piece, first, last, _ = kind.segments(s, np.zeros(0, np.uint64))
        for p, a, z in zip(piece.tolist(), first.tolist(), last.tolist(), strict=True):
            got += [(int(s.row[p]), int(s.base[p] + x - s.first[p]), s.cut_out(x, x + 8)) for x in range(a, z + 1)]
    units = [t.split() if words else t for t in texts]
    want = [(i, x, b" ".join(u[x : x + 8]) if words else u[x : x + 8]) for i, u in enumerate(units) for x in range(len(u) - 7)]
    assert sorted(got) == want and len(want) > 300


def test_long_texts_and_shared_keys(spark, rows, tmp_path, monkeypatch):
    """Texts of many pieces, and rows that all have one key."""
    monkeypatch.setattr(windows, "PIECE_BYTES", 3000)
    monkeypatch.setattr(windows, "SLICE_BYTES", 5000)
    monkeypatch.setattr(substrings, "row_key", lambda *_: substrings.F.lit(7).cast("long"))
    some = rows[:60] + rows[-80:]
    some = some + [(7000, " ".join(t for _, t in some[:30] if t)), (7001, " ".join(t for _, t in some[20:50] if t))]
    spark.createDataFrame(some, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op8_phrase_dedup(spark, str(tmp_path)).collect()))
    assert got == brute_words(some, 13)
    distinct = [r for i, r in enumerate(some) if r[0] not in {x for x, _ in some[:i]}]  # rows of one id share the key
    spark.createDataFrame(distinct, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/d/documents.parquet")
    got = sorted(map(tuple, queries.op3_suffix_dedup(spark, f"{tmp_path}/d").collect()), key=str)
    assert got == brute_bytes(distinct, 400)


def test_a_text_of_70_megabytes_is_cut_into_pieces():
    kind = windows.Kind(span=400, gram=32, words=False, sampled=16)
    n = units = 0
    for s in kind.cut_up([b"0123456789 abcdefghij " * 3_300_000, b"x" * 5000]):
        n += 1
        units = max(units, len(s.grams))
    assert n > 15 and units < 2 * windows.PIECE_BYTES


def test_edges(spark):
    t = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, t, 0), (1, t, 0), (None, t, 0), (2, None, 0)], "doc_id long, text string, key int")
    out = {(r.doc_id, r.n_words, r.n_removed) for r in phrases.remove_repeats(df).collect()}
    assert out == {(1, 200, 0), (None, 200, 0), (2, 0, 0)}
    out = sorted((str(r.doc_id), r.n_removed == len(t)) for r in substrings.remove_repeats(df).collect())
    assert out == [("1", True), ("1", True), ("2", False), ("None", True)]
    assert phrases.remove_repeats(df.limit(0)).count() == 0 and substrings.remove_repeats(df.limit(0)).count() == 0


def test_shards_are_handed_out_while_the_rows_come():
    """A task holds no more than a table and a batch of its segments."""
    taken = []

    def batches():
        for i in range(40):
            taken.append(i)
            h = [i // 3, i // 3, i // 3 + (i % 3 == 2)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((h, [5, 5, 9], [b"x" * 100, b"x" * 100, b"y" * 50], [1, 2, 1], [i, 7, 8], [i, 70, 8]), windows.SEGMENTS, strict=True)], schema=windows.SEGMENTS)

    ahead, rows = [], []
    for t in windows.shards(batches(), 300):
        ahead.append(len(taken))
        rows += t.to_pylist()
        assert t.column("seg").nbytes < 2000
    assert ahead[0] < 6 and len(ahead) > 4
    got = [(r["h"], r["sh"]) for r in rows]
    assert sum(r["n"] for r in rows) == 160 and len({r["h"] for r in rows}) == 14
    assert all(a != b for a, b in zip(got[:-1], got[1:], strict=True)) and [x for x, _ in got] == sorted(x for x, _ in got)


def found(spark, rows, kind, marked):
    df = spark.createDataFrame(rows, "key long, mark long, text string").withColumn("text", F.col("text").cast("binary"))
    whole, places = windows.recurring_segments(df, packed(df).repartition(4, "key"), kind, marked=marked)
    return [r.asDict() for r in whole.collect()], [r.asDict() for r in places.collect()]


def test_a_repeated_gram_alone_has_no_segment_looked_at(spark):
    """Texts that share 150 bytes have no window of 400 in common; those that share 600 keep theirs."""
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    kind = windows.Kind(span=400, gram=32, words=False, sampled=16)
    short, long = words(22)[:150], words(90)[:600]
    assert found(spark, [(i, i, words(100) + short + words(100)) for i in range(8)], kind, False) == ([], [])
    whole, places = found(spark, [(i, i, words(100) + long + words(100)) for i in range(8)], kind, False)
    covered = {(p["key"], p["start"] + i) for p in places for i in range(p["windows"])}
    assert all(sum(1 for k, _ in covered if k == key) >= 201 for key in range(8)) and sum(r["n"] for r in whole) == len(places)


@pytest.mark.parametrize("held", [1, 1 << 18])
def test_keys_that_recur_in_one_task_or_over_tasks(spark, monkeypatch, held):
    monkeypatch.setattr(windows, "HELD_KEYS", held)
    monkeypatch.setattr(windows, "SLICE_BYTES", 100)
    kind = windows.Kind(span=5, gram=3, words=True)
    phrase = "one two three four five six seven"
    rows = [(i, i % 5, f"a{i} b{i} c{i} {phrase} d{i} e{i}") for i in range(40)] + [(50, 9, "u v w x y z"), (51, 9, "u v w x y z"), (52, 8, None)]
    df = spark.createDataFrame([r for r in rows if r[2]], "key long, mark long, text string").withColumn("text", F.col("text").cast("binary")).repartition(6)
    hot = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    s = next(kind.cut_up([phrase.encode()]))
    want = set(kind.segments(s, hot.value)[3].view(np.int64).tolist())
    got = {(r.key, r.h) for r in windows.recurring_keys(df, kind, hot, marked=True).collect()}
    assert {(k, h) for k in range(40) for h in want} <= got and not {k for k, _ in got} & {50, 51}
    assert {50, 51} <= {r.key for r in windows.recurring_keys(df, kind, hot, marked=False).collect()}


@pytest.mark.parametrize("operator", [phrases, substrings])
def test_the_texts_are_shuffled_once(spark, rows, operator):
    out = operator.remove_repeats(spark.createDataFrame(rows[:80], "doc_id long, text string"))
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [x for x in final.splitlines() if "Exchange hashpartitioning(key" in x and "REPARTITION_BY_NUM" in x]
    assert len(dealt) > 1 and sum("ReusedExchange" not in x for x in dealt) == 1


@pytest.mark.parametrize("least", [1, 3, 8, 9, 20])
def test_places_of_repeated_strings(least):
    """The expansion starts at strings of eight symbols, or of all for less."""
    rng = random.Random(least)
    for _ in range(200):
        segs = ["".join(rng.choices(rng.choice(["ab", "abcdefgh", "é日x"]), k=rng.randint(1, 60))).encode() for _ in range(rng.randint(1, 6))]
        copies = [rng.choice([1, 1, 1, 2]) for _ in segs]
        seen = defaultdict(int)
        for s, n in zip(segs, copies, strict=True):
            for i in range(len(s) - least + 1):
                seen[s[i : i + least]] += n
        got = [sorted(x for a, z in f for x in range(a, z + 1)) for f in substrings.repeated_places(segs, copies, least)]
        assert got == [[i for i in range(len(s) - least + 1) if seen[s[i : i + least]] > 1] for s in segs]


def test_texts_of_few_words(spark):
    """A slice may have fewer words than a gram."""
    for n in range(6):
        out = phrases.remove_repeats(spark.createDataFrame([(1, " ".join("abcdef"[:n]))], "doc_id long, text string").coalesce(1)).collect()
        assert [(r.doc_id, r.n_words, r.n_removed) for r in out] == [(1, n, 0)]
