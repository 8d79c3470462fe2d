import math

import pytest

from reelspark.llm import mixing as M


def test_counts_are_poisson_quantiles(spark):
    rows = [(i, f"s{i % 3}" if i % 3 else None, f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    out = M.mix(df, {None: 1.0, "s1": 2.0, "s2": 0.0}).collect()
    n = {}
    for r in out:
        n.setdefault(r.doc_id, []).append(r["copy"])
    us = {r[0]: r[1] for r in df.select("doc_id", M.uniform(42, M.F.col("doc_id"))).collect()}
    for i, s, _ in rows:
        rate = {None: 1.0, "s1": 2.0, "s2": 0.0}[s]
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while us[i] >= c and k < 500:
            k += 1
            p *= rate / k
            c += p
        assert sorted(n.get(i, [])) == list(range(k)), (i, rate)
    by = {s: sum(1 for r in out if r.source == s) for s in (None, "s1", "s2")}
    assert by["s2"] == 0 and 850 < by[None] < 1150 and 1800 < by["s1"] < 2200
    keys = [r.shuffle_key for r in out]
    assert len(set(keys)) == len(keys) and all(0 <= k < 1 for k in keys)


def test_same_result_for_any_layout_salted_or_not(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 7 // 3}") for i in range(500)], "doc_id long, source string")
    a = sorted(map(tuple, M.mix(df).collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert a == sorted(map(tuple, M.mix(df.repartition(13)).collect()))


def test_edges(spark):
    df = spark.createDataFrame([(1, "a", "x", 9), (1, "a", "x", 9), (None, None, None, 9)], "doc_id long, source string, text string, copy int")
    out = M.mix(df, total=30).collect()
    twins = sorted(r["copy"] for r in out if r.doc_id == 1)
    assert twins == sorted(2 * list(range(len(twins) // 2)))
    assert M.mix(df.limit(0)).count() == 0
    named = spark.createDataFrame([(i, "a", i, -i, f"{i}") for i in range(50)], "doc_id long, source string, __n long, __cdf long, __source string")
    out = M.mix(named).collect()
    assert out and all(r["__n"] == r.doc_id and r["__cdf"] == -r.doc_id and r["__source"] == str(r.doc_id) for r in out)
    with pytest.raises(Exception, match="repeated more than"):
        M.mix(df, total=1000).count()


def test_a_source_of_one_row_is_repeated_to_its_weight(spark):
    rows = [(i, f"s{i % 20}") for i in range(6000)] + [(6000, None)]
    out = M.mix(spark.createDataFrame(rows, "doc_id long, source string").repartition(3)).collect()
    by = {s: [r["copy"] for r in out if r.source == s] for s in (None, "s0", "s7")}
    rate = 6001 / 21
    assert sorted(by[None]) == list(range(len(by[None]))) and all(abs(len(x) - rate) < 5 * rate**0.5 for x in by.values())


@pytest.mark.parametrize("rate", [60.0, 150.0, 2000.0])
def test_counts_of_high_rates_are_poisson(spark, rate):
    parts, share = M.parts_of(M.F.lit(rate))
    df = spark.range(2000).select("id", parts.alias("parts"), share.alias("share"))
    df = df.select("id", "parts", M.cumulated(M.F.col("share")).alias("cdf"))
    n = [r.n for r in df.select(M.poisson_count(42, *map(M.F.col, df.columns)).alias("n")).collect()]
    mean = sum(n) / len(n)
    var = sum((x - mean) ** 2 for x in n) / (len(n) - 1)
    assert abs(mean - rate) < 5 * (rate / len(n)) ** 0.5 and abs(var / rate - 1) < 5 * (2 / len(n)) ** 0.5
