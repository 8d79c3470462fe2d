import math
import random
import re

from reelspark.llm import secrets as S

A = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in A.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    for m in re.finditer(S.CANDIDATE, t):
        h = m[0]
        if any(re.search(p, h) for p in S.ALLOW):
            continue
        bits = next(b for _, p, b in S.CLASSES if re.search(p, h))
        good = []
        for i in range(len(h) - S.WINDOW + 1):
            w = h[i : i + S.WINDOW]
            if -sum(w.count(c) / S.WINDOW * math.log2(w.count(c) / S.WINDOW) for c in set(w)) >= bits - 1e-9:
                good.append(i)
        if good:
            out.append((m.start() + good[0], 3, m.start() + good[-1] + S.WINDOW, "entropy"))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def made(rng):
    bits = ["pass", "Password", "token", "API_KEY", "apikey", " = ", ": ", '"', "'", "abc", "abcdef12", "é", "日本", " ", "\n", "AKIA", "AKIAIOSFODNN7EXAMPL", "0123456789abcdef", "deadbeef" * 3, "x" * 30, "".join(rng.choices("ABCDEFGHIJKLMNOPqrstuvwxyz0123456789+/", k=40))]
    return "".join(rng.choices(bits, k=rng.randint(0, 25)))


def test_against_brute_force(spark, sf_dir):
    rng = random.Random(3)
    rows = [(i, made(rng)) for i in range(400)] + [(1000, None), (1001, ""), (1001, ""), (None, "token=" + "q" * 50)]
    rows += [(2000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("s", S.F.lit(7))
    got = sorted(((r.doc_id, r.d) for r in S.with_spans(df).select("doc_id", S.digest(S.F.col("spans")).alias("d")).collect()), key=str)
    assert got == sorted(((i, brute(t)) for i, t in rows), key=str)
    assert S.with_spans(df.limit(0)).count() == 0


def test_long_texts_take_linear_time(spark):
    """A megabyte of words that look hexadecimal, of assignments and of one blob; quadratic work would take hours."""
    rng = random.Random(1)
    words = " ".join("".join(rng.choices("abcdef0123xyz", k=rng.randint(2, 9))) for _ in range(170_000)) + " " + "deadbeef" * 6
    assigned = " ".join("token=" + "ab" * rng.randint(1, 6) for _ in range(20_000))
    blob = "".join(rng.choices(S.ALPHABET, k=200_000))
    rows = [(1, words), (2, assigned), (3, blob), (4, " ".join("q" * 4 + "AKIA" + "Z" * (14 + i % 4) for i in range(150)))]
    got = {r.doc_id: r.d for r in S.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", S.digest(S.F.col("spans")).alias("d")).collect()}
    assert got[1] == f"hex:{len(words) - 48}:{len(words)}"
    assert got[2] == brute(assigned) and got[4] == brute(rows[3][1]) and got[3].startswith("entropy:0:")


def test_redaction(spark):
    rows = [(1, 'a token = "abcdef99" b'), (2, "clean é text"), (3, None), (4, "deadbeef" * 3), (5, "x password=" + "deadbeef" * 3 + " y AKIA" + "Z" * 16)]
    got = {r.doc_id: r.text for r in S.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 'a [SECRET]" b', 2: "clean é text", 3: None, 4: "[SECRET]", 5: "x [SECRET] y [SECRET]"}
