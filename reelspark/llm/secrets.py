"""Secret scans with DataFrame expressions only.

Base patterns give spans of three kinds. Beside them, long candidate strings are scored by the Shannon
entropy of a sliding window, with a threshold for each character class; the counts of all characters within the
window are kept, packed into a few whole numbers, and change by one leaving and one entering character, so a
step takes the same time for any window and no logarithm. An allow-list suppresses well-known harmless
candidates. Everything is a row-local expression: no shuffle, no Python. Cheap tests of the whole text come
first, so that only texts with something to find are searched in full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind, pattern, and the test that a match must pass (fixed values of the contract; runs of hexadecimal digits and
#: of key characters are maximal, so their least length can be asked for in the pattern)
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""),
    ("access", r"AKIA[A-Z0-9]{16,}", r"."),
    ("hex", r"[0-9a-f]{24,}", r"."),
)
#: a text without one of these (in lower case) has no assignment
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: the characters of candidates; hexadecimal digits and key characters are among them, so a text without a candidate has none of those spans either
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: counts of up to 31 take five bits each, twelve to a whole number
BITS, PACKED = 5, 12
#: class, its pattern, and the least entropy of a window in bits; the first class that matches counts
CLASSES = (("hex", r"^[0-9A-Fa-f]+$", 3.0), ("letters", r"^[A-Za-z]+$", 4.2), ("mixed", r".", 3.9))
#: candidates that hold one of these are no secrets
ALLOW = (r"(?i)example", r"(?i)0123456789abcdef", r"(?i)abcdefghijklmnopqrst", r"^(.)\1+$", r"^[/_=+-]+$")
#: sums of c * log2(c) are kept as whole numbers of this fraction of a bit
SCALE = 10**9
XLOGX = [0] + [round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1)]
SPAN = "array<struct<s:int,e:int,kind:string>>"


def least_sum(bits: float) -> int:
    """The largest sum of c * log2(c) over a window's counts at which its entropy is still ``bits``."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * SCALE)


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


#: Positions are summed up in blocks of so many matches, so that no array grows match by match.
BLOCK = 64
HITS = "array<struct<s:int,hit:string>>"


def located(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of (start, match), in code points.

    The pieces between the matches and the matches themselves add up to the positions: first over blocks of
    matches, then within each block.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda x: x["hit"].isNotNull())  # the last piece has no match

    def placed(z: Column) -> Column:
        def cumulated(block: Column, base: Column) -> Column:
            start = F.struct(base.alias("at"), _none(HITS).alias("out"))

            def step(acc, x):
                s = acc["at"] + x["gap"]
                return F.struct((s + F.length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), x["hit"].alias("hit")))).alias("out"))

            return F.aggregate(block, start, step, lambda acc: acc["out"])

        def long(z: Column) -> Column:
            cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda k: F.slice(z, k * BLOCK + 1, BLOCK))
            size = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["hit"]))
            begin = F.struct(F.lit(0).alias("at"), _none("array<struct<base:int,block:array<struct<gap:int,hit:string>>>>").alias("out"))
            based = F.aggregate(cut, begin, lambda acc, b: F.struct((acc["at"] + size(b)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("base"), b.alias("block")))).alias("out")), lambda acc: acc["out"])
            return F.flatten(F.transform(based, lambda b: cumulated(b["block"], b["base"])))

        return F.when(F.size(z) <= BLOCK, cumulated(z, F.lit(0))).otherwise(long(z))

    # bound once: the matches are found a single time and then placed
    return F.element_at(F.transform(F.array(zipped), placed), 1)


def holds_candidate(text: Column) -> Column:
    """Whether there is a candidate: it lies between two blanks, so most texts are settled by their words' lengths."""
    return F.exists(F.split(text, " "), lambda w: F.octet_length(w) >= WINDOW) & text.rlike(CANDIDATE.replace(",", ""))


def base_spans(text: Column, low: Column, candidate: Column, kind: str, pattern: str, test: str) -> Column:
    """Spans of one kind; ``low`` is the text in lower case, ``candidate`` whether it holds a candidate."""
    guard = {"hex": candidate & text.rlike(r"[0-9a-f]{24}"), "access": candidate & text.contains("AKIA"), "assign": F.greatest(*[low.contains(w) for w in ASSIGN_WORDS])}[kind]
    spans = F.transform(F.filter(located(text, pattern), lambda x: x["hit"].rlike(test)), lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["hit"])).alias("e"), F.lit(kind).alias("kind")))
    return F.when(guard, spans).otherwise(_none(SPAN))


def windows(hit: Column, most: Column) -> Column:
    """First start and last end of the windows whose sum of c * log2(c) is at most ``most``; -1 without any.

    A character has a place (word ``k``, bits from ``b``) in the packed counts, which the fold carries along.
    """
    places = F.array(*[F.struct(F.lit(i // PACKED).alias("k"), F.lit(i % PACKED * BITS).alias("b"), F.lit(1 << i % PACKED * BITS).cast("long").alias("one")) for i in range(len(ALPHABET))])
    table = F.array(*[F.lit(x).cast("long") for x in XLOGX])
    f = lambda c: F.element_at(table, c.cast("int") + 1)
    count = lambda counts, x: F.call_function("shiftright", F.element_at(counts, x["k"] + 1), x["b"]).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
    words = F.sequence(F.lit(0), F.lit((len(ALPHABET) - 1) // PACKED))

    def scan(bound):
        chars, most = bound["chars"], bound["most"]
        first = F.slice(chars, 1, WINDOW)
        counts = F.transform(words, lambda k: F.aggregate(first, F.lit(0).cast("long"), lambda a, x: a + F.when(x["k"] == k, x["one"]).otherwise(F.lit(0).cast("long"))))
        total = F.aggregate(F.transform(F.array_distinct(first), lambda x: f(F.size(F.filter(first, lambda c: c == x)))), F.lit(0).cast("long"), lambda a, v: a + v)
        begin = F.struct(total.alias("sum"), F.when(total <= most, 0).otherwise(-1).alias("first"), F.when(total <= most, WINDOW).otherwise(-1).alias("last"), counts.alias("counts"))

        def step(acc, i):  # from the window that starts at i (from 1) to the next
            gone, come = F.element_at(chars, i), F.element_at(chars, i + WINDOW)
            c_gone, c_come = count(acc["counts"], gone), count(acc["counts"], come)
            total = F.when(gone == come, acc["sum"]).otherwise(acc["sum"] - f(c_gone) + f(c_gone - 1) - f(c_come) + f(c_come + 1))
            nothing = F.lit(0).cast("long")
            counts = F.transform(acc["counts"], lambda c, k: c - F.when(gone["k"] == k, gone["one"]).otherwise(nothing) + F.when(come["k"] == k, come["one"]).otherwise(nothing))
            return F.struct(total.alias("sum"), F.when((acc["first"] < 0) & (total <= most), i).otherwise(acc["first"]).alias("first"), F.when(total <= most, i + WINDOW).otherwise(acc["last"]).alias("last"), counts.alias("counts"))

        steps = F.when(F.size(chars) > WINDOW, F.sequence(F.lit(1), F.size(chars) - WINDOW)).otherwise(_none("array<int>"))
        return F.aggregate(steps, begin, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    chars = F.transform(F.split(hit, ""), lambda c: F.element_at(places, F.instr(F.lit(ALPHABET), c)))
    return F.element_at(F.transform(F.array(F.struct(chars.alias("chars"), most.alias("most"))), scan), 1)  # bound once


def entropy_spans(text: Column, candidate: Column) -> Column:
    allowed = lambda hit: F.array_max(F.array(*[hit.rlike(p) for p in ALLOW]))

    def most(hit):
        out = F.lit(least_sum(CLASSES[-1][2]))
        for _, pattern, bits in reversed(CLASSES[:-1]):
            out = F.when(hit.rlike(pattern), F.lit(least_sum(bits))).otherwise(out)
        return out.cast("long")

    scored = F.transform(F.filter(located(text, CANDIDATE), lambda x: ~allowed(x["hit"])), lambda x: F.struct(x["s"].alias("s"), windows(x["hit"], most(x["hit"])).alias("w")))
    spans = F.transform(F.filter(scored, lambda x: x["w"]["first"] >= 0), lambda x: F.struct((x["s"] + x["w"]["first"]).cast("int").alias("s"), (x["s"] + x["w"]["last"]).cast("int").alias("e"), F.lit("entropy").alias("kind")))
    return F.when(candidate, spans).otherwise(_none(SPAN))


def with_spans(df: DataFrame, *, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with an array of (s, e, kind) in column ``out``, by start and then kind (assign, access, hex, entropy).

    Positions are code points, the end exclusive. Base spans are never suppressed. Null texts count as empty
    and have no spans; rows, repeated or not, are kept one for one, so ids may be null or repeated. A column
    named ``out`` is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rank = {k: i for i, k in enumerate([k for k, _, _ in BASE] + ["entropy"])}

    def ordered(bound):
        spans = F.concat(*[base_spans(bound["t"], bound["low"], bound["c"], *b) for b in BASE], entropy_spans(bound["t"], bound["c"]))
        order = lambda k: F.when(k == "assign", rank["assign"]).when(k == "access", rank["access"]).when(k == "hex", rank["hex"]).otherwise(rank["entropy"])
        keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), order(x["kind"]).alias("r"), x["e"].alias("e"), x["kind"].alias("kind"))))
        return F.transform(keyed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))

    facts = F.struct(text.alias("t"), F.lower(text).alias("low"), holds_candidate(text).alias("c"))
    return df.withColumn(out, F.element_at(F.transform(F.array(facts), ordered), 1))  # each test of a whole text runs once


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redacted(df: DataFrame, mark: str = "[SECRET]", *, text_col: str = "text", kinds: tuple[str, ...] = ("assign", "access", "hex", "entropy")) -> DataFrame:
    """``df`` with every span of ``kinds`` in the text replaced by ``mark``; spans that touch or overlap are one.

    Texts without spans, and null texts, stay as they are, as do all other columns, whatever their names.
    """
    spans = "__spans"
    while spans in df.columns:
        spans = "_" + spans
    found = with_spans(df, text_col=text_col, out=spans)
    text = F.col(text_col)
    kept = F.filter(F.col(spans), lambda x: x["kind"].isin(*kinds))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        piece = F.when(x["s"] > acc["at"], F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).when((acc["at"] == 0), F.lit(mark)).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    done = F.aggregate(kept, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(kept) > 0, done).otherwise(text)).drop(spans)
