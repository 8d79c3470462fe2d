"""Removal of repeated word passages with sharded Aho-Corasick automata.

Recurring windows of words are confirmed per shard of segments (``windows``); each shard compiles its windows
into one automaton, with the least document id of each, and streams its segments through it. Documents get
back every place at which a window of an earlier document occurs.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, cut, packed, prepare, shuffle_parts, slices, utf8
from .windows import Kind, by_shard, recurring_segments, shards

#: Bytes of segments in one automaton; its states take some hundred times as many.
SHARD_BYTES = 1 << 18


def coded(words: list[bytes], ids: dict[bytes, str]) -> str:
    """One character for each word; the surrogates are skipped."""
    out = []
    for w in words:
        c = ids.get(w)
        if c is None:
            n = len(ids) + 1
            c = ids[w] = chr(n if n < 0xD800 else n + 0x800)
        out.append(c)
    return "".join(out)


def earlier(segs: list[bytes], least: list[int], most: list[int], span: int) -> list[list[tuple[int, int]]]:
    """For each segment (place, least id) of its windows that recur, by one automaton over all windows.

    ``least`` and ``most`` are the ids that hold a segment.
    """
    ids: dict[bytes, str] = {}
    lines = [coded(s.split(), ids) for s in segs]
    held: dict[str, list[int]] = {}
    for line, lo, hi in zip(lines, least, most, strict=True):
        for i in range(len(line) - span + 1):
            w = line[i : i + span]
            x = held.get(w)
            if x is None:
                held[w] = [lo, hi]
            else:
                x[0], x[1] = min(x[0], lo), max(x[1], hi)
    auto = ahocorasick.Automaton()
    for w, (lo, hi) in held.items():
        if lo < hi:  # confirmed: in two documents
            auto.add_word(w, lo)
    if not len(auto):
        return [[] for _ in segs]
    auto.make_automaton()
    return [[(end - span + 1, lo) for end, lo in auto.iter(line)] for line in lines]


def remove_repeats(df: DataFrame, *, span: int = 13, gram: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``kept`` (kept words, one space between, as UTF-8), ``removed`` ranges.

    A word goes if a window of ``span`` words over it also starts in a row with a smaller id; all windows are
    judged on the input. ``removed`` is an array of maximal (start, end) word ranges. Null texts have no words.
    A row with a null id keeps all and makes no other row lose anything; rows of one id do not affect each
    other. Texts repeated under several ids (equal by two 64-bit hashes) are compared once, for their least id. Texts
    may have any length. Empty input gives empty output; other columns are ignored.

    The automata stream the segments instead of whole documents, and lose nothing by it: a window that recurs has
    the same anchor wherever it occurs, so its anchor recurs, so at every occurrence the segment that holds it is
    among those kept; and all of them meet in the one shard of that anchor.
    """
    prepare(df.sparkSession)
    kind = Kind(span=span, gram=gram, words=True)
    n = shuffle_parts(df)
    every = df.select(df[id_col].cast("long").alias("key"), utf8(text_col).alias("text")).select("key", F.xxhash64("text").alias("mark"), "text")
    rows = every.filter("key is not null")  # in all uses, so that the shuffled texts are the same in each
    # joins would add this test to some uses, whose shuffle would then be another one
    dealt = packed(rows).filter("key is not null").repartition(n, "key")
    # of equal texts, the one with the least id stands for all: others have every window in it
    # (equal by 128 bits of hashes: by 64 alone, some pair among very many different texts would pass for equal)
    # a row needs only its mark then: its id leads either that very text or none of that mark
    firsts = rows.groupBy("mark", F.xxhash64(F.lit(1), "text").alias("other")).agg(F.min("key").alias("key"))
    lead = cut(firsts.groupBy("key").agg(F.collect_list("mark").alias("marks")))

    whole, short = recurring_segments(rows, dealt, kind, marked=True, among=lead.select("key"))

    def locate(batches):
        for t in shards(batches, SHARD_BYTES):
            found = earlier(t.column("seg").to_pylist(), t.column("lo").to_pylist(), t.column("hi").to_pylist(), span)
            h, sh = t.column("h").to_pylist(), t.column("sh").to_pylist()
            rows = [(h[i], sh[i], [{"at": a, "least": lo} for a, lo in f]) for i, f in enumerate(found) if f]
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.struct([("at", pa.int32()), ("least", pa.int64())])))], ["h", "sh", "hits"])

    hits = by_shard(whole).mapInArrow(locate, "h bigint, sh bigint, hits array<struct<at:int,least:bigint>>")
    placed = short.join(hits, ["h", "sh"]).select("key", "mark", (F.transform(F.filter("hits", lambda x: x["least"] < F.col("key")), lambda x: (F.col("start") + x["at"]).cast("int"))).alias("at")).filter(F.size("at") > 0)
    starts = placed.groupBy("key").agg(F.collect_list(F.struct("mark", "at")).alias("found"))
    facts = lead.join(starts, "key", "left").select(F.col("key").alias("fk"), "marks", "found")
    out = dealt.join(facts, dealt["key"] == facts["fk"], "left")
    at = F.flatten(F.transform(F.filter("found", lambda x: x["mark"] == F.col("mark")), lambda x: x["at"]))
    # a text whose least id is another one loses all words that a window covers
    again = ~F.coalesce(F.array_contains("marks", F.col("mark")), F.lit(False))
    judged = out.select(F.col("key").alias("id"), "text", at.alias("at"), again.alias("again"), F.lit(False).alias("plain"))
    apart = every.filter("key is null").select(F.col("key").alias("id"), "text", F.lit(None).cast("array<int>").alias("at"), F.lit(False).alias("again"), F.lit(True).alias("plain"))
    return _emit(judged.union(apart), span).withColumnRenamed("id", id_col)


def _emit(df: DataFrame, span: int) -> DataFrame:
    def run(batches):
        press = zstandard.ZstdDecompressor()
        for b in slices(batches, "text", CHUNK_BYTES // 4):
            n_words, n_removed, kept, ranges = [], [], [], []
            for text, at, again, plain in zip(*(b.column(c).to_pylist() for c in ("text", "at", "again", "plain")), strict=True):
                words = (text if plain else press.decompress(text)).split()
                gone = np.zeros(len(words) + 1, np.int64)
                if again and len(words) >= span:
                    gone[0], gone[-1] = 1, -1
                elif at and not again:
                    a = np.array(at)
                    np.add.at(gone, a, 1)
                    np.add.at(gone, a + span, -1)
                out = np.cumsum(gone[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8)))
                n_words.append(len(words))
                n_removed.append(int(out.sum()))
                kept.append(b" ".join(w for w, o in zip(words, out.tolist(), strict=True) if not o))
                ranges.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(ranges, kind)], ["id", "n_words", "n_removed", "kept", "removed"])

    return df.mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept binary, removed array<struct<start:int,end:int>>")


