"""Toxicity scores: Levenshtein automata on a lexicon trie, and context windows around the hits.

The lexicon is learned from labelled rows: whole words, and stems from which compounds are made, that are far
more frequent in toxic texts. Its trie is intersected with the edit automaton of one error (change, insertion,
deletion, swap) and compiled into one deterministic table, which all words of a batch walk together. Each hit
is scored from its window: near other hits and second-person words it weighs more, within quotation marks or
beside words of reporting less. Boosted trees turn the sums of a document into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import automaton
from .boosting import FIT_ROWS, Trees, about, fit, held_out, named, sampled, scored, training_rows
from .common import cut, prepare, slices, utf8

#: The lexicon is learned from at most so many texts of each label, and holds at most so many terms.
LEXICON_ROWS = 4_000
LEXICON_TERMS = 120
#: A term this long or longer may be misspelled once.
FUZZY_LENGTH = 5
STEMS = range(3, 9)
WINDOW = 8
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes reported reports claimed according dit écrit selon sagte schrieb laut dijo escribió según".split())
ADDRESS = frozenset("you your you're u ur du dein deine ihr sie tu vous ton votre tú tus eres usted".split())
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # any word that begins so
    weight: float


def mine(rows: DataFrame, most: int = LEXICON_TERMS) -> list[Term]:
    """Terms of (text, y) rows that are significantly more frequent in texts of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            seen = (Counter(), Counter())
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                words = set(WORD.findall(t.decode().lower()))
                seen[y].update({("w", w) for w in words if 3 <= len(w) <= 30} | {("s", w[:k]) for w in words for k in STEMS if len(w) >= k})
                seen[y]["n", ""] += 1
            keys = [*seen[0].keys() | seen[1].keys()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys]), pa.array([t for _, t in keys]), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["kind", "term", "n1", "n0"])

    counts = rows.select(utf8("text").alias("text"), F.col("y").cast("int").alias("y")).mapInArrow(run, "kind string, term string, n1 bigint, n0 bigint").groupBy("kind", "term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counts = cut(counts)
    totals = counts.filter("kind = 'n'").first()
    if totals is None or not totals.n1:
        return []
    t1, t0 = totals.n1, totals.n0
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds = F.log(a / (t1 - F.col("n1") + 0.5)) - F.log(b / (t0 - F.col("n0") + 0.5))
    z = odds / F.sqrt(1 / a + 1 / b)
    least = max(4, round(0.004 * t1))
    found = counts.filter((F.col("kind") != "n") & (F.col("n1") >= least)).select("kind", "term", "n1", "n0", odds.alias("odds"), z.alias("z")).filter((F.col("z") > 5) & (F.col("odds") > 1.2))
    best = found.orderBy(F.desc("z"), "kind", "term").limit(20 * most).collect()  # bounded by the lexicon's size
    words = {r.term: r for r in best if r.kind == "w"}
    chosen: list[Term] = []
    for r in best:
        if r.kind == "s" and any(w.startswith(r.term) and words[w].n1 >= 0.6 * r.n1 for w in words):
            continue  # one whole word explains the stem
        if any(r.term.startswith(c.text) for c in chosen if c.stem) or any(c.text == r.term for c in chosen):
            continue
        if r.kind == "s" and any(c.stem and c.text.startswith(r.term) for c in chosen):
            continue
        chosen.append(Term(r.term, r.kind == "s", float(r.odds)))
        if len(chosen) == most:
            break
    return chosen


class Matcher:
    """Deterministic automaton of all words within one edit of a lexicon's terms.

    A state is a set of (trie node, edits, pending swap); the ends of stems absorb. ``kind`` of a final state: 0 none,
    1 stem with an edit, 2 stem, 3 word with an edit, 4 word; ``weight`` is that of the heaviest such term.
    """

    def __init__(self, terms: list[Term]):
        self.alphabet = sorted({c for t in terms for c in t.text})
        code = {c: i + 1 for i, c in enumerate(self.alphabet)}
        self.width = len(code) + 1  # 0: any other character
        child: list[dict[int, int]] = [{}]
        word: list[float | None] = [None]
        stem: list[float | None] = [None]
        deep: list[int] = [0]  # longest term below, for the edit allowance
        for t in terms:
            node = 0
            deep[0] = max(deep[0], len(t.text))
            for c in t.text:
                node_ = child[node].get(code[c])
                if node_ is None:
                    node_ = child[node][code[c]] = len(child)
                    child.append({})
                    word.append(None)
                    stem.append(None)
                    deep.append(0)
                node = node_
                deep[node] = max(deep[node], len(t.text))
            ends = stem if t.stem else word
            ends[node] = max(t.weight, ends[node] or 0)
        self._long = {}
        for t in terms:  # nodes at which a misspelled term may end
            node = 0
            for c in t.text:
                node = child[node][code[c]]
            self._long[node, t.stem] = len(t.text) >= FUZZY_LENGTH

        def closed(state):
            """Deletions: a trie character that the word lacks; then only the least edits of a node stay."""
            todo, out = list(state), set(state)
            while todo:
                node, edits, swap = todo.pop()
                if node >= 0 and not edits and not swap and deep[node] >= FUZZY_LENGTH:
                    for nxt in child[node].values():
                        x = (nxt, 1, 0)
                        if x not in out:
                            out.add(x)
                            todo.append(x)
            for node, edits, swap in list(out):  # stems absorb: -1 with, -2 without an edit
                if node > 0 and not swap and stem[node] is not None and (not edits or self._long.get((node, True))):
                    out.add((-2 + edits, 0, stem[node]))
            if (marks := [x for x in out if x[0] < 0]) and any(x[0] == -2 for x in marks):
                out = {max((x for x in marks if x[0] == -2), key=lambda x: x[2])} | {x for x in out if x[0] >= 0 and word_below[x[0]]}
            return frozenset(x for x in out if not (x[0] >= 0 and x[1] and (x[0], 0, 0) in out))

        word_below = [False] * len(child)
        for v in range(len(child) - 1, -1, -1):
            word_below[v] = word[v] is not None or any(word_below[w] for w in child[v].values())

        def step(state, c):
            out = set()
            for node, edits, swap in state:
                if node < 0:
                    out.add((node, edits, swap))
                elif swap:  # the second of two swapped characters must be the first one of the trie
                    nxt = child[node].get(c)
                    if nxt is not None and nxt == swap[0]:
                        out.add((swap[1], 1, 0))
                else:
                    if c in child[node]:
                        out.add((child[node][c], edits, 0))
                    if not edits and deep[node] >= FUZZY_LENGTH:
                        out.add((node, 1, 0))  # an extra character
                        for x, nxt in child[node].items():
                            if x != c:
                                out.add((nxt, 1, 0))  # another character
                                if c in child[nxt]:
                                    out.add((node, 1, (nxt, child[nxt][c])))
            return closed(out)

        start = closed({(0, 0, 0)})
        ids, order, rows = {start: 0}, [start], []
        for state in order:
            row = []
            for c in range(self.width):
                nxt = step(state, c)
                if nxt not in ids:
                    ids[nxt] = len(order)
                    order.append(nxt)
                row.append(ids[nxt])
            rows.append(row)
        self.table = np.array(rows, dtype=np.uint32).reshape(-1)
        self.kind, self.weight = np.zeros(len(order), np.int8), np.zeros(len(order))
        for i, state in enumerate(order):
            best = (0, 0.0)
            for node, edits, swap in state:
                if node < 0:
                    best = max(best, (2 if node == -2 else 1, swap))
                elif node and not swap and word[node] is not None and (not edits or self._long.get((node, False))):
                    best = max(best, (3 if edits else 4, word[node]))
            self.kind[i], self.weight[i] = best
        self.codes = np.zeros(0x3000, np.int64)
        for c, i in code.items():
            if ord(c) < 0x3000:
                self.codes[ord(c)] = i
        far = [c for c in self.alphabet if ord(c) >= 0x3000]
        self.far, self.far_codes = np.array([*map(ord, far), 0x110000], dtype=np.int64), np.array([*(code[c] for c in far), 0], dtype=np.int64)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        out = np.where(points < 0x3000, self.codes[np.minimum(points, 0x2FFF)], 0)
        at = np.flatnonzero(points >= 0x3000)  # kana, CJK, Hangul and beyond: by search
        if len(at) and len(self.far) > 1:
            k = np.searchsorted(self.far, points[at])
            out[at] = np.where(self.far[k] == points[at], self.far_codes[k], 0)
        return out

    def match(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state, _ = automaton.run(self.table, self.width, self.symbols(points), starts, ends, 0)
        return self.kind[state], self.weight[state]


LETTER = np.array([bool(WORD.fullmatch(chr(i))) for i in range(0x3000)])
QUOTE_POINTS = np.array(sorted(map(ord, QUOTES)))


def letters(points: np.ndarray) -> np.ndarray:
    return np.where(points < 0x3000, LETTER[np.minimum(points, 0x2FFF)], points < 0x110000)


def _listed(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: frozenset[str]) -> np.ndarray:
    """Which words are in a short list, by a hash of their characters."""
    out = np.zeros(len(starts), bool)
    by: dict[int, list[str]] = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    size = ends - starts
    for n, ws in by.items():
        at = np.flatnonzero(size == n)
        if len(at):
            h = np.zeros(len(at), np.uint64)
            for j in range(n):
                h = h * np.uint64(1_000_003) + points[starts[at] + j].astype(np.uint64)
            want = []
            for w in ws:
                x = 0
                for c in w:
                    x = (x * 1_000_003 + ord(c)) & 0xFFFFFFFFFFFFFFFF
                want.append(x)
            out[at] = np.isin(h, np.array(want, dtype=np.uint64))
    return out


def context_features(texts: list[str], matcher: Matcher) -> np.ndarray:
    """One row of sums for each text; texts without words or hits have zeros beside their length."""
    n = len(texts)
    points = np.frombuffer("".join(t.lower() + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if not n:
        return np.zeros((0, 20))
    sizes = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, n)
    at = np.r_[0, np.cumsum(sizes)]
    gap = ~letters(points)
    turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        turn = np.r_[0, turn]
    s, e = turn[0::2], turn[1::2]
    doc = np.searchsorted(at, s, side="right") - 1
    words = np.bincount(doc, minlength=n)
    kind, weight = matcher.match(points, s, e)
    hit = np.flatnonzero(kind)
    hd, hk, hw = doc[hit], kind[hit], weight[hit]
    # within quotation marks: an odd number of them before the hit in its line, and one more after it
    quote = np.isin(points, QUOTE_POINTS)
    cq = np.r_[0, np.cumsum(quote)]
    lines = np.flatnonzero(points == 10)
    which = np.searchsorted(lines, s[hit])
    line_begin = np.where(which > 0, lines[np.maximum(which - 1, 0)] + 1, 0)
    quoted = ((cq[s[hit]] - cq[line_begin]) % 2 == 1) & (cq[lines[which]] > cq[e[hit]]) if len(hit) else np.zeros(0, bool)
    first, last = np.searchsorted(doc, hd, side="left"), np.searchsorted(doc, hd, side="right")
    lo, hi = np.maximum(hit - WINDOW, first), np.minimum(hit + WINDOW + 1, last)

    def near(flags):
        c = np.r_[0, np.cumsum(flags)]
        return c[hi] - c[lo]

    cue = near(_listed(points, s, e, REPORTING)) > 0
    you = near(_listed(points, s, e, ADDRESS)) > 0
    crowd = np.minimum(near(kind > 0) - 1, 3)
    score = hw * np.where(hk % 2 == 1, 0.6, 1.0) * (1 - 0.6 * quoted) * (1 - 0.3 * cue) * (1 + 0.2 * you) * (1 + 0.2 * crowd)
    per = lambda w: np.bincount(hd, weights=w, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, hd, score)
    w1 = np.maximum(words, 1)
    cols = [np.log1p(words), per(score), top, 100 * per(score) / w1, 100 * per(np.ones(len(hit))) / w1, per(quoted), per(cue), per(you), per(crowd), per(score * ~quoted)]
    for k in (1, 2, 3, 4):
        cols += [per(hk == k), 100 * per(hk == k) / w1]
    # different terms hit tell abuse from a name: distinct weights stand for distinct terms
    for some in (np.ones(len(hit), bool), hk % 2 == 0):
        pairs = np.unique(np.stack([hd[some], hw[some]], axis=1), axis=0)
        cols.append(np.bincount(pairs[:, 0].astype(int), minlength=n))
    return np.stack(cols, axis=1).astype(float)


def lexicon_rows(df: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, y) of at most ``rows`` rows of each label that are not held out; their ids, so bounded, are broadcast."""
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("lid"), F.col(label_col).alias("y"))
    some, totals = None, {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    for y in (0, 1):
        part = known.filter(F.col("y") == y).filter(about(F.col("lid"), rows, totals.get(y, 0))).orderBy(F.xxhash64("lid"), "lid").limit(rows)
        some = part if some is None else some.union(part)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(cut(some.distinct())), F.col("id") == F.col("lid")).select("text", "y")


def features(df: DataFrame, terms: list[Term], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f): the context sums of every whole text. Null texts are empty; rows are kept one for one."""
    shared = df.sparkSession.sparkContext.broadcast(Matcher(terms))  # bounded by LEXICON_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            x = context_features([t.decode() for t in b.column("text").to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))], ["id", "f"])

    return df.select(df[id_col].cast("long").alias("id"), utf8(text_col).alias("text")).mapInArrow(run, "id bigint, f array<double>")


@dataclass(frozen=True)
class Model:
    terms: list[Term]
    trees: Trees


def train(df: DataFrame, labels: DataFrame, *, label_col: str = "toxic", lexicon_rows_: int = LEXICON_ROWS, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", extra_terms: tuple[Term, ...] = (), whole: bool = True) -> tuple[Model, DataFrame]:
    """A model from the labelled rows that are not held out, and the features of ``rows`` (checkpointed).

    ``whole``: features of all rows, for scores that follow; else only of the few that are learned from. Labels are
    joined by their column ``id_col``, or ``doc_id`` if they have no such column.
    """
    labels = named(labels, id_col)
    terms = mine(lexicon_rows(df, labels, label_col, lexicon_rows_, id_col, text_col))
    terms += [t for t in extra_terms if t.text not in {x.text for x in terms}]
    if not whole:
        known = sampled(labels, label_col, fit_rows).select(F.col("lid").alias("__lid")).distinct()
        df = df.select(df[id_col], df[text_col]).join(known, F.col(id_col) == F.col("__lid"), "left_semi")
    found = cut(features(df, terms, id_col=id_col, text_col=text_col))
    return Model(terms, fit(*training_rows(found, labels, label_col, fit_rows), trees=60, depth=3, least=8)), found


def toxicity_scores(df: DataFrame, labels: DataFrame, *, label_col: str = "toxic", at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """id, ``held_out``, ``score`` (probability of label 1) and ``predicted`` of every row of ``df``.

    Null and empty texts are scored like others, texts of any length as a whole; null ids are held out; repeated
    rows are kept; labels that are null or name no row are ignored; without labels every score is 0.5, and a score
    right at the threshold counts as label 1; other columns are never read.
    """
    prepare(df.sparkSession)
    model, found = train(df, labels, label_col=label_col, id_col=id_col, text_col=text_col, **bounds)
    return scored(found, model.trees, at_least, id_col)


def accepted(df: DataFrame, model: Model, *, at_least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose score is under ``at_least``, all columns as they are; no shuffle. Null texts count as empty."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((Matcher(model.terms), model.trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, trees = shared.value
        for b in slices(batches, text_col, 2 << 20):
            yield b.filter(pa.array(trees.score(context_features([t or "" for t in b.column(text_col).to_pylist()], matcher)) < at_least))

    return df.mapInArrow(run, df.schema)
