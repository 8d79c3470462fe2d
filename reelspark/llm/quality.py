"""Quality scores from document statistics by histogram gradient-boosted trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import FIT_ROWS, Trees, fit, named, scored, training_rows
from .common import cut, joined, prepare, slices, utf8, word_bounds
from .windows import gram_hashes, word_hashes

NAMES = (
    "log_bytes log_words word_length upper digit mark symbol space break other distinct_words top_word repeat_next distinct_threes distinct_lines line_length "
    "caps_words mark_words long_words short_words entropy longest_repeat first_upper"
).split()
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?\"'()-")] = True
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"*%&$#|@^~<>{}[]\\/=+_`")] = True


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return c[at[1:] - 1] - c[at[:-1]]  # without the line feed after each text


def _distinct(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values each owner has, and how often its commonest occurs."""
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])]) if len(o) else np.zeros(0, int)
    top = np.zeros(n)
    np.maximum.at(top, o[new], np.diff(np.r_[new, len(o)]))
    return np.bincount(o[new], minlength=n), top


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of statistics for each text; all numbers are finite, also for empty texts."""
    n = len(texts)
    buf, at = joined(texts)
    s, e = word_bounds(buf)
    size = np.diff(at) - 1
    one = np.maximum(size, 1)
    doc = np.searchsorted(at, s, side="right") - 1
    words = np.bincount(doc, minlength=n)
    w1 = np.maximum(words, 1)
    h = word_hashes(buf, s, e)
    per_word = lambda flag: np.bincount(doc, weights=flag, minlength=n) / w1
    upper, digit = (buf >= 65) & (buf <= 90), (buf >= 48) & (buf <= 57)
    marks, symbols, breaks = MARKS[buf], SYMBOLS[buf], buf == 10
    distinct, top = _distinct(doc, h, n)
    same_next = np.r_[(h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), False][: len(h)]
    threes = gram_hashes(h, 3)
    whole = np.r_[doc[2:] == doc[:-2], False, False][: len(doc)] if len(doc) > 2 else np.zeros(len(doc), bool)
    distinct3, top3 = _distinct(doc[whole], threes[whole], n)
    lines = np.flatnonzero(breaks)
    begin = np.r_[0, lines[:-1] + 1] if len(lines) else lines
    ldoc = np.searchsorted(at, begin, side="right") - 1
    distinct_l, _ = _distinct(ldoc, word_hashes(buf, begin, lines), n)
    n_lines = np.maximum(np.bincount(ldoc, minlength=n), 1)
    cu = np.r_[0, np.cumsum(upper, dtype=np.int64)]
    length = e - s
    counts = np.bincount(np.repeat(np.arange(n), size + 1) * 256 + buf, minlength=256 * n).reshape(n, 256)
    counts[:, 10] -= 1
    p = counts / one[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    return np.stack(
        [
            np.log1p(size), np.log1p(words), per_word(length), _sums(upper, at) / one, _sums(digit, at) / one, _sums(marks, at) / one, _sums(symbols, at) / one, _sums(buf == 32, at) / one,
            _sums(breaks, at) / w1, _sums(buf >= 128, at) / one, distinct / w1, top / w1, per_word(same_next), distinct3 / np.maximum(words - 2, 1), distinct_l / n_lines, size / n_lines,
            per_word((cu[e] - cu[s] >= 2) & (cu[e] - cu[s] >= 0.6 * length)), per_word(MARKS[buf[np.maximum(e - 1, 0)]] if len(e) else e), per_word(length > 15), per_word(length <= 3), entropy, top3 / w1, per_word(upper[s] if len(s) else s),
        ],
        axis=1,
    )


def features(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f): the statistics of every whole text. Null texts are empty; rows are kept one for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = statistics(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))], ["id", "f"])

    return df.select(df[id_col].cast("long").alias("id"), utf8(text_col).alias("text")).mapInArrow(run, "id bigint, f array<double>")


def quality_scores(df: DataFrame, labels: DataFrame, *, label_col: str = "quality", at_least: float = 0.3, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """id, ``held_out``, ``score`` (probability of label 1) and ``predicted`` of every row of ``df``.

    A model is fitted on at most ``fit_rows`` labelled rows that are not held out; without any every score is
    0.5. Null and empty texts are scored like others, texts of any length as a whole; null ids are held out; repeated
    rows are kept; labels that are null or name no row are ignored; a score right at the threshold counts as
    label 1; other columns are never read.
    """
    prepare(df.sparkSession)
    found = cut(features(df, id_col=id_col, text_col=text_col))
    if model is None:
        model = fit(*training_rows(found, named(labels, id_col), label_col, fit_rows))
    return scored(found, model, at_least, id_col)
