"""Quality rules: log-likelihood ratio of hashed n-grams, with exact base rules.

Two multinomials over hashed byte n-grams are counted: one over a trusted target, one
over the whole raw corpus. A document's mean log ratio per n-gram is compared with a
fixed threshold; every document gets the same deterministic verdict on every run.

Defined cases: a null or empty text has no words and no n-grams, ratio 0, and fails the
base rules; without trusted rows all ratios are 0; repeated rows get the same figures; an
empty table has no rows; extra columns are kept, but what is added takes the place of input
columns of the same names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import in_arrow, named, others, packed, small, unpacked
from graphloom.llm.textbytes import Hashes, per_row, repeated, slices, word_bounds

BUCKETS = 1 << 16
N = 4
THRESHOLD = -0.08
SMOOTHING = 1.0

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(text: str, window: int = 5) -> int:
    """Words covered by windows of five words that occur twice or more in the text."""
    words = text.encode().split()
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    counts = Counter(grams)
    covered, until = 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += i + window - max(i, until)
            until = i + window
    return covered


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def base_figures(column: pa.Array) -> dict[str, np.ndarray]:
    """Exact figures of each text. Hashes only find the texts that may repeat a line or
    a window; those are counted again on their bytes."""
    out = {k: np.zeros(len(column), dtype=np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for row, data, offsets in slices(column):
        rows = slice(row, row + len(offsets) - 1)
        start, end, at = word_bounds(data, offsets)
        n = len(offsets) - 1
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[start] += 1
        inside[end] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool) if len(data) else np.zeros(0, bool)
        # two words that touch across rows keep the flag at 1: -1 and +1 meet there
        out["n_words"][rows] = np.bincount(at, minlength=n)
        out["word_chars"][rows] = per_row(inside & ((data & 0xC0) != 0x80), offsets)
        out["n_symbols"][rows] = per_row(_SYMBOLS[data], offsets)
        if not len(start):
            continue
        hashes = Hashes(data)
        words = hashes.of(start, end)
        if len(words) >= 5:
            m = len(words) - 4
            mix = np.zeros(m, dtype=np.uint64)
            for k in range(5):
                mix = (mix + words[k : k + m]) * np.uint64(0xD6E8FEB86659FD93)
            whole = at[:m] == at[4:]
            again = repeated(at[:m][whole], mix[whole], n)
            for k in np.flatnonzero(again):
                out["n_repeat_words"][row + k] = repeat_words(column[row + int(k)].as_py())
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        cut[1:] |= data == 10
        first = np.flatnonzero(cut[:-1])
        last = np.append(first[1:], len(data))
        last = last - ((last > first) & (data[np.maximum(last - 1, 0)] == 10))
        solid = np.concatenate(([0], np.cumsum(inside)))
        full = solid[last] > solid[first]
        first, last = first[full], last[full]
        line_row = np.searchsorted(offsets, first, side="right") - 1
        again = repeated(line_row, hashes.of(first, last), n)
        for k in np.flatnonzero(again):
            out["n_dup_lines"][row + k] = duplicate_lines(column[row + int(k)].as_py())
    return out


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n bytes from each position (n - 1 bytes short), and whether all are of one text."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    code = np.zeros(m, dtype=np.uint32)
    for k in range(n):
        code = code * np.uint32(0x01000193) ^ data[k : k + m]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - buckets.bit_length() + 1)
    ok = np.ones(m, dtype=bool)
    for k in range(1, n):
        inner = offsets[1:-1] - k
        ok[inner[(inner >= 0) & (inner < m)]] = False
    return code, ok


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
        for row, data, offsets in slices(batch.column(0)):
            code, ok = ngrams(data, offsets, N, BUCKETS)
            raw += np.bincount(code[ok], minlength=BUCKETS)
            mine = good[row : row + len(offsets) - 1]
            if mine.any() and len(code):
                keep = ok & np.repeat(mine, np.diff(offsets))[: len(code)]
                trusted += np.bincount(code[keep], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": seen.astype(np.int32), "raw": raw[seen], "trusted": trusted[seen]})


def trusted_ids(labels: DataFrame, *, key: str = "doc_id", target: str = "quality") -> DataFrame:
    """Ids of all rows labelled 1 (by the mean of their labels)."""
    good = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(target).alias("mean")).where("mean >= 0.5")
    return good.select(F.col(key).alias("_key"))


def log_ratios(docs: DataFrame, trusted: DataFrame, *, text: str = "text", key: str = "doc_id", smoothing: float = SMOOTHING) -> np.ndarray:
    """log P(bucket | trusted rows) - log P(bucket | all rows), counted over all rows of
    docs. Every task adds up its own table; BUCKETS rows come to the driver. Few trusted ids
    are sent to the texts, more than that meet them in a merge join."""
    marked = docs.select(named(text).alias("_text"), named(key).alias("_key")).join(small(trusted.withColumn("_good", F.lit(True))), "_key", "left")
    counted = marked.select("_text", "_good").mapInArrow(_count, "bucket int, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, a, b in counted.collect():
        raw[bucket], target[bucket] = a, b
    if not target.sum():
        return np.zeros(BUCKETS)

    def share(x: np.ndarray) -> np.ndarray:
        return (x + smoothing) / (x.sum() + smoothing * BUCKETS)

    return np.log(share(target)) - np.log(share(raw))


def judged(docs: DataFrame, trusted: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """docs' columns but the text, with the base figures, base_failed, llr (mean log ratio
    of an n-gram) and kept. `trusted` is what trusted_ids returns."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, trusted, text=text, key=key))
    own = others(docs, text, *[x.split()[0] for x in BASE.split(", ")], "base_failed", "llr", "kept")
    rows = docs.select(named(text).alias("_text"), packed(own))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = ratios.value
        for batch in batches:
            column = batch.column(0)
            figures = base_figures(column)
            llr = np.zeros(len(column))
            for row, data, offsets in slices(column):
                code, ok = ngrams(data, offsets, N, BUCKETS)
                if len(code):
                    total = np.concatenate(([0.0], np.cumsum(np.where(ok, weights[code], 0.0))))
                    some = np.concatenate(([0], np.cumsum(ok)))
                    at = np.minimum(offsets, len(code))
                    llr[row : row + len(offsets) - 1] = (total[at[1:]] - total[at[:-1]]) / np.maximum(1, some[at[1:]] - some[at[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, figures.values()), pa.array(np.round(llr, 9))], names=["_row", *figures, "llr"])

    scored = in_arrow(rows, score, f"{BASE}, llr double")
    return scored.select(*unpacked(own), *[x.split()[0] for x in BASE.split(", ")], base_failed().alias("base_failed"), "llr").withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
