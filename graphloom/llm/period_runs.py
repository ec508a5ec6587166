"""Periodic runs of words, found through string synchronising sets.

A run is a longest stretch of words with smallest period q (words q apart are equal) that
holds q at least `times` (4) times and has `least` (6) words. Each text is handled whole.

For every dyadic scale t, a position belongs to the synchronising set if the least hash of
the t-word windows that start in [position, position + t] is that of the first or the last
of them. That depends on the 2t words from there alone, so equal contexts are selected
alike, and about 2 positions in t are selected. A run of smallest period q, t <= q < 2t, has
a selected position in its first t words, and the next selected position with an equal
2t-word context is exactly q further on: neighbours of equal context propose periods, and
each proposal is extended word by word, which also verifies it. Windows with a period of
t / 4 or less have no hash (their texts would select every position); the runs that they
lie in are those of the smaller scales, and periods below FIRST_SCALE are found directly, by
comparing the words with themselves moved by each of them.

Work and memory are linear in the words of a scale, and only texts of 4t words take part in
scale t. Rows never leave their task: nothing is shuffled.

Defined cases: null and empty texts, and texts of white space, have no words and no runs;
`collapsed` is then empty; repeated rows get equal results; an empty table has no rows;
extra columns are kept, but what is added takes the place of input columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, in_arrow, named, others, packed, unpacked
from graphloom.llm.textbytes import mixed

TIMES, LEAST = 4, 6
FIRST_SCALE = 8  # a power of two; smaller periods are compared directly
GROUP_WORDS = 100_000  # words of texts that are handled together; a longer text is alone
KEPT_CODES = 1_000_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Codes(dict):
    """A number for each word, given when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _moved(values: np.ndarray, by: int) -> np.ndarray:
    """values[i + by] at i; zero behind the end."""
    out = np.zeros_like(values)
    out[: len(values) - by] = values[by:]
    return out


def _joined(windows: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of 2 * size words, from those of size words."""
    return mixed(windows * _LEFT + _moved(windows, size) * _RIGHT)


class Runs:
    """The runs of texts whose words' codes stand one after another; bounds has where each
    text begins, and the end of the last."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, times: int = TIMES, least: int = LEAST) -> None:
        self.codes, self.bounds, self.times, self.least = codes, bounds, times, least
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        #: (start, end) -> smallest period; scales ascend, so the first one found is smallest
        self.found: dict[tuple[int, int], int] = {}
        longest = int(np.diff(bounds).max(initial=0))
        for q in range(1, min(FIRST_SCALE, longest // times + 1)):
            self._direct(q)
        self._scales(longest)

    def _keep(self, start: int, end: int, period: int) -> None:
        if end - start >= max(self.least, self.times * period):
            self.found.setdefault((start, end), period)

    def _direct(self, q: int) -> None:
        equal = np.zeros(len(self.codes) - q + 2, dtype=np.int8)
        equal[1:-1] = (self.codes[:-q] == self.codes[q:]) & (self.text[:-q] == self.text[q:])
        edges = np.flatnonzero(np.diff(equal))
        start, end = edges[::2], edges[1::2] + q
        for k in np.flatnonzero(end - start >= max(self.least, self.times * q)).tolist():
            self._keep(int(start[k]), int(end[k]), q)

    def _scales(self, longest: int) -> None:
        size, scale = np.diff(self.bounds), FIRST_SCALE
        if longest < self.times * scale:
            return
        at = np.arange(len(self.codes))
        windows = mixed(self.codes.astype(np.uint64) + np.uint64(1))
        for half in (1 << k for k in range(FIRST_SCALE.bit_length() - 1)):
            windows = _joined(windows, half)
        while longest >= self.times * scale:
            wide = size[self.text[at]] >= self.times * scale
            if not wide.all():
                at, windows = at[wide], windows[wide]
            windows = self._scale(at, windows, scale)
            scale *= 2

    def _scale(self, at: np.ndarray, windows: np.ndarray, t: int) -> np.ndarray:
        """Runs with periods in [t, 2t); returns the hashes of windows of 2t words."""
        text = self.text[at]
        room = self.bounds[text + 1] - at  # words from here to the end of the text
        hashes = np.where(room >= t, windows, _NONE)
        for (start, end), q in self.found.items():  # the highly periodic regions
            if self.times * q <= t <= end - start:
                k = int(np.searchsorted(at, start))
                if k < len(at) and at[k] == start:
                    hashes[k : k + end - start - t + 1] = _NONE
        least, span = hashes, 1
        while span < t:
            least = np.minimum(least, np.append(least[span:], np.full(span, _NONE)))
            span *= 2
        last = np.append(hashes[t:], np.full(t, _NONE))
        least = np.minimum(least, last)
        chosen = np.flatnonzero((room >= 2 * t) & (least != _NONE) & ((least == hashes) | (least == last)))
        context = _joined(windows, t)
        key = context[chosen] ^ mixed(text[chosen].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        key, place = key[order], at[chosen[order]]
        period = np.diff(place)
        hit = np.flatnonzero((key[1:] == key[:-1]) & (period >= t) & (period < 2 * t))
        place, period = place[hit], period[hit]
        place, period = place[order := np.lexsort((place, period))], period[order]
        # equal contexts that overlap or touch lie in one stretch of their period
        first = np.append(True, (np.diff(period) != 0) | (np.diff(place) > 2 * t))[: len(place)]
        for p, q in zip(place[first].tolist(), period[first].tolist(), strict=True):
            k = self.text[p]
            self._extended(p, q, int(self.bounds[k]), int(self.bounds[k + 1]))
        return context

    def _extended(self, p: int, q: int, low: int, high: int) -> None:
        """The longest stretch of period q about p, in steps that double."""
        codes, end, step = self.codes, p, 64
        if self.text[p] != self.text[p + q]:
            return
        while end < high - q:
            some = min(step, high - q - end)
            equal = codes[end : end + some] == codes[end + q : end + q + some]
            if not equal.all():
                end += int(equal.argmin())
                break
            end, step = end + some, 2 * step
        start, step = p, 64
        while start > low:
            some = min(step, start - low)
            equal = (codes[start - some : start] == codes[start - some + q : start + q])[::-1]
            if not equal.all():
                start -= int(equal.argmin())
                break
            start, step = start - some, 2 * step
        self._keep(start, end + q, q)

    def of_texts(self) -> dict[int, list[tuple[int, int, int]]]:
        """text -> its runs (start, length, period) by start, then period."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        for (start, end), q in self.found.items():
            k = int(self.text[start])
            out.setdefault(k, []).append((start - int(self.bounds[k]), end - start, q))
        for runs in out.values():
            runs.sort(key=lambda r: (r[0], r[2]))
        return out


def _without(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return list(compress(words, kept.tolist()))


def _groups(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The texts' words, in groups of about GROUP_WORDS. bytes.split parts at exactly the
    white space that no word holds."""
    group: list[list[bytes]] = []
    size = 0
    for text in texts:
        words = text.split() if text else []
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def periodic_runs(docs: DataFrame, *, text: str = "text", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """docs' columns but the text, with n_words, runs (start, length and period in words, by
    start, then period) and collapsed: the words that no run holds after its first period,
    one space apart."""
    if times < 4 or least < 1:
        raise ValueError("a run holds its period four times at least, as the contexts of the synchronising sets need")
    own = others(docs, text, "n_words", "runs", "collapsed")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            row = 0
            for group in _groups(batch.column(1).cast(pa.binary()).to_pylist()):
                if len(codes) > KEPT_CODES:
                    codes = Codes()
                size = np.array([len(words) for words in group])
                bounds = np.concatenate(([0], np.cumsum(size)))
                flat = np.fromiter((codes[w] for words in group for w in words), dtype=np.int64, count=int(bounds[-1]))
                runs = Runs(flat, bounds, times, least).of_texts() if len(flat) else {}
                kept = [b" ".join(_without(words, runs[k]) if k in runs else words) for k, words in enumerate(group)]
                lists = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs.get(k, ())] for k in range(len(group))], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(group)), pa.array(size, pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], names=["_row", "n_words", "runs", "collapsed"])
                row += len(group)

    rows = docs.select(packed(own), named(text).alias("_text"))
    return in_arrow(rows, run, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").select(*unpacked(own), "n_words", "runs", "collapsed")


def looped(text: Column, h: Column) -> Column:
    """The text with its words repeated from a place on, where h (a number from 0) divides
    by 10: with n words and g = floor(h / 10), each word i >= a = g mod n becomes word
    a + (i - a) mod p, p = 1 + floor((n - a) / (3 + g mod 8))."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    plan = F.struct(words.alias("w"), F.size(words).cast("long").alias("n"), F.floor(h / 10).alias("g"))

    def moved(x: Column) -> Column:
        a = x["g"] % x["n"]
        p = 1 + F.floor((x["n"] - a) / (3 + x["g"] % 8))
        places = F.sequence(F.lit(0).cast("long"), x["n"] - 1)
        return F.concat_ws(" ", F.transform(places, lambda i: F.get(x["w"], F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))))

    # the plan is computed once: an array of one element, transformed
    built = F.get(F.transform(F.array(plan), moved), 0)
    return F.when((h % 10 == 0) & text.rlike(WORD), built).otherwise(text)
