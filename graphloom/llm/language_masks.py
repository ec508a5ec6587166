"""Language identification by n-gram filters over language bitmasks.

Each language's frequent n-grams are put in a Bloom filter; the filters are bit-sliced:
place p of the table holds a mask whose bit L says whether language L's filter has p set.
One look at an n-gram's k places, ANDed, gives all languages that contain it. A text's
n-grams are counted by language, the counts are corrected for each filter's false
positives, and the largest corrected count decides.

Defined cases: a null text, or one without a letter, is `und` with score 0; a text whose
n-grams are in no filter gets the smallest language with score 0; ties go to the smaller
language; without training rows everything is `und`; repeated rows get equal results;
extra columns are kept, but lang_pred and score take the place of input columns of these
names; any number of languages is told apart (the masks take 8 MB for every 64).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import in_arrow, named, others, packed, unpacked
from graphloom.llm.textbytes import mixed, slices

N = 4  # bytes of an n-gram, word edges included
PLACES = 1 << 20
PROBES = 3
#: An n-gram is frequent if it is this share of its language's n-grams, so a language has
#: 1 / MIN_SHARE of them at most, whatever the corpus.
MIN_SHARE = 2e-5
WORD_BITS = 64  # languages of one mask word; a place has as many words as they need


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The N bytes from each position as a number, and whether they are one text's and hold
    no two neighbouring spaces, digit or sign."""
    m = len(data) - N + 1
    if m <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    plain = _FOLD[data]
    code = np.zeros(m, dtype=np.uint32)
    for k in range(N):
        code = code << np.uint32(8) | plain[k : k + m]
    ok = np.ones(m, dtype=bool)
    for k in range(1, N):
        inner = offsets[1:-1] - k
        ok[inner[(inner >= 0) & (inner < m)]] = False
    space = plain == 32
    twice = space[1:] & space[:-1]
    for k in range(N - 1):
        ok &= ~twice[k : k + m]
    return code, ok


#: ASCII signs, digits and white space become a space, A-Z a-z; other bytes stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(128)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, code, n) of (text, language) rows, added up as far as memory goes."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            for k in range(0, len(code), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code[k : k + 100_000])), pa.array(code[k : k + 100_000].astype(np.int64)), pa.array(n[k : k + 100_000])], names=["lang", "code", "n"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for row, data, offsets in slices(pc.utf8_lower(batch.column(0))):
            code, ok = codes(data, offsets)
            if not len(code):
                continue
            mine = langs[row : row + len(offsets) - 1]
            of = np.repeat(np.arange(len(mine)), np.diff(offsets))[: len(code)]
            for lang in set(mine):
                part = code[ok & (mine == lang)[of]]
                held.setdefault(lang, []).append(part)
                size += len(part)
        if size > 8 << 20:
            yield from flush()
            size = 0
    yield from flush()


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # PLACES masks of a word for every WORD_BITS languages
    false_rate: np.ndarray  # of each language's filter

    def masks(self, code: np.ndarray) -> np.ndarray:
        out = None
        for place in _places(code):
            got = self.table[place]
            out = got if out is None else out & got
        return out


def _places(code: np.ndarray) -> Iterator[np.ndarray]:
    h = mixed(code.astype(np.uint64) + np.uint64(1))
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    for k in range(PROBES):
        yield ((a + np.uint64(k) * b) & np.uint64(PLACES - 1)).astype(np.int64)


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE) -> Filters:
    """Filters of docs' rows with a language; all their n-grams are counted, and the frequent
    ones come to the driver, 1 / min_share of each language at most."""
    counted = docs.where(named(lang).isNotNull() & named(text).isNotNull()).select(named(text).alias("_text"), named(lang).alias("lang")).mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).persist()
    try:
        totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
        languages = sorted(r.lang for r in totals.select("lang").collect())
        frequent = counted.join(totals, "lang").where((F.col("n") >= min_share * F.col("total")) & (F.col("n") >= 1)).select("lang", "code").toPandas()
    finally:
        counted.unpersist()
    # few languages have narrow masks, which stay in the processor's cache
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    table = np.zeros((PLACES, max(1, -(-len(languages) // WORD_BITS))), dtype=kind)
    rate = np.zeros(len(languages))
    for k, name in enumerate(languages):
        code = frequent.code[frequent.lang == name].to_numpy().astype(np.uint64)
        for place in _places(code):
            table[place, k // WORD_BITS] |= kind(1 << k % WORD_BITS)
        rate[k] = ((table[:, k // WORD_BITS] >> kind(k % WORD_BITS)) & kind(1)).mean() ** PROBES
    return Filters(languages, table, rate)


def decided(filters: Filters, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. The score is the winner's lead over the next
    language, as a share of its own corrected count."""
    n, count = len(column), len(filters.languages)
    hits, total = np.zeros((n, count)), np.zeros(n)
    for row, data, offsets in slices(pc.utf8_lower(column)):
        code, ok = codes(data, offsets)
        if not len(code):
            continue
        at = np.minimum(offsets, len(code))
        mask = np.where(ok[:, None], filters.masks(code), filters.table.dtype.type(0))
        for k in range(-1, count):
            flag = ok if k < 0 else (mask[:, k // WORD_BITS] >> mask.dtype.type(k % WORD_BITS)) & mask.dtype.type(1)
            some = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
            got = some[at[1:]] - some[at[:-1]]
            if k < 0:
                total[row : row + len(got)] = got
            else:
                hits[row : row + len(got), k] = got
    fixed = np.maximum(0.0, (hits - total[:, None] * filters.false_rate) / (1 - filters.false_rate))
    best = fixed.argmax(axis=1) if count else np.zeros(n, int)
    top = fixed[np.arange(n), best] if count else np.zeros(n)
    second = np.sort(fixed, axis=1)[:, -2] if count > 1 else np.zeros(n)
    score = np.where(top > 0, (top - second) / np.maximum(top, 1e-12) if count > 1 else 1.0, 0.0)
    none = ~np.array(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False), dtype=bool)
    none |= count == 0
    return ["und" if none[k] else filters.languages[best[k]] for k in range(n)], np.round(np.where(none, 0.0, np.clip(score, 0.0, 1.0)), 9)


def identified(docs: DataFrame, train: Column, *, text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """docs' columns but the text, with lang_pred and score; `train` tells the rows whose
    text and language may be learnt from."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs.where(train), text=text, lang=lang, **how))
    own = others(docs, text, "lang_pred", "score")
    rows = docs.select(named(text).alias("_text"), packed(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = decided(sent.value, batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["_row", "lang_pred", "score"])

    return in_arrow(rows, run, "lang_pred string, score double").select(*unpacked(own), "lang_pred", "score")
