"""SimHash near-dedup by anchor-point covering.

A perfect covering code's words are the anchors: every point is within the code's radius
R of exactly one. A fingerprint goes to the anchor of every point near it, and only
fingerprints that meet at an anchor are compared. Two fingerprints at distance t or less
have a point within ceil(t / 2) of both; its anchor is within R + ceil(t / 2) of both, so
they meet. (The plain method replicates one side within R + t; replicating both sides to
half the threshold needs fewer copies and finds the same pairs.) The 64 bits are cut into
bands, of which one differs in t / bands bits at most; within a band the code is a product
of Golay (23 bits, R = 3), Hamming (15 bits, R = 1) and plain bits (R = 0).

Defined cases: a null or empty text, or one of white space, has no words and fingerprint
zero; texts of fewer words than a shingle have one shingle, all their words; rows with
equal fingerprints are linked; a null id is never the smallest of a component that holds
an id; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Saved, in_arrow, named, others, packed, unpacked
from graphloom.llm.components import crowded, linked
from graphloom.llm.textbytes import Hashes, mixed, slices, word_bounds

SEED = 42
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Code:
    """A perfect cyclic code: n bits, generator polynomial, covering radius."""

    n: int
    generator: int
    radius: int

    @property
    def check_bits(self) -> int:
        return self.generator.bit_length() - 1


GOLAY = Code(23, 0b110001110101, 3)
HAMMING = Code(15, 0b10011, 1)


@cache
def _tables(code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each single bit; error pattern of each syndrome."""
    bit = np.zeros(code.n, dtype=np.int64)
    for k in range(code.n):
        r = 1 << k
        while r.bit_length() > code.check_bits:
            r ^= code.generator << (r.bit_length() - code.generator.bit_length())
        bit[k] = r
    error = np.full(1 << code.check_bits, -1, dtype=np.int64)
    for weight in range(code.radius + 1):
        for at in combinations(range(code.n), weight):
            error[np.bitwise_xor.reduce(bit[list(at)]) if at else 0] = sum(1 << k for k in at)
    assert (error >= 0).all(), "the code is not perfect"
    return bit, error


def anchor_of(code: Code, points: np.ndarray) -> np.ndarray:
    """The nearest code word, named by its message bits."""
    bit, error = _tables(code)
    syndrome = np.zeros_like(points)
    for k in range(code.n):
        syndrome ^= ((points >> k) & 1) * bit[k]
    return (points ^ error[syndrome]) >> code.check_bits


@dataclass(frozen=True)
class Band:
    """Consecutive bits of a fingerprint: `codes` in order, then `plain` bits."""

    start: int
    codes: tuple[Code, ...]
    plain: int

    @property
    def width(self) -> int:
        return sum(c.n for c in self.codes) + self.plain


#: One band for thresholds to 2; 54 bits, 2^32 anchors, 18 or so copies of a fingerprint.
WIDE = (Band(0, (GOLAY, GOLAY), 8),)
#: Three bands for thresholds to 8; 2^17 anchors each, 41 or so copies in all.
THREE = (Band(0, (HAMMING,), 6), Band(21, (HAMMING,), 6), Band(42, (HAMMING,), 7))


def anchors(fingerprints: np.ndarray, bands: tuple[Band, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) of every visit: the anchors of all points that
    differ in one bit of the band at most."""
    index, names = [], []
    for number, band in enumerate(bands):
        part = (fingerprints.view(np.uint64) >> np.uint64(band.start)).astype(np.int64) & ((1 << band.width) - 1)
        at = 0
        homes, near = [], []
        for code in band.codes:
            own = (part >> at) & ((1 << code.n) - 1)
            flips = np.array([0, *(1 << k for k in range(code.n))], dtype=np.int64)
            around = anchor_of(code, (own[:, None] ^ flips).ravel()).reshape(len(own), -1)
            homes.append(around[:, 0])
            near.append(np.sort(around, axis=1))
            at += code.n
        plain = (part >> at) & ((1 << band.plain) - 1)
        bits = [c.n - c.check_bits for c in band.codes]

        def named(words: list[np.ndarray], rest: np.ndarray, bits: list[int] = bits, plain_bits: int = band.plain, number: int = number) -> np.ndarray:
            out = np.full(len(rest), number, dtype=np.int64)
            for w, b in zip(words, bits, strict=True):
                out = out << b | w
            return out << plain_bits | rest

        rows = np.arange(len(part))
        index.append(rows)
        names.append(named(homes, plain))
        for k in range(band.plain):
            index.append(rows)
            names.append(named(homes, plain ^ (1 << k)))
        for c, around in enumerate(near):
            fresh = np.ones(around.shape, dtype=bool)
            fresh[:, 1:] = around[:, 1:] != around[:, :-1]
            fresh &= around != homes[c][:, None]
            i, j = np.nonzero(fresh)
            words = [h[i] for h in homes]
            words[c] = around[i, j]
            index.append(i)
            names.append(named(words, plain[i]))
    return np.concatenate(index), np.concatenate(names)


def visits(fingerprints: DataFrame, bands: tuple[Band, ...], *, fingerprint: str = "fingerprint") -> DataFrame:
    """fingerprints' columns and `anchor`, a row for each visit."""
    rest = others(fingerprints, fingerprint)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                some = batch.slice(start, 2000)
                index, names = anchors(some.column(1).to_numpy(zero_copy_only=False).astype(np.int64), bands)
                taken = some.take(pa.array(index))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(names)], names=[*taken.schema.names, "anchor"])

    out = in_arrow(fingerprints.select(packed(rest), named(fingerprint).alias("_print")), spread, "_print long, anchor long")
    return out.select("anchor", F.col("_print").alias(fingerprint), *unpacked(rest))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_fingerprints(column: pa.Array, words: int = 3) -> np.ndarray:
    """Majority bits of the XXH64 hashes of each text's shingles, repeats included."""
    out = np.zeros(len(column), dtype=np.uint64)
    for row, data, offsets in slices(column):
        rows, hashes = _shingle_hashes(_LOWER[data], offsets, words)
        found, edges = np.unique(rows, return_index=True)
        for r, a, b in zip(found.tolist(), edges.tolist(), [*edges[1:].tolist(), len(rows)], strict=True):
            out[row + r] = majority(hashes[a:b])
    return out


def _shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, XXH64) of every shingle in order of row; fewer words than `words` are one."""
    start, end, at = word_bounds(data, offsets)
    size = end - start
    # the words again, with one space after each
    put = np.cumsum(size + 1) - size - 1
    total = int((size + 1).sum())
    tape = np.append(data, np.uint8(32))[np.minimum(np.repeat(start - put, size + 1) + np.arange(total), len(data))]
    tape[put + size] = 32
    m = max(0, len(start) - words + 1)
    first = np.flatnonzero(at[:m] == at[words - 1 :]) if m else np.zeros(0, np.int64)
    last = first + words - 1
    count = np.bincount(at, minlength=len(offsets) - 1)
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        begin = np.searchsorted(at, few)
        first, last = np.concatenate((first, begin)), np.concatenate((last, begin + count[few] - 1))
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
    return at[first], xxh64(tape, put[first], put[last] + size[last] - put[first], SEED)


#: The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint64(k) | x >> np.uint64(64 - k)


def xxh64(tape: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many stretches of the bytes at once. Stretches are put in order of what their
    last 32-byte block holds, so that each step works on a contiguous part of them."""
    n = len(begin)
    order = np.argsort((size % 32).astype(np.uint8), kind="stable")
    at, size = begin[order].astype(np.int64), size[order].astype(np.int64)
    tape = np.concatenate((tape, np.zeros(8, np.uint8)))
    lane = np.ndarray((len(tape) - 7,), dtype="<u8", buffer=tape.data, strides=(1,))
    seed_ = np.uint64(seed)
    with np.errstate(over="ignore"):

        def stirred(v: np.ndarray, x: np.ndarray) -> np.ndarray:
            return _rotated(v + x * _P2, 31) * _P1

        h = np.full(n, seed_ + _P5, dtype=np.uint64)
        long = np.flatnonzero(size >= 32)
        if len(long):
            v = [np.full(len(long), x, dtype=np.uint64) for x in (seed_ + _P1 + _P2, seed_ + _P2, seed_, seed_ - _P1)]
            going = np.arange(len(long))
            while len(going):
                here = at[long[going]]
                for k in range(4):
                    v[k][going] = stirred(v[k][going], lane[here + 8 * k])
                at[long[going]] += 32
                going = going[begin[order[long[going]]] + size[long[going]] - at[long[going]] >= 32]
            total = _rotated(v[0], 1) + _rotated(v[1], 7) + _rotated(v[2], 12) + _rotated(v[3], 18)
            for k in range(4):
                total = (total ^ stirred(np.uint64(0), v[k])) * _P1 + _P4
            h[long] = total
        h += size.astype(np.uint64)
        rest = size % 32
        for k in range(3):
            some = slice(int(np.searchsorted(rest, 8 * k + 8)), n)
            h[some] = _rotated(h[some] ^ stirred(np.uint64(0), lane[at[some]]), 27) * _P1 + _P4
            at[some] += 8
        four = np.flatnonzero(rest & 4)
        h[four] = _rotated(h[four] ^ (lane[at[four]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        at[four] += 4
        for k in range(3):
            one = np.flatnonzero(rest % 4 > k)
            h[one] = _rotated(h[one] ^ tape[at[one]].astype(np.uint64) * _P5, 11) * _P1
            at[one] += 1
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        h ^= h >> np.uint64(32)
    out = np.empty(n, dtype=np.uint64)
    out[order] = h
    return out


def fingerprinted(docs: DataFrame, *, text: str = "text", words: int = 3) -> DataFrame:
    """docs' columns but the text, and `fingerprint` (long)."""
    own = others(docs, text, "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shingle_fingerprints(batch.column(1), words).view(np.int64))], names=["_row", "fingerprint"])

    return in_arrow(docs.select(packed(own), named(text).alias("_text")), run, "fingerprint long").select(*unpacked(own), "fingerprint")


def within(threshold: int) -> "callable":
    return lambda x, y: F.bit_count(F.col(f"{x}.node").bitwiseXOR(F.col(f"{y}.node"))) <= threshold


def near_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3, threshold: int = 2, bands: tuple[Band, ...] = WIDE) -> DataFrame:
    """docs' columns but the text, with fingerprint (long) and component_id: the smallest id
    whose fingerprint is reachable over fingerprints that differ in `threshold` bits at most."""
    assert max(threshold // len(bands), 0) <= 2, "a band may differ in two bits at most"
    saved = Saved(docs.sparkSession, "simhash")
    own = others(docs, text, "fingerprint", "component_id")
    rows = docs.select(packed(own), named(key).alias("_key"), named(text).alias("_text"))
    marked = saved.save(fingerprinted(rows, text="_text", words=words))
    distinct = marked.groupBy(F.col("fingerprint").alias("node")).agg(F.min("_key").alias("least"))
    shared = saved.save(crowded(visits(distinct.select("node"), bands, fingerprint="node")))
    groups = linked(shared, within(threshold))
    group = saved.save(distinct.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = group.groupBy("component").agg(F.min("least").alias("component_id"))
    told = group.join(least, "component").select(F.col("node").alias("fingerprint"), "component_id")
    return marked.join(told, "fingerprint").select(*unpacked(own), "fingerprint", "component_id")


# ---- documents that share most of their shingles ------------------------------------

SKETCH = 8  # 64-bit words of parity bits of a text's shingles


def _wide(grams: np.ndarray) -> np.ndarray:
    """Parity bits of a long text, as many as it has shingles at least; none for a short one."""
    if len(grams) <= 64 * SKETCH:
        return np.zeros(0, dtype=np.int64)
    size = 64 * SKETCH << int(np.ceil(np.log2(len(grams) / (64 * SKETCH))))
    odd = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _apart(x: Column, y: Column) -> Column:
    """Parity bits that differ; the longer of two is folded to the length of the other, as bits
    are chosen by the last bits of a hash. 0 if either has none."""
    n = F.least(F.size(x), F.size(y))

    def folded(v: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(i, F.size(v) - 1, n), F.lit(0).cast("long"), lambda a, j: a.bitwiseXOR(F.get(v, j)))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.bit_count(folded(x, i).bitwiseXOR(folded(y, i))))
    return F.when(n > 0, total).otherwise(0)


def _windows(words: np.ndarray, at: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle of `size` words; shorter texts have one."""
    parts_row, parts_hash = [], []
    m = len(words) - size + 1
    if m > 0:
        mix = np.zeros(m, dtype=np.uint64)
        for k in range(size):
            mix = (mix + words[k : k + m]) * np.uint64(0xD6E8FEB86659FD93)
        whole = at[:m] == at[size - 1 :]
        parts_row.append(at[:m][whole])
        parts_hash.append(mixed(mix[whole]))
    count = np.bincount(at, minlength=n)
    for row in np.flatnonzero(count < size):
        parts_row.append(np.array([row]))
        total = np.zeros(1, dtype=np.uint64)
        for w in words[at == row]:
            total = (total + w) * np.uint64(0xD6E8FEB86659FD93)
        parts_hash.append(mixed(total))
    rows, hashes = np.concatenate(parts_row), np.concatenate(parts_hash)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[fresh], hashes[fresh]


ORDER_ROWS = 5_000  # texts, about, whose shingles are counted for the order
ORDER_SHINGLES = 10_000


def _common(docs: DataFrame, text: str, node: Column, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that are common in a sample of the texts, in order, and their
    counts. They only order shingles: any order gives the same links."""
    parts = max(1, docs.count() // ORDER_ROWS)
    some = docs.select(F.col(text).alias("_text"), node.alias("node")).where(F.pmod(F.xxhash64("node"), F.lit(parts)) == 0)
    grams = some.mapInArrow(_sets(words), "node long, grams array<long>").dropDuplicates(["node"]).select(F.explode("grams").alias("g"))
    found = grams.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "g").limit(ORDER_SHINGLES).toArrow()
    hashes, counts = (np.array(found[c].to_numpy(), dtype=np.int64) for c in ("g", "n"))
    order = np.argsort(hashes.view(np.uint64))
    return hashes.view(np.uint64)[order], counts[order]


def _first(rows: np.ndarray, grams: np.ndarray, n: int, similarity: float, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, shingles) of each row's first n - ceil(similarity * n) + 1 shingles, rarest
    first: two sets with that Jaccard similarity have one of these in common."""
    often = np.zeros(len(grams), dtype=np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
        often = np.where(hashes[at] == grams, counts[at], 0)
    order = np.lexsort((grams, often, rows))
    size = np.bincount(rows, minlength=n)
    take = size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1
    place = np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
    kept = grams[order][place < np.repeat(take, size)]
    return np.cumsum(np.minimum(take, size)), kept


def _digest(words: int, similarity: float, often: np.ndarray, counts: np.ndarray) -> "callable":
    """Batches of (row, text) to (row, fingerprint of the distinct words, number of distinct
    shingles, parity sketches of the shingles, the first shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            prints, sizes, sketch = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros((n, SKETCH), np.uint64)
            firsts, wide = [], [np.zeros(0, dtype=np.int64)] * n
            for row, data, offsets in slices(batch.column(1)):
                data = _LOWER[data]
                start, end, at = word_bounds(data, offsets)
                hashes = Hashes(data).of(start, end)
                m = len(offsets) - 1
                rows, grams = _windows(hashes, at, m, words)
                sizes[row : row + m] = np.bincount(rows, minlength=m)
                for k in np.flatnonzero(sizes[row : row + m] > 64 * SKETCH):
                    wide[row + k] = _wide(grams[slice(*np.searchsorted(rows, (k, k + 1)))])
                ends, first = _first(rows, grams, m, similarity, often, counts)
                # the sign sets them apart from the fingerprints' anchors
                firsts.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array((first | np.uint64(1 << 63)).view(np.int64))))
                bits = np.bincount(rows * (64 * SKETCH) + (grams & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=m * 64 * SKETCH) & 1
                sketch[row : row + m] = np.packbits(bits.astype(np.uint8).reshape(m, -1), axis=1, bitorder="little").view(np.uint64)
                single_rows, single = _windows(hashes, at, m, 1)
                edges = np.searchsorted(single_rows, np.arange(m + 1))
                count = np.bincount(at, minlength=m)
                for k in range(m):
                    if count[k]:
                        prints[row + k] = majority(single[edges[k] : edges[k + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), pa.array(sizes), *[pa.array(np.ascontiguousarray(sketch[:, k]).view(np.int64)) for k in range(SKETCH)], pa.array(wide, pa.list_(pa.int64())), pa.concat_arrays(firsts) if firsts else pa.array([], pa.list_(pa.int64()))], names=["_row", "fingerprint", "shingles", *[f"s{k}" for k in range(SKETCH)], "wide", "first"])

    return run


def _sets(words: int) -> "callable":
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column(0)):
                data = _LOWER[data]
                start, end, at = word_bounds(data, offsets)
                m = len(offsets) - 1
                rows, grams = _windows(Hashes(data).of(start, end), at, m, words)
                ends = np.searchsorted(rows, np.arange(m + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, m), pa.ListArray.from_arrays(pa.array(ends), pa.array(grams.view(np.int64)))], names=["node", "grams"])

    return run


def similar_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, threshold: int = 2, bands: tuple[Band, ...] = WIDE) -> DataFrame:
    """(key, node, rows, group_id, group_node): every distinct (id, text) of docs, node being the
    text's hash, with the number of its rows and the smallest id and the node of its group. Texts
    are linked if their sets of shingles have a Jaccard similarity of `similarity` or more, which
    is verified. Those are held against each other that meet at an anchor of their SimHash (of
    distinct words, `threshold` bits apart at most), and, so that no pair is missed, those that
    share one of their first shingles, the rarest ones, as all texts with that similarity do."""
    saved, passing = Saved(docs.sparkSession, "similar"), Saved(docs.sparkSession, "digests")
    docs, name = docs.select(named(key).alias("id"), named(text).alias("text")), key
    node = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct("id", node.alias("node")).alias("_row"), "text")
    sketch = [f"s{k}" for k in range(SKETCH)]
    hashes, counts = _common(docs, "text", node, words)
    digest = in_arrow(rows, _digest(words, similarity, hashes, counts), f"fingerprint long, shingles long, {', '.join(f'{s} long' for s in sketch)}, wide array<long>, first array<long>")
    digest = passing.save(digest.select("_row.*", "fingerprint", "shingles", *sketch, "wide", "first"))
    each = saved.save(digest.groupBy("id", "node").agg(F.count("*").alias("rows")))
    nodes = digest.groupBy("node").agg(F.min("id").alias("id"), F.first("fingerprint").alias("fingerprint"), F.first("shingles").alias("shingles"), F.first("wide").alias("wide"), *[F.first(s).alias(s) for s in sketch])
    nodes = saved.save(nodes)
    met = visits(nodes.select("fingerprint", "node"), bands).select("anchor", "node")
    shared = saved.save(crowded(met.union(digest.select(F.explode("first").alias("anchor"), "node"))))
    passing.drop_all()

    def near(x: str, y: str) -> Column:
        sized = F.least(f"{x}.shingles", f"{y}.shingles") >= similarity * F.greatest(f"{x}.shingles", f"{y}.shingles") - 1e-6
        # each parity bit that differs is a shingle that only one side has: an exact bound
        differ = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in sketch), F.lit(0))
        return sized & (differ * (1 + similarity) <= (1 - similarity) * (F.col(f"{x}.shingles") + F.col(f"{y}.shingles")) + 1e-6)

    def verify(pairs: DataFrame) -> DataFrame:
        using = Saved(docs.sparkSession, "verified")
        # long texts outgrow the sketch: their wide ones, a 64th of their shingles, come first
        x, y = nodes.select(F.col("node").alias("a"), F.struct("shingles", "wide").alias("x")), nodes.select(F.col("node").alias("b"), F.struct("shingles", "wide").alias("y"))
        apart = _apart(F.col("x.wide"), F.col("y.wide"))
        close = apart * (1 + similarity) <= (1 - similarity) * (F.col("x.shingles") + F.col("y.shingles")) + 1e-6
        pairs = using.save(pairs.join(x, "a").join(y, "b").where(close).select("a", "b"))
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        # one row of each text: the one with the smallest id
        reps = wanted.join(nodes.select("node", "id"), "node").select(F.col("node").alias("_node"), F.col("id").alias("_id"))
        texts = docs.select("text", "id", node.alias("node")).join(reps, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id"))).select("text", "node")
        grams = using.save(texts.mapInArrow(_sets(words), "node long, grams array<long>").dropDuplicates(["node"]))
        left, right = grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), grams.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
        both = pairs.join(left, "a").join(right, "b").withColumn("same", F.size(F.array_intersect("ga", "gb")))
        found = saved.save(both.where(F.col("same") >= similarity * (F.size("ga") + F.size("gb") - F.col("same")) - 1e-9).select("a", "b"))
        using.drop_all()
        return found

    groups = linked(shared, near, verify, facts=nodes.select("node", "shingles", *sketch))
    placed = saved.save(nodes.select("node", "id").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = placed.groupBy("component").agg(F.min("id").alias("group_id"), F.min_by("node", F.struct(F.col("id").isNull(), "id", "node")).alias("group_node"))
    told = saved.save(placed.join(least, "component").select("node", "group_id", "group_node"))
    return each.join(told, "node").select(F.col("id").alias(name), "node", "rows", "group_id", "group_node")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the near copies: of each group the row with the smallest id stays, of equal
    rows one."""
    groups = Saved(docs.sparkSession, "kept").save(similar_groups(docs, key=key, text=text, **how))
    stays = groups.where(named(key).eqNullSafe(F.col("group_id")) & (F.col("node") == F.col("group_node"))).select(named(key).alias("_id"), F.col("node").alias("_node"), "rows")
    own = docs.columns
    rows = docs.select(packed(own), named(key).alias("_key"), F.xxhash64(F.coalesce(named(text), F.lit(""))).alias("_text_node"))
    left = rows.join(stays, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text_node") == F.col("_node")))
    again = left.where("rows > 1").dropDuplicates(["_key", "_text_node"])
    return left.where("rows = 1").union(again).select(*unpacked(own))
