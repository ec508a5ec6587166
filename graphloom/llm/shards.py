"""Sharding by histogram sort: shards near equal in bytes, from one exchange.

Rows are ordered by (hash of the text, id), so equal texts lie together. Splitters of
that order are found by counting: each round puts aligned candidate boundaries (probes)
into every interval that still holds a splitter, counts the exact bytes below them over
all partitions, and keeps the one interval that the splitter falls in. A splitter is
settled when a probe is within `tolerance` of its target, or at the nearer end of the one
row or small group of equal texts that holds it; inside a large group the search goes on
over the ids' hashes. Only counts come to the driver: splitters x probes of them a round at
most, and splitters are fewer than shards. The exchange is by (shard, position), so a shard
of any size is dealt to as many tasks as it needs, and so is a group of equal texts.

Defined cases: a null text counts as empty and as equal to an empty one; a null id has a
hash like any other; fully equal rows are neighbours and may be split anywhere between
two of them only if an id does; an empty table has no rows; extra columns are kept, but what
is added takes the place of input columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Saved, named, others, packed, text_crc, unpacked
from graphloom.operators.loops import ranked

BITS = 10  # of a probe round: 1024 probes in an interval
WORD_BITS = 63
#: Of a shard: how near a splitter must come, and how far it may move so as not to cut a
#: group of equal texts.
TOLERANCE = 0.0002
SNAP = 0.01


@dataclass(frozen=True)
class Splitter:
    """Rows with (g, i) >= (group, item) lie at or above it."""

    group: int
    item: int


def positions(id_: Column, text: Column) -> list[Column]:
    """63-bit positions of a row's group and of the row in its group."""
    return [F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1).alias("g"), F.shiftrightunsigned(F.xxhash64(id_, F.lit(1)), 1).alias("i")]


@dataclass(frozen=True)
class Target:
    """An open target: bytes below its interval, the interval's prefix, and its group once
    the search is inside one."""

    below: int = 0
    prefix: int = 0
    group: int = 0


def splitters(rows: DataFrame, targets: list[float], slack: float, snap: float) -> list[Splitter]:
    """For each target (bytes below), a boundary that meets it to within slack. A group of
    equal texts is cut only if neither of its ends is within `snap`; a row never is."""
    found: dict[int, Splitter] = {}
    inside: dict[int, Target] = {}
    for level in ("g", "i"):
        open_ = {k: Target() for k in range(len(targets))} if level == "g" else inside
        done = 0
        while open_ and done < WORD_BITS:
            bits = min(BITS, WORD_BITS - done)
            shift = WORD_BITS - done - bits
            counts = _round(rows, level, done, shift, open_)
            following: dict[int, Target] = {}
            for k, t in open_.items():
                best, hit, base = (abs(t.below - targets[k]), t.prefix << bits), None, t.below
                for probe, size, n, low, high in counts.get((t.group, t.prefix), []):
                    if base + size > targets[k] and hit is None:
                        hit = (probe, base, size, n, low, high)
                    base += size
                    best = min(best, (abs(base - targets[k]), probe + 1))
                edge = best[1] << shift
                if hit is None or best[0] <= slack or hit[3] == 1 or (level == "i" and not shift):
                    found[k] = Splitter(edge, 0) if level == "g" else Splitter(t.group, edge)
                    continue
                probe, base, size, _, low, high = hit
                if level == "g" and low == high:
                    ends = min((abs(base - targets[k]), low), (abs(base + size - targets[k]), low + 1))
                    if ends[0] <= snap:
                        found[k] = Splitter(ends[1], 0)
                    else:
                        inside[k] = Target(base, 0, low)
                else:
                    following[k] = Target(base, probe, t.group)
            open_, done = following, done + bits
    return [found[k] for k in range(len(targets))]


def _round(rows: DataFrame, level: str, done: int, shift: int, open_: dict[int, Target]) -> dict[tuple[int, int], list[tuple[int, ...]]]:
    """(group, prefix) -> (probe, bytes, rows, lowest and highest group) in order, for the
    prefixes that open targets are in."""
    wanted = sorted({(t.group, t.prefix) for t in open_.values()})
    if done or level == "i":
        # no more of them than targets
        keys = F.explode(F.array(*[F.struct(F.lit(g).cast("long").alias("kg"), F.lit(p).cast("long").alias("kp")) for g, p in wanted]))
        keys = rows.sparkSession.range(1).select(keys.alias("k")).select("k.*")
        match = F.col("kp") == (F.shiftrightunsigned(level, WORD_BITS - done) if done else F.lit(0))
        rows = rows.join(F.broadcast(keys), match & (F.col("kg") == F.col("g")) if level == "i" else match)
    else:
        rows = rows.withColumn("kg", F.lit(0)).withColumn("kp", F.lit(0))
    counted = rows.groupBy("kg", "kp", F.shiftrightunsigned(level, shift).alias("probe")).agg(F.sum("size"), F.count("*"), F.min("g"), F.max("g"))
    out: dict[tuple[int, int], list[tuple[int, ...]]] = {}
    for kg, kp, *rest in sorted(map(tuple, counted.collect())):
        out.setdefault((kg, kp), []).append(tuple(rest))
    return out


def range_of(cuts: list[Splitter]) -> Column:
    """Number of cuts at or below a row, by a binary tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        cut = cuts[mid]
        above = (F.col("g") > cut.group) | ((F.col("g") == cut.group) & (F.col("i") >= cut.item))
        return F.when(above, tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(cuts))


def sharded(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """docs' columns but the text, with size, text_crc32, shard and slot (gapless in a shard,
    in the order of the sort). Every shard has total / shards bytes, to within tolerance of
    that or one row."""
    own = others(docs, text, "size", "text_crc32", "shard", "slot")
    whole = F.coalesce(named(text), F.lit(""))
    rows = docs.select(packed(own), F.octet_length(whole).cast("long").alias("bytes"), text_crc(whole).alias("text_crc32"), *positions(named(key), named(text)))
    saved = Saved(docs.sparkSession, "shards")
    rows = saved.save(rows.withColumn("size", F.col("bytes") + 8))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cuts = splitters(rows, [total * k / shards for k in range(1, shards)], tolerance * total / shards, SNAP * total / shards) if n else []
    cuts = sorted(cuts, key=lambda c: (c.group, c.item))
    # one exchange, in which a shard has as many tasks as its rows need; the order of the
    # sort makes a row's place in its shard the same wherever the tasks' ranges end
    dealt = ranked(rows.select("_row", "size", "text_crc32", "g", "i", range_of(cuts).alias("shard")), "shard", "g", "i", name="place", n=n)
    return dealt.select(*unpacked(own), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") - 1).alias("slot"))
