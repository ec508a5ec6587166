"""Merkle manifest of a data set with a witness for every row, built by aligned appends.

A group's leaves are appended in order. Each run of three neighbouring nodes (the last run
may be shorter, even one) becomes the node above it, until one is left: the group's
subroot; the subroots, in the order of their groups, become the root in the same way. H is
the lower-case hexadecimal SHA-256 of its inputs' text.

A task appends the leaves of one aligned block (3^LEVELS of them) as a stream. An open
subtree holds the partial witnesses of its leaves, and whenever a sibling completes the run,
they are extended by it (`Subtrees`). The blocks' roots are leaves of a further round of
appends, dealt out again in blocks, until a group has one node; then the subroots are
appended in the same way. From the top down, what has completed above a block extends the
witnesses of its leaves, so a witness is only ever whole in the task that puts it out, and
no shuffle carries more than one witness a block.

New rows behind the last ones change only the open block of their group at each round:
`appended` takes up an earlier manifest there, and all closed blocks keep their roots.

Defined cases: null values are `-` in a leaf; null ids come first; rows of equal id are in
the order of their leaves; equal rows are leaves of their own with the witnesses of
neighbouring places; a null group is a group, before all others; an empty table has no rows
and no root; extra columns are kept, but what is added takes the place of input columns of
these names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Saved, in_arrow, named, others, packed, unpacked
from graphloom.operators.loops import ranked

ARITY = 3
LEVELS = 6  # of a block
BLOCK = ARITY**LEVELS
PROOF = "array<struct<before: string, after: string>>"
Witness = list[tuple[str, str]]  # a level each: the siblings before a node and after it


def joined_hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """H of the values: `-` if null, else the number of UTF-8 bytes, `:` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Subtrees:
    """Subtrees that are still open, by height, each with the leaves that it holds."""

    def __init__(self) -> None:
        self.open: list[list[tuple[str, list[int]]]] = []
        self.witnesses: list[Witness] = []

    def append(self, digest: str) -> None:
        self.witnesses.append([])
        self._put(0, digest, [len(self.witnesses) - 1])

    def _put(self, height: int, digest: str, leaves: list[int]) -> None:
        if height == len(self.open):
            self.open.append([])
        self.open[height].append((digest, leaves))
        if len(self.open[height]) == ARITY:
            self._complete(height)

    def _complete(self, height: int) -> None:
        run, self.open[height] = self.open[height], []
        digests = [digest for digest, _ in run]
        for k, (_, leaves) in enumerate(run):
            step = ("".join(digests[:k]), "".join(digests[k + 1 :]))
            for x in leaves:
                self.witnesses[x].append(step)
        self._put(height + 1, joined_hash(*digests), [x for _, leaves in run for x in leaves])

    def close(self, height: int = 0) -> str:
        """The root: short runs are completed until one node is left, at `height` at least."""
        at = 0
        while True:
            if self.open[at]:
                if at >= height and sum(map(len, self.open)) == 1:
                    return self.open[at][0][0]
                self._complete(at)
            at += 1


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by group and block, cut where a block ends."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, blocks = batch.column("g").to_pylist(), batch.column("block").to_pylist()
        if held and (groups[0], blocks[0]) != key:
            yield pa.Table.from_batches(held)
            held = []
        key, cut = (groups[-1], blocks[-1]), batch.num_rows
        while cut and (groups[cut - 1], blocks[cut - 1]) == key:
            cut -= 1
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _blocks(table: pa.Table) -> Iterator[tuple[int, int]]:
    """First row and end of each block."""
    keys = list(zip(table.column("g").to_pylist(), table.column("block").to_pylist(), strict=True))
    start = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[start]:
            yield start, k
            start = k


def _dealt(nodes: DataFrame, *order: str) -> DataFrame:
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(tasks, "g", "block").sortWithinPartitions("g", "block", *order)


def _roots(nodes: DataFrame) -> DataFrame:
    """(g, pos, digest) of the blocks of nodes (g, pos, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            groups, blocks, digests = (table.column(c).to_pylist() for c in ("g", "block", "digest"))
            out = []
            for start, end in _blocks(table):
                trees = Subtrees()
                for digest in digests[start:end]:
                    trees.append(digest)
                # behind the first block there are more, so all are lifted to one height;
                # the first block has that height if it is full, and is alone if it is not
                out.append((groups[start], blocks[start], trees.close(LEVELS if blocks[start] else 0)))
            g, pos, digest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(pos, pa.int64()), pa.array(digest, pa.string())], names=["g", "pos", "digest"])

    block = F.floor(F.col("pos") / BLOCK).alias("block")
    return _dealt(nodes.select("g", block, "pos", "digest"), "pos").mapInArrow(run, "g string, pos long, digest string")


def _rounds(saved: Saved, nodes: DataFrame) -> list[DataFrame]:
    """nodes, the roots of its blocks, the roots of their blocks, until every group has one."""
    out = [nodes]
    while not out[-1].where(F.col("pos") > 0).isEmpty():
        out.append(saved.save(_roots(out[-1])))
    return out


def _extended(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes' _row with g, pos, subroot and proof: their witnesses within the block, extended
    by the one of the block's root. above: g, pos, subroot, proof."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            digests, tops, subroots = (table.column(c).to_pylist() for c in ("digest", "proof", "subroot"))
            before, after, ends, own, keep = [], [], [0], [], []
            for start, end in _blocks(table):
                trees = Subtrees()
                for digest in digests[start + 1 : end]:
                    trees.append(digest)
                # a row that begins a block carries what has completed above it
                block = table.column("block")[start].as_py()
                trees.close(LEVELS if block else 0)
                top = [(x["before"], x["after"]) for x in tops[start]]
                for witness in trees.witnesses:
                    steps = witness + top
                    before += [b for b, _ in steps]
                    after += [a for _, a in steps]
                    ends.append(len(before))
                own += [subroots[start]] * (end - start - 1)
                keep += range(start + 1, end)
            kept = table.take(pa.array(keep, pa.int64())).combine_chunks()
            steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
            if not kept.num_rows:
                continue
            yield pa.RecordBatch.from_arrays([*[kept.column(c).chunk(0) for c in ("_row", "g", "pos")], pa.array(own, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)], names=["_row", "g", "pos", "subroot", "proof"])

    none = F.lit(None)
    kind = nodes.schema["_row"].dataType
    heads = above.select(none.cast(kind).alias("_row"), "g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), none.cast("string").alias("digest"), "subroot", "proof")
    rows = nodes.select("_row", "g", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "digest", none.cast("string").alias("subroot"), none.cast(PROOF).alias("proof"))
    return in_arrow(_dealt(rows.union(heads), "pos"), run, f"g string, pos long, subroot string, proof {PROOF}")


def _bare(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("_row", F.struct(F.lit(0).alias("none")))


def _group_key(group: Column) -> Column:
    """A text that is never null and keeps the order of groups, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


class Manifest:
    """The rounds of appends over rows, and the root of them all.

    rows has a column `leaf` with the rows' digests, which `group` and `order` put in their
    places."""

    def __init__(self, rows: DataFrame, *, group: str, order: str, _placed: DataFrame | None = None) -> None:
        self.columns = others(rows, "subroot", "root", "proof")
        self.saved = Saved(rows.sparkSession, "witnesses")
        if _placed is None:
            keyed = rows.select(packed(self.columns), _group_key(named(group)).alias("g"), named(order).alias("o"), F.col("leaf").alias("digest"))
            _placed = ranked(keyed, "g", "o", "digest", name="pos").select("_row", "g", (F.col("pos") - 1).alias("pos"), "digest")
        self.nodes = self.saved.save(_placed)
        self._finish(_rounds(self.saved, self.nodes))

    def _finish(self, rounds: list[DataFrame]) -> None:
        self.rounds = rounds
        ordered = ranked(self.rounds[-1].select("g", F.lit("").alias("all"), "digest"), "all", "g", name="pos")
        self.subroots = self.saved.save(ordered.select(F.struct("g").alias("_row"), F.col("all").alias("g"), (F.col("pos") - 1).alias("pos"), "digest"))
        self.top = _rounds(self.saved, self.subroots)
        root = self.top[-1].first()  # one row, or none
        self.root: str | None = root.digest if root else None

    def witnesses(self) -> DataFrame:
        """The rows with subroot, root and proof: for each level from the leaf to the root the
        digests before and behind the node, side by side."""
        above = self.top[-1].select("g", "pos", F.col("digest").alias("subroot"), F.array().cast(PROOF).alias("proof"))
        for nodes in reversed(self.top[:-1]):
            nodes = nodes if nodes is self.subroots else _bare(nodes)
            above = self.saved.save(_extended(nodes, above))
        groups = self.rounds[-1].select("g", "pos", F.col("digest").alias("subroot"))
        if len(self.top) > 1:  # one group: its subroot is the root, and above it is nothing
            groups = groups.join(above.select(F.col("_row.g").alias("k"), "proof"), F.col("g") == F.col("k")).drop("k")
        else:
            groups = groups.withColumn("proof", F.array().cast(PROOF))
        above = self.saved.save(groups)
        for nodes in reversed(self.rounds[1:-1]):
            above = self.saved.save(_extended(_bare(nodes), above).drop("_row"))
        if len(self.rounds) > 1:
            out = _extended(self.nodes, above)
        else:
            out = self.nodes.join(above, ["g", "pos"])
        return out.select(*unpacked(self.columns), "subroot", F.lit(self.root).alias("root"), "proof")

    def appended(self, rows: DataFrame, *, group: str, order: str) -> Manifest:
        """The manifest with rows of the same columns behind those that are there: only the
        open block of each group, and the open blocks above it, are hashed again."""
        old, new = self, Manifest.__new__(Manifest)
        new.columns, new.saved = old.columns, Saved(rows.sparkSession, "witnesses")
        keyed = rows.select(packed(old.columns), _group_key(named(group)).alias("g"), named(order).alias("o"), F.col("leaf").alias("digest"))
        behind = ranked(keyed, "g", "o", "digest", name="rank").select("_row", "g", "rank", "digest")
        size = old.nodes.groupBy("g").agg(F.count("*").alias("size"))
        placed = behind.join(size, "g", "left").select("_row", "g", (F.col("rank") - 1 + F.coalesce("size", F.lit(0))).alias("pos"), "digest")
        fresh = new.saved.save(placed)
        new.nodes = new.saved.save(old.nodes.union(fresh))
        rounds, changed = [new.nodes], fresh
        while not rounds[-1].where(F.col("pos") > 0).isEmpty():
            depth = len(rounds)
            touched = changed.select("g", F.floor(F.col("pos") / BLOCK).alias("block")).distinct()
            part = rounds[-1].withColumn("block", F.floor(F.col("pos") / BLOCK)).join(touched, ["g", "block"], "left_semi")
            changed = new.saved.save(_roots(part))
            # a group that had a round less so far stands in it with its last node
            known = old.rounds[min(depth, len(old.rounds) - 1)].select("g", "pos", "digest")
            rounds.append(new.saved.save(changed.union(known.join(changed, ["g", "pos"], "left_anti"))))
        new._finish(rounds)
        return new


def proof_digest(proof: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda x: F.concat(x["before"], x["after"]))), 256)


def folded(proof: Column, digest: Column) -> Column:
    """The root that a leaf's digest leads to along its witness."""
    return F.aggregate(proof, digest, lambda above, x: F.sha2(F.concat(x["before"], above, x["after"]), 256))
