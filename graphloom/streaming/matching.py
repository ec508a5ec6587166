"""Scored matching of a stream against all that came before.

State is kept by block key and part: a new row is stored in one part of each of its blocks and
looks into all parts, so a block with many rows is dealt to as many tasks as it has parts.
What meets is scored by Spark. State is in the query's checkpoint: after a restart a batch
that runs again meets the same rows and gives the same pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.functions import strings as S

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAIRS = "a long, b long, name_a string, name_b string, block string"
CHUNK = 20_000  # pairs that are given on together, about


def _frame(parts: list[tuple], block) -> pd.DataFrame:
    a, b, name_a, name_b = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pd.DataFrame({"a": a, "b": b, "name_a": name_a, "name_b": name_b, "block": block})


class Meetings(StatefulProcessor):
    """Pairs of rows of one block and part whose times are at most `keep` seconds apart (any
    if it is None), each once: when the later one to come looks for the earlier one."""

    def __init__(self, keep: float | None, late: float) -> None:
        self.keep, self.late = keep, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "id long, name string, at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.known.get()) if self.known.exists() else []
        fresh = sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: (r.at, r.id))
        there = held + [(int(r.id), r.name, float(r.at)) for r in fresh if r.home]
        before = len(held) + np.cumsum([0] + [bool(r.home) for r in fresh])  # what a row looks at
        held = there
        if self.keep is not None and held:
            # what no row within the lateness can still meet
            newest = max(at for _, _, at in held)
            held = [x for x in held if x[2] >= newest - self.keep - self.late]
        if held:
            self.known.put(held)
        else:
            self.known.clear()
        yield from self._pairs(fresh, there, before, key[0])

    def _pairs(self, fresh: list, there: list, before: np.ndarray, block) -> Iterator[pd.DataFrame]:
        """Parts of about CHUNK pairs: all pairs of a large block are never held at once."""
        ids, at = np.array([x[0] for x in there], dtype="int64"), np.array([x[2] for x in there], dtype="float64")
        names = np.empty(len(there), dtype=object)
        names[:] = [x[1] for x in there]
        out, size = [], 0
        for r, n in zip(fresh, before, strict=False):
            for first in range(0, int(n), CHUNK):
                part = slice(first, min(first + CHUNK, int(n)))
                met = np.arange(part.start, part.stop)
                if self.keep is not None:
                    met = met[np.abs(r.at - at[part]) <= self.keep]
                if not len(met):
                    continue
                mine, other = np.full(len(met), r.id, dtype="int64"), ids[met]
                name = np.full(len(met), r.name, dtype=object)
                low = other < mine
                out.append((np.where(low, other, mine), np.where(low, mine, other), np.where(low, names[met], name), np.where(low, name, names[met])))
                size += len(met)
                if size >= CHUNK:
                    yield _frame(out, block)
                    out, size = [], 0
        if out:
            yield _frame(out, block)

    def close(self) -> None:
        pass


def met(stream: DataFrame, *, key: str, name: str, blocks: Column, at: Column | None = None, keep: float | None = None, late: float = 0.0, parts: int = 4) -> DataFrame:
    """(a, b, name_a, name_b), a < b: rows of the stream that share a block, each pair once. `at`
    is a row's time in seconds; rows more than `keep` apart do not meet, and state older than
    that (and `late`) is let go. Keys are distinct numbers."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    when = F.lit(0.0) if at is None else at.cast("double")
    rows = stream.select(F.col(key).cast("long").alias("id"), F.col(name).alias("name"), when.alias("at"), F.explode(F.array_distinct(blocks)).alias("block"))
    home = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).withColumn("home", F.col("part") == home)
    return rows.groupBy("block", "part").transformWithStateInPandas(Meetings(keep, late), PAIRS, "Append", "None")


def matched(stream: DataFrame, threshold: float, *, key: str, name: str, blocks: Callable[[Column], Column], **how) -> DataFrame:
    """(a, b, score): pairs whose names' Levenshtein similarity reaches the threshold. A pair
    that shares several blocks counts in the first of them."""
    pairs = met(stream, key=key, name=name, blocks=blocks(F.col(name)), **how)
    first = F.array_min(F.array_intersect(blocks(F.col("name_a")), blocks(F.col("name_b"))))
    score = S.levenshtein_similarity(F.col("name_a"), F.col("name_b"))
    return pairs.where(F.col("block") == first).select("a", "b", score.alias("score")).where(F.col("score") >= threshold)
