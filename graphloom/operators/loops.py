"""Loops over DataFrames: saved rounds, connected components, reachability."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}
#: Open scratch scopes, each the folders that were made in it.
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset,
    a local session (a test) gets one temporary folder for the application; on a cluster it
    is an error, as every executor would write to a disk of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _own_folder[context.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted at the end: write what is wanted of them before."""
    _scopes.append([])
    try:
        yield
    finally:
        for root in _scopes.pop():
            _delete(spark, root)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted with its end, not when the driver comes to
    collect garbage: a loop's disk is that of a round. Where a persisted table loses a part that
    was computed from them, Spark runs their stage again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Saved:
    """Tables written to the shared folder and read again: each cuts the lineage, so
    a lost executor never makes a loop start over."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        if _scopes:
            _scopes[-1].append(self.root)

    def save(self, df: DataFrame) -> DataFrame:
        with _own_shuffles(self.spark):
            df.write.parquet(self._next())
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.count - 1}")

    def signed(self, df: DataFrame, *columns: str) -> tuple[DataFrame, tuple]:
        """The saved table, and its number of rows with a sum of their hashes, both taken
        while it is written."""
        seen = Observation()
        total = F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0))
        table = self.save(df.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("total")))
        return table, (seen.get["n"], seen.get["total"])

    def all(self, first: int = 0) -> DataFrame:
        """The rows of all tables from number `first` on, which have one schema."""
        paths = [f"{self.root}/{k}" for k in range(first, self.count)]
        return self.spark.read.schema(self.spark.read.parquet(paths[0]).schema).parquet(*paths)

    def drop_before(self, keep: int = 1) -> None:
        """Delete all but the last `keep` tables."""
        for k in range(max(0, self.count - keep - 2), self.count - keep):
            _delete(self.spark, f"{self.root}/{k}")

    def drop(self, first: int, end: int) -> None:
        """Delete the tables from number `first` to before `end`."""
        for k in range(first, end):
            _delete(self.spark, f"{self.root}/{k}")

    def drop_all(self) -> None:
        """Delete all tables: nothing that is still to be computed may read them."""
        _delete(self.spark, self.root)

    def _next(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count - 1}"


TASK_ROWS = 1_000_000  # rows that a task sorts, about


def ranked(rows: DataFrame, group: str, *order: Column | str, name: str = "rank", n: int | None = None) -> DataFrame:
    """rows with their number (from 1) in the order of their group, however large a group is:
    one range exchange by group and order, a number in each task, and an offset for each task
    and group. Rows that are equal in group and order get neighbouring numbers in any order.
    `n` is the number of rows, if that is known and the rows are cheap to compute again."""
    saved = Saved(rows.sparkSession, "ranked")
    if n is None:
        rows = saved.save(rows)
        n = rows.count()
    tasks = max(1, -(-n // TASK_ROWS))
    dealt = rows.repartitionByRange(tasks, group, *order).sortWithinPartitions(group, *order)
    dealt = saved.save(dealt.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    counted = dealt.groupBy(F.col(group).alias("_group"), task.alias("_task")).agg(F.count("*").alias("n"), F.min("_at").alias("least"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = saved.save(counted.select("_group", "_task", (below - F.col("least") + 1).alias("_offset")))
    placed = dealt.join(offset, F.col(group).eqNullSafe(F.col("_group")) & (task == F.col("_task")))
    return placed.select(*rows.columns, (F.col("_at") + F.col("_offset")).alias(name))


def components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node of its component.

    Alternating large-star and small-star steps; each halves the depth of the trees, and
    every step is a partial aggregate and a join, so no node's neighbours are gathered.
    The test for an end is taken from the round's own write. Self-loops and repeated edges
    are allowed."""
    saved = Saved(edges.sparkSession, "components")
    now, sign = saved.signed(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u != v").distinct(), "v", "u")
    before = None
    while sign[0] and sign != before:
        before = sign
        now, sign = saved.signed(_small_star(_large_star(now)), "v", "u")
        saved.drop_before()
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # v > u in every edge, so a node's smaller neighbours are its u
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    hung = edges.join(least, "v").where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return least.select("v", F.col("m").alias("u")).union(hung).distinct()


def reachable(edges: DataFrame, starts: DataFrame, *, max_hops: int | None = None) -> DataFrame:
    """(start, node, hops): every node on a directed path from a start, with the fewest hops.

    edges: src, dst; starts: start (a node, or several). Runs until nothing new is found or
    max_hops; a round joins only the last frontier, and writes only what it has found."""
    saved = Saved(edges.sparkSession, "reach")
    links = edges.select("src", "dst").distinct()
    frontier = saved.save(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct())
    hop, n = 0, 1
    while n and (max_hops is None or hop < max_hops):
        hop += 1
        fresh = frontier.select("start", "node").join(links, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        fresh = fresh.join(saved.all().select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop))
        frontier, (n, _) = saved.signed(fresh, "start", "node")
    return saved.all()
