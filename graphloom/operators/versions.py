"""Snapshots, differences, lineage, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.loops import Saved, reachable


def checksum(*columns: str) -> Column:
    """SHA-256 of a row's canonical JSON (columns in order of name)."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def compared(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields): added, removed, or modified with the names of what differs."""
    a = old.select(F.col(key).alias("k"), F.struct(*fields).alias("a"))
    b = new.select(F.col(key).alias("k"), F.struct(*fields).alias("b"))
    both = a.join(b, "k", "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(differ) > 0, "modified")
    return both.select(F.col("k").alias(key), change.alias("change"), F.when(change == "modified", F.array_join(differ, ",")).otherwise("").alias("fields")).where("change is not null")


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows only in new ('added') and only in old ('removed'), nulls equal."""
    on = new.columns
    a = new.exceptAll(old).distinct().withColumn("change", F.lit("added"))
    b = old.select(*on).exceptAll(new).distinct().withColumn("change", F.lit("removed"))
    return a.union(b)


LIST = 1000  # ancestors that a row carries, about


def lineage(edges: DataFrame, starts: DataFrame, sources: DataFrame) -> DataFrame:
    """Of each start: number of ancestors, distinct sources, first and last time seen.
    edges: src (derived) -> dst (parent); sources: node, source, first_seen, last_seen.

    Where many starts share few parents, ways are followed from the parents alone, and a start
    takes up the lists of its parents, which meet in the start's own task."""
    saved = Saved(edges.sparkSession, "lineage")
    starts = saved.save(starts.select("start").distinct())
    # what starts at a node that is nobody's parent is never met on a way from a parent
    tops = starts.join(edges.select(F.col("dst").alias("start")).distinct(), "start", "left_anti").select(F.col("start").alias("node"), F.lit(True).alias("top"))
    marked = starts.join(tops, F.col("start") == F.col("node"), "left").select("start", F.coalesce("top", F.lit(False)).alias("top"))
    links = saved.save(edges.select("src", "dst").join(marked, F.col("src") == F.col("start"), "left").select("src", "dst", "start", "top"))
    first = links.where("start is not null").select("start", F.col("dst").alias("parent"))
    parents = saved.save(first.select("parent").distinct())
    seen = sources.select("node", F.struct("node", "source", "first_seen", "last_seen").alias("x"))
    if 2 * parents.count() > starts.count():
        found = reachable(edges, starts).join(seen, "node").select("start", "x")
    else:
        rest = saved.save(links.where("top is null or not top").select("src", "dst").distinct())
        upper = saved.save(reachable(rest, parents.select(F.col("parent").alias("start"))).join(seen, "node").select(F.col("start").alias("parent"), "x"))
        size = upper.groupBy("parent").agg(F.ceil(F.count("*") / LIST).alias("parts"))
        lists = upper.join(size, "parent").groupBy("parent", F.pmod(F.hash("x.node"), "parts").alias("part")).agg(F.collect_list("x").alias("xs"))
        own = starts.join(seen, F.col("start") == F.col("node")).select("start", F.array("x").alias("xs"))
        found = first.join(lists, "parent").select("start", "xs").union(own).repartition("start").select("start", F.explode("xs").alias("x"))
    each = found.groupBy("start", F.col("x.node").alias("node"), F.col("x.source").alias("source")).agg(F.min("x.first_seen").alias("first_seen"), F.max("x.last_seen").alias("last_seen"))
    return each.groupBy("start").agg((F.countDistinct("node") - 1).alias("ancestors"), F.countDistinct("source").alias("sources"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def pruned(versions: DataFrame, key: str, order: Column, keep: int) -> DataFrame:
    return versions.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where(F.col("_k") <= keep).drop("_k")


#: Changes of these fields bound what may be said, or how classes hang together.
RESTRICTIVE = ("domain", "range", "cardinality", "max_cardinality")
STRUCTURAL = ("subclasses", "superclasses", "equivalent_to", "disjoint_with")


def impact(change: Column, fields: Column) -> Column:
    """breaking, potentially_breaking or safe, of a change (added, removed, modified) with the
    names of the fields that differ."""
    def any_of(names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(fields, F.array(*[F.lit(n) for n in names]))

    return F.when(change == "removed", "breaking").when(change == "added", "safe").when(any_of(RESTRICTIVE), "breaking").when(any_of(STRUCTURAL), "potentially_breaking").otherwise("safe")


def chained(rows: DataFrame, key: str, order: Column, content: Column) -> DataFrame:
    """key, n, head: the head of a chain of SHA-256 hashes over a key's rows in order, each over
    the hash before and the row's content. A key's rows are one record's own history."""
    entries = F.array_sort(F.collect_list(F.struct(order.alias("at"), content.alias("c"))))
    head = F.aggregate("entries", F.lit(""), lambda h, e: F.sha2(F.concat(h, F.lit("|"), e["c"]), 256))
    return rows.groupBy(key).agg(entries.alias("entries")).select(key, F.size("entries").alias("n"), head.alias("head"))


def translated(values: DataFrame, axioms: list[tuple[str, str, float, float]]) -> DataFrame:
    """values (value, ...) carried through layers: axioms are (from, to, coefficient, confidence)
    in order. Adds layer, result and the least confidence of the way."""
    result, sure = F.col("value"), 1.0
    for _, _, coefficient, confidence in axioms:
        result, sure = result * coefficient, min(sure, confidence)
    for (_, a, *_), (b, *_) in zip(axioms, axioms[1:], strict=False):
        if a != b:
            raise ValueError(f"the chain breaks between {a} and {b}")
    return values.select("*", F.lit(axioms[-1][1]).alias("layer"), result.alias("result"), F.lit(sure).alias("confidence"))
