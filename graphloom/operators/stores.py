"""A property graph, vectors and policies as tables: every change gives a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(rows: DataFrame, changes: DataFrame, key: str, *, merge: bool = True) -> DataFrame:
    """rows with the changes put in by key: new keys are added; a known key's columns are
    replaced, or with `merge` only those that the change gives (is not null)."""
    fields = [c for c in rows.columns if c != key]
    old, new = rows.select(key, F.struct(*fields).alias("a")), changes.select(key, F.struct(*fields).alias("b"))
    both = old.join(new, key, "full_outer")

    def pick(c: str) -> Column:
        kept = F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if merge else F.col(f"b.{c}")
        return F.when(F.col("b").isNull(), F.col(f"a.{c}")).otherwise(kept).alias(c)

    return both.select(key, *[pick(c) for c in fields])


def detached(nodes: DataFrame, edges: DataFrame, gone: DataFrame, *, detach: bool = True) -> tuple[DataFrame, DataFrame]:
    """nodes (id) without those in gone (id), and the edges (src, dst) without theirs. Without
    `detach` a node that has edges stays."""
    if not detach:
        tied = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        gone = gone.join(tied, "id", "left_anti")
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), left.select(*edges.columns)


def applicable(policies: DataFrame, decisions: DataFrame) -> DataFrame:
    """decision, policy, version: the latest version of each policy of the decision's category
    whose scope meets the decision's entities (an empty scope meets all). policies: policy,
    version (ordered array<int>), category, scope (array)."""
    latest = policies.groupBy("policy").agg(F.max_by(F.struct("version", "category", "scope"), "version").alias("p")).select("policy", "p.*")
    met = decisions.join(latest, "category")
    return met.where((F.size("scope") == 0) | F.arrays_overlap("scope", "entities")).select("decision", "policy", F.array_join("version", ".").alias("version"))


def bumped(version: Column) -> Column:
    """The last part of a dotted version raised by one."""
    parts = F.split(version, r"\.")
    last = (F.element_at(parts, -1).cast("int") + 1).cast("string")
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(last)), ".")


def enforced(confidence: Column, outcome: Column, reasoning: Column, *, required: list[Column], min_confidence: float = 0.7, outcomes: tuple[str, ...] = ("approved", "rejected", "flagged"), longest: int = 1000) -> Column:
    """Names of the rules that a decision breaks, in order."""
    checks = [("min_confidence", confidence >= min_confidence), ("allowed_outcomes", outcome.isin(*outcomes)), ("required_fields", sum((c.isNull().cast("int") for c in required), F.lit(0)) == 0), ("max_reasoning_length", F.length(reasoning) <= longest)]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))


def merged_entities(mentions: DataFrame) -> DataFrame:
    """One row for each normalised name of mentions (name, type, description, source, at): the
    first type, the longest description, all sources."""
    norm = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "))
    return mentions.groupBy(norm.alias("entity")).agg(F.min_by("type", "at").alias("type"), F.max_by("description", F.struct(F.length("description"), F.col("description"))).alias("description"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
