"""Duplicate entities: blocking, scores, groups, merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import strings as S
from graphloom.operators.loops import Saved, components


BLOCK = 1000  # rows of a block that one task pairs with the others


def candidates(rows: DataFrame, *, key: str, name: str, keys: Column) -> DataFrame:
    """Pairs (a < b) that share a block key, each once; names come along.

    All pairs of a block are wanted, so they grow with the square of its size: a large block's
    one side is dealt to parts of BLOCK, and the other is sent to each of them. Where that is
    too many, `neighbours` pairs each row with a few others only."""
    blocks = rows.select(F.col(key).alias("id"), F.col(name).alias("name"), F.explode(keys).alias("block"))
    parts = blocks.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").select("block", "parts")
    blocks = Saved(rows.sparkSession, "blocks").save(blocks.join(parts, "block"))
    a = blocks.select(F.col("id").alias("a"), F.col("name").alias("name_a"), "block", F.pmod(F.hash("id"), F.col("parts")).alias("part"))
    b = blocks.select(F.col("id").alias("b"), F.col("name").alias("name_b"), "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["block", "part"]).where("a < b").drop("block", "part").distinct()


def scored(pairs: DataFrame, method: str = "levenshtein") -> DataFrame:
    a, b = F.col("name_a"), F.col("name_b")
    score = {"levenshtein": lambda: S.levenshtein_similarity(a, b), "bigram": lambda: S.jaccard(S.bigrams(a), S.bigrams(b)), "characters": lambda: S.jaccard(S.characters(a), S.characters(b)), "words": lambda: S.jaccard(S.words(a), S.words(b))}[method]()
    return pairs.withColumn("score", score)


def confidence(score: Column, same_name: Column, equal_properties: Column, same_type: Column) -> Column:
    return F.least(F.lit(1.0), score + 0.1 * same_name.cast("int") + 0.05 * equal_properties + 0.05 * same_type.cast("int"))


def groups(pairs: DataFrame) -> DataFrame:
    """(node, component) of linked pairs (a, b)."""
    return components(pairs)


def group_confidence(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Mean score of a group's links * (0.8 + 0.2 * min(1, size / 5))."""
    mean = pairs.join(grouped, F.col("a") == F.col("node")).groupBy("component").agg(F.avg("score").alias("mean"))
    size = grouped.groupBy("component").agg(F.count("*").alias("size"))
    return mean.join(size, "component").select("component", "size", (F.col("mean") * (0.8 + 0.2 * F.least(F.lit(1.0), F.col("size") / 5))).alias("confidence"))


def merged(rows: DataFrame, *, by: list[str], order: list[Column], properties: list[str], strategy: str = "keep_first") -> DataFrame:
    """One row of each group. keep_first / keep_last: first or last non-null value by order;
    keep_most_complete: of the row with most non-null properties; longest: longest value."""
    rank = F.struct(*order)
    filled = sum((F.col(p).isNotNull().cast("int") for p in properties), F.lit(0))
    def pick(p: str) -> Column:
        value = F.col(p)
        if strategy == "keep_first":
            return F.min_by(value, F.struct(value.isNull(), rank))
        if strategy == "keep_last":
            return F.max_by(value, F.struct(value.isNotNull(), rank))
        if strategy == "keep_most_complete":
            return F.min_by(value, F.struct(-filled, rank))
        if strategy == "longest":
            return F.min_by(value, F.struct(-F.coalesce(F.length(value.cast("string")), F.lit(-1)), rank))
        raise ValueError(f"unknown strategy {strategy}")

    return rows.groupBy(*by).agg(F.count("*").alias("merged"), *[pick(p).alias(p) for p in properties])


def neighbours(rows: DataFrame, *, key: str, block: Column, order: list[str], reach: int) -> DataFrame:
    """Sorted neighbourhood: each row (columns x_a) with the `reach` rows after it in its block
    (x_b), so the number of pairs is linear however large a block is; a, b are the keys."""
    others = [c for c in rows.columns if c != key]
    window = Window.partitionBy("_block").orderBy(*order)
    after = [F.lead(F.struct(key, *others), k).over(window).alias(f"_{k}") for k in range(1, reach + 1)]
    ahead = rows.withColumn("_block", block).select(F.struct(key, *others).alias("x"), *after)
    pairs = ahead.select("x", F.explode(F.array_compact(F.array(*[f"_{k}" for k in range(1, reach + 1)]))).alias("y"))
    return pairs.select(F.col(f"x.{key}").alias("a"), *[F.col(f"x.{c}").alias(f"{c}_a") for c in others], F.col(f"y.{key}").alias("b"), *[F.col(f"y.{c}").alias(f"{c}_b") for c in others])


def incremental(new: DataFrame, known: DataFrame, threshold: float, *, key: str, name: str, blocks: Callable[[Column], Column]) -> DataFrame:
    """new's rows with `match`, the key of the known row whose name is most alike, and `score`;
    null where none reaches the threshold. Only names that share a block are compared, each
    distinct pair once; of equal scores, and of rows of one name, the smallest key counts."""
    a = new.select(F.col(name).alias("name")).distinct().select("name", F.explode(blocks(F.col("name"))).alias("block"))
    b = known.groupBy(F.col(name).alias("other")).agg(F.min(key).alias("match")).select("other", "match", F.explode(blocks(F.col("other"))).alias("block"))
    pairs = a.join(b, "block").select("name", "other", "match").distinct()
    scored_ = pairs.withColumn("score", S.levenshtein_similarity(F.col("name"), F.col("other"))).where(F.col("score") >= threshold)
    best = scored_.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("less"), "match")).alias("m"))
    return new.join(best.select(F.col("name").alias(name), F.col("m.match").alias("match"), (-F.col("m.less")).alias("score")), name, "left").select(*new.columns, "match", "score")


def alike_relations(relations: DataFrame, *, threshold: float, method: str = "jaro_winkler") -> DataFrame:
    """relations: subject, predicate, object (distinct). Pairs of one subject: 0.6 of the
    predicates' similarity and 0.4 of the objects' reach the threshold."""
    a = relations.select("subject", F.col("predicate").alias("pa"), F.col("object").alias("oa"))
    b = relations.select("subject", F.col("predicate").alias("pb"), F.col("object").alias("ob"))
    pairs = a.join(b, "subject").where(F.struct("pa", "oa") < F.struct("pb", "ob"))
    score = 0.6 * S.string_similarity(F.col("pa"), F.col("pb"), method) + 0.4 * S.string_similarity(F.col("oa"), F.col("ob"), method)
    return pairs.withColumn("score", score).where(F.col("score") >= threshold)


def linked_names(names: DataFrame, *, name: str, words: str) -> DataFrame:
    """name, other, score: distinct names that share a word, by the Jaccard similarity of their
    words, counted from an inverted index."""
    sized = names.select(F.col(name).alias("name"), F.array_distinct(words).alias("w"))
    each = sized.select("name", F.size("w").alias("n"), F.explode("w").alias("x"))
    both = each.join(each.select(F.col("name").alias("other"), F.col("n").alias("m"), "x"), "x").where("name < other")
    return both.groupBy("name", "other", "n", "m").agg(F.count("*").alias("same")).select("name", "other", (F.col("same") / (F.col("n") + F.col("m") - F.col("same"))).alias("score"))


def resolved(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """rows with `canonical`: what the alias table (alias in lower case, canonical) says, else the name."""
    known = rows.join(aliases, F.lower(F.trim(name)) == F.col("alias"), "left")
    return known.select(*rows.columns, F.coalesce("canonical", name).alias("canonical"))
