"""Mentions of entities in texts, relations told by what stands between two of them, and a
graph that takes up texts batch by batch.

Defined cases: a null or empty text has no mentions; a mention is one place, so equal names at
two places can be related to each other; mentions that overlap or touch have nothing between
them and are not related; names that only white space is left of are dropped."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import strings as ST
from graphloom.functions import text as X
from graphloom.operators.loops import Saved

_SPACE = r"[ \t\n\x0B\f\r]+"
_ENDS = f"^{_SPACE}|{_SPACE}$"


def found(text: Column, patterns: dict[str, str], reach: int = 100) -> Column:
    """array<struct<start, stop, label, entity, after>> of all patterns' matches, in order; `after`
    holds the `reach` characters that follow."""

    def of(label: str, pattern: str) -> Column:
        return F.transform(X.places(text, pattern, reach), lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.lit(label).alias("label"), m["entity"].alias("entity"), m["after"].alias("after")))

    return F.array_sort(F.concat(*[of(label, p) for label, p in patterns.items()]))


def mentions(docs: DataFrame, *, key: str, text: str = "text", patterns: dict[str, str], reach: int = 100) -> DataFrame:
    """key, start, stop, label, entity, after: the mentions of each text."""
    return docs.select(key, F.explode(found(F.col(text), patterns, reach)).alias("m")).select(key, "m.*")


def near(rows: DataFrame, *, key: str, reach: int = 100) -> DataFrame:
    """key, l, r, between: two mentions of a text (made with the same reach) of which r starts at
    most `reach` characters after l stops. A text is cut into bins of `reach` characters, and a
    mention meets those of two bins, so pairs are linear in a text's length."""
    fields = ["start", "stop", "label", "entity"]
    first = F.floor(F.col("stop") / reach)
    left = rows.select(key, F.struct(*fields, "after").alias("l"), F.explode(F.array(first, first + 1)).alias("_bin"))
    right = rows.select(key, F.struct(*fields).alias("r"), F.floor(F.col("start") / reach).alias("_bin"))
    gap = F.col("r.start") - F.col("l.stop")
    met = left.join(right, [key, "_bin"]).where(gap.between(0, reach))
    between = F.regexp_replace(F.left("l.after", gap), _ENDS, "")
    return met.select(key, F.col("l").dropFields("after").alias("l"), "r", between.alias("between")).where("between <> ''")


def _by_words(between: Column, types: Sequence[str]) -> Column:
    def of(b: Column) -> Column:
        def score(name: str) -> Column:
            return F.when(F.contains(b["low"], F.lit(name.lower())), 1.0).otherwise(ST.jaccard(b["words"], ST.words(F.lit(name))))

        scores = F.array(*[F.struct(score(name).alias("score"), F.lit(-k).alias("k"), F.lit(name).alias("relation")) for k, name in enumerate(types)])
        return F.array_max(scores)

    # an array of one binds lower case and words to a name, so that they are computed once
    best = F.transform(F.array(F.struct(F.lower(between).alias("low"), ST.words(between).alias("words"))), of)
    return F.transform(best, lambda x: F.struct(x["relation"].alias("relation"), x["score"].alias("score")))


def _by_sequence(types: Sequence[str], threshold: float):
    names = [(t, t.lower()) for t in types]

    @F.pandas_udf("struct<relation:string,score:double>")
    def best(between: pd.Series) -> pd.DataFrame:
        def of(text: str) -> tuple[str | None, float]:
            low, top, matcher = text.lower(), (None, 0.0), None
            for name, lowered in names:
                if lowered in low:
                    score = 1.0
                elif 2.0 * min(len(lowered), len(low)) / (len(lowered) + len(low)) < max(threshold, top[1]):
                    continue  # too different in length, whatever they share
                else:
                    matcher = matcher or SequenceMatcher(None, "", low)
                    matcher.set_seq1(lowered)
                    score = matcher.ratio()
                if score > top[1]:
                    top = (name, score)
            return top

        return pd.DataFrame([of(t) for t in between], columns=["relation", "score"])

    return best


def related_by_context(rows: DataFrame, types: Sequence[str], *, key: str, reach: int = 100, threshold: float = 0.6, measure: str = "sequence") -> DataFrame:
    """key, subject, relation, object, score, between, subject_start, object_start: pairs of
    mentions whose words between are most like a relation type (the first of equal ones), from
    the threshold on. A type that stands between them word for word scores 1; else `sequence`
    takes the matching blocks' share of all characters, `words` the Jaccard of distinct words.
    The later mention is the subject as well where both together span `reach` at most."""
    if measure not in ("sequence", "words"):
        raise ValueError(f"unknown measure {measure}")
    if not types:
        raise ValueError("no relation types")
    pairs = near(rows, key=key, reach=reach)
    best = _by_words(F.col("between"), types) if measure == "words" else F.array(_by_sequence(types, threshold)("between"))
    # exploded, so that a score is not computed again for the filter
    scored = pairs.select("*", F.explode(F.filter(best, lambda b: (b["score"] >= threshold) & (b["score"] > 0))).alias("best"))
    forth = F.struct(F.col("l").alias("s"), F.col("r").alias("o"))
    back = F.struct(F.col("r").alias("s"), F.col("l").alias("o"))
    ways = F.when(F.col("r.stop") - F.col("l.start") <= reach, F.array(forth, back)).otherwise(F.array(forth))
    out = scored.select(key, "best", "between", F.explode(ways).alias("w"))
    return out.select(key, F.col("w.s.entity").alias("subject"), "best.relation", F.col("w.o.entity").alias("object"), "best.score", "between", F.col("w.s.start").alias("subject_start"), F.col("w.o.start").alias("object_start"))


@dataclass(frozen=True)
class TextGraph:
    """entities: entity (normalised name), name, type, description, since; relations: src, dst,
    description, since; entity_sources: entity, source; relation_sources: src, dst, source. Sources
    are rows of their own, as an entity may be in every chunk."""

    entities: DataFrame
    relations: DataFrame
    entity_sources: DataFrame
    relation_sources: DataFrame


def normal_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, _SPACE, " ")))


def extracted(docs: DataFrame, *, key: str, text: str = "text", patterns: dict[str, str], size: int = 1200, reach: int = 100) -> DataFrame:
    """source (key#n), key, n, entities (array of name, type, description), relations (array of
    source, target, description) of each chunk of each text: names are told by patterns, a name
    and the next one, `reach` characters away at most, are related by what is between them. Any
    other extraction that gives these columns does as well."""
    chunks = docs.select(key, F.posexplode(X.paragraph_chunks(F.col(text), size)).alias("n", "chunk"))
    ms = chunks.select(key, "n", found(F.col("chunk"), patterns, reach).alias("m"))
    names = F.transform("m", lambda x: F.struct(x["entity"].alias("name"), x["label"].alias("type"), F.regexp_replace(x["after"], _ENDS, "").alias("description")))

    def with_next(x: Column, k: Column) -> Column:
        y = F.get("m", k + 1)
        gap = y["start"] - x["stop"]
        return F.when(gap.between(0, reach), F.struct(x["entity"].alias("source"), y["entity"].alias("target"), F.regexp_replace(F.left(x["after"], gap), _ENDS, "").alias("description")))

    return ms.select(F.concat_ws("#", F.col(key).cast("string"), F.col("n").cast("string")).alias("source"), key, "n", names.alias("entities"), F.array_compact(F.transform("m", with_next)).alias("relations"))


def taken_up(chunks: DataFrame, *, key: str, known: TextGraph | None = None, batch: int = 1) -> TextGraph:
    """The known graph with what `extracted` chunks tell. By normalised name the first name and
    type count and the longest description (the first of equal ones); sources are united. A
    relation needs two different entities, each known by the end of its chunk. Batches count up
    from 1, chunks are in order of key and n."""
    store = Saved(chunks.sparkSession, "mentions")
    chunks = store.save(chunks)  # every table below reads them
    # places are (batch, key, n, place in the chunk); known rows keep theirs
    names = chunks.select("source", key, "n", F.posexplode("entities").alias("k", "e"))
    at = F.struct(F.lit(batch).alias("batch"), F.col(key).alias("key"), "n", "k")
    new = names.select(normal_name(F.col("e.name")).alias("entity"), F.trim("e.name").alias("name"), F.lower(F.trim(F.coalesce(F.nullif("e.type", F.lit("")), F.lit("concept")))).alias("type"), F.trim(F.coalesce("e.description", F.lit(""))).alias("description"), at.alias("since"), "source").where("entity <> ''")
    told = chunks.select("source", key, "n", F.posexplode("relations").alias("k", "e"))
    links = told.select(normal_name(F.col("e.source")).alias("src"), normal_name(F.col("e.target")).alias("dst"), F.trim(F.coalesce("e.description", F.lit(""))).alias("description"), at.alias("since"), "source").where("src <> dst")

    rows = new.drop("source")
    if known:
        rows = rows.unionByName(known.entities)
    entities = store.save(_merged(rows, ["entity"], ["name", "type"]))
    since = entities.select("entity", "since")
    for end in ("src", "dst"):
        first = since.select(F.col("entity").alias(end), F.struct("since.batch", "since.key", "since.n").alias("seen"))
        links = links.join(first, end).where(F.col("seen") <= F.struct("since.batch", "since.key", "since.n")).drop("seen")
    rows = links.drop("source")
    if known:
        rows = rows.unionByName(known.relations)
    relations = _merged(rows, ["src", "dst"], [])
    of_entities, of_relations = new.select("entity", "source"), links.select("src", "dst", "source")
    if known:
        of_entities, of_relations = of_entities.union(known.entity_sources), of_relations.union(known.relation_sources)
    return TextGraph(entities, relations, of_entities.distinct(), of_relations.distinct())


def _merged(rows: DataFrame, by: list[str], first: list[str]) -> DataFrame:
    longest = F.min_by("description", F.struct((-F.length("description")).alias("n"), F.col("since")))
    return rows.groupBy(*by).agg(*[F.min_by(c, "since").alias(c) for c in first], longest.alias("description"), F.min("since").alias("since"))
