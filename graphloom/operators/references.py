"""Pronouns and what they stand for, and the chains of mentions of one entity, in whole texts.

A pronoun stands for the nearest mention before it whose label suits it, else for the nearest
mention before it at all, else for nothing. A mention is before a pronoun if it ends earlier
than the pronoun starts, with a character between them at least.

Defined cases: a text without pronouns or mentions has no rows; a word that is a pronoun is
no name, even if the names' pattern fits it; of mentions with one end the one that starts first
counts, of these the smaller label; case is no matter for pronouns and chains; labels and
texts with any other columns take no harm, as only the key and the text are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import mentions as M

# Labels that each pronoun can stand for.
_THING = ("ORG", "GPE", "LOC", "PRODUCT", "EVENT", "FAC", "WORK_OF_ART", "LAW", "LANGUAGE", "DATE", "TIME", "PERCENT", "MONEY", "QUANTITY", "ORDINAL", "CARDINAL")
_MANY = ("ORG", "GPE", "PERSON", "NORP")
SUITS = {"he": ("PERSON",), "him": ("PERSON",), "his": ("PERSON",), "she": ("PERSON",), "her": ("PERSON",), "it": _THING, "its": _THING, "they": _MANY, "them": _MANY, "their": _MANY}

PRONOUN = "pronoun"


def pronoun_pattern(pronouns: dict[str, tuple[str, ...]]) -> str:
    """A pattern of these words, whatever their case, with no letter at either side."""
    return r"(?i)(?<!\p{L})(?:" + "|".join(sorted(pronouns)) + r")(?!\p{L})"


def placed(docs: DataFrame, *, key: str, text: str = "text", patterns: dict[str, str], suits: dict[str, tuple[str, ...]] = SUITS) -> DataFrame:
    """key, start, stop, label, entity: the mentions that the patterns (label to pattern) find,
    and the pronouns, in one pass over each text."""
    rows = M.mentions(docs, key=key, text=text, patterns=patterns | {PRONOUN: pronoun_pattern(suits)}, reach=1).drop("after")
    return rows.where((F.col("label") == PRONOUN) | ~F.lower("entity").isin(*suits))


def resolved(rows: DataFrame, *, key: str, suits: dict[str, tuple[str, ...]] = SUITS) -> DataFrame:
    """rows (as `placed` gives them) with `antecedent`, struct<entity, start, stop, label>: what
    each pronoun stands for; null for other mentions."""
    pronoun = F.col("label") == PRONOUN
    # a mention takes its place at its end, after a pronoun that starts there
    at = F.when(pronoun, F.col("start")).otherwise(F.col("stop"))
    before = Window.partitionBy(key).orderBy("_at", F.desc("_pronoun"), F.desc("start"), F.desc("label")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mention = F.struct("entity", "start", "stop", "label")

    def nearest(fits: Column) -> Column:
        return F.last(F.when(~F.col("_pronoun") & fits, mention), ignorenulls=True).over(before)

    kinds = sorted(set(suits.values()))
    seen = rows.withColumns({"_at": at, "_pronoun": pronoun})
    seen = seen.withColumns({"_any": nearest(F.lit(True))} | {f"_{k}": nearest(F.col("label").isin(*labels)) for k, labels in enumerate(kinds)})
    best = F.lit(None)
    word = F.lower("entity")
    for k, labels in enumerate(kinds):
        best = F.when(word.isin(*[p for p, x in suits.items() if x == labels]), F.coalesce(f"_{k}", "_any")).otherwise(best)
    return seen.select(*rows.columns, F.when(pronoun, best).alias("antecedent"))


def chains(rows: DataFrame, *, key: str) -> DataFrame:
    """key, entity (in lower case), representative (its first mention), label, first, last,
    mentions, pronouns: of each text the entities that more than one mention stands for,
    pronouns included. Takes rows as `resolved` gives them."""
    pronoun = F.col("label") == PRONOUN
    who = F.when(pronoun, F.col("antecedent.entity")).otherwise(F.col("entity"))
    each = rows.where(who.isNotNull()).withColumns({"_who": F.lower(who), "_name": F.when(~pronoun, F.struct("start", "label", "entity"))})
    total = each.groupBy(key, "_who").agg(F.min("_name").alias("n"), F.max("stop").alias("last"), F.count("*").alias("mentions"), F.count_if(F.col("_name").isNull()).alias("pronouns"))
    return total.where("mentions > 1").select(key, F.col("_who").alias("entity"), F.col("n.entity").alias("representative"), F.col("n.label").alias("label"), F.col("n.start").alias("first"), "last", "mentions", "pronouns")
