"""Conflicting claims (entity, property, value, source, confidence, ts): finding and resolving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_conflicts(claims: DataFrame) -> DataFrame:
    """(entity, property) with two rows or more and more than one distinct value."""
    return claims.where("value is not null").groupBy("entity", "property").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"), F.avg("confidence").alias("mean_confidence")).where("n >= 2 AND distinct_values > 1")


def confidence() -> Column:
    return F.least(F.lit(1.0), F.col("mean_confidence") * (1 + F.col("distinct_values") / F.col("n")))


def severity(prop: Column, spread: Column) -> Column:
    return F.when(prop.isin("id", "name", "type", "founded_year", "revenue"), "critical").when(spread > 1000, "high").otherwise("medium")


def resolved(claims: DataFrame, strategy: str, credibility: DataFrame | None = None) -> DataFrame:
    """(entity, property, value, confidence) by voting, credibility_weighted, most_recent,
    first_seen or highest_confidence; ties go to what was seen first, then to the smaller value."""
    by = ["entity", "property"]
    if strategy in ("voting", "credibility_weighted"):
        weight = F.lit(1.0)
        if strategy == "credibility_weighted":
            claims = claims.join(credibility, "source", "left") if credibility is not None else claims.withColumn("credibility", F.lit(None).cast("double"))
            weight = F.coalesce("confidence", F.lit(0.5)) * F.coalesce("credibility", F.lit(0.5))
        votes = claims.groupBy(*by, "value").agg(F.sum(weight).alias("w"), F.min("pos").alias("first"))
        order = Window.partitionBy(*by).orderBy(F.desc(F.round("w", 9)), "first", "value")
        total = F.sum("w").over(Window.partitionBy(*by))
        return votes.withColumn("k", F.row_number().over(order)).withColumn("confidence", F.col("w") / total).where("k = 1").select(*by, "value", "confidence")
    pick, sure = {
        "most_recent": (F.max_by("value", F.struct("ts", -F.col("pos"))), F.lit(0.8)),
        "first_seen": (F.min_by("value", "pos"), F.lit(0.7)),
        "highest_confidence": (F.max_by("value", F.struct("confidence", -F.col("pos"))), F.max("confidence")),
    }[strategy]
    return claims.groupBy(*by).agg(pick.alias("value"), sure.alias("confidence"))


def counted(conflicts: DataFrame, dimensions: list[str]) -> DataFrame:
    """Numbers of conflicts by each dimension, in one pass of grouping sets."""
    sets = [[F.col(d)] for d in dimensions]
    out = conflicts.groupingSets(sets, *dimensions).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    pick, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, d in enumerate(dimensions):
        bit = ((1 << len(dimensions)) - 1) ^ (1 << (len(dimensions) - 1 - k))
        pick, value = F.when(F.col("g") == bit, F.lit(d)).otherwise(pick), F.when(F.col("g") == bit, F.col(d).cast("string")).otherwise(value)
    return out.select(pick.alias("dimension"), value.alias("value"), "n")


def types_in_conflict(rows: DataFrame, incompatible: list[tuple[str, str]]) -> DataFrame:
    """Entities that are of two types which exclude each other."""
    kinds = rows.groupBy("entity").agg(F.array_sort(F.collect_set("type")).alias("types"))  # types are few
    bad = F.lit(False)
    for a, b in incompatible:
        bad = bad | (F.array_contains("types", a) & F.array_contains("types", b))
    return kinds.where(bad).select("entity", F.array_join("types", ",").alias("types"))


#: Fixed values: (type, type that excludes it).
EXCLUSIVE = (("Person", "Organization"), ("Person", "Company"), ("Person", "Institution"), ("Organization", "Person"), ("Company", "Person"), ("Location", "Person"), ("Location", "Organization"))


def temporal(rows: DataFrame, key: str, properties: list[str]) -> DataFrame:
    """key, property, years, first, last: date texts of one entity with different years."""
    each = rows.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.regexp_extract(F.col(p), "(19|20)[0-9]{2}", 0).alias("y")) for p in properties])).alias("v"))
    return each.where("v.y <> ''").groupBy(key, "v.property").agg(F.countDistinct("v.y").alias("years"), F.min("v.y").alias("first"), F.max("v.y").alias("last")).where("years > 1")


def relations(rows: DataFrame, key: str, properties: list[str]) -> DataFrame:
    """key, property, n: properties of one relation with several values (as texts)."""
    each = rows.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("v")) for p in properties])).alias("x"))
    found = each.groupBy(key, "x.property").agg(F.countDistinct("x.v").alias("n")).where("n > 1")
    return found.withColumn("confidence", F.lit(0.8)).withColumn("severity", F.lit("medium"))


def logical(types: DataFrame) -> DataFrame:
    """id, a, b: entities (id, type) with two types of which a excludes b. An entity's types are
    gathered as a set, which is as small as the number of types."""
    held = types.groupBy("id").agg(F.collect_set("type").alias("held"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EXCLUSIVE])
    met = F.filter(pairs, lambda p: F.array_contains("held", p["a"]) & F.array_contains("held", p["b"]))
    return held.select("id", F.explode(met).alias("p")).select("id", "p.a", "p.b")


def guide(property_: Column, entity: Column, n: Column) -> Column:
    """What to do about a conflict, as text."""
    return F.format_string("Conflict of %s on %s: %d values. 1. Compare the sources. 2. Check the latest. 3. Record the choice.", property_, entity, n)
