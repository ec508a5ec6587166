"""Classes, properties and constraints inferred from entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classes(entities: DataFrame, properties: list[str], *, min_count: int = 2, share: float = 0.5) -> DataFrame:
    """(class, n, property): classes with min_count entities, and the properties that `share`
    of them have."""
    have = [F.struct(F.lit(p).alias("p"), F.col(p).isNotNull().cast("int").alias("has")) for p in properties]
    counts = entities.select(F.col("type").alias("class"), F.explode(F.array(*have)).alias("x")).groupBy("class", F.col("x.p").alias("property")).agg(F.count("*").alias("n"), F.sum("x.has").alias("has"))
    return counts.where((F.col("n") >= min_count) & (F.col("has") >= share * F.col("n"))).select("class", "n", "property")


def object_properties(relations: DataFrame, *, min_count: int = 2) -> DataFrame:
    """relations: type, source_type, target_type -> property, n, domains, ranges."""
    return relations.groupBy(F.col("type").alias("property")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("domains"), F.array_join(F.array_sort(F.collect_set("target_type")), ",").alias("ranges")).where(F.col("n") >= min_count)


def data_type(value: Column) -> Column:
    """Narrowest of boolean, integer, decimal, dateTime, string that a text is."""
    return (
        F.when(value.rlike(r"^(true|false)$"), "boolean").when(value.rlike(r"^[+-]?[0-9]+$"), "integer").when(value.rlike(r"^[+-]?[0-9]*\.[0-9]+$"), "decimal")
        .when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T].*)?$"), "dateTime").otherwise("string")
    )


def data_properties(entities: DataFrame, properties: list[str]) -> DataFrame:
    """(property, type, n): the type that all values fit; integer and decimal widen to
    decimal, anything else mixed to string."""
    each = entities.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(p).cast("string").alias("v")) for p in properties])).alias("x")).where("x.v is not null")
    kinds = each.groupBy(F.col("x.p").alias("property"), data_type(F.col("x.v")).alias("t")).agg(F.count("*").alias("n"))
    whole = kinds.groupBy("property").agg(F.array_sort(F.collect_set("t")).alias("ts"), F.sum("n").alias("n"))
    wide = F.when(F.size("ts") == 1, F.col("ts")[0]).when(F.size(F.array_except("ts", F.array(F.lit("integer"), F.lit("decimal")))) == 0, "decimal").otherwise("string")
    return whole.select("property", wide.alias("type"), "n")


def cardinality(values: DataFrame, *, low: int = 0, high: int | None = None) -> DataFrame:
    """Subjects of (subject, value) whose number of values is outside [low, high]."""
    counts = values.groupBy("subject").agg(F.count("value").alias("n"))
    bad = F.col("n") < low
    return counts.where(bad if high is None else bad | (F.col("n") > high))


def coverage(needed: DataFrame, known: DataFrame) -> DataFrame:
    """One row: terms that are needed (term), how many of them are known, the share, and the
    gaps in order. Both are vocabularies, small beside the data."""
    both = needed.select("term").distinct().join(known.select("term").distinct().withColumn("has", F.lit(1)), "term", "left")
    return both.agg(F.count("*").alias("terms"), F.count("has").alias("answerable"), (F.count("has") / F.count("*")).alias("coverage"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("has").isNull(), F.col("term")))), ",").alias("gaps"))


def granularity(instances: DataFrame) -> DataFrame:
    """class, n, share, level: instances (class) of each class, and whether it is a coarse one
    (over half of all), a fine one (under one in twenty) or a balanced one."""
    n = instances.groupBy("class").agg(F.count("*").alias("n"))
    share = F.col("n") / n.agg(F.sum("n")).scalar()
    return n.withColumn("share", share).withColumn("level", F.when(F.col("share") > 0.5, "coarse").when(F.col("share") < 0.05, "fine").otherwise("balanced"))


def class_iri(name: Column, base: str) -> Column:
    return F.concat(F.lit(base), F.replace(F.initcap(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", " "))), F.lit(" "), F.lit("")))


def valid_iri(iri: Column) -> Column:
    return F.coalesce(iri.rlike(r"^[a-z][a-z0-9+.-]*:[^ <>]+$"), F.lit(False))


def alignment_scores(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: terms of either vocabulary, shared ones (by lower-cased name), Jaccard overlap,
    and the share of the left that the right covers."""
    a, b = (x.select(F.lower(F.trim("term")).alias("t")).distinct() for x in (left, right))
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "t", "full_outer")
    shared = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1))
    return both.agg(F.count("a").alias("left_terms"), F.count("b").alias("right_terms"), shared.alias("shared"), (shared / F.count("*")).alias("overlap"), (shared / F.count("a")).alias("covered"))


def shape_violations(rows: DataFrame, key: str, shapes: list[dict]) -> DataFrame:
    """key, path, constraint, value: what of a data graph breaks its shapes. A shape has path and
    any of min_count, datatype, pattern, in, min, max."""
    found = []
    for shape in shapes:
        c = F.col(shape["path"])
        text = c.cast("string")
        tests = {
            "minCount": c.isNull() if shape.get("min_count") else None,
            "datatype": c.isNotNull() & text.try_cast(shape["datatype"]).isNull() if "datatype" in shape else None,
            "pattern": ~text.rlike(shape["pattern"]) if "pattern" in shape else None,
            "in": ~c.isin(shape["in"]) if "in" in shape else None,
            "minInclusive": c < shape["min"] if "min" in shape else None,
            "maxInclusive": c > shape["max"] if "max" in shape else None,
        }
        found += [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(shape["path"]).alias("path"), F.lit(name).alias("constraint"), text.alias("value"))) for name, bad in tests.items() if bad is not None]
    return rows.select(F.col(key), F.explode(F.array_compact(F.array(*found))).alias("v")).select(key, "v.*")


def concept_triples(concepts: DataFrame, scheme: str) -> DataFrame:
    """s, p, o of concepts (concept, label, broader, notation): type, scheme, label, and both
    directions of the broader relation."""
    def said(s: Column, p: str, o: Column) -> Column:
        return F.when(s.isNotNull() & o.isNotNull(), F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o")))

    c, b = F.col("concept"), F.col("broader")
    each = F.array(said(c, "rdf:type", F.lit("skos:Concept")), said(c, "skos:inScheme", F.lit(scheme)), said(c, "skos:prefLabel", F.col("label")), said(c, "skos:broader", b), said(b, "skos:narrower", c), said(c, "skos:notation", F.col("notation")))
    return concepts.select(F.explode(F.array_compact(each)).alias("t")).select("t.*")


def associations(rows: DataFrame, name: str, ends: dict[str, str], properties: list[str]) -> DataFrame:
    """s, p, o of a class that stands for an n-ary relation: one instance a row, with a link to
    each of its ends (role -> column) and its own properties."""
    own = F.concat_ws("-", F.lit(name), *[F.col(c).cast("string") for c in ends.values()])
    parts = [F.struct(F.lit("rdf:type").alias("p"), F.lit(name).alias("o")), *[F.struct(F.lit(f"has{role}").alias("p"), F.col(c).cast("string").alias("o")) for role, c in ends.items()], *[F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o")) for c in properties]]
    return rows.select(own.alias("s"), F.explode(F.array(*parts)).alias("x")).select("s", "x.p", "x.o")
