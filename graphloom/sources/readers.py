"""Readers: every source as a DataFrame, and rows as triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, *, pattern: str | None = None, content: bool = False, most_bytes: int | None = None) -> DataFrame:
    """path, length, modified, kind of all files below a directory (any file system that
    Spark reads); their bytes only if asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    found = found if most_bytes is None else found.where(F.col("length") <= most_bytes)
    columns = ["path", "length", F.col("modificationTime").alias("modified"), kind(F.col("path"), F.col("content") if content else None).alias("kind")]
    return found.select(*columns, *(["content"] if content else []))


#: First bytes of common formats, in hexadecimal.
MAGIC = {"25504446": "pdf", "504B0304": "zip", "89504E47": "png", "FFD8FF": "jpeg", "47494638": "gif", "50415231": "parquet", "1F8B": "gzip"}


def kind(path: Column, content: Column | None = None) -> Column:
    """By first bytes if the content is at hand, else by the ending."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    named = F.when(ending == "", "unknown").otherwise(ending)
    if content is None:
        return named
    first = F.hex(F.substring(content, 1, 4))
    out = named
    for magic, name in MAGIC.items():
        out = F.when(first.startswith(magic), name).otherwise(out)
    return out


def tabular(spark: SparkSession, path: str, form: str, *, schema: str | None = None, **options) -> DataFrame:
    """csv, json, parquet, orc, avro, text, xml or jdbc; csv and json keep what does not
    parse in `_corrupt_record` when a schema with that column is given."""
    reader = spark.read.format(form).options(**{"header": "true"} if form == "csv" else {}).options(**options)
    reader = reader.schema(schema) if schema else reader
    return reader.load() if form == "jdbc" else reader.load(path)


def triples(rows: DataFrame, *, subject: Column, properties: dict[str, Column | str], kind: str | None = None) -> DataFrame:
    """(s, p, o) of each row: a triple for every property that is not null, and its type."""
    pairs = [F.struct(F.lit(p).alias("p"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("o")) for p, c in properties.items()]
    if kind:
        pairs.append(F.struct(F.lit("type").alias("p"), F.lit(kind).alias("o")))
    return rows.select(subject.alias("s"), F.explode(F.filter(F.array(*pairs), lambda x: x["o"].isNotNull())).alias("x")).select("s", "x.p", "x.o")


def entities_from_triples(facts: DataFrame, properties: list[str]) -> DataFrame:
    """One row for each subject, a column for each property (the smallest value of several)."""
    return facts.where(F.col("p").isin(properties)).groupBy("s").pivot("p", properties).agg(F.min("o"))
