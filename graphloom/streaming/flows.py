"""Streaming forms: windowed counts, sessions, first-seen, dead letters.

The same functions work on batch DataFrames. Event time is the column ts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.loops import Saved, shared_folder


def event_stream(spark: SparkSession, path: str, *, schema, most_files: int = 100) -> DataFrame:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Needs the Kafka package on the cluster's class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()


def windowed_counts(events: DataFrame, *, width: str = "1 day", late: str = "1 day", by: str = "event_type") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sliding_counts(events: DataFrame, *, width: str, slide: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, *, gap: str, late: str = "1 day", by: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, *keys: str, late: str = "40 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys)).select(*keys)


def parted(messages: DataFrame, schema: str, *, value: str = "props") -> tuple[DataFrame, DataFrame]:
    """(parsed, dead): rows whose JSON fits the schema, and the others as they came."""
    read = messages.withColumn("_p", F.from_json(value, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    fine = F.col("_p").isNotNull() & F.col("_p._bad").isNull()
    return read.where(fine).select(*messages.columns, "_p.*").drop("_bad"), read.where(~F.coalesce(fine, F.lit(False))).select(*messages.columns)


def drained(stream: DataFrame, name: str, *, mode: str = "complete", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """All that is there now is run through the stream; what the last batch (complete mode) or
    all batches (append mode) gave is returned. State and output are in the shared folder."""
    spark = stream.sparkSession
    saved = Saved(spark, f"stream-{name}")
    out: dict[int, DataFrame] = {}

    def keep(batch: DataFrame, number: int) -> None:
        if each:
            each(batch, number)
        out[number] = saved.save(batch)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{saved.root}-state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if mode == "complete":
        return out[max(out)]
    whole = None
    for number in sorted(out):
        whole = out[number] if whole is None else whole.union(out[number])
    return whole


def loaded(stream: DataFrame, name: str, path: str, *, keys: list[str]) -> DataFrame:
    """A stream of rows appended to the Parquet table at `path`, each key once a batch, and
    (batch, rows) of what every batch loaded. A batch that runs again replaces its own folder."""
    spark = stream.sparkSession
    saved = Saved(spark, f"load-{name}")

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.option("checkpointLocation", f"{saved.root}-state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.parquet(path).groupBy("batch").agg(F.count("*").alias("rows"))
