"""The standard tables, and the property graph they stand for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a session, where it is not installed on them."""
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class PropertyGraph:
    """nodes: id, type, name; edges: src, dst, type, weight."""

    nodes: DataFrame
    edges: DataFrame


def node(kind: str, key: str):
    return F.concat(F.lit(kind), F.col(key).cast("string"))


def trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Parts and the suppliers that delivered them; weight is the number of line items."""
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(node("p", "p_partkey").alias("id"), F.lit("part").alias("type"), F.col("p_name").alias("name"))
    suppliers = table(spark, sf_dir, "supplier").select(node("s", "s_suppkey").alias("id"), F.lit("supplier").alias("type"), F.col("s_name").alias("name"))
    edges = items.groupBy(node("p", "l_partkey").alias("src"), node("s", "l_suppkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return PropertyGraph(parts.union(suppliers), edges.select("src", "dst", F.lit("supplied_by").alias("type"), "weight"))


def place_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, and the customers and suppliers in them: a forest of five trees."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nodes = (
        region.select(node("r", "r_regionkey").alias("id"), F.lit("region").alias("type"), F.col("r_name").alias("name"))
        .union(nation.select(node("n", "n_nationkey"), F.lit("nation"), "n_name"))
        .union(customer.select(node("c", "c_custkey"), F.lit("customer"), "c_name"))
        .union(supplier.select(node("s", "s_suppkey"), F.lit("supplier"), "s_name"))
    )
    edges = (
        nation.select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst"), F.lit("contains").alias("type"), F.lit(0.9).alias("weight"))
        .union(customer.select(node("n", "c_nationkey"), node("c", "c_custkey"), F.lit("home_of"), F.lit(0.8)))
        .union(supplier.select(node("n", "s_nationkey"), node("s", "s_suppkey"), F.lit("seat_of"), F.lit(0.5)))
    )
    return PropertyGraph(nodes, edges)


def market_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges (src, dst): customers to the suppliers that they buy from, suppliers to
    their nations, nations to their customers."""
    bought = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        bought.select(node("c", "o_custkey").alias("src"), node("s", "l_suppkey").alias("dst")).distinct()
        .union(table(spark, sf_dir, "supplier").select(node("s", "s_suppkey"), node("n", "s_nationkey")))
        .union(table(spark, sf_dir, "customer").select(node("n", "c_nationkey"), node("c", "c_custkey")))
    )
