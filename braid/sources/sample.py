"""The generated test tables as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import sequences


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.round(F.col("o_totalprice") * 100).cast("bigint")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hyperedge_id"), cost.alias("cost"))
    return rows.select("hyperedge_id", F.struct("hyperedge_id", "cost").alias("weight"), "cost")


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperedges: the parts of each order by line."""
    rows = sequences(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey"])
    return rows.join(order_weights(spark, sf_dir), "hyperedge_id").select("hyperedge_id", "vertices", "weight", "cost")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices: parts, weighted by key and name, as names repeat."""
    rows = table(spark, sf_dir, "part")
    return rows.select(F.col("p_partkey").alias("vertex_id"), F.struct("p_partkey", "p_name").alias("weight"))


def order_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperedges: the supplier nations of each order by line."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("nation"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(suppliers, "l_suppkey")
    found = sequences(rows, "l_orderkey", "nation", ["l_linenumber", "l_partkey", "l_suppkey"])
    return found.join(order_weights(spark, sf_dir), "hyperedge_id").select("hyperedge_id", "vertices", "weight", "cost")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    return rows.select(F.col("n_nationkey").cast("bigint").alias("vertex_id"), F.struct("n_name").alias("weight"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperedges: the event types of each user by time; event types are numbered by name."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    numbered = events.select("event_type").distinct().withColumn("vertex_id", F.row_number().over(W.orderBy("event_type")).cast("bigint") - 1)  # kinds, not events
    rows = events.join(numbered, "event_type")
    found = sequences(rows, "user_id", "vertex_id", ["ts", "event_id"])
    return found.select("hyperedge_id", "vertices", F.struct("hyperedge_id").alias("weight"), F.size("vertices").cast("bigint").alias("cost"))
