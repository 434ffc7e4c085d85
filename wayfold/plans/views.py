"""Trajectories over the test tables, and the same views in SQL.

emb: 32 points of each embedding; evt: a user's events in time; lin: a supplier's lines.
The query set is every trajectory whose id is divisible by 100: as it is, or, where all are of one
length and none could be longer than a query, the means of every four points in a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", i).cast("double")
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("traj_id"), pts.alias("pts"))


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("ts", "event_id", (F.col("value") / 1000).alias("x"), (F.get_json_object("props", "$.k").cast("double") / 1000).alias("y"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("traj_id")).agg(F.array_sort(F.collect_list(row)).alias("p"))
    return rows.select("traj_id", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))


def lin(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", F.col("l_discount").cast("double").alias("x"), F.col("l_tax").cast("double").alias("y"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("traj_id")).agg(F.array_sort(F.collect_list(row)).alias("p"))
    return rows.select("traj_id", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))


def queries(traj: DataFrame) -> DataFrame:
    """query_id, q_pts: the whole trajectories of the query set."""
    return traj.filter("traj_id % 100 = 0").select(F.col("traj_id").alias("query_id"), F.col("pts").alias("q_pts"))


def coarse(traj: DataFrame) -> DataFrame:
    """query_id, q_pts: the trajectories of the query set (32 points) as 8 means of four points in a row."""
    mean = lambda i, axis: (F.get("q_pts", 4 * i)[axis] + F.get("q_pts", 4 * i + 1)[axis] + F.get("q_pts", 4 * i + 2)[axis] + F.get("q_pts", 4 * i + 3)[axis]) / 4
    pts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(mean(i, "x").alias("x"), mean(i, "y").alias("y")))
    return queries(traj).select("query_id", pts.alias("q_pts"))


#: Common table expressions: points (traj_id, pos, x, y) of each view, and queries (query_id, pos, x, y).
SQL = {
    "emb": "emb AS (SELECT vec_id AS traj_id, i AS pos, embedding[2*i+1]::DOUBLE AS x, embedding[2*i+2]::DOUBLE AS y FROM embeddings, range(32) r(i))",
    "qemb": "qemb AS (SELECT vec_id AS query_id, i AS pos, (embedding[8*i+1]::DOUBLE + embedding[8*i+3]::DOUBLE + embedding[8*i+5]::DOUBLE + embedding[8*i+7]::DOUBLE) / 4 AS x, (embedding[8*i+2]::DOUBLE + embedding[8*i+4]::DOUBLE + embedding[8*i+6]::DOUBLE + embedding[8*i+8]::DOUBLE) / 4 AS y FROM embeddings, range(8) r(i) WHERE vec_id % 100 = 0)",
    "evt": "evt AS (SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value / 1000 AS x, CAST(json_extract(props, '$.k') AS DOUBLE) / 1000 AS y FROM events)",
    "qevt": "qevt AS (SELECT traj_id AS query_id, pos, x, y FROM evt WHERE traj_id % 100 = 0)",
    "lin": "lin AS (SELECT l_suppkey AS traj_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS pos, l_discount::DOUBLE AS x, l_tax::DOUBLE AS y FROM lineitem)",
}


def with_views(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)
