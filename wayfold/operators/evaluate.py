"""Quality of results against the ground truth: pred and truth are (query_id, rank from 1, traj_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hits(pred: DataFrame, truth: DataFrame, p: int, t: int) -> DataFrame:
    """query_id, hits: how many of the first p predictions are among the first t true ones; queries without any count 0."""
    a = pred.filter(F.col("rank") <= p).select("query_id", "traj_id").distinct()
    b = truth.filter(F.col("rank") <= t).select("query_id", "traj_id").distinct()
    hits = a.join(b, ["query_id", "traj_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return truth.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"))


def hit_rates(pred: DataFrame, truth: DataFrame, k: int, portions=(0.2, 0.4, 0.6, 0.8, 1.0)) -> DataFrame:
    """query_id, portion, hr: the overlap of the first portion of both lists."""
    out = None
    for f in portions:
        n = int(f * k)
        part = _hits(pred, truth, n, n).select("query_id", F.lit(f).alias("portion"), (F.col("hits") / n).alias("hr"))
        out = part if out is None else out.unionByName(part)
    return out


def mean_hit_rates(rates: DataFrame) -> DataFrame:
    return rates.groupBy("portion").agg(F.avg("hr").alias("hr"))


def recall_at(pred: DataFrame, truth: DataFrame, k: int, portion: float = 0.2) -> DataFrame:
    """query_id, recall: which part of the first portion * k true results is among the k predictions."""
    n = int(portion * k)
    return _hits(pred, truth, k, n).select("query_id", (F.col("hits") / n).alias("recall"))


def precision(pred: DataFrame, truth: DataFrame, width: int) -> DataFrame:
    """One row: hits among the first `width` of both lists, over all queries."""
    return _hits(pred, truth, width, width).agg((F.sum("hits") / (F.count(F.lit(1)) * width)).alias("precision"))


def report(matches: DataFrame) -> DataFrame:
    """query_id, best distance with its trajectory, sum of distances and number of pairs."""
    return matches.groupBy("query_id").agg(F.min("dist").alias("best"), F.min(F.struct("dist", "traj_id"))["traj_id"].alias("traj_id"), F.sum("dist").alias("total"), F.count(F.lit(1)).alias("pairs"))
