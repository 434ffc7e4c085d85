"""Filters and projections over trajectories (traj_id, pts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ranges (x, then y) of three cities.
RANGES = {
    "xian": ((34.20, 34.29), (108.91, 109.00)),
    "chengdu": ((30.65, 30.73), (104.04, 104.13)),
    "porto": ((41.11, 41.19), (-8.67, -8.57)),
}


def points_of(traj: DataFrame) -> DataFrame:
    """One row for each point: traj_id, pos, x, y."""
    return traj.select("traj_id", F.posexplode("pts").alias("pos", "p")).select("traj_id", "pos", "p.x", "p.y")


def in_range(traj: DataFrame, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    """Trajectories all of whose points lie in the closed range."""
    return traj.filter(F.forall("pts", lambda p: p["x"].between(*x) & p["y"].between(*y)))


def by_length(traj: DataFrame, least: int, most: int, limit: int | None = None) -> DataFrame:
    got = traj.filter(F.size("pts").between(least, most))
    return got if limit is None else got.orderBy("traj_id").limit(limit)


def truncated(traj: DataFrame, least: int, most: int) -> DataFrame:
    """Queries of `least` points or more, cut to their first `most`."""
    return traj.filter(F.size("pts") >= least).withColumn("pts", F.slice("pts", 1, most))


def swapped(pts: Column) -> Column:
    return F.transform(pts, lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y")))


def without_stops(pts: Column) -> Column:
    """pts without points equal to the one before."""
    return F.filter(pts, lambda p, i: (i == 0) | (p != F.get(pts, i - 1)))


def part(pts: Column, start: Column, end: Column) -> Column:
    """The points start..end, both included."""
    return F.slice(pts, start + 1, end - start + 1)


def normalised(traj: DataFrame) -> DataFrame:
    """Coordinates scaled to 0..1 by the extent of all points; an axis without extent gives null."""
    each = traj.select(F.array_min(F.transform("pts", lambda p: p["x"])).alias("x0"), F.array_max(F.transform("pts", lambda p: p["x"])).alias("x1"), F.array_min(F.transform("pts", lambda p: p["y"])).alias("y0"), F.array_max(F.transform("pts", lambda p: p["y"])).alias("y1"))
    e = each.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()  # one row
    if e[0] is None:
        return traj
    x0, x1, y0, y1 = (F.lit(v) for v in e)
    return traj.withColumn("pts", F.transform("pts", lambda p: F.struct(F.try_divide(p["x"] - x0, x1 - x0).alias("x"), F.try_divide(p["y"] - y0, y1 - y0).alias("y"))))


def scores(table: DataFrame, longest: float | None = None) -> DataFrame:
    """Rows of a score table (que_index, tra_idx, s, e, score1) that span over two points, scores divided by `longest` if given."""
    got = table.filter(F.col("e") - F.col("s") > 2)
    return got if longest is None else got.withColumn("score1", F.col("score1") / F.lit(float(longest)))


def first_ids(traj: DataFrame, n: int) -> DataFrame:
    return traj.filter(F.col("traj_id") < n)


def chosen(traj: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the trajectories of ids (traj_id), the ids that there are none of)."""
    return traj.join(ids, "traj_id", "left_semi"), ids.join(traj.select("traj_id"), "traj_id", "left_anti")


def summary(traj: DataFrame, points: str = "all") -> DataFrame:
    """count, mean length, and mean and extent of the coordinates of all points, or of the last of each."""
    pts = F.explode("pts") if points == "all" else F.explode(F.slice("pts", -1, 1))
    sizes = traj.agg(F.count(F.lit(1)).alias("trajectories"), F.avg(F.size("pts")).alias("mean_length"))
    coords = traj.select(pts.alias("p")).agg(*[f(f"p.{c}").alias(f"{n}_{c}") for c in "xy" for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])
    return sizes.join(F.broadcast(coords))  # one row each
