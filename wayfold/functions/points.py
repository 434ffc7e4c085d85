"""Costs between points, as Columns.  Points are structs (x, y) of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The gap point, and the default centre, thresholds and band of the costs.
GAP = -1000.0
CENTRE = (34.43999862670898, 109.94999694824219)
EPSILON, BAND = 0.0005, 3


def euclid(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def levenshtein(p: Column, q: Column) -> Column:
    return F.when((p["x"] == q["x"]) & (p["y"] == q["y"]), 0.0).otherwise(1.0)


def lcss(p: Column, q: Column, eps: float = EPSILON) -> Column:
    """0 where both coordinates differ by less than eps."""
    return F.when((F.abs(p["x"] - q["x"]) < eps) & (F.abs(p["y"] - q["y"]) < eps), 0.0).otherwise(1.0)


def erp(p: Column, q: Column, centre: tuple[float, float] = CENTRE) -> Column:
    """Euclidean, the gap point standing for the centre."""

    def real(a: Column) -> Column:
        gap = a["x"] == GAP
        return F.struct(F.when(gap, F.lit(centre[0])).otherwise(a["x"]).alias("x"), F.when(gap, F.lit(centre[1])).otherwise(a["y"]).alias("y"))

    return euclid(real(p), real(q))


def edr(p: Column, q: Column, eps: float = EPSILON) -> Column:
    """1 where the points are farther apart than eps; points at eps match."""
    return F.when(euclid(p, q) > eps, 1.0).otherwise(0.0)


def edr_match(p: Column, q: Column, eps: float = EPSILON) -> Column:
    return F.when(euclid(p, q) <= eps, 1).otherwise(0)


COSTS = {"dtw": euclid, "fc": euclid, "erp": erp, "edr": edr, "lcss": lcss, "lev": levenshtein}


def cost(metric: str, p: Column, q: Column, **options) -> Column:
    """The cost of a metric by name; an unknown name is an error."""
    if metric not in COSTS:
        raise ValueError(f"no metric {metric!r}; there are {sorted(COSTS)}")
    return COSTS[metric](p, q, **options)


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
