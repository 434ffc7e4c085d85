"""Boxes, cells and grids over trajectories, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mbr(pts: Column) -> Column:
    """The bounding box of an array of points; null for no points."""
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def scaled(box: Column, factor: Column | float) -> Column:
    """The box with its sides multiplied by factor, around its centre."""
    f = F.lit(factor) if not isinstance(factor, Column) else factor
    cx, cy = (box["min_x"] + box["max_x"]) / 2, (box["min_y"] + box["max_y"]) / 2
    hx, hy = (box["max_x"] - box["min_x"]) / 2 * f, (box["max_y"] - box["min_y"]) / 2 * f
    return F.struct((cx - hx).alias("min_x"), (cy - hy).alias("min_y"), (cx + hx).alias("max_x"), (cy + hy).alias("max_y"))


def box_distance(a: Column, b: Column) -> Column:
    """Euclidean gap between boxes, 0 where they meet."""
    dx = F.greatest(F.lit(0.0), a["min_x"] - b["max_x"], b["min_x"] - a["max_x"])
    dy = F.greatest(F.lit(0.0), a["min_y"] - b["max_y"], b["min_y"] - a["max_y"])
    return F.sqrt(dx * dx + dy * dy)


def overlap(a: Column, b: Column) -> Column:
    return (a["min_x"] <= b["max_x"]) & (b["min_x"] <= a["max_x"]) & (a["min_y"] <= b["max_y"]) & (b["min_y"] <= a["max_y"])


def within(a: Column, b: Column) -> Column:
    """Box a lies strictly inside box b."""
    return (a["min_x"] > b["min_x"]) & (a["max_x"] < b["max_x"]) & (a["min_y"] > b["min_y"]) & (a["max_y"] < b["max_y"])


def cell(v: Column, origin: Column | float, size: Column | float, mode: str = "floor") -> Column:
    """The cell of a coordinate: floor, or trunc (towards 0, which differs below the origin)."""
    q = (v - origin) / size
    return F.floor(q).cast("int") if mode == "floor" else q.cast("int")


def cell_box(gx: Column, gy: Column, origin: tuple, size: tuple, reach: int = 0) -> Column:
    """The box of a cell, with `reach` more cells on every side."""
    (ox, oy), (sx, sy) = origin, size
    return F.struct((ox + (gx - reach) * sx).alias("min_x"), (oy + (gy - reach) * sy).alias("min_y"), (ox + (gx + 1 + reach) * sx).alias("max_x"), (oy + (gy + 1 + reach) * sy).alias("max_y"))


def grid_id(x: Column, y: Column, x0: float, y0: float, g: float, x_size: int) -> Column:
    """One number for a cell, counted by rows of x_size cells from 1."""
    return (F.ceil((y - y0) / g) * x_size + F.ceil((x - x0) / g)).cast("long")


def fitting_factor(box: Column, frame: Column) -> Column:
    """The factor by which a frame must grow around its centre until the box fits into it."""
    cx, cy = (frame["min_x"] + frame["max_x"]) / 2, (frame["min_y"] + frame["max_y"]) / 2
    hx, hy = (frame["max_x"] - frame["min_x"]) / 2, (frame["max_y"] - frame["min_y"]) / 2
    return F.greatest((box["max_x"] - cx) / hx, (cx - box["min_x"]) / hx, (box["max_y"] - cy) / hy, (cy - box["min_y"]) / hy)
