"""Plain recurrences, one pair at a time: what the tests hold the kernels against."""

from __future__ import annotations

import math

from ..functions import points


def costs(metric: str, eps: float, centre):
    def far(p, q):
        return math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2)

    gap = (points.GAP, points.GAP)
    sub = {"dtw": far, "fc": far, "erp": far, "edr": lambda p, q: float(far(p, q) > eps), "lcss": lambda p, q: 1.0 - (abs(p[0] - q[0]) < eps and abs(p[1] - q[1]) < eps), "lev": lambda p, q: float(tuple(p) != tuple(q))}[metric]
    hole = {"erp": lambda p: far(p, centre), "edr": lambda p: float(far(p, gap) > eps)}.get(metric, lambda p: 1.0)
    return sub, hole


def distance(q, d, metric: str, eps=points.EPSILON, centre=points.CENTRE) -> float:
    """Whole against whole."""
    sub, hole = costs(metric, eps, centre)
    if metric in ("dtw", "fc"):
        join = max if metric == "fc" else lambda a, b: a + b
        row: list[float] = []
        for i, p in enumerate(q):
            new: list[float] = []
            for j, r in enumerate(d):
                near = [x for x in (row[j] if i else None, row[j - 1] if i and j else None, new[j - 1] if j else None) if x is not None]
                new.append(join(min(near), sub(p, r)) if near else sub(p, r))
            row = new
        return row[-1]
    row = [0.0]
    for r in d:
        row.append(row[-1] + hole(r))
    for p in q:
        new = [row[0] + hole(p)]
        for j, r in enumerate(d):
            new.append(min(row[j] + sub(p, r), row[j + 1] + hole(p), new[j] + hole(r)))
        row = new
    return row[-1]


def best(q, d, metric: str, **options) -> float:
    """The least distance of q to any subtrajectory of d."""
    return min(distance(q, d[s : e + 1], metric, **options) for s in range(len(d)) for e in range(s, len(d)))
