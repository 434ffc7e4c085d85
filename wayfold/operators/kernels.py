"""Vectorised kernels: the subtrajectory of the data that is closest to the query.

A batch of pairs is one set of *lanes*, the last axis of all arrays.  All recurrences need the cells
above, left and diagonal only, so each cell is one numpy operation over the lanes, and what does not need
the cell on the left is one operation over a row; queries and data are padded, and cells outside a lane's
own lengths never win.  Batches are small enough for a processor's cache.
"""

from __future__ import annotations

import numpy as np

from ..functions import points

METRICS = ("dtw", "fc", "edr", "erp", "lcss", "lev")
ALGORITHMS = ("cma", "exact", "pss", "pos")


class Costs:
    """sub (m, n, lanes), and the gap costs of query (m, lanes) and data points (n, lanes), of points (2, m or n, lanes).

    Where all costs are 0 or 1 they are float32, in which their sums are exact."""

    def __init__(self, q: np.ndarray, d: np.ndarray, metric: str, eps: float, centre: tuple[float, float]):
        if metric not in METRICS:
            raise ValueError(f"no metric {metric!r}; there are {METRICS}")
        kind = float if metric in ("dtw", "fc", "erp") else np.float32
        self.sub = np.empty((q.shape[1], d.shape[1], q.shape[2]), kind)
        dx, dy = np.empty(d.shape[1:]), np.empty(d.shape[1:])
        for i, row in enumerate(self.sub):
            np.subtract(q[0, i], d[0], out=dx)
            np.subtract(q[1, i], d[1], out=dy)
            if metric == "lcss":
                row[:] = 1 - ((np.abs(dx) < eps) & (np.abs(dy) < eps))
            elif metric == "lev":
                row[:] = 1 - ((dx == 0) & (dy == 0))
            else:
                np.multiply(dx, dx, out=dx)
                np.multiply(dy, dy, out=dy)
                np.add(dx, dy, out=dx)
                if metric == "edr":
                    row[:] = np.sqrt(dx, out=dx) > eps
                else:
                    np.sqrt(dx, out=row)
        if metric == "erp":
            self.gq, self.gd = (np.sqrt((p[0] - centre[0]) ** 2 + (p[1] - centre[1]) ** 2) for p in (q, d))
        elif metric == "edr":
            self.gq, self.gd = ((np.sqrt((p[0] - points.GAP) ** 2 + (p[1] - points.GAP) ** 2) > eps).astype(kind) for p in (q, d))
        else:
            self.gq, self.gd = (np.ones(p.shape[1:], kind) for p in (q, d))


def _join(metric: str):
    return np.maximum if metric == "fc" else np.add


def _first_least(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of the least of each lane's first n values, that value)."""
    rows = np.where(np.arange(len(rows))[:, None] < n, rows, np.inf)
    at = rows.argmin(axis=0)
    return at, rows[at, np.arange(len(at))]


def _take(out: np.ndarray, got: np.ndarray, own: np.ndarray) -> None:
    """Copy the lanes of got that are own."""
    if own.all():
        out[...] = got
    elif own.any():
        out[..., own] = got[..., own]


def cma(c: Costs, m: np.ndarray, n: np.ndarray, metric: str):
    """Free start and end in one pass, the start carried along: (start, end, distance)."""
    rows, cols, lanes = c.sub.shape
    a, s = c.sub[0].copy(), np.repeat(np.arange(cols, dtype=np.int32)[:, None], lanes, axis=1)
    last, begin = a.copy(), s.copy()
    wed, join = metric not in ("dtw", "fc"), _join(metric)
    gaps, less, left = np.cumsum(c.gq, axis=0, dtype=c.sub.dtype), np.empty(lanes, bool), np.empty(lanes, c.sub.dtype)
    for i in range(1, rows):
        sub = c.sub[i]
        up, diag = (a + c.gq[i], a[:-1] + sub[1:]) if wed else (a, a[:-1])
        x, t = np.empty_like(a), np.empty_like(s)
        x[0] = np.minimum(up[0], gaps[i - 1] + sub[0]) if wed else join(a[0], sub[0])
        t[0] = 0
        np.minimum(up[1:], diag, out=x[1:])
        t[1:] = np.where(up[1:] >= diag, s[:-1], s[1:])
        for j in range(1, cols):
            if wed:
                np.add(x[j - 1], c.gd[j - 1], out=left)
                np.subtract(left, sub[j - 1], out=left)
                before = np.add(left, sub[j], out=left)
            else:
                before = x[j - 1]
            np.less(before, x[j], out=less)
            np.copyto(t[j], t[j - 1], where=less)
            np.minimum(before, x[j], out=x[j])
            if not wed:
                join(x[j], sub[j], out=x[j])
        a, s = x, t
        own = m - 1 == i
        _take(last, a, own)
        _take(begin, s, own)
    end, dist = _first_least(last, n)
    return begin[end, np.arange(lanes)], end, dist


def _prefix_rows(sub, gq, gd, m, metric: str, band: int | None = None) -> np.ndarray:
    """The distance of the whole query to each prefix of the data: (cols, lanes)."""
    rows, cols, lanes = sub.shape
    out = np.full((cols, lanes), np.inf)
    if metric in ("dtw", "fc"):
        join = _join(metric)
        a = join.accumulate(sub[0], axis=0)
        _take(out, a, m == 1)
        for i in range(1, rows):
            x = np.empty_like(a)
            join(a[0], sub[i, 0], out=x[0])
            np.minimum(a[1:], a[:-1], out=x[1:])
            for j in range(1, cols):
                np.minimum(x[j], x[j - 1], out=x[j])
                join(x[j], sub[i, j], out=x[j])
            a = x
            _take(out, a, m - 1 == i)
        return out
    a = np.concatenate([np.zeros((1, lanes), sub.dtype), np.cumsum(gd, axis=0, dtype=sub.dtype)])
    left = np.empty(lanes, sub.dtype)
    for i in range(1, rows + 1):
        x = a + gq[i - 1]
        lo, hi = (1, cols + 1) if band is None else (max(1, i - band + 1), min(cols + 1, i + band))
        if lo < hi:
            np.minimum(x[lo:hi], a[lo - 1 : hi - 1] + sub[i - 1, lo - 1 : hi - 1], out=x[lo:hi])
        for j in range(1, cols + 1):
            np.add(x[j - 1], gd[j - 1], out=left)
            np.minimum(x[j], left, out=x[j])
        a = x
        _take(out, a[1:], m == i)
    return out


def all_ranges(c: Costs, m, n, metric: str, strict: bool = False, banded: bool = True) -> np.ndarray:
    """The distances to data[start..end]: (ends, starts, lanes), infinite where there is no such range.

    The starts of a lane advance together.  strict leaves out the start at the last point; lcss is banded."""
    rows, cols, lanes = c.sub.shape
    band = points.BAND if metric == "lcss" and banded else None
    out = None if (m == m[0]).all() else np.full((cols, cols, lanes), np.inf, c.sub.dtype)
    if metric in ("dtw", "fc"):
        join = _join(metric)
        a = np.full((cols, cols, lanes), np.inf)
        for j in range(cols):
            a[j, j] = c.sub[0, j]
            if j:
                join(a[j - 1, :j], c.sub[0, j], out=a[j, :j])
        if out is not None:
            _take(out, a, m == 1)
        x = np.full_like(a, np.inf)
        for i in range(1, rows):
            for j in range(cols):
                new = x[j, : j + 1]
                if j:
                    np.minimum(a[j, : j + 1], a[j - 1, : j + 1], out=new)
                    np.minimum(new[:j], x[j - 1, :j], out=new[:j])
                    join(new, c.sub[i, j], out=new)
                else:
                    join(a[0, :1], c.sub[i, 0], out=new)
            if out is not None:
                _take(out, x, m - 1 == i)
            a, x = x, a
    else:
        a = np.full((cols + 1, cols, lanes), np.inf, c.sub.dtype)  # a[s, s] comes before the first point
        for j in range(cols):
            a[j, j] = 0
            np.add(a[j, : j + 1], c.gd[j], out=a[j + 1, : j + 1])
        x = np.full_like(a, np.inf)
        for i in range(1, rows + 1):
            for j in range(cols):
                np.add(a[j, j], c.gq[i - 1], out=x[j, j])
                new = x[j + 1, : j + 1]
                np.minimum(a[j + 1, : j + 1] + c.gq[i - 1], x[j, : j + 1] + c.gd[j], out=new)
                lo, hi = (0, j + 1) if band is None else (max(0, j + 2 - i - band), min(j + 1, j + 1 - i + band))
                if lo < hi:
                    np.minimum(new[lo:hi], a[j, lo:hi] + c.sub[i - 1, j], out=new[lo:hi])
            if out is not None:
                _take(out, x[1:], m == i)
            a, x = x, a
        a[np.arange(cols), np.arange(cols)] = np.inf  # no points
        a = a[1:]
    out = a if out is None else out  # ranges that end before they start are infinite
    if strict or (n < cols).any():
        inside = np.arange(cols)[:, None, None] < n
        out = np.where(inside & (np.arange(cols)[:, None] < n - 1) if strict else inside, out, np.inf)
    return out


def exact(c: Costs, m, n, metric: str, strict: bool = False):
    got, k = all_ranges(c, m, n, metric, strict), np.arange(len(m))
    start = got.min(axis=0).argmin(axis=0)
    own = got[:, start, k]
    end = own.argmin(axis=0)
    dist = own[end, k].astype(float)
    return start, np.where(np.isinf(dist), 0, end), dist


def _scan(sub, gq_, gd_, m, n, metric: str, after: np.ndarray | None, delay: int | None):
    """Grow a prefix point by point and keep the best; `after` are the distances of what is left (PSS).  Lanes come first here."""
    lanes, rows, cols = sub.shape
    wed, join, k = metric not in ("dtw", "fc"), _join(metric), np.arange(lanes)
    all_ = sub
    d = np.zeros((lanes, rows + 1))
    j, start, waited = np.zeros(lanes, int), np.zeros(lanes, int), np.zeros(lanes, int)
    best, lo, hi = np.full(lanes, np.inf), np.zeros(lanes, int), np.zeros(lanes, int)
    gaps = np.concatenate([np.zeros((lanes, 1)), np.cumsum(gq_, axis=1)], axis=1)
    while (live := j < n).any():
        at = np.minimum(j, cols - 1)
        sub, gd, fresh = all_[k, :, at], gd_[k, at], j == start
        x = np.empty_like(d)
        if wed:
            d[fresh] = gaps[fresh]
            x[:, 0] = d[:, 0] + gd
            for i in range(1, rows + 1):
                x[:, i] = np.minimum(np.minimum(d[:, i - 1] + sub[:, i - 1], d[:, i] + gd), x[:, i - 1] + gq_[:, i - 1])
        else:
            d[fresh] = np.inf
            x[:, 0] = np.inf
            x[:, 1] = np.where(fresh, sub[:, 0], join(d[:, 1], sub[:, 0]))
            for i in range(2, rows + 1):
                x[:, i] = join(np.minimum(np.minimum(d[:, i - 1], d[:, i]), x[:, i - 1]), sub[:, i - 1])
        d = x
        here = d[k, m]
        if after is not None:
            rest = after[k, np.minimum(at, after.shape[1] - 1)]
            got, own = np.minimum(here, rest), here < rest
        else:
            got, own = here, np.ones(lanes, bool)
        better = live & (got < best)
        best[better] = got[better]
        lo[better] = np.where(own, start, j)[better]
        hi[better] = np.where(own, j, n - 1)[better]
        waited[better] = 0
        if delay is None:
            start[better] = j[better] + 1
            j += live
            continue
        worse = live & ~better
        waited[worse] += 1
        again = worse & (waited > delay) & (lo == start)
        j += live
        start[again] = j[again] = hi[again] + 1
        waited[again] = 0
    return lo, hi, best


def _reversed(a: np.ndarray, size: np.ndarray, axis: int) -> np.ndarray:
    """The first size[lane] entries of an axis in reverse, padding left in place."""
    at = np.arange(a.shape[axis])[None, :]
    at = np.where(at < size[:, None], size[:, None] - 1 - at, at)
    shape = [1] * a.ndim
    shape[0], shape[axis] = a.shape[0], a.shape[axis]
    return np.take_along_axis(a, at.reshape(shape), axis=axis)


def pss(c: Costs, m, n, metric: str):
    """Prefix-suffix split: at each point the better of what ends and what starts there; ranges in data order."""
    prefix = _prefix_rows(c.sub, c.gq, c.gd, m, metric).T  # of data[0..j]
    sub = _reversed(_reversed(c.sub.transpose(2, 0, 1), m, 1), n, 2)
    lo, hi, best = _scan(sub, _reversed(c.gq.T, m, 1), _reversed(c.gd.T, n, 1), m, n, metric, _reversed(prefix, n, 1), None)
    return n - 1 - hi, n - 1 - lo, best


def pos(c: Costs, m, n, metric: str, delay: int = 10):
    """Prefix only; edit distances go on for `delay` points without a gain, then restart after the best."""
    return _scan(np.ascontiguousarray(c.sub.transpose(2, 0, 1)), c.gq.T, c.gd.T, m, n, metric, None, delay if metric not in ("dtw", "fc") else None)


def whole(c: Costs, m, n, metric: str) -> np.ndarray:
    """The distance of the whole query to the whole data."""
    return _prefix_rows(c.sub, c.gq, c.gd, m, metric)[n - 1, np.arange(len(m))]


class Paths:
    """Paths of points, one after the other: xy (2, points), and the place of the first point and the number of points of each."""

    def __init__(self, xy: np.ndarray, sizes: np.ndarray):
        self.xy, self.sizes = np.concatenate([xy, np.zeros((2, 1))], axis=1), np.asarray(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, paths: list) -> Paths:
        kept = [np.asarray(p, float).reshape(-1, 2).T for p in paths]
        return cls(np.concatenate([np.zeros((2, 0)), *kept], axis=1), np.array([p.shape[1] for p in kept], np.int64))

    def __len__(self) -> int:
        return len(self.sizes)

    def ending(self, value: float) -> Paths:
        """The same paths; what `padded` gives beyond the end of one is `value`."""
        out = Paths(self.xy[:, :-1], self.sizes)
        out.xy[:, -1] = value
        return out

    def padded(self, k: np.ndarray) -> np.ndarray:
        """(2, most points, lanes) of the paths k."""
        at = np.arange(self.sizes[k].max())[:, None]
        return self.xy[:, np.where(at < self.sizes[k], self.starts[k] + at, -1)]


def batches(m: np.ndarray, n: np.ndarray, algorithm: str, cells: int):
    """Numbers of pairs of like shape, batch by batch; pairs with an empty side come in none."""
    near = 1 if algorithm == "exact" else 8
    order = np.lexsort((n, m // near))
    order = order[(m[order] > 0) & (n[order] > 0)]
    if not len(order):
        return
    edges = np.append(np.flatnonzero(np.diff(m[order] // near)) + 1, len(order))

    def lanes(rows: int, cols: int) -> int:
        return max(1, min((100_000 // cols if algorithm == "exact" else 40_000) // cols, cells // (rows * cols)))

    at = 0
    for end in edges.tolist():
        rows = int(m[order[at:end]].max())
        while at < end:
            to = min(end, at + lanes(rows, int(n[order[at]])))
            to = min(to, at + lanes(rows, int(n[order[to - 1]])))
            yield order[at:to]
            at = to


def solve_pairs(q: Paths, d: Paths, qi: np.ndarray, di: np.ndarray, metric: str = "dtw", algorithm: str = "cma", eps: float = points.EPSILON, centre=points.CENTRE, strict: bool = False, delay: int = 10, cells: int = 3_000_000):
    """(start, end, distance) arrays for the pairs (q[qi], d[di]); pairs of like shape share a batch.

    Pairs with an empty side get (-1, -1, nan)."""
    if algorithm not in (*ALGORITHMS, "whole"):
        raise ValueError(f"no algorithm {algorithm!r}; there are {ALGORITHMS}")
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}; there are {METRICS}")
    m, n = q.sizes[qi], d.sizes[di]
    start, end, dist = np.full(len(m), -1), np.full(len(m), -1), np.full(len(m), np.nan)
    run = {"cma": cma, "exact": lambda *x: exact(*x, strict), "pss": pss, "pos": lambda *x: pos(*x, delay), "whole": lambda c, m, n, metric: (0, n - 1, whole(c, m, n, metric))}[algorithm]
    for k in batches(m, n, algorithm, cells):
        c = Costs(q.padded(qi[k]), d.padded(di[k]), metric, eps, centre)
        start[k], end[k], dist[k] = run(c, m[k], n[k], metric)
    return start, end, dist


#: Metrics whose least distance over all ranges, without the range, least_table has.
ONE_PASS = ("dtw", "fc", "edr", "lev")


def square_within(eps: float) -> float:
    """The largest number whose root is not over eps."""
    if eps < 0:
        return -1.0
    at = eps * eps
    while np.sqrt(at) > eps:
        at = np.nextafter(at, -1)
    while np.sqrt(np.nextafter(at, np.inf)) <= eps:
        at = np.nextafter(at, np.inf)
    return float(at)


def least_table(q: Paths, d: Paths, metric: str, eps: float = points.EPSILON, cells: int = 8_000) -> np.ndarray:
    """The distance of exact for all pairs of q and d: (len(q), len(d)), nan where a side is empty.

    A range may begin at any point, so one table of query x data has the least of all starts in each cell: rounding
    keeps the order of numbers, so the least of sums of one order is the same number.  The cells of a diagonal, which
    need those of the two before it only, advance together.  Only where all gaps cost 1 for edr and lev."""
    if metric not in ONE_PASS:
        raise ValueError(f"{metric!r} is none of {ONE_PASS}")
    out = np.full((len(q), len(d)), np.nan)
    some = np.flatnonzero(q.sizes)
    if not len(some):
        return out
    widest, within = int(q.sizes.max()), square_within(eps)
    order = np.argsort(d.sizes, kind="stable")
    order = order[d.sizes[order] > 0]
    step = max(16, cells // int(np.median(q.sizes[some])))
    for at in range(0, len(order), step):
        lane = order[at : at + step]
        sizes, n = d.sizes[lane], int(d.sizes[lane].max())
        ragged = None if (sizes == n).all() else sizes
        back = np.full((2, n + 2 * widest - 2, len(lane)), np.inf)  # the data from its end, so that a diagonal is one slice
        back[:, widest - 1 : widest - 1 + n] = d.padded(lane)[:, ::-1]
        for k in some.tolist():
            own = q.xy[:, q.starts[k] : q.starts[k] + q.sizes[k], None]
            out[k, lane] = _least_of_diagonals(own, back, n, n + widest - 2, ragged, metric, within)
    return np.sqrt(out) if metric == "fc" else out


def _least_of_diagonals(q, back, n: int, first: int, sizes, metric: str, within: float) -> np.ndarray:
    """The least of the last row, for fc its square; back[:, first - k + i] are the points that meet q[i] in diagonal k."""
    m, lanes, edits = q.shape[1], back.shape[2], metric in ("edr", "lev")
    kind = (np.uint8 if m < 250 else np.int32) if edits else float
    a, b, x = (np.full((m, lanes), m if edits else np.inf, kind) for _ in range(3))  # the diagonal before, that before it, this one
    b[0] = a[0] = 1 if edits else np.inf
    best = np.full(lanes, m if edits else np.inf, kind)
    dx, dy = np.empty((m, lanes)), np.empty((m, lanes))
    sub = np.empty((m, lanes), bool)
    for k in range(n + m - 1):
        points_ = back[:, first - k : first - k + m]
        np.subtract(q[0], points_[0], out=dx)
        np.subtract(q[1], points_[1], out=dy)
        if metric == "lev":
            np.not_equal(dx, 0, out=sub)
            sub |= dy != 0
        else:
            np.multiply(dx, dx, out=dx)
            np.multiply(dy, dy, out=dy)
            np.add(dx, dy, out=dx)
            if metric == "dtw":
                np.sqrt(dx, out=dx)
            elif edits:
                np.greater(dx, within, out=sub)
        x[0] = sub[0] if edits else dx[0]
        if m > 1:
            np.minimum(a[:-1], a[1:], out=x[1:])
            if edits:
                x[1:] += 1
                np.add(b[:-1], sub[1:], out=b[1:])
                np.minimum(x[1:], b[1:], out=x[1:])
            else:
                np.minimum(x[1:], b[:-1], out=x[1:])
                (np.add if metric == "dtw" else np.maximum)(x[1:], dx[1:], out=x[1:])
        if edits and k + 1 < m:
            x[k + 1] = k + 2  # no point of the data yet
        if (j := k - m + 1) >= 0:
            if sizes is None:
                np.minimum(best, x[-1], out=best)
            else:
                np.minimum(best, x[-1], out=best, where=sizes > j)
        a, b, x = x, a, b
    return best


def solve(q: list, d: list, metric: str = "dtw", algorithm: str = "cma", **options):
    """solve_pairs for two lists of (k, 2) arrays of one length."""
    k = np.arange(len(q))
    return solve_pairs(Paths.of(q), Paths.of(d), k, k, metric, algorithm, **options)


def count_better(q: list, d: list, dist, metric: str = "dtw", eps: float = points.EPSILON, centre=points.CENTRE, strict: bool = False, cells: int = 3_000_000) -> np.ndarray:
    """How many subtrajectories of d are closer to q than dist, for each pair; the starts of a pair are the lanes."""
    out = np.zeros(len(q), np.int64)
    band = points.BAND if metric == "lcss" else None
    for k in range(len(q)):
        m, n = len(q[k]), len(d[k])
        if not m or not n:
            continue
        c = Costs(np.asarray(q[k]).T[:, :, None], np.asarray(d[k]).T[:, :, None], metric, eps, centre)
        starts, step = np.arange(n - 1 if strict else n), max(1, cells // (m * n))
        for at in range(0, len(starts), step):
            place = np.arange(n)[:, None] + starts[at : at + step]
            inside, place = place < n, np.minimum(place, n - 1)
            lanes = place.shape[1]
            got = _prefix_rows(c.sub[:, place, 0], np.repeat(c.gq, lanes, axis=1), c.gd[place, 0], np.full(lanes, m), metric, band)
            out[k] += int(((got < dist[k]) & inside).sum())
    return out
