"""Scores between two data trajectories: a greedy walk over their match matrix, and exhaustive minima."""

from __future__ import annotations

import numpy as np

from . import kernels


def walk(a: np.ndarray, b: np.ndarray, eps: float, scoring: str = "best") -> tuple[float, int, int, int, int]:
    """(-score, s1, e1, s2, e2); (0, -1, -1, -1, -1) where no points match.

    From each start all walks advance together.  On a match a walk goes to the diagonal if
    that matches too (+2), else to the better of right and down (-1); on a mismatch it goes
    to a match on the right or below (+3) or on the diagonal (+2), else right (-1).  It ends at
    an edge or when nothing is left of its score.  scoring `best` starts at matches and counts the
    best point of the way, `last` starts anywhere and counts the end."""
    if not len(a) or not len(b):
        return 0.0, -1, -1, -1, -1
    far = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    hit = far <= eps
    i, j = (x.astype(np.int64) for x in (np.nonzero(hit) if scoring == "best" else np.indices(hit.shape).reshape(2, -1)))
    if not hit.any():
        return 0.0, -1, -1, -1, -1
    si, sj = i.copy(), j.copy()
    total = np.full(len(i), 2)
    best, bi, bj = total.copy(), i.copy(), j.copy()
    live = (i < len(a) - 1) & (j < len(b) - 1)
    while live.any():
        k = np.flatnonzero(live)
        y, x = i[k], j[k]
        here, diag, right, down = hit[y, x], hit[y + 1, x + 1], hit[y, x + 1], hit[y + 1, x]
        on_diag = np.where(here, diag, ~right & ~down & diag)
        on_down = np.where(here, ~diag & ~right & down, ~right & down)
        gain = np.where(here, np.where(diag, 2, -1), np.where(right | down, 3, np.where(diag, 2, -1)))
        i[k] = y + (on_diag | on_down)
        j[k] = x + ~on_down
        total[k] += gain
        up = k[total[k] > best[k]] if scoring == "best" else k
        best[up], bi[up], bj[up] = total[up], i[up], j[up]
        live[k] = (total[k] > 0) & (i[k] < len(a) - 1) & (j[k] < len(b) - 1)
    at = int(best.argmax())
    return -float(best[at]), int(si[at]), int(bi[at]), int(sj[at]), int(bj[at])


#: Rows and columns of a match matrix up to which scores fit a byte; pairs that advance together in bytes.
BYTE, LANES = 250, 512


def walks(a: kernels.Paths, b: kernels.Paths, ai: np.ndarray, bi: np.ndarray, eps: float, cells: int = 60_000, lanes: int = LANES):
    """(-score, s1, e1, s2, e2) arrays of walk with scoring `best` for the pairs (a[ai], b[bi]), which are the lanes of batches.

    The way on depends on the place alone, and of two walks that meet the one with more of its score, or of equal ones the
    one that started first, is the better from there on.  So a cell keeps one: its score and, where scores don't fit a byte,
    its start as one number."""
    out = np.zeros((5, len(ai)))
    out[1:] = -1
    m, n = a.sizes[ai], b.sizes[bi]
    order = np.lexsort((n, m))
    order = order[(m[order] > 0) & (n[order] > 0)]
    edges = np.append(np.flatnonzero(np.diff(m[order])) + 1, len(order)).tolist() if len(order) else []
    held, ends = _Bytes(), (a.ending(np.inf), b.ending(-np.inf))  # what lies beyond a path is near nothing
    at, wide = 0, [np.zeros(0, np.int64)]
    for edge in edges:  # a batch has one number of rows
        while at < edge:
            k = order[at : min(edge, at + lanes)]
            at += len(k)
            if int(m[k[0]]) + int(n[k[-1]]) > BYTE or len(k) < lanes // 16:
                wide.append(k)
            else:
                with np.errstate(invalid="ignore"):
                    out[:, k] = _byte_walks(ends[0].padded(ai[k]), ends[1].padded(bi[k]), n[k], eps, held)
    order = np.concatenate(wide)
    order, at = order[np.lexsort((n[order], m[order] // 8))], 0
    while at < len(order):
        k = order[at : at + max(1, cells // int(n[order[at : at + cells]].max()))]
        at += len(k)
        out[:, k] = _walks(a.padded(ai[k]), b.padded(bi[k]), m[k], n[k], eps)
    return out


class _Bytes:
    """Bytes that batches use one after the other."""

    def __init__(self):
        self.data, self.at = np.empty(0, np.uint8), 0

    def begin(self, size: int) -> None:
        if len(self.data) < size:
            self.data = np.empty(size, np.uint8)
        self.at = 0

    def take(self, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        self.at += size
        return self.data[self.at - size : self.at].reshape(shape)


def _near(a: np.ndarray, b: np.ndarray, eps: float):
    """near(rows, rows, out): whether the points a[:, rows] and b[:, rows] of all lanes are within eps.

    Single precision decides where its error cannot matter, else double precision."""
    within = kernels.square_within(eps)
    most = max(np.abs(x[np.isfinite(x)]).max(initial=0) for x in (a, b))
    off = 2.0**-23 * (most + eps)  # the error of a difference that counts
    slack = 1.25 * (np.sqrt(8 * within) * off + 2 * off * off) + 2.0**-20 * within
    small = not (np.isnan(a).any() or np.isnan(b).any()) and most < 1e15 and 1e-30 < 100 * slack < within
    b = np.ascontiguousarray(b)
    c, d = (x.astype(np.float32) if small else x for x in (a, b))
    low, high = (np.float32(within - slack), np.float32(within + slack)) if small else (within, within)
    one, two = np.empty((2, c.shape[1], c.shape[2]), c.dtype)
    maybe = np.empty(one.shape, bool)

    def near(i: slice, j: slice, out: np.ndarray) -> None:
        size = i.stop - i.start
        x, y, open_ = one[:size], two[:size], maybe[:size]
        np.subtract(c[0, i], d[0, j], out=x)
        np.multiply(x, x, out=x)
        np.subtract(c[1, i], d[1, j], out=y)
        np.multiply(y, y, out=y)
        np.add(x, y, out=x)
        np.less_equal(x, low, out=out)
        if not small:
            return
        np.less_equal(x, high, out=open_)
        if np.count_nonzero(out) != np.count_nonzero(open_):
            k = np.flatnonzero(out != open_)
            e, f = (p[i].reshape(-1)[k] - q[j].reshape(-1)[k] for p, q in zip(a, b, strict=True))
            out.reshape(-1)[k] = e * e + f * f <= within

    return near


def _byte_walks(a: np.ndarray, b: np.ndarray, n: np.ndarray, eps: float, held: _Bytes) -> np.ndarray:
    """walks of pairs whose first paths all have the same number of points, an antidiagonal of cells after the other.

    First each cell gets the best score of the walks that come to it.  Then, from the last antidiagonal back, the cells are marked from which
    the best score of all is reached by moves that carry the best score of where they lead; the first start among
    them is that of the walk.  True is 255; entry i of an antidiagonal is its cell in row i."""
    rows, cols, lanes = a.shape[1], b.shape[1], a.shape[2]
    steps, high = rows + cols - 1, rows + 2
    held.begin(((2 * steps + 2) * high + 22 * high + cols) * lanes)
    score, code = held.take(steps + 2, high, lanes), held.take(steps, high, lanes)
    hits, misses, starts, rights, downs, diags = held.take(6, 3, high, lanes)
    best, x, y = held.take(3, high, lanes)
    inner = held.take(cols, lanes)  # not in the last column, whose cells count from the last to the first
    inner[:] = np.where(np.arange(cols)[::-1, None] < n - 1, 255, 0)
    near = _near(a, b[:, ::-1], eps)
    spans = [(max(0, d - cols + 1), min(rows, d + 1)) for d in range(steps)]
    for t in (rights, downs, diags, best, score[:2]):
        t[:] = 0

    def compare(d: int) -> None:
        if d < steps:
            lo, hi = spans[d]
            h = hits[d % 3, lo:hi]
            near(slice(lo, hi), slice(cols - 1 - d + lo, cols - 1 - d + hi), h.view(bool))
            np.negative(h, out=h)
            np.invert(h, out=misses[d % 3, lo:hi])

    def judge(d: int) -> None:
        """1, 2, 4: the move to the right, down, diagonal carries the best score of where it leads (or nothing); 8: a walk from here has the best."""
        lo, hi = spans[d]
        c, u, k = code[d, lo:hi], x[lo:hi], d % 3
        np.equal(rights[k, lo:hi], score[d + 1, lo:hi], out=c.view(bool))
        np.equal(downs[k, lo:hi], score[d + 1, lo + 1 : hi + 1], out=u.view(bool))
        np.add(u, u, out=u)
        np.bitwise_or(c, u, out=c)
        for bit, one, other in ((4, diags[k, lo:hi], score[d + 2, lo + 1 : hi + 1]), (8, starts[k, lo:hi], score[d, lo:hi])):
            np.equal(one, other, out=u.view(bool))
            np.negative(u, out=u)
            np.bitwise_and(u, bit, out=u)
            np.bitwise_or(c, u, out=c)

    compare(0)
    compare(1)
    for d, (lo, hi) in enumerate(spans):
        compare(d + 2)
        k, k1, k2 = d % 3, (d + 1) % 3, (d + 2) % 3
        s, start = score[d, lo:hi], starts[k, lo:hi]
        np.bitwise_and(hits[k, lo:hi], 2, out=start)
        np.maximum(s, start, out=s)
        np.maximum(best[lo:hi], s, out=best[lo:hi])
        if d >= 2:
            judge(d - 2)
        up = min(hi, rows - 1)  # nothing leaves the last row
        s, u, v = score[d, lo:up], x[lo:up], y[lo:up]
        right, down, diag = hits[k1, lo:up], hits[k1, lo + 1 : up + 1], hits[k2, lo + 1 : up + 1]
        to_right, to_down, to_diag = rights[k, lo:up], downs[k, lo:up], diags[k, lo:up]
        np.bitwise_and(down, inner[cols - 1 - d + lo : cols - 1 - d + up], out=to_down)
        np.bitwise_or(right, to_down, out=u)
        np.bitwise_and(u, misses[k, lo:up], out=u)  # to a match on the right or below: 3
        np.invert(u, out=v)
        np.bitwise_and(v, diag, out=to_diag)
        np.bitwise_or(right, to_diag, out=v)
        np.invert(v, out=v)
        np.bitwise_and(to_down, v, out=to_down)
        np.bitwise_and(u, 4, out=u)
        np.bitwise_and(to_diag, 3, out=v)
        np.add(u, v, out=u)
        np.add(u, s, out=u)
        np.subtract(u, 1, out=u)
        np.greater(s, 0, out=v.view(bool))
        np.negative(v, out=v)
        np.bitwise_and(u, v, out=u)  # the score that goes on
        np.bitwise_and(to_diag, u, out=to_diag)
        np.bitwise_and(to_down, u, out=to_down)
        np.subtract(u, to_diag, out=to_right)
        np.subtract(to_right, to_down, out=to_right)
        one, two = score[d + 1], score[d + 2]
        np.maximum(one[lo:up], to_right, out=one[lo:up])
        np.maximum(one[lo + 1 : up + 1], to_down, out=one[lo + 1 : up + 1])
        two[lo], two[up + 1 : hi + 2] = 0, 0
        two[lo + 1 : up + 1] = to_diag
    for d in range(max(0, steps - 2), steps):
        judge(d)
    most = best[:rows].max(axis=0)
    on, first = hits, best  # cells of a best walk; for each row the antidiagonal of its first start
    on[:], first[:] = 0, 255
    for d in range(steps - 1, -1, -1):
        lo, hi = spans[d]
        u, v, c = x[lo:hi], y[lo:hi], code[d, lo:hi]
        now, one, two = on[d % 3, lo:hi], on[(d + 1) % 3], on[(d + 2) % 3]
        np.bitwise_and(one[lo:hi], 1, out=u)
        np.bitwise_and(one[lo + 1 : hi + 1], 2, out=v)
        np.bitwise_or(u, v, out=u)
        np.bitwise_and(two[lo + 1 : hi + 1], 4, out=v)
        np.bitwise_or(u, v, out=u)
        np.bitwise_and(u, c, out=u)
        np.greater(u, 0, out=u.view(bool))
        np.equal(score[d, lo:hi], most, out=v.view(bool))
        np.bitwise_or(u, v, out=u)
        np.negative(u, out=now)
        np.bitwise_and(c, 8, out=u)
        np.bitwise_and(u, now, out=u)
        np.equal(u, 0, out=u.view(bool))
        np.negative(u, out=u)
        np.bitwise_or(u, np.uint8(d), out=u)
        np.minimum(first[lo:hi], u, out=first[lo:hi])
    out = np.empty((5, lanes))
    out[0], out[1:] = 0, -1
    lane = np.flatnonzero(most)
    i = (first[:rows, lane] < 255).argmax(axis=0)
    j = first[i, lane].astype(np.int64) - i
    out[0, lane], out[1, lane], out[3, lane] = -most[lane].astype(float), i, j
    scores, codes, layer = score.reshape(-1), code.reshape(-1), high * lanes
    at, want = (i + j) * layer + i * lanes + lane, most[lane]
    while len(lane):  # from its start each walk goes to the first place that has the best score
        end = scores[at] == want
        if end.any():
            place = at[end] // lanes
            out[2, lane[end]], out[4, lane[end]] = place % high, place // high - place % high
            at, lane, want = at[~end], lane[~end], want[~end]
        c = codes[at]
        to_diag = (c & 4 > 0) & (scores[at + 2 * layer + lanes] > 0)
        to_down = (c & 2 > 0) & (scores[at + layer + lanes] > 0) & ~to_diag
        at = at + layer + np.where(to_diag, layer + lanes, to_down * lanes)
    return out


def _walks(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, eps: float) -> np.ndarray:
    rows, cols, lanes = a.shape[1], b.shape[1], a.shape[2]
    unit = 1 << int(rows * cols).bit_length()  # a number is score * unit + unit - 1 - place of the start
    kind = np.int32 if (2 + 3 * (rows + cols)) * unit < 1 << 30 else np.int64
    dx, dy = np.empty((2, cols, lanes))
    inside, inner = np.arange(cols)[:, None] < n, np.arange(cols)[:, None] < n - 1
    hit, below = np.zeros((2, cols + 1, lanes), bool)

    def matches(i: int, into: np.ndarray) -> None:
        into[:] = False
        if i < rows:
            np.subtract(a[0, i], b[0], out=dx)
            np.subtract(a[1, i], b[1], out=dy)
            np.multiply(dx, dx, out=dx)
            np.multiply(dy, dy, out=dy)
            np.add(dx, dy, out=dx)
            np.less_equal(np.sqrt(dx, out=dx), eps, out=into[:cols])
            into[:cols] &= inside
            into[:cols] &= i < m

    matches(0, below)
    score, came = np.zeros((2, cols + 1, lanes), kind)
    best, found = np.zeros(lanes, kind), np.zeros(lanes, np.int64)
    alive = np.empty(lanes, bool)
    on = np.empty(lanes, kind)
    for i in range(rows):
        hit, below = below, hit
        matches(i + 1, below)
        here, right, down, diag = hit[:cols], hit[1:], below[:cols], below[1:]
        side = right | down
        to_diag = diag & (here | ~side)
        to_down = down & ~right & ~(here & diag)
        gain = ((~here & side).astype(kind) * 4 + to_diag.astype(kind) * 3 - 1) * unit
        moves = inner & (i < m - 1)
        to_right = np.where(moves & ~to_diag & ~to_down, gain, kind(-(1 << 30)))
        now = score[:cols]
        np.maximum(came[:cols], here * (3 * unit - 1 - (i * cols + np.arange(cols, dtype=kind)))[:, None], out=now)
        for j in range(1, cols):
            np.greater_equal(now[j - 1], unit, out=alive)
            np.add(now[j - 1], to_right[j - 1], out=on)
            np.multiply(on, alive, out=on)
            np.maximum(now[j], on, out=now[j])
        most = now.max(axis=0)
        better = np.flatnonzero(most > best)
        if len(better):
            best[better] = most[better]
            found[better] = i * cols + now[:, better].argmax(axis=0)
        gone = np.where(moves & (now >= unit), now + gain, 0)
        came[:cols] = gone * to_down
        np.maximum(came[1:], gone * to_diag, out=came[1:])
        came[cols] = 0
    any_ = best > 0
    start = unit - 1 - best % unit
    return np.where(any_, np.stack([-(best // unit).astype(float), start // cols, found // cols, start % cols, found % cols]), np.array([0.0, -1, -1, -1, -1])[:, None])


def least(a: np.ndarray, b: np.ndarray, metric: str, algorithm: str = "cma", **options) -> tuple[float, int, int, int, int]:
    """The least distance over subtrajectories of a and of b, with the first ranges that reach it.  For short trajectories."""
    return least_of([a], [b], metric, algorithm, **options)[0]


def least_of(a: list[np.ndarray], b: list[np.ndarray], metric: str, algorithm: str = "cma", most: int = 20_000, **options) -> list[tuple[float, int, int, int, int]]:
    """least of each pair; about `most` ranges are matched at once."""
    out, at = [], 0
    while at < len(a):
        ranges, bounds = [], [0]
        while at + len(bounds) - 1 < len(a) and (len(bounds) == 1 or len(ranges) < most):
            k = at + len(bounds) - 1
            if len(b[k]):
                ranges += [(k, s, e) for s in range(len(a[k])) for e in range(s, len(a[k]))]
            bounds.append(len(ranges))
        if ranges:
            start, end, dist = kernels.solve([a[k][s : e + 1] for k, s, e in ranges], [b[k] for k, _, _ in ranges], metric, algorithm, **options)
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if lo == hi:
                out.append((float("nan"), -1, -1, -1, -1))
            else:
                best = lo + int(np.argmin(dist[lo:hi]))
                out.append((float(dist[best]), *ranges[best][1:], int(start[best]), int(end[best])))
        at += len(bounds) - 1
    return out
