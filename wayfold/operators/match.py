"""Kernels as Arrow-batched functions over pairs of trajectories."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import points
from . import blocks, dtsm, kernels


def xs(pts: Column) -> Column:
    return F.transform(pts, lambda p: p["x"])


def ys(pts: Column) -> Column:
    return F.transform(pts, lambda p: p["y"])


def _paths(x: pd.Series, y: pd.Series) -> list[np.ndarray]:
    return [np.zeros((0, 2)) if a is None or len(a) == 0 else np.column_stack([a, b]).astype(float) for a, b in zip(x, y, strict=True)]


def best_subtraj_udf(metric: str = "dtw", algorithm: str = "cma", **options):
    """(qx, qy, dx, dy) -> struct(start, end, dist); ends are inclusive."""
    if metric not in kernels.METRICS or algorithm not in (*kernels.ALGORITHMS, "whole"):
        raise ValueError(f"{metric!r}, {algorithm!r}: metrics are {kernels.METRICS}, algorithms {kernels.ALGORITHMS}")

    @F.pandas_udf("start int, end int, dist double")
    def best(qx: pd.Series, qy: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.DataFrame:
        s, e, d = kernels.solve(_paths(qx, qy), _paths(dx, dy), metric, algorithm, **options)
        return pd.DataFrame({"start": s, "end": e, "dist": d})

    return best


def match(pairs: DataFrame, metric: str = "dtw", algorithm: str = "cma", q: str = "q_pts", d: str = "d_pts", **options) -> DataFrame:
    """pairs with start, end, dist of the closest subtrajectory of d to q."""
    best = best_subtraj_udf(metric, algorithm, **options)
    got = pairs.withColumn("r", best(xs(F.col(q)), ys(F.col(q)), xs(F.col(d)), ys(F.col(d))))
    return got.select(*pairs.columns, "r.start", "r.end", "r.dist")


def _near_gap(p: kernels.Paths, options: dict) -> bool:
    """Whether a point is so near the gap that leaving it out costs nothing (edr)."""
    gap = p.xy[:, :-1] - points.GAP
    return bool((np.sqrt((gap * gap).sum(axis=0)) <= options.get("eps", points.EPSILON)).any())


def match_all(queries: DataFrame, data: DataFrame, metric: str = "dtw", algorithm: str = "cma", k: int | None = None, chosen=None, ranges: bool = True, **options) -> DataFrame:
    """query_id, traj_id, start, end, dist (without ranges: query_id, traj_id, dist) of the eligible pairs (pairs.eligible) of queries (query_id, q_pts) and data (traj_id, pts).

    The pairs are made, matched and, with k, cut to each query's k best of a block by (dist, traj_id) where the
    blocks meet.  chosen(query rows, data rows): a matrix of the pairs that count, of all."""
    if metric not in kernels.METRICS or algorithm not in (*kernels.ALGORITHMS, "whole"):
        raise ValueError(f"{metric!r}, {algorithm!r}: metrics are {kernels.METRICS}, algorithms {kernels.ALGORITHMS}")

    def run(left, right):
        q, d, qid, tid = blocks.paths(left), blocks.paths(right), blocks.column(left, "id"), blocks.column(right, "id")
        pick = (qid[:, None] != tid) & (d.sizes > q.sizes[:, None])
        if chosen is not None:
            pick &= chosen(left, right)
        every = max(1, 200_000 // max(1, len(d)))
        table = one_pass and pick.mean() > 0.5 and (metric != "edr" or not (_near_gap(q, options) or _near_gap(d, options)))
        for at in range(0, len(q), every):
            qi, di = np.nonzero(pick[at : at + every])
            if table:
                some = kernels.Paths(q.xy[:, q.starts[at] : q.starts[at] + int(q.sizes[at : at + every].sum())], q.sizes[at : at + every])
                yield {"query_id": qid[qi + at], "traj_id": tid[di], "dist": kernels.least_table(some, d, metric, **options)[qi, di]}
                continue
            qi += at
            start, end, dist = kernels.solve_pairs(q, d, qi, di, metric, algorithm, **options)
            if k is not None:
                own = blocks.best_of(qi, dist, tid[di], k)
                qi, di, start, end, dist = qi[own], di[own], start[own], end[own], dist[own]
            yield {"query_id": qid[qi], "traj_id": tid[di], "start": start, "end": end, "dist": dist}

    one_pass = not ranges and k is None and algorithm == "exact" and metric in kernels.ONE_PASS and set(options) <= {"eps"}
    q = queries if "id" in queries.columns else blocks.flat(queries, "query_id", "q_pts")
    d = data if "id" in data.columns else blocks.flat(data, "traj_id", "pts")
    return blocks.met(q, d, run, "query_id long, traj_id long, start int, end int, dist double" if ranges else "query_id long, traj_id long, dist double")


def rank_counts(pairs: DataFrame, metric: str = "dtw", strict: bool = False, **options) -> DataFrame:
    """pairs (q_pts, d_pts, dist) with AR, MR, RR: the distance, its rank among all subtrajectories, and that over their number."""

    @F.pandas_udf("long")
    def better(qx: pd.Series, qy: pd.Series, dx: pd.Series, dy: pd.Series, dist: pd.Series) -> pd.Series:
        return pd.Series(kernels.count_better(_paths(qx, qy), _paths(dx, dy), dist.to_numpy(), metric, strict=strict, **options))

    n = F.size("d_pts")
    got = pairs.withColumn("mr", better(xs(F.col("q_pts")), ys(F.col("q_pts")), xs(F.col("d_pts")), ys(F.col("d_pts")), "dist") + 1)
    return got.withColumns({"ar": F.col("dist"), "rr": F.col("mr") / (n * (n + 1) / 2)})


SCORE = ["dist", "s1", "e1", "s2", "e2"]
#: Bytes of packed lists that a task sorts, about.
LISTS = 16 << 20


#: An entry of a packed list of scores.
ENTRY = np.dtype([("dst", "<i8"), ("score", "<i4"), ("s", "<i4"), ("e", "<i4")])


def _greedy_pairs(left, right, eps: float):
    """Of two blocks, batch by batch: ids of both, and the numbers (rows of left, rows of right) and scores of the pairs with a < b."""
    a, b, ia, ib = blocks.paths(left), blocks.paths(right), blocks.column(left, "id"), blocks.column(right, "id")
    every = max(1, 200_000 // max(1, len(b)))
    for at in range(0, len(a), every):
        i, j = np.nonzero(ia[at : at + every, None] < ib)
        i += at
        yield ia, ib, i, j, dtsm.walks(a, b, i, j, eps)


def greedy_scores(traj: DataFrame, eps: float = points.EPSILON) -> DataFrame:
    """a, b, dist, s1, e1, s2, e2: the greedy score (best) of all pairs with a < b of trajectories (traj_id, pts)."""

    def run(left, right):
        for ia, ib, i, j, found in _greedy_pairs(left, right, eps):
            yield {"a": ia[i], "b": ib[j]} | dict(zip(SCORE, found, strict=True))

    t = blocks.flat(traj, "traj_id", "pts")
    return blocks.met(t, t, run, "a long, b long, dist double, s1 int, e1 int, s2 int, e2 int")


def greedy_lists(traj: DataFrame, eps: float, chosen) -> DataFrame:
    """src, rank, dst, dist, s, e: of all others of a trajectory, by (dist, dst), the places that chosen(their number) gives, numbered anew.

    dist, s and e are those of greedy_scores, s and e the range of dst.  A block sends each trajectory its scores
    as one packed row, and a list is sorted where its rows meet."""

    def run(left, right):
        for ia, ib, i, j, (dist, s1, e1, s2, e2) in _greedy_pairs(left, right, eps):
            for src, own, dst, s, e in ((ia, i, ib[j], s2, e2), (ib, j, ia[i], s1, e1)):
                order = np.argsort(own, kind="stable")
                rows = np.empty(len(order), ENTRY)
                for name, v in (("dst", dst), ("score", -dist), ("s", s), ("e", e)):
                    rows[name] = v[order]
                edges = np.flatnonzero(np.diff(own[order], prepend=-1))
                ends = pa.array(np.append(edges, len(order)) * ENTRY.itemsize, pa.int32())
                yield {"src": src[own[order[edges]]], "list": pa.BinaryArray.from_buffers(pa.binary(), len(edges), [None, ends.buffers()[1], pa.py_buffer(rows)])}

    def rank(batches):
        for batch in batches:
            for src, lists in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(b"".join(x.as_py() for x in lists.values), ENTRY)
                rows = rows[np.lexsort((rows["dst"], -rows["score"]))]
                rows = rows[chosen(len(rows))]
                columns = (np.full(len(rows), src), np.arange(len(rows), dtype=np.int32), rows["dst"], -rows["score"].astype(float), rows["s"], rows["e"])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["src", "rank", "dst", "dist", "s", "e"])

    t = blocks.flat(traj, "traj_id", "pts")
    n = t.count()
    tasks = max(int(traj.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * n * ENTRY.itemsize // LISTS)
    packed = blocks.met(t, t, run, "src long, list binary").repartition(min(n, tasks) or 1, "src")
    return packed.groupBy("src").agg(F.collect_list("list").alias("lists")).mapInArrow(rank, "src long, rank int, dst long, dist double, s int, e int")


def greedy_links(links: DataFrame, traj: DataFrame, eps: float = points.EPSILON) -> DataFrame:
    """src, dst, dist, s1, e1, s2, e2: the greedy score (best) of the pairs (src, dst) of links."""

    def run(left, right):
        a, b, ia, ib = blocks.paths(left), blocks.paths(right), blocks.column(left, "id"), blocks.column(right, "id")
        dst, n = blocks.lists(left, "dst")
        order = np.argsort(ib, kind="stable")
        place = np.minimum(np.searchsorted(ib[order], dst), max(0, len(ib) - 1))
        there = ib[order][place] == dst
        i, j = np.repeat(np.arange(len(a)), n)[there], order[place[there]]
        yield {"src": ia[i], "dst": ib[j]} | dict(zip(SCORE, dtsm.walks(a, b, i, j, eps), strict=True))

    t = blocks.flat(traj, "traj_id", "pts")
    own = t.join(links.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("dst")), "id")
    return blocks.met(own, t, run, "src long, dst long, dist double, s1 int, e1 int, s2 int, e2 int")


def greedy_score(pairs: DataFrame, eps: float = points.EPSILON, scoring: str = "best", a: str = "a_pts", b: str = "b_pts") -> DataFrame:
    """pairs with dist, s1, e1, s2, e2 of the greedy score between two trajectories (dtsm.py)."""

    @F.pandas_udf("dist double, s1 int, e1 int, s2 int, e2 int")
    def score(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.DataFrame:
        if scoring == "best":
            k = np.arange(len(ax))
            got = dtsm.walks(kernels.Paths.of(_paths(ax, ay)), kernels.Paths.of(_paths(bx, by)), k, k, eps)
            return pd.DataFrame(dict(zip(SCORE, got, strict=True))).astype(dict.fromkeys(SCORE[1:], "int32"))
        return pd.DataFrame([dtsm.walk(p, q, eps, scoring) for p, q in zip(_paths(ax, ay), _paths(bx, by), strict=True)], columns=SCORE)

    got = pairs.withColumn("r", score(xs(F.col(a)), ys(F.col(a)), xs(F.col(b)), ys(F.col(b))))
    return got.select(*pairs.columns, "r.*")


def subtraj_pairs(pairs: DataFrame, metric: str, algorithm: str = "cma", a: str = "a_pts", b: str = "b_pts", **options) -> DataFrame:
    """pairs with the least distance over all subtrajectories of a and of b, and both ranges."""

    @F.pandas_udf("dist double, s1 int, e1 int, s2 int, e2 int")
    def least(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dtsm.least_of(_paths(ax, ay), _paths(bx, by), metric, algorithm, **options), columns=["dist", "s1", "e1", "s2", "e2"])

    got = pairs.withColumn("r", least(xs(F.col(a)), ys(F.col(a)), xs(F.col(b)), ys(F.col(b))))
    return got.select(*pairs.columns, "r.*")


def register(spark: SparkSession, **options) -> None:
    """SQL functions best_subtraj_<metric>_<algorithm>, traj_dist_<metric>, each of (qx, qy, dx, dy)."""
    for metric in kernels.METRICS:
        spark.udf.register(f"traj_dist_{metric}", best_subtraj_udf(metric, "whole", **options))
        for algorithm in kernels.ALGORITHMS:
            spark.udf.register(f"best_subtraj_{metric}_{algorithm}", best_subtraj_udf(metric, algorithm, **options))
