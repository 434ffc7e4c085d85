"""Top-k queries: plain, pruned, by batch, and the ground truth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import stash
from . import blocks, clean, pairs
from .match import match, match_all, rank_counts


def ranked(matches: DataFrame, k: int | None) -> DataFrame:
    """matches with their rank for each query, by (dist, traj_id); only the first k leave a task."""
    got = matches.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "traj_id")))
    return got if k is None else got.filter(F.col("rank") <= k)


def brute(queries: DataFrame, data: DataFrame, k: int | None, metric: str = "dtw", algorithm: str = "cma", **options) -> DataFrame:
    """query_id, rank, traj_id, start, end, dist over all eligible pairs (k None: the full order)."""
    return ranked(match_all(queries, data, metric, algorithm, k, **options), k).select("query_id", "rank", "traj_id", "start", "end", "dist")


def pruned(queries: DataFrame, data: DataFrame, k: int, metric: str = "dtw", algorithm: str = "cma", key_num: int = 10, **options) -> DataFrame:
    """brute, leaving out pairs whose key-point bound reaches the k-th distance.

    The k pairs of least bound are matched first; their largest distance is the threshold
    that the others' bounds must be under.  The bound is heuristic, as in the method."""
    costs = {x: options[x] for x in ("eps", "centre") if x in options and (x == "centre") == (metric == "erp")}

    def bounds(left, right):
        q, d, qid, tid = blocks.paths(left), blocks.paths(right), blocks.column(left, "id"), blocks.column(right, "id")
        pick = (qid[:, None] != tid) & (d.sizes > q.sizes[:, None]) & (q.sizes[:, None] > 0)
        return q, qid, tid, *np.nonzero(pick), d

    def least(left, right):
        q, qid, tid, qi, di, d = bounds(left, right)
        bound = pairs.key_bounds(q, d, qi, di, key_num, metric, **costs)
        own = blocks.best_of(qi, bound, tid[di], k)
        yield {"query_id": qid[qi[own]], "traj_id": tid[di[own]], "bound": bound[own]}

    def under(left, right):
        """Pairs whose bound is under the limit of their query, without those that were matched first."""
        q, qid, tid, qi, di, d = bounds(left, right)
        full = blocks.column(left, "n")[qi] >= k
        limit = np.where(full, blocks.column(left, "limit")[qi], np.inf)
        some = ~full
        some[full] = pairs.key_bounds(q, d, qi[full], di[full], key_num, metric, **costs) < limit[full]
        out = np.zeros((len(q), len(d)), bool)
        out[qi[some], di[some]] = True
        gone, sizes = blocks.lists(left, "matched")
        edge = np.concatenate([[0], np.cumsum(sizes)])
        for i in range(len(q)):
            out[i, np.isin(tid, gone[edge[i] : edge[i + 1]])] = False
        return out

    q, d = blocks.flat(queries, "query_id", "q_pts"), blocks.flat(data, "traj_id", "pts")
    first = blocks.met(q, d, least, "query_id long, traj_id long, bound double")
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("bound", "traj_id"))).filter(F.col("r") <= k)
    full = stash(first.select("query_id", "traj_id"), "least-bounds").join(queries.select("query_id", "q_pts"), "query_id").join(data.select("traj_id", F.col("pts").alias("d_pts")), "traj_id")
    seeds = stash(match(full, metric, algorithm, **options).select("query_id", "traj_id", "start", "end", "dist"), "seeds")
    limit = seeds.groupBy(F.col("query_id").alias("id")).agg(F.max("dist").alias("limit"), F.count(F.lit(1)).alias("n"), F.collect_set("traj_id").alias("matched"))
    more = match_all(q.join(limit, "id"), d, metric, algorithm, k, under, **options)
    return ranked(seeds.unionByName(more), k).select("query_id", "rank", "traj_id", "start", "end", "dist")


def batch(queries: DataFrame, data: DataFrame, k: int, metric: str = "dtw", algorithm: str = "cma", gather: str = "gridbase", key_num: int = 10, rate: float = 0.6, origin=(0.0, 0.0), size: float = 1e-4, filter_num: int = 3, **options) -> DataFrame:
    """Many queries at once: candidates by grid coverage, key-point bound, both or none, then top-k with AR, MR, RR."""
    if gather not in ("gridbase", "keyfilter", "both", "none"):
        raise ValueError(f"no way {gather!r} to gather candidates")
    if gather in ("gridbase", "none"):
        chosen = None if gather == "none" else lambda left, right: pairs.covered(left, right, key_num, rate, origin, size)
        best = stash(ranked(match_all(queries, data, metric, algorithm, k, chosen, **options), k), "best")
        best = best.join(queries.select("query_id", "q_pts"), "query_id").join(data.select("traj_id", F.col("pts").alias("d_pts")), "traj_id")
        spark = queries.sparkSession
        best = best.repartition(4 * spark.sparkContext.defaultParallelism, "query_id", "traj_id")  # few rows of much work
        return rank_counts(best, metric, **options).select("query_id", "rank", "traj_id", "start", "end", "dist", "ar", "mr", "rr")
    cand = pairs.eligible(queries, data)
    if gather == "both":
        cand = cand.join(pairs.grid_coverage(queries, clean.points_of(data), key_num, rate, origin, size).select("query_id", "traj_id"), ["query_id", "traj_id"], "left_semi")
    cand = stash(cand.withColumn("bound", pairs.key_bound(F.col("q_pts"), F.col("d_pts"), filter_num, metric, truncate=False)), "bounds")
    first = cand.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("bound", "traj_id"))).filter(F.col("r") <= k)
    limit = match(first, metric, algorithm, **options).groupBy("query_id").agg(F.max("dist").alias("limit"))
    cand = cand.join(limit, "query_id").filter(F.col("bound") <= F.col("limit")).drop("bound", "limit")
    best = ranked(match(cand, metric, algorithm, **options), k)
    return rank_counts(best, metric, **options).select("query_id", "rank", "traj_id", "start", "end", "dist", "ar", "mr", "rr")


def representatives(top: DataFrame, queries: DataFrame, data: DataFrame) -> DataFrame:
    """top with the subtrajectory, the whole trajectory and the query."""
    got = top.join(data.select("traj_id", F.col("pts").alias("full")), "traj_id").join(queries.select("query_id", "q_pts"), "query_id")
    return got.withColumn("sub", clean.part(F.col("full"), F.col("start"), F.col("end")))


def farthest_nodes(dist: DataFrame, seed_node: int, n_near: int, count: int) -> list[int]:
    """Nodes picked one by one: drop the n_near nearest of the last, take the farthest of what is left.

    dist (a, b, dist) is a table among representatives; each step collects n_near rows of it and one."""
    picked, gone = [seed_node], {seed_node}
    while len(picked) < count:
        rows = dist.filter((F.col("a") == picked[-1]) & ~F.col("b").isin(*gone))
        gone |= {r.b for r in rows.orderBy("dist", "b").select("b").limit(n_near).collect()}
        left = [r.b for r in rows.filter(~F.col("b").isin(*gone)).orderBy(F.desc("dist"), F.desc("b")).select("b").limit(1).collect()]
        if not left:
            break
        picked.append(left[-1])
        gone.add(left[-1])
    return picked
