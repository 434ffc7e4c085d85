"""A two-layer proximity graph in three tables, and greedy search over it.

edge (src, rank, dst, dist, s, e), top_node (traj_id), top_edge (src, rank, dst, dist, s, e).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.shared import all_pairs, brief_shuffles, drop, stash
from . import pairs
from .match import greedy_links, greedy_lists, match


def bottom(traj: DataFrame, k: int, n_near: int, origin: tuple[float, float], size: float, eta: float, eps: float, seed: int = 7) -> DataFrame:
    """edge: for each trajectory the k best scored of its candidates: nearest boxes that also pass cells and eta, padded to k."""
    with brief_shuffles(traj.sparkSession):
        near = stash(pairs.nearest_boxes(traj, traj, n_near), "nearest")
        survivors = stash(pairs.cover_all(traj, origin, size, eta, near), "survivors")
        links = stash(pairs.padded(survivors, near, k, seed), "padded")
    drop(near, survivors)
    w = Window.partitionBy("src").orderBy("dist", "dst", "s2", "e2")
    got = greedy_links(links, traj, eps).withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)
    return got.select("src", "rank", "dst", "dist", F.col("s2").alias("s"), F.col("e2").alias("e"))


def cell_representatives(traj: DataFrame, cells: int) -> DataFrame:
    """traj_id of the trajectories that fit into a cell of the grid over all data, or, where none
    fits, into the cell grown by the fewest tenths."""
    e = pairs.extent(traj, cells).first()  # one row
    origin, size = (e.min_x, e.min_y), (e.size_x, e.size_y)
    frames = traj.sparkSession.range(cells * cells).select((F.col("id") % cells).cast("int").alias("gx"), F.floor(F.col("id") / cells).cast("int").alias("gy"))
    frames = frames.withColumn("frame", g.cell_box(F.col("gx"), F.col("gy"), origin, size))
    boxes = traj.select("traj_id", g.mbr(F.col("pts")).alias("box"))
    f = F.greatest(F.lit(1.0), F.ceil(g.fitting_factor(F.col("box"), F.col("frame")) * 10) / 10)
    fits = all_pairs(frames, boxes, F.lit(True)).select("gx", "gy", "traj_id", f.alias("f"))
    least = fits.groupBy("gx", "gy").agg(F.min("f").alias("f"))
    return fits.join(least, ["gx", "gy", "f"]).select("traj_id").distinct()


def top(traj: DataFrame, cells: int, eps: float, ratio: float = 0.8, portions: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> tuple[DataFrame, DataFrame]:
    """(top_node, top_edge): representatives, and for each the first, middle and last portions of the others by score."""
    nodes = stash(cell_representatives(traj, cells), "top-nodes")

    def chosen(n: int) -> np.ndarray:
        want = math.floor(n * ratio)
        front, middle, back = (math.floor(want * p) for p in portions)
        mid, r = math.floor((n - middle) / 2), np.arange(n)
        return np.flatnonzero((r < front) | ((r >= mid) & (r < mid + middle)) | (r >= n - back))

    return nodes, greedy_lists(traj.join(nodes, "traj_id", "left_semi"), eps, chosen)


#: The tables of each layer.
LAYERS = {"bottom": ("edge",), "top": ("top_node", "top_edge")}


def save(graph: tuple[DataFrame, ...], path: str, layers: tuple[str, ...] = tuple(LAYERS)) -> None:
    for name, df in zip([n for x in layers for n in LAYERS[x]], graph, strict=True):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, layers: tuple[str, ...] = tuple(LAYERS)) -> tuple[DataFrame, ...]:
    return tuple(spark.read.parquet(f"{path}/{name}") for x in layers for name in LAYERS[x])


def build_index(traj: DataFrame, path: str, rebuild: bool = False, layers: tuple[str, ...] = tuple(LAYERS), *, k: int, n_near: int, origin, size: float, eta: float, eps: float, cells: int) -> tuple[DataFrame, ...]:
    """The tables of the layers of the graph at path; a layer is built and saved where there is none, or on rebuild."""
    from pyspark.errors import AnalysisException

    out = ()
    for layer in layers:
        try:
            if rebuild:
                raise AnalysisException("rebuild")
            out += load(traj.sparkSession, path, (layer,))
        except AnalysisException:  # no such tables
            save((bottom(traj, k, n_near, origin, size, eta, eps),) if layer == "bottom" else top(traj, cells, eps), path, (layer,))
            out += load(traj.sparkSession, path, (layer,))
    return out


def ranges(edge: DataFrame, links: DataFrame) -> DataFrame:
    """src, dst, s, e of the given links (src, dst) of a layer; those that it lacks are left out."""
    return edge.select("src", "dst", "s", "e").join(links.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def neighbours(edge: DataFrame, ids: DataFrame, most: int | None = None) -> DataFrame:
    """The first `most` edges of the given sources (src)."""
    got = edge.join(ids, "src", "left_semi")
    return got if most in (None, -1) else got.filter(F.col("rank") < most)


class _Memo:
    """What was evaluated: (query_id, traj_id, start, end, dist), each pair once."""

    def __init__(self, queries: DataFrame, traj: DataFrame, metric: str, options: dict):
        self.queries, self.traj, self.metric, self.options, self.known = queries, traj, metric, options, None

    def of(self, near: DataFrame) -> DataFrame:
        """The pairs (query_id, traj_id) of a table with their matches; new ones are evaluated."""
        new = near if self.known is None else near.join(self.known.select("query_id", "traj_id"), ["query_id", "traj_id"], "left_anti")
        full = new.join(self.traj.select("traj_id", F.col("pts").alias("d_pts")), "traj_id").join(self.queries.select("query_id", "q_pts"), "query_id")
        got = stash(match(full, self.metric, "cma", **self.options).select("query_id", "traj_id", "start", "end", "dist"), "evaluated")
        self.known = got if self.known is None else self.known.unionByName(got)
        return near.join(self.known, ["query_id", "traj_id"])


def _descend(at: DataFrame, edge: DataFrame, memo: _Memo) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move each query (query_id, node, best) to its best neighbour until none improves: (where they end, the
    neighbours they saw, the moves)."""
    ends, seen, moves = None, None, None
    while True:  # distances fall with each move, so this ends
        near = stash(at.select("query_id", F.col("node").alias("src")).join(edge.select("src", F.col("dst").alias("traj_id")), "src").select("query_id", "traj_id").distinct(), "neighbours")
        best = memo.of(near).groupBy("query_id").agg(F.min(F.struct("dist", "start", "end", "traj_id")).alias("b"))
        moved = at.join(best, "query_id").filter(F.col("best").isNull() | (F.col("b.dist") < F.col("best")))
        moved = stash(moved.select("query_id", F.col("b.traj_id").alias("node"), F.col("b.dist").alias("best")), "moved")
        stay = stash(at.join(moved.select("query_id"), "query_id", "left_anti"), "settled")
        ends, seen, moves = ((new if old is None else old.unionByName(new)) for old, new in ((ends, stay), (seen, near), (moves, moved.select("query_id"))))
        if moved.isEmpty():
            return ends, seen, moves
        at = moved


#: Parts that the nodes are numbered in, and restarts in a row that may bring nothing new.
PARTS, PATIENCE = 64, 5


def _entries(queries: DataFrame, nodes: DataFrame, turn: int, seed: int) -> DataFrame:
    """query_id, traj_id: for each query a node of its own, chosen by hash."""
    part = F.pmod(F.xxhash64("traj_id"), F.lit(PARTS)).cast("int")
    numbered = nodes.select("traj_id", part.alias("part")).withColumn("no", F.row_number().over(Window.partitionBy("part").orderBy("traj_id")) - 1)
    sizes = {r.part: r["count"] for r in numbered.groupBy("part").count().collect()}  # PARTS rows at most
    pick = F.pmod(F.xxhash64("query_id", F.lit(seed), F.lit(turn)), F.lit(sum(sizes.values())))
    place, before = F.lit(None).cast("int"), 0
    own = F.lit(None).cast("long")
    for k, n in sorted(sizes.items()):
        inside = (F.col("pick") >= before) & (F.col("pick") < before + n)
        place, own = F.when(inside, k).otherwise(place), F.when(inside, F.col("pick") - before).otherwise(own)
        before += n
    chosen = queries.select("query_id", pick.alias("pick")).select("query_id", place.alias("part"), own.cast("int").alias("no"))
    return chosen.join(numbered, ["part", "no"]).select("query_id", "traj_id")


def search_counted(queries: DataFrame, traj: DataFrame, graph: tuple[DataFrame, DataFrame, DataFrame], k: int, metric: str = "dtw", most: int | None = None, restarts: int = 1, seed: int = 7, top_layer: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """(found, counters).  found: query_id, rank, traj_id, start, end, dist; counters: query_id, restarts, moves, evaluated, candidates.

    Greedy search from a node of the top layer, one of each query's own, down to the bottom.  All queries move
    together, one join of frontier and edges a round.  The bottom neighbours that are evaluated are the candidates.
    After `restarts` turns, queries with fewer than k candidates start again from other nodes, until they have
    k or PATIENCE turns brought none of them a new one."""
    edge, top_node, top_edge = graph
    edge = edge if most is None else edge.filter(F.col("rank") < most)
    nodes = top_node if top_layer else traj.select("traj_id")
    memo, seen, moves, starts, idle, had = _Memo(queries, traj, metric, options), None, None, None, 0, 0
    todo, turn = queries.select("query_id"), 0
    while True:
        entry = stash(_entries(todo, nodes, turn, seed), "entries")
        starts = entry.select("query_id") if starts is None else starts.unionByName(entry.select("query_id"))
        at = stash(memo.of(entry).select("query_id", F.col("traj_id").alias("node"), F.col("dist").alias("best")), "entry")
        if top_layer:
            at, _, steps = _descend(at, top_edge, memo)
            moves = steps if moves is None else moves.unionByName(steps)
        _, near, steps = _descend(at.withColumn("best", F.lit(None).cast("double")), edge, memo)
        moves = steps if moves is None else moves.unionByName(steps)
        seen = stash(near.distinct() if seen is None else seen.unionByName(near).distinct(), "candidates")
        turn += 1
        if turn < restarts:
            continue
        have = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
        todo = stash(queries.select("query_id").join(have, "query_id", "left").filter(F.coalesce("candidates", F.lit(0)) < k).select("query_id"), "short")
        now = seen.count()
        idle, had = (idle + 1 if now == had else 0), now
        if idle >= PATIENCE or todo.isEmpty():
            break
    got = seen.join(memo.known, ["query_id", "traj_id"])
    w = Window.partitionBy("query_id").orderBy("dist", "traj_id")
    found = got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "traj_id", "start", "end", "dist")
    counters = queries.select("query_id")
    for name, rows in (("restarts", starts), ("moves", moves), ("evaluated", memo.known), ("candidates", seen)):
        counters = counters.join(rows.groupBy("query_id").agg(F.count(F.lit(1)).alias(name)), "query_id", "left")
    return found, counters.na.fill(0)


def search(*args, **options) -> DataFrame:
    """The rows found by search_counted."""
    return search_counted(*args, **options)[0]
