import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geometry
from wayfold.operators import blocks, clean, dtsm, experiments, graph, kernels, match, naive, pairs, topk
from wayfold.plans import registry
from wayfold.sources import files

OPTIONS = {"eps": 0.8, "centre": (30.0, 30.0)}


def paths(n, most, seed):
    r = np.random.default_rng(seed)
    return [r.normal(size=(r.integers(1, most), 2)).round(1) for _ in range(n)]


@pytest.mark.parametrize("metric", kernels.METRICS)
def test_kernels_against_plain_recurrences(metric):
    q, d = paths(60, 6, 1), paths(60, 10, 2)
    least = np.array([naive.best(a, b, metric, **OPTIONS) for a, b in zip(q, d, strict=True)])
    for algorithm in kernels.ALGORITHMS:
        start, end, dist = kernels.solve(q, d, metric, algorithm, **OPTIONS)
        if algorithm in ("cma", "exact") and (metric, algorithm) != ("lcss", "exact"):
            assert np.allclose(dist, least)
        if (metric, algorithm) != ("lcss", "exact"):
            assert (dist >= least - 1e-9).all()
        if algorithm in ("pss", "pos"):
            own = [naive.distance(a, b[s : e + 1], metric, **OPTIONS) for a, b, s, e in zip(q, d, start, end, strict=True)]
            assert np.allclose(own, dist)


def test_empty_and_unknown():
    start, _, dist = kernels.solve([np.zeros((0, 2))], [np.zeros((3, 2))])
    assert start[0] == -1 and np.isnan(dist[0])
    with pytest.raises(ValueError):
        kernels.solve([np.zeros((1, 2))], [np.zeros((1, 2))], "nothing")


def test_greedy_score_without_match():
    assert dtsm.walk(np.zeros((3, 2)), np.ones((3, 2)), 0.1) == (0.0, -1, -1, -1, -1)
    assert dtsm.walk(np.zeros((3, 2)), np.zeros((3, 2)), 0.1)[0] == -6.0


def test_pruned_is_no_better_than_brute(spark):
    rows = [(i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(paths(40, 12, 5))]
    t = spark.createDataFrame(rows, files.TRAJ)
    q = t.filter("traj_id < 4").select(F.col("traj_id").alias("query_id"), F.slice("pts", 1, 3).alias("q_pts"))
    a = {(r.query_id, r["rank"]): r.dist for r in topk.brute(q, t, 5).collect()}
    b = {(r.query_id, r["rank"]): r.dist for r in topk.pruned(q, t, 5, key_num=2).collect()}
    assert set(a) == set(b) and all(b[k] >= a[k] - 1e-9 for k in a)


def test_files_round_trip(spark, tmp_path):
    rows = [(0, [(1.0, 2.0), (3.0, 4.5)]), (1, [(-8.5, 0.25)])]
    t = spark.createDataFrame(rows, files.TRAJ)
    files.write_json(t, str(tmp_path / "j"))
    assert sorted(files.read_json(spark, str(tmp_path / "j")).collect()) == sorted(t.collect())
    (tmp_path / "b").write_bytes(files.pack_trajectories([p for _, p in rows]))
    assert sorted(files.read_binary(spark, str(tmp_path / "b")).collect()) == sorted(t.collect())
    (tmp_path / "t").write_text("2\n5 1.0 2.0\n6 3.0 4.5\n1\n7 -8.5 0.25\n")
    assert sorted(files.read_text(spark, str(tmp_path / "t")).collect()) == sorted(t.collect())
    (tmp_path / "r").write_bytes(files.pack_ragged([[1, 2], [], [3]]))
    assert [r["values"] for r in files.read_ragged(spark, str(tmp_path / "r")).orderBy("row").collect()] == [[1, 2], [], [3]]
    (tmp_path / "d").write_bytes(files.pack_dense([[1.0, 2.0], [3.0, 4.0]]))
    assert files.read_dense(spark, str(tmp_path / "d")).count() == 2
    assert files.read_json(spark, str(tmp_path / "none")).count() == 0


def test_clean(spark):
    t = spark.createDataFrame([(0, [(1.0, 1.0), (1.0, 1.0), (2.0, 1.0)])], files.TRAJ)
    assert t.select(F.size(clean.without_stops(F.col("pts")))).first()[0] == 2


def test_report_as_text(spark, tmp_path):
    rows = [(0, 4, 1.5), (0, 2, 0.5), (1, 7, 2.0)]
    got = experiments.report(lambda: spark.createDataFrame(rows, "query_id long, traj_id long, dist double"), str(tmp_path / "report"))
    assert {(r.query_id, r.best, r.traj_id, r.total, r.pairs) for r in got.collect()} == {(0, 0.5, 2, 2.0, 2), (1, 2.0, 7, 2.0, 1)}
    lines = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[0].startswith("query 0: least 0.500000 with 2, sum 2.000000 over 2 pairs") and len(lines) == 2


def test_registry_names():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_graph_search_finds_all_where_the_graph_is_whole(spark):
    rows = [(i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(paths(30, 14, 7))]
    t = spark.createDataFrame(rows, files.TRAJ)
    q = t.filter("traj_id % 10 = 0").select(F.col("traj_id").alias("query_id"), F.slice("pts", 1, 3).alias("q_pts"))
    ids = t.select("traj_id")
    edge = ids.select(F.col("traj_id").alias("src")).crossJoin(ids.select(F.col("traj_id").alias("dst"))).filter("src <> dst")
    edge = edge.withColumns({"rank": F.col("dst").cast("int"), "dist": F.lit(0.0), "s": F.lit(0), "e": F.lit(0)})
    found, counters = graph.search_counted(q, t, (edge, ids.filter("traj_id < 5"), edge.filter("src < 5 and dst < 5")), 6)
    want = match.match(q.crossJoin(t.select("traj_id", F.col("pts").alias("d_pts"))))
    want = {(r.query_id, r["rank"]): (r.traj_id, round(r.dist, 9)) for r in topk.ranked(want, 6).collect()}
    assert {(r.query_id, r["rank"]): (r.traj_id, round(r.dist, 9)) for r in found.collect()} == want
    for r in counters.collect():
        assert r.restarts == 1 and r.evaluated <= 30 and r.candidates >= 29 and r.moves >= 1


def test_search_starts_again_where_candidates_are_few(spark):
    rows = [(i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(paths(20, 9, 3))]
    t = spark.createDataFrame(rows, files.TRAJ)
    q = t.filter("traj_id < 2").select(F.col("traj_id").alias("query_id"), F.slice("pts", 1, 2).alias("q_pts"))
    edge = spark.createDataFrame([(i, 0, i ^ 1, 0.0, 0, 0) for i in range(20)], "src long, rank int, dst long, dist double, s int, e int")  # pairs only
    found, counters = graph.search_counted(q, t, (edge, t.select("traj_id"), edge), 8, top_layer=False)
    assert {r.query_id for r in found.collect()} == {0, 1}
    assert all(r.restarts > 1 and r.candidates > 1 for r in counters.collect())


def test_farthest_of_a_long_list(spark):
    dist = spark.range(1, 100_011).selectExpr("0L AS a", "id AS b", "CAST(id AS DOUBLE) AS dist")
    assert topk.farthest_nodes(dist, 0, 2, 2) == [0, 100_010]


def test_walks_are_those_of_each_pair():
    r = np.random.default_rng(4)
    for size in (4, 7):
        a, b = ([r.integers(0, size, size=(r.integers(0, 20), 2)).astype(float) for _ in range(80)] for _ in range(2))
        k = np.arange(80)
        got = dtsm.walks(kernels.Paths.of(a), kernels.Paths.of(b), k, k, 1.0)
        assert got.T.tolist() == [[float(x) for x in dtsm.walk(p, q, 1.0)] for p, q in zip(a, b, strict=True)]


def trajectories(spark, n, most, seed):
    return spark.createDataFrame([(i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(paths(n, most, seed))], files.TRAJ)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "met", functools.partial(blocks.met, points=(50, 40), rows=(7, 9)))


def test_matches_by_blocks_are_those_of_the_pairs(spark, small_blocks):
    t = trajectories(spark, 40, 9, 8)
    q = t.filter("traj_id % 4 = 0").select(F.col("traj_id").alias("query_id"), F.col("pts").alias("q_pts"))
    for metric, algorithm in (("dtw", "exact"), ("lcss", "exact"), ("fc", "cma"), ("erp", "whole")):
        want = match.match(pairs.eligible(q, t), metric, algorithm, **OPTIONS).drop("q_pts", "d_pts")
        got = match.match_all(q, t, metric, algorithm, **OPTIONS)
        assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
        ranked = topk.brute(q, t, 3, metric, algorithm, **OPTIONS)
        assert sorted(ranked.collect()) == sorted(topk.ranked(want, 3).select(*ranked.columns).collect())


def test_bounds_and_coverage_by_blocks_are_those_of_the_pairs(spark):
    t = trajectories(spark, 30, 12, 9)
    q = t.filter("traj_id % 3 = 0").select(F.col("traj_id").alias("query_id"), F.col("pts").alias("q_pts"))
    rows = pairs.eligible(q, t).select("query_id", "traj_id", pairs.key_bound(F.col("q_pts"), F.col("d_pts"), 4, truncate=False).alias("bound")).collect()
    own = kernels.Paths.of([np.array(r.pts) for r in t.orderBy("traj_id").collect()])
    i, j = (np.array([r[c] for r in rows]) for c in ("query_id", "traj_id"))
    assert pairs.key_bounds(own, own, i, j, 4, truncate=False).tolist() == [r.bound for r in rows]
    want = pairs.grid_coverage(q, clean.points_of(t), 10, 0.2, (-1.0, -1.0), 0.4).select("query_id", "traj_id").filter("query_id <> traj_id")
    want = want.join(pairs.eligible(q, t).select("query_id", "traj_id"), ["query_id", "traj_id"], "left_semi").collect()
    got = match.match_all(q, t, chosen=lambda a, b: pairs.covered(a, b, 10, 0.2, (-1.0, -1.0), 0.4)).select("query_id", "traj_id").collect()
    assert sorted(got) == sorted(want) and got


def test_candidates_by_blocks_are_those_of_the_joins(spark, monkeypatch):
    monkeypatch.setattr(pairs, "FEW", 7)
    monkeypatch.setattr(pairs, "MANY", 11)
    t = trajectories(spark, 40, 12, 11)
    box = lambda c: geometry.mbr(F.col(c))
    every = t.selectExpr("traj_id AS src", "pts AS p").crossJoin(t.selectExpr("traj_id AS dst", "pts AS r")).filter("src <> dst")
    gaps = every.select("src", "dst", geometry.box_distance(box("p"), box("r")).alias("gap")).collect()
    near = pairs.nearest_boxes(t, t, 5)
    want = {(s, k + 1, d, gap) for s in range(40) for k, (gap, d) in enumerate(sorted((r.gap, r.dst) for r in gaps if r.src == s)[:5])}
    assert {tuple(r) for r in near.collect()} == want
    far = {(r.src, r.dst) for r in pairs.far_random(near, t, 3).collect()}
    taken = {(s, d) for s, _, d, _ in want}
    order = lambda s, d: (((d + s) % (1 << 31) * 2654435761 + 7) % (1 << 32), d)
    assert far == {(s, d) for s in range(40) for d in sorted((d for d in range(40) if d != s and (s, d) not in taken), key=lambda d, s=s: order(s, d))[:3]}
    pts = clean.points_of(t)
    around = pairs.cell_neighbours(pts, pairs.cells_of(pts, (0.0, 0.0), 0.5), (0.0, 0.0), 0.5)
    counted = around.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(pairs.neighbour_counts(t, (0.0, 0.0), 0.5).collect()) == sorted(counted.collect())
    found = pairs.cover(pairs.within_eta(around, pts, 0.3, 0.5, (0.0, 0.0)))
    assert sorted(pairs.cover_all(t, (0.0, 0.0), 0.5, 0.3).collect()) == sorted(found.collect())
    some = found.join(near.select("src", "dst"), ["src", "dst"], "left_semi")
    assert sorted(pairs.cover_all(t, (0.0, 0.0), 0.5, 0.3, near).collect()) == sorted(some.collect())


def test_a_layer_of_the_graph_is_built_alone(spark, tmp_path):
    t = trajectories(spark, 12, 9, 12)
    options = {"k": 3, "n_near": 5, "origin": (0.0, 0.0), "size": 0.5, "eta": 0.4, "eps": 0.4, "cells": 2}
    (edge,) = graph.build_index(t, str(tmp_path), layers=("bottom",), **options)
    assert edge.count() and [p.name for p in tmp_path.iterdir()] == ["edge"]
    assert len(graph.build_index(t, str(tmp_path), **options)) == 3


@pytest.mark.parametrize("metric", kernels.ONE_PASS)
def test_least_table_is_that_of_exact(metric):
    for most, more in ((6, 10), (40, 60)):
        q, d = kernels.Paths.of([np.zeros((0, 2)), *paths(25, most, 21)]), kernels.Paths.of([*paths(30, more, 22), np.zeros((0, 2))])
        i, j = (x.ravel() for x in np.indices((len(q), len(d))))
        want = kernels.solve_pairs(q, d, i, j, metric, "exact", eps=0.8)[2].reshape(len(q), len(d))
        assert np.array_equal(kernels.least_table(q, d, metric, 0.8, cells=100), want, equal_nan=True)


@pytest.mark.parametrize("metric", ["fc", "edr"])
def test_exact_without_ranges_is_exact(spark, metric):
    short, long = paths(12, 4, 23), [np.concatenate([p, p]) for p in paths(30, 12, 24)]
    gap = np.full((3, 2), -1000.0)  # leaving such a point out costs edr nothing
    for more in ([], [gap]):
        q = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(short + more)], files.TRAJ).toDF("query_id", "q_pts")
        d = spark.createDataFrame([(100 + i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(long)], files.TRAJ)
        a, b = (match.match_all(q, d, metric, "exact", ranges=r, eps=0.8).select("query_id", "traj_id", "dist") for r in (True, False))
        assert sorted(a.collect()) == sorted(b.collect()) and a.count() > 200
        assert match.match_all(q, d, metric, "exact", ranges=False).columns == ["query_id", "traj_id", "dist"]


def test_within_eta_of_all_pairs(spark):
    rows = [(i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate([*paths(25, 15, 31), np.zeros((1, 2)), np.zeros((2, 2))])]
    rows += [(90, []), (91, [(0.1, 0.2), (float("nan"), 0.1), (0.0, 0.3)])]
    t = spark.createDataFrame(rows, files.TRAJ)
    pts = clean.points_of(t.filter("traj_id <> 91"))
    around = pairs.cell_neighbours(pts, pairs.cells_of(pts, (0.0, 0.0), 0.5), (0.0, 0.0), 0.5)
    want = pairs.within_eta(around, pts, 0.3, 0.5, (0.0, 0.0)).select("src", "pos", "dst", "dist")
    got = pairs.within_eta_all(t, (0.0, 0.0), 0.5, 0.3, lanes=4, most=9)
    assert got.columns == want.columns
    assert sorted(got.filter("src <> 91 AND dst <> 91").collect()) == sorted(want.collect()) and want.count() > 50
    assert got.filter("dst = 91 AND dist IS NOT NULL AND NOT isnan(dist)").count() == got.filter("dst = 91").count() > 0


def test_rounding_often_is_rounding(spark):
    some = [0.0, -0.0, 0.1234565, 5e-7, -5e-7, 1.5e-6, -1e-9, 1e300, float("inf"), float("nan"), None, 2.5, 1234567.8912345]
    some += (np.random.default_rng(5).normal(size=2000) * 10.0 ** np.random.default_rng(6).integers(-7, 5, 2000)).round(7).tolist()
    t = spark.createDataFrame([(x,) for x in some], "x double")
    assert t.select("x", registry.r6("x").alias("a"), registry.r6_often(F.col("x")).alias("b")).filter("NOT a <=> b").count() == 0


def test_walks_in_bytes_are_those_of_each_pair():
    r = np.random.default_rng(14)
    for size, grow in ((4, 1.0), (9, 1e-3), (6, 1e6)):
        a, b = ([r.integers(0, size, size=(n, 2)) * grow for n in r.integers(0, 25, 40)] for _ in range(2))
        a[3], a[4], b[5] = np.full((9, 2), np.nan), np.full((9, 2), np.inf), np.full((9, 2), np.inf)
        a[6] = r.integers(0, size, size=(260, 2)) * grow  # its scores may not fit a byte
        i, j = (x.ravel() for x in np.indices((40, 40)))
        with np.errstate(invalid="ignore"):
            want = [[float(x) for x in dtsm.walk(a[x], b[y], grow)] for x, y in zip(i, j, strict=True)]
        assert dtsm.walks(kernels.Paths.of(a), kernels.Paths.of(b), i, j, grow, lanes=64).T.tolist() == want


def test_lists_of_the_top_layer_are_those_of_sorted_pairs(spark, small_blocks):
    t = trajectories(spark, 30, 12, 15)
    want = {}
    for r in match.greedy_scores(t, 0.4).collect():
        want.setdefault(r.a, []).append((r.dist, r.b, r.s2, r.e2))
        want.setdefault(r.b, []).append((r.dist, r.a, r.s1, r.e1))
    got = match.greedy_lists(t, 0.4, lambda n: np.array([0, 3, n - 1]))
    assert got.dtypes == [("src", "bigint"), ("rank", "int"), ("dst", "bigint"), ("dist", "double"), ("s", "int"), ("e", "int")]
    rows = {(a, k, b, d, s, e) for a, own in want.items() for k, (d, b, s, e) in enumerate(sorted(own)[x] for x in (0, 3, len(own) - 1))}
    assert {tuple(r) for r in got.collect()} == rows and len(rows) == 90


def test_a_side_of_many_blocks_is_dealt_in_few_parts(spark):
    t = blocks.flat(trajectories(spark, 60, 9, 16), "traj_id", "pts")
    run = lambda a, b: iter([{"n": np.array([len(a)]), "m": np.array([len(b)]), "points": np.array([len(blocks.column(a, "x"))])}])
    seen = blocks.met(t, t, run, "n long, m long, points long", points=(1_000_000, 1_000_000), rows=(3, 2)).collect()
    assert sum(r.n * r.m for r in seen) == 3600 and max(r.n for r in seen) <= 3 and max(r.m for r in seen) <= 2
    assert blocks._count(t, F.lit(1), 1_000_000, 1) == blocks.SIDE and blocks._count(t, F.lit(1), 1_000_000, 30) == 2


def test_pairs_that_meet_soon_are_near():
    a, b = (kernels.Paths.of([np.zeros((0, 2)), *paths(70, 12, seed)]) for seed in (41, 42))
    first, enter = np.append(a.starts, a.sizes.sum()), np.arange(a.sizes.sum())
    x = lambda p, k: p.xy[:, p.starts[k] : p.starts[k] + p.sizes[k]].T
    gaps = lambda i, j: np.sqrt(((x(a, i)[:, None] - x(b, j)) ** 2).sum(axis=2))
    tries = lambda d, most: any(d[t % len(d), t % d.shape[1]] <= 0.3 for t in range(most)) if d.size else False
    for dense, most in ((1, 2), (3, 9)):
        got = pairs._met_soon(a, enter, first, b, kernels.square_within(0.3), dense, most, 8)
        assert got.tolist() == [[tries(gaps(i, j), most) for j in range(len(b))] for i in range(len(a))] and got.any()
