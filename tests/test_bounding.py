"""Blocks and boxes against all pairs: few rows a block, so that every way through the plan is taken."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import bounding as B
from fieldloom.operators import geometry as G
from fieldloom.operators import shapes as H
from fieldloom.operators import spatial as N

POINTS = "scene_id long, point_id long, x double, y double, z double"
SMALL = B.Sizes(scene_rows=20, left_rows=8, right_rows=5, chunk=2)


def ball(n_rings, n_around, rough=0.0, seed=1):
    """(vertices, faces) of a closed ball of triangles, its radius between 1 - rough and 1 + rough."""
    rng = random.Random(seed)
    ring = [(0.0, 0.0, 1.0)] + [(math.sin(t) * math.cos(p), math.sin(t) * math.sin(p), math.cos(t)) for i in range(1, n_rings) for t in [math.pi * i / n_rings] for p in [2 * math.pi * j / n_around for j in range(n_around)]] + [(0.0, 0.0, -1.0)]
    v = [tuple(c * s for c in p) for p in ring for s in [1 + rough * (2 * rng.random() - 1)]]
    at = lambda i, j: 1 + (i - 1) * n_around + j % n_around
    f = [(0, at(1, j), at(1, j + 1)) for j in range(n_around)]
    for i in range(1, n_rings - 1):
        for j in range(n_around):
            f += [(at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1))]
    f += [(len(v) - 1, at(n_rings - 1, j + 1), at(n_rings - 1, j)) for j in range(n_around)]
    return np.array(v), np.array(f)


def surface(spark, v, f, scene=1):
    vertices = spark.createDataFrame([(scene, i, *map(float, p)) for i, p in enumerate(v)], "scene_id long, vid long, x double, y double, z double")
    return vertices, spark.createDataFrame([(scene, i, *map(int, t)) for i, t in enumerate(f)], "scene_id long, fid long, v0 long, v1 long, v2 long")


def test_blocks_hold_neighbours_of_one_scene(spark):
    rng = random.Random(1)
    rows = [(i % 3, i, rng.random(), 0.0 if i % 2 else rng.random(), 5.0) for i in range(500)] + [(7, 1000 + i, 0.5, 0.5, 0.5) for i in range(50)]
    got = B.blocked(spark.createDataFrame(rows, POINTS).repartition(5), 8, [F.col(c) for c in "xyz"]).collect()
    assert len(got) == 550 and len({r.row for r in got}) == 550
    blocks = {}
    for r in got:
        blocks.setdefault(r.block, []).append(r)
    assert all(len(b) <= 8 and len({r.scene_id for r in b}) == 1 for b in blocks.values()) and len(blocks) < 100


@pytest.mark.parametrize("k", [1, 4])
def test_neighbours_through_blocks(spark, k):
    rng = random.Random(k)
    place = lambda i: (rng.choice([0.0, 1.0, rng.random()]), rng.choice([0.0, rng.random()]), 0.5 if i % 3 else rng.random())
    left = [(i % 2, i, *place(i)) for i in range(90)] + [(5, 900, 0.0, 0.0, 0.0), (6, 901 + 0, 1.0, 1.0, 1.0)] + [(5, 1000 + i, 0.1, 0.2, 0.3) for i in range(40)] + [(0, 3, 0.5, 0.5, 0.5)] * 2
    right = [(i % 2, i, *place(i)) for i in range(80)] + [(0, 500 + i, 0.3, 0.3, 0.3) for i in range(60)] + [(6, 1, 1.0, 0.0, 0.0)]
    got = N.neighbours(spark.createDataFrame(left, POINTS), spark.createDataFrame(right, POINTS), k, block_rows=5, whole_rows=20, share_rows=8).collect()
    seen = {}
    for r in got:
        seen.setdefault((r.scene_id, r.point_id, r.x, r.y, r.z), []).append((r["rank"], r.r_id))
    for p in set(left):
        near = [i for _, i in sorted((sum((a - b) ** 2 for a, b in zip(p[2:], q[2:])), q[1]) for q in right if q[0] == p[0])[:k]]
        want = [(n + 1, i) for n, i in enumerate(near)] or [(None, None)]
        assert sorted(seen.pop(p)) == sorted(want * left.count(p)) if near else True
    assert not [s for s in seen if s[0] not in (5,)]
    assert sum(r.scene_id == 5 for r in got) == 41 and all(r.r_id is None for r in got if r.scene_id == 5)


def test_a_hundred_thousand_points_in_one_place(spark, monkeypatch):
    """No task gets more than a block of points and a chunk of blocks, however many points of right share a place."""
    right = spark.range(100_000).select(F.lit(1).cast("long").alias("scene_id"), F.col("id").alias("point_id"), *[F.lit(0.25).alias(c) for c in "xyz"])
    left = spark.range(300).select(F.lit(1).cast("long").alias("scene_id"), F.col("id").alias("point_id"), *[(F.col("id") / 300).alias(c) for c in "xyz"])
    most = spark.sparkContext.accumulator(0)
    run = N._nearest

    def watched(points, items, k):
        if len(points) > 1_024 or len(items["r_id"]) > 16 * 512:
            most.add(1)
        return run(points, items, k)

    monkeypatch.setattr(N, "_nearest", watched)
    got = N.nearest_join(left, right).collect()
    assert len(got) == 300 and {r.nearest_id for r in got} == {0} and most.value == 0
    assert all(math.isclose(r.distance, math.sqrt(3) * abs(r.point_id / 300 - 0.25), abs_tol=1e-12) for r in got)


def all_triangles(p, v, f):
    a, b, c = (v[f[:, k]] for k in range(3))
    return [math.sqrt(H.triangle_d2(np.broadcast_to(x, a.shape), a, b, c).min()) for x in p]


def test_triangles_through_blocks(spark):
    v, f = ball(8, 9, 0.2)
    rng = np.random.default_rng(4)
    p = rng.normal(0, 0.8, (70, 3))
    points = spark.createDataFrame([(1, i, *map(float, x)) for i, x in enumerate(p)] + [(2, 100, 0.0, 0.0, 0.0), (1, 101, float("nan"), 0.0, 0.0)], POINTS)
    want = all_triangles(p, v, f)
    for sizes in (None, SMALL):
        got = {r.point_id: r.distance for r in H.triangle_distance(points, *surface(spark, v, f), sizes).collect()}
        assert len(got) == 72 and got[100] is None and got[101] is None
        assert all(math.isclose(got[i], d, abs_tol=1e-12) for i, d in enumerate(want))


def test_a_twentieth_of_all_pairs_is_measured():
    v, f = ball(50, 51)
    p = np.random.default_rng(2).normal(0, 0.7, (400, 3))
    items = {q + k: v[f[:, n], m] for n, q in enumerate("abc") for m, k in enumerate("xyz")}
    counts = []
    _, got = H.least_triangle(p, items, counts)
    assert len(f) > 4_900 and np.allclose(np.sqrt(got["d2"]), all_triangles(p, v, f), atol=1e-12)
    met, measured = (sum(c[k] for c in counts) for k in (0, 1))
    assert met < 0.1 * len(p) * len(f) and measured < 0.05 * len(p) * len(f)


def full_winding(p, v, f):
    a, b, c = (v[f[:, k]] for k in range(3))
    return np.array([G._angles_of_pairs(a - x, b - x, c - x).sum() for x in p]) / (4 * math.pi)


def test_winding_numbers_by_groups_stay_within_their_error():
    for rough in (0.0, 0.02):
        v, f = ball(70, 71, rough)
        p = np.random.default_rng(5).normal(0, 0.6, (200, 3))
        items = {q + k: v[f[:, n], m] for n, q in enumerate("abc") for m, k in enumerate("xyz")}
        want = full_winding(p, v, f)
        assert np.allclose(G._winding(p, items, 0.0)[1]["w"], want, atol=1e-9)
        for error in (0.1, 0.02):
            counts = []
            got = G._winding(p, items, error, counts)[1]["w"]
            assert np.abs(got - want).max() <= error and sum(c[1] for c in counts) < 0.8 * len(p) * len(f)


def test_winding_numbers_through_blocks(spark):
    v, f = ball(9, 10, 0.1)
    open_ = f[: len(f) * 2 // 3]  # not closed: winding numbers between 0 and 1
    p = np.random.default_rng(6).uniform(-1, 1, (80, 3))
    points = spark.createDataFrame([(s, i, *map(float, x)) for i, x in enumerate(p) for s in (1, 3)] + [(2, 100, 0.0, 0.0, 0.0)], POINTS)
    for faces in (f, open_):
        one, other = surface(spark, v, faces), surface(spark, v * 3, faces, 3)
        both = [a.unionByName(b) for a, b in zip(one, other)]
        want = {1: full_winding(p, v, faces), 3: full_winding(p, v * 3, faces)}
        for sizes, error in ((None, 0.0), (SMALL, 0.0), (SMALL, 0.3)):
            got = {(r.scene_id, r.point_id): r for r in G.winding_number(points, *both, error, sizes).collect()}
            assert len(got) == 161 and got[2, 100].sign == 1
            for s in (1, 3):
                for i, w in enumerate(want[s]):
                    inside = all(lo <= c <= hi for c, lo, hi in zip(p[i], (v * s).min(0), (v * s).max(0)))
                    assert not inside or (abs(got[s, i].w - w) <= error + 1e-9 and (got[s, i].sign == -1) == (abs(w) > 0.5))


def test_segments_through_blocks(spark):
    rng = random.Random(3)
    points = [(s, n, i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for s in (1, 2) for n in ("a/b", "a") for i in range(40)] + [(9, "a", 1, 0.0, 0.0)]
    ends = [(s, n, *[rng.uniform(-1, 1) for _ in range(4)]) for s in (1, 2) for n in ("a/b", "a") for _ in range(30)] + [(1, "a", 0.5, 0.5, 0.5, 0.5), (1, "a", None, 0.0, 1.0, 0.0)]
    p = spark.createDataFrame(points, "scene_id long, name string, point_id long, u double, v double")
    q = spark.createDataFrame(ends, "scene_id long, name string, au double, av double, bu double, bv double")

    def least(s, n, u, v):
        out = []
        for t, m, *e in ends:
            if (t, m) == (s, n) and None not in e and e[:2] != e[2:]:
                (a, b), (c, d) = e[:2], e[2:]
                k = max(0, min(1, ((u - a) * (c - a) + (v - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))
                out.append(math.dist((u, v), (a + k * (c - a), b + k * (d - b))))
        return min(out, default=None)

    for sizes in (None, SMALL):
        got = {(r.scene_id, r.name, r.point_id): r.distance for r in G.segment_distance(p, q, "scene_id", "name", sizes=sizes).collect()}
        assert len(got) == len(points) and got.pop((9, "a", 1)) is None
        assert all(math.isclose(got[s, n, i], least(s, n, u, v), abs_tol=1e-12) for s, n, i, u, v in points[:-1])


def test_varifold_through_blocks(spark):
    rng = np.random.default_rng(8)
    sides = [[(1, *map(float, rng.uniform(0, 3, 3)), *map(float, rng.normal(size=3)), float(rng.random())) for _ in range(60)] for _ in range(2)] + [[], []]
    schema = "scene_id long, x double, y double, z double, nx double, ny double, nz double, area double"
    a, b = (spark.createDataFrame(s + [(2, *s[0][1:])], schema) for s in sides[:2])
    gamma = 6.0

    def k(p, q):
        p, q = np.array(p)[:, 1:], np.array(q)[:, 1:]
        return (np.exp(-gamma * ((p[:, None, :3] - q[None, :, :3]) ** 2).sum(-1)) * (p[:, 3:6] @ q[:, 3:6].T) * p[:, 6:] * q[None, :, 6]).sum()

    want = {1: k(sides[0], sides[0]) + k(sides[1], sides[1]) - 2 * k(*sides[:2]), 2: sum(k([s[0]], [s[0]]) for s in sides[:2]) - 2 * k([sides[0][0]], [sides[1][0]])}
    for sizes in (None, SMALL):
        got = {r.scene_id: r.distance for r in G.varifold(a, b, gamma, sizes=sizes).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)
        for cut in (1e-3, 0.3):
            for r in G.varifold(a, b, gamma, cut, sizes).collect():
                assert abs(r.distance - want[r.scene_id]) <= r.left_out
