"""Planes, contours, picks and composed jobs on a cube and on small tables, against closed forms and plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_operators import cube

from fieldloom.operators import slices as Z
from fieldloom.operators import tables as T
from fieldloom.operators.latent import effective_dimension, mahalanobis, pca
from fieldloom.operators.spatial import surface_scores

POINTS = "scene_id long, point_id long, x double, y double, z double"
PLANE = "scene_id long, plane_id long, ox double, oy double, oz double, nx double, ny double, nz double"


def area(rows):
    def one(r):
        u, w = ([r[q + k] - r["a" + k] for k in "xyz"] for q in "bc")
        return math.hypot(u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]) / 2

    return sum(one(r) for r in rows)


def test_slab_of_a_cube(spark):
    """Four sides of the height of the slab; a slab beside the cube has nothing, and one that holds a face all of it."""
    v, f = cube(spark)
    planes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.5, 0.0, 0.0, 1.0), (1, 1, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0), (1, 2, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], PLANE)
    got = {}
    for r in Z.slab_clip(v, f, planes, 0.2).collect():
        got.setdefault(r.plane_id, []).append(r)
    assert set(got) == {0, 2} and math.isclose(area(got[0]), 4 * 0.4, rel_tol=1e-6) and math.isclose(area(got[2]), 1 + 4 * 0.2, rel_tol=1e-6)
    assert all(abs(r[p + "z"] - 0.5) <= 0.2 + 1e-8 for r in got[0] for p in "abc")


def test_curvature_of_a_square(spark):
    """Only the corners turn, by a right angle; segments with one corner have half of its value."""
    ends = [(0, 0), (1, 0), (2, 0), (2, 2), (0, 2)]
    rows = [(1, 0, i, *map(float, (*p, 0, *q, 0))) for i, (p, q) in enumerate(zip(ends, ends[1:] + ends[:1]))]
    seg = spark.createDataFrame(rows, "scene_id long, plane_id long, fid long, ax double, ay double, az double, bx double, by double, bz double")
    got = {r.fid: r.curvature for r in Z.contour_curvature(seg).collect()}
    turn = lambda a, b: math.pi / 2 / ((a + b) / 2)
    at = [turn(2, 1), 0, turn(1, 2), turn(2, 2), turn(2, 2)]
    assert all(math.isclose(got[i], (at[i] + at[(i + 1) % 5]) / 2) for i in range(5))
    grid = spark.createDataFrame([(1, 0, 7, 2.1, 1.0, 0.0), (1, 5, 8, 0.0, 0.0, 0.0)], "scene_id long, plane_id long, point_id long, x double, y double, z double")
    on = {r.point_id: r.curvature for r in Z.curvature_on_grid(grid, Z.contour_curvature(seg)).collect()}
    assert math.isclose(on[7], got[2]) and on[8] == 0


def test_sector_of_a_cube(spark):
    """The plane through the cube's middle cuts a square; the sector keeps what lies between its rays."""
    v, f = cube(spark)
    balls = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 3.0, -1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "scene_id long, cx double, cy double, cz double, radius double, wx double, wy double, wz double, lx double, ly double, lz double")
    length = lambda rows: sum(math.dist((r.ax, r.ay, r.az), (r.bx, r.by, r.bz)) for r in rows)
    assert math.isclose(length(Z.sector_contours(v, f, balls, 90).collect()), 4, rel_tol=1e-9)
    # the apex is at x = -2.5; at opening 2 * atan(0.1) the rays are at +-0.25 at the near side and +-0.35 at the far one
    narrow = Z.sector_contours(v, f, balls, math.degrees(2 * math.atan(0.1))).collect()
    assert math.isclose(length(narrow), 0.5 + 0.7, rel_tol=1e-6)
    arc = Z.sector_geometry(balls, 60, 5).collect()
    assert len(arc) == 6 and all(math.isclose(math.dist((r.x, r.y, r.z), (0.5, 0.5, 0.5)), 3) for r in arc)


def test_planes_and_errors(spark):
    mark = lambda ax, ay: spark.createDataFrame([(1, 50.0, 0.0, 0.0, 0.0, ax, ay, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "scene_id long, scale_mm double, " + ", ".join(f"{p}{k} double" for p in ("c", "a", "e1", "e2", "e3") for k in "xyz"))
    got = Z.all_planes(mark(2.2, 0.0), 0.5, 1, 1).orderBy("plane_id").collect()
    assert [r.ox for r in got] == [-0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 0.5, 0.5] and [r.plane_type for r in got[-2:]] == ["long_axis_1", "long_axis_2"]
    for bad in (mark(-1.0, 0.0), mark(0.0, 0.0), mark(1.0, 0.1)):
        with pytest.raises(Exception, match="the apex is"):
            Z.all_planes(bad, 0.5, 0, 0).collect()


def test_budgets():
    assert Z.budgets(10, (1, 1, 1), "largest") == [4, 3, 3] and Z.budgets(11, (1, 1, 1), "each") == [4, 4, 3] and Z.budgets(10, (1, 1, 1), "last") == [3, 3, 4]
    assert Z.budgets(7, (0, 0, 0), "largest") == [3, 2, 2]


def test_budget_pick(spark):
    """Nothing twice, n of each scene or all of it, and surfaces in their bands."""
    r = random.Random(2)
    rows = [(i % 2, i, r.random(), r.random(), *[r.choice([r.random(), float("nan")]) for _ in range(3)]) for i in range(300)] + [(5, i, 0.1, 0.2, 0.01, 0.5, 0.5) for i in range(7)]
    df = spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, dist_epi double, dist_lv double, dist_rv double")
    for labelled in (False, True):
        got = Z.budget_pick(df, 40, [0.05, 0.2, 0.6], ["x", "y"], 4, labelled=labelled).collect()
        assert len({(p.scene_id, p.point_id) for p in got}) == len(got) and sum(p.scene_id == 0 for p in got) == 40
        at = {(x[0], x[1]): dict(zip(("epi", "lv", "rv"), x[4:])) for x in rows}
        assert all(at[p.scene_id, p.point_id][p.source_surface] <= 0.6 for p in got if p.source_surface in ("epi", "lv", "rv"))
        assert sum(p.scene_id == 5 for p in got) == 7


def test_apex_by_the_leading_axis(spark):
    rows = [(1, i, float(i), 0.1 * (i % 2), 0.0) for i in range(9)]
    base = spark.createDataFrame([(1, 9.0, 0.0, 0.0)], "scene_id long, bx double, by double, bz double")
    got = Z.apex_gap(spark.createDataFrame(rows, POINTS), base, spark.createDataFrame([(1, 50.0)], "scene_id long, scale_mm double")).first()
    assert (got.far_id, got.pca_id, got.gap_mm) == (0, 0, 0.0)


def nested_cubes(spark):
    v, f = cube(spark)
    at = lambda g: v.withColumns({k: (F.col(k) - 0.5) * g for k in "xyz"})
    return {"epi": (at(2.0), f), "lv": (at(1.0), f), "rv": (at(0.5), f)}


def test_slice_samples_of_cubes(spark):
    """Distances in the middle plane of nested cubes; a plane that misses a surface has mask 0 for it."""
    planes = spark.createDataFrame([(1, k, 0.0, 0.0, z, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 3.0) for k, z in ((0, 0.0), (1, 0.4))], PLANE + ", ux double, uy double, uz double, vx double, vy double, vz double, side double")
    square = lambda x, y, h: (max(abs(x), abs(y)) - h) if max(abs(x), abs(y)) <= h else math.hypot(max(abs(x) - h, 0), max(abs(y) - h, 0))
    for mode in ("contour", "slab", "volume"):
        got = Z.build_slice_samples(nested_cubes(spark), planes, 0.24, 30, mode, half=0.01, expansion=0.3, supervision="finite").collect()
        assert 20 <= len(got) <= 60 and {r.plane_id for r in got} == {0, 1}
        for r in got:
            size = (1.0, 0.5, 0.25)
            if r.plane_id == 0 and mode != "volume":
                assert all(math.isclose(d, square(r.x, r.y, h), abs_tol=1e-6) for d, h in zip((r.sdf_epi, r.sdf_lv, r.sdf_rv), size))
            if r.plane_id == 1 and mode != "volume":
                assert r.mask_rv == 0 and r.sdf_rv == 0 and r.mask_epi == 1
            assert abs(r.x) <= 1.3 and abs(r.y) <= 1.3


def test_whole_samples_of_cubes(spark):
    got = Z.build_samples(nested_cubes(spark), 5, 0.05, 4).collect()
    assert len(got) == 3 * 10 + 4
    for r in got:
        x = [abs(r.x), abs(r.y), abs(r.z)]
        for d, h in ((r.sdf_epi, 1.0), (r.sdf_lv, 0.5), (r.sdf_rv, 0.25)):
            want = max(x) - h if max(x) <= h else math.hypot(*[max(c - h, 0) for c in x])
            assert math.isclose(d, want, abs_tol=1e-9)


def test_line_compatibility_of_a_cube(spark):
    """Both planes cut squares whose distances at points of their common line are the same."""
    v, f = nested_cubes(spark)["epi"]
    planes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.1, 0.0, 0.0, 1.0, "SA"), (1, 1, 0.2, 0.0, 0.0, 1.0, 0.0, 0.0, "LA")], PLANE + ", plane_type string")
    got = Z.line_compatibility(planes, v, f, 0.3, 0.2).collect()
    assert len(got) == 9
    for r in got:
        y = abs(-1.2 + 0.3 * r.i)
        for d, other in ((r.sdf_sa, 0.2), (r.sdf_lax, 0.1)):
            want = max(y, other) - 1 if y <= 1 else y - 1
            assert math.isclose(d, want, abs_tol=1e-9)


def test_scores_of_a_scene_with_one_side(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (2, 2, 0.0, 0.0, 0.0)], POINTS)
    b = spark.createDataFrame([(1, 1, 0.0, 3.0, 4.0)], POINTS)
    got = {r.scene_id: (r.chamfer, r.hausdorff, r.f1) for r in surface_scores(a, b, 1.0).collect()}
    assert got == {1: (5.0, 5.0, 0.0), 2: (None, None, None)}


def test_percentiles_with_nulls_and_ties(spark):
    r = random.Random(4)
    rows = [(k, None if r.random() < 0.1 else float(r.choice([1, 1, 1, r.random()]))) for k in ("a", "b", None) for _ in range(50)] + [("c", None), ("d", 2.0)]
    got = {x.k: (x.m, x.q) for x in T.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"m": 0.5, "q": 0.95}).collect()}
    for k in ("a", "b", None, "d"):
        v = sorted(x for g, x in rows if g == k and x is not None)
        at = lambda p: v[math.floor((len(v) - 1) * p)] + (v[math.ceil((len(v) - 1) * p)] - v[math.floor((len(v) - 1) * p)]) * ((len(v) - 1) * p % 1)  # noqa: E731, B023
        assert all(math.isclose(x, at(p)) for x, p in zip(got[k], (0.5, 0.95)))
    assert "c" not in got


def test_guards(spark):
    df = spark.createDataFrame([(1, "included"), (2, "unknown")], "id long, status string")
    with pytest.raises(Exception, match="not among the originals"):
        T.inclusion_guard(df).collect()
    counts = spark.createDataFrame([(1, 5)], "scene_id long, n long")
    with pytest.raises(Exception, match="not one row for scene"):
        T.requested_guard(counts, spark.createDataFrame([(1,), (2,)], "scene_id long")).collect()


def test_latent_codes(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    codes = rng.normal(size=(40, 3)) * [5, 1, 0.2]
    df = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes)], "id long, code array<double>")
    cov = np.cov(codes.T)
    want = np.sort(np.linalg.eigvalsh(cov))[::-1]
    scores, shares = pca(df, 3)
    assert np.allclose([float(s) for s in shares], want / want.sum(), atol=1e-9) and scores.count() == 40
    assert effective_dimension([0.9, 0.06, 0.04]) in (1, 2)
    assert mahalanobis(df, "id").count() == 40
