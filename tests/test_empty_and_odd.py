"""Empty tables, null keys, and rows that are not numbers in the operators that cut scenes into blocks or matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import bounding as B
from fieldloom.operators import geometry as G
from fieldloom.operators import latent as L
from fieldloom.operators import shapes as H
from fieldloom.operators import spatial as N
from fieldloom.operators import tables as T

POINTS = "scene_id long, point_id long, x double, y double, z double"
SMALL = B.Sizes(scene_rows=1, left_rows=2, right_rows=2, chunk=1)


@pytest.fixture(scope="module")
def tables(spark):
    one = spark.createDataFrame([(1, i, float(i), 0.0, 0.0) for i in range(5)] + [(None, 9, 0.0, 0.0, 0.0), (1, 10, None, 0.0, 0.0)], POINTS)
    vertices = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0), (1, 1, 1.0, 0.0, 1.0), (1, 2, 0.0, 1.0, 1.0), (1, 3, None, 0.0, 0.0)], "scene_id long, vid long, x double, y double, z double")
    faces = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 0, 1, 3)], "scene_id long, fid long, v0 long, v1 long, v2 long")
    return one, vertices, faces


def test_neighbours_of_nothing(spark, tables):
    one, none = tables[0], tables[0].limit(0)
    for options in ({}, {"whole_rows": 1, "block_rows": 2, "share_rows": 2}):
        assert N.nearest_join(none, one, **options).count() == 0
        assert [r.nearest_id for r in N.nearest_join(one, none, **options).collect()] == [None] * 7
        got = {r.point_id: r.nearest_id for r in N.nearest_join(one.filter("scene_id = 1"), one.filter("scene_id = 1"), **options).collect()}
        assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 10: None}
        assert N.surface_scores(none, none).count() == 0


def test_surfaces_with_broken_faces(spark, tables):
    one, v, f = tables
    for sizes in (None, SMALL):
        got = {r.point_id: r.distance for r in H.triangle_distance(one.filter("scene_id = 1"), v, f, sizes).collect()}
        assert got[10] is None and math.isclose(got[0], 1.0) and math.isclose(got[4], math.sqrt(10))
        assert [r.distance for r in H.triangle_distance(one, v.limit(0), f, sizes).collect()] == [None] * 7
        assert H.triangle_distance(one.limit(0), v, f, sizes).count() == 0
        for error in (0.0, 0.2):
            assert {r.sign for r in G.winding_number(one, v, f, error, sizes).collect()} == {1}
            assert G.winding_number(one.limit(0), v, f, error, sizes).count() == 0
        t = G.face_table(v, f)
        assert G.varifold(t, t, 1.0, sizes=sizes).filter("abs(distance) > 1e-12").count() == 0
        assert G.varifold(t.limit(0), t.limit(0), 1.0, 0.1, sizes).count() == 0


def test_curvature_without_edges(spark, tables):
    one, v, f = tables
    got = H.ball_curvature(one.filter("x is not null"), v.filter("x is not null"), f.filter("fid = 0"), 0.1, 0.1).collect()
    assert len(got) == 6 and all(r.mean == 0.0 for r in got)
    weights = H.curvature_weight(spark.createDataFrame([(1, 1, 4.0, 0.0), (1, 2, -4.0, 0.0), (2, 3, 0.0, 0.0), (3, 4, 0.0, 2.0)], "scene_id long, point_id long, gauss double, mean double"))
    assert {r.point_id: r.weight for r in weights.collect()} == {1: 0.5, 2: 0.5, 3: 0.0, 4: 1.0}


def test_curvature_of_a_long_edge_in_a_small_ball(spark):
    """Two faces at a right angle along an edge of length 10: a ball around its middle holds two radii of it, and a hollow edge counts negative."""
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 10.0, 0.0, 0.0), (1, 2, 5.0, 4.0, 0.0), (1, 3, 5.0, 0.0, -4.0)], "scene_id long, vid long, x double, y double, z double")
    p = spark.createDataFrame([(1, 1, 5.0, 0.0, 0.0), (1, 2, 0.0, 0.0, 0.0), (1, 3, 5.0, 0.3, 0.0), (1, 4, 5.0, 0.6, 0.0)], POINTS)
    want = {1: 1.0, 2: 0.5, 3: 0.8, 4: 0.0}
    for faces, sign in (([(1, 0, 0, 1, 2), (1, 1, 1, 0, 3)], 1), ([(1, 0, 1, 0, 2), (1, 1, 0, 1, 3)], -1)):
        f = spark.createDataFrame(faces, "scene_id long, fid long, v0 long, v1 long, v2 long")
        got = {r.point_id: r["mean"] for r in H.ball_curvature(p, v, f, 0.5, 0.5).collect()}
        assert all(math.isclose(got[i], sign * w * (math.pi / 2) / 2, abs_tol=1e-9) for i, w in want.items())


def test_registration_of_nothing(spark, tables):
    one = tables[0]
    for options in ({}, {"scene_rows": 1}):
        moved, log = H.register_all(one, one.limit(0), rounds=3, **options)
        assert moved.count() == 7 and log.count() == 0
        moved, log = H.register_all(one.limit(0), one, rounds=3, **options)
        assert moved.count() == 0 and log.count() == 0


def test_codes(spark):
    rows = [(i, [float(i % 3), float(i % 5), float(i)]) for i in range(30)] + [(99, None)]
    codes = spark.createDataFrame(rows, "id long, code array<double>").repartition(7)
    x = np.array([c for _, c in rows[:-1]])
    cov = np.cov(x.T)
    assert all(math.isclose(r.c, cov[r.i, r.j], abs_tol=1e-9) for r in L.covariance_table(codes).collect()) and L.covariance_table(codes).count() == 6
    inverse = np.linalg.inv(cov + 1e-6 * np.eye(3))
    want = np.sqrt(np.einsum("ni,ij,nj->n", x - x.mean(0), inverse, x - x.mean(0)))
    got = {r.id: r.distance for r in L.mahalanobis(codes, "id").collect()}
    assert got.pop(99) is None and all(math.isclose(got[i], w, rel_tol=1e-9) for i, w in enumerate(want))
    assert [r.distance for r in L.mahalanobis(codes.filter("code is null"), "id").collect()] == [None] and L.mahalanobis(codes.limit(0), "id").count() == 0


def test_percentiles_of_several_columns(spark):
    rows = [(k, float(i), None if k else float(-i)) for k in (0, 1) for i in range(11)]
    got = {r.k: r for r in T.measure_percentiles(spark.createDataFrame(rows, "k int, a double, b double"), ["k"], ["a", "b"], {"median": 0.5, "top": 1.0}).collect()}
    assert (got[0].median_a, got[0].top_b, got[1].median_a, got[1].median_b) == (5.0, 0.0, 5.0, None)


def test_grids_with_offsets(spark):
    planes = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "scene_id long, plane_id long")
    fixed = {"ox": 0.0, "oy": 0.0, "oz": 0.0, "ux": 1.0, "uy": 0.0, "uz": 0.0, "vx": 0.0, "vy": 1.0, "vz": 0.0, "nx": 0.0, "ny": 0.0, "nz": 1.0, "side": 1.0}
    planes = planes.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()])
    assert H.volume_grid(planes, 0.5, 0.25).count() == 3 * 3 * 3 * 2
    rows = H.volume_grid(planes, 0.3, 0.2, "step").collect()
    assert all(abs(r.x) <= 0.5 and abs(r.y) <= 0.5 and abs(r.z) <= 0.2 for r in rows) and len({(r.scene_id, r.plane_id) for r in rows}) == 3
    first = {(r.scene_id, r.plane_id): (r.x, r.y, r.z) for r in rows if (r.i, r.j, r.k) == (0, 0, 0)}
    assert len(set(first.values())) == 3 and all(-0.5 <= x < -0.2 for x, _, _ in first.values())
    assert H.volume_grid(planes, 5.0, 0.1, "step").count() < 3  # an offset beyond the far side leaves no point
    centred = H.planar_grid(planes, 0.25, "centred").collect()
    assert all(abs(r.x) <= 0.625 for r in centred) and 3 * 16 <= len(centred) <= 3 * 36
    for wrong in ({"step": 0.0}, {"step": 1.0, "offset": "other"}):
        with pytest.raises(ValueError):
            H.planar_grid(planes, **wrong)
