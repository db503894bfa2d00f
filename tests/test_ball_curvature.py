"""Curvature in balls copies no row for cells and is that of all pairs, however scenes are cut."""

import math

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import shapes as H
from fieldloom.operators.bounding import Sizes
from fieldloom.plans.views import torus

SF = "/root/testdata/sf0.001"
GAUSS, MEAN = 0.9, 0.7


def surface(spark):
    v, f = torus(spark, SF)
    return v.filter("scene_id < 2"), f.filter("scene_id < 2")


def test_points_are_not_copied_for_cells(spark):
    v, f = surface(spark)
    plan = H.ball_curvature(v.withColumnRenamed("vid", "point_id"), v, f, GAUSS, MEAN)._jdf.queryExecution().executedPlan().toString()
    assert "supplier" in plan and plan.count("Generate explode") == 2  # those of the torus


def clipped(a, b, c, r):
    """The length of the segment in the ball, by its foot and half chord."""
    size = math.dist(a, b)
    foot = sum((q - p) * (o - p) for p, q, o in zip(a, b, c)) / size
    off2 = math.dist(a, c) ** 2 - foot * foot
    half = math.sqrt(max(0.0, r * r - off2))
    return max(0.0, min(size, foot + half) - max(0.0, foot - half))


@pytest.mark.parametrize("sizes", [None, Sizes(scene_rows=20, left_rows=8, right_rows=16, chunk=2)], ids=["whole", "blocks"])
def test_curvature_is_that_of_all_pairs(spark, sizes):
    v, f = surface(spark)
    odd = spark.createDataFrame([(0, 900, 50.0, 0.0, 0.0), (0, 901, None, 0.0, 0.0), (0, 902, math.nan, 0.0, 0.0), (9, 903, 0.0, 0.0, 0.0)], "scene_id bigint, point_id bigint, x double, y double, z double")
    points = v.withColumn("point_id", F.col("vid").cast("bigint")).select("scene_id", "point_id", "x", "y", "z").unionByName(odd)
    got = {(r.scene_id, r.point_id): (r.gauss, r["mean"]) for r in H.ball_curvature(points, v, f, GAUSS, MEAN, sizes).collect()}
    at = {(r.scene_id, r.vid): (r.x, r.y, r.z) for r in v.collect()}
    mass = H.angle_defect(v, f).collect()
    bends = H.signed_bends(v, f).collect()
    assert len(got) == len(at) + 4 and all(got[k] == (0.0, 0.0) for k in ((0, 900), (0, 901), (0, 902), (9, 903)))
    for (s, i), c in at.items():
        gauss = sum(r.mass for r in mass if r.scene_id == s and sum((a - b) ** 2 for a, b in zip(c, at[s, r.vid])) <= GAUSS * GAUSS)
        mean = sum(clipped((r.px, r.py, r.pz), (r.qx, r.qy, r.qz), c, MEAN) * r.bend for r in bends if r.scene_id == s) / 2
        assert got[s, i] == (pytest.approx(gauss, abs=1e-9), pytest.approx(mean, abs=1e-6))
