"""Composed jobs make each of their tables once, and the points go to a surface with what is known of them."""

import math

from fieldloom.operators import shapes as H
from fieldloom.operators import slices as Z
from fieldloom.operators.bounding import Sizes

from test_slices import PLANE, POINTS, nested_cubes


def test_a_slice_build_makes_each_table_once(spark):
    planes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 3.0)], PLANE + ", ux double, uy double, uz double, vx double, vy double, vz double, side double")
    spark.sparkContext.setJobGroup("slice-build", "jobs of one build")
    try:
        got = Z.build_slice_samples(nested_cubes(spark), planes, 0.6, 10, "slab", half=0.01, expansion=0.3, supervision="finite").count()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("slice-build"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == 10
    assert jobs < 100, jobs


def test_surfaces_together_as_one_by_one(spark):
    """Also of scenes that are cut into blocks, and with a face whose corner is missing, a point without a place, and one without a scene."""
    surfaces = nested_cubes(spark)
    v, f = surfaces["lv"]
    surfaces["lv"] = v, f.unionByName(spark.createDataFrame([(1, 99, 0, 1, 77)], f.schema))
    rows = [(1, i, i % 7 * 0.35 - 1.0, i % 5 * 0.4 - 0.8, i % 3 * 0.5 - 0.6) for i in range(40)] + [(1, 50, None, 0.0, 0.0), (1, 51, float("nan"), 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0), (None, 2, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, POINTS)
    got = {(r.scene_id, r.point_id): r for r in H.by_surfaces(points, surfaces).collect()}
    assert len(got) == len(rows)
    for s, p, x, y, z in rows:
        r = got[s, p]
        for name, h in (("epi", 1.0), ("lv", 0.5), ("rv", 0.25)):
            d, sign = r[f"distance_{name}"], r[f"sign_{name}"]
            if s != 1 or p >= 50:
                assert d is None and sign == 1
                continue
            most = max(abs(x), abs(y), abs(z))
            want = most - h if most <= h else math.hypot(*[max(abs(c) - h, 0) for c in (x, y, z)])
            assert math.isclose(d, abs(want), abs_tol=1e-9) and (most == h or sign == (-1 if most < h else 1))
    sizes = Sizes(scene_rows=10, left_rows=8, right_rows=4, chunk=2)
    cut = {(r.scene_id, r.point_id): r for r in H.by_surfaces(points.filter("scene_id = 1"), surfaces, ("epi",), sizes=sizes).collect()}
    assert len(cut) == 42 and "distance_lv" not in cut[1, 0]
    for key, r in cut.items():
        assert r.sign_rv == got[key].sign_rv and r.sign_epi == got[key].sign_epi
        assert r.distance_epi is None and got[key].distance_epi is None or math.isclose(r.distance_epi, got[key].distance_epi, abs_tol=1e-9)
