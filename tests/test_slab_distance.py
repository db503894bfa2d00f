"""Slab distances copy no row for bins and are those of all pairs."""

import numpy as np
import pytest

from fieldloom.operators import shapes as H
from fieldloom.operators.bounding import Sizes
from fieldloom.plans.views import samples, torus

SF = "/root/testdata/sf0.001"
POINTS = "scene_id bigint, point_id bigint, x double, y double, z double"


def rows_of(seed, n, scenes=2):
    r = np.random.default_rng(seed)
    return [(s, i, *np.round(r.random(3) * 4, 1).tolist()) for s in range(scenes) for i in range(n)]


def test_points_are_not_copied_for_slabs(spark):
    plan = H.slab_vertex_distance(samples(spark, SF), torus(spark, SF)[0], 0.103)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" in plan and plan.count("Generate explode") == 2  # those of the torus


@pytest.mark.parametrize("sizes", [None, Sizes(scene_rows=20, left_rows=8, right_rows=4, chunk=2)], ids=["whole", "blocks"])
@pytest.mark.parametrize("axis", [(0.0, 0.0, 1.0), (0.6, 0.0, -0.8)])
def test_slab_distances_are_those_of_all_pairs(spark, sizes, axis):
    left, right = rows_of(1, 60, 3), rows_of(2, 50)
    left += [(0, 900, 1.0, 1.0, 50.0), (0, 901, 1.0, None, 1.0)]
    p, q = (spark.createDataFrame(rows, POINTS) for rows in (left, right))
    got = {(r.scene_id, r.point_id): r.distance for r in H.slab_vertex_distance(p, q, 0.103, axis, sizes).collect()}
    assert len(got) == len(left)
    for s, i, *at in left:
        near = [sum((u - w) ** 2 for u, w in zip(at, v)) ** 0.5 for t, _, *v in right if t == s and None not in at and abs(sum(u * a for u, a in zip(at, axis)) - sum(w * a for w, a in zip(v, axis))) <= 0.103]
        assert got[s, i] == (pytest.approx(min(near), abs=1e-12) if near else None)
