"""Tables that explode makes out of few bytes must not go whole through the driver, nor come from one task."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import geometry as G
from fieldloom.operators import shapes as H
from fieldloom.operators import slices as Z
from fieldloom.operators import spatial as N
from fieldloom.plans.queries import level_plane
from fieldloom.plans.views import torus

SF = "/root/testdata/sf0.001"


def curved(v, f):
    return H.ball_curvature(v.withColumnRenamed("vid", "point_id"), v, f, 0.9, 0.7)


@pytest.mark.parametrize(
    "make",
    [
        lambda v, f, p: G.corners(v, f),
        lambda v, f, p: G.plane_contours(v, f, p),
        lambda v, f, p: Z.slab_clip(v, f, p, 0.2),
        lambda v, f, p: H.edge_bend(v, f),
        lambda v, f, p: H.slab_vertex_distance(v.withColumnRenamed("vid", "point_id"), v, 0.1),
        lambda v, f, p: N.radius_sum(v.withColumnRenamed("vid", "point_id"), v.withColumn("mass", F.lit(1.0)), 0.5),
        lambda v, f, p: curved(v, f),
        lambda v, f, p: H.tagged_landmarks(v, f.withColumn("tag", F.floor(F.col("fid") / 50))),
    ],
    ids=["corners", "plane_contours", "slab_clip", "edge_bend", "slab_vertex_distance", "radius_sum", "ball_curvature", "tagged_landmarks"],
)
def test_no_surface_is_broadcast(spark, make):
    v, f = torus(spark, SF)
    plan = make(v, f, level_plane(spark, SF, 0.11))._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("BroadcastExchange")[1:]:  # what is grouped first has a size that Spark measures
        below = part.split("BroadcastHashJoin")[0]
        assert "Exchange hashpartitioning" in below and "HashAggregate" in below


def test_surfaces_come_from_many_tasks(spark):
    v, f = torus(spark, SF)
    assert v.rdd.getNumPartitions() > 1 and f.rdd.getNumPartitions() > 1
    assert f.groupBy("scene_id").count().filter("count != 192").count() == 0
