"""Thinning by a least distance: the same choice in packs and in steps, and no table of all pairs."""

import math
import random
from pathlib import Path

from pyspark.sql import functions as F

from fieldloom.functions.scalars import uniform
from fieldloom.operators import shapes as H
from fieldloom.scratch import shared_folder

POINTS = "scene_id long, point_id long, x double, y double, z double"


def one_after_another(spark, rows, least):
    keyed = spark.createDataFrame(rows, POINTS).withColumn("h", uniform("scene_id", "point_id", F.lit("thin"))).collect()
    kept = {}
    for r in sorted(keyed, key=lambda r: (r.h, r.point_id)):
        mine = kept.setdefault(r.scene_id, [])
        if all(math.dist(r[2:5], q[2:5]) >= least for q in mine):
            mine.append(r)
    return sorted((s, r.point_id) for s, mine in kept.items() for r in mine)


def test_the_choice_is_that_of_one_point_after_another(spark):
    draw = random.Random(5)
    rows = [(s, i, *[draw.random() * w for _ in "xyz"]) for s, w in ((1, 1.0), (2, 4.0)) for i in range(300)]
    rows += [(3, i, 0.5, 0.25, draw.random() * 0.01) for i in range(200)] + [(4, 1, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, POINTS).repartition(3)
    want = one_after_another(spark, rows, 0.4)
    for options in ({}, {"pack_rows": 100}, {"scene_rows": 60}):
        assert sorted(tuple(r) for r in H.min_distance_thin(points, 0.4, **options).collect()) == want


def test_points_without_a_place_or_a_scene_stay(spark):
    rows = [(1, 1, 0.0, 0.0, None), (1, 2, 0.0, float("nan"), 0.0), (1, 3, 0.0, 0.0, 0.0), (None, 4, 0.0, 0.0, 0.0), (None, 5, 0.0, 0.0, 0.0)]
    for options in ({}, {"scene_rows": 1}):
        assert sorted(r.point_id for r in H.min_distance_thin(spark.createDataFrame(rows, POINTS), 1.0, **options).collect()) == [1, 2, 3, 4, 5]
    assert H.min_distance_thin(spark.createDataFrame([], POINTS), 1.0).count() == 0


def test_near_points_make_no_table_of_pairs(spark):
    draw = random.Random(6)
    points = spark.createDataFrame([(1, i, *[draw.random() * 0.1 for _ in "xyz"]) for i in range(1000)], POINTS)
    H.min_distance_thin(points.limit(1), 0.3).count()  # the folders are there
    roots = [shared_folder(spark), spark.sparkContext.getCheckpointDir()]
    size = lambda: sum(f.stat().st_size for r in roots if r for f in Path(r.removeprefix("file:")).rglob("*") if f.is_file())
    before = size()
    assert H.min_distance_thin(points, 0.3).count() == 1
    assert size() - before < 1_000_000  # 999,000 pairs are 20 MB
