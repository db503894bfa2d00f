import math

from pyspark.sql import functions as F

from fieldloom.functions import scalars as S
from fieldloom.operators import geometry as G
from fieldloom.operators import samples as P
from fieldloom.operators import spatial as N
from fieldloom.sources import io


def cube(spark):
    v = [(1, i, float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    f = [(1, 2 * k + t, q[0], q[1 + t], q[2 + t]) for k, q in enumerate(quads) for t in (0, 1)]
    return spark.createDataFrame(v, "scene_id long, vid long, x double, y double, z double"), spark.createDataFrame(f, "scene_id long, fid long, v0 long, v1 long, v2 long")


def test_cube_measures_and_edges(spark):
    v, f = cube(spark)
    m = G.measures(v, f).first()
    assert math.isclose(m.area, 6) and math.isclose(m.volume, 1)
    assert G.edge_audit(f).first().watertight
    assert G.edge_audit(f.filter("fid > 1")).first().boundary == 4


def test_winding_sign(spark):
    v, f = cube(spark)
    p = spark.createDataFrame([(1, 1, 0.5, 0.4, 0.3), (1, 2, 2.0, 0.0, 0.0), (1, 3, -0.5, 0.5, 0.5)], "scene_id long, point_id long, x double, y double, z double")
    assert {r.point_id: r.sign for r in G.winding_number(p, v, f).collect()} == {1: -1, 2: 1, 3: 1}


def test_nearest_against_all_pairs(spark):
    import random

    random.seed(1)
    pts = lambda n: [(i % 3, i, random.random(), random.random(), random.random() * 9) for i in range(n)]
    a, b = pts(60), [p for p in pts(40) if p[0] != 2]
    schema = "scene_id long, point_id long, x double, y double, z double"
    got = {(r.scene_id, r.point_id): (r.nearest_id, r.distance) for r in N.nearest_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), block_rows=2, whole_rows=3, share_rows=5).collect()}
    assert len(got) == 60
    for p in a:
        d = [(math.dist(p[2:], q[2:]), q[1]) for q in b if q[0] == p[0]]
        if d:
            assert got[p[:2]][0] == min(d)[1]
        else:
            assert got[p[:2]] == (None, None)


def test_picks_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") % 4).alias("scene_id"), F.col("id").alias("point_id"), (F.col("id") * 7 % 31 / 31.0).alias("x"), (F.col("id") * 5 % 17 / 17.0).alias("y"))
    runs = [sorted(map(tuple, P.stratified_pick(df.repartition(n), ["x", "y"], 4, 20).select("scene_id", "point_id").collect())) for n in (1, 3, 17)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 80


def test_rigid_fit_gives_the_rotation_back(spark):
    rows = [(1, float(i), float(i * i % 7), float(i * 3 % 5)) for i in range(12)]
    df = spark.createDataFrame(rows, "scene_id long, x double, y double, z double").select("*", (0.6 * F.col("x") - 0.8 * F.col("y") + 1).alias("tx"), (0.8 * F.col("x") + 0.6 * F.col("y") + 2).alias("ty"), (F.col("z") - 3).alias("tz"))
    r = G.rigid_fit(df).first()
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(r.rotation + r.translation, [0.6, -0.8, 0, 0.8, 0.6, 0, 0, 0, 1, 1, 2, -3]))


def test_scalars(spark):
    row = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert row(S.parse_value(F.lit("[0.0123]"))) == 0.0123 and row(S.parse_value(F.lit("x"))) is None
    assert row(S.clean_id(F.lit("21001.0"))) == "21001" and row(S.clean_id(F.lit(None).cast("string"))) == ""
    assert row(S.norm_id(F.lit("yrm0342_v1"), F.lit("YRM"))) == "YRM0342" and row(S.norm_id(F.lit("LEU_BBB_21001"), F.lit("BBB"))) == "21001"
    assert row(S.parse_gender(F.lit("1;;;"))) == "F" and row(S.parse_gender(F.lit("nan"))) is None


def test_sample_files(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "P1-epi_lv_rv_5_coords.npy", np.ones((5, 6), np.float32))
    np.save(tmp_path / "P2-epi_lv_rv_3_coords.npy", np.ones((3, 9), np.float32))
    np.save(tmp_path / "P3-bad.npy", np.ones((3, 7), np.float32))
    n = {(r.scene_id, r.problem is None): r["count"] for r in io.read_samples(spark, str(tmp_path)).withColumn("problem", "problem" and F.col("problem")).groupBy("scene_id", "problem").count().collect()}
    assert n == {("P1", True): 5, ("P2", True): 3, ("P3", False): 1}


def test_entry_works_without_text_operators():
    import __spark_entry__ as e

    assert "C7_experiment_report" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
