import math
import random

from test_operators import cube

from fieldloom.operators import picks as K
from fieldloom.operators import shapes as H

POINTS = "scene_id long, point_id long, x double, y double, z double"


def scattered(n, seed=3):
    r = random.Random(seed)
    return [(i % 2, i, r.random(), r.random(), r.random()) for i in range(n)]


def test_distance_to_a_cube(spark):
    v, f = cube(spark)
    p = spark.createDataFrame([(1, 1, 0.5, 0.5, 0.2), (1, 2, 2.0, 0.5, 0.4), (1, 3, 2.0, 2.0, 0.5), (1, 4, -1.0, -2.0, -2.0), (2, 5, 0.0, 0.0, 0.0)], POINTS)
    got = {r.point_id: r.sdf for r in H.signed_distance(p, v, f).collect()}
    want = {1: -0.2, 2: 1.0, 3: math.sqrt(2), 4: 3.0}
    assert got[5] is None and all(math.isclose(got[i], d, abs_tol=1e-9) for i, d in want.items())


def test_curvature_of_a_cube(spark):
    v, f = cube(spark)
    assert all(math.isclose(r.mass, math.pi / 2) for r in H.angle_defect(v, f).collect())
    bends = [r.mass for r in H.edge_bend(v, f).collect()]
    assert len(bends) == 18 and math.isclose(sum(bends), 12 * math.pi / 2)


def test_nearest_k_against_all_pairs(spark):
    a, b = scattered(30), scattered(24, 4)
    got = {(r.scene_id, r.point_id, r["rank"]): r.nearest_id for r in H.knn_join(spark.createDataFrame(a, POINTS), spark.createDataFrame(b, POINTS), 3, block_rows=2, whole_rows=3, share_rows=4).collect()}
    for p in a:
        near = sorted((math.dist(p[2:], q[2:]), q[1]) for q in b if q[0] == p[0])[:3]
        assert [got[(*p[:2], k + 1)] for k in range(3)] == [i for _, i in near]


def test_thinning_keeps_its_distance_and_is_full(spark):
    rows = scattered(120)
    kept = {(r.scene_id, r.point_id) for r in H.min_distance_thin(spark.createDataFrame(rows, POINTS), 0.3).collect()}
    at = {r[:2]: r[2:] for r in rows}
    for k, p in at.items():
        near = [o for o in kept if o[0] == k[0] and o != k and math.dist(at[o], p) < 0.3]
        assert (not near) == (k in kept)


def test_registration_finds_a_small_turn(spark):
    rows = [(1, i, (i % 5) * 1.0, (i // 5) * 1.3, (i * i % 3) * 1.7) for i in range(20)]
    turn = lambda x, y: (math.cos(0.04) * x - math.sin(0.04) * y + 0.05, math.sin(0.04) * x + math.cos(0.04) * y)
    target = [(s, i, *turn(x, y), z - 0.03) for s, i, x, y, z in rows]
    moved, log = H.register_all(spark.createDataFrame(rows, POINTS), spark.createDataFrame(target, POINTS), rounds=4)
    at = {r.point_id: (r.x, r.y, r.z) for r in moved.collect()}
    assert len(at) == 20 and all(math.dist(at[i], t) < 1e-6 for _, i, *t in target)
    assert log.count() == 2


def test_registration_to_planes_slides_onto_them(spark):
    """Points beside three planes at right angles: the first step takes them onto the planes, and the next ones rest."""
    flat = lambda axis, i: tuple(0.0 if k == axis else 0.5 + (i * (3 + k) % 7) / 4 for k in range(3))
    places = [(axis, flat(axis, i)) for axis in range(3) for i in range(12)]
    target = [(1, n, *p, *[float(k == axis) for k in range(3)]) for n, (axis, p) in enumerate(places)]
    source = [(1, n, *[c + 0.02 * (k + 1) for k, c in enumerate(p)]) for n, (_, p) in enumerate(places)]
    moved, log = H.register_all(spark.createDataFrame(source, POINTS), spark.createDataFrame(target, POINTS + ", nx double, ny double, nz double"), rounds=4, to_plane=True)
    at = {r.point_id: (r.x, r.y, r.z) for r in moved.collect()}
    assert len(at) == 36 and all(abs(at[n][axis]) < 1e-6 for n, (axis, _) in enumerate(places))
    assert log.count() <= 3


def test_overrides(spark):
    from pyspark.sql import functions as F

    m = lambda **k: F.create_map(*[F.lit(x) for p in k.items() for x in p])
    r = spark.range(1).select(K.deep_update(m(a="1", b="2"), m(b="3", c="4")).alias("new"), K.bad_overrides(m(a="1", b="2"), m(b="3", c="4")).alias("bad")).first()
    assert r.new == {"a": "1", "b": "3"} and r.bad == ["c"]


def test_registration_round_by_round_as_in_one_task(spark):
    """Large scenes, which go through tables, move as small ones do; scenes rest in different rounds, and one has no targets."""
    r = random.Random(9)
    shape = [(r.random(), r.random(), r.random()) for _ in range(40)]
    rows, target = [], []
    for scene, turn in ((1, 0.0), (2, 0.05), (3, 0.12), (4, 0.3)):
        rows += [(scene, i, *p) for i, p in enumerate(shape)]
        flat = lambda x, y: (math.cos(turn) * x - math.sin(turn) * y, math.sin(turn) * x + math.cos(turn) * y)  # noqa: E731, B023
        target += [(scene, i, *flat(x, y), z, 0.0, 0.6, 0.8) for i, (x, y, z) in enumerate(shape)] if scene < 4 else []
    rows += [(2, 99, float("nan"), 0.0, 0.0)]
    a, b = spark.createDataFrame(rows, POINTS), spark.createDataFrame(target, POINTS + ", nx double, ny double, nz double")
    for to_plane in (False, True):
        results = []
        for size in ({}, {"scene_rows": 10}):
            moved, log = H.register_all(a, b, rounds=6, to_plane=to_plane, **size)
            results.append(({(p.scene_id, p.point_id): (p.x, p.y, p.z) for p in moved.collect()}, {(p.scene_id, p["round"]): tuple(p[c] for c in H.RESIDUALS) for p in log.collect()}))
        (at, log), (at_tables, log_tables) = results
        assert len(at) == 161 and at.keys() == at_tables.keys() and log.keys() == log_tables.keys()
        assert all(math.dist(at[k], at_tables[k]) < 1e-7 for k in at if k != (2, 99)) and all(math.dist(log[k], log_tables[k]) < 1e-5 for k in log)
        assert not any(s == 4 for s, _ in log) and (1, 1) not in log and at[4, 3] == shape[3]
