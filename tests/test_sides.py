"""Both sides of a score are made once, and the screened nearest row is the measured one."""

import numpy as np
import pytest

from fieldloom.operators import shapes as H
from fieldloom.operators import spatial as N
from fieldloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
POINTS = "scene_id bigint, point_id bigint, x double, y double, z double"


def rows_of(seed, n, scenes=2):
    r = np.random.default_rng(seed)
    return [(s, i, *np.round(r.random(3) * 4, 1).tolist()) for s in range(scenes) for i in range(n)]


@pytest.mark.parametrize("make", [lambda a, b: N.surface_scores(a, b), lambda a, b: H.register_all(a, b, rounds=3)[1]], ids=["scores", "registration"])
def test_both_sides_are_made_once(spark, make):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    a, b = (spark.createDataFrame(rows_of(seed, 40), POINTS).mapInArrow(counted, POINTS) for seed in (3, 4))
    assert make(a, b).count() >= 2
    assert made.value == 160


def test_f1_at_a_share_reads_the_samples_once(spark):
    assert not [f for f in QUERIES["A20_f1_at_share_of_diagonal"](spark, SF).inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("shift, scale, step", [(0, 1, 0), (0, 1, 5), (1e4, 1e-3, 0), (0, 0, 0), (-3, 1e-160, 0)])
def test_the_nearest_place_is_the_measured_one(shift, scale, step):
    r = np.random.default_rng(5)
    for n, m in ((1, 1), (70, 1), (200, 90)):
        p, q = r.random((n, 3)), r.random((m, 3))
        q[m // 2 :] = q[: m - m // 2].copy()
        p, q = ((np.round(v * step) / step if step else v) * scale + shift for v in (p, q))
        d2 = sum((p[:, c, None] - q[None, :, c]) ** 2 for c in range(3))
        place, least = N.nearest_places(p, q)
        assert (place == d2.argmin(1)).all() and (least == d2.min(1)).all()
