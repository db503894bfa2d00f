"""G20: the plan of a square's axes stays short."""

from fieldloom.operators.slices import square_frame


def test_axes_are_made_in_steps(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 2.0), (2, 3.0, 0.0, 0.1), (3, 0.0, 0.0, 0.0)], "scene_id int, nx double, ny double, nz double")
    out = square_frame(rows)
    assert out.columns == ["scene_id", "nx", "ny", "nz", "ux", "uy", "uz", "vx", "vy", "vz"]
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 12_000
    first, second, none = out.orderBy("scene_id").collect()
    assert (first.ux, first.uy, first.uz) == (0.0, 1.0, 0.0) and (first.vx, first.vy, first.vz) == (-1.0, 0.0, 0.0)
    assert abs(second.ux * 3 + second.uz * 0.1) < 1e-12 and none.ux is None
