"""Ids, genders, cohorts, file and combination names: lists of inputs and the outputs that the rules give them."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldloom.functions import scalars as S
from fieldloom.operators import picks as K
from fieldloom.operators import shapes as H


def each(spark, rule, cases):
    df = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], "n int, t string")
    return [r.v for r in df.select("n", rule(F.col("t")).alias("v")).orderBy("n").collect()]


def test_clean_id(spark):
    cases = {"21001.0": "21001", " 21001.0 ": "21001", "AF1.0": "AF1.0", "af1.0": "AF1.0", "1.00": "1.00", "1.0.0": "1.0.0", ".0": ".0", "\tyrm1\n": "YRM1", "nan": "", None: "", "": "", "0.0": "0"}
    assert each(spark, S.clean_id, cases) == list(cases.values())


def test_norm_id(spark):
    cases = ["LEU_BBB_21001", "none", " s62 ", "yrm0342_v1", "yrm0619_v1_2", "YRM", "VT001_MUG1"]
    assert each(spark, lambda c: S.norm_id(c, F.lit("BBB")), cases) == ["21001", "none", "62", "0342", "0619", "YRM", "001"]
    assert each(spark, lambda c: S.norm_id(c, F.lit("SickValve")), cases) == ["LEU_BBB_21001", "NONE", "S62", "YRM0342", "YRM0619", "YRM", "VT001_MUG1"]
    assert each(spark, lambda c: S.norm_id(c, F.lit("VT")), cases) == ["LEU_BBB_21001", "NONE", "S62", "YRM0342_V1", "YRM0619_V1_2", "YRM", "VT001_MUG1"]


def test_parse_gender(spark):
    cases = {"1;;;": "F", "0;;;": "M", "0": "M", "1": "F", "10": None, "Female": "F", "DONNA": "F", "donna ": "F", "woman": "F", "f": "F", "M": "M", "Uomo": "M", "man": "M", "male": "M", "nan": None, "": None, " ": None, None: None, "other": None, "a 1 b": "F"}
    assert each(spark, S.parse_gender, cases) == list(cases.values())


def test_cohort_of(spark):
    cases = {"AF12": "AF", "leaf": "AF", "yrm0342_v1": "SickValve", "LEU_NORM_F009": "Leuven_norm", "LEU_BBB_21001": "Leuven_BBB", "VT001_MUG1": "VT", "S62": "ilearnHeart", "yrm_AF": "AF", "xyz": None, "": None, None: None}
    assert each(spark, S.cohort_of, cases) == list(cases.values())


def test_scene_of(spark):
    cases = {"a/P1-epi_lv_rv_5000_coords_and_sdf.npy": "P1", "P2_MRI_like_coords_and_sdf.npy": "P2", "LEU-1_three_axis_mri_grid_samples.npy": "LEU-1", "P4_mri_samples.npy": "P4", "P_5-x-y.npy": "P_5", "P6.npy": None, "-x.npy": None, "": None, None: None}
    assert each(spark, S.scene_of, cases) == list(cases.values())
    assert [e is None for e in each(spark, S.scene_error, cases)] == [v is not None for v in cases.values()]


def test_combinations(spark):
    names = ["S_0.0025-L_0.25-R_0.5", " S_1-L_2-R_3 ", "xS_1-L_2-R_3", "S_1-L_2", None]
    parts = [each(spark, lambda c, k=k: S.sampling_combination(c)[k], names) for k in range(3)]
    assert list(zip(*parts)) == [(0.0025, 0.25, 0.5), (1.0, 2.0, 3.0), (None,) * 3, (None,) * 3, (None,) * 3]
    names = ["5k_D3_W64_L16", "5k_D3_W64_L16x", "5k_D4_W64_L16", "5k_D7_W512_L128", "5k_D5_W32_L8", "5k_D5_W64_L8", None]
    assert each(spark, S.combination_error, names) == [None, "unknown combination: 5k_D3_W64_L16x", "invalid depth: 5k_D4_W64_L16", None, "invalid width: 5k_D5_W32_L8", "invalid latent size: 5k_D5_W64_L8", "unknown combination: null"]


def test_cohort_table(spark):
    original = spark.createDataFrame([("yrm1_v1", "1;;;"), ("YRM2", "uomo"), ("YRM2", None), ("YRM9", "f")], ["ERA ID", "Sex"])
    included = spark.createDataFrame([(" yrm1_v1 ",), ("yrm2_v3",), ("yrm3_v1",), (None,)], "`Included Patients` string")
    numbers = spark.createDataFrame([(21001.0, "Female"), (21002.0, "x")], ["id", "is female?"])
    of_numbers = spark.createDataFrame([("LEU_BBB_21001",), ("LEU_BBB_21002",)], "`Included Patients` string")
    normal = spark.createDataFrame([("LEU_NORM_F009",), ("LEU_NORM_12",)], "`Included Patients` string")
    pairs = [(original, included, "YRM"), (numbers, of_numbers, "BBB"), (normal, normal, "NORM")]
    got = {tuple(r) for r in K.cohort_table(pairs).select("Patient_ID", "Cohort", "Gender").collect()}
    assert got == {
        ("yrm1_v1", "SickValve", "F"), ("yrm2_v3", "SickValve", "M"), ("yrm3_v1", "SickValve", None), ("LEU_BBB_21001", "Leuven_BBB", "F"),
        ("LEU_BBB_21002", "Leuven_BBB", None), ("LEU_NORM_F009", "Leuven_norm", "F"), ("LEU_NORM_12", "Leuven_norm", "M"),
    }
    with pytest.raises(PySparkException, match="two cohorts"):
        K.cohort_table([*pairs, (original, included, "YRM")]).collect()
    with pytest.raises(ValueError, match="no column of genders"):
        K.cohort_table([(original.select("ERA ID"), included, "YRM")])


def test_thinning_to_more_points_than_a_square_holds(spark):
    assert H.most_in_square(10.0, 1.0) == 115
    points = spark.createDataFrame([(1, i, i * 0.3, 0.0, 0.0) for i in range(50)], "scene_id long, point_id long, x double, y double, z double")
    with pytest.raises(ValueError, match="115"):
        H.min_distance_thin(points, 1.0, n=116, side=10.0)
    every = {r.point_id for r in H.min_distance_thin(points, 1.0).collect()}
    some = {r.point_id for r in H.min_distance_thin(points, 1.0, n=5, side=10.0).collect()}
    assert len(some) == 5 and some < every
