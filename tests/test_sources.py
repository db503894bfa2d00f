"""Files in and out: landmarks, metrics, specs, tags, splits, cohorts, codes, samples and tables."""

import json
import math

import numpy as np
import pytest

from fieldloom.sources import io


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_landmarks_keep_their_text(spark, tmp_path):
    for name, sep in (("a.csv", ";"), ("b.csv", ",")):
        path = write(tmp_path / name, sep.join(["Patient", "C_area_x", "status"]) + "\n" + sep.join(["P1", "1.5", "ok"]) + "\n" + sep.join(["P2", "x", "failed"]) + "\n")
        got = [tuple(r) for r in io.read_landmarks(spark, path, None).orderBy("patient_id").collect()]
        assert got == [("P1", 1.5, "ok"), ("P2", None, "failed")]
    with pytest.raises(ValueError, match="no id column"):
        io.read_landmarks(spark, write(tmp_path / "c.csv", "who;x\n1;2\n")).collect()


def test_metrics_and_specs(spark, tmp_path):
    write(tmp_path / "m" / "e-version_3-chamfer-train.csv", "version,patient,organ,metric,value\n3,P1,epi,chamfer,[0.01]\n")
    r = io.read_metrics(spark, str(tmp_path / "m" / "*.csv")).first()
    assert (r.version, r.patient, r.value, r.split) == ("3", "P1", "[0.01]", "train")
    write(tmp_path / "s" / "specs.json", json.dumps({"net": {"dims": [1, 2]}, "epochs": 5}, indent=1))
    r = io.read_specs(spark, str(tmp_path / "s" / "*.json")).first()
    assert r.net.dims == [1, 2] and r.epochs == 5 and r.file.endswith("specs.json")


def test_tags_and_splits(spark, tmp_path):
    tags = write(tmp_path / "tags.txt", "label: left atrium (4)\nnoise\nlabel: valve (7)\nlabel: LA (4)\n")
    assert {(r.tag, r.label) for r in io.read_tag_labels(spark, tags).collect()} == {(4, "LA"), (7, "valve")}
    keys = write(tmp_path / "train.txt", "# list\nx/P1_coords.npy\n\nP2_coords.npy\nP1_coords\n")
    assert {r.key for r in io.read_splits(spark, keys, "_coords").collect()} == {"P1", "P2"}
    out = str(tmp_path / "lists")
    io.write_split_lists(spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test")], "key string, split string"), out)
    got = {r.split: json.loads(r.value) for r in spark.read.text(out).collect()}
    assert got == {"train": ["a", "b"], "test": ["c"]}


def test_cohort_tables(spark, tmp_path):
    write(tmp_path / "c" / "b.csv", "id,g\n1,F\n")
    write(tmp_path / "c" / "a" / "z.csv", "id;g\n2;M\n")
    assert [tuple(r) for r in io.read_cohort_tables(spark, str(tmp_path / "c")).collect()] == [("2", "M")]
    (tmp_path / "none").mkdir()
    write(tmp_path / "none" / "x.xlsx", "")
    with pytest.raises(FileNotFoundError):
        io.read_cohort_tables(spark, str(tmp_path / "none"))


def test_latent_files(spark, tmp_path):
    np.savez(tmp_path / "codes.npz", P1=np.ones(3), P2=np.zeros(3))
    np.save(tmp_path / "codes.npy", np.eye(2))
    assert {(r.scene_id, tuple(r.code)) for r in io.read_latents(spark, str(tmp_path / "codes.npz")).collect()} == {("P1", (1.0,) * 3), ("P2", (0.0,) * 3)}
    assert {(r.scene_id, tuple(r.code)) for r in io.read_latents(spark, str(tmp_path / "codes.npy")).collect()} == {("0", (1.0, 0.0)), ("1", (0.0, 1.0))}


def test_samples_are_written_as_floats_and_refused_if_not_finite(spark, tmp_path):
    schema = "scene_id long, point_id long, x double, y double, z double, sdf_epi double, sdf_lv double, sdf_rv double"
    rows = [(1, 1, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6), (2, 2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    io.write_samples(spark.createDataFrame(rows, schema), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert dict(back.dtypes)["x"] == "float" and back.count() == 2 and (tmp_path / "out" / "scene_id=1").is_dir()
    with pytest.raises(Exception, match="not finite"):
        io.write_samples(spark.createDataFrame([(1, 1, math.nan, 0.0, 0.0, 0.0, 0.0, 0.0)], schema), str(tmp_path / "bad"))
    io.write_table(spark.createDataFrame([(1, "a")], "n long, t string"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True, sep=";").first().t == "a"
