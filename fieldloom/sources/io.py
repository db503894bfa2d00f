"""Sources and sinks. Schemas are fixed; file names carry scene, version and split."""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldloom.functions.scalars import scene_error, scene_of

#: Column names that may hold a patient's id, in order of precedence.
ID_COLUMNS = ["patient", "Patient", "PATIENT", "patient_id", "PatientID", "id", "ID"]
SAMPLE_SCHEMA = "file string, point_id bigint, x float, y float, z float, sdf_epi float, sdf_lv float, sdf_rv float, mask_epi float, mask_lv float, mask_rv float, problem string"


def _matrices(batches):
    names = ["x", "y", "z", "sdf_epi", "sdf_lv", "sdf_rv", "mask_epi", "mask_lv", "mask_rv"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                m = np.load(io.BytesIO(content), allow_pickle=False)
                problem = None if m.ndim == 2 and m.shape[1] in (6, 9) else f"shape {m.shape}"
            except ValueError as e:
                m, problem = None, str(e)
            if problem:
                yield pd.DataFrame({"file": [path], "point_id": [None], **{n: [None] for n in names}, "problem": [problem]})
                continue
            if m.shape[1] == 6:  # no masks: every value counts
                m = np.concatenate([m, np.ones((len(m), 3), m.dtype)], 1)
            for at in range(0, len(m), 100_000):
                part = m[at : at + 100_000].astype(np.float32)
                yield pd.DataFrame({"file": path, "point_id": np.arange(at, at + len(part)), **{n: part[:, i] for i, n in enumerate(names)}, "problem": None})


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample matrices (.npy, 6 or 9 columns), one file per scene, as one table; a bad file is one row with its problem, and a file name without a scene is the problem of its rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    rows = files.mapInPandas(_matrices, SAMPLE_SCHEMA).withColumn("problem", F.coalesce("problem", scene_error(F.col("file"))))
    return rows.withColumn("scene_id", scene_of(F.col("file"))).drop("file")


def resolve_id(df: DataFrame) -> DataFrame:
    """The first id column that the table has, named patient_id."""
    for name in ID_COLUMNS:
        if name in df.columns:
            return df.withColumnRenamed(name, "patient_id")
    raise ValueError(f"no id column among {df.columns}")


def separator(spark: SparkSession, path: str) -> str:
    """The one of ; , tab and | that the header holds most often; of equals the first named."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0].value if head else ""
    return max(";,\t|", key=line.count)


def read_landmarks(spark: SparkSession, path: str, sep: str | None = ";") -> DataFrame:
    """Landmarks with patient_id; coordinates (columns that end in _x, _y or _z) as double, the others as text. Without sep it is taken from the header."""
    df = resolve_id(spark.read.csv(path, header=True, sep=sep or separator(spark, path)))
    number = lambda c: c.lower().endswith(("_x", "_y", "_z"))
    return df.select("patient_id", *[F.col(c).try_cast("double").alias(c) if number(c) else F.col(c) for c in df.columns if c != "patient_id"])


def read_cohort_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The first table of a folder, by path, among its csv and parquet files at any depth; office formats have to be converted first."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    path = found.filter(F.lower("path").rlike(r"\.(csv|parquet)$")).agg(F.min("path")).first()[0]
    if path is None:
        raise FileNotFoundError(f"no csv or parquet file in {folder}")
    return spark.read.parquet(path) if path.lower().endswith(".parquet") else spark.read.csv(path, header=True, sep=separator(spark, path))


def read_latents(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, code) of latent codes: parquet (scene_id, code), or .npz files of a vector for each scene, or .npy matrices, whose rows are numbered as scene_id and meet their names in align_codes."""
    if path.endswith((".npy", ".npz")):
        files = spark.read.format("binaryFile").load(path).select("content")
        return files.mapInPandas(_codes, "scene_id string, code array<float>")
    return spark.read.parquet(path).select(F.col("scene_id").cast("string").alias("scene_id"), F.col("code").cast("array<float>").alias("code"))


def _codes(batches):
    for pdf in batches:
        for content in pdf["content"]:
            held = np.load(io.BytesIO(content), allow_pickle=False)
            rows = [(k, held[k].ravel()) for k in held.files] if hasattr(held, "files") else [(str(i), r) for i, r in enumerate(held)]
            for at in range(0, len(rows), 10_000):
                yield pd.DataFrame([(k, v.astype(np.float32).tolist()) for k, v in rows[at : at + 10_000]], columns=["scene_id", "code"])


def read_metrics(spark: SparkSession, glob: str) -> DataFrame:
    """Metric files {experiment}-version_{n}-{metric}-{split}.csv; version and split come from the name, train before test."""
    df = spark.read.schema("version int, patient string, organ string, metric string, value string").csv(glob, header=True)
    name = F.col("_metadata.file_name")
    split = F.when(name.contains("train"), "train").when(name.contains("test"), "test")
    return df.select(F.regexp_extract(name, r"version_(\w+)", 1).alias("version"), "patient", "organ", "metric", "value", split.alias("split"))


def read_specs(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(glob).select("*", F.col("_metadata.file_path").alias("file"))


def split_keys(lines: DataFrame, suffix: str = "") -> DataFrame:
    """(key, line_no) from lines (line_no, value): no blanks or # comments, base names without .npy and then without the suffix, the first of duplicates."""
    key = F.regexp_replace(F.substring_index(F.trim("value"), "/", -1), r"\.npy$", "")
    if suffix:
        key = F.regexp_replace(key, re.escape(suffix) + "$", "")
    rows = lines.filter(~F.trim("value").startswith("#") & (F.trim("value") != "")).select("line_no", key.alias("key"))
    return rows.groupBy("key").agg(F.min("line_no").alias("line_no"))


def read_splits(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return split_keys(lines, suffix)


def read_tag_labels(spark: SparkSession, path: str) -> DataFrame:
    """(tag, label) of lines `label: NAME (ID)`; the last one for an id wins."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    tag, label = (F.regexp_extract("value", r"label:\s*(.+?)\s*\((\d+)\)", g) for g in (2, 1))
    return lines.select("line_no", tag.alias("tag"), label.alias("label")).filter("tag != ''").groupBy(F.col("tag").cast("int").alias("tag")).agg(F.max_by("label", "line_no").alias("label"))


def align_codes(codes: DataFrame, keys: DataFrame) -> DataFrame:
    """Codes (position, code) joined with keys (line_no, key) by position."""
    order = keys.withColumn("position", F.row_number().over(W.orderBy("line_no")) - 1)  # a split list has a row per scene
    return codes.join(order.select("position", "key"), "position")


def finite_guard(samples: DataFrame) -> DataFrame:
    bad = None
    for c in ("x", "y", "z", "sdf_epi", "sdf_lv", "sdf_rv"):
        one = F.isnan(c) | F.col(c).isNull() | (F.abs(c) == F.lit(float("inf")))
        bad = one if bad is None else bad | one
    return samples.withColumn("x", F.when(bad, F.raise_error(F.concat(F.lit("a value that is not finite in "), F.col("scene_id").cast("string")))).otherwise(F.col("x")))


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A partition per scene, numbers as 32-bit floats; values that are not finite stop the write."""
    numbers = [c for c, t in samples.dtypes if t == "double"]
    finite_guard(samples).withColumns({c: F.col(c).cast("float") for c in numbers}).write.mode(mode).partitionBy("scene_id").parquet(path)


def write_table(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def split_lists(splits: DataFrame) -> DataFrame:
    """(split, files): a JSON array of the keys of each split, a list of scene names."""
    return splits.groupBy("split").agg(F.to_json(F.array_sort(F.collect_list("key"))).alias("files"))


def write_split_lists(splits: DataFrame, path: str) -> None:
    """A folder of one JSON array for each split."""
    split_lists(splits).select("split", F.col("files").alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def pending(wanted: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """What is still to be made."""
    return wanted if overwrite else wanted.join(done.select(key).distinct(), key, "left_anti")
