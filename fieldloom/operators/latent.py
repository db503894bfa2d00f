"""Latent-code analytics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def centred(codes: DataFrame, code: str = "code") -> DataFrame:
    """Codes less their mean vector. The mean is one row of the code's fixed length."""
    mean = codes.select(F.posexplode(code).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    row = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    return codes.join(F.broadcast(row)).withColumn(code, F.zip_with(code, "mean", lambda a, b: a - b)).drop("mean")


def pca(codes: DataFrame, k: int = 2, code: str = "code") -> tuple[DataFrame, list[float]]:
    """(codes with scores, shares of variance); the sign of a component is free."""
    v = centred(codes, code).withColumn("_v", array_to_vector(F.col(code).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_s").fit(v)
    return model.transform(v).withColumn("scores", vector_to_array("_s")).drop("_v", "_s"), model.explainedVariance.toArray().tolist()


def effective_dimension(shares: list[float], least: float = 0.95) -> int:
    return int(np.searchsorted(np.cumsum(shares), least) + 1)


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def gram(codes: DataFrame, code: str = "code") -> DataFrame:
    """(i, products): row i of the sum of products of all centred codes (arrays of one length).

    A task adds up the matrices of its batches and gives a row for each dimension; rows of a dimension are then added in two steps, of 16 shares
    each and of these, so that no task gets more than its share of the other tasks' rows."""
    v = centred(codes.select(F.col(code).cast("array<double>").alias("v")).filter("v is not null"), "v")

    def own(batches):
        total = None
        for batch in batches:
            x = _matrix(batch, 0)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            share = TaskContext.get().partitionId() % 16
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(np.full(len(total), share)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "share", "products"])

    def added(table):
        total = table.column("products").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(0)
        return pa.table({"i": table.column("i").slice(0, 1), "share": table.column("share").slice(0, 1), "products": pa.array([total], pa.list_(pa.float64()))})

    schema = "i bigint, share bigint, products array<double>"
    parts = v.mapInArrow(own, schema).groupBy("i", "share").applyInArrow(added, schema)
    return parts.groupBy("i").applyInArrow(added, schema).select("i", "products")


def covariance_table(codes: DataFrame, code: str = "code") -> DataFrame:
    """(i, j, c) for i <= j: n - 1 normalised, from gram(). Null codes are left out."""
    n = codes.filter(F.col(code).isNotNull()).count()
    return gram(codes, code).select("i", F.posexplode("products").alias("j", "total")).filter("i <= j").select(F.col("i").cast("int").alias("i"), "j", (F.col("total") / (n - 1)).alias("c"))


def mahalanobis(codes: DataFrame, key: str, code: str = "code", ridge: float = 1e-6) -> DataFrame:
    """Distance of each code to the mean under the ridged covariance; null for a null code.

    The d x d inverse, d being the code's length, is made on the driver and broadcast; the quadratic forms of a batch are one matrix product."""
    rows = gram(codes, code).orderBy("i").collect()  # d rows
    if not rows:
        return codes.select(key, F.lit(None).cast("double").alias("distance"))
    n = codes.filter(F.col(code).isNotNull()).count()
    products = np.array([r.products for r in rows])
    inverse = codes.sparkSession.sparkContext.broadcast(np.linalg.inv(products / max(1, n - 1) + ridge * np.eye(len(products))))
    c = centred(codes.select(key, F.col(code).cast("array<double>").alias("v")), "v")

    def form(batches):
        for batch in batches:
            some = batch.filter(pc.is_valid(batch.column(1)))
            x = _matrix(some, 1) if some.num_rows else np.zeros((0, len(inverse.value)))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.sqrt(np.maximum(((x @ inverse.value) * x).sum(1), 0)))], names=["key", "distance"])

    out = c.mapInArrow(form, f"key {dict(codes.dtypes)[key]}, distance double")
    none = codes.filter(F.col(code).isNull()).select(F.col(key).alias("key"), F.lit(None).cast("double").alias("distance"))
    return out.unionByName(none).withColumnRenamed("key", key)
