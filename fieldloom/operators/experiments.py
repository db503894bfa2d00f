"""Experiment tables: summaries, ranks, pivots; cohorts and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldloom.operators.tables import percentiles


def mean_std(rows: DataFrame, keys: list[str], value: str = "value", population: bool = False) -> DataFrame:
    """Mean and standard deviation: of a sample (null for one row), or of a population."""
    std = F.stddev_pop if population else F.stddev_samp
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), std(value).alias("std"), F.count(value).alias("n"))


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    sums = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    q = percentiles(rows, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    return sums.join(q, keys, "left").select(*keys, "n", "mean", "std", "least", "p25", "p50", "p75", "p95", "most")


def combine_metrics(summary: DataFrame, metrics: list[str]) -> DataFrame:
    """A row per organ with {metric}_mean and {metric}_std: one pivot instead of a chain of full joins."""
    return summary.groupBy("organ").pivot("metric", metrics).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))


def attach_specs(metrics: DataFrame, specs: DataFrame, keys: list[str]) -> DataFrame:
    """Spec values as strings, by version."""
    return metrics.join(specs.select("version", *[F.col(k).cast("string").alias(k) for k in keys]), "version", "left")


def top_overall(rows: DataFrame, value: str, name: str, n: int) -> DataFrame:
    """The n best rows of all, ties by name."""
    return rows.orderBy(value, name).limit(n)


def top_n(rows: DataFrame, keys: list[str], value: str, name: str, n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(value, name)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def latest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The largest numeric suffix, compared as a number."""
    n = F.regexp_extract(version, r"(\d+)$", 1).try_cast("int")
    return rows.groupBy(key).agg(F.max(n).alias("latest"))


def version_set_check(train: DataFrame, test: DataFrame) -> DataFrame:
    a, b = train.select("version").distinct().withColumn("a", F.lit(1)), test.select("version").distinct().withColumn("b", F.lit(1))
    return a.join(b, "version", "full").filter("a is null or b is null").select("version", F.when(F.col("a").isNull(), "test").otherwise("train").alias("only_in"))


def heatmap(rows: DataFrame, row: str, column: str, columns: list, value: str) -> DataFrame:
    """One cell per (row, column); a second value for a cell is an error, a missing one null."""
    guard = F.when(F.count(value) > 1, F.raise_error(F.lit("two values for one cell"))).otherwise(F.first(value))
    return rows.groupBy(row, column).agg(guard.alias("v")).groupBy(row).pivot(column, columns).agg(F.first("v"))


def degenerate_free(scalars: DataFrame, least: float = 1e-10) -> DataFrame:
    """Runs without any tag whose least value is at or below `least`."""
    bad = scalars.groupBy("version", "tag").agg(F.min("value").alias("m")).filter(F.col("m") <= least).select("version").distinct()
    return scalars.join(bad, "version", "left_anti")


def match_metadata(included: DataFrame, original: DataFrame, key: str, *values: str) -> DataFrame:
    """Left join on a key; of duplicate originals the last line wins."""
    last = original.groupBy(key).agg(*[F.max_by(v, "line_no").alias(v) for v in values])
    return included.join(last, key, "left")


def crosstab(rows: DataFrame, a: str, b: str, values: list) -> DataFrame:
    return rows.filter(F.col(b).isNotNull()).groupBy(a).pivot(b, values).count().na.fill(0)


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    """Counts by bins of width from floor(min / width); the last bin is closed on the right. One row of bounds is joined on."""
    ok = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).alias("v"))
    ends = ok.agg((F.floor(F.min("v") / width) * width).alias("lo"), (F.ceil(F.max("v") / width) * width).alias("hi"))
    bins = F.greatest(F.round((F.col("hi") - F.col("lo")) / width), F.lit(1))
    out = ok.join(F.broadcast(ends)).select(F.least(F.floor((F.col("v") - F.col("lo")) / width), bins - 1).cast("int").alias("bin"))
    return out.groupBy("bin").agg(F.count("*").alias("n"))


def assign_split(files: DataFrame, train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """train before test, else unknown."""
    out = files.join(train.select(key).distinct().withColumn("tr", F.lit(1)), key, "left").join(test.select(key).distinct().withColumn("te", F.lit(1)), key, "left")
    return out.withColumn("split", F.when(F.col("tr") == 1, "train").when(F.col("te") == 1, "test").otherwise("unknown")).drop("tr", "te")


def inclusion_report(original: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """(key, status): included (in both), excluded (only original), unknown (only processed)."""
    a, b = original.select(key).distinct().withColumn("a", F.lit(1)), processed.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full").select(key, F.when(F.col("b").isNull(), "excluded").when(F.col("a").isNull(), "unknown").otherwise("included").alias("status"))


def batch_report(rows: DataFrame) -> DataFrame:
    s = F.col("status")
    return rows.agg(F.count_if(s == "completed").alias("completed"), F.count_if(s.startswith("skipped")).alias("skipped"), F.count_if(~s.startswith("skipped") & (s != "completed")).alias("failed"))
