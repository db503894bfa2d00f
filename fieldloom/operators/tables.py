"""Small steps over sample, plane, cohort and metric tables: columns, joins and sums that a user puts together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldloom.functions.scalars import dot, minus, unit
from fieldloom.operators.spatial import held

SURFACES = ("epi", "lv", "rv")


def vector(prefix: str = "") -> list[Column]:
    return [F.col(prefix + k) for k in "xyz"]


# -- columns


def normalise_units(rows: DataFrame, meta: DataFrame, columns: list[str], scale: str = "scale_mm", to_mm: bool = False) -> DataFrame:
    """Lengths divided by the scene's scale, or multiplied by it (to_mm). meta: (scene_id, scale)."""
    j = rows.join(meta.select("scene_id", scale), "scene_id")
    return j.withColumns({c: F.col(c) * F.col(scale) if to_mm else F.col(c) / F.col(scale) for c in columns}).drop(scale)


def apply_rigid(points: DataFrame, rotation: list, translation: list, right: bool = False) -> DataFrame:
    """R p + t, or p R + t (right). rotation: nine columns or numbers by rows; translation: three."""
    r = [x if isinstance(x, Column) else F.lit(float(x)) for x in rotation]
    t = [x if isinstance(x, Column) else F.lit(float(x)) for x in translation]
    row = lambda i: r[i::3] if right else r[3 * i : 3 * i + 3]
    moved = [dot(row(i), vector()) + t[i] for i in range(3)]
    return points.withColumns({k + "_moved": m for k, m in zip("xyz", moved)}).drop(*"xyz").withColumnsRenamed({k + "_moved": k for k in "xyz"})


def plane_coords(points: DataFrame) -> DataFrame:
    """u and v of points in their planes (o*, u*, v*): (p - o) along the axes, which are made unit vectors."""
    d = minus(vector(), vector("o"))
    return points.withColumns({"u": dot(d, unit(vector("u"))), "v": dot(d, unit(vector("v")))})


def project_to_plane(points: DataFrame) -> DataFrame:
    """depth (p - o) . n along the unit normal of the plane (o*, n*), and the foot f*."""
    n = unit(vector("n"))
    depth = dot(minus(vector(), vector("o")), n)
    return points.withColumn("depth", depth).withColumns({"f" + k: F.col(k) - F.col("depth") * m for k, m in zip("xyz", n)})


def mask_filter(samples: DataFrame, surface: str) -> DataFrame:
    return samples.filter(F.col(f"mask_{surface}") > 0.5)


def near_any_band(samples: DataFrame, band: float, surfaces: tuple = SURFACES) -> DataFrame:
    """Rows of which any surface is no farther than band; null and NaN are far."""
    near = F.lit(False)
    for s in surfaces:
        d = F.abs(f"sdf_{s}")
        near = near | F.coalesce(~F.isnan(d) & (d <= band), F.lit(False))
    return samples.filter(near)


def with_status(rows: DataFrame, key: str, excluded: list) -> DataFrame:
    """status ok, or excluded for the listed keys: these stay in the table."""
    return rows.withColumn("status", F.when(F.col(key).isin(excluded), "excluded").otherwise("ok"))


def only_ok(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status") == "ok")


def select_tags(faces: DataFrame, declared: list, tag: str = "tag") -> DataFrame:
    """Faces whose tag is among the declared tags that are there."""
    present = faces.select(tag).filter(F.col(tag).isin(declared)).distinct()  # no more rows than declared
    return faces.join(F.broadcast(present), tag, "left_semi").select(*faces.columns)


def minmax_norm(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """value from 0 to 1 within its keys; 1 where all are equal."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    j = rows.join(ends, list(keys)) if keys else rows.crossJoin(F.broadcast(ends))
    scaled = F.when(F.col("low") == F.col("high"), 1.0).otherwise((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")))
    return j.withColumn(value, scaled).drop("low", "high")


# -- joins


def merge_landmarks(reference: DataFrame, landmarks: DataFrame, key: str) -> DataFrame:
    """reference with its landmarks, if any, of those with status ok and a key of the reference."""
    known = only_ok(landmarks).join(reference.select(key).distinct(), key, "left_semi").drop("status")
    return reference.join(known, key, "left")


def existing(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return rows.join(files.select(key).distinct(), key, "left_semi")


def missing(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return rows.join(files.select(key).distinct(), key, "left_anti")


def with_dimension(samples: DataFrame, dimension: DataFrame, key: str = "scene_id") -> DataFrame:
    """samples with the columns of their scene; Spark broadcasts the dimension if it is small."""
    return samples.join(dimension, key)


def explode_thresholds(rows: DataFrame, distance: str, thresholds: list[float]) -> DataFrame:
    """Each row once for every threshold that its distance does not exceed, as thr."""
    at = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col(distance) <= t)
    return rows.withColumn("thr", F.explode(at))


# -- sums


def centroid(points: DataFrame) -> DataFrame:
    return points.groupBy("scene_id").agg(*[F.avg(k).alias(k) for k in "xyz"])


def percentiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(keys, one column for each name of at): exact percentiles by linear interpolation; null without values.

    Equal values are counted first, then ranked over ranges of (keys, value), so that a group of any size, or one value of very
    many rows, is spread over all tasks."""
    v = F.col(value).cast("double")
    counts = rows.filter(v.isNotNull()).groupBy(*keys, v.alias("pc_value")).agg(F.count("*").alias("pc_n"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = held(counts.repartitionByRange(parts, *keys, "pc_value").withColumn("pc_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "pc_part").agg(F.sum("pc_n").alias("own"))  # a row for each group and range it touches
    order = W.partitionBy(*keys).orderBy("pc_part")
    sizes = sizes.withColumn("before", F.coalesce(F.sum("own").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("own").over(W.partitionBy(*keys)))
    joined = ranged.alias("l").join(sizes.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "pc_part"]])
    joined = joined.select(*[F.col(f"l.{k}").alias(k) for k in keys], "l.pc_part", "pc_value", "pc_n", "before", "total")
    to = F.col("before") + F.sum("pc_n").over(W.partitionBy(*keys, "pc_part").orderBy("pc_value").rowsBetween(W.unboundedPreceding, 0))
    placed = joined.withColumn("to", to).withColumn("from", F.col("to") - F.col("pc_n"))

    def value_at(place):
        return F.max(F.when((F.col("from") <= place) & (place < F.col("to")), F.col("pc_value")))

    found = []
    for name, p in at.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        found += [value_at(F.floor(place)).alias(f"{name}_low"), value_at(F.ceil(place)).alias(f"{name}_high"), F.max(place - F.floor(place)).alias(f"{name}_part")]
    out = placed.groupBy(*keys).agg(*found)
    return out.select(*keys, *[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n) for n in at])


def measure_percentiles(rows: DataFrame, keys: list[str], measures: list[str], at: dict[str, float]) -> DataFrame:
    """(keys, {name}_{measure} for each name of at): the percentiles of several columns from one ranking by (keys, measure, value)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in measures]))
    ranked = percentiles(rows.select(*keys, each.alias("m")).select(*keys, "m.*"), [*keys, "measure"], "value", at)
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == c, F.col(p))).alias(f"{p}_{c}") for c in measures for p in at])


def compat_summary(rows: DataFrame, keys: dict[str, list], thresholds: list[float]) -> DataFrame:
    """A row for each combination of the keys' values and the thresholds, also the empty ones, of rows (keys, distance, sdf_a, sdf_b).

    n; mean, median and p95 of distance, of delta = |sdf_a - sdf_b| and of ratio = delta / distance (null at distance 0); the largest delta; the share of ratios above 1; and of the
    rows where both sdf are known the share whose signs differ. The rows are held once; thresholds are exploded on them and summed, all percentiles
    come from one ranking by (measure, combination, value), and only then the grid is joined."""
    spark, names = rows.sparkSession, [*keys, "thr"]
    rows = held(rows.select(*keys, "distance", "sdf_a", "sdf_b"))
    delta = F.abs(F.col("sdf_a") - F.col("sdf_b"))
    r = explode_thresholds(rows, "distance", thresholds).withColumn("delta", delta).withColumn("ratio", F.col("delta") / F.nullif(F.col("distance"), F.lit(0.0)))
    differ = F.when(F.col("sdf_a").isNotNull() & F.col("sdf_b").isNotNull(), (F.signum("sdf_a") != F.signum("sdf_b")).cast("double"))
    values = ("distance", "delta", "ratio")
    sums = r.groupBy(*names).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in values], F.max("delta").alias("max_delta"),
        F.avg((F.col("ratio") > 1).cast("double")).alias("ratio_above_1"), F.avg(differ).alias("sign_mismatch"),
    )
    sums = sums.join(measure_percentiles(r, names, list(values), {"median": 0.5, "p95": 0.95}), names, "left")
    grid = spark.range(1).select(*[F.explode(F.array(*[F.lit(v) for v in vs])).alias(k) for k, vs in list(keys.items())[:1]])
    for k, vs in [*list(keys.items())[1:], ("thr", [float(t) for t in thresholds])]:
        grid = grid.withColumn(k, F.explode(F.array(*[F.lit(v) for v in vs])))
    return grid.join(sums, names, "left").na.fill(0, ["n"])


def intersection_summary(rows: DataFrame, keys: list[str], levels: list[float]) -> DataFrame:
    """Per keys of rows (sdf_sa, sdf_lax): n, mean, median, p95 and largest difference of the two fields, the same of those inside (either sdf at most 0), the
    share of differing signs, and how many differences are within each level."""
    d = F.abs(F.col("sdf_sa") - F.col("sdf_lax"))
    rows = held(rows.select(*keys, "sdf_sa", "sdf_lax"))
    r = rows.withColumn("delta", d).withColumn("delta_inside", F.when((F.col("sdf_sa") <= 0) | (F.col("sdf_lax") <= 0), F.col("delta")))
    mismatch = (F.signum("sdf_sa") != F.signum("sdf_lax")).cast("double")
    sums = r.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("delta_inside").alias("n_inside"), F.avg("delta").alias("mean"), F.max("delta").alias("most"), F.avg("delta_inside").alias("mean_inside"),
        F.avg(mismatch).alias("sign_mismatch"), *[F.count_if(F.col("delta") <= t).alias(f"within_{i}") for i, t in enumerate(levels)],
    )
    ranked = measure_percentiles(r, keys, ["delta", "delta_inside"], {"median": 0.5, "p95": 0.95})
    names = {"median_delta": "median", "p95_delta": "p95", "median_delta_inside": "median_inside", "p95_delta_inside": "p95_inside"}
    return sums.join(ranked.withColumnsRenamed(names), keys, "left")


def unique_tags(rows: DataFrame, key: str, tag: str) -> DataFrame:
    """(key, tags): the distinct tags of each key, ascending."""
    return rows.select(key, tag).distinct().groupBy(key).agg(F.array_sort(F.collect_list(tag)).alias("tags"))


def extremes(rows: DataFrame, key: str, id_col: str, value: str) -> DataFrame:
    """(key, least, most): the ids with the least and the largest value; ties by id."""
    order = F.struct(value, id_col)
    return rows.groupBy(key).agg(F.min_by(id_col, order).alias("least"), F.max_by(id_col, order).alias("most"))


def extent(points: DataFrame, u: list, v: list) -> DataFrame:
    """Per scene how far its points reach along u and along v, and the larger of both."""
    place = [dot(vector(), [x if isinstance(x, Column) else F.lit(float(x)) for x in axis]) for axis in (u, v)]
    du, dv = (F.max(p) - F.min(p) for p in place)
    return points.groupBy("scene_id").agg(du.alias("du"), dv.alias("dv"), F.greatest(du, dv).alias("larger"))


def fold_compare(rows: DataFrame, fold: str, folds: list, key: str, value: str, population: bool = True) -> DataFrame:
    """A row for each key with {fold}_mean and {fold}_std of every fold."""
    std = F.stddev_pop if population else F.stddev_samp
    return rows.groupBy(key).pivot(fold, folds).agg(F.avg(value).alias("mean"), std(value).alias("std"))


def grand_table(rows: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """crosstab with a total for each row and column, and how many rows lack b: (a, *values, total, missing); the sums over a have the name all."""
    one = [F.count_if(F.col(b) == v).alias(str(v)) for v in values]
    sums = [*one, F.count(b).alias("total"), F.count_if(F.col(b).isNull()).alias("missing")]
    return rows.groupBy(F.col(a).cast("string").alias(a)).agg(*sums).unionByName(rows.agg(*sums).select(F.lit("all").alias(a), *[str(v) for v in values], "total", "missing"))


# -- picks


def rank_incompatible(rows: DataFrame, keys: list[str], value: str, n: int = 20) -> DataFrame:
    """The n keys with the largest p95 of value, then the largest mean."""
    means = rows.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return percentiles(rows, keys, value, {"p95": 0.95}).join(means, keys).orderBy(F.desc("p95"), F.desc("mean"), *keys).limit(n)


def best_patch(patches: DataFrame, key: str, id_col: str, likelihood: str) -> DataFrame:
    """(key, best): the id with the largest likelihood; of several the least."""
    return patches.groupBy(key).agg(F.min_by(id_col, F.struct(-F.col(likelihood), F.col(id_col))).alias("best"))


def dedupe_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, whole."""
    others = [c for c in rows.columns if c not in (key, order)]
    first = rows.groupBy(key).agg(F.min(F.struct(order, *others)).alias("first"))
    return first.select(key, *[F.col(f"first.{c}").alias(c) for c in (order, *others)])


def mask_union(points: DataFrame, axis: str, centres: list[float], half: float) -> DataFrame:
    """(scene_id, point_id, hit): whether a point is within half of any of the centres along the axis."""
    hit = F.exists(F.array(*[F.lit(float(c)) for c in centres]), lambda c: F.abs(F.col(axis) - c) <= half)
    return points.select("scene_id", "point_id", hit.alias("hit"))


def inclusion_guard(report: DataFrame) -> DataFrame:
    """An inclusion report that fails on a key that is not among the originals."""
    wrong = F.raise_error(F.concat(F.lit("processed, but not among the originals: "), F.col(report.columns[0]).cast("string")))
    return report.withColumn("status", F.when(F.col("status") == "unknown", wrong).otherwise(F.col("status")))


def requested_guard(counts: DataFrame, requested: DataFrame) -> DataFrame:
    """counts for the requested scenes, which fails if one has no row or several."""
    n = counts.groupBy("scene_id").agg(F.count("*").alias("rows_of_scene"))
    checked = requested.select("scene_id").distinct().join(n, "scene_id", "left")
    wrong = F.raise_error(F.concat(F.lit("not one row for scene "), F.col("scene_id").cast("string")))
    checked = checked.withColumn("scene_id", F.when(F.coalesce("rows_of_scene", F.lit(0)) != 1, wrong.cast("bigint")).otherwise(F.col("scene_id")))
    return checked.select("scene_id").join(counts, "scene_id")


def failures(rows: DataFrame, key: str) -> DataFrame:
    """(key, status) of what is neither completed nor skipped."""
    return rows.filter(~F.col("status").startswith("skipped") & (F.col("status") != "completed")).select(key, "status")
