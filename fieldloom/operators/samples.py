"""Filters, audits and selections over sample tables (scene_id, point_id, x, y, z, sdf_*, mask_*, source_surface)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldloom.functions.scalars import finite, uniform

SURFACES = ("epi", "lv", "rv")


def center_scale(points: DataFrame) -> DataFrame:
    """Less the scene's centroid, divided by the largest radius of the scene: two aggregations and joins, no wide window."""
    c = points.groupBy("scene_id").agg(*[F.avg(k).alias(f"c{k}") for k in "xyz"])
    moved = points.join(c, "scene_id").select(*points.columns, *[(F.col(k) - F.col(f"c{k}")).alias(f"m{k}") for k in "xyz"])
    r = moved.groupBy("scene_id").agg(F.max(F.sqrt(sum(F.col(f"m{k}") ** 2 for k in "xyz"))).alias("radius"))
    return moved.join(r, "scene_id").select("scene_id", "point_id", *[(F.col(f"m{k}") / F.col("radius")).alias(k) for k in "xyz"])


def near_surface(samples: DataFrame, surface: str, threshold: float, strict: bool = False) -> DataFrame:
    d = F.abs(f"sdf_{surface}")
    return samples.filter(d < threshold if strict else d <= threshold)


def clamp(column: Column, limit: float) -> Column:
    return F.greatest(F.least(column, F.lit(limit)), F.lit(-limit))


def periodic_slabs(points: DataFrame, axis: str, thickness: float, spacing: float) -> DataFrame:
    """Points within thickness / 2 of a plane at min + k * spacing below the scene's max, for thickness <= spacing."""
    ends = points.groupBy("scene_id").agg(F.min(axis).alias("low"), F.max(axis).alias("high"))
    rel, k = F.col(axis) - F.col("low"), F.floor((F.col(axis) - F.col("low")) / spacing)
    hit = lambda n: (n * spacing < F.col("high") - F.col("low")) & (F.abs(rel - n * spacing) <= thickness / 2)
    return points.join(ends, "scene_id").filter(hit(k) | hit(k + 1)).select(*points.columns)


def supervision_mask(mode: str) -> list[Column]:
    """local: the point's own surface; hybrid: epi as local, the others where finite; finite: where finite."""
    out = []
    for s in SURFACES:
        own = F.col("source_surface") == s
        out.append((own if mode == "local" or mode == "hybrid" and s == "epi" else finite(f"sdf_{s}")).cast("int").alias(f"mask_{s}"))
    return out


def zero_masked(surface: str) -> list[Column]:
    ok = finite(f"sdf_{surface}")
    return [F.when(ok, F.col(f"sdf_{surface}")).otherwise(0.0).alias(f"sdf_{surface}"), ok.cast("int").alias(f"mask_{surface}")]


def mask_stats(samples: DataFrame) -> DataFrame:
    """(scene_id, mask_*, n): all eight combinations of each scene, also those without rows."""
    masks = [f"mask_{s}" for s in SURFACES]
    n = samples.groupBy("scene_id", *[(F.col(m) > 0.5).cast("int").alias(m) for m in masks]).agg(F.count("*").alias("n"))
    grid = n.select("scene_id").distinct()
    for m in masks:
        grid = grid.withColumn(m, F.explode(F.array(F.lit(0), F.lit(1))))
    return grid.join(n, ["scene_id", *masks], "left").na.fill(0, ["n"])


def valid_shares(samples: DataFrame) -> DataFrame:
    """Per scene and surface how many rows are valid, and which share in per cent: (scene_id, surface, n_valid, percent)."""
    per = samples.groupBy("scene_id").agg(F.count("*").alias("n"), *[F.count_if(F.col(f"mask_{s}") > 0.5).alias(s) for s in SURFACES])
    rows = per.unpivot(["scene_id", "n"], list(SURFACES), "surface", "n_valid")
    return rows.select("scene_id", "surface", "n_valid", (100 * F.col("n_valid") / F.col("n")).alias("percent"))


def mask_values(samples: DataFrame) -> DataFrame:
    """(mask, value, n): how often each mask has each value."""
    masks = [f"mask_{s}" for s in SURFACES]
    return samples.select(*masks).unpivot([], masks, "mask", "value").groupBy("mask", "value").agg(F.count("*").alias("n"))


def sample_counts(samples: DataFrame) -> DataFrame:
    """Over scenes: mean, least and most rows, mean valid rows, and the ratio of the means in per cent."""
    any_ = F.greatest(*[F.col(f"mask_{s}") for s in SURFACES]) > 0
    per = samples.groupBy("scene_id").agg(F.count("*").alias("n"), F.count_if(any_).alias("valid"))
    return per.agg(F.avg("n").alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("valid").alias("mean_valid"), (100 * F.avg("valid") / F.avg("n")).alias("mean_percent"))


def threshold_counts(samples: DataFrame, threshold: float) -> DataFrame:
    near = [F.count_if((F.col("source_surface") == s) & (F.abs(f"sdf_{s}") < threshold)).alias(f"n_{s}") for s in SURFACES]
    return samples.groupBy("scene_id").agg(*near, F.count("*").alias("n_total"))


def profile(samples: DataFrame) -> DataFrame:
    cols = [c for k in "xyz" for c in (F.min(k).alias(f"min_{k}"), F.max(k).alias(f"max_{k}"))]
    return samples.agg(*cols, *[f(f"sdf_{s}").alias(f"{f.__name__}_{s}") for s in SURFACES for f in (F.min, F.max)], *[F.round(F.avg(f"sdf_{s}"), 6).alias(f"avg_{s}") for s in SURFACES])


def first_last_mask(samples: DataFrame) -> DataFrame:
    none = (F.greatest(*[F.col(f"mask_{s}") for s in SURFACES]) < 1e-8).cast("int")
    return samples.groupBy("scene_id").agg(F.min_by(none, "point_id").alias("first_zero"), F.max_by(none, "point_id").alias("last_zero"))


def cell_name(axes: list[str], bins: int) -> Column:
    """The cell of a row among bins of equal width from min_* to max_* of each axis."""
    place = [F.floor((F.col(a) - F.col(f"min_{a}")) / F.greatest(F.col(f"max_{a}") - F.col(f"min_{a}"), F.lit(1e-12)) * bins) for a in axes]
    return F.concat_ws("_", *[F.least(p, F.lit(bins - 1)).cast("string") for p in place])


def stratified_pick(points: DataFrame, axes: list[str], bins: int, n: int, salt: str = "pick") -> DataFrame:
    """n rows per scene, one per cell in turn: cells of equal width over the scene's range, in a keyed order that holds in every turn."""
    ends = points.groupBy("scene_id").agg(*[f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)])
    rows = points.join(ends, "scene_id").withColumn("cell", cell_name(axes, bins)).withColumn("h", uniform("scene_id", "point_id", F.lit(salt)))
    turn = F.row_number().over(W.partitionBy("scene_id", "cell").orderBy("h", "point_id"))
    rows = rows.withColumn("turn", turn).withColumn("ch", uniform("scene_id", "cell", F.lit(salt)))
    rank = F.row_number().over(W.partitionBy("scene_id").orderBy("turn", "ch", "cell"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).select(*points.columns, "cell", "rank")


def band_pick(points: DataFrame, distance: str, bands: list[float], need: int) -> DataFrame:
    """Rows of each scene within the narrowest band that holds `need` rows, else within the widest."""
    counts = points.groupBy("scene_id").agg(*[F.count_if(F.col(distance) <= b).alias(f"n{i}") for i, b in enumerate(bands)])
    band = F.coalesce(*[F.when(F.col(f"n{i}") >= need, F.lit(b)) for i, b in enumerate(bands)], F.lit(bands[-1]))
    return points.join(counts.select("scene_id", band.alias("band")), "scene_id").filter(F.col(distance) <= F.col("band"))


def weighted_sample(points: DataFrame, weight: Column, n: int, salt: str = "weighted") -> DataFrame:
    """n rows per scene without replacement, in proportion to weight (null and NaN: 0): the n least -ln(u) / w."""
    w = F.coalesce(F.nanvl(weight, F.lit(0.0)), F.lit(0.0))
    key = F.when(w > 0, -F.ln(uniform("scene_id", "point_id", F.lit(salt))) / w)
    rows = points.withColumn("key", key).filter("key is not null")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("scene_id").orderBy("key", "point_id"))).filter(F.col("rank") <= n).drop("key")


def curvature_weight(points: DataFrame, gauss: str, mean: str, share: float, power: float) -> DataFrame:
    """points with weight (1 - share) |K|^power / sum + share |H|^power / sum, the sums over the scene; a value that is not finite counts 0."""
    size = {c: F.when(finite(c), F.pow(F.abs(c), F.lit(power))).otherwise(0.0) for c in (gauss, mean)}
    sums = points.groupBy("scene_id").agg(F.sum(size[gauss]).alias("all_k"), F.sum(size[mean]).alias("all_h"))
    part = lambda c, total: F.coalesce(size[c] / F.nullif(F.col(total), F.lit(0.0)), F.lit(0.0))
    return points.join(sums, "scene_id").withColumn("weight", (1 - share) * part(gauss, "all_k") + share * part(mean, "all_h")).drop("all_k", "all_h")


def fraction_subsample(points: DataFrame, fraction: float, salt: str = "fraction") -> DataFrame:
    """floor(fraction * rows) of each scene's rows."""
    n = points.groupBy("scene_id").agg(F.floor(F.count("*") * fraction).alias("quota"))
    rows = points.withColumn("rank", F.row_number().over(W.partitionBy("scene_id").orderBy(uniform("scene_id", "point_id", F.lit(salt)), "point_id")))
    return rows.join(n, "scene_id").filter("rank <= quota").drop("quota", "rank")


def resample(points: DataFrame, n: int, salt: str = "draw") -> DataFrame:
    """n draws with replacement from each scene: draw i takes the row of rank 1 + floor(u * count)."""
    rows = points.withColumn("rank", F.row_number().over(W.partitionBy("scene_id").orderBy("point_id")))
    draws = points.groupBy("scene_id").agg(F.count("*").alias("n")).select("scene_id", "n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    draws = draws.select("scene_id", "draw", (F.floor(uniform("scene_id", "draw", F.lit(salt)) * F.col("n")) + 1).cast("int").alias("rank"))
    return draws.join(rows.hint("merge"), ["scene_id", "rank"]).drop("rank")


def cap_points(points: DataFrame, n: int) -> DataFrame:
    """Rows at the whole parts of n evenly spaced places from the first to the last."""
    rows = points.withColumn("at", F.row_number().over(W.partitionBy("scene_id").orderBy("point_id")) - 1)
    size = points.groupBy("scene_id").agg(F.count("*").alias("n"))
    at = size.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "n").select("scene_id", F.floor(F.col("i") * (F.col("n") - 1) / (n - 1)).cast("int").alias("at")).distinct()
    return rows.join(at, ["scene_id", "at"]).drop("at")
