"""Selections with keyed draws, and tables of specs and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from fieldloom.functions import scalars as S
from fieldloom.functions.scalars import uniform
from fieldloom.operators.samples import SURFACES, stratified_pick, weighted_sample


def balanced_resample(points: DataFrame, n: int) -> DataFrame:
    """(scene_id, slot, point_id): for each surface n // 3 draws with replacement, half of positive and half of negative values.

    A sign without rows borrows the other's; a surface without either has no draws. Slots that the division leaves over are
    drawn from the slots before."""
    half = n // 3 // 2
    signs = F.explode(F.array(*[F.struct(F.lit(i).alias("surface"), F.signum(f"sdf_{s}").cast("int").alias("sign")) for i, s in enumerate(SURFACES)]))
    rows = points.select("scene_id", "point_id", signs.alias("s")).select("scene_id", "point_id", "s.*").filter("sign != 0")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("scene_id", "surface", "sign").orderBy("point_id")))
    counts = rows.groupBy("scene_id", "surface").agg(F.count_if(F.col("sign") > 0).alias("pos"), F.count_if(F.col("sign") < 0).alias("neg"))
    draws = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * half - 1))).alias("draw")) if half else counts.select("*", F.lit(0).alias("draw")).filter("false")
    plus = F.when(F.col("draw") < half, F.col("pos") > 0).otherwise(F.col("neg") == 0)
    draws = draws.select("scene_id", "surface", (F.col("surface") * 2 * half + F.col("draw")).alias("slot"), F.when(plus, 1).otherwise(-1).alias("sign"), F.when(plus, F.col("pos")).otherwise(F.col("neg")).alias("many"))
    rank = (F.floor(uniform("scene_id", "slot", F.lit("balance")) * F.col("many")) + 1).cast("int")
    drawn = draws.withColumn("rank", rank).join(ranked.hint("merge"), ["scene_id", "surface", "sign", "rank"]).select("scene_id", "slot", "point_id")
    if n <= 6 * half or not half:
        return drawn
    extra = points.select("scene_id").distinct().select("scene_id", F.explode(F.sequence(F.lit(6 * half), F.lit(n - 1))).alias("new"))
    extra = extra.withColumn("slot", F.floor(uniform("scene_id", "new", F.lit("extra")) * 6 * half).cast("int"))
    return drawn.unionByName(extra.join(drawn, ["scene_id", "slot"]).select("scene_id", F.col("new").alias("slot"), "point_id"))


def lhs_thin(points: DataFrame, bins: int, n: int) -> DataFrame:
    """One row for each of the bins of each axis, each row once, at most n of a scene; scenes of at most n rows stay whole.

    A row at an axis's largest value is in no bin of it."""
    ends = points.groupBy("scene_id").agg(F.count("*").alias("many"), *[f(k).alias(f"{f.__name__}_{k}") for k in "xyz" for f in (F.min, F.max)])
    rows = points.join(ends, "scene_id")
    places = [F.struct(F.lit(k).alias("axis"), F.floor((F.col(k) - F.col(f"min_{k}")) / F.nullif(F.col(f"max_{k}") - F.col(f"min_{k}"), F.lit(0.0)) * bins).alias("bin")) for k in "xyz"]
    binned = rows.filter(F.col("many") > n).select("scene_id", "point_id", F.explode(F.array(*places)).alias("p")).filter(F.col("p.bin") < bins)
    h = F.struct(uniform("scene_id", "point_id", F.col("p.axis"), F.lit("lhs")), "point_id")
    one = binned.groupBy("scene_id", "p.axis", "p.bin").agg(F.min_by("point_id", h).alias("point_id")).select("scene_id", "point_id").distinct()
    rank = F.row_number().over(W.partitionBy("scene_id").orderBy(uniform("scene_id", "point_id", F.lit("cap")), "point_id"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank").unionByName(rows.filter(F.col("many") <= n).select("scene_id", "point_id"))


def curvature_mixed_pick(points: DataFrame, weight: str, axes: list[str], bins: int, n: int, fraction: float) -> DataFrame:
    """(scene_id, point_id, part): round(n * fraction) rows in proportion to weight, the rest of n one per cell in turn."""
    most = points.groupBy("scene_id").agg(F.max(weight).alias("most"))
    first = round(n * fraction)
    heavy = weighted_sample(points.join(most, "scene_id"), F.col(weight) + 1e-6 * F.col("most"), first).select("scene_id", "point_id")
    rest = stratified_pick(points.join(heavy, ["scene_id", "point_id"], "left_anti"), axes, bins, n - first).select("scene_id", "point_id")
    return heavy.withColumn("part", F.lit("weight")).unionByName(rest.withColumn("part", F.lit("cells")))


def flat_columns(schema: StructType, prefix: str = "") -> list[Column]:
    """The leaves of nested structs, named by their dotted paths; arrays are leaves."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, StructType):
            out += flat_columns(f.dataType, path + ".")
        else:
            out.append(F.col(".".join(f"`{p}`" for p in path.split("."))).alias(path))
    return out


def deep_update(base: Column, override: Column) -> Column:
    """A flat map with the values of override in place of base's."""
    return F.map_filter(F.map_zip_with(base, override, lambda k, a, b: F.coalesce(b, a)), lambda k, v: F.array_contains(F.map_keys(base), k))


def bad_overrides(base: Column, override: Column) -> Column:
    """Keys of override that base doesn't have, or that have no value."""
    return F.array_sort(F.map_keys(F.map_filter(override, lambda k, v: v.isNull() | ~F.array_contains(F.map_keys(base), k))))


def cohort_union(*cohorts: DataFrame, key: str = "id") -> DataFrame:
    """The rows of all cohorts; a key in more than one is an error."""
    out = cohorts[0]
    for c in cohorts[1:]:
        out = out.unionByName(c)
    twice = F.count("*").over(W.partitionBy(key)) > 1
    return out.withColumn(key, F.when(twice, F.raise_error(F.concat(F.lit("in two cohorts: "), F.col(key).cast("string")))).otherwise(F.col(key)))


#: The names of id and gender columns in the tables of a cohort, in order of precedence.
ID_COLUMNS, GENDER_COLUMNS = ["mug-id", "era id", "id", "folder_name"], ["sex", "female", "gender"]


def cohort_columns(original: DataFrame) -> tuple[str, str]:
    """The columns of id and gender of a cohort's original table, by their names in any case; else the first whose name holds female."""
    named = {}
    for c in original.columns:
        named[c.strip().lower()] = c
    id_col = next((named[c] for c in ID_COLUMNS if c in named), None)
    gender = next((named[c] for c in GENDER_COLUMNS if c in named), None) or next((c for c in original.columns if "female" in c.lower()), None)
    if id_col is None or gender is None:
        raise ValueError(f"no column of {'ids' if id_col is None else 'genders'} among {original.columns}")
    return id_col, gender


def cohort_table(pairs: list[tuple[DataFrame, DataFrame, str]], included: str = "Included Patients") -> DataFrame:
    """(Patient_ID, Cohort, Gender) of all cohorts, a pair of original and included table and the mark of the ids' form (BBB, YRM, NORM or none) for each.

    Ids of both are brought to one form and joined; of several original rows the first gender by its letter stays. In a NORM cohort the gender
    is read from the id. Null ids go, an id that one table lists twice stays once, and one in two cohorts is an error (cohort_union)."""
    out = []
    for original, processed, mark in pairs:
        ids = processed.select(S.stripped(F.col(f"`{included}`").cast("string")).alias("id")).filter("id is not null").distinct()
        if "NORM" in mark.upper():
            rows = ids.withColumn("Gender", S.gender_from_id(F.col("id")))
        else:
            id_col, gender = cohort_columns(original)
            known = original.select(S.norm_id(S.clean_id(F.col(f"`{id_col}`").cast("string")), F.lit(mark)).alias("match_id"), S.parse_gender(F.col(f"`{gender}`").cast("string")).alias("Gender"))
            known = known.groupBy("match_id").agg(F.min("Gender").alias("Gender"))
            rows = ids.withColumn("match_id", S.norm_id(F.col("id"), F.lit(mark))).join(known, "match_id", "left")
        out.append(rows.select("id", S.cohort_of(F.col("id")).alias("Cohort"), "Gender"))
    return cohort_union(*out).withColumnRenamed("id", "Patient_ID")


def myocardium(measures: DataFrame) -> DataFrame:
    """From (scene_id, surface, area, volume): the volume between epi and both chambers, and its mean thickness."""
    of = lambda c, s: F.sum(F.when(F.col("surface") == s, F.col(c)))
    volume = of("volume", "epi") - of("volume", "lv") - of("volume", "rv")
    return measures.groupBy("scene_id").agg(volume.alias("myocardium"), (volume / (F.sum("area") / 2)).alias("thickness"))
